"""Near-duplicate detection with SimHash fingerprints and bit-sliced comparison.

1. A document's fingerprint is the bitwise majority of the hashes of its word shingles.
2. Equal fingerprints become one representative each.
3. Two fingerprints within two bits agree on two of four 16-bit parts at least, so each
   representative goes to the six groups named by two of its parts.  A large group is split further
   by the same argument on the bits that are left (three sub-parts, one of which agrees), down to
   50 fixed bits, so that no group holds more than 2**14 fingerprints however the data are skewed.
4. Inside a group the fingerprints are stored as vertical bit planes.  A query updates the distances
   of a whole block at once with carry-save counters and leaves the block as soon as every member
   exceeds the radius.  Only links that join two classes of the group are kept, so a group of n
   fingerprints yields fewer than n links and connectivity is whole.
5. Classes are connected components over all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import append_columns, map_batches, text_bytes
from quillgraph.operators.components import connected_components
from quillgraph.plans.staging import cut, ship_package

RADIUS = 2
#: Words of a shingle and the seed of its XXH64, as the query's contract has them.
WORDS, SEED = 3, 42
#: Fingerprints of a group beyond which it is split by more bits.
GROUP = 2048
#: Fingerprints that stand in one block of bit planes.
BLOCK = 4096

PARTS = [(i * 16, 16) for i in range(4)]


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of lower-cased (A-Z) words; 0 for a text without words."""
    w = raw.lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return h(b" ".join(w), SEED)
    join = b" ".join
    hashes = np.array([h(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)], np.uint64)
    n = len(hashes)
    planes = np.zeros(64, np.int64)
    for s in range(0, n, 1 << 16):  # bounded whatever the length of the text
        bits = np.unpackbits(hashes[s : s + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        planes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * planes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed 64-bit number.

    Null and empty texts, and texts of white space, have fingerprint zero.  Other columns are not read.
    """

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in text_bytes(b)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp, pa.int64())], [id_col, "fp"])

    rows = docs.select(id_col, F.col("text").cast("string").alias("text"))
    return map_batches(rows, kernel, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp bigint")


def with_fingerprints(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with a column for their fingerprint, and its name."""

    def kernel(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in text_bytes(b)], np.uint64).view(np.int64), pa.int64())]

    out, (name,) = append_columns(docs, kernel, [("fp", "bigint")])
    return out, name


def bits(fp, at: int, n: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(level, key, fp): groups of at least two fingerprints such that every pair within the radius
    shares one, and none of which is larger than its number of free bits allows."""
    fp = F.col("fp")
    pairs = [(a, b) for a, b in combinations(range(4), 2)]
    first = F.array(*[F.struct(F.lit(k).alias("c"), (F.shiftleft(bits(fp, 16 * a, 16), 16) + bits(fp, 16 * b, 16)).alias("key")) for k, (a, b) in enumerate(pairs)])
    level0 = reps.select("fp", F.explode(first).alias("g")).select(F.col("g.c").alias("c"), "g.key", "fp")

    def sized(df: DataFrame) -> DataFrame:
        n = df.groupBy("c", "key").count()
        return df.join(n.where("count > 1"), ["c", "key"])

    # the 32 bits that key c leaves free, low part first
    free = F.lit(0).cast("long")
    for k, (a, b) in enumerate(pairs):
        x, y = [p for p in range(4) if p not in (a, b)]
        free = F.when(F.col("c") == k, bits(fp, 16 * x, 16) + F.shiftleft(bits(fp, 16 * y, 16), 16)).otherwise(free)
    sized0 = cut(sized(level0), "simhash-groups")
    out = sized0.where(F.col("count") <= GROUP).select(F.lit(0).alias("level"), "c", "key", "fp")
    big = sized0.where(F.col("count") > GROUP)
    if big.isEmpty():
        return out
    # 32 free bits: parts of 11, 11 and 10, one of which agrees; then 21 or 22: parts of 7 or 8
    cuts = [(0, 11), (11, 11), (22, 10)]
    sub = F.array(*[F.struct(F.lit(s).alias("s"), bits(free, at, n).alias("v")) for s, (at, n) in enumerate(cuts)])
    level1 = big.select("c", "key", "fp", free.alias("free"), F.explode(sub).alias("g")).select((F.col("c") * 3 + F.col("g.s")).alias("c1"), F.struct("key", F.col("g.v")).alias("key1"), "fp", "free")
    n1 = level1.groupBy("c1", "key1").count()
    sized1 = cut(level1.join(n1.where("count > 1"), ["c1", "key1"]), "simhash-groups")
    as_key = F.concat_ws(":", F.col("key1.key"), F.col("key1.v"))
    out = out.select("level", "c", F.col("key").cast("string").alias("key"), "fp")
    out = out.unionByName(sized1.where(F.col("count") <= GROUP).select(F.lit(1).alias("level"), F.col("c1").alias("c"), as_key.alias("key"), "fp"))
    big1 = sized1.where(F.col("count") > GROUP)
    rest = []
    for s in range(3):
        left = [p for i, p in enumerate(cuts) if i != s]
        low, high = left
        both = bits(F.col("free"), low[0], low[1]) + F.shiftleft(bits(F.col("free"), high[0], high[1]), low[1])
        n = low[1] + high[1]
        third = [(0, 7), (7, 7), (14, n - 14)]
        rest.append(F.when(F.col("c1") % 3 == s, F.array(*[F.concat(F.lit(f"{i}:"), bits(both, at, m).cast("string")) for i, (at, m) in enumerate(third)])))
    level2 = big1.select("c1", as_key.alias("key1"), "fp", F.explode(F.coalesce(*rest)).alias("v"))
    return out.unionByName(level2.select(F.lit(2).alias("level"), F.col("c1").alias("c"), F.concat_ws("/", "key1", "v").alias("key"), "fp"))


class Planes:
    """A block of fingerprints as 64 vertical bit planes (an integer of one bit a member each)."""

    def __init__(self, fps: list[int]):
        self.n = len(fps)
        m = np.array(fps, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        cols = np.packbits(np.unpackbits(m, axis=1, bitorder="little"), axis=0, bitorder="little")
        planes = [int.from_bytes(cols[:, j].tobytes(), "little") for j in range(64)]
        self.all = (1 << self.n) - 1
        # planes on which all members agree can't tell members apart; they are compared once a block
        self.same = [(j, p & 1) for j, p in enumerate(planes) if p in (0, self.all)]
        self.free = [(j, p) for j, p in enumerate(planes) if p not in (0, self.all)]

    def within(self, q: int, radius: int = RADIUS, among: int | None = None) -> int:
        """The members (as a bit mask) at most ``radius`` bits from q; ``among`` limits them."""
        alive = self.all if among is None else among
        base = sum(1 for j, b in self.same if (q >> j & 1) != b)
        if base > radius:
            return 0
        # carry-save: bit k of every member's distance stands in counter[k]; what overflows is out
        width = (radius + 1).bit_length()
        counter = [self.all if base >> k & 1 else 0 for k in range(width)]
        for j, p in self.free:
            carry = (self.all ^ p) if q >> j & 1 else p
            carry &= alive
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
                if not carry:
                    break
            if carry:
                alive &= ~carry
            over = self._over(counter, radius)
            if over & alive:
                alive &= ~over
                if not alive:  # the whole block is out of reach
                    return 0
        return alive

    def _over(self, counter: list[int], radius: int) -> int:
        """Members whose counter is greater than the radius."""
        more, equal = 0, self.all
        for k in range(len(counter) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counter[k]
            else:
                more |= equal & counter[k]
                equal &= ~counter[k]
        return more


def group_links(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between distinct fingerprints of a group that suffice to connect all within the radius."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for s in range(0, len(fps), BLOCK):
        block = Planes(fps[s : s + BLOCK])
        for i, q in enumerate(fps[: s + block.n]):
            among = block.all if i < s else block.all & ~((2 << (i - s)) - 1)
            hit = block.within(q, radius, among) if among else 0
            while hit:
                low = hit & -hit
                j = s + low.bit_length() - 1
                hit ^= low
                a, b = root(i), root(j)
                if a != b:
                    parent[b] = a
                    links.append((q, fps[j]))
    return links


def links(reps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints; their components are those of all pairs in reach."""
    ship_package(reps.sparkSession)
    groups = candidate_groups(reps)
    # a task walks through its groups in key order, one at a time
    rows = groups.select(F.concat_ws("|", "level", "c", "key").alias("g"), "fp").repartition("g").sortWithinPartitions("g", "fp")

    def run(batches):
        at, held = None, []

        def done(found):
            x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(x[:, 0], pa.int64()), "b": pa.array(x[:, 1], pa.int64())})

        found = []
        for b in batches:
            for g, fp in zip(b.column("g").to_pylist(), b.column("fp").to_pylist(), strict=True):
                if g != at:
                    found += group_links(held)
                    at, held = g, []
                    if len(found) > 100_000:
                        yield done(found)
                        found = []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
        found += group_links(held)
        yield done(found)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, fp (signed 64-bit fingerprint), component_id (least id that is reachable)
    and root (a fingerprint that names the class).

    Texts without words have fingerprint zero and are linked like any other.  Equal rows stay as many
    rows.  Rows with a null id take part; a class of null ids only has a null component_id.  An empty
    table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col), "simhash")
    reps = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    comps = connected_components(links(reps.select("fp")), "a", "b")
    named = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = cut(named.join(least, "component").select("fp", "component_id", F.col("component").alias("root")), "simhash")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id", "root")


def op5(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
