"""Benchmark decontamination with a distributed positional inverted index.

The training text is cut into *segments* (runs of documents inside one task).  A segment stores its own
vocabulary and, for every term of it, the ascending positions at which it stands; positions run on over
the documents of the segment, with a gap between two documents so that no phrase crosses them.  The index
knows nothing of any test set and can be searched with one after another.  A phrase is found by taking
the posting list of its rarest term, shifting it by the term's offset in the phrase, and
intersecting the shifted lists of the other terms, rarest first, until none is left.  Proximity
search intersects the same lists with a tolerance, inside each document.

Segments are rows of a Parquet table in the shared folder; searching is a scan of that table without
any shuffle, and the test items travel to it in blocks of bounded size.  A segment first tells which test
terms its vocabulary has; phrases that lack one there are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import planes, unplanes
from quillgraph.plans.staging import cut, ship_package

#: Words of a window.
WINDOW = 13
#: Words that one segment holds at most (a longer document is a segment of its own).
SEGMENT_WORDS = 1_500_000
#: Words of test items that are searched at once; bounds the broadcast and what the driver holds.
ITEM_BLOCK_WORDS = 500_000
#: Rows that a search hands on at once.
ROWS_OUT = 5000

#: Lower-cases A-Z and makes a space of every ASCII byte that is neither a letter nor a digit.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return raw.translate(_WORD_BYTES).split()


@dataclass
class Segment:
    """Postings of some documents: ``pos[off[t]:off[t + 1]]`` are the positions of term number t."""

    off: np.ndarray
    pos: np.ndarray

    def postings(self, t: int) -> np.ndarray:
        return self.pos[self.off[t] : self.off[t + 1]]

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Start positions of every exact occurrence of a phrase."""
        sizes = [(int(self.off[t + 1] - self.off[t]), j, t) for j, t in enumerate(terms)]
        sizes.sort()
        if not sizes or not sizes[0][0]:
            return np.empty(0, np.int64)
        n, j, t = sizes[0]
        found = self.postings(t) - j
        for n, j, t in sizes[1:]:
            p = self.postings(t)
            at = np.searchsorted(p, found + j)
            at[at == n] = n - 1
            found = found[p[at] == found + j]
            if not len(found):
                break
        return found

    def near(self, terms: list[int], slack: int, starts: np.ndarray | None = None, lengths: np.ndarray | None = None) -> np.ndarray:
        """Positions of the rarest term that have every other term within ``slack`` words, in the same
        document if the documents' first positions and lengths are given."""
        sizes = sorted((int(self.off[t + 1] - self.off[t]), t) for t in set(terms))
        if not sizes or not sizes[0][0]:
            return np.empty(0, np.int64)
        found = self.postings(sizes[0][1])
        for n, t in sizes[1:]:
            p = self.postings(t)
            low, high = found - slack, found + slack
            if starts is not None:
                d = np.searchsorted(starts, found, "right") - 1
                low, high = np.maximum(low, starts[d]), np.minimum(high, starts[d] + lengths[d] - 1)
            at = np.searchsorted(p, low)
            found = found[(at < n) & (p[np.minimum(at, n - 1)] <= high)]
        return found


def make_segment(ids: np.ndarray, n_terms: int) -> Segment:
    """``ids``: term number at each position, -1 where no word stands."""
    at = np.flatnonzero(ids >= 0)
    t = ids[at]
    order = np.argsort(t, kind="stable")
    return Segment(np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_terms))]), at[order].astype(np.int64))


def gaps(s: Segment) -> np.ndarray:
    """Positions as distances within their own list, which are small and compress well."""
    gap = np.diff(s.pos, prepend=0).astype("<i4")
    first = s.off[:-1][s.off[:-1] < s.off[1:]]
    gap[first] = s.pos[first]
    return gap


def from_gaps(off: np.ndarray, gap: np.ndarray) -> Segment:
    pos = np.cumsum(gap, dtype=np.int64)
    first = off[:-1][off[:-1] < off[1:]]
    # each list starts from its own first position, not from the end of the list before it
    if len(first):
        base = np.zeros(len(gap), np.int64)
        base[first] = np.diff(pos[first] - gap[first], prepend=0)
        pos = pos - np.cumsum(base)
    return Segment(off, pos)


def text_hash() -> Column:
    """What the index keeps of a text: its XXH64, null counting as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))


def build_index(docs: DataFrame) -> DataFrame:
    """Positional postings of every word of every document, one row a segment, in shared storage.

    Null and empty texts have no words and still stand in ``doc_ids``.  Repeated rows are indexed as
    often as they occur.  ``text_hashes`` has the XXH64 of each text, by which a verdict finds its row again.
    doc_id keeps its type.  Only columns doc_id and text are read.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        number, doc_ids, hashes, starts, lengths, parts, held, made = {}, [], [], [], [], [], 0, 0

        def flush(kind):
            s = make_segment(np.concatenate(parts), len(number))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{TaskContext.get().partitionId()}-{made}"]),
                    pa.array([doc_ids], pa.list_(kind)),
                    pa.array([hashes], pa.list_(pa.int64())),
                    pa.array([starts], pa.list_(pa.int32())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([zstandard.compress(b" ".join(number), 1)], pa.binary()),
                    pa.array([planes(np.diff(s.off).astype("<i4"))], pa.binary()),
                    pa.array([planes(gaps(s))], pa.binary()),
                ],
                ["segment", "doc_ids", "text_hashes", "starts", "lengths", "terms", "counts", "gaps"],
            )

        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for i, (d, h) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), strict=True)):
                w = words_of(b.column("text")[i].as_py() or b"")
                if doc_ids and held + len(w) > SEGMENT_WORDS:
                    yield flush(kind)
                    made += 1
                    number, doc_ids, hashes, starts, lengths, parts, held = {}, [], [], [], [], [], 0
                own = number.setdefault
                doc_ids.append(d)
                hashes.append(h)
                starts.append(held)
                lengths.append(len(w))
                parts.append(np.fromiter((own(x, len(number)) for x in w), np.int32, len(w)))
                parts.append(np.full(1, -1, np.int32))  # no phrase crosses documents
                held += len(w) + 1
        if doc_ids:
            yield flush(kind)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_hash().alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"segment string, doc_ids array<{kind}>, text_hashes array<bigint>, starts array<int>, lengths array<int>, terms binary, counts binary, gaps binary"), "postings")


def read_segment(row: dict, wanted: dict[bytes, int]) -> tuple[Segment, np.ndarray]:
    """The postings, and the segment's number of each wanted term (-1 where it has none)."""
    local = np.full(len(wanted), -1, np.int64)
    get = wanted.get
    for i, t in enumerate(zstandard.decompress(row["terms"]).split(b" ")):
        k = get(t)
        if k is not None:
            local[k] = i
    off = np.concatenate([[0], np.cumsum(unplanes(row["counts"], "<i4"), dtype=np.int64)])
    return from_gaps(off, unplanes(row["gaps"], "<i4")), local


Item = tuple[str | None, list[bytes]]


def item_blocks(items: DataFrame) -> Iterator[list[Item]]:
    """Blocks of (item id as text, words), of bounded size each; one block at least.

    The test set is read row by row through the driver, which holds one block at a time.  Items without
    words go; an item without an id is searched like any other.
    """
    block, held, given = [], 0, False
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("text")).toLocalIterator():
        w = words_of((r["text"] or "").encode())
        if not w:
            continue
        block.append((r["i"], w))
        held += len(w)
        if held >= ITEM_BLOCK_WORDS:
            yield block
            block, held, given = [], 0, True
    if block or not given:
        yield block


def numbered(lists: list[list[bytes]]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Numbers of all terms, and the lists in these numbers."""
    number: dict[bytes, int] = {}
    own = number.setdefault
    out = [np.array([own(t, len(number)) for t in w], np.int64) for w in lists]
    return number, out


def phrase_hits(index: DataFrame, items: list[Item], window: int = WINDOW) -> DataFrame:
    """For each document row: its words, positions inside any window of an item, and those items.

    An item without an id hits like any other; ``items`` can't name it.
    """
    number, lists = numbered([w for _, w in items])
    windows: dict[tuple[int, ...], set[str]] = {}
    for (i, _), k in zip(items, lists, strict=True):
        for s in range(max(1, len(k) - window + 1)):
            windows.setdefault(tuple(k[s : s + window].tolist()), set()).update([i] if i is not None else [])
    # windows of one length make one matrix
    sizes = sorted({len(k) for k in windows})
    asked = index.sparkSession.sparkContext.broadcast((number, [(np.array([k for k in windows if len(k) == n], np.int32), [sorted(v) for k, v in windows.items() if len(k) == n]) for n in sizes]))
    id_kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches):
        wanted, by_size = asked.value
        for b in batches:
            kind = b.schema.field("doc_ids").type.value_type
            for row in b.to_pylist():
                starts, lengths = np.array(row["starts"], np.int64), np.array(row["lengths"], np.int64)
                seg, local = read_segment(row, wanted)
                edge, found = np.zeros(int(starts[-1] + lengths[-1] + 2), np.int32), {}
                for matrix, owners in by_size:
                    own = local[matrix]
                    for r in np.flatnonzero((own >= 0).all(axis=1)).tolist():
                        at = seg.phrase(own[r].tolist())
                        if len(at):
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + matrix.shape[1], -1)
                            for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                                found.setdefault(d, set()).update(owners[r])
                hit = np.cumsum(edge)[:-1] > 0
                hits = [np.flatnonzero(hit[s : s + m]).tolist() if d in found else [] for d, (s, m) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True))]
                for s in range(0, len(starts), ROWS_OUT):
                    e = min(s + ROWS_OUT, len(starts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"]] * (e - s)),
                            pa.array(range(s, e), pa.int32()),
                            pa.array(row["doc_ids"][s:e], kind),
                            pa.array(row["text_hashes"][s:e], pa.int64()),
                            pa.array(lengths[s:e], pa.int64()),
                            pa.array(hits[s:e], pa.list_(pa.int32())),
                            pa.array([sorted(found.get(d, ())) for d in range(s, e)], pa.list_(pa.string())),
                        ],
                        ["segment", "ord", "doc_id", "text_hash", "n_words", "hit", "items"],
                    )

    return index.mapInArrow(search, f"segment string, ord int, doc_id {id_kind}, text_hash bigint, n_words bigint, hit array<int>, items array<string>")


def proximity_matches(index: DataFrame, items: DataFrame, slack: int) -> DataFrame:
    """(doc_id, text_hash, item_id, position) where all words of an item stand close together.

    A match is a word position (from 0, in its document) of the item's rarest word in that segment which
    has every other word of the item within ``slack`` words, before or after, in the same document; order
    and repetition don't matter.  Items without words match nothing; items without an id match with a
    null one.  A document row that matches nothing has no row here.
    """
    spark, id_kind = index.sparkSession, index.schema["doc_ids"].dataType.elementType.simpleString()

    def matches(block: list[Item]) -> DataFrame:
        number, lists = numbered([w for _, w in block])
        asked = spark.sparkContext.broadcast((number, [(i, np.unique(k)) for (i, _), k in zip(block, lists, strict=True)]))

        def search(batches):
            wanted, own_lists = asked.value
            for b in batches:
                kind = b.schema.field("doc_ids").type.value_type
                for row in b.to_pylist():
                    starts, lengths = np.array(row["starts"], np.int64), np.array(row["lengths"], np.int64)
                    seg, local = read_segment(row, wanted)
                    for i, k in own_lists:
                        own = local[k]
                        at = seg.near(own.tolist(), slack, starts, lengths) if (own >= 0).all() else np.empty(0, np.int64)
                        for s in range(0, len(at), ROWS_OUT):
                            p = at[s : s + ROWS_OUT]
                            d = np.searchsorted(starts, p, "right") - 1
                            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][x] for x in d.tolist()], kind), pa.array([row["text_hashes"][x] for x in d.tolist()], pa.int64()), pa.array([i] * len(p), pa.string()), pa.array(p - starts[d], pa.int64())], ["doc_id", "text_hash", "item_id", "position"])

        return index.mapInArrow(search, f"doc_id {id_kind}, text_hash bigint, item_id string, position bigint")

    found = over_blocks(items, matches)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def over_blocks(items: DataFrame, search) -> list[DataFrame]:
    """``search`` of each block of items; beyond one, each result goes to storage before the next block
    is read, so that the driver lets go of the block."""
    out = []
    for block in item_blocks(items):
        if len(out) == 1:
            out[0] = cut(out[0], "hits")
        out.append(search(block) if not out else cut(search(block), "hits"))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, hit positions, items found, contaminated.

    A document is contaminated if it has a hit word and at least one word in twenty is hit.  Null,
    empty and word-free texts have no words and no hits.  An empty test set hits nothing.  An item without an
    id hits, but isn't among the items found.  Repeated
    rows and rows that share a doc_id each get a row of their own.  Other columns are not read.
    """
    index = build_index(docs)
    parts = over_blocks(items, lambda block: phrase_hits(index, block, window))
    hits = parts[0]
    if len(parts) > 1:  # the rows of a document meet again by their place in the index
        for p in parts[1:]:
            hits = hits.unionByName(p)
        gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        hits = hits.groupBy("segment", "ord", "doc_id", "text_hash", "n_words").agg(gather("hit"), gather("items"))
    n_hit = F.size("hit").cast("long")
    return hits.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "hit", "items", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def digest(items: list[str]) -> str:
    """What the query's items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op2(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda s: array_to_string(w[s:s + 12], ' '))) AS k FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
dwin AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS k FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.s, d.n, w.item FROM dwin d JOIN wins w ON d.k = w.k AND d.n = w.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
