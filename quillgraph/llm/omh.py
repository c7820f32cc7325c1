"""Document fingerprints by Order MinHash, in DataFrame expressions only.

The k-mers of a text are runs of ``K`` words (split at single spaces); in a text of few words or of
words so long that spaces can't be what parts it, they are runs of ``K + GRAM - 1`` characters.  Equal k-mers are numbered in
text order, so that a repeated one counts as often as it stands there.  The hashes of the numbered
k-mers fall into ``BINS`` ranges, as in one-permutation hashing; the ``PICK`` least hashes of a
range, put back into text order, are hashed as one tuple.  A tuple survives an edit only if its
k-mers all survive *and* keep their order, which makes the share of equal tuples follow the edit
distance rather than the overlap of sets.

A hashed k-mer and its position travel in one 63-bit number (36 bits of hash, 27 of position), so
that arrays stay primitive and sorting them is cheap.  Texts of more than 2**27 words keep positions
modulo that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.staging import cut

#: Words of a k-mer, ranges of the hash, and k-mers of a tuple.
K, BINS, PICK = 2, 32, 2
#: Characters take the place of words in texts of at least LEAST_CHARS of them that have fewer than
#: FEW_WORDS words, or more than LONG_WORD characters a word; GRAM characters then make a "word".
LEAST_CHARS, FEW_WORDS, LONG_WORD, GRAM = 8, 8, 20, 3
_POS, _HASH = 27, 36
_MASK = (1 << _POS) - 1
_BIN = _POS + _HASH - (BINS.bit_length() - 1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, _POS)


def _same(a: Column, b: Column, shift: int) -> Column:
    return F.shiftright(a, shift).eqNullSafe(F.shiftright(b, shift))


def _packed(h: Column, pos: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH), _POS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(_MASK)))


def _number(s: Column, x: Column, i: Column) -> Column:
    """How many equal k-mers stand before x, number i of the sorted array s."""
    steps = F.sequence(F.floor(F.log2(F.size(s))).cast("int"), F.lit(0), F.lit(-1))
    back = lambda a, k: a + F.call_function("shiftleft", F.lit(1), k)
    found = F.aggregate(steps, F.lit(0), lambda a, k: F.when(_same(F.get(s, i - back(a, k)), x, _POS), back(a, k)).otherwise(a))
    return F.when(_same(F.get(s, i - 1), x, _POS), found).otherwise(F.lit(0))


def signature(text: Column) -> Column:
    """The tuples of a text: array of (range << 32 | 32-bit tuple hash), ascending by range.

    Null counts as the empty text, which has the one word "".
    """
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    grams = lambda c: F.transform(c, lambda x, i: F.concat_ws("", x, *[F.get(c, i + j) for j in range(1, GRAM)]))
    few = lambda w: (n >= LEAST_CHARS) & ((F.size(w) < FEW_WORDS) | (n > LONG_WORD * F.size(w)))
    words = _let(F.split(text, " "), lambda w: F.when(few(w), _let(F.split(text, ""), grams)).otherwise(w))
    positions = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0)))
    kmers = lambda w: F.sort_array(F.transform(positions(w), lambda i: _packed(F.xxhash64(*[F.get(w, i + j) for j in range(K)]), i)))
    numbered = lambda s: F.sort_array(F.transform(s, lambda x, i: _packed(F.xxhash64(_hash_of(x), _number(s, x, i)), x)))
    least = lambda z: F.filter(z, lambda x, i: ~_same(F.get(z, i - PICK), x, _BIN))

    def entry(c: Column, x: Column, i: Column) -> Column:
        """The tuple that starts with x, the least of its range; null for the others of the range."""
        own = [F.get(c, i + j) for j in range(PICK)]
        tied = F.array_compact(F.array(*[F.when(_same(o, x, _BIN), F.struct(o.bitwiseAND(F.lit(_MASK)).alias("p"), _hash_of(o).alias("h"))) for o in own]))
        ordered = F.transform(F.array_sort(tied), lambda o: o["h"])
        short = F.shiftrightunsigned(F.xxhash64(ordered), 32)
        return F.when(~_same(F.get(c, i - 1), x, _BIN), F.shiftleft(F.shiftright(x, _BIN), 32).bitwiseOR(short))

    tuples = lambda c: F.array_compact(F.transform(c, lambda x, i: entry(c, x, i)))
    return _let(words, lambda w: _let(kmers(w), lambda s: _let(numbered(s), lambda z: _let(least(z), tuples))))


def as_text(sig: Column) -> Column:
    """Ten hexadecimal digits for each tuple: two for its range, eight for its hash."""
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples among the ranges that either text uses."""
    ranges = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    return (F.size(F.array_intersect(a, b)) / F.size(F.array_union(ranges(a), ranges(b)))).cast("double")


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next) over the distinct keys in ascending order, the last followed by the first.

    Null is the least key.  Only key ranges meet in one task: each range finds its own successors, and
    one row a range links it to the next.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = ids.select(key).distinct().select(key, F.lit(1).alias("one"))
    ranged = cut(own.repartitionByRange(n, F.col(key).asc_nulls_first()).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy(F.col(key).asc_nulls_first())
    # a struct tells "no successor in this range" from "the successor is null"
    led = ranged.select(key, "part", F.lead(F.struct(F.col(key).alias("k"))).over(inside).alias("n"))
    first = ranged.groupBy("part").agg(F.min_by(F.struct(F.col(key).alias("k")), F.struct(F.col(key).isNotNull(), key)).alias("f"))
    order = Window.orderBy("part")  # one row a range
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    link = first.select("part", F.coalesce(F.lead("f").over(order), F.first("f").over(every)).alias("after"))
    return led.join(F.broadcast(link), "part").select(key, F.coalesce("n", "after")["k"].alias("next"))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, the fingerprints and their likeness.

    Where rows share a doc_id, each gets its row; as a next document they count once, with the least
    text, and as a neighbour with the least fingerprint.  A null text is empty; null is the least
    doc_id.  One document alone is its own next.  Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    needs = rows.groupBy("doc_id").agg(F.max(quarter).alias("q"))
    after = cut(_linked(needs), "omh-next")
    # the next document hands on as many code points as the one before it needs
    giver = after.select(F.col("next").alias("g"), F.col("doc_id").alias("to"), "q").hint("shuffle_hash")
    given = rows.join(giver, rows["doc_id"].eqNullSafe(giver["g"])).where("q > 0").select("to", F.substring("text", F.lit(1), F.col("q")).alias("head"))
    given = given.groupBy("to").agg(F.min("head").alias("head")).hint("shuffle_hash")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    made = rows.join(given, rows["doc_id"].eqNullSafe(given["to"]), "left").select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    done = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature(F.col("text")).alias("sig"), signature(F.col("edited")).alias("edited_sig"))
    done = cut(done, "omh")
    neighbour = done.groupBy("doc_id").agg(F.min("sig").alias("next_sig")).withColumnRenamed("doc_id", "nid")
    near = after.select(F.col("doc_id").alias("of"), "next")
    near = near.join(neighbour, near["next"].eqNullSafe(neighbour["nid"])).select("of", "next_sig")
    out = done.join(near, done["doc_id"].eqNullSafe(near["of"]))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def _linked(needs: DataFrame) -> DataFrame:
    s = successors(needs, "doc_id").withColumnRenamed("doc_id", "k")
    return needs.join(s, needs["doc_id"].eqNullSafe(s["k"])).select("doc_id", "next", "q")


def op9(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
