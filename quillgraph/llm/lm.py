"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token mixes the maximum-likelihood estimates of orders 0 to 2 (uniform, by
token, by token after its predecessor); the weights depend on how often the predecessor was seen (in
buckets of powers of two) and are learned by expectation maximisation on held-out counts: each
training bigram is *deleted* from the counts before it is predicted from the rest.

Counts are exact and cover the whole corpus, and no table of them is ever held in one place:

1. Tasks turn documents into *blocks*: token numbers of a block-local vocabulary, in a table that is
   bucketed by block in the shared folder, so that what comes back for a block joins it without moving it.
2. Each block asks for the counts of its distinct tokens; requests go to ranges of the token hash.
   A range adds up what the blocks counted and answers every block.  So that packed requests stay
   large and their number grows with the corpus alone, at most ``FAN`` blocks ask the same range: with more
   blocks, groups of ``FAN`` first merge what they ask for in one coarse range and ask as one, level by
   level, and the answers come back the same way.
3. The same for bigrams.  A request also says how often the bigram's two tokens occur, so that
   the range can put each deleted bigram into a histogram of bounded size, from which the weights
   are learned.
4. Each block scores its documents.

Frequent tokens and bigrams are one request a block however often they occur, so nothing is skewed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_fold, planes, unplanes
from quillgraph.plans.staging import cut, drop, remove, run_dir, ship_package

#: Tokens of a block (a longer document is a block of its own) and requests that a range receives.
BLOCK_TOKENS, RANGE_KEYS = 700_000, 500_000
#: Blocks, or groups of blocks, that ask the same range at most (about, at the first level: they are hashed).
FAN = 512
#: Steps an octave of counts in the histogram; rounds of expectation maximisation.
STEPS, ROUNDS = 4, 40
END, BEGIN = 0, 1  # local numbers of the end token and of the context before the first token
_MARKS = (b" ", b"\t")  # no word holds white space

BLOCKS_SCHEMA = "block string, doc_ids array<{}>, held array<boolean>, sizes array<int>, ids binary, hashes binary, counts binary, n bigint, docs bigint"


def tokens_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    return raw.lower().split()


def make_blocks(docs: DataFrame) -> str:
    """Blocks of documents as a table bucketed by block (see BLOCKS_SCHEMA); its name."""
    spark = docs.sparkSession
    ship_package(spark)

    def run(batches):
        number, ids, doc_ids, held, sizes, made = {}, [], [], [], [], 0

        def fresh():
            return {m: k for k, m in enumerate(_MARKS)}

        def flush(kind):
            all_ids = np.concatenate(ids)
            learn = np.repeat(~np.array(held), sizes)
            counts = np.bincount(all_ids[learn], minlength=len(number)).astype("<u4")
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([f"{TaskContext.get().partitionId()}-{made}"]),
                    "doc_ids": pa.array([doc_ids], pa.list_(kind)),
                    "held": pa.array([held], pa.list_(pa.bool_())),
                    "sizes": pa.array([sizes], pa.list_(pa.int32())),
                    "ids": pa.array([planes(all_ids)], pa.binary()),
                    "hashes": pa.array([hashes.tobytes()], pa.binary()),
                    "counts": pa.array([planes(counts)], pa.binary()),
                    "n": pa.array([len(number)], pa.int64()),
                    "docs": pa.array([held.count(False)], pa.int64()),
                }
            )

        number, total, kind = fresh(), 0, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for d, h, i in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), range(b.num_rows), strict=True):
                words = tokens_of(b.column("text")[i].as_py() or b"")
                if doc_ids and total + len(words) > BLOCK_TOKENS:
                    yield flush(kind)
                    made += 1
                    number, ids, doc_ids, held, sizes, total = fresh(), [], [], [], [], 0
                own = number.setdefault
                x = np.fromiter((own(w, len(number)) for w in words), np.int32, len(words))
                ids += [x, np.array([END], np.int32)]
                doc_ids.append(d)
                held.append(h)
                sizes.append(len(x) + 1)
                total += len(x) + 1
        if doc_ids:
            yield flush(kind)

    rows = docs.select("doc_id", (crc_fold("doc_id", 10) == 0).alias("held"), F.col("text").cast("string").cast("binary").alias("text"))
    name = f"quillgraph_lm_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    rows.mapInArrow(run, BLOCKS_SCHEMA.format(rows.schema["doc_id"].dataType.simpleString())).write.bucketBy(buckets, "block").sortBy("block").format("parquet").option("path", f"{run_dir(spark)}/{name}").saveAsTable(name)
    return name


# --- requests and answers ----------------------------------------------------------------------

REQUEST = "part bigint, grp bigint, child string, keys binary, counts binary, marks binary"
ANSWER = "child string, part bigint, totals binary, seen bigint, hist binary"


def levels_of(blocks: int, keys: int) -> list[tuple[int, int]]:
    """For each level of the exchange: ranges that a unit asks, and ranges that there are in all."""
    out, total = [], 1
    while blocks > FAN:
        total, blocks = total * FAN, -(-blocks // FAN)
        out.append((FAN, total))
    parts = -(-max(8, -(-keys // RANGE_KEYS)) // total)
    return [*out, (parts, total * parts)]


def requests(child: str, grp: int, keys: np.ndarray, counts: np.ndarray, marks: np.ndarray, low: int, parts: int, total: int) -> pa.Table:
    """One row for each of the ``parts`` ranges from number ``low`` on (of ``total``) that has some of the
    sorted, distinct keys; marks: two bytes a key, or none."""
    edges = np.searchsorted(keys, np.array([(k << 64) // total for k in range(low + 1, low + parts)], np.uint64))
    cuts = [0, *edges.tolist(), len(keys)]
    rows = [(k, s, e) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if s < e]
    return pa.table(
        {
            "part": pa.array([low + k for k, _, _ in rows], pa.int64()),
            "grp": pa.array([grp] * len(rows), pa.int64()),
            "child": pa.array([child] * len(rows), pa.string()),
            "keys": pa.array([planes(np.diff(keys[s:e], prepend=np.uint64(0))) for _, s, e in rows], pa.binary()),
            "counts": pa.array([planes(counts[s:e].astype("<u8")) for _, s, e in rows], pa.binary()),
            "marks": pa.array([planes(marks[s:e]) if len(marks) else b"" for _, s, e in rows], pa.binary()),
        }
    )


def level(c: np.ndarray) -> np.ndarray:
    """Counts as whole steps of their logarithm; 0 for none."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1)) * STEPS + 1e-9) + 1, 0).astype(np.uint8)


def count_of(lev: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level (exact for counts below eight)."""
    first = np.ceil(np.exp2((lev - 1) / STEPS) - 1e-9)
    return (first + np.maximum(first, np.ceil(np.exp2(lev / STEPS) - 1e-9) - 1)) / 2


def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all requests of a group: distinct keys, sums of their counts, marks, and where each request's
    keys stand among them."""
    keys = [np.cumsum(unplanes(k, "<u8"), dtype=np.uint64) for k in group.column("keys").to_pylist()]
    counts = [unplanes(c, "<u8") for c in group.column("counts").to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(every), np.int64)
    np.add.at(totals, at, np.concatenate(counts).astype(np.int64))
    marks = group.column("marks").to_pylist()
    own = np.empty(0, "<u2")
    if marks[0]:
        own = np.zeros(len(every), "<u2")
        own[at] = np.concatenate([unplanes(m, "<u2") for m in marks])
    spans = np.cumsum([0, *(len(k) for k in keys)])
    return every, totals, own, [at[s:e] for s, e in zip(spans, spans[1:], strict=False)]


def answers(group: pa.Table, totals: np.ndarray, at: list[np.ndarray], seen: int = 0, hist: bytes = b"") -> pa.Table:
    n = len(at)
    return pa.table(
        {
            "child": group.column("child"),
            "part": group.column("part"),
            "totals": pa.array([planes(totals[x].astype("<u8")) for x in at], pa.binary()),
            "seen": pa.array([seen] + [0] * (n - 1), pa.int64()),
            "hist": pa.array([hist] + [b""] * (n - 1), pa.binary()),
        }
    )


def answered(group: pa.Table) -> pa.Table:
    """Totals over all units that ask a range, for each in the order of its keys."""
    _, totals, marks, at = merged(group)
    live, hist = totals > 0, b""
    if len(marks):
        pair = marks[live].view(np.uint8).reshape(-1, 2).astype(np.int64)
        codes, inverse = np.unique(pair[:, 0] << 16 | pair[:, 1] << 8 | level(totals[live]), return_inverse=True)
        hist = np.stack([codes, np.bincount(inverse, weights=totals[live]).astype(np.int64)]).tobytes()
    return answers(group, totals, at, int(live.sum()), hist)


def exchange(asked: DataFrame, levels: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Answers to all requests, and those of the last level (with its histograms), in shared storage."""
    if len(levels) == 1:
        out = cut(asked.groupBy("part").applyInArrow(answered, ANSWER), "lm-answers")
        return out, out
    asked = cut(asked, "lm-asked")
    parts, total = levels[1]

    def up(group: pa.Table) -> pa.Table:
        part, grp = group.column("part")[0].as_py(), group.column("grp")[0].as_py()
        keys, counts, marks, _ = merged(group)
        return requests(f"{part}/{grp}", grp // FAN, keys, counts, marks, part * parts, parts, total)

    def down(group: pa.Table, found: pa.Table) -> pa.Table:
        return answers(group, _totals(found.column("up")[0].as_py()), merged(group)[3])

    upper, top = exchange(asked.groupBy("part", "grp").applyInArrow(up, REQUEST), levels[1:])
    units = asked.withColumn("unit", F.concat_ws("/", "part", "grp")).groupBy("unit")
    out = cut(units.cogroup(by_child(upper, "up").groupBy("child")).applyInArrow(lambda a, b: down(a.drop_columns(["unit"]), b), ANSWER), "lm-answers")
    drop(asked, *([] if upper is top else [upper]))
    return out, top


def by_child(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "totals"))), lambda x: x["totals"]).alias(name))


def _totals(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([unplanes(p, "<u8") for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)


def _bigrams(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers and 64-bit bigram keys at every token."""
    before = np.concatenate([[BEGIN], ids[:-1]]) if len(ids) else ids
    before[np.cumsum(sizes)[:-1]] = BEGIN
    a, b = hashes[before], hashes[ids]
    key = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    return before, (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _block(row: dict) -> tuple:
    hashes = np.frombuffer(row["hashes"], "<u8")
    ids = unplanes(row["ids"], "<i4")
    sizes = np.array(row["sizes"], np.int64)
    return hashes, ids, sizes, np.array(row["held"], bool)


def _token_counts(row: dict, hashes: np.ndarray) -> np.ndarray:
    """Counts over the whole corpus of the block's tokens, by local number."""
    order = np.argsort(hashes)
    out = np.empty(len(hashes), np.int64)
    out[order] = _totals(row["tokens"])
    return out


def learn_weights(hist: np.ndarray, n: int, v: int) -> np.ndarray:
    """Weights (uniform, token, bigram) for each bucket of context counts; bucket 0 is unseen.

    hist: rows (levels of context, token and bigram; number of deleted tokens).
    """
    weights = np.tile([1.0, 0.0, 0.0], (65, 1))
    if not len(hist):
        return weights
    cv, cw, cvw = count_of(hist[:, 0]), count_of(hist[:, 1]), count_of(hist[:, 2])
    cvw = np.minimum(cvw, np.minimum(cv, cw))
    p = np.stack([np.full(len(hist), 1 / (v + 1)), (cw - 1) / max(n - 1, 1), np.where(cv > 1, (cvw - 1) / np.maximum(cv - 1, 1), 0)], 1)
    bucket, mass = (hist[:, 0].astype(int) - 1) // STEPS + 1, hist[:, 3].astype(float)

    def em(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        w = np.full(q.shape[1], 1 / q.shape[1])
        for _ in range(ROUNDS):
            post = q * w
            post /= post.sum(1, keepdims=True)
            w = np.maximum((post * m[:, None]).sum(0) / m.sum(), 1e-6)
            w /= w.sum()
        return w

    weights[:, :2] = em(p[:, :2], mass)
    for b in np.unique(bucket):
        own = bucket == b
        weights[b] = em(p[own], mass[own])
    # a bucket that no deleted bigram fell into takes the weights of the one below it
    for b in range(2, len(weights)):
        if not (bucket == b).any():
            weights[b] = weights[b - 1] if (bucket == b - 1).any() or b > bucket.max() else weights[b]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0.  Null and empty texts have the end
    token only.  Repeated rows stay and count as often as they occur; without a row to learn from all
    scores are 0; an empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    table = make_blocks(docs)
    blocks = spark.table(table)
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    docs_learned = size["docs"] or 0
    groups = -(-max(size["blocks"], 1) // FAN)
    token_levels, pair_levels = levels_of(size["blocks"], size["n"] or 0), levels_of(size["blocks"], size["tokens"] or 0)

    def ask(block: str, keys: np.ndarray, counts: np.ndarray, marks: np.ndarray, levels: list[tuple[int, int]]) -> pa.Table:
        return requests(block, xxhash.xxh64_intdigest(block) % groups, keys, counts, marks, 0, *levels[0])

    def ask_tokens(batches):
        for b in batches:
            for row in b.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], "<u8"), unplanes(row["counts"], "<u4")
                order = np.argsort(hashes)
                yield from ask(row["block"], hashes[order], counts[order], np.empty(0, "<u2"), token_levels).to_batches()

    tokens, token_tops = exchange(blocks.select("block", "hashes", "counts").mapInArrow(ask_tokens, REQUEST), token_levels)
    v = token_tops.agg(F.sum("seen")).first()[0] or 0
    by_block = lambda found, name: by_child(found, name).withColumnRenamed("child", "block")
    with_tokens = blocks.join(by_block(tokens, "tokens"), "block")

    def ask_pairs(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        hashes, ids, sizes, held = _block(row)
        count = _token_counts(row, hashes)
        context = count.copy()
        context[BEGIN] = docs_learned
        before, key = _bigrams(ids, sizes, hashes)
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        own = np.bincount(at, weights=np.repeat(~held, sizes), minlength=len(keys))
        marks = np.stack([level(context[before[first]]), level(count[ids[first]])], 1)
        return ask(row["block"], keys, own, np.ascontiguousarray(marks).view("<u2").ravel(), pair_levels)

    pairs, pair_tops = exchange(with_tokens.select("block", "held", "sizes", "ids", "hashes", "tokens").groupBy("block").applyInArrow(ask_pairs, REQUEST), pair_levels)

    def spread(batches):
        for b in batches:
            for h in b.column("hist").to_pylist():
                codes, n = np.frombuffer(h, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"code": pa.array(codes), "n": pa.array(n)})

    hist = pair_tops.where(F.length("hist") > 0).select("hist").mapInArrow(spread, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, mass = hist.column("code").to_numpy(), hist.column("n").to_numpy()
    n = int(mass.sum())
    weights = learn_weights(np.stack([code >> 16, code >> 8 & 255, code & 255, mass], 1) if len(code) else np.empty((0, 4)), n, v)

    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def score_block(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        hashes, ids, sizes, held = _block(row)
        count = _token_counts(row, hashes)
        context = count.copy()
        context[BEGIN] = docs_learned
        before, key = _bigrams(ids, sizes, hashes)
        _, at = np.unique(key, return_inverse=True)
        pair = _totals(row["pairs"])[at]
        c, cv = count[ids], context[before]
        w = weights[np.where(cv > 0, np.floor(np.log2(np.maximum(cv, 1)) + 1e-9).astype(int) + 1, 0)]
        p = w[:, 0] / (v + 1) + w[:, 1] * c / max(n, 1) + w[:, 2] * pair / np.maximum(cv, 1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        return pa.table(
            {
                "doc_id": group.column("doc_ids").combine_chunks().flatten(),
                "held_out": pa.array(held),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(total(c > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sizes), n, np.int64)),
                "base_score": pa.array(total(np.log10((c + 0.1) / (n + 0.1 * (v + 1))))),
                "score": pa.array(total(np.log10(p))),
            }
        )

    joined = blocks.select("block", "doc_ids", "held", "sizes", "ids", "hashes").join(by_block(tokens, "tokens"), "block").join(by_block(pairs, "pairs"), "block")
    out = cut(joined.groupBy("block").applyInArrow(score_block, f"doc_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"), "lm-scores")
    drop(tokens, token_tops, pairs, pair_tops)
    spark.sql(f"DROP TABLE {table}")
    remove(spark, f"{run_dir(spark)}/{table}")
    return out


def op3(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
