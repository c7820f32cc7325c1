"""Language identification by prediction by partial matching (PPM).

For every language a byte context tree of variable order (up to ``ORDER``) is counted from labelled
texts and then frozen.  The code length of a byte is taken at the longest context that the language
has seen; a byte that did not follow there costs an escape and falls to the next shorter context,
down to the uniform distribution over 256 bytes (escape method C).  Because the statistics are
frozen, the exact code length of a byte depends on its ``ORDER`` predecessors only, so all code
lengths that a context tree can give are put into one table of n-grams, and a text is scored with
vectorised look-ups.  The language with the shortest code wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import append_columns, crc_fold, map_batches, text_bytes

#: Bytes of the longest context; the begin of a text is preceded by as many zero bytes.
ORDER = 3
#: Labelled documents that each language's tree is counted from (about; chosen by a hash of the id).
DOCS_PER_LANGUAGE = 4000
#: Labelled documents a language (about) that are left out of the trees to calibrate scores and rates on, and
#: bits a byte by which the least likely thousandth of them may be exceeded before a text counts as no language,
#: documents that it takes to tell, and bits that any text has free, as the rate of a short one says little.
CALIBRATION, MARGIN, LEAST, FREE = 400, 2.0, 100, 32.0
#: Bits that code lengths are divided by before they become a probability, where nothing could be fitted.
TEMPERATURE = 16.0
#: The prediction for texts without a letter.
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams (as uint32) at every byte of the texts, and each text's first gram and length."""
    pad = b"\0" * ORDER
    raw = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]]) if len(texts) else np.empty(0, np.int64)
    n = max(0, len(raw) - ORDER)
    grams = np.zeros(n, np.uint32)
    for k in range(ORDER + 1):
        grams = (grams << np.uint32(8)) | raw[k : k + n]
    return grams, starts.astype(np.int64), lengths


def _real(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which grams end in a byte of a text (and not in the padding before the next)."""
    edge = np.zeros(n + ORDER + 2, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:n] > 0


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows of (lang, text); grams of ORDER + 1 bytes as numbers."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, out = np.array(b.column("lang").to_pylist(), object), []
        texts = text_bytes(b)
        for lang in sorted(set(langs)):
            grams, starts, lengths = _joined([t for t, k in zip(texts, langs, strict=True) if k == lang])
            g, n = np.unique(grams[_real(len(grams), starts, lengths)], return_counts=True)
            out.append((lang, g, n))
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([k for k, g, _ in out for _ in range(len(g))], pa.string()),
                "gram": pa.array(np.concatenate([g for _, g, _ in out]).astype(np.int64), pa.int64()),
                "n": pa.array(np.concatenate([n for _, _, n in out]).astype(np.int64), pa.int64()),
            }
        )

    return map_batches(rows, kernel, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Frozen:
    """Code lengths in bits.  grams[m]: sorted keys of m + 1 bytes seen after m bytes in any
    language, cost[m]: their code length in each language; contexts[m], escape[m]: likewise."""

    langs: list[str]
    grams: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    temperature: float = TEMPERATURE
    #: Bits a byte beyond which a text is none of the language's.
    rates: dict[str, float] = field(default_factory=dict)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram, for every language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        left, g = np.arange(len(grams)), grams
        for m in range(ORDER, -1, -1):
            keys = self.grams[m]
            at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
            hit = keys[at] == g if len(keys) else np.zeros(len(g), bool)
            if m == ORDER:
                np.take(self.cost[m], at, axis=0, out=out)
                out[~hit] = 0
            else:
                out[left[hit]] += self.cost[m][at[hit]]
            left, g = left[~hit], g[~hit]
            if not len(left):
                return out
            ctx, keys = g >> np.uint32(8), self.contexts[m]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, ctx), len(keys) - 1)
                out[left] += np.where((keys[at] == ctx)[:, None], self.escape[m][at], 0)
            g = g & np.uint32((1 << 8 * m) - 1) if m else g
        out[left] += 8.0
        return out

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in each language."""
        grams, starts, lengths = _joined(texts)
        total = np.zeros((len(texts), len(self.langs)))
        step = 1 << 20
        edges = np.zeros((1, len(self.langs)))
        at = np.empty((len(starts) * 2, len(self.langs)))
        # running sums, kept only where a text starts or ends
        marks = np.stack([starts, starts + lengths], 1).ravel()
        order, done = np.argsort(marks, kind="stable"), 0
        real = _real(len(grams), starts, lengths)
        for s in range(0, max(len(grams), 1), step):
            run = np.cumsum(np.where(real[s : s + step, None], self.bits(grams[s : s + step]), 0), axis=0, dtype=np.float64)
            run = np.concatenate([edges, edges + run])
            while done < len(order) and marks[order[done]] <= s + len(run) - 1:
                at[order[done]] = run[marks[order[done]] - s]
                done += 1
            edges = run[-1:]
        return at[1::2] - at[0::2] if len(texts) else total


def freeze(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Frozen:
    """Context trees of all languages as tables; counts: language -> (grams, their numbers)."""
    grams, cost, contexts, escape = [], [], [], []
    for m in range(ORDER + 1):
        mask = np.uint32((1 << 8 * (m + 1)) - 1) if m < 3 else np.uint32(0xFFFFFFFF)
        own = {}
        for k in langs:
            g, at = np.unique(counts[k][0] & mask, return_inverse=True)
            own[k] = (g, np.bincount(at, weights=counts[k][1]))
        keys = np.unique(np.concatenate([g for g, _ in own.values()])) if langs else np.empty(0, np.uint32)
        ctxs = np.unique(keys >> np.uint32(8)) if m else np.zeros(min(1, len(keys)), np.uint32)
        lower = np.full((len(keys), len(langs)), 8.0)
        if m:
            below = keys & np.uint32((1 << 8 * m) - 1)
            lower = cost[m - 1][np.searchsorted(grams[m - 1], below)]
        c, e = np.array(lower, np.float64), np.zeros((len(ctxs), len(langs)))
        for j, k in enumerate(langs):
            g, n = own[k]
            ctx = np.searchsorted(ctxs, g >> np.uint32(8) if m else np.zeros(len(g), np.uint32))
            total, distinct = np.bincount(ctx, weights=n, minlength=len(ctxs)), np.bincount(ctx, minlength=len(ctxs))
            known = distinct > 0
            e[known, j] = np.log2((total[known] + distinct[known]) / distinct[known])
            c[:, j] += e[np.searchsorted(ctxs, keys >> np.uint32(8) if m else np.zeros(len(keys), np.uint32)), j]
            c[np.searchsorted(keys, g), j] = np.log2((total[ctx] + distinct[ctx]) / n)
        grams.append(keys)
        cost.append(c.astype(np.float32))
        contexts.append(ctxs)
        escape.append(e.astype(np.float32))
    return Frozen(langs, grams, cost, contexts, escape)


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, calibration: int = CALIBRATION) -> Frozen:
    """Count and freeze context trees from rows of ``docs`` that have a language and a text.

    Every language takes about ``per_language`` of its documents (all, if it has fewer), chosen by a
    hash of doc_id; the model's size is bounded by that sample.  About ``calibration`` documents more, a tenth
    of a small language, are left out of the trees: on them the temperature of the scores and each
    language's rate are fitted.
    """
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    kept, low = F.lit(0.0), F.lit(0.0)
    for k in langs:
        out = min(0.1, calibration / sizes[k])
        kept = F.when(F.col("lang") == k, min(1.0, out + per_language / sizes[k])).otherwise(kept)
        low = F.when(F.col("lang") == k, out).otherwise(low)
    dice = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    counts = {k: (np.empty(0, np.uint32), np.empty(0)) for k in langs}
    if langs:
        found = gram_counts(rows.where((dice >= low) & (dice < kept)).select("lang", "text")).toArrow()
        lang, gram, n = (np.array(found.column(c).to_pylist()) if c == "lang" else found.column(c).to_numpy() for c in ("lang", "gram", "n"))
        for k in langs:
            own = lang == k if len(lang) else np.zeros(0, bool)
            counts[k] = (gram[own].astype(np.uint32), n[own].astype(np.float64))
    model = freeze(langs, counts)
    if langs:
        calibrate(model, rows.where(dice < low).select("lang", "text"))
    return model


def calibrate(model: Frozen, rows: DataFrame) -> None:
    """Fit the temperature and the languages' rates on rows of (lang, text) that the trees don't know."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(b)
        return pa.RecordBatch.from_arrays([b.column("lang"), pa.array([len(t) for t in texts], pa.int64()), pa.array(list(shared.value.text_bits(texts)), pa.list_(pa.float64()))], ["lang", "size", "bits"])

    found = [r for r in map_batches(rows, kernel, "lang string, size bigint, bits array<double>").collect() if r["size"]]
    if not found:
        return
    at = {k: i for i, k in enumerate(model.langs)}
    bits, gold, size = np.array([r["bits"] for r in found]), np.array([at[r["lang"]] for r in found]), np.array([r["size"] for r in found])
    for k, i in at.items():
        rate = (bits[:, i] / size)[gold == i]
        if len(rate) >= LEAST:
            model.rates[k] = min(8.0, float(np.quantile(rate, 0.999) + MARGIN))
    gap = bits - bits[np.arange(len(gold)), gold][:, None]  # a text's own language against the others

    def loss(t: float) -> float:
        x = -gap / t * np.log(2)
        top = x.max(axis=1)
        return float((top + np.log(np.exp(x - top[:, None]).sum(axis=1))).mean())

    # never below one bit: code lengths are probabilities themselves
    model.temperature = min((2.0 ** (k / 4) for k in range(0, 41)), key=loss)


def judge(model: Frozen, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and bits a byte in that language, of each text; ties go to the first name."""
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
    bits = model.text_bits(texts)
    best = np.argmin(bits, axis=1) if len(texts) else np.empty(0, int)
    p = np.exp2((bits.min(axis=1, keepdims=True) - bits) / model.temperature) if len(texts) else bits
    score = 1.0 / p.sum(axis=1) if len(texts) else np.empty(0)
    letter = np.array([_LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
    rate = bits.min(axis=1) / np.maximum([len(t) for t in texts], 1) if len(texts) else np.empty(0)
    return [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, letter, strict=True)], np.where(letter, score, 0.0), rate


def identify(docs: DataFrame, model: Frozen, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for each row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0.  Repeated rows stay; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, _ = judge(shared.value, text_bytes(b))
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    rows = docs.select(id_col, F.col("text").cast("string").alias("text"))
    return map_batches(rows, kernel, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_fold("doc_id", 4) != 2)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages; all columns stay.

    Rejected are ``und`` (null texts, texts without a letter) and texts whose code in the best language takes
    more bits than ``FREE`` and that language's rate for each byte: ``MARGIN`` more than all but a thousandth of its
    documents that calibration left out of the trees.  The rate is 8 bits, that of random bytes, at most, and
    with fewer than ``LEAST`` of these documents.  An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(learning_rows(docs)))

    def kernel(b: pa.RecordBatch) -> list[pa.Array]:
        texts = text_bytes(b)
        lang, _, rate = judge(shared.value, texts)
        return [pa.array([k != UNDETERMINED and (r - shared.value.rates.get(k, 8.0)) * len(t) < FREE for t, k, r in zip(texts, lang, rate, strict=True)], pa.bool_())]

    out, (kept,) = append_columns(docs, kernel, [("kept", "boolean")])
    return out.where(F.col(kept)).drop(kept)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(learning_rows(docs)))
    return found.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
