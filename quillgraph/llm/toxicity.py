"""Toxicity by weak supervision.

*Voters* are lexicons and patterns: a fixed list of insults, lexicons of words and word beginnings that a
bounded sample of labelled documents sets apart, and patterns of style.  Each votes toxic, clean or
abstains.  A *generative label model* of votes given the hidden class is estimated by expectation
maximisation from how often each combination of votes occurs among all documents: every voter has
its own accuracy, and its vote may also depend on one other voter (the maximum spanning tree of the
conditional mutual information), which models correlated voters.  A given label is one more voter, of an
accuracy that is assumed.  A *linear classifier* on lexicon counts is then trained on the posterior labels of
the sample, of which some documents have a given label and some have none, and scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_fold, map_batches, text_bytes
from quillgraph.plans.staging import cut, drop

#: Labelled documents (about; chosen by a hash of the id) that lexicons and the classifier learn from, and
#: documents without a label that the classifier learns from by their posterior label alone.
SAMPLE, UNLABELLED = 20_000, 10_000
#: Terms that a learned lexicon holds at most, toxic documents that a term needs, least odds ratio.
LEXICON, SUPPORT, ODDS = 300, 4, 4.0
#: Rounds of expectation maximisation; share of given labels that are right; weight decay.
ROUNDS, TRUST, DECAY = 30, 0.98, 1e-3
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3

# A short list of insults of this package's own choosing; lexicons learned from labels stand beside it.
INSULTS = frozenset("bastard bitch clown coward creep cretin crap damn disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile jerk kill loser lunatic maggot moron nasty parasite pathetic pig rat ridiculous rubbish scum shit shut slut stupid sucker trash ugly useless vermin vile whore worm worthless wretch".split())
#: Lexicons: whole words, and their first so many characters.
HEADS = (4, 5, 6, 7)
LEXICONS = ("insult", "word", *(f"head{n}" for n in HEADS))
_YOU = re.compile(r"\b(?:you|your|tu|toi|vous|du|dich|sie|eres|usted)\b", re.IGNORECASE)
_SHOUT = re.compile(r"!{2,}")
_WORD = re.compile(r"[^\W\d_]+")

ABSTAIN, CLEAN, TOXIC = 0, 1, 2


def words_of(raw: bytes) -> list[str]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower())


def heads(word: str) -> list[tuple[str, str]]:
    """(lexicon, term) pairs that a word could match, but for the fixed list."""
    return [("word", word), *((f"head{n}", word[:n]) for n in HEADS if len(word) >= n)]


@dataclass
class Features:
    """Learned lexicons: (lexicon, term) -> number of the feature."""

    number: dict[tuple[str, str], int] = field(default_factory=dict)
    #: Features of the stronger half of each learned lexicon.
    strong: frozenset[int] = frozenset()
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        for w in sorted(INSULTS):
            self.number.setdefault(("insult", w), len(self.number))
        self.names = list(self.number)

    def __getstate__(self):
        return {"number": self.number, "strong": self.strong, "memo": {}, "names": self.names}

    def match(self, word: str) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            get = self.number.get
            found = tuple(k for t in [("insult", word), *heads(word)] if (k := get(t)) is not None)
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    def of(self, raw: bytes) -> tuple[dict[int, int], dict[str, int], dict[str, float]]:
        """Counts by feature, hits by lexicon, and figures of style of a text."""
        words = words_of(raw)
        counts: Counter = Counter()
        match = self.match
        for w in words:
            m = match(w)
            if m:
                counts.update(m)
        hits = dict.fromkeys(LEXICONS, 0)
        for k, n in counts.items():
            hits[self.names[k][0]] += n
        strong = frozenset(self.names[k][0] for k in counts if k in self.strong)
        return counts, hits, {"words": len(words), "strong": strong, "shout": len(_SHOUT.findall(raw.decode("utf-8", "replace"))) if b"!!" in raw else 0}


def votes(raw: bytes, hits: dict[str, int], style: dict) -> str:
    """One character for each voter.

    The voters of a learned lexicon have five joint votes, those of the insults three, and the patterns 72 at
    most, so that there are fewer than 700,000 combinations whatever the documents are.
    """
    out, n, any_hit = [], max(style["words"], 1), any(hits.values())
    for k in LEXICONS:
        h = hits[k]
        out.append(TOXIC if h else ABSTAIN)  # any hit
        out.append(TOXIC if h >= 3 else CLEAN if not h else ABSTAIN)  # several hits, or none
        if k != "insult":
            out.append(TOXIC if k in style["strong"] else ABSTAIN)  # a hit among the stronger terms
    rate = max(hits.values()) / n
    out.append(TOXIC if rate >= 0.02 else CLEAN if rate < 0.002 and n >= 30 else ABSTAIN)
    you = any_hit and _YOU.search(raw.decode("utf-8", "replace")) is not None
    out.append(TOXIC if you and hits["insult"] else ABSTAIN)
    out.append(TOXIC if you and style["strong"] else ABSTAIN)
    out.append(TOXIC if style["shout"] >= 3 and any_hit else CLEAN if not style["shout"] and not any_hit else ABSTAIN)
    out.append(TOXIC if len(style["strong"]) >= 3 else ABSTAIN)  # lexicons agree
    return "".join(map(str, out))


class LabelModel:
    """P(votes, class) with a tree of dependencies among voters, by expectation maximisation.

    A given label is a voter of the accuracy ``TRUST`` that depends on no other.
    """

    def __init__(self, patterns: list[str], counts: np.ndarray, labelled: np.ndarray):
        """counts: documents with each pattern; labelled: (clean, toxic) labelled documents with it."""
        self.at = {p: i for i, p in enumerate(patterns)}
        v = np.array([[int(c) for c in p] for p in patterns])
        n, m = v.shape
        one = np.eye(3)[v].reshape(n, 3 * m)  # patterns, (voter, vote)
        free = np.maximum(counts - labelled.sum(1), 0)
        total = free + labelled.sum(1)
        q = (labelled[:, 1] + 0.1) / (labelled.sum(1) + 1.0)  # toxic share, few labels pulled to 0.1
        self.logit = np.log(q / (1 - q))
        for _ in range(ROUNDS):
            toxic = free * self.posterior() + labelled[:, 1] * self.posterior(1) + labelled[:, 0] * self.posterior(0)
            w = np.stack([total - toxic, toxic])
            self.prior = (w.sum(1) + 1) / (w.sum() + 2)
            single = (w @ one).reshape(2, m, 3) + 0.5
            pair = np.stack([(one * x[:, None]).T @ one for x in w]).reshape(2, m, 3, m, 3) + 0.1
            self.parent = self._tree(pair)
            logp = np.log(self.prior)[:, None] + np.zeros((2, n))
            for j in range(m):
                i = self.parent[j]
                if i < 0:
                    t = np.log(single[:, j] / single[:, j].sum(1, keepdims=True))
                    logp += t[:, v[:, j]]
                else:
                    t = np.log(pair[:, i, :, j, :] / pair[:, i, :, j, :].sum(2, keepdims=True))
                    logp += t[:, v[:, i], v[:, j]]
            self.logit = logp[1] - logp[0]
        one = one.reshape(n, m, 3)
        self._calibrate(labelled)
        self.accuracy = [float(w[1] @ one[:, j, TOXIC] / max((w @ one[:, j, TOXIC]).sum(), 1e-9)) for j in range(m)]

    def _calibrate(self, labelled: np.ndarray) -> None:
        """Scale the logits to the given labels: voters that depend on more than one other overstate them."""
        if labelled.sum(0).min() < 10:
            return
        x, w = np.stack([np.clip(self.logit, -40, 40), np.ones(len(self.logit))], 1), np.array([1.0, 0.0])
        n, y = labelled.sum(1), labelled[:, 1]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (n * p - y) + (w - [1, 0]))
            w = w - step / max(1.0, float(np.abs(step).max()))
        self.logit = x @ w

    def posterior(self, given: int | None = None) -> np.ndarray:
        """P(toxic) of each pattern, beside a given label if there is one."""
        lift = {None: 0.0, 1: 1.0, 0: -1.0}[given] * math.log(TRUST / (1 - TRUST))
        return 1 / (1 + np.exp(-np.clip(self.logit + lift, -40, 40)))

    @staticmethod
    def _tree(pair: np.ndarray) -> list[int]:
        """Parents in the maximum spanning tree of mutual information given the class; -1: the root."""
        m = pair.shape[1]
        info = np.zeros((m, m))
        for k in range(2):
            p = pair[k] / pair[k].sum(axis=(1, 3), keepdims=True)
            a, b = p.sum(3, keepdims=True), p.sum(1, keepdims=True)
            info += pair[k].sum(axis=(1, 3)) / pair.sum(axis=(0, 2, 4)) * (p * np.log(p / (a * b))).sum(axis=(1, 3))
        parent, best = [-1] * m, info[0].copy()
        source, left = [0] * m, set(range(1, m))
        while left:
            j = max(sorted(left), key=lambda x: best[x])
            parent[j] = source[j]
            left.discard(j)
            for x in left:
                if info[j, x] > best[x]:
                    best[x], source[x] = info[j, x], j
        # parents stand before their children only by reference; tables hold any order
        return parent

    def of(self, pattern: str, given: int | None = None) -> float:
        return float(self.posterior(given)[self.at[pattern]])


def dense(hits: dict[str, int], style: dict[str, float]) -> list[float]:
    """Features that every document has: hits and rate by lexicon, length, style."""
    n = max(style["words"], 1)
    return [x for k in LEXICONS for x in (math.log2(1 + hits[k]), min(100.0 * hits[k] / n, 10.0))] + [math.log2(n) / 10, math.log2(1 + style["shout"]) / 5]


@dataclass
class Classifier:
    features: Features
    sparse: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, raw: bytes) -> float:
        counts, hits, style = self.features.of(raw)
        z = self.bias + float(np.dot(self.dense, dense(hits, style)))
        for k, n in counts.items():
            z += float(self.sparse[k]) * math.log2(1 + n)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_linear(rows: list[tuple[dict[int, int], list[float], float]], n_sparse: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels, with Adam on whole passes."""
    d = np.array([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    row = np.array([i for i, r in enumerate(rows) for _ in r[0]], int)
    col = np.array([k for r in rows for k in r[0]], int)
    val = np.log2(1.0 + np.array([c for r in rows for c in r[0].values()]))
    w, u, b = np.zeros(n_sparse), np.zeros(d.shape[1]), -2.0
    m = [np.zeros(n_sparse), np.zeros(d.shape[1]), 0.0]
    s = [np.zeros(n_sparse), np.zeros(d.shape[1]), 0.0]
    for t in range(1, 401):
        z = b + d @ u + np.bincount(row, weights=val * w[col], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        grads = [np.bincount(col, weights=val * g[row], minlength=n_sparse) + DECAY * w, d.T @ g + DECAY * 0.1 * u, g.sum()]
        step = []
        for i, x in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * x
            s[i] = 0.99 * s[i] + 0.01 * x * x
            step.append(0.05 * m[i] / (1 - 0.9**t) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-9))
        w, u, b = w - step[0], u - step[1], b - step[2]
    return w, u, float(b)


def learn_lexicons(sample: DataFrame, positive: int, negative: int) -> Features:
    """Terms whose odds of standing in a toxic document of the sample are high, by lexicon."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple[str, str], list[int]] = {}
        for raw, y in zip(text_bytes(b), b.column("toxic").to_pylist(), strict=True):
            for t in {t for w in set(words_of(raw)) for t in heads(w)}:
                seen.setdefault(t, [0, 0])[y] += 1
        return pa.RecordBatch.from_pydict(
            {"lexicon": pa.array([k for k, _ in seen], pa.string()), "term": pa.array([t for _, t in seen], pa.string()), "clean": pa.array([n[0] for n in seen.values()], pa.int64()), "toxic": pa.array([n[1] for n in seen.values()], pa.int64())}
        )

    found = map_batches(sample.select("text", "toxic"), kernel, "lexicon string, term string, clean bigint, toxic bigint").groupBy("lexicon", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = ((F.col("toxic") + 0.5) / (positive + 1)) / ((F.col("clean") + 0.5) / (negative + 1))
    strong = cut(found.where((F.col("toxic") >= SUPPORT) & (odds >= ODDS)).withColumn("worth", F.col("toxic") * F.log(odds)), "toxicity-terms")
    features = Features()
    for k in LEXICONS[1:]:
        for r in strong.where(F.col("lexicon") == k).orderBy(F.desc("worth"), "term").limit(LEXICON).collect():
            features.number.setdefault((k, r["term"]), len(features.number))
    features.names = list(features.number)
    for k in LEXICONS[1:]:
        own = [i for (name, _), i in features.number.items() if name == k]
        features.strong |= frozenset(own[: -(-len(own) // 2)])
    return features


def pattern_counts(docs: DataFrame, features: Features) -> dict[str, int]:
    """How many documents have each combination of votes (see ``votes`` for how many there can be)."""
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        f = shared.value
        seen = Counter(votes(raw, *f.of(raw)[1:]) for raw in text_bytes(b))
        return pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = map_batches(docs.select(F.col("text").cast("string").alias("text")), kernel, "pattern string, n bigint")
    return {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def train(docs: DataFrame, labels: DataFrame, learning) -> Classifier:
    """The classifier; ``learning`` is a condition on doc_id for the labels that may be used.

    Labels other than 0 and 1 are left out, and a document with both counts as toxic.  Documents without a
    label that the sample takes stand under ``learning`` too.  Without a toxic and a clean label the fixed list
    alone decides.
    """
    spark = docs.sparkSession
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(learning).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    picked = own.where(dice < min(1.0, SAMPLE / max(n, 1)))
    # at most about SAMPLE ids: small enough to send to every task
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = rows.join(F.broadcast(picked), "doc_id").select("text", "toxic")
    other = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("unlabelled")), F.lit(1 << 20)) / float(1 << 20)
    unknown = rows.where(learning).where(other < min(1.0, UNLABELLED / max(docs.count(), 1))).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_anti").select("text", F.lit(None).cast("int").alias("toxic"))
    sample = cut(known.unionByName(unknown), "toxicity-sample")
    by = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    features = learn_lexicons(sample.where("toxic IS NOT NULL"), by.get(1, 0), by.get(0, 0)) if by.get(1) and by.get(0) else Features()
    shared = spark.sparkContext.broadcast(features)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        f, out = shared.value, []
        for raw in text_bytes(b):
            counts, hits, style = f.of(raw)
            out.append((list(counts), list(counts.values()), dense(hits, style), votes(raw, hits, style)))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.float64())), pa.array([o[3] for o in out], pa.string()), b.column("toxic")], ["k", "n", "dense", "votes", "toxic"])

    rows = map_batches(sample, kernel, "k array<int>, n array<int>, dense array<double>, votes string, toxic int").collect()
    width = 2 * len(LEXICONS) + 2
    if not (by.get(1) and by.get(0)):
        u = np.zeros(width)
        u[0] = 4.0
        return Classifier(features, np.zeros(len(features.number)), u, -2.0)
    patterns = pattern_counts(docs, features)
    labelled = {p: [0, 0] for p in patterns}
    for r in rows:
        if r["toxic"] is not None:
            labelled.setdefault(r["votes"], [0, 0])[r["toxic"]] += 1
    names = sorted(labelled)
    model = LabelModel(names, np.array([patterns.get(p, 0) for p in names], float), np.array([labelled[p] for p in names], float))
    posterior = {given: model.posterior(given) for given in (None, 0, 1)}
    soft = [(dict(zip(r["k"], r["n"], strict=True)), r["dense"], float(posterior[r["toxic"]][model.at[r["votes"]]])) for r in rows if r["toxic"] is not None or r["votes"] in model.at]
    drop(sample)
    return Classifier(features, *fit_linear(soft, len(features.number)))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for each row from its whole text; a null text scores as the empty one.

    Repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array([m.score(raw) for raw in text_bytes(b)], pa.float64())], [id_col, "score"])

    rows = docs.select(id_col, F.col("text").cast("string").alias("text"))
    return map_batches(rows, kernel, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels, crc_fold("doc_id", 4) != 2))
    return scored.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
