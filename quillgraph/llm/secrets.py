"""Secret scanning: fixed rules, and a character-level convolutional network over every candidate.

Candidates are the findings of three fixed rules, the values of assignments under any name, and all
other tokens that don't look like a plain word.  The network sees a candidate whole, with the text
around it: characters are embedded, convolved, pooled by maximum over all positions, and scored by a
logistic unit.  It is trained in numpy on labelled findings only: the rules' findings, and secrets and
non-secrets of many forms that are generated from a seed and the text's own common words.  What no
label is known of teaches nothing.  Scores are calibrated on findings that were held out; the threshold
is even odds, or lower if that is needed to recall the wanted share of them.  All candidates are
scored.  A rule's finding always stays; the network adds candidates that no rule finds.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import append_columns, map_batches
from quillgraph.plans.staging import cut

# The rules of the query's contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of 24 and more: a run is taken whole
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "cnn")

#: Other candidates: values that any name is given, and tokens that are no plain word.
VALUE = re.compile(r"""(?<![A-Za-z0-9])[A-Za-z_][A-Za-z0-9_-]*["']?\x20*[:=]\x20*["']?([^\s"'<>,;:=\[\]](?:[^\s"'<>,;\[\]]{4,})[^\s"'<>,;.\[\]])""")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])|.*[a-z].*[A-Z]|[A-Z]+[a-z]+[A-Z]|[A-Za-z]{20,}$|[A-Z]{12,}$", re.DOTALL)

#: Documents (about, by a hash of the id) that the rules' findings and common words are taken from, and
#: how many of either.
SAMPLE_DOCS, SAMPLE_FINDINGS = 20_000, 2_000
#: Generated findings of either label, and documents of the sample that make a word common.
GENERATED, COMMON = 4_000, 3
#: Characters of context on either side; share of held-out secrets that the threshold must recall.
LEFT, RIGHT, RECALL = 24, 8, 0.98
#: Characters of the longest finding that the network learns from (it scores findings of any length).
LONGEST_LEARNED = 1000
EMBED, WIDTH, FILTERS, EPOCHS = 12, 5, 24, 16
#: Characters of a candidate that are convolved at once; a longer one goes slice by slice.
SLICE = 1 << 14
REDACTED = "[SECRET]"

Span = tuple[int, int, str]


def rule_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind: leftmost non-overlapping matches of each rule."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Assigned values, then unusual tokens, that overlap no finding of a rule nor one another."""
    # findings of rules may overlap one another: joined into runs, one of them at most can hold a place
    runs: list[list[int]] = []
    for s, e, _ in base:
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    values = _apart([m.span(1) for m in VALUE.finditer(text)], runs)
    tokens = _apart([m.span() for m in CANDIDATE.finditer(text) if _MIXED.match(m[0])], runs)
    return sorted([*values, *_apart(tokens, values)])


def _apart(spans: list[tuple[int, int]], taken: list) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``; both are ascending and apart among themselves."""
    out, k = [], 0
    for s, e in spans:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or e <= taken[k][0]:
            out.append((s, e))
    return out


def characters(text: str, start: int, end: int, context: bool = True) -> list[int]:
    """The candidate and what stands around it as numbers below 130; 1 and 2 mark its ends."""
    left, right = (text[max(0, start - LEFT) : start], text[end : end + RIGHT]) if context else ("", "")
    of = lambda s: [min(ord(c), 127) + 2 for c in s]
    return [*of(left), 1, *of(text[start:end]), 2, *of(right)]


def _padded(rows: list[list[int]]) -> np.ndarray:
    """Rows of one length; a window starts at each character, and zeros stand behind the last one."""
    width = WIDTH - 1 + max((len(r) for r in rows), default=1)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


@dataclass
class Network:
    """Weights, the calibration (a, b) of the logit, and the threshold of the calibrated score."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        embed = rng.normal(0, 0.3, (130, EMBED)).astype(np.float32)
        embed[0] = 0
        return cls(embed, rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32), 0.0)

    def forward(self, x: np.ndarray):
        e = self.embed[x]
        n, t, _ = e.shape
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, t - WIDTH + 1, WIDTH * EMBED)
        h = windows @ self.conv + self.bias
        # what a row's neighbours in the batch add to its padding tells nothing
        h = np.where((np.arange(h.shape[1]) < np.maximum((x > 0).sum(1), 1)[:, None])[:, :, None], h, -np.inf)
        at = h.argmax(axis=1)
        top = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0], 0)
        return top @ self.out + self.out_bias, top, at, windows

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        """Of any number of candidates of any length, in batches of bounded size."""
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        while order and len(rows[order[-1]]) > SLICE:
            i = order.pop()
            out[i] = self._long(rows[i])
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e + 1 - s) * len(rows[order[e]]) <= 40_000:
                e += 1
            out[order[s:e]] = self.forward(_padded([rows[i] for i in order[s:e]]))[0]
            s = e
        return out

    def _long(self, row: list[int]) -> float:
        """The logit of a long candidate: maxima of slices that overlap by a window less one."""
        best = np.zeros(FILTERS)
        for s in range(0, len(row), SLICE):
            part = row[s : s + SLICE + WIDTH - 1]
            part = part + [0] * (min(SLICE, len(row) - s) + WIDTH - 1 - len(part))
            best = np.maximum(best, self.forward(np.array([part]))[1][0])
        return float(best @ self.out + self.out_bias)

    def probability(self, rows: list[list[int]]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(rows) + b, -40, 40)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean logistic loss: by weight array, and of the last bias."""
        z, top, at, windows = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y).astype(self.out.dtype) / len(y)
        d_top = d[:, None] * self.out * (top > 0)
        taken = np.take_along_axis(windows, at[:, :, None], 1)  # n, filters, window
        grads = {"out": top.T @ d, "bias": d_top.sum(0), "conv": np.einsum("nf,nfw->wf", d_top, taken)}
        d_e = (d_top[:, :, None] * self.conv.T[None]).reshape(len(y), FILTERS, WIDTH, EMBED)
        where = np.take_along_axis(x, (at[:, :, None] + np.arange(WIDTH)).reshape(len(y), -1), 1)
        g = np.zeros_like(self.embed)
        np.add.at(g, where.ravel(), d_e.reshape(-1, EMBED))
        g[0] = 0
        return grads | {"embed": g}, float(d.sum())

    def step(self, x: np.ndarray, y: np.ndarray, moments: dict, t: int, rate: float) -> None:
        """One step of Adam on the logistic loss."""
        grads, bias = self.gradients(x, y)
        self.out_bias -= rate * bias
        for k, g in grads.items():
            m, v = moments.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[k] = (m, v)
            setattr(self, k, getattr(self, k) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))


def fit(secrets: list[list[int]], others: list[list[int]], recall: float = RECALL, seed: int = 7) -> Network | None:
    """Train, calibrate and choose the threshold; None if either label has fewer than ten findings.

    Findings of the same characters, with whatever stands around them, are held out together.
    """
    if min(len(secrets), len(others)) < 10:
        return None
    rng = np.random.default_rng(seed)
    rows, y = [*secrets, *others], np.array([1] * len(secrets) + [0] * len(others))
    number: dict[tuple, int] = {}
    own = np.array([number.setdefault(tuple(r[r.index(1) : r.index(2)]) if 1 in r and 2 in r else tuple(r), len(number)) for r in rows])
    order = rng.permutation(len(rows))
    out = np.isin(own, rng.permutation(len(number))[: max(1, len(number) // 5)]) if len(number) > 10 else np.arange(len(rows)) % 5 == 0
    held, learn = order[out[order]], order[~out[order]]
    net, moments, t = Network.fresh(rng), {}, 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for s in range(0, len(learn), 64):
            t += 1
            part = learn[s : s + 64]
            net.step(_padded([rows[i] for i in part]), y[part], moments, t, 3e-3)
    # Platt scaling with bounded Newton steps on the held-out findings; the prior keeps it finite where they are apart
    z, w = net.logits([rows[i] for i in held]), np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y[held]) + (w - [1, 0]))
        w -= step / max(1.0, 2 * float(np.abs(step).max()))
    net.scale = (float(w[0]), float(w[1]))
    good = np.sort(net.probability([rows[i] for i, k in zip(held, y[held], strict=True) if k]))
    # one half, where the calibrated odds are even, or less if that recalls too little
    net.threshold = float(min(0.5, good[int((1 - recall) * len(good))])) if len(good) else 0.5
    return net


#: Names that generated secrets, and other values, are assigned to; no rule knows any of them.
_SECRET_NAMES = "pwd pass passphrase client_key private_key access_code credential credentials auth bearer signing_key key licence_key pin_code session db_pass master_key".split()
_OTHER_NAMES = "note title date version colour author name status order page label source category path file model created updated id url key".split()
_WORDS = "about after again answer between country different example family following general important language letter morning mountain number paper people picture question river school science second sentence something station street system together winter without window yellow".split()


def _secret(rng: random.Random, words: list[str]) -> tuple[str, bool]:
    """A generated secret, and whether it can be told without a name before it."""
    draw = lambda alphabet, low, high: "".join(rng.choices(alphabet, k=rng.randint(low, high)))
    alnum, symbols = string.ascii_letters + string.digits, "!@#$%^&*+?"
    form = rng.randrange(9)
    if form == 0:
        return draw(alnum, 12, 48), True
    if form == 1:
        return draw(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), 12, 23), True
    if form == 2:
        return draw(alnum + "+/", 16, 60) + rng.choice(["", "=", "=="]), True
    if form == 3:
        return draw(string.ascii_letters, 16, 40), True
    if form == 4:
        return draw(rng.choice([string.ascii_lowercase, string.ascii_uppercase]), 20, 40), True
    if form == 5:
        return rng.choice(["sk_live_", "ghp_", "pk-", "xoxb-", "key-", "eyJ"]) + draw(alnum, 16, 36), True
    if form == 6:
        return draw(alnum + symbols, 8, 16), False
    if form == 7:
        return draw(string.ascii_lowercase + string.digits, 8, 12), False
    return rng.choice(words).capitalize() + draw(string.digits, 2, 4) + draw(symbols, 1, 2), False


def _other(rng: random.Random, words: list[str]) -> str:
    """A generated candidate that is no secret."""
    w = lambda: rng.choice(words)
    n = lambda low, high: str(rng.randint(low, high))
    form = rng.randrange(12)
    if form == 0:
        return w()
    if form == 1:
        return rng.choice([w().capitalize(), w().upper(), (w() + w()).upper()])
    if form == 2:
        return "".join(w().capitalize() for _ in range(rng.randint(2, 4)))
    if form == 3:
        return rng.choice("_-/").join(w() for _ in range(rng.randint(2, 5)))
    if form == 4:
        return f"{n(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(["", f"T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}Z"])
    if form == 5:
        return w() + rng.choice(["", "-", "_"]) + n(1, 9999)
    if form == 6:
        return n(1, 99999) + rng.choice(["", "-", "_"]) + w()
    if form == 7:
        return f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}"
    if form == 8:
        return "".join(w() for _ in range(rng.randint(2, 4)))
    if form == 9:
        return w() + "".join(w().capitalize() for _ in range(rng.randint(1, 3)))
    if form == 10:
        return rng.choice(["=", "-", "_", "ab", "xX", "0", "+-"]) * rng.randint(8, 30)
    return rng.choice(["http", "www", w()]) + "/" + w() + rng.choice(["/", "-", "_"]) + w() + n(0, 99)


def labelled(n: int, words: list[str], seed: int) -> list[tuple[str, int, int, int]]:
    """``n`` generated (text, start, end, label) of either label, in turn; label 1 is a secret."""
    rng, out = random.Random(seed), []
    words = [*_WORDS, *words]
    for k in range(2 * n):
        value, bare = _secret(rng, words) if k % 2 else (_other(rng, words), True)
        loud, gap = rng.random() < 0.2, rng.choice([" ", "!! ", ". ", ", "])
        value = "".join(rng.choice(words) for _ in range(rng.randint(1, 3))).upper() if loud and not k % 2 else value
        prose = lambda: (str.upper if loud else str)((gap if loud else " ").join(rng.choice(words) for _ in range(rng.randint(0, 5))))  # noqa: B023, E731
        before, after = prose() + (gap if loud else " "), (gap if loud else " ") + prose()
        if not bare or rng.random() < 0.5:
            # words stand behind names of secrets, too: the name alone proves nothing
            name = rng.choice(_SECRET_NAMES if k % 2 or rng.random() < 0.3 else _OTHER_NAMES)
            quote = rng.choice(["", "", "'", '"'])
            before += rng.choice([name, name.upper(), name.capitalize()]) + rng.choice(["=", ": ", " = ", ":"]) + quote
            after = quote + after
        out.append((before + value + after, len(before), len(before) + len(value), k % 2))
    return out


def rule_value(text: str, start: int, end: int) -> int:
    """Where the secret itself starts in a rule's finding: behind the name, in an assignment."""
    m = ASSIGN.match(text, start)
    return m.start(2) if m and m.end() == end else start


def train(docs: DataFrame) -> Network | None:
    """A network from the rules' findings of a bounded sample of ``docs`` and generated candidates."""
    n = docs.count()
    if not n:
        return None
    dice = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("secrets")), F.lit(1 << 20)) / float(1 << 20)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        chars, words = [], []
        for t in b.column("text").to_pylist():
            for s, e, _ in rule_spans(t or ""):
                # the value, with what stands around it and alone: it must be known by itself too
                s = rule_value(t, s, e)
                chars += [characters(t, s, e), characters(t, s, e, False)]
            words += sorted({w.lower() for w in re.findall(r"(?<![^\W_])[^\W\d_]{4,20}(?![^\W_])", t or "")})
        order = [int.from_bytes(hashlib.md5(bytes(c)).digest()[:7], "little") for c in chars]
        rows = len(chars) + len(words)
        return pa.RecordBatch.from_pydict({"chars": pa.array(chars + [None] * len(words), pa.list_(pa.int64())), "word": pa.array([None] * len(chars) + words, pa.string()), "o": pa.array(order + [0] * (rows - len(order)), pa.int64())})

    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(dice < min(1.0, SAMPLE_DOCS / n)).select("text")
    found = cut(map_batches(sample, kernel, "chars array<bigint>, word string, o bigint"), "secrets")
    rules = [r["chars"] for r in found.where(F.size("chars").between(0, LONGEST_LEARNED)).orderBy("o", "chars").limit(SAMPLE_FINDINGS).collect()]
    # a word of several documents is one of the language, not a key of letters only
    common = found.where("word IS NOT NULL").groupBy("word").count().where(F.col("count") >= COMMON)
    words = [r["word"] for r in common.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_FINDINGS).collect()]
    made = labelled(GENERATED, words, 11)
    of = {k: [characters(t, s, e) for t, s, e, label in made if label == k] for k in (1, 0)}
    return fit([*rules, *of[1]], of[0])


def scored(texts: list[str], net: Network | None) -> list[list[tuple[int, int, str, float | None]]]:
    """All spans of each text, the rules' and those that the network adds, in order, with the network's
    calibrated score of each (None without a network)."""
    out: list[list] = [[] for _ in texts]
    asked, chars = [], []
    for i, t in enumerate(texts):
        base = rule_spans(t)
        if net is None:
            out[i] = [(*x, None) for x in base]
            continue
        for s, e, kind in base:
            asked.append((i, s, e, kind))
            chars.append(characters(t, rule_value(t, s, e), e))
        for s, e in other_candidates(t, base):
            asked.append((i, s, e, "cnn"))
            chars.append(characters(t, s, e))
    if asked:
        for (i, s, e, kind), p in zip(asked, net.probability(chars), strict=True):
            if kind != "cnn" or p >= net.threshold:
                out[i].append((s, e, kind, float(p)))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


def scan(texts: list[str], net: Network | None) -> list[list[Span]]:
    """The spans of ``scored`` without their scores."""
    return [[x[:3] for x in found] for found in scored(texts, net)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SPANS = "array<struct<start:bigint,end:bigint,kind:string,score:double>>"


def find_secrets(docs: DataFrame, net: Network | None, id_col: str = "doc_id") -> DataFrame:
    """(id, spans) for each row: start and end in code points (end exclusive), kind, and score.

    Null and empty texts have no spans.  Repeated rows stay; an empty table gives an empty result;
    other columns are not read.  Without a network (an empty table) only the rules
    find.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        found = scored([t or "" for t in b.column("text").to_pylist()], shared.value)
        spans = pa.array([[{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])))
        return pa.RecordBatch.from_arrays([b.column(id_col), spans], [id_col, "spans"])

    rows = docs.select(id_col, F.col("text").cast("string").alias("text"))
    return map_batches(rows, kernel, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, put as ``REDACTED``."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], REDACTED]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with secrets redacted in text (and n_chars, where it is a column, set to
    the new length of a changed text); rows without a secret stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def kernel(b: pa.RecordBatch) -> list[pa.Array]:
        texts = b.column("text").to_pylist()
        found = scan([t or "" for t in texts], shared.value)
        return [pa.array([redact(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string()), pa.array([bool(x) for x in found], pa.bool_())]

    out, (text, changed) = append_columns(docs, kernel, [("clean_text", "string"), ("changed", "boolean")])
    puts = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        puts["n_chars"] = F.when(F.col(changed), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(puts).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs, train(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("cnn"))
