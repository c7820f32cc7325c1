"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the corpus (pre-tokens, counted over every document) are compiled into a minimal
acyclic automaton in which words share suffixes.  Each transition carries how many words its
siblings before it lead to, so that a walk yields the word's rank among all words; ranks index the
id outputs.  The automaton is a flat file that every Python worker memory-maps.  Many words are walked at once, one byte of all of them per step.  A word that the
automaton doesn't accept is merged by the exact BPE rules.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import pieces
from quillgraph.plans.staging import cut, ship_package

#: Words that the automaton holds at most.
LEXICON_WORDS = 1 << 17
#: Words whose ids a task remembers at once, and distinct words that it counts before it hands them on.
REMEMBERED = 400_000
#: Longest word, in bytes, that the automaton takes.
LONGEST = 48

_NO_MERGE = 1 << 40

#: How byte-level BPE splits a text, with white space by its Unicode property.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


#: Texts of these characters alone split alike under a simpler pattern, which is faster to match.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def split_plain(text: str) -> list[str]:
    return (PLAIN_SPLIT if PLAIN.fullmatch(text) else SPLIT).findall(text)


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary's file: printable Latin-1 characters
    for themselves, the other bytes in turn from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tokens as bytes by id, merge ranks, and special tokens of a byte-level BPE file."""

    tokens: list[bytes]
    merges: dict[int, tuple[int, int]] = field(repr=False)
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in vocab.items():
            tokens[i] = bytes(to_byte[c] for c in t)
        for t, i in special.items():
            tokens[i] = t.encode()
        merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        return cls(tokens, merges, special)

    def __post_init__(self):
        self.byte_id = [0] * 256
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.byte_id[t[0]] = i
        self._byte_ids = np.array(self.byte_id, np.int64)
        ordered = sorted((k, r, m) for k, (r, m) in self.merges.items())
        self._pairs = np.array([k for k, _, _ in ordered], np.int64)
        self._rank = np.array([r for _, r, _ in ordered], np.int64)
        self._made = np.zeros(1 + max((r for _, r, _ in ordered), default=0), np.int64)
        self._made[self._rank] = [m for _, _, m in ordered]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank is merged, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                return ids
            new = best[1]
            ids[at : at + 2] = [new]
            del pairs[at]
            if at:
                pairs[at - 1] = get(ids[at - 1] << 32 | new)
            if at < len(pairs):
                pairs[at] = get(new << 32 | ids[at + 1])

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """As ``merge``, for many words at once: every step merges one pair in each of them.

        The ids of a word are little-endian uint32 bytes.
        """
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > 64:
            i = order.pop()
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        for s in range(0, len(order), 1 << 14):
            part = order[s : s + (1 << 14)]
            self._merge_block([words[i] for i in part], part, out)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, want), len(self._pairs) - 1)
        return np.where(self._pairs[at] == want, self._rank[at], _NO_MERGE)

    def _merge_block(self, words: list[bytes], places: list[int], out: list) -> None:
        n = np.array([len(w) for w in words])
        width = int(n.max(initial=0)) + 1
        ids = self._byte_ids[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)]
        column = np.arange(width)
        left = np.where(column[None, :-1] < n[:, None] - 1, self._ranks(ids[:, :-1], ids[:, 1:]), _NO_MERGE) if width > 1 and len(self._pairs) else np.full((len(words), max(width - 1, 1)), _NO_MERGE)
        place = np.array(places)
        while len(place):
            at = left.argmin(axis=1)
            best = left[np.arange(len(place)), at]
            live = best != _NO_MERGE
            done = ~live
            flat = ids[done][column < n[done, None]].astype("<u4").tobytes()
            ends = np.cumsum(n[done] * 4)
            for p, a, b in zip(place[done].tolist(), (ends - n[done] * 4).tolist(), ends.tolist(), strict=True):
                out[p] = flat[a:b]
            place, ids, left, n, at, best = place[live], ids[live], left[live], n[live] - 1, at[live], best[live]
            if not len(place):
                return
            row, new = np.arange(len(place)), self._made[best]
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), width - 1), 1)
            ids[row, at] = new
            shift = column[:-1] + (column[:-1] > at[:, None])
            left = np.where(shift < width - 1, np.take_along_axis(left, np.minimum(shift, width - 2), 1), _NO_MERGE)
            left[row, at] = np.where(at < n - 1, self._ranks(new, ids[row, at + 1]), _NO_MERGE)
            before = at > 0
            left[row[before], at[before] - 1] = self._ranks(ids[row[before], at[before] - 1], new[before])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n, for words of any length."""
        n, get = len(ids), self.merges.get
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := get(new << 32 | ids[after[i]]):
                    heapq.heappush(heap, (p[0], i, new, ids[after[i]], p[1]))
            if before[i] >= 0:
                k = before[i]
                if p := get(ids[k] << 32 | new):
                    heapq.heappush(heap, (p[0], k, ids[k], new, p[1]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


# --- the automaton ---------------------------------------------------------------------------


def compile_lexicon(words: list[bytes], outputs: list[list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of distinct words, as flat arrays.

    key: state * 256 + byte of every transition, ascending; to: its target; skip: words that the
    state accepts before those of this transition; final: states that accept; off, ids: the outputs
    by the rank of the word in byte order.
    """
    pairs = sorted(zip(words, outputs, strict=True))
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each registered state: (final, ((byte, target), ...))

    def registered(node: list) -> int:
        sign = (node[0], tuple(node[1]))
        at = register.get(sign)
        if at is None:
            at = register[sign] = len(arcs)
            arcs.append(sign)
        return at

    # states on the path of the last word, not yet registered: [final, [(byte, target), ...]]
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        for k in range(len(last), depth, -1):
            path[k - 1][1].append((last[k - 1], registered(path[k])))
            path.pop()

    for w, _ in pairs:
        n = 0
        while n < len(w) and n < len(last) and w[n] == last[n]:
            n += 1
        close(n)
        path.extend([False, []] for _ in w[n:])
        path[-1][0] = True
        last = w
    close(0)
    root = registered(path[0])

    below: list[int] = []  # words from each state; targets are registered before their sources
    keys, to, skip = [], [], []
    for final, own in arcs:
        n = int(final)
        for byte, target in own:
            keys.append(len(below) * 256 + byte)
            to.append(target)
            skip.append(n)
            n += below[target]
        below.append(n)
    return {
        "key": np.array(keys, np.int64),
        "to": np.array(to, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array([f for f, _ in arcs], np.uint8),
        "root": np.array([root], np.int64),
        "off": np.cumsum([0, *(len(o) for _, o in pairs)]).astype(np.int64),
        "ids": np.array([i for _, o in pairs for i in o], "<u4"),
    }


def pack(arrays: dict[str, np.ndarray]) -> tuple[bytes, dict[str, tuple[int, str, int]]]:
    """One file's bytes, and where each array stands in it."""
    blob, where = bytearray(), {}
    for name, a in arrays.items():
        blob += b"\0" * (-len(blob) % 8)
        where[name] = (len(blob), a.dtype.str, len(a))
        blob += a.tobytes()
    return bytes(blob), where


class Lexicon:
    """The automaton over a memory-mapped file."""

    def __init__(self, path: str, where: dict[str, tuple[int, str, int]]):
        raw = np.asarray(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else np.empty(0, np.uint8)
        for name, (at, kind, n) in where.items():
            setattr(self, name, raw[at : at + n * np.dtype(kind).itemsize].view(kind))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that aren't accepted."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        if not len(live) or not len(self.key):
            return out
        width = int(size[live].max())
        text = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in live.tolist()]), np.uint8).reshape(-1, width)
        state, rank, left = np.full(len(live), int(self.root[0])), np.zeros(len(live), np.int64), size[live]
        row = np.arange(len(live))
        for k in range(width):
            want = state * 256 + text[row, k]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            at, row, live, left = at[ok], row[ok], live[ok], left[ok]
            rank = rank[ok] + self.skip[at]
            state = self.to[at].astype(np.int64)
            done = left == k + 1
            end = done & (self.final[state] == 1)
            out[live[end]] = rank[end]
            row, live, left, rank, state = row[~done], live[~done], left[~done], rank[~done], state[~done]
            if not len(row):
                break
        return out

    def outputs(self, ranks: np.ndarray) -> list[bytes]:
        """The ids of accepted words, as little-endian uint32 bytes each."""
        ids = memoryview(self.ids.view(np.uint8))
        return [ids[a:b].tobytes() for a, b in zip((self.off[ranks] * 4).tolist(), (self.off[ranks + 1] * 4).tolist(), strict=True)]


_mapped: dict[str, Lexicon] = {}


def mapped(blob: bytes, where: dict, name: str) -> Lexicon:
    """The lexicon in this worker, mapped from a file that loses its name as soon as it is mapped.

    No other session can meet, change or remove it, and nothing stays behind when the worker ends.
    """
    if name not in _mapped:
        handle, path = tempfile.mkstemp(prefix="quillgraph-lexicon-")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(blob)
            _mapped.clear()
            _mapped[name] = Lexicon(path, where)
        finally:
            os.remove(path)
    return _mapped[name]


# --- over a corpus ---------------------------------------------------------------------------


def splitter(special: Iterable[str]):
    """A function from text to its pieces; special tokens are pieces of their own."""
    names = sorted(special, key=len, reverse=True)
    if not names:
        return split_plain
    mark = regex.compile("(" + "|".join(regex.escape(s) for s in names) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in names):
            return split_plain(text)
        out = []
        for k, part in enumerate(mark.split(text)):
            out += [part] if k % 2 else split_plain(part)
        return out

    return split


def frequent_words(docs: DataFrame, special: Iterable[str], limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces over all documents: those above a count that at most ``limit`` exceed."""
    ship_package(docs.sparkSession)
    special = list(special)

    def run(batches):
        split, count = splitter(special), Counter()

        def out():
            return pa.RecordBatch.from_pydict({"w": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})

        for b in batches:
            for p in pieces(b):
                for t in p.column("text").to_pylist():
                    if t:
                        count.update(split(t))
                if len(count) > REMEMBERED:
                    yield out()
                    count.clear()
        yield out()

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "w string, n bigint")
    counts = cut(seen.groupBy("w").agg(F.sum("n").alias("n")).where(F.octet_length("w") <= LONGEST), "bpe-words")
    # sixteen steps an octave: a histogram of at most a thousand rows gives the least count that fits
    step = F.floor(F.log2("n") * 16).cast("int")
    least, held = 0, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > limit:
            least = r["s"] + 1
            break
    return [r["w"] for r in counts.where(step >= least).select("w").collect()]


@dataclass
class Encoder:
    """What a task needs to encode: the vocabulary and the packed automaton."""

    vocab: Vocabulary
    blob: bytes = field(repr=False)
    where: dict
    name: str

    @classmethod
    def build(cls, vocab: Vocabulary, words: Iterable[str]) -> Encoder:
        own = sorted({w.encode() for w in words if w not in vocab.special} - {b""})
        blob, where = pack(compile_lexicon(own, [vocab.merge(w) for w in own]))
        return cls(vocab, blob, where, hashlib.sha256(blob).hexdigest()[:24])

    def start(self):
        """A function from texts to their ids as little-endian uint32 bytes."""
        lexicon, vocab = mapped(self.blob, self.where, self.name), self.vocab
        split = splitter(vocab.special)
        known = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}
        seen: dict[str, bytes] = {}

        def encode(texts: list[str]) -> list[bytes]:
            parts = [split(t) if t else [] for t in texts]
            if len(seen) > REMEMBERED:
                seen.clear()
            if not seen:
                seen.update(known)
            new = list(set().union(*parts).difference(seen))
            raw = [w.encode() for w in new]
            ranks = lexicon.ranks(raw)
            hit, miss = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0).tolist()
            seen.update(zip([new[i] for i in hit.tolist()], lexicon.outputs(ranks[hit]), strict=True))
            seen.update(zip([new[i] for i in miss], vocab.merge_many([raw[i] for i in miss]), strict=True))
            get = seen.__getitem__
            return [b"".join(map(get, p)) for p in parts]

        return encode


def encode(docs: DataFrame, tokenizer: str, keep_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ``tokenizer`` is the path of a byte-level BPE file.  A null text counts as empty and has no
    tokens.  Strings of special tokens in a text become those tokens.  Repeated rows stay; an empty
    table gives an empty result; other columns are not read.
    """
    vocab = Vocabulary.read(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.build(vocab, frequent_words(docs, vocab.special)))
    rows = docs.select(id_col, F.col("text").cast("string").alias("text"))
    ship_package(docs.sparkSession)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        own = shared.value.start()
        tokens = shared.value.vocab.tokens
        for b in batches:
            for p in pieces(b):
                ids = own(p.column("text").to_pylist())
                numbers = [np.frombuffer(x, "<u4") for x in ids]
                text = [b"".join([tokens[i] for i in x.tolist()]).decode("utf-8", "replace").encode() for x in numbers]
                columns = [p.column(id_col), pa.array([len(x) for x in numbers], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(t).hexdigest() for t in text])]
                if keep_ids:
                    columns.append(pa.array(numbers, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode(ids: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of (id, ids array): the id and its decoded text; null ids give an empty text."""
    shared = ids.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array([shared.value.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], [id_col, "text"])

    ship_package(ids.sparkSession)
    rows = ids.select(id_col, "ids")
    return rows.mapInArrow(lambda batches: (kernel(b) for b in batches), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
