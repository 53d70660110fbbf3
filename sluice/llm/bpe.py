"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves hold rank and place of each adjacent pair of a piece, inner nodes their minimum. The root is the leftmost
pair of lowest rank; merging it changes three leaves, each updated on its way to the root, until no pair can merge.
So a piece of n bytes takes O(n log n), however long it is. Texts are split into pieces by the byte-level pattern;
pieces met before are looked up in a bounded table.

Defined results: a null text counts as empty, and an empty text has no tokens; all rows stay, repeated ones included.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import as_bytes, schema_with, small_batches

#: Pieces whose tokens a worker remembers before it starts anew.
REMEMBERED = 400_000
#: As many where the worker also holds what other operators of a chain left in it.
CHAINED = 100_000
NONE = 1 << 62
#: The white space of the byte-level pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def char_class(kind: str, last: int) -> str:
    """The ranges of the characters up to last of a general category."""
    found, start = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            found.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(found)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> dict:
    """Vocabulary, merges and special tokens of a byte-level tokenizer file, as plain values to broadcast."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    vocabulary = spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    texts = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocabulary.items() if t not in special} | {i: t.encode() for t, i in special.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    pairs = {(vocabulary[a] << 32) | vocabulary[b]: (rank, vocabulary[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
    return {"bytes": [next(vocabulary[c] for c, x in alphabet.items() if x == b) for b in range(256)], "pairs": pairs, "texts": texts, "special": special}


def shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for the executors; a file of some ten thousand merges, whatever the corpus."""
    return spark.sparkContext.broadcast(load(path))


class Bpe:
    """Encoder and decoder of one worker."""

    def __init__(self, spec: dict):
        self.bytes, self.pairs, self.texts, self.special = spec["bytes"], spec["pairs"], spec["texts"], spec["special"]
        #: Patterns for ASCII, for the basic plane and for all characters; the fewer ranges, the faster.
        self.pieces = [self._pattern(last) for last in (127, 0xFFFF, sys.maxunicode)]
        #: A run of other characters with the space before it; pieces never go beyond one, so whole runs are remembered.
        self.run = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Tokens of runs, as int32 bytes and as decimal text; neither is an object that the garbage collector visits.
        self.known: dict[str, bytes] = {}
        self.decimal: dict[str, str] = {}
        order = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(order, np.iinfo(np.int64).max)
        self.ranks, self.into = np.array([[*self.pairs[k]] for k in order.tolist()] + [[NONE, 0]], np.int64).T.copy()
        table = [self.texts.get(i, b"") for i in range(max(self.texts) + 1)]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([*map(len, table)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.names = [*map(str, range(len(table)))]

    @staticmethod
    def _pattern(last: int) -> re.Pattern:
        letters, numbers = char_class("L", last), char_class("N", last)
        return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def merged(self, data: bytes) -> list[int]:
        """Tokens of one long piece."""
        ids = [self.bytes[b] for b in data]
        n = len(ids)
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length()
        get, mask = self.pairs.get, (1 << shift) - 1
        tree, into = [NONE] * (2 * size), [0] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(k: int) -> int:
            pair = get((ids[k] << 32) | ids[after[k]]) if after[k] < n else None
            if pair is None:
                return NONE
            into[k] = pair[1]
            return (pair[0] << shift) | k

        tree[size : size + n] = map(leaf, range(n))
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < NONE:
            k = tree[1] & mask
            gone, left = after[k], before[k]
            ids[k], ids[gone], after[k] = into[k], -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for at in (gone, k, left) if left >= 0 else (gone, k):
                value = NONE if at == gone else leaf(at)
                at += size
                tree[at] = value
                while at > 1:
                    value = min(value, tree[at ^ 1])
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        return [i for i in ids if i >= 0]

    def merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of many pieces of about equal length: one tree each, all climbed in step."""
        n = np.array([*map(len, pieces)], np.int64)
        m, size = len(pieces), 1 << max(1, int(n.max() - 1).bit_length())
        shift = size.bit_length()
        ids = np.full((m, size + 1), -1, np.int64)
        ids[:, :size][np.arange(size) < n[:, None]] = np.array(self.bytes, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        tree, into = np.full((m, 2 * size), NONE, np.int64), np.zeros((m, size + 1), np.int64)
        after, before = np.tile(np.arange(1, size + 2), (m, 1)), np.tile(np.arange(-1, size), (m, 1))

        def leaves(row: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Set and return what the leaves hold: rank and place, or NONE where the pair does not merge."""
            a, b = ids[row, at], ids[row, np.minimum(after[row, at], size)]
            key = (a << 32) | b
            k = np.searchsorted(self.keys, key)
            good = (self.keys[k] == key) & (a >= 0) & (b >= 0)
            into[row, at] = self.into[k]
            return np.where(good, (self.ranks[k] << shift) | at, NONE)

        row, at = np.nonzero(np.arange(size - 1) < (n - 1)[:, None])
        tree[row, size + at] = leaves(row, at)
        for k in range(size.bit_length() - 1, 0, -1):
            low = 1 << (k - 1)
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            k = tree[rows, 1] & ((1 << shift) - 1)
            gone, left = after[rows, k], before[rows, k]
            to = after[rows, gone]
            ids[rows, k], ids[rows, gone] = into[rows, k], -1
            after[rows, k] = to
            before[rows, np.minimum(to, size)] = k
            tree[rows, size + gone] = NONE
            tree[rows, size + k] = leaves(rows, k)
            has = left >= 0
            tree[rows[has], size + left[has]] = leaves(rows[has], left[has])
            row = np.concatenate((rows, rows, rows[has]))
            up = np.concatenate((gone, k, left[has])) + size
            while up[0] > 1:
                up >>= 1
                tree[row, up] = np.minimum(tree[row, 2 * up], tree[row, 2 * up + 1])
            rows = rows[tree[rows, 1] < NONE]
        left = ids[:, :size] >= 0
        flat, ends = ids[:, :size][left].tolist(), np.cumsum(left.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def split(self, run: str) -> list[str]:
        if run in self.special:
            return []
        return self.pieces[0 if run.isascii() else 1 if max(run) <= "\uffff" else 2].findall(run)

    def learn(self, runs: set[str]) -> None:
        """Encode runs that are not known yet, their pieces together by length."""
        gc.disable()  # many small lists live for a moment, none in a cycle
        split = {r: self.split(r) for r in runs}
        by_size: dict[int, list[bytes]] = {}
        for p in {p for pieces in split.values() for p in pieces}:
            data = p.encode()
            by_size.setdefault((len(data) - 1).bit_length(), []).append(data)
        tokens: dict[bytes, list[int]] = {}
        for k, pieces in by_size.items():
            if k == 0:
                tokens.update((p, [self.bytes[p[0]]]) for p in pieces)
            elif k > 6:
                tokens.update((p, self.merged(p)) for p in pieces)
            else:
                for a in range(0, len(pieces), 1 << 14):
                    part = pieces[a : a + (1 << 14)]
                    tokens.update(zip(part, self.merged_together(part), strict=True))
        names = self.names
        for r, pieces in split.items():
            ids = tokens[pieces[0].encode()] if len(pieces) == 1 else [i for p in pieces for i in tokens[p.encode()]] if pieces else [self.special[r]]
            self.known[r] = array("i", ids).tobytes()
            self.decimal[r] = ",".join([names[i] for i in ids])
        gc.enable()

    def encode(self, texts: list[str], remembered: int = REMEMBERED) -> Iterator[tuple[np.ndarray, str]]:
        """Tokens of each text, and the same in decimal joined by commas. Runs are learnt for some texts at a time."""
        at = 0
        while at < len(texts):
            chunk, wanted, size = [], set(), 0
            while at < len(texts) and size < 1 << 20:
                chunk.append(runs := self._runs(texts[at]))
                wanted.update(runs)
                size += len(texts[at])
                at += 1
            fresh = wanted.difference(self.known)
            if len(self.known) + len(fresh) > remembered:  # all that the chunk needs must be known together
                self.known.clear()
                self.decimal.clear()
                fresh = wanted
            self.learn(fresh)
            ids, decimal = self.known.__getitem__, self.decimal.__getitem__
            for runs in chunk:
                yield np.frombuffer(b"".join(map(ids, runs)), np.int32), ",".join(map(decimal, runs))

    def _runs(self, text: str) -> list[str]:
        if not self.mark or not self.mark.search(text):
            return self.run.findall(text)
        return [r for part in self.mark.split(text) for r in ([part] if part in self.special else self.run.findall(part))]

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_workers: dict[int, Bpe] = {}


def worker(spec: Broadcast) -> Bpe:
    """The encoder of this Python worker, kept between tasks."""
    key = id(spec.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Bpe(spec.value)
    return _workers[key]


def encode(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the tokens of each whole text."""
    small_batches(docs.sparkSession)
    narrow, spec = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")), shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(spec)
        for batch in batches:
            ids = [ids for ids, _ in bpe.encode([t.decode() if t else "" for t in as_bytes(batch.column(1))], CHAINED)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "ids array<int>"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text, of rows (doc_id, ids); null ids give a null text."""
    spec = shared(tokens.sparkSession, path)
    narrow = tokens.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(spec)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "text string"))


def report(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and SHA-256 of each text's tokens, and the SHA-256 of the text that they decode to."""
    small_batches(docs.sparkSession)
    narrow, spec = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")), shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(spec)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, line in bpe.encode([t.decode() if t else "" for t in as_bytes(batch.column(1))]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
