"""Removal of repeated passages by difference-cover anchors.

Two equal windows of `width` words may start anywhere, but for a difference cover D modulo v there is an offset below v
that brings both starts to places in D. So only runs of width - v + 1 words that start at places in D modulo v are
hashed; every repeated window holds such an anchor that is repeated too. Around repeated anchors all windows that can
hold them are extended to their full width, hashed with 96 bits, and those found twice or more are removed.

Hashes meet in sorted partitions and are compared with their neighbours only, so no group is ever held. Before that,
each batch settles the repeats that it sees by itself and sends one row of them on, so hot passages arrive thinned.
Equal texts are known by 128 bits; all copies of a text of at least one window lose all their words.

Defined results: a null or wordless text has no words, none removed, and the digest of the empty text; texts shorter
than a window keep their words; repeated rows repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_bytes, materialize, schema_with, small_batches

#: Perfect difference sets by period: every difference modulo the period is one of two members' differences.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes whose words are hashed together.
CHUNK = 1 << 18
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The largest known period that leaves anchors of at least two fifths of the window; 1 for the shortest windows."""
    fit = [v for v in COVERS if 5 * (width - v + 1) >= 2 * width]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of a batch of texts: their places in the bytes, their text and their hashes."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        gap = SPACE[self.data]
        full = self.offsets[:-1] < self.offsets[1:]
        before, after = np.ones(len(gap), bool), np.ones(len(gap), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[self.offsets[:-1][full]] = True
        after[self.offsets[1:][full] - 1] = True
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.n = np.bincount(self.text, minlength=len(texts))
        #: Place of each text's first word among all words.
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.place = np.arange(len(self.start)) - self.first[self.text]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + CHUNK, "right")))
            at = self.start[a]
            part = self.data[at : self.end[b - 1]].astype(np.uint64) + np.uint64(1)
            up, down = powers(WORD_BASE, len(part) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(part) * up[:-1], dtype=np.uint64)))
            s, e = self.start[a:b] - at, self.end[a:b] - at
            out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
        return out


def window_hashes(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A hash of each run of width word hashes; runs across two texts are for the caller to leave out."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + words[k : k + len(out)]
    return mix(out)


#: h and c: the hash; t and u: the digest of the text; pos: word at which it starts; known: repeated within its batch.
ROWS = "h long, c int, t long, u long, pos int, known boolean"
NAMES = ["h", "c", "t", "u", "pos", "known"]


def digest(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text from seeds of their own, t and u."""
    return [F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u")]


def settled(h: np.ndarray, c: np.ndarray, t: np.ndarray, u: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows to send on: hashes seen at two places of the batch are known repeats, and one row still tells of them."""
    order = np.lexsort((pos, u, t, c, h))
    h, c, t, u, pos = h[order], c[order], t[order], u[order], pos[order]
    same, copy, known = (np.zeros(len(h), bool) for _ in range(3))
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    copy[1:] = same[1:] & (t[1:] == t[:-1]) & (u[1:] == u[:-1]) & (pos[1:] == pos[:-1])
    # A copy is the same place again, so it is left out; whether its row repeats the one before it stays true.
    h, c, t, u, pos, same, known = (x[~copy] for x in (h, c, t, u, pos, same, known))
    known[:] = same
    known[:-1] |= same[1:]
    head = known & ~same
    spread = np.where(known, t, h)  # known repeats need no meeting, so they are dealt by their texts
    out = [np.concatenate((x, y[head])) for x, y in ((spread, h), (c, c), (t, t), (u, u), (pos, pos), (known, np.zeros(len(h), bool)))]
    kinds = (np.int64, np.int32, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([*[pa.array(x.view(k)) for x, k in zip(out[:4], kinds, strict=True)], pa.array(out[4].astype(np.int32)), pa.array(out[5])], NAMES)


def met(rows: DataFrame) -> DataFrame:
    """(t, u, pos) of the rows whose hash occurs at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # hash of the last row seen, its place, and whether its group is known to repeat
        for batch in batches:
            h, c, t, u, pos, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            out = [(t[known], u[known], pos[known])]
            h, c, t, u, pos = h[~known], c[~known], t[~known], u[~known], pos[~known]
            if len(h):
                if last:  # the open row comes first again
                    h, c, t, u, pos = (np.concatenate((np.array([v], x.dtype), x)) for v, x in zip(last[:5], (h, c, t, u, pos), strict=True))
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
                other = ~new & np.concatenate(([False], (t[1:] != t[:-1]) | (u[1:] != u[:-1]) | (pos[1:] != pos[:-1])))
                group = np.cumsum(new) - 1
                repeats = np.bincount(group, other) > 0
                repeats[0] |= bool(last and last[5])
                keep = repeats[group] & (new | other)
                out.append((t[keep], u[keep], pos[keep]))
                last = (h[-1], c[-1], t[-1], u[-1], pos[-1], bool(repeats[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["t", "u", "pos"])

    return rows.repartition("h").sortWithinPartitions("h", "c", "t", "u", "pos").mapInArrow(run, "t long, u long, pos int")


def anchors(texts: DataFrame, width: int) -> DataFrame:
    """Hashes of the runs of words at cover places, of columns (t, u, text)."""
    period, places = cover_for(width)
    length = width - period + 1
    wanted = np.zeros(period, bool)
    wanted[list(places)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, (t, u) = Words(batch.column(2)), (batch.column(k).to_numpy().view(np.uint64) for k in range(2))
            h = window_hashes(w.hashes(), length)
            # The anchor must fit its text, and the text must hold a whole window.
            at = np.flatnonzero((w.place[: len(h)] + length <= w.n[w.text[: len(h)]]) & (w.n[w.text[: len(h)]] >= width) & wanted[w.place[: len(h)] % period])
            yield settled(h[at], np.zeros(len(at), np.uint32), t[w.text[at]], u[w.text[at]], w.place[at])

    return texts.mapInArrow(run, ROWS)


def windows(found: DataFrame, width: int) -> DataFrame:
    """Hashes of all windows that can hold a repeated anchor, of columns (t, u, text, places)."""
    period, _ = cover_for(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, (t, u) = Words(batch.column(2)), (batch.column(k).to_numpy().view(np.uint64) for k in range(2))
            places = batch.column(3)
            rows = np.repeat(np.arange(len(batch)), places.value_lengths().to_numpy())
            at = w.first[rows] + places.flatten().to_numpy()
            # A window starts less than a period before its anchor, within the text, and ends within it.
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, np.maximum(w.first[rows], at - period + 1), 1)
            np.add.at(edge, at + 1, -1)
            starts = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (w.place + width <= w.n[w.text]))
            words = w.hashes()
            h = window_hashes(words, width)[starts]
            c = window_hashes(mix(words ^ np.uint64(WORD_BASE)), width, WORD_BASE)[starts]
            yield settled(h, (c >> np.uint64(32)).astype(np.uint32), t[w.text[starts]], u[w.text[starts]], w.place[starts])

    return found.mapInArrow(run, ROWS)


def kept_texts(docs: DataFrame, width: int = 35, text_col: str = "text") -> DataFrame:
    """For each distinct text that loses words: its digest (t, u), n_words, n_removed and what is kept of it.

    Windows are judged on the texts as given. Words covered by a window whose words also start elsewhere go; the kept
    words are joined by one space.
    """
    small_batches(docs.sparkSession)
    long_enough = F.octet_length(text_col) >= 2 * width - 1
    texts = docs.select(*digest(F.col(text_col)), F.col(text_col).alias("text")).where(long_enough)
    places = materialize(met(anchors(texts, width)).groupBy("t", "u").agg(F.collect_set("pos").alias("places")))
    # Copies of a text become one in their map tasks, before texts move.
    found = materialize(texts.groupBy("t", "u").agg(F.first("text").alias("text")).join(places, ["t", "u"]))
    starts = materialize(met(windows(found, width)).groupBy("t", "u").agg(F.collect_set("pos").alias("starts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, at in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.array(at) + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                rows.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["t", "u", "n_words", "n_removed", "kept"])

    return materialize(found.select("t", "u", "text").join(starts, ["t", "u"]).mapInArrow(cut, "t long, u long, n_words long, n_removed long, kept string"))


def copied(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Digests of the texts that several rows hold."""
    return docs.select(*digest(F.col(text_col))).groupBy("t", "u").count().where("count > 1").select("t", "u", F.lit(True).alias("copied"))


def report(docs: DataFrame, width: int = 35, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the words, the removed words and the SHA-256 of the kept words joined by one space.

    A null text has no words. Repeated rows and equal texts are places of their own, so they repeat each other.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_col).alias("doc_id"), *digest(F.col(text_col)), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole = [], []
            for text in as_bytes(batch.column(3)):
                words = text.split() if text else []
                n.append(len(words))
                whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(whole, pa.string())], ["doc_id", "t", "u", "n_words", "whole"])

    base = narrow.mapInArrow(count, schema_with(narrow, ["doc_id", "t", "u"], "n_words long, whole string"))
    shorter = kept_texts(docs, width, text_col).select("t", "u", F.col("n_removed").alias("cut"), F.sha2("kept", 256).alias("digest"))
    changed = materialize(copied(docs, text_col).join(shorter, ["t", "u"], "full_outer"))
    gone = F.col("copied") & (F.col("n_words") >= width)
    return base.join(changed, ["t", "u"], "left").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, width: int = 35, text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their texts; texts without one stay as they are.

    All rows and columns stay; a text that is repeated as a whole becomes empty.
    """
    mark, words = "_t" + "_" * max(map(len, docs.columns)), F.size(F.array_remove(F.split(text_col, "[ \\t-\\r]+"), ""))
    on = [mark, mark + "u"]
    named = lambda df, *more: df.select(F.col("t").alias(on[0]), F.col("u").alias(on[1]), *more)
    shorter = named(kept_texts(docs, width, text_col), F.col("kept").alias(mark + "k"))
    changed = materialize(named(copied(docs, text_col), F.col("copied").alias(mark + "c")).join(shorter, on, "full_outer"))
    text = F.when(F.col(mark + "c") & (words >= width), F.lit("")).otherwise(F.coalesce(mark + "k", text_col))
    joined = docs.withColumns(dict(zip(on, digest(F.col(text_col)), strict=True))).join(changed, on, "left")
    return joined.select(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
