"""Alignment of two tokenizers by interval coalescing.

Both encode the same bytes. All tokens of both are sorted by where they start, the running maximum of their ends is
taken, and a group breaks where a start reaches that maximum, so tokens that overlap, directly or through others, are of
one group. All pairs of a first and a second token in a group are linked. How many documents link a pair of ids is
counted over the corpus, which tells for each first id its usual partners.

A task encodes a batch of texts bounded by bytes and aligns it in one go; a group's ids are made distinct before its pairs are
formed, and these a bounded number at a time. Pairs are added up before they are shuffled. The counts are broadcast while
they are few (MOST_BROADCAST rows, counted) and joined by shuffles else, where adaptive execution splits hot pairs.

Defined results: texts that are null or empty, or that either tokenizer does not give back byte by byte with one space
before, have no tokens: zeros and an empty groups_sha256. Strings of special tokens in texts are plain text. Repeated
rows each count as a document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import as_bytes, materialize, schema_with, small_batches
from .bpe import byte_alphabet

#: Ids fit in so many bits, and so do the rows of a batch.
ID_BITS = 20
#: Pairs of ids that a task forms at a time, and bytes of texts that it aligns at a time.
PAIRS, CHUNK = 1 << 20, 512 << 10
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counted pairs, some 40 bytes each, that are broadcast at most.
MOST_BROADCAST = 1 << 20


class Encoders:
    """Both tokenizers of one worker, with the bytes of each of their tokens."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece

        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        alphabet, spec = byte_alphabet(), json.loads(first)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.first = self._ranked(ranks, spec["model"]["merges"], alphabet) or self._general(first)
        self.texts = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.texts[i] = token
        self.pieces = [self._piece(self.second.id_to_piece(i)) for i in range(self.second.get_piece_size())]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.texts, self.pieces)]
        self.decimal = np.array([str(i) for i in range(max(len(self.texts), len(self.pieces)))], object)

    @staticmethod
    def _ranked(ranks: dict[bytes, int], merges: list, alphabet: dict[str, int]) -> Callable[[list[str]], list[list[int]]] | None:
        """The encoder that goes by the ids of merged tokens, three times as fast; only where ids follow the order of the merges."""
        import tiktoken

        whole = [bytes(map(alphabet.__getitem__, "".join(m) if isinstance(m, list) else m.replace(" ", ""))) for m in merges]
        if [ranks.get(x) for x in whole] != [*range(256, 256 + len(whole))] or len(ranks) != 256 + len(whole):
            return None
        found = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [found.encode_ordinary(t) for t in texts]

    @staticmethod
    def _general(spec: str) -> Callable[[list[str]], list[list[int]]]:
        import tokenizers

        found = tokenizers.Tokenizer.from_str(spec)
        found.encode_special_tokens = True
        found.no_truncation()
        found.no_padding()
        return lambda texts: [x.ids for x in found.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[bytes | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by both; none where the bytes do not come back."""
        plain = [(t or b"").decode() for t in texts]
        first = self.first([" " + t for t in plain])
        second = self.second.encode(plain, num_threads=1)
        out = []
        for t, a, b in zip(texts, first, second, strict=True):
            whole = b" " + (t or b"")
            same = t and b"".join(map(self.texts.__getitem__, a)) == whole and b"".join(map(self.pieces.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


_workers: dict[int, Encoders] = {}


def shared(spark: SparkSession, first: str, second: str) -> Broadcast:
    """Both vocabulary files for the executors, some megabytes whatever the corpus."""
    with open(first, encoding="utf-8") as a, open(second, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def worker(files: Broadcast) -> Encoders:
    """The tokenizers of this Python worker, kept between tasks."""
    key = id(files.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoders(*files.value)
    return _workers[key]


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval, numbered from 0 in the order of places: intervals that overlap, through others too, share one."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.concatenate(([False], starts[order][1:] >= reached[:-1])) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def in_chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, text) in slices of some CHUNK bytes of text, a longer text alone."""
    ends = np.cumsum([len(t or b"") for t in as_bytes(batch.column(1))])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class Aligned:
    """The tokens of a batch of texts: row, id, side (0 or 1), bytes and group of each, by group, side and place."""

    def __init__(self, encoders: Encoders, texts: list[bytes | None]):
        both = encoders.encode(texts)
        sides = []
        # Rows lie one after another on a common line, so no group spans two.
        base = np.concatenate(([0], np.cumsum([1 + len(t or b"") for t in texts])))
        for side in (0, 1):
            counts = np.array([len(x[side]) for x in both], np.int64)
            ids = np.fromiter((i for x in both for i in x[side]), np.int64, counts.sum())
            row = np.repeat(np.arange(len(texts)), counts)
            ends = np.cumsum(encoders.sizes[side][ids])
            before = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))[:-1]]
            ends = ends + np.repeat(base[:-1] - before, counts)
            sides.append((row, ids, np.full(len(ids), side, np.int8), ends - encoders.sizes[side][ids], ends))
        row, ids, side, start, end = (np.concatenate(x) for x in zip(*sides, strict=True))
        group = coalesced(start, end)
        order = np.lexsort((start, side, group))
        self.row, self.ids, self.side, self.group = row[order], ids[order], side[order], group[order]
        self.start, self.end = (start - base[row])[order], (end - base[row])[order]
        self.n, self.n_groups = len(texts), int(group.max()) + 1 if len(group) else 0

    def heads(self) -> np.ndarray:
        """Where groups begin."""
        return np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1]))) if len(self.group) else np.zeros(0, np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first id, second id and number of links of each pair of ids of a row, sorted."""
        one = lambda side: np.unique((self.group << ID_BITS | self.ids)[self.side == side], return_counts=True)
        (first, n_first), (second, n_second) = one(0), one(1)
        of_first, of_second = first >> ID_BITS, second >> ID_BITS
        partners = np.bincount(of_second, minlength=self.n_groups)
        begins = np.concatenate(([0], np.cumsum(partners)))
        row_of = self.row[self.heads()]
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, mask = 0, (1 << ID_BITS) - 1
        width = partners[of_first]
        upto = np.concatenate(([0], np.cumsum(width)))
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            a = np.repeat(np.arange(at, stop), width[at:stop])
            b = np.arange(len(a)) - np.repeat(upto[at:stop] - upto[at], width[at:stop]) + begins[of_first[a]]
            key = (row_of[of_first[a]] << ID_BITS | (first[a] & mask)) << ID_BITS | (second[b] & mask)
            keys, back = np.unique(np.concatenate((keys, key)), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, np.concatenate((sums, n_first[a] * n_second[b])))
            sums, at = total, stop
        return keys >> 2 * ID_BITS, keys >> ID_BITS & mask, keys & mask, sums

    def written(self, decimal: np.ndarray) -> list[str]:
        """The groups of each row as text: `a1,a2|b1;a3|b2`."""
        if not len(self.ids):
            return [""] * self.n
        mark = np.full(len(self.ids), ",", object)
        mark[1:][self.side[1:] != self.side[:-1]] = "|"
        mark[self.heads()] = ";"
        parts = np.empty(2 * len(self.ids), object)
        parts[0::2], parts[1::2] = mark, decimal[self.ids]
        bounds = 2 * np.searchsorted(self.row, np.arange(self.n + 1))
        return ["".join(parts[a + 1 : b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def groups(docs: DataFrame, first: str, second: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each group of each document: its byte range in space + text and the ids of both sides, in order."""
    small_batches(docs.sparkSession)
    files, narrow = shared(docs.sparkSession, first, second), docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in in_chunks(whole)):
            found = Aligned(worker(files), as_bytes(batch.column(1)))
            heads = found.heads()
            if not len(heads):
                continue
            lists = []
            for side in (0, 1):
                of = np.concatenate(([0], np.cumsum(np.bincount(found.group[found.side == side], minlength=found.n_groups)))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(of), pa.array(found.ids[found.side == side].astype(np.int32))))
            ends = np.maximum.reduceat(found.end, heads)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.row[heads])), pa.array(found.start[heads]), pa.array(ends), *lists], ["doc_id", "start", "end", "a", "b"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "start long, end long, a array<int>, b array<int>"))


def linked(docs: DataFrame, first: str, second: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its counts, the digest of its groups, and its pairs of ids with their numbers of links."""
    small_batches(docs.sparkSession)
    files, narrow = shared(docs.sparkSession, first, second), docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 33
        for batch in (x for whole in batches for x in in_chunks(whole)):
            encoders, n = worker(files), batch.num_rows
            found = Aligned(encoders, as_bytes(batch.column(1)))
            row, a, b, links = found.links()
            per_row = lambda values, weights=None: np.bincount(values, weights, minlength=n).astype(np.int64)
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            total = np.zeros(n, np.int64)
            np.add.at(total, row, links)
            texts = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.written(encoders.decimal)]
            columns = [
                *(batch.column(0), pa.array(seen + np.arange(n))),
                *(pa.array(per_row(found.row[found.side == s])) for s in (0, 1)),
                *(pa.array(per_row(found.row[found.heads()])), pa.array(total), pa.array(texts)),
                pa.ListArray.from_arrays(offsets, pa.array(a << 32 | b)),
                pa.ListArray.from_arrays(offsets, pa.array(links)),
            ]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"))


def counted(found: DataFrame) -> DataFrame:
    """From linked(): how many documents link each pair of ids, and whether no pair of its first id has more."""
    counts = materialize(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    first = F.shiftright("pair", 32).alias("first")
    best = counts.groupBy(first).agg(F.max("docs").alias("most"))
    return materialize(counts.withColumn("first", first).join(best, "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def report(docs: DataFrame, first: str, second: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens of both, groups, links, links to the most frequent partners, sum of the links' counts, digest of the groups."""
    found = materialize(linked(docs, first, second, doc_col, text_col))
    counts = counted(found)
    counts = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    each = found.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.links").alias("n"))
    of_best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
    sums = each.join(counts, "pair").groupBy("uid").agg(of_best, F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    kept = found.select("doc_id", "uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return kept.join(sums, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *none, "groups_sha256")
