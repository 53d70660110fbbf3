"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton of all items is built once per block of items (a block holds a bounded number of words), broadcast, and
every document streams its words through it; blocks take turns. At each word the automaton gives the longest match that ends there; a
match of at least `window` words, or of a whole item that is shorter, marks words as hit.

Defined results: a null text has no words and no hits; an item without words matches nothing; items with a null id
mark words but are not named; repeated items count once; documents keep all their rows, repeated ones included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_bytes, materialize, schema_with, small_batches

#: Words are runs of digits, ASCII letters in lower case and all characters beyond ASCII; the rest separates.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Most words of benchmark items in one automaton; more items make more automata, each with its own pass.
BLOCK_WORDS = 250_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with what the window rule needs at each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, moves = [0], [-1], [{}]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(moves, last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        self.size = len(self.vocabulary)
        self.moves = {v * self.size + w: to for v, out in enumerate(moves) for w, to in out.items()}
        self._mark(items)

    def _extend(self, moves: list[dict], last: int, w: int) -> int:
        """Append w to the item that ends in state last; no state is made twice for a text that other items hold."""
        length, link = self.length, self.link
        known = moves[last].get(w)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(moves, last, w, known)
        new = self._state(moves, length[last] + 1, {})
        v = last
        while v >= 0 and w not in moves[v]:
            moves[v][w] = new
            v = link[v]
        if v < 0:
            link[new] = 0
        else:
            to = moves[v][w]
            link[new] = to if length[to] == length[v] + 1 else self._split(moves, v, w, to)
        return new

    def _state(self, moves: list[dict], length: int, out: dict) -> int:
        self.length.append(length)
        self.link.append(0)
        moves.append(out)
        return len(moves) - 1

    def _split(self, moves: list[dict], v: int, w: int, to: int) -> int:
        """Part the shorter texts of state to, which have more occurrences, from its longer ones."""
        part = self._state(moves, self.length[v] + 1, dict(moves[to]))
        self.link[part], self.link[to] = self.link[to], part
        while v >= 0 and moves[v].get(w) == to:
            moves[v][w] = part
            v = self.link[v]
        return part

    def _mark(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        """Item ids of the state of each window; and states that hold whole items shorter than a window."""
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, set[str]]]] = {}
        for name, words in items:
            v = n = 0
            for w in words:
                v = self.moves[v * self.size + self.vocabulary[w]]
                n += 1
                if n >= self.window:
                    while self.length[self.link[v]] >= self.window:
                        v = self.link[v]
                    n = self.window
                    self.items.setdefault(v, set()).update(() if name is None else (name,))
            if 0 < len(words) < self.window:
                at = self.whole.setdefault(v, [])
                named = next((s for k, s in at if k == n), None)
                if named is None:
                    at.append((n, named := set()))
                named.update(() if name is None else (name,))
        #: The nearest state, itself included, on each state's chain of suffixes that holds a whole short item.
        self.near = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.near[v] = v if v in self.whole else self.near[self.link[v]] if v else -1

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the ids of the items that have an occurring window."""
        size, window, moves, link, length, near, whole = self.size, self.window, self.moves, self.link, self.length, self.near, self.whole
        hit, found, seen = np.zeros(len(words), bool), set(), set()
        ids = list(map(self.vocabulary.get, words))
        v = n = 0
        for i, w in enumerate(ids):
            if w is None:
                v = n = 0
                continue
            to = moves.get(v * size + w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = moves.get(v * size + w)
            if to is None:
                n = 0
                continue
            v = to
            n += 1
            if n >= window:
                hit[i - window + 1 : i + 1] = True
                while length[link[v]] >= window:
                    v = link[v]
                n = min(n, length[v])
                if v not in seen:
                    seen.add(v)
                    found |= self.items[v]
            at = near[v]
            while at >= 0:
                for k, named in whole[at]:
                    if k <= n:
                        hit[i - k + 1 : i + 1] = True
                        found |= named
                at = near[link[at]]
        return hit, found


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def blocks_of(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """The different items with their block, and the number of blocks; all words are counted first, so that each block fits its bound."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    words = F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long")
    total = items.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    return items.withColumn("block", F.expr(f"pmod(xxhash64(item, text), {blocks})")), blocks


def automaton(items: DataFrame, block: int, window: int) -> Broadcast:
    """The broadcast automaton of one block, of about as many words as a block may have."""
    rows = items.where(F.col("block") == block).select("item", "text").collect()
    return items.sparkSession.sparkContext.broadcast(SuffixAutomaton([(r.item, words_of(r.text.encode())) for r in rows], window))


HITS = "n_words long, hits array<struct<a: int, b: int>>, items array<string>"


def passed(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """n_words, hits and items of each row (key, text) by one automaton, and its columns after these two."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits, items = [], [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                hit, found = shared.value.scan(words)
                n.append(len(words))
                hits.append([{"a": a, "b": b} for a, b in runs(hit)])
                items.append(sorted(found))
            spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.string())), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "hits", "items", *batch.schema.names[2:]])

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:])
    return texts.mapInArrow(scan, schema_with(texts, ["key"], HITS + more))


def merged(hits: str) -> Column:
    """Sorted hit runs of several automata as runs that neither overlap nor touch."""
    last = lambda done: F.element_at(done, -1)

    def add(done: Column, x: Column) -> Column:
        longer = F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], x["b"]).alias("b"))
        return F.when(done.isNull(), F.array(x)).when(last(done)["b"] >= x["a"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(hits, F.lit(None).cast("array<struct<a:int,b:int>>"), add)


def united(texts: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """key, text, hits and items of the different texts (key, text) that any block hits.

    Blocks pass one after another, so driver and workers hold one automaton at a time, however many items there are.
    """
    parts = []
    for b in range(blocks):
        shared = automaton(items, b, window)
        found = passed(texts.select("key", "text", F.col("text").alias("whole")), shared).where("size(hits) > 0")
        parts.append(materialize(found.select("key", F.col("whole").alias("text"), "hits", "items")))
        shared.destroy()
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    found = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.first("text").alias("text"), flat("hits"), flat("items"))
    return found.select("key", "text", merged("hits").alias("hits"), "items")


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, hit runs of words and the matching item ids, sorted.

    Only the id and the text are read. With one block there is no shuffle. With more, each block passes over the
    documents and returns rows for the texts that it hits; these are joined back by the text's digest.
    """
    small_batches(docs.sparkSession)
    items, blocks = blocks_of(benchmark, block_words)
    if blocks == 1:
        return passed(docs.select(F.col(doc_col).alias("key"), F.col(text_col).alias("text")), automaton(items, 0, window)).withColumnRenamed("key", "doc_id")
    keyed = docs.select(F.col(doc_col).alias("doc_id"), F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text"))
    found = materialize(united(keyed.select("key", "text"), items, blocks, window).drop("text"))
    n = F.coalesce(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long"), F.lit(0))
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    joined = keyed.select("doc_id", "key", n.alias("n_words")).join(found, "key", "left")
    return joined.select("doc_id", "n_words", F.coalesce("hits", nothing).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, **columns) -> DataFrame:
    """Counts and a digest of the matching items per document."""
    found = match(docs, benchmark, window, **columns)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without(text: bytes, plain: bytes, spans: list[tuple[int, int]]) -> bytes | None:
    """The text without the runs of words; None if no word is left."""
    at = [m.span() for m in WORD.finditer(plain)]
    parts, end = [], 0
    for a, b in spans:
        parts.append(text[end : at[a][0]])
        end = at[b - 1][1]
    text = b"".join([*parts, text[end:]])
    return text if words_of(text) else None


def cut(text: bytes, automaton: SuffixAutomaton, max_coverage: float) -> bytes | None:
    """The text without the spans that the automaton hits, until none is left; None if hits cover more than max_coverage of its words."""
    first = True
    while text is not None:
        plain = text.translate(NORMAL)
        hit = automaton.scan(plain.split())[0]
        if not hit.any():
            return text
        if first and hit.mean() > max_coverage:
            return None
        first = False
        text = without(text, plain, runs(hit))
    return None


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with hit spans cut out of the text; documents that hits cover beyond max_coverage are dropped.

    All other columns pass unchanged, whatever their names. Cutting repeats until no window is left. A document
    without a hit keeps its text to the byte; null texts stay null. With one block of items there is one pass and no
    shuffle. With more, the hits of all blocks are united before a text is judged and cut, and the texts that were cut
    go through all blocks again, so the result does not depend on block_words.
    """
    small_batches(docs.sparkSession)
    k = docs.columns.index(text_col)
    items, blocks = blocks_of(benchmark, block_words)
    if blocks > 1:
        return changed(docs, items, blocks, window, max_coverage, text_col)
    shared = automaton(items, 0, window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text in as_bytes(batch.column(k)):
                done = text if text is None else cut(text, shared.value, max_coverage)
                keep.append(text is None or done is not None)
                texts.append(None if done is None else done.decode())
            columns = [*batch.columns]
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def changed(docs: DataFrame, items: DataFrame, blocks: int, window: int, max_coverage: float, text_col: str) -> DataFrame:
    """decontaminate over several blocks: only texts with hits move, known by their digests."""

    def cut_once(most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for text, hits in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    plain = text.translate(NORMAL)
                    kept = None
                    if sum(x["b"] - x["a"] for x in hits) <= most * len(plain.split()):
                        kept = without(text, plain, [(x["a"], x["b"]) for x in hits])
                    texts.append(None if kept is None else kept.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

        return run

    mark = "_t" + "_" * max(map(len, docs.columns))  # longer than any column's name, so it clashes with none
    pending, most, done = docs.select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text")), max_coverage, None
    while True:
        found = united(pending, items, blocks, window).select("key", "text", "hits")
        new = materialize(found.mapInArrow(cut_once(most), "key string, text string"))
        if new.isEmpty():
            break
        done = new if done is None else materialize(done.join(new.select("key"), "key", "left_anti").unionByName(new))
        pending, most = new.where("text is not null"), 1.0
    if done is None:
        return docs
    done = done.select(F.col("key").alias(mark), F.col("text").alias(mark + "new"), F.lit(True).alias(mark + "cut"))
    joined = docs.withColumn(mark, F.sha2(text_col, 256)).join(done, mark, "left").where(F.col(mark + "cut").isNull() | F.col(mark + "new").isNotNull())
    return joined.select(*[(F.coalesce(F.col(mark + "new"), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
