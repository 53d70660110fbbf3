"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots holds, at each slot, a bit per language: the Bloom filters of all languages, sliced by slot. A
lookup reads an n-gram's slots, and their conjunction is the set of languages that contain it. Per language the hits
of a text are counted, corrected for that language's false-positive rate, and the largest share decides.

A language's filter holds every n-gram of a bounded sample of its labelled texts (see SAMPLE_TEXTS and MOST_LANGUAGES);
Spark adds the bits up by slot, so the driver receives no more than the filters themselves, whose size has a bound.
Prediction reads whole texts of all rows and nothing else of them.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learnt.
A text with a letter but without a known n-gram gets the commonest language with score 0. Ties go to the language that
sorts first. Repeated rows are predicted alike; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import as_bytes, materialize, schema_with, small_batches

#: Labelled texts that the filters are learnt from, about so many for each language at most, and the languages learnt:
#: those with most labelled texts.
SAMPLE_TEXTS, MOST_LANGUAGES = 1500, 256
#: N-gram length in bytes, probes, slots for each n-gram of the largest filter, and the least and most slots as powers of two.
LENGTH, PROBES, SLOTS_EACH, LEAST_BITS, MOST_BITS = 4, 4, 16, 12, 24
#: N-grams that are looked up together.
STEP = 1 << 20
UNKNOWN = "und"
#: Bytes folded to one text form: ASCII capitals to small letters, all other ASCII than letters to a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def folded(text: bytes) -> np.ndarray:
    """The bytes of a text after folding, with one space for a run of separators and at both ends."""
    out = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def grams(text: bytes) -> Iterator[np.ndarray]:
    """The n-grams of a text as integers, at most STEP at a time; each one once, whatever the pieces."""
    whole = folded(text)
    for a in range(0, len(whole) - LENGTH + 1, STEP):
        part = whole[a : a + STEP + LENGTH - 1].astype(np.uint32)
        out = part[: len(part) - LENGTH + 1].copy()
        for k in range(1, LENGTH):
            out = (out << np.uint32(8)) | part[k : k + len(out)]
        yield out


def slots(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    """The probes of each n-gram among 2**bits slots, from two parts of one product hash."""
    h = (gram.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    a, b, mask = h >> np.uint64(64 - bits), (h >> np.uint64(16)) | np.uint64(1), np.uint64((1 << bits) - 1)
    return [((a + np.uint64(k) * b) & mask).astype(np.int64) for k in range(PROBES)]


class Filters:
    """Planes of eight languages each: a byte per slot, a bit per language."""

    def __init__(self, languages: list[str], planes: np.ndarray, commonest: str = UNKNOWN):
        self.languages, self.planes, self.commonest = languages, planes, commonest
        self.slot_bits = planes.shape[1].bit_length() - 1
        fill = [(planes[i // 8] >> (i % 8) & 1).mean() for i in range(len(languages))]
        #: Chance that an n-gram which a language lacks is found all the same.
        self.false = np.array(fill) ** PROBES
        self.bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """For each n-gram the languages whose filters hold it, a bit each, eight to a byte."""
        at = slots(gram, self.slot_bits)
        out = self.planes[:, at[0]]
        for x in at[1:]:
            out &= self.planes[:, x]
        return out

    def counts(self, text: bytes) -> tuple[np.ndarray, int]:
        """Hits per language, and the number of n-grams."""
        hits, n = np.zeros(8 * len(self.planes), np.int64), 0
        for gram in grams(text):
            n += len(gram)
            for p, mask in enumerate(self.masks(gram)):
                hits[8 * p : 8 * p + 8] += np.bincount(mask, minlength=256) @ self.bits
        return hits[: len(self.languages)], n

    def shares(self, text: bytes) -> np.ndarray:
        """Per language the share of the text's n-grams that it holds, false positives taken off."""
        hits, n = self.counts(text)
        return np.clip((hits / max(1, n) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The language of the largest corrected share, and that share against the sum of the best two."""
        return self.judge(text)[:2]

    def judge(self, text: bytes | None) -> tuple[str, float, float]:
        """What predict returns, and the largest corrected share itself."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        share = self.shares(text)
        best = int(share.argmax())
        if share[best] <= 0:
            return self.commonest, 0.0, 0.0
        second = np.delete(share, best).max(initial=0)
        return self.languages[best], float(share[best] / (share[best] + second)), float(share[best])


ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def has_letter(text: bytes) -> bool:
    plain = text.translate(None, ASCII_LETTERS)
    return len(plain) < len(text) or any(map(str.isalpha, plain.decode()))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Filters from rows with a language. The sample is drawn by a hash of the id, so it is the same at every run."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return Filters([], np.zeros((1, 1 << LEAST_BITS), np.uint8))
    languages = sorted(counts)
    place = {name: i for i, name in enumerate(languages)}
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_TEXTS / n))])[F.col("lang")]
    sample = rows.where(F.expr("shiftrightunsigned(h, 11)") < part * float(1 << 53)).select("lang", F.col("text").cast("binary").alias("text"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for gram in grams(text):
                    gram = np.unique(gram)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), place[lang], np.int32)), pa.array(gram.astype(np.int64))], ["lang", "gram"])

    members = materialize(sample.mapInArrow(held, "lang int, gram long").distinct())
    most = members.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(most * SLOTS_EACH))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.tile(batch.column(0).to_numpy(), PROBES)
            at = np.concatenate(slots(batch.column(1).to_numpy().astype(np.uint32), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang // 8), pa.array(np.left_shift(1, lang % 8).astype(np.int32))], ["slot", "plane", "bit"])

    # As many rows at most as the filters have slots.
    filled = members.mapInArrow(placed, "slot long, plane int, bit int").groupBy("slot", "plane").agg(F.bit_or("bit").alias("mask")).toPandas()
    planes = np.zeros((-(-len(languages) // 8), 1 << bits), np.uint8)
    planes[filled["plane"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy()
    return Filters(languages, planes, min(counts, key=lambda k: (-counts[k], k)))


def shared(docs: DataFrame, filters: Filters) -> Broadcast:
    """The filters for the executors: at most 2**MOST_BITS bytes for each eight languages, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(filters)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row; only the id and the text are read, and there is no shuffle."""
    small_batches(docs.sparkSession)
    narrow, model = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shared(docs, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "lang_pred string, score double"))


def keep_identified(docs: DataFrame, filters: Filters, languages: list[str] | None = None, least_score: float = 0.0, text_col: str = "text", least_share: float = 0.0) -> DataFrame:
    """The rows whose language is identified with at least this score and corrected share, and is one of languages if given. Columns pass unchanged."""
    small_batches(docs.sparkSession)
    model, k = shared(docs, filters), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.judge(t) for t in as_bytes(batch.column(k))]
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_score and share >= least_share and (not languages or x in languages) for x, s, share in found]))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Filters from the rows whose id is not held out."""
    return learn(docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0), text_col, lang_col, id_col)


def report(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Predictions of all rows, by filters that the held-out rows had no part in."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = predict(docs, trained(docs, text_col, lang_col, id_col), id_col, text_col)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
