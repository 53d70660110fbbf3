"""Token counts attributed to fields and sections by offset mapping.

The fields of a document are rendered to one text and encoded once, as a whole. Token spans follow from the byte
lengths of the tokens, and are joined to the sections, which are intervals too, by binary search. A token that lies in
several sections is allocated by an explicit rule: `start` gives it to the section of its first byte, `majority` to
the section with most of its bytes (the first of equals), `split` to each in proportion to its bytes.

A section is a line of a field with its line break; the separator between two fields belongs to the former's last
line. Defined results: a null field is empty; an empty field is one section without tokens of its own; every token is
allocated, so a document's counts add up to its tokens; repeated rows and null ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import as_bytes, schema_with, small_batches
from .bpe import shared, worker

RULES = ("start", "majority", "split")


def sections_of(fields: list[bytes], separator: bytes) -> tuple[bytes, list[int], np.ndarray]:
    """The rendered text, the field of each section, and the byte at which each section ends."""
    of, ends, at = [], [], 0
    for k, data in enumerate(fields):
        lines = data.split(b"\n")
        for n, line in enumerate(lines):
            at += len(line) + (n < len(lines) - 1)
            of.append(k)
            ends.append(at)
        if k < len(fields) - 1:
            at += len(separator)
            ends[-1] = at
    return separator.join(fields), of, np.array(ends, np.int64)


def allocate(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that lie in it lie in others too."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    counts = np.bincount(first[first == last], minlength=len(ends)).astype(float)
    crossing = np.zeros(len(ends), np.int64)
    for a, b, i, j in zip(*(x[first < last].tolist() for x in (start, stop, first, last)), strict=True):
        edges = np.clip(np.concatenate(([a], ends[i : j + 1])), a, b)
        part = np.diff(edges)
        crossing[i : j + 1] += part > 0
        if rule == "split":
            counts[i : j + 1] += part / (b - a)
        else:
            counts[i if rule == "start" else i + int(part.argmax())] += 1
    return counts, crossing


def attribute(docs: DataFrame, path: str, fields: list[str], separator: str = "\n", rule: str = "majority", doc_col: str = "doc_id") -> DataFrame:
    """Per document and section: field, number of the section in it, its code points in the rendered text, and tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_col).alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)])
    spec, joint = shared(docs.sparkSession, path), separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(spec)
        for batch in batches:
            rendered = [sections_of([*x], joint) for x in zip(*map(as_bytes, batch.columns[1:]), strict=True)]
            row, field, number, start, end, count, cross = ([] for _ in range(7))
            for k, (ids, _) in enumerate(bpe.encode([text.decode() for text, _, _ in rendered])):
                text, of, ends = rendered[k]
                counts, crossing = allocate(bpe.size[ids], ends, rule)
                # Code points before each byte: all bytes but those that continue a character.
                points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                of = np.array(of)
                row.append(np.full(len(of), k))
                field.append(of)
                number.append(np.arange(len(of)) - np.searchsorted(of, of))
                end.append(points[ends])
                start.append(np.concatenate(([0], points[ends[:-1]])))
                count.append(counts)
                cross.append(crossing)
            if not row:
                continue
            join = np.concatenate
            names = pa.array(fields).take(pa.array(join(field)))
            kind = pa.float64() if rule == "split" else pa.int64()
            columns = [batch.column(0).take(pa.array(join(row))), names, pa.array(join(number).astype(np.int32)), pa.array(join(start)), pa.array(join(end)), pa.array(join(count)).cast(kind), pa.array(join(cross))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"])

    count = "double" if rule == "split" else "long"
    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], f"field string, section int, start long, end long, n_tokens {count}, n_crossing long"))
