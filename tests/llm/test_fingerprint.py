"""Syncmer fingerprints against a choice by definition."""

import hashlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import fingerprint as fp


def inner_hash(text: str) -> int:
    h = 42
    for c in text:
        h = xxhash.xxh64_intdigest(c.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def by_definition(text: str) -> list[int]:
    """Starts of the k-mers whose least inner substring is at an edge."""
    h = [inner_hash(text[i : i + fp.INNER]) for i in range(len(text) - fp.INNER + 1)]
    return [i for i in range(len(text) - fp.WIDTH + 1) if min(h[i : i + fp.SPAN]) in (h[i], h[i + fp.SPAN - 1])]


def split(text: str) -> list[str]:
    return [text[k : k + 8] for k in range(0, len(text), 8)]


@pytest.mark.parametrize("piece,large", [(1024, 1 << 16), (7, 50), (1, 3)])
def test_anchors_are_those_of_the_definition(spark, odd, monkeypatch, piece, large):
    monkeypatch.setattr(fp, "PIECE", piece)
    monkeypatch.setattr(fp, "LARGE", large)
    texts = [r.text[:3000] for r in odd.where("text is not null").select("text").collect()] + ["é😀" * 40, "ab" * 30, "a" * 19, "a" * 20, "the quick brown fox jumps over the lazy dog " * 5]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", F.transform(fp.anchors(F.col("t")), lambda a: F.struct(fp.pos_of(a).alias("pos"), fp.hash_of(a).alias("hash"))).alias("found")).collect():
        assert [a.pos for a in r.found] == by_definition(r.t), r.t[:50]
    # A hash tells the k-mer, whatever stands around it.
    known: dict = {}
    for r in df.select("t", F.transform(fp.anchors(F.col("t")), lambda a: F.struct(fp.pos_of(a).alias("pos"), fp.hash_of(a).alias("hash"))).alias("found")).collect():
        for a in r.found:
            assert known.setdefault(a.hash, r.t[a.pos : a.pos + fp.WIDTH]) == r.t[a.pos : a.pos + fp.WIDTH]


def test_long_runs_hold_an_anchor(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(fp.SHORT)) for _ in range(500)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(fp.anchors(F.col("t"))).alias("n"))
    assert found.where("n = 0").isEmpty()


def in_python(rows):
    """doc_id, text and the text of the row that follows, by descending id with nulls last, then by text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def edited(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_report_against_brute_force(spark, odd, partitions):
    docs = odd.withColumn("text", F.substring("text", 1, 4000))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = fp.report(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = in_python([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    full = spark.createDataFrame([(k, t, edited(t, f), f) for k, (_, t, f) in enumerate(want)], "k int, t string, e string, f string")
    prints = full.select("k", *[fp.written(fp.hashes(fp.anchors(F.col(c)), F.col(c))).alias(c) for c in "tef"]).collect()
    of = {r.k: r for r in prints}

    def alike(a, b):
        if not a and not b:
            return 1.0
        return 2 * sum((Counter(split(a)) & Counter(split(b))).values()) / (len(split(a)) + len(split(b)))

    expected = [(i, len(t), hashlib.sha256(edited(t, f).encode()).hexdigest(), of[k].t, of[k].e, round(alike(of[k].t, of[k].e), 9), round(alike(of[k].t, of[k].f), 9)) for k, (i, t, f) in enumerate(want)]
    assert sorted(expected, key=str) == sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=str)


def test_given_documents(spark, documents):
    got = fp.report(documents).collect()
    want = in_python([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted((i, len(t), hashlib.sha256(edited(t, f).encode()).hexdigest()) for i, t, f in want)
    clear = [r for r in got if r.n_chars >= 200]
    assert sum(r.near_edited > 0.5 for r in clear) > 0.97 * len(clear) and sum(r.near_next < 0.1 for r in clear) > 0.97 * len(clear)


def test_small_tables(spark, odd):
    assert fp.report(odd.limit(0)).isEmpty()
    one = spark.createDataFrame([(3, "some text of a single document, long enough for anchors")], "doc_id long, text string")
    assert fp.report(one).first().near_next == 1.0
    nobody = spark.createDataFrame([(None, "x" * 30), (None, None)], "doc_id long, text string")
    assert sorted(r.n_chars for r in fp.report(nobody).collect()) == [0, 30]


def test_native(spark, documents):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        fp.report(documents).explain("formatted")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
