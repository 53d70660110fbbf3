"""WARC archives, sharding, the pipeline and the SQL of the corpus queries."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import queries, sharding, warc
from sluice.llm._util import shared_dir

from ..compare import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    same(df, queries.oracle_sql()[name], sf_dir)


# 3

PAGES = [(1, "http://a/", "x"), (2, "http://b/\n", "x"), (3, None, None), (4, "http://c/", ""), (None, "http://d/", "x"), (5, "http://e/", "é" * 200_000), (5, "http://f/", "é" * 200_000), (6, "http://g/", "only"), (None, "http://h/", None)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    root = shared_dir(spark)
    manifest = warc.write(pages, root, file_bytes=1000)
    back = warc.read(spark, root).collect()
    assert len(back) == len(PAGES) and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for r in back:
        assert r.payload_bytes in {len((h or "").encode()) for p, _, h in PAGES if str(p) == str(r.page_id)}
    by = {(r.page_id, r.payload_digest): r for r in back}
    assert by["1", digest("x")].refers_to == "2" and by["2", digest("x")].record_type == "response"
    assert by[None, digest("x")].refers_to == "2" and by["3", digest("")].refers_to == "4" and by["6", digest("only")].record_type == "response"
    assert sorted(r.record_type for r in back if r.page_id == "5") == ["response", "revisit"]
    assert [bytes(r.payload) for r in back if r.page_id == "6"] == [b"only"] and all(r.payload is None for r in back if r.record_type == "revisit")
    folder = Path(root.removeprefix("file://"))
    assert not (folder / "_temporary").exists()
    for m in manifest.collect():
        data = (folder / m.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == m.sha256 and len(data) == m.bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_archives_do_not_depend_on_partitions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = [{(m.file, m.sha256) for m in warc.write(pages.repartition(n), shared_dir(spark), file_bytes=20_000, range_bytes=100_000).collect()} for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) > 1
    assert warc.write(pages.limit(0), shared_dir(spark)).isEmpty()


# 9


def capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        n, at = 1, 0
        for s in sizes:
            if at + s > middle:
                n, at = n + 1, 0
            at += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 24, 150])
def test_capacity_is_the_smallest(spark, sf_dir, shards):
    rows = sharding.keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    groups = sharding.groups_of(rows)
    sizes = [r.bytes for r in groups.orderBy("key").collect()]
    got, keys = sharding.plan(groups, shards)
    assert got == capacity(sizes, shards) and len(keys) == shards - 1
    placed = rows.groupBy(sharding.shard_of(F.col("key"), keys).alias("shard")).agg(F.sum("size").alias("n")).collect()
    assert max(r.n for r in placed) == got


def test_slots_are_gapless(spark, sf_dir, odd, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text")))
    rows = sharding.assign(docs, 5).collect()
    assert len(rows) == docs.count()
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == [*range(len(slots))]
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"copy")}) == 1
    assert all(r.size == 8 and r.text_crc32 == 0 for r in rows if r.size == 8)
    assert sharding.assign(odd.limit(0), 5).isEmpty()
    assert sharding.with_shard(odd, 4).count() == odd.count()


# The pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    from .test_text_operators import marked, personal, similar_groups

    assert [name for name, _ in p.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    strange = spark.createDataFrame([(9001, "1 2 3", None, None, None), (9002, None, None, None, None), (9003, None, None, None, None)], docs.schema)
    docs = docs.unionByName(strange)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    one = p.STAGES[0][1](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} >= {9001, 9002, 9003} and one.count() > 0.95 * docs.count() - 3
    two = p.STAGES[1][1](spark, one, sf_dir).cache()
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    of = similar_groups([t for _, t in rows])
    assert sorted(r.doc_id for r in two.collect()) == [d for k, (d, _) in enumerate(rows) if of[k] == k]
    three = p.STAGES[2][1](spark, two, sf_dir).cache()
    before = {d: hit for d, _, hit, *_ in marked([(r.doc_id, r.text) for r in two.collect()], items)}
    after = {r.doc_id: r.text for r in three.collect()}
    assert all(not hit for *_, hit in marked(after.items(), items))
    assert all(after[r.doc_id] == r.text for r in two.collect() if not before[r.doc_id])
    four = p.STAGES[3][1](spark, three, sf_dir).cache()
    assert four.columns == docs.columns and all(not personal(r.text) for r in four.collect())
    assert all(r.text == after[r.doc_id] for r in four.collect() if not personal(after[r.doc_id]))
    five = p.STAGES[4][1](spark, four, sf_dir)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in p.run(spark, sf_dir).collect()} <= {(r.doc_id, tuple(r.ids)) for r in five.collect()}


def test_pipeline_drops_edited_copies(spark, sf_dir):
    import corpus_pipeline as p

    from .conftest import WORDS
    from .test_text_operators import words

    rng, rows = np.random.default_rng(4), []
    for k in range(60):
        text = [WORDS[j] for j in rng.integers(0, 2000, 200)]
        rows.append((1000 * k, " ".join(text)))
        for n in (1, 2, 3, 12):  # edited words; 12 leave a similarity of about 0.5 to 0.6
            edited = list(text)
            for at in range(5, 200, 200 // n)[:n] if n < 12 else range(5, 200, 16):
                edited[at] = "edited"
            rows.append((1000 * k + n, " ".join(edited)))
    shingles = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert all(alike(rows[0][1], rows[n][1]) >= 0.85 for n in (1, 2, 3)) and alike(rows[0][1], rows[4][1]) < 0.7
    kept = {r.doc_id for r in p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    assert kept == {1000 * k + n for k in range(60) for n in (0, 12)}


def test_stages_take_empty_and_odd_tables(spark, sf_dir, odd):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        found = stage(spark, odd.limit(0), sf_dir)
        assert found.isEmpty() and (name == "tokens" or found.columns == odd.columns), name
    docs = odd
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == odd.columns, name
    assert docs.where("text is null or trim(text) = ''").isEmpty() and docs.count() <= odd.count()
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
