"""Sources that are read in part or in blocks."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import in_sql
from quillspark.operators import chunking, retrieval
from quillspark.sources import tables, vectors
from quillspark.streaming.telemetry import Progress, Run


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """Two files of many blocks: blank lines, both line ends, letters of several bytes, no end at the end."""
    rng = np.random.default_rng(1)
    texts = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = ["" if rng.random() < 0.1 else f'{{"a": {i}, "b": "{"é" * int(rng.integers(0, 60))}"}}' for i in range(9000)]
        texts[name] = lines
        (tmp_path / name).write_bytes(b"".join(x.encode() + (b"\r\n" if i % 3 else b"\n") for i, x in enumerate(lines[:-1])) + lines[-1].encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_block_start").distinct().count() > 10
        got = tables.numbered_lines(spark, f"file://{tmp_path}").collect()
        chunks = tables.jsonl_chunks(spark, f"file://{tmp_path}/a.jsonl", "a int, b string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, lines in texts.items():
        own = sorted((r.number, r.line) for r in got if r.path.endswith(name))
        assert own == [(i, x) for i, x in enumerate(lines) if i < len(lines) - 1 or x]
    assert sorted((r.chunk_idx, r.a) for r in chunks) == [(i, i) for i, x in enumerate(texts["a.jsonl"]) if x]


def bytes_read(spark, df):
    """Size of the files that a scan of ``df`` opens."""
    files = [r[0] for r in df.select(F.input_file_name()).distinct().collect()]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)


def test_stored_collection(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, dim = 6000, 24
    x = rng.standard_normal((40, dim))[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, dim))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(n, 0, None), (n + 1, 0, [0.0] * dim)]
    points = spark.createDataFrame(rows, "point_id long, collection int, vector array<double>")
    path = f"file://{tmp_path}/index"
    assert vectors.write_index(points, path, lists=50, sample=1000) == 50
    assert vectors.read_index(spark, path).count() == n + 2
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, n, 60)] + [(-1, None), (-2, [0.0] * dim)], "query_id long, vector array<double>")
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.point_id, r.score) for r in df.collect())
    exact = rows_of(retrieval.retrieve(points, queries, k=10))
    assert rows_of(vectors.search_index(spark, path, queries, k=10)) == exact
    few = vectors.search_index(spark, path, queries, k=10, probes=5)
    found = {(q, p) for q, _, p, _ in rows_of(few)}
    assert len(found & {(q, p) for q, _, p, _ in exact}) >= 0.9 * len(exact)
    one = vectors.search_index(spark, path, queries.where("query_id = 60"), k=10, probes=5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    lists = vectors.read_index(spark, path)
    opened = lists.where(F.col("list").isin([r[0] for r in one.select("list").distinct().collect()]))
    assert bytes_read(spark, opened) < 0.3 * bytes_read(spark, lists)
    page, cursor = tables.scrolled(lists.withColumnRenamed("point_id", "id"), 5, 100)
    assert [r.id for r in page.collect()] == [101, 102, 103, 104, 105] and cursor == 105


def test_empty_collection(spark, tmp_path):
    points = spark.createDataFrame([(1, None)], "point_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert vectors.write_index(points, f"file://{tmp_path}/none") == 0
    assert vectors.search_index(spark, f"file://{tmp_path}/none", queries).count() == 0


@pytest.mark.parametrize("block", [1, 7])
def test_queries_in_blocks(spark, tmp_path, monkeypatch, block):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 4)))], "point_id long, vector array<double>")
    vectors.write_index(points, f"file://{tmp_path}/p")
    queries = points.where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    monkeypatch.setattr(vectors, "QUERIES", block)
    got = vectors.search_index(spark, f"file://{tmp_path}/p", queries).select("query_id", "rank", "point_id").collect()
    assert sorted(map(tuple, got)) == sorted((r.query_id, r["rank"], r.point_id) for r in retrieval.retrieve(points, queries).collect())


def test_chunks_in_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    in_sql.register(spark)
    docs.createOrReplaceTempView("docs_of_test")
    got = spark.sql("SELECT doc_id, chunk_index, total_chunks, content FROM chunks(TABLE(docs_of_test), 300, 50)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.chunks(docs, 300, 50).select("doc_id", "chunk_index", "total_chunks", "content").collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT count(*) FROM chunks(TABLE(docs_of_test))").first()[0] == chunking.chunks(docs).count()
    with pytest.raises(Exception, match="column text"):
        spark.sql("SELECT * FROM chunks(TABLE(SELECT 1 AS x))").collect()


def test_telemetry_of_a_run(spark, tmp_path):
    run = Run(spark)
    first = run.written("first", spark.range(100), f"file://{tmp_path}/a", total=F.sum("id"))
    run.written("none", first.where("id > 1000"), f"file://{tmp_path}/b", largest=F.max("id"))
    with pytest.raises(Exception, match="boom"):
        run.written("broken", first.select(F.raise_error(F.lit("boom")).cast("string").alias("x")), f"file://{tmp_path}/c")
    got = {r.stage: r for r in run.report().collect()}
    assert (got["first"].rows, got["first"].figures["total"], got["first"].ok) == (100, 4950.0, True)
    assert got["none"].rows == 0 and got["none"].figures["largest"] is None and got["none"].seconds > 0
    assert not got["broken"].ok and "boom" in got["broken"].error and got["broken"].rows is None


def test_progress_of_streams(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    seen = Progress()
    spark.streams.addListener(seen)
    try:
        q = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in").writeStream.format("noop").queryName("counted").trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(100):
            if seen.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sum(b[2] for b in seen.batches if b[0] == "counted") == 50 and seen.ended == [None]
