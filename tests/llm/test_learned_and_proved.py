"""Positive-unlabelled quality, the Merkle manifest and ranked search, against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from quillspark.llm import merkle, pu_quality, ranked_search, registry
from quillspark.llm.common import Scratch


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def key(r):
    return repr(r)


def test_all_thirteen_are_registered():
    """A broken import inside the subpackage must not pass for its absence."""
    import __spark_entry__

    known = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in known)] == [] and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)


# --- positive-unlabelled learning ---------------------------------------------------------------

def plain_sums(codes, unlabelled, positive, w):
    """Risks, slopes and curvature, a row at a time."""
    d = len(w)
    out = np.zeros(5), np.zeros(d), np.zeros(d), np.zeros((d, d))
    for row, u, p in zip(codes.tolist(), unlabelled, positive, strict=True):
        x = np.zeros(d)
        x[row] = 1
        z = float(w @ x)
        s = 1 / (1 + math.exp(-z))
        out[0][:] += [u, p, u * math.log1p(math.exp(z)), p * math.log1p(math.exp(-z)), p * math.log1p(math.exp(z))]
        for part, v in zip(out[1:3], (u * s, p), strict=True):
            part += v * x
        out[3][:] += u * s * (1 - s) * np.outer(x, x)
    return np.concatenate([x.ravel() for x in out])


def test_sums_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    codes = np.column_stack([np.zeros(70, int), rng.integers(1, 5, 70), rng.integers(5, 9, 70)])
    u, p, w = rng.random(70) < 0.8, rng.random(70) < 0.3, rng.standard_normal(9)
    assert pu_quality.row_sums(codes, u, p, w) == pytest.approx(plain_sums(codes, u, p, w))


def test_slopes_are_those_of_the_risk():
    """The Newton step's slope beside differences of the risk."""
    rng = np.random.default_rng(3)
    codes = np.column_stack([np.zeros(200, int), rng.integers(1, 4, 200)])
    u, p = np.ones(200), (codes[:, 1] == 3) & (rng.random(200) < 0.5)
    fit, w = pu_quality.Fit(4, 0.4), rng.standard_normal(4) * 0.3

    def risk(at):
        fit.w = at
        return fit.risk(pu_quality.Sums.of(pu_quality.row_sums(codes, u, p, at), 4))

    s = pu_quality.Sums.of(pu_quality.row_sums(codes, u, p, w), 4)
    assert risk(w)[1] > 0
    slope = s.slope_u / s.n_u - 0.4 * s.at_p / s.n_p + fit.ridge(s) * w
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        assert slope[i] == pytest.approx((risk(w + step)[0] - risk(w - step)[0]) / 2e-6, abs=1e-5)


def test_risk_of_negatives_stays_at_or_above_zero(monkeypatch):
    """A prior far too large makes the unbiased risk fall without end; the weights kept do not."""
    rng = np.random.default_rng(4)
    codes = np.column_stack([np.zeros(60, int), 1 + np.arange(60)])
    u, p = np.ones(60), rng.random(60) < 0.3
    monkeypatch.setattr(pu_quality, "SHRINK", 0.0)
    monkeypatch.setattr(pu_quality, "RIDGE", 1e-3)
    fit = pu_quality.Fit(61, 0.95)
    went_below = False
    for _ in range(30):
        went_below |= fit.risk(pu_quality.Sums.of(pu_quality.row_sums(codes, u, p, fit.w), 61))[1] < -pu_quality.BETA
        fit.step(pu_quality.Sums.of(pu_quality.row_sums(codes, u, p, fit.w), 61))
    fit.w = fit.best
    risk, negative = fit.risk(pu_quality.Sums.of(pu_quality.row_sums(codes, u, p, fit.best), 61))
    assert went_below and negative >= -pu_quality.BETA and risk < math.log(2) and fit.best.any()


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_best_bin_finds_the_prior(prior):
    rng = np.random.default_rng(5)
    good = lambda n: rng.normal(2, 1, n)
    n = 40_000
    u = np.concatenate([good(int(n * prior)), rng.normal(-2, 1, n - int(n * prior))])
    h = [np.histogram(x, bins=512, range=(-8, 8))[0] for x in (u, good(9000))]
    assert pu_quality.best_bin(*h) == pytest.approx(prior, abs=0.03)


def test_bins_hold_even_shares(spark):
    rows = [(i, " ".join(["word"] * (i % 50 + 1))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stats = pu_quality.measured(docs, spark.createDataFrame([], "doc_id long, quality int"), None, "doc_id", "text", Scratch(spark))
    table, d = pu_quality.bin_table(stats, 10)
    codes = pu_quality.Model(table, np.zeros(d), 0.5).codes(pu_quality._bits(stats.select("bits").toArrow().column(0).combine_chunks()))
    words = np.bincount(codes[:, 1])
    assert words[words > 0].min() >= 30 and (words > 0).sum() == 10 and codes.max() < d


def test_quality_by_positives_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op11_pu_quality(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95 and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_bad_and_held_out_labels_are_never_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.score for r in pu_quality.score_documents(docs, labels, held_out()).collect()}
    other = labels.where("quality = 1").where(~held_out()).unionByName(labels.where(held_out()).withColumn("quality", F.lit(1)))
    assert {r.doc_id: r.score for r in pu_quality.score_documents(docs, other, held_out()).collect()} == pytest.approx(want)


def test_quality_by_positives_of_odd_rows(spark):
    rows = [(i, f"a clean text of number {i} with some words in it " * 3) for i in range(60)] + [(100 + i, "### $$$ ### " * 30) for i in range(20)]
    rows += [(200, None), (201, ""), (None, rows[0][1]), rows[0], rows[0], (202, "long " * 200_000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fold int, bits int, positive int")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1), (3, 0), (5, None), (100, 0)], "doc_id long, quality int")
    got = pu_quality.score_documents(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=key) == sorted((d for d, _ in rows), key=key) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert len({r.score for r in got if r.doc_id in (0, None)}) == 1 and score[200] == score[201]
    assert min(score[i] for i in range(60)) > max(score[100 + i] for i in range(20))
    model = pu_quality.learn(pu_quality.measured(docs, labels, None, "doc_id", "text", Scratch(spark)))
    assert {r.doc_id: r.score for r in pu_quality.score_texts(docs, model).collect()} == pytest.approx(score)
    assert {r.score for r in pu_quality.score_documents(docs, labels.where("quality = 0")).collect()} == {0.5}
    assert pu_quality.score_documents(docs.where("false"), labels).count() == 0


# --- Merkle manifest --------------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def changed(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def manifest(docs):
    return merkle.manifest(docs, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def test_manifest_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "fr", "é", "", None]), rng.choice([5, 0, None]), rng.choice(["text", "", None, "日本語 \n", "x" * 500_000])) for i in range(150)]
    rows += [rows[0], rows[0], (3, "other", rows[3][2], 1, "t"), (None, "a", "en", 2, "t"), (None, None, None, None, None), (999, "s", "lone", 9, "t")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "leaf", "name", "place", "nodes", "id", "claim")})
    got = sorted(map(tuple, manifest(docs).collect()), key=key)
    assert got == sorted(brute.merkle(rows, changed), key=key)
    assert {g[-1] for g in got} == {True, False} and all(g[-1] for g in got if g[0] is None)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(registry.OP12).fetchall(), key=key) == got
    assert manifest(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 257, 66_000])
def test_manifest_of_trees_of_several_supersteps(spark, n):
    """One large tree beside a small one; edges of vertices."""
    rows = [(i, "s", "x", i, "t") for i in range(n)] + [(i, "s", "y", i, "t") for i in range(3)]
    got = sorted(map(tuple, manifest(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == sorted(brute.merkle(rows, changed))


def test_manifest_with_many_trees(spark):
    rows = [(i, "s", f"lang{i % 700}", i, "t") for i in range(1500)]
    assert sorted(map(tuple, manifest(spark.createDataFrame(rows, DOCS)).collect())) == sorted(brute.merkle(rows, changed))


def test_a_vertex_waits_for_all_its_children():
    children = [(i, bytes([i]) * 32, None, None) for i in range(5)]
    assert merkle._complete(((0, 0), [(5, children[3:]), (5, children[:3])]))[3] == b"".join(c[1] for c in children)
    with pytest.raises(ValueError, match="heard from 4 of 5"):
        merkle._complete(((0, 0), [(5, children[:4])]))


def test_proofs_by_folding():
    for n in range(1, 20):
        nodes = [bytes([i]) * 32 for i in range(n)]
        levels = merkle.levels_of(nodes, merkle.height_of(n))
        assert len(levels[-1]) == 1
        for node, way in zip(nodes, merkle.ways(levels), strict=True):
            assert merkle.fold(node, way) == levels[-1][0] and (n == 1 or merkle.fold(bytes(32) if node != bytes(32) else b"x" * 32, way) != levels[-1][0])


# --- ranked search --------------------------------------------------------------------------------------

def plain_ranks(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score), every document scored for every item."""
    terms = lambda t: re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.FOLD))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=key)


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "éa", "b2", "日本", "rare", "mid", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choice(words[:rng.randint(2, len(words))]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [rng.choice(texts) if rng.random() < 0.2 else t.replace(" ", rng.choice([" ", "-", ",\n", "\x7f"])) for t in texts]


@pytest.mark.parametrize(("seed", "shard"), [(1, 1 << 20), (2, 300), (3, 1)])
def test_ranked_search(spark, seed, shard):
    """Copies (ties), odd rows and clashing columns, over shards of any size."""
    docs = [(i, t) for i, t in enumerate(random_texts(seed, 160))]
    docs += [(None, docs[0][1]), (None, docs[0][1]), docs[5], docs[5], (500, None), (501, ""), (502, "-- !!"), (503, "the " * 30_000)]
    items = [(i, t) for i, t in enumerate(random_texts(seed + 50, 25))] + [(3, "the rare"), (3, "the rare"), (None, "w1 w1 w2"), (40, None), (41, "--"), (42, "nowhere")]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, n int, tf int, item_id int").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = ranked_search.search(table, asked, shard=shard)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == plain_ranks(docs, items)
    assert sorted(map(tuple, ranked_search.search(table, asked, shard=shard, block=7).collect()), key=key) == rows
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.execute(registry.OP13).fetchall(), key=key) == rows
    assert ranked_search.search(table.where("false"), asked).count() == 0 and ranked_search.search(table, asked.where("false")).count() == 0
    assert ranked_search.search(table.where("doc_id >= 500 and doc_id < 503"), asked).count() == 0


def test_threshold_stops_early_and_never_too_early():
    """Few documents are looked up where impacts differ much; ties at the k-th place are all seen."""
    rng = np.random.default_rng(7)
    n, kinds = 4000, 3
    impact = rng.integers(1, 20, (n, kinds)) ** 4
    impact[:12] = 200_000  # more than k documents tie at the top
    here = ranked_search.Shard(np.arange(n)[::-1].copy(), np.zeros(n, int), np.full(n, kinds), np.tile(np.arange(kinds), n), impact.ravel(), kinds)
    docs, scores, looked = here.search(np.arange(kinds), np.array([3, 1, 2]), 5, 0)
    total = impact @ [3, 1, 2]
    want = sorted(range(n), key=lambda d: (-total[d], n - 1 - d))[:5]
    assert docs.tolist() == want and scores.tolist() == total[want].tolist() and looked < n / 4
    floor = int(total.max()) + 1
    assert here.search(np.arange(kinds), np.array([3, 1, 2]), 5, floor)[2] == 0
