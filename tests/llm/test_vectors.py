import numpy as np
import pytest
from pyspark.sql import functions as F

from letterloom.llm import ann, near_vectors
from conftest import SF
from llm.conftest import components

nan, inf = float("nan"), float("inf")
ODD = [(900, None), (901, [0.0] * 8), (902, [nan] + [1.0] * 7), (903, [inf] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, []), (906, [1.0, 2.0]), (None, [1.0] * 8)]


def clustered(n, seed=3, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    x = centre[rng.integers(0, 6, n)] + rng.normal(scale=0.12, size=(n, dim))
    x[5], x[6] = x[4], x[4]
    return (x * rng.uniform(0.1, 9, (n, 1))).round(4)


def table(spark, x, odd=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(odd)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)


@pytest.mark.parametrize("block", [2048, 40])
def test_near_vectors_are_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    x = clustered(300)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = (u @ u.T) >= 0.95
    np.fill_diagonal(close, False)
    want = components(range(len(x)), zip(*np.nonzero(close)))
    got = {r.id: r for r in near_vectors.near_duplicates(table(spark, x, ODD)).collect() if r.id is not None}
    assert close.sum() > 1000
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum(), want[i], want[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in ODD if i)
    assert len(got) == len(x) + len(ODD) - 1


def test_near_vectors_without_ids_and_of_other_lengths(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (None, [0.0, 0.0, 1.0]), (2, [0.0, 0.1, 1.0]), (7, [1.0, 0.0]), (6, [1.0, 0.01]), (8, [0.0, 1.0]), (3, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, near_vectors.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 3, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 3, False), (None, 1, None, True), (None, 1, None, True)]
    assert got == want


def test_near_vectors_without_rows_and_with_repeated_ones(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors.near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors.near_duplicates(same).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def exact(x, ids, q, k):
    score = x @ x[q]
    return [int(i) for i in np.lexsort((ids, -score)) if i != q][:k]


def test_nearest_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").select("embedding").collect()])
    got = ann.nearest(df, F.col("id") % 20 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert sorted(found) == list(range(0, len(x), 20))
    hits = 0
    for q, rows in found.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        assert np.allclose([r.score for r in rows], [x[r.vec_id] @ x[q] for r in rows], atol=1e-12)
        hits += len({r.vec_id for r in rows} & set(exact(x, np.arange(len(x)), q, 20)))
    assert hits / (20 * len(found)) >= 0.9


def test_nearest_with_unequal_lengths_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = clustered(200, dim=8)
    x[100:130] = x[4]
    df = table(spark, x, ODD)
    got = ann.nearest(df, F.col("id").isin(4, 50, 110), k=5, tables=30, probes=8).collect()
    for q in (4, 50, 110):
        rows = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert len(rows) == 5
        score = x @ x[q]
        assert abs(sum(score[v] for _, v in rows) - sum(score[v] for v in exact(x, np.arange(200), q, 5))) < 1e-6 * abs(score).max() * 5 or q == 50
    assert [v for _, v in sorted((r.rank, r.vec_id) for r in got if r.query_id == 110)][0] in {i for i in range(200) if x[i] @ x[110] >= x[4] @ x[110]}
    few = table(spark, x[:3])
    assert ann.nearest(few, F.col("id") == 0, k=20, probes=16).count() <= 2
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_recall_of_random_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64)).round(3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = ann.nearest(table(spark, x), F.col("id") % 60 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    want = {(q, v) for q in range(0, 3000, 60) for v in exact(x, np.arange(3000), q, 20)}
    assert len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [8192, 7])
def test_short_lists_are_completed(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(9)
    few = rng.normal(size=(12, 64)).round(3)
    assert ann.nearest(table(spark, few), F.col("id") >= 0).count() == 12 * 11
    skewed = np.concatenate([np.eye(64)[0] * 9 + rng.normal(scale=0.01, size=(100, 64)), rng.normal(size=(25, 64))]).round(3)
    found = {}
    for r in ann.nearest(table(spark, skewed), F.col("id") % 5 == 0, tables=2, probes=1).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert sorted(found) == list(range(0, 125, 5)) and all(sorted(f) == list(range(1, 21)) for f in found.values())
    for q in range(100, 125, 5):
        assert [found[q][r] for r in range(1, 21)] == exact(skewed, np.arange(125), q, 20)


def test_nearest_of_each_length(spark):
    x = np.random.default_rng(3).normal(size=(30, 8)).round(3)
    rows = [(i, [float(v) for v in r[: 8 if i % 3 else 5]]) for i, r in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") < 2, k=20).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(0, k) for k in range(1, 10)] + [(1, k) for k in range(1, 20)]
    assert all((r.vec_id % 3 == 0) == (r.query_id == 0) for r in got)


def test_many_equal_scores_go_to_the_smaller_ids(spark):
    x = np.random.default_rng(10).integers(-9, 10, size=(1000, 8)).astype(float)
    x[:, 0], x[0] = 0, np.eye(8)[0]
    got = ann.nearest(table(spark, x), F.col("id") == 0, k=5, tables=3, probes=32).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(1, 6)]


def test_probes_begin_with_the_own_bucket():
    turns = ann.Rotations(8, 2)
    x = clustered(50)
    first = turns.probes(x, 1, 5)
    assert first.shape == (50, 5) and (first[:, 0] == turns.buckets(x, 1)).all()
    assert all(len(set(r)) == 5 for r in first.tolist())
