import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF

import __spark_entry__

QUERIES = {n: q for n, q in __spark_entry__.queries().items() if n == "pipeline" or (n[:2] == "op" and n[2].isdigit())}
TABLES = ("documents", "labels", "embeddings", "pages", "conversations")


def put(spark, folder, change):
    for name in TABLES:
        change(spark.read.parquet(f"{SF}/{name}.parquet"), name).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return put(spark, tmp_path_factory.mktemp("empty"), lambda df, _: df.limit(0))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Some rows of every table, rows of nulls, rows twice, empty and white texts, and one long text."""

    def change(df, name):
        few = df.limit(40)
        nulls = few.limit(2).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
        out = few.union(few.limit(5)).union(nulls)
        if name in ("documents", "pages", "conversations"):
            text = {"documents": "text", "pages": "html", "conversations": "text"}[name]
            for value in ("", " \n\t ", "long word " * 60_000):
                out = out.union(few.limit(1).withColumn(text, F.lit(value)))
        return out.withColumn("id", F.lit("clash")).withColumn("slot", F.lit(1.5)).repartition(3)

    return put(spark, tmp_path_factory.mktemp("odd"), change)


def test_there_are_all():
    assert len(QUERIES) == 14


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op5") else 0)


def test_recall_of_nothing(spark, empty):
    assert tuple(__spark_entry__.queries()["recall_of_neighbours"](spark, empty).first()) == (0, 0, True, True, 0.0)


#: What holds for every row of a result, however odd the tables.
HOLDS = {
    "op1": lambda r: (r.vec_id is None) == (r.component_id is None) and r.n_links >= 0 and r.kept == (r.vec_id == r.component_id),
    "op2": lambda r: 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and (r.held_out or r.doc_id is not None),
    "op3": lambda r: 1 <= r["rank"] <= 20 and r.vec_id != r.query_id and r.query_id % 20 == 0,
    "op4": lambda r: (r.licence == "none") == (r.n_notices == 0) and 0 <= r.probability <= 1,
    "op5": lambda r: r.formatted_chars >= r.loss_chars >= 0 and r.n_turns > 0,
    "op6": lambda r: (r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()),
    "op7": lambda r: r.start >= 0 and 0 < r.length <= r.offset + r.length <= 2048,
    "op8": lambda r: 0 <= r.n_removed <= r.n_bytes and (r.n_spans > 0) == (r.n_removed > 0),
    "op9": lambda r: (r.record_type == "revisit") == (r.refers_to is not None) and (r.payload_bytes >= 100 or r.record_type == "response"),
    "op10": lambda r: r.n_shingles >= 0 and r.kept == (r.doc_id == r.component_id),
    "op11": lambda r: (r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()),
    "op12": lambda r: len(r.word) >= 7 and r.n >= 2 and (r.form is None) == (r.form_n is None) == (r.root == r.word) and (r.form is None or r.form_n >= 10 * r.n),
    "op13": lambda r: 0 < r.n_convs and 0 < r.n_leaves and (r.depth == 0) == (r.parent_conv_id is None) and r.saved_tokens >= 0,
    "pipeline": lambda r: 0 < r.length <= r.offset + r.length <= 2048,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    found = QUERIES[name](spark, odd).collect()
    assert all(HOLDS[name.split("_")[0]](r) for r in found)
    texts = [r.text or "" for r in spark.read.parquet(f"{odd}/documents.parquet").select("text").collect()]
    sha = lambda values: sorted(hashlib.sha256(v.encode()).hexdigest() for v in values)
    if name.startswith(("op6", "op11")):
        assert sorted(r.decoded_sha256 for r in found) == sha(texts)
    if name.startswith("op8"):
        assert sorted(r.n_bytes for r in found) == sorted(len(t.encode()) for t in texts)
    rows = {"op1": "embeddings", "op2": "documents", "op4": "documents", "op6": "documents", "op8": "documents", "op9": "pages", "op10": "documents", "op11": "documents"}
    if table := rows.get(name.split("_")[0]):
        assert len(found) == spark.read.parquet(f"{odd}/{table}.parquet").count()
    assert found
