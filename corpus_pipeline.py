"""The corpus pipeline: toxic documents go, near copies go, repeated passages are cut, and the rest is packed.

Each stage is one operator on all that the stage before has kept; ``run`` writes every stage's rows to the shared folder
and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from letterloom.llm import minhash, packing, suffix_dedup, toxicity
from letterloom.llm.queries import table, vocabulary
from letterloom.llm.scratch import written

#: A document at this toxicity or more is rejected; bytes of a passage that may not start in two places.
TOXIC, PASSAGE = 0.7, 200


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``. The model learns from ``labels`` of the given documents, but never from the
    held-out third; null labels teach nothing, and null texts are scored as empty and so stay where empty ones do."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.is_held_out("doc_id"))
    model = toxicity.train(docs, labels)
    name = "_".join(["toxicity", *docs.columns])  # no column of the documents has it
    return toxicity.score(docs, model, out_col=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id, rows
    without id last, of several such the one with the smallest hash. Every row is a document of its own, so that of rows
    that repeat an id or have none only copies go. Documents without words are in no group and stay."""
    row, order = ("_".join([x, *docs.columns]) for x in ("row", "order"))  # no column of the documents has these
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), F.monotonically_increasing_id())
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(order, place), "numbered")
    found = written(minhash.near_duplicates(rows, id_col=row).select("id", "component_id"), "groups")
    placed = found.join(rows.select(F.col(row).alias("id"), order), "id")
    kept = placed.groupBy("component_id").agg(F.min_by("id", order).alias("id"))
    gone = written(found.join(kept, "id", "left_anti").select(F.col("id").alias(row)), "copies")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of ``PASSAGE`` bytes or more that start anywhere else too. A character that is
    cut in two goes whole; null texts become empty; ``n_chars`` follows the text, all else stays."""
    return suffix_dedup.cleaned(docs, least=PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: Models, signatures and packing are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
