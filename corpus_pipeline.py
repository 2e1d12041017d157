"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's
rows to the shared folder and gives them, read again, to the next.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import common as C
from lodegraph.llm import decontamination, line_dedup, minhash, packing, quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a proven cutoff rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed = docs.withColumn("_tk", C.text_key(F.col("text")))
    judged = quality_rules.judge(keyed, labels, carry=("_tk",))
    bad = C.small(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("_tk").alias("_bad")).distinct())
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tk") == F.col("_bad")), "left_anti").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; every document stays, and ``n_chars`` follows its text."""
    found = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, 0.8 alike or more, stays: the one with the smallest id.

    Rows are told apart by id and text together, so rows that share an id with another text are judged by their own
    text; of rows alike in both, one stays.  Rows without an id come after all others.
    """
    tk = C.text_key(F.col("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", tk.alias("tk"))
    found = C.settle(minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), percent=80), "pipeline-classes")
    own = [F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.tk").alias("_tk")]
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (tk == F.col("_tk"))
    docs = docs.join(C.small(found.filter(~F.col("kept")).select(*own).distinct()), same, "left_anti")
    repeated = C.settle(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select(*own), "pipeline-repeated")
    if repeated.isEmpty():
        return docs
    return docs.join(repeated, same, "left_anti").unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences of 4096 tokens."""
    return packing.pack(docs, capacity=4096, end_id=2, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages' methods (classifier cutoffs, retrieval, packing) are beyond SQL; a test holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
