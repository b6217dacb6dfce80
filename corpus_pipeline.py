"""Five stages over ``documents``: what each drops is gone for the next, and the last packs what is left.

Every stage reads the whole table its predecessor wrote and returns the columns of documents (the
last: the pieces of sequences).

Defined cases: rows are dropped one by one and never by a doc_id that another text has too; of linked
rows that with the smallest doc_id stays (a null one only if no other has any; rows of equal doc_id and
equal shingles count as one); null, empty and blank texts are linked with nothing and stay; further
columns pass unchanged, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import op2_decontamination, op6_packing, op7_lines, op9_toxicity, op10_jaccard
from corvane.llm.scratch import Scratch, fresh


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = op9_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs.columns, "_score")
    return op9_toxicity.score(docs, model, name).where(F.col(name) < op9_toxicity.THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are found in 10 of them or more; n_chars follows the text."""
    lines, dropped = fresh(docs.columns, "_lines"), fresh(docs.columns, "_dropped")
    out = op7_lines.line_dedup(docs, lines=lines, dropped=dropped).drop(lines, dropped)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group: that with the smallest doc_id."""
    return op10_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    name = fresh(docs.columns, "_leaks")
    return op2_decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name).where(F.size(name) == 0).drop(name)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2048 ids."""
    import public_tokenizers

    return op6_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark)
    last = None
    for name, stage in STAGES[:-1]:
        docs = s.save(stage(spark, docs, sf_dir), name)
        if last:
            s.drop(last)
        last = name
    out = STAGES[-1][1](spark, docs, sf_dir)  # a written table of its own
    s.drop(last)
    return out
