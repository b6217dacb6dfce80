"""Writers: IDF tables, graphs with provenance, round checkpoints, logs and flat score rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntriple_line() -> Column:
    """An N-Triples line of (s, s_kind, p, o, o_kind, o_lang, o_dtype)."""
    node = lambda v, k: F.when(F.col(k) == "iri", F.concat(F.lit("<"), v, F.lit(">"))).otherwise(F.col(v))
    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit("^^<"), "o_dtype", F.lit(">")), F.lit("")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o", "o_kind"))
    return F.concat(node("s", "s_kind"), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" ."))


def write_idf(idf: DataFrame, path: str) -> None:
    idf.write.mode("overwrite").parquet(path)


def write_graph(triples: DataFrame, provenance: DataFrame, path: str) -> None:
    """Sorted N-Triples in parts, in order, and provenance records."""
    triples.select(ntriple_line().alias("value")).distinct().orderBy("value").write.mode("overwrite").text(f"{path}/kg.nt")
    provenance.write.mode("overwrite").json(f"{path}/provenance.jsonl")


def write_round(state: DataFrame, path: str) -> None:
    """Rows with run_id and round into their folders."""
    state.write.mode("append").partitionBy("run_id", "round").parquet(path)


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def flat_scores(scores: DataFrame, key: str, name: str, value: str, prefix: str, names: list[str]) -> DataFrame:
    """One row for each key with a prefixed column for each name."""
    t = scores.groupBy(key).pivot(name, names).agg(F.first(value))
    return t.select(key, *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
