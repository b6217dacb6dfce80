"""Instruments folded into score rows, defects, feedback under a token limit, and what is planned from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.calibration import render_sections
from corvane.operators.graph import LABEL, TYPE


def score_row(key: str, **instruments: DataFrame) -> DataFrame:
    """One flat row for each key: every instrument's columns under its name, joined on the key."""
    out = None
    for name, df in instruments.items():
        part = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = part if out is None else out.join(part, key, "full")
    return out


def defects(violations: DataFrame, pitfalls: DataFrame, coverage: DataFrame, least: float) -> DataFrame:
    """Defects of three instruments: broken rules, pitfalls and genres whose coverage is under ``least``.

    ``violations`` (rule, n), ``pitfalls`` (code, severity, affected), ``coverage`` (genre, coverage); ids count on
    over all instruments in a fixed order.
    """
    none = F.array().cast("array<string>")
    a = violations.where("n > 0").select(F.lit(0).alias("k"), F.lit("reasoner").alias("instrument"), F.concat("rule", F.lit(" x "), F.col("n").cast("string")).alias("description"), F.lit("critical").alias("severity"), none.alias("involved"))
    b = pitfalls.select(F.lit(1).alias("k"), F.lit("pitfalls").alias("instrument"), F.col("code").alias("description"), "severity", F.array_sort("affected").alias("involved"))
    c = coverage.where(F.col("coverage") < least).select(F.lit(2).alias("k"), F.lit("coverage").alias("instrument"), F.concat(F.lit("low coverage of "), "genre").alias("description"), F.lit("minor").alias("severity"), none.alias("involved"))
    t = a.union(b).union(c)
    order = Window.orderBy("k", "description", F.array_join("involved", ","))  # a report's defects are few
    return t.withColumn("defect_id", F.concat(F.lit("D"), F.lpad((F.row_number().over(order) - 1).cast("string"), 4, "0"))).drop("k")


def feedback(found: DataFrame, caps: dict[str, int], limit: int, count_tokens=lambda text: len(text.split())) -> tuple[str, dict[str, int], int]:
    """(text, caps used, overflow): sections under their caps; caps are halved, at least 1, up to eight times."""
    caps = dict(caps)
    for _ in range(9):
        parts = []
        for section in sorted(caps):
            got = render_sections(found.where(F.col("instrument") == section), "instrument", caps[section]).first()
            if got:
                parts.append(got["text"])
        text = "\n\n".join(parts)
        over = count_tokens(text) - limit
        if over <= 0 or all(v <= 1 for v in caps.values()):
            break
        caps = {k: max(1, v // 2) for k, v in caps.items()}
    return text, caps, max(0, over)


def class_labels(typed: DataFrame, schema: DataFrame) -> DataFrame:
    """(iri, class_label): the smallest schema label among an individual's types."""
    return typed.where(F.col("p") == TYPE).select(F.col("s").alias("iri"), F.col("o").alias("cls")).join(F.broadcast(schema.where("kind = 'class'").select(F.col("iri").alias("cls"), "label")), "cls").groupBy("iri").agg(F.min("label").alias("class_label"))


def injection_inventory(ontology: DataFrame, definition: str, limit: int) -> DataFrame:
    """Labelled entities with definitions by (label, iri), and an error where their words are over the limit."""
    t = ontology.where(F.col("p") == LABEL).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))
    t = t.join(ontology.where(F.col("p") == definition).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("definition")), "iri", "left")
    words = F.size(F.split(F.concat_ws(" ", "label", "definition"), r"\s+"))
    total = t.agg(F.sum(words).alias("total"))
    t = t.crossJoin(F.broadcast(total))
    guard = F.when(F.col("total") <= limit, F.col("label")).otherwise(F.raise_error(F.lit("the inventory is over its limit")).cast("string"))
    return t.select("iri", guard.alias("label"), "definition").orderBy("label", "iri")


def prompt(template: str, parts: dict[str, Column], allotment: dict[str, int]) -> tuple[Column, Column]:
    """A prompt and its words by part; a part over its allotment is an error."""
    size = lambda c: F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))
    text = F.lit(template)
    for name, col in parts.items():
        fits = F.when(size(col) <= allotment.get(name, 1 << 30), col).otherwise(F.raise_error(F.lit(f"{name} is over its allotment")).cast("string"))
        text = F.replace(text, F.lit("{" + name + "}"), fits)
    return text, F.struct(*[size(c).alias(n) for n, c in parts.items()])


def schema_text(schema: DataFrame) -> DataFrame:
    """One row: the schema's lines in order, classes first."""
    line = F.concat(F.when(F.col("kind") == "class", "class ").otherwise("property "), "label", F.coalesce(F.concat(F.lit(": "), "definition"), F.lit("")))
    return schema.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("kind") != "class").alias("k"), "label", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def paired_contrasts(scores: DataFrame, seed: str, condition: str, value: str, a: str, b: str) -> DataFrame:
    """Mean difference of two conditions over the seeds that have both, its spread and number."""
    t = scores.where(F.col(condition).isin(a, b)).groupBy(seed).pivot(condition, [a, b]).agg(F.avg(value))
    d = F.col(f"`{a}`") - F.col(f"`{b}`")
    return t.where(d.isNotNull()).agg(F.count("*").alias("pairs"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("spread"))


def interaction_contrast(scores: DataFrame, seed: str, first: str, second: str, value: str, levels: tuple[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """(a1b1 - a0b1) - (a1b0 - a0b0) by seed, averaged."""
    (a0, a1), (b0, b1) = levels
    cell = lambda a, b: F.avg(F.when((F.col(first) == a) & (F.col(second) == b), F.col(value)))
    t = scores.groupBy(seed).agg((cell(a1, b1) - cell(a0, b1) - cell(a1, b0) + cell(a0, b0)).alias("d"))
    return t.where("d is not null").agg(F.count("*").alias("seeds"), F.avg("d").alias("interaction"))


def calibration_summary(records: DataFrame) -> DataFrame:
    """One row of counts over records (zero_hit, dropped, review, expansions)."""
    return records.agg(F.count("*").alias("records"), F.count_if("zero_hit").alias("zero_hits"), F.count_if(F.size("dropped") > 0).alias("dropped_genres"), F.count_if("review").alias("join_reviews"), F.sum(F.size("expansions")).alias("expansions"))


def frequent_expansions(accepted: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` terms that were accepted most often."""
    return accepted.select(F.explode("accepted").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def integration_loss(union: DataFrame, integrated: DataFrame, key: str, value: str) -> DataFrame:
    """What an instrument loses between the plain union and the integrated graph."""
    return union.select(key, F.col(value).alias("before")).join(integrated.select(key, F.col(value).alias("after")), key, "full").withColumn("loss", F.col("before") - F.col("after"))


def round_delta(rounds: DataFrame, run: str, number: str, total: str) -> DataFrame:
    """Change of a count from a run's last round."""
    return rounds.withColumn("change", F.col(total) - F.lag(total).over(Window.partitionBy(run).orderBy(number)))


def manifest(config: dict, texts: dict[str, str]) -> dict:
    """A run's configuration with the digests of the assets it used."""
    return {"config": dict(sorted(config.items())), "sha256": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(texts.items())}}


def run_states(states: list[dict], one, save) -> list[dict]:
    """Every state through ``one``; a state that fails is recorded and the rest go on; summaries come in order."""
    out = []
    for s in sorted(states, key=lambda s: (str(s.get("run_id")), s.get("round", 0))):
        try:
            out.append(s | {"result": save(one(s)), "error": None})
        except Exception as e:
            out.append(s | {"result": None, "error": str(e)[:500]})
    return out
