"""Schema views, assembly of graphs from extracted triples, utilisation and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.stats import wilson
from corvane.operators.graph import LABEL, OWL, RDFS, TYPE
from corvane.plans.fixpoint import stored

SKOS_DEFINITION = "http://www.w3.org/2004/02/skos/core#definition"


def schema_view(ontology: DataFrame) -> DataFrame:
    """One entry for each normalised label: kind, smallest IRI, label, definition, domain and range.

    Classes and properties are apart; an object property wins over a datatype property of the label.
    """
    typed = ontology.where(F.col("p") == TYPE).select(F.col("s").alias("iri"), F.when(F.col("o") == OWL + "Class", "class").when(F.col("o") == OWL + "ObjectProperty", "object").when(F.col("o") == OWL + "DatatypeProperty", "data").alias("kind")).where("kind is not null").distinct()
    low = lambda p, n: ontology.where(F.col("p") == p).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias(n))
    t = typed.join(low(LABEL, "label"), "iri")
    for p, n in ((SKOS_DEFINITION, "d1"), (RDFS + "comment", "d2"), (RDFS + "domain", "domain"), (RDFS + "range", "range")):
        t = t.join(low(p, n), "iri", "left")
    t = t.withColumn("norm", X.normalise_label(F.col("label"))).withColumn("definition", F.coalesce("d1", "d2")).drop("d1", "d2").where("norm <> ''")
    w = Window.partitionBy("norm", F.col("kind") == "class").orderBy(F.when(F.col("kind") == "data", 1).otherwise(0), "iri")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


#: Distinct labels that are broadcast with what they mean at most.
LABELS = 200_000


def _meanings(rows: DataFrame, labels: DataFrame, column: str, meanings: DataFrame, norm: str) -> DataFrame:
    """Rows with the meaning of a label of ``labels`` (raw, norm), a missing one included."""
    known = labels.join(F.broadcast(meanings), labels["norm"] == meanings[norm]).drop("norm", norm)
    if known.limit(LABELS + 1).count() <= LABELS:
        known = F.broadcast(known)
    return rows.join(known, F.col(column).eqNullSafe(F.col("raw")), "left").drop("raw")


def conform(extracted: DataFrame, schema: DataFrame) -> DataFrame:
    """Extracted triples with a status, in the order of the checks: predicate, subject type, literal, object type."""
    props = schema.where("kind <> 'class'").select(F.col("norm").alias("pn"), F.col("iri").alias("p_iri"), (F.col("kind") == "data").alias("is_data"), F.col("label").alias("predicate_label"))
    cls = schema.where("kind = 'class'")
    # Stored before they are normalised: else the planner would filter all rows by their normalised labels.
    labels = stored(extracted.select(F.explode(F.array("predicate", "subject_type", "object_type")).alias("raw")).distinct())
    labels = stored(labels.select("raw", X.normalise_label(F.col("raw")).alias("norm")))
    t = _meanings(extracted, labels, "predicate", props, "pn")
    t = _meanings(t, labels, "subject_type", cls.select(F.col("norm").alias("sn"), F.col("iri").alias("s_type")), "sn")
    t = _meanings(t, labels, "object_type", cls.select(F.col("norm").alias("on"), F.col("iri").alias("o_type")), "on")
    literal = F.col("is_literal") | F.col("is_data")
    status = F.when(F.col("p_iri").isNull(), "unknown_predicate").when(F.col("s_type").isNull(), "unknown_subject_type").when(literal & ~F.col("is_data"), "literal_for_object_property").when(~literal & F.col("o_type").isNull(), "unknown_object_type").otherwise("kept")
    t = t.withColumn("status", status).withColumn("s_iri", X.individual_iri(F.col("subject")))
    return t.withColumn("o_node", F.when(F.coalesce("is_data", F.lit(False)), F.col("object")).otherwise(X.individual_iri(F.col("object")))).withColumn("o_is_literal", F.coalesce("is_data", F.lit(False)))


def conformance_tally(conformed: DataFrame, order: list[str]) -> DataFrame:
    """Counts by status; repeats of a kept triple are counted as duplicates and stay kept, whichever comes first in ``order``.

    Rows of the same words are counted first, so that their nodes are made once.
    """
    kept = F.col("status") == "kept"
    same = conformed.groupBy("status", *[F.when(kept, F.col(c)).alias(c) for c in ("subject", "p_iri", "object", "is_data")]).agg(F.count("*").alias("n"))
    same = stored(same)
    data = F.coalesce("is_data", F.lit(False))
    label = same.where(kept).select(F.col("subject").alias("raw")).union(same.where(kept & ~data).select("object")).distinct()
    # A label's node is made once; a missing label has a node too.
    iri = stored(label.select("raw", X.individual_iri(F.col("raw")).alias("iri")))
    at = lambda c, n: iri.select(F.coalesce("raw", F.lit("")).alias(f"{c}_key"), F.col("raw").isNull().alias(f"{c}_none"), F.col("iri").alias(n))
    t = same.where(kept)
    for c, n in (("subject", "s_iri"), ("object", "o_iri")):
        t = t.withColumn(f"{c}_key", F.coalesce(c, F.lit(""))).withColumn(f"{c}_none", F.col(c).isNull()).join(at(c, n), [f"{c}_key", f"{c}_none"], "left")
    node = t.groupBy("s_iri", "p_iri", F.when(data, F.col("object")).otherwise(F.col("o_iri")).alias("o_node")).agg(F.sum("n").alias("n"))
    repeats = node.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n")).select(F.lit("duplicates").alias("status"), "n")
    return same.groupBy("status").agg(F.sum("n").alias("n")).union(repeats)


def assembled(conformed: DataFrame) -> DataFrame:
    """The graph's triples. A subject whose triple fails a later check is still in the graph."""
    past = conformed.where(~F.col("status").isin("unknown_predicate", "unknown_subject_type"))
    kept = conformed.where("status = 'kept'")
    row = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), o.alias("o"), kind.alias("o_kind"))
    iri, lit = F.lit("iri"), F.lit("literal")
    who = lambda n, t, label: F.array(row(n, TYPE, F.lit(OWL + "NamedIndividual"), iri), row(n, TYPE, t, iri), row(n, LABEL, label, lit))
    a = past.select(F.explode(who(F.col("s_iri"), F.col("s_type"), F.col("subject"))).alias("t"))
    b = kept.where("not o_is_literal").select(F.explode(who(F.col("o_node"), F.col("o_type"), F.col("object"))).alias("t"))
    c = kept.select(row(F.col("s_iri"), F.col("p_iri"), F.col("o_node"), F.when(F.col("o_is_literal"), lit).otherwise(iri)).alias("t"))
    return a.union(b).union(c).select("t.*").distinct()


def utilisation(kg: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Used classes and properties of the schema, individuals and those in no relation."""
    used_c = kg.where(F.col("p") == TYPE).select(F.col("o").alias("iri")).distinct().join(classes, "iri", "left_semi")
    used_p = kg.select(F.col("p").alias("iri")).distinct().join(properties, "iri", "left_semi")
    people = kg.where((F.col("p") == TYPE) & (F.col("o") == OWL + "NamedIndividual")).select(F.col("s").alias("iri")).distinct()
    rel = kg.where(~F.col("p").isin(TYPE, LABEL))
    linked = rel.select(F.col("s").alias("iri")).union(rel.where("o_kind = 'iri'").select(F.col("o").alias("iri"))).distinct()
    n = lambda d, a: d.agg(F.count("*").alias(a))
    one = n(used_c, "classes_used").crossJoin(n(classes, "classes")).crossJoin(n(used_p, "properties_used")).crossJoin(n(properties, "properties")).crossJoin(n(people, "individuals")).crossJoin(n(people.join(linked, "iri", "left_anti"), "orphans"))
    return one.withColumn("orphan_rate", F.coalesce(F.try_divide(F.col("orphans").cast("double"), F.col("individuals").cast("double")), F.lit(0.0)))


def orphan_rates(individuals: DataFrame, related: DataFrame, key: str, cls: str) -> DataFrame:
    """Individuals of each class, and those that are in no relation."""
    t = individuals.join(related.select(key, F.lit(True).alias("related")).distinct(), key, "left")
    t = t.groupBy(cls).agg(F.count("*").alias("individuals"), F.count_if(F.col("related").isNull()).alias("orphans"))
    return t.withColumn("orphan_rate", F.round(F.col("orphans") / F.col("individuals"), 6))


def content_hash(triples: DataFrame) -> DataFrame:
    """sha256 of the sorted N-Triples lines, joined by newlines."""
    return triples.select(F.col("line")).agg(F.sha2(F.expr("listagg(line, '\n') within group (order by line)").cast("binary"), 256).alias("sha256"))


def literal_support(evidence: Column, subject: Column, obj: Column) -> Column:
    return F.contains(F.lower(evidence), F.lower(subject)) & F.contains(F.lower(evidence), F.lower(obj))


def precision(verified: DataFrame, score: str, threshold: float, genre: str) -> DataFrame:
    """Verified share with its interval, for all (null genre) and for each genre."""
    t = verified.groupingSets([[], [genre]], genre).agg(F.count_if(F.col(score) >= threshold).alias("successes"), F.count("*").alias("trials"))
    return t.withColumn("w", wilson(F.col("successes"), F.col("trials"))).select(genre, "successes", "trials", F.round("w.estimate", 6).alias("estimate"), F.round("w.lower", 6).alias("lower"), F.round("w.upper", 6).alias("upper"), F.round("w.half_width", 6).alias("half_width"))


def hashed(key: Column, what: str, seed: int) -> Column:
    """A number of 32 bits that follows from a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{what}|{seed}"))), 1, 8), 16, 10).cast("long")


def mutations(records: DataFrame, individuals: DataFrame, properties: DataFrame, seed: int = 1, limit: int = 500) -> DataFrame:
    """(key, s, p, o, label, mutation): positives with support, and one mutation of each that is possible.

    ``records`` (key, s, p, o, s_class, o_class, is_literal, supported), ``individuals`` (iri, cls),
    ``properties`` (iri, is_literal). The first operator of a positive is drawn, then come object,
    subject and predicate swaps. A swap takes a place in the sorted members of the class by the key's
    hash, past the own one, so no member meets another and a class of any size costs a join on its place.
    """
    key = F.col("key")
    base = records.where("supported").withColumn("h", hashed(key, "order", seed)).orderBy("h", "key").limit(limit).drop("h", "supported")
    place = lambda t, cls: t.distinct().withColumn("at", F.row_number().over(Window.partitionBy(cls).orderBy("iri")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(cls)))
    people, props = place(individuals.select("iri", "cls"), "cls"), place(properties.select("iri", "is_literal"), "is_literal")

    def swap(t: DataFrame, side: str, cls: str, members: DataFrame, by: str, name: str) -> DataFrame:
        own = members.select(F.col("iri").alias(side), F.col(by).alias(cls), F.col("at").alias("own"), "n")
        t = t.join(own, [side, cls], "left")
        size = members.groupBy(by).agg(F.first("n").alias("m")).select(F.col(by).alias(cls), "m")
        t = t.join(F.broadcast(size), cls, "left")
        # A member that isn't in the class may be swapped for any; one that is, for any other.
        inside = F.col("own").isNotNull()
        to = F.when(inside, (F.col("own") + 1 + hashed(key, name, seed) % F.greatest(F.col("m") - 1, F.lit(1))) % F.col("m")).otherwise(hashed(key, name, seed) % F.col("m"))
        t = t.withColumn("to", F.when(F.col("m") > F.when(inside, 1).otherwise(0), to))
        alt = members.select(F.col("iri").alias(name), F.col(by).alias(cls), F.col("at").alias("to"))
        return t.join(alt, [cls, "to"], "left").drop("own", "n", "m", "to")

    t = swap(swap(swap(base, "s", "s_class", people, "cls", "subject_swap"), "o", "o_class", people, "cls", "object_swap"), "p", "is_literal", props, "is_literal", "predicate_swap")
    t = t.withColumn("object_swap", F.when(~F.col("is_literal"), F.col("object_swap")))
    first = F.element_at(F.array(*map(F.lit, ("subject_swap", "object_swap", "predicate_swap"))), (hashed(key, "op", seed) % 3 + 1).cast("int"))
    order = F.concat(F.array(first), F.array(*map(F.lit, ("object_swap", "subject_swap", "predicate_swap"))))
    can = F.create_map(*(x for n in ("subject_swap", "object_swap", "predicate_swap") for x in (F.lit(n), F.col(n).isNotNull())))
    t = t.withColumn("mutation", F.get(F.filter(order, lambda n: can[n]), F.lit(0)))
    none = base.select("key", "s", "p", "o", F.lit(True).alias("label"), F.lit("none").alias("mutation"))
    col = lambda c, n: F.when(F.col("mutation") == n, F.col(n)).otherwise(F.col(c)).alias(c)
    return none.union(t.where("mutation is not null").select("key", col("s", "subject_swap"), col("p", "predicate_swap"), col("o", "object_swap"), F.lit(False), "mutation"))


def repeats(triples: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The triples that came before, in order of arrival, with their number."""
    return triples.withColumn("seen", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("seen > 1")


def entity_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Entities that two rounds don't share, as a share of the later one's."""
    n = lambda d, c: d.agg(F.count("*").alias(c))
    one = n(after.join(before, key, "left_anti"), "added").crossJoin(n(before.join(after, key, "left_anti"), "removed")).crossJoin(n(after, "total"))
    return one.select("added", "removed", F.round((F.col("added") + F.col("removed")) / F.col("total"), 6).alias("delta_rate"))


def shared_entities(tables: list[DataFrame], key: str) -> DataFrame:
    """Entities of two tables or more."""
    from functools import reduce

    t = reduce(DataFrame.union, [d.select(key, F.lit(i).alias("source")) for i, d in enumerate(tables)])
    return t.groupBy(key).agg(F.countDistinct("source").alias("n")).where("n > 1").select(key)
