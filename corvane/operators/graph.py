"""Operators over triples (s, p, o, o_kind): classes, closures, depth, structural metrics, alignment, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.fixpoint import closure, cut

# Vocabulary terms and namespaces.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TYPE, SUB, LABEL = RDF + "type", RDFS + "subClassOf", RDFS + "label"
BFO, BFO_144 = "http://purl.obolibrary.org/obo/BFO_", "http://purl.obolibrary.org/obo/BFO_0000144"
IOF, CCO = "https://spec.industrialontologies.org/ontology/construct/", "https://www.commoncoreontologies.org/"


def subclass_edges(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == SUB) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select("s", "o").distinct()


def named_classes(triples: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Declared classes and both ends of subclass axioms, without the top, the bottom and excluded namespaces."""
    declared = triples.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "Class", RDFS + "Class") & (F.col("s_kind") == "iri")).select(F.col("s").alias("cls"))
    ends = triples.where(F.col("p") == SUB)
    ends = ends.where("s_kind = 'iri'").select(F.col("s").alias("cls")).union(ends.where("o_kind = 'iri'").select(F.col("o").alias("cls")))
    out = declared.union(ends).distinct().where(~F.col("cls").isin(OWL + "Thing", OWL + "Nothing"))
    for n in excluded:
        out = out.where(~F.col("cls").startswith(n))
    return out


def class_depth(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest path from a root; -1 for classes on a cycle or below none but cycles. A level a round."""
    inside = edges.join(classes.select(F.col("cls").alias("s")), "s", "left_semi").join(classes.select(F.col("cls").alias("o")), "o", "left_semi")
    inside = cut(inside.select("s", "o").distinct())
    depth = cut(classes.join(inside.select(F.col("s").alias("cls")), "cls", "left_anti").select("cls", F.lit(0).alias("depth")))
    while True:
        # A class is settled when all its parents are.
        state = inside.join(depth.select(F.col("cls").alias("o"), "depth"), "o", "left")
        new = state.groupBy("s").agg(F.max("depth").alias("d"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0")
        new = cut(new.select(F.col("s").alias("cls"), (F.col("d") + 1).cast("int").alias("depth")).join(depth, "cls", "left_anti"))
        if new.isEmpty():
            return classes.join(depth, "cls", "left").select("cls", F.coalesce("depth", F.lit(-1)).alias("depth"))
        depth = cut(depth.union(new))


def structural_profile(triples: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """One row of inheritance, relationship and attribute richness, depth, orphan and multiple-parent figures."""
    classes = cut(named_classes(triples, excluded))
    edges = subclass_edges(triples).join(classes.select(F.col("cls").alias("s")), "s", "left_semi").join(classes.select(F.col("cls").alias("o")), "o", "left_semi").select("s", "o")
    edges = cut(edges)
    kinds = triples.where(F.col("p") == TYPE).agg(
        F.countDistinct(F.when(F.col("o") == OWL + "ObjectProperty", F.col("s"))).alias("object_properties"),
        F.countDistinct(F.when(F.col("o") == OWL + "DatatypeProperty", F.col("s"))).alias("data_properties"),
    )
    depth = class_depth(classes, edges).agg(F.max(F.when(F.col("depth") >= 0, F.col("depth"))).alias("max_depth"), F.avg(F.when(F.col("depth") >= 0, F.col("depth"))).alias("mean_depth"))
    parents = edges.groupBy("s").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_parent"), F.count("*").alias("with_parent"))
    one = classes.agg(F.count("*").alias("classes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(kinds).crossJoin(depth).crossJoin(parents)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)
    c, e, op, dp = (F.col(x) for x in ("classes", "edges", "object_properties", "data_properties"))
    return one.select(
        "classes", "edges", "object_properties", "data_properties", rate(e, c).alias("inheritance_richness"), rate(op, op + e).alias("relationship_richness"), rate(dp, c).alias("attribute_richness"),
        "max_depth", F.round("mean_depth", 4).alias("mean_depth"), rate(c - F.col("with_parent"), c).alias("orphan_rate"), "multi_parent",
    )


def alignment(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each domain class's category by priority over all its ancestors."""
    domain = classes.where(~F.col("cls").startswith(BFO) & ~F.col("cls").startswith(IOF) & ~F.col("cls").startswith(CCO))
    up = closure(edges)
    o = F.col("o")
    rank = F.when(o.startswith(CCO), 1).when(o.startswith(IOF) | (o == BFO_144), 2).when(o.startswith(BFO), 3)
    best = up.withColumn("r", rank).where("r is not null").groupBy(F.col("s").alias("cls")).agg(F.min("r").alias("r"))
    name = F.when(F.col("r") == 1, "CCO-aligned").when(F.col("r") == 2, "IOF-aligned").when(F.col("r") == 3, "BFO-only-aligned").otherwise("unaligned")
    return domain.join(best, "cls", "left").select("cls", name.alias("alignment"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    t = aligned.groupBy("alignment").agg(F.count("*").alias("n"))
    return t.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def disjoint_pairs(triples: DataFrame) -> DataFrame:
    """Ordered pairs of disjoint classes: axioms both ways, and the members of disjointness lists."""
    direct = triples.where((F.col("p") == OWL + "disjointWith") & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    cells = triples.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select("s", "o")
    reach = closure(cells, reflexive=False)
    heads = triples.where(F.col("p") == OWL + "members").join(triples.where((F.col("p") == TYPE) & (F.col("o") == OWL + "AllDisjointClasses")).select("s"), "s", "left_semi").select(F.col("s").alias("list"), F.col("o").alias("head"))
    at = heads.select("list", F.col("head").alias("cell")).union(heads.join(reach, heads["head"] == reach["s"]).select("list", F.col("o").alias("cell")))
    member = at.join(triples.where((F.col("p") == RDF + "first") & (F.col("o_kind") == "iri")).select(F.col("s").alias("cell"), F.col("o").alias("m")), "cell").select("list", "m").distinct()
    listed = member.select("list", F.col("m").alias("a")).join(member.select("list", F.col("m").alias("b")), "list").where("a <> b").select("a", "b")
    return direct.union(direct.select("b", "a")).union(listed).distinct()


def rule_check(kg: DataFrame, ontology: DataFrame) -> DataFrame:
    """(kind, rule, n) of violations, near violations, punning and type anomalies, under unique names."""
    is_ = lambda name: ontology.where((F.col("p") == TYPE) & (F.col("o") == OWL + name)).select("s").distinct()
    classes = is_("Class").where(~F.col("s").startswith("_:")).select(F.col("s").alias("c"))
    props = is_("ObjectProperty").union(is_("DatatypeProperty")).union(is_("AnnotationProperty")).distinct().select(F.col("s").alias("prop"))
    rule = lambda name: ontology.where((F.col("p") == RDFS + name) & (F.col("o_kind") == "iri")).select(F.col("s").alias("prop"), F.col("o").alias("c")).join(props, "prop", "left_semi").distinct()
    # Eleven rules read the graph: it is made once, in the shared folder.
    kg = cut(kg.dropDuplicates(["s", "p", "o", "o_kind"]))
    typed = kg.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & (F.col("o") != OWL + "NamedIndividual")).select(F.col("s").alias("x"), F.col("o").alias("c")).distinct()
    have = typed.select("x").distinct().withColumn("has", F.lit(True))
    facts = kg.where(F.col("p") != TYPE).select("s", F.col("p").alias("prop"), "o", "o_kind")
    dom = facts.join(F.broadcast(rule("domain")), "prop").select(F.col("s").alias("x"), "c")
    ran = facts.where("o_kind = 'iri'").join(F.broadcast(rule("range")), "prop").select(F.col("o").alias("x"), "c")
    inferred = typed.union(dom).union(ran).distinct()
    up = closure(subclass_edges(ontology), reflexive=True)
    closed = cut(inferred.join(up.select(F.col("s").alias("c"), F.col("o").alias("a")), "c", "left").select("x", F.coalesce("a", "c").alias("a")).union(inferred.select("x", F.col("c").alias("a"))).distinct())
    clash = closed.join(F.broadcast(disjoint_pairs(ontology)), "a").select("x", F.col("b").alias("a")).join(closed, ["x", "a"]).select("x").distinct()
    marked = lambda name: facts.join(F.broadcast(is_(name).select(F.col("s").alias("prop"))), "prop", "left_semi")
    asym = marked("AsymmetricProperty").where("s <> o")
    people = kg.where((F.col("p") == TYPE) & (F.col("o") == OWL + "NamedIndividual")).select("s").distinct()
    used = kg.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).select(F.col("o").alias("s")).union(kg.where((F.col("p") == TYPE) & (F.col("o") == OWL + "Class")).select("s")).distinct()
    types = typed.join(props.withColumn("is_prop", F.lit(True)), typed["c"] == props["prop"], "left").join(classes.withColumn("is_class", F.lit(True)), "c", "left")
    parts = [
        ("violation", "disjoint_types", clash),
        ("violation", "functional", marked("FunctionalProperty").groupBy("prop", "s").agg(F.countDistinct("o", "o_kind").alias("n")).where("n > 1")),
        ("violation", "inverse_functional", marked("InverseFunctionalProperty").groupBy("prop", "o").agg(F.countDistinct("s").alias("n")).where("n > 1")),
        ("violation", "irreflexive", marked("IrreflexiveProperty").where("s = o")),
        ("violation", "asymmetric", asym.join(asym.select("prop", F.col("o").alias("s"), F.col("s").alias("o")), ["prop", "s", "o"], "left_semi")),
        ("near", "untyped_domain", dom.join(have, "x", "left_anti")),
        ("near", "untyped_range", ran.join(have, "x", "left_anti")),
        ("punning", "class_as_individual", people.join(classes, people["s"] == classes["c"], "left_semi")),
        ("punning", "individual_as_class", used.where(F.col("s") != OWL + "NamedIndividual").join(people, "s", "left_semi").join(classes, used["s"] == classes["c"], "left_anti")),
        ("anomaly", "property_as_type", types.where("is_prop")),
        ("anomaly", "type_not_in_ontology", types.where("is_prop is null and is_class is null")),
    ]
    return reduce(DataFrame.union, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.lit(r).alias("rule"), "n") for k, r, d in parts])


def campaign_instrument(runs: DataFrame) -> DataFrame:
    """One instrument for the whole campaign: the full reasoner only if it ended in time for every graph."""
    w = Window.partitionBy()  # a row for each graph
    done = F.min(F.coalesce(F.col("completed"), F.lit(False)).cast("int")).over(w) == 1
    hook = F.max("has_hook").over(w)
    return runs.withColumn("instrument", F.when(done & hook, "owl2dl").otherwise("owl2rl")).withColumn("completion_rate", F.when(hook, F.avg(F.coalesce(F.col("completed"), F.lit(False)).cast("double")).over(w)))


def canonical_redirect(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Triples with every term replaced by its cluster's root, each once."""
    r = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
    t = triples
    for c in ("s", "p", "o"):
        t = t.join(r(c), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
    return t.distinct()


def provenance_map(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Canonical term, its sources, what was redirected to it and the first round it was seen in."""
    t = triples.select(F.col("s").alias("node"), "source", "round").join(roots, "node", "left").withColumn("iri", F.coalesce("root", "node"))
    return t.groupBy("iri").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("node") != F.col("iri"), F.col("node")))).alias("redirected_from"), F.min("round").alias("first_seen_round"))


def route_defects(defects: DataFrame, provenance: DataFrame) -> DataFrame:
    """Sources of all terms a defect involves; no terms go to all sources, unknown ones to none."""
    e = defects.select("defect_id", F.explode_outer("involved").alias("iri")).join(provenance.select("iri", "sources"), "iri", "left")
    got = e.groupBy("defect_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count("iri").alias("n"))
    return got.select("defect_id", "sources", F.when(F.col("n") == 0, "all").when(F.size("sources") == 0, "unroutable").when(F.size("sources") == 1, "single").otherwise("multi").alias("route"))


def patch_merge(base: DataFrame, window: DataFrame, patched: DataFrame, visible: DataFrame) -> DataFrame:
    """(s, p, o): the base with a patch of its window. Added axioms about entities that the window didn't show are
    rejected; triples that still refer to an entity whose own triples were deleted keep it."""
    added = patched.subtract(window)
    removed = window.subtract(patched)
    hidden = base.select(F.col("s").alias("x")).distinct().join(visible.select(F.col("iri").alias("x")), "x", "left_anti")
    ok = added.join(hidden.withColumnRenamed("x", "s"), "s", "left_anti").join(hidden.withColumnRenamed("x", "o"), "o", "left_anti").select("s", "p", "o")
    rest = base.subtract(removed)
    outside = base.subtract(window)
    lost = removed.join(rest.select("s").distinct(), "s", "left_anti")
    needed = lost.join(outside.select(F.col("o").alias("s")).distinct(), "s", "left_semi").select("s", "p", "o")
    return rest.union(ok).union(needed).distinct()


def window_triples(triples: DataFrame, allowed: DataFrame, schema_predicates: tuple[str, ...]) -> DataFrame:
    """Triples of the allowed entities: annotations and types of a subject, and relations with both ends allowed."""
    a = allowed.select(F.col("iri").alias("s"))
    t = triples.join(a, "s", "left_semi")
    both = t.join(allowed.select(F.col("iri").alias("o")), "o", "left_semi").select(*triples.columns)
    return t.where(F.col("p").isin(*schema_predicates) | (F.col("o_kind") == "literal")).union(both).distinct()


def select_window(scores: DataFrame, edges: DataFrame, sizes: DataFrame, budget: int, fan_out: int = 5, injected: DataFrame | None = None) -> DataFrame:
    """(iri, phase): the classes of a window. ``scores`` (cls, score), ``edges`` (s, o), ``sizes`` (iri, tokens) of all classes.

    Phase 0: everything fits. Else 1: scored classes; 2: all their ancestors; 3: of each scored class's
    siblings and children, without those of phases 1 and 2, the first ``fan_out`` by IRI; 4: the rest by
    score, then IRI, as long as the budget holds; the first that doesn't fit ends it. ``injected`` classes
    (iri) are always shown and take no part in the fill. A window's classes are an ontology's: few.
    """
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    if total <= budget:
        return sizes.select("iri", F.lit(0).alias("phase"))
    seeds = scores.select(F.col("cls").alias("iri")).distinct()
    pairs = edges.select("s", "o").distinct()
    ours = lambda side: seeds.select(F.col("iri").alias(side))
    up = closure(edges).join(ours("s"), "s", "left_semi").select(F.col("o").alias("iri")).distinct().join(seeds, "iri", "left_anti")
    children = pairs.join(ours("o"), "o", "left_semi").select(F.col("o").alias("seed"), F.col("s").alias("iri"))
    parents = pairs.join(ours("s"), "s", "left_semi").select(F.col("s").alias("seed"), "o")
    siblings = parents.join(pairs, "o").select("seed", F.col("s").alias("iri")).where("seed <> iri")
    near = children.union(siblings).distinct().join(seeds, "iri", "left_anti").join(up, "iri", "left_anti")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("iri"))).where(F.col("r") <= fan_out).select("iri").distinct()
    chosen = cut(seeds.withColumn("phase", F.lit(1)).union(up.withColumn("phase", F.lit(2))).union(near.withColumn("phase", F.lit(3))))
    used = chosen.join(sizes, "iri").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    rest = sizes.join(chosen, "iri", "left_anti")
    if injected is not None:
        rest = rest.join(injected, "iri", "left_anti")
    rest = rest.join(scores.groupBy(F.col("cls").alias("iri")).agg(F.max("score").alias("score")), "iri", "left")
    w = Window.partitionBy().orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "iri").rowsBetween(Window.unboundedPreceding, 0)
    fill = rest.withColumn("used", F.sum("tokens").over(w) + used).where((F.col("used") <= budget) & F.lit(used < budget))
    return chosen.union(fill.select("iri", F.lit(4)))


def functional(facts: DataFrame, key: str, value: list[str]) -> DataFrame:
    """Keys with more than one distinct value."""
    return facts.groupBy(key).agg(F.countDistinct(*value).alias("n")).where("n > 1")


def both_ways(facts: DataFrame) -> DataFrame:
    """Pairs that are stated in both directions."""
    t = facts.where("s <> o").distinct()
    return t.join(t.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_semi")


def reflexive(facts: DataFrame) -> DataFrame:
    """Entities in relation to themselves, with the number of statements."""
    return facts.where("s = o").groupBy("s").agg(F.count("*").alias("n"))


def canonical_mapping(matches: DataFrame, least: float = 0.5) -> DataFrame:
    """(node, root): clusters over matches (s, o, relation, confidence) that state equality with enough confidence."""
    from corvane.plans.fixpoint import components

    return components(matches.where((F.col("relation") == "=") & (F.col("confidence") >= least)).select("s", "o"))


def integrated(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """The redirected graph without the old declarations, with an equivalence from each old term to its root."""
    old = roots.where("node <> root")
    kept = triples.join(old.select(F.col("node").alias("s")).withColumn("gone", F.lit(True)), "s", "left")
    kept = kept.where(F.col("gone").isNull() | (F.col("p") != TYPE) | ~F.col("o").isin(OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty")).select("s", "p", "o")
    same = old.select(F.col("node").alias("s"), F.lit(OWL + "equivalentClass").alias("p"), F.col("root").alias("o"))
    return canonical_redirect(kept, roots).select("s", "p", "o").union(same).distinct()


def rule_totals(checked: DataFrame) -> DataFrame:
    """Violations in all, and those rules that have any."""
    v = checked.where("kind = 'violation'")
    return v.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.concat("rule", F.lit("="), F.col("n").cast("string"))))).alias("rules"))
