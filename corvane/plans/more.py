"""Queries of the operators on questions, windows, integration and assembly, with the SQL that each must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import stats as S
from corvane.functions import text as X
from corvane.functions import vectors as V
from corvane.operators import battery as B
from corvane.operators import calibration as C
from corvane.operators import graph as G
from corvane.operators import kg as K
from corvane.operators import terms as M
from corvane.plans.catalog import query
from corvane.plans.fixpoint import stored
from corvane.plans.views import corpus, ontology, table

# Questions

_LABEL_IRI = "<http://www.w3.org/2000/01/rdf-schema#label>"
#: Queries of which it is known whether they join classes by more than labels and types.
_FORMS = (
    ("SELECT ?a WHERE { ?a rdfs:label ?l . ?a rdfs:subClassOf ?b . ?b rdfs:label ?m }", True),
    ("SELECT ?a WHERE { ?a ex:uses ?b . ?a rdfs:label ?l }", False),
    ("SELECT ?a WHERE { ?a ?p ?b . ?b a ?c }", False),
    ("SELECT ?a WHERE { ?a a ?b . # ?a ex:uses ?c\n ?a skos:prefLabel ?l }", True),
    ('SELECT ?a WHERE { ?a rdfs:label ?l . FILTER (REGEX(?l, "?x ex:uses ?y")) . ?a rdf:type ?t }', True),
    ("SELECT ?a WHERE { ?a rdfs:subClassOf+ ?b . ?b rdfs:label ?l }", False),
)
_TYPES = ("relational", "multi-hop", "existential", "definitional")


def _pick(n, values):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _case(n: str, values) -> str:
    return f"([{', '.join(str(v) if isinstance(v, bool) else repr(v) for v in values)}])[({n}) % {len(values)} + 1]"


@query(f"SELECT event_id AS cq_id, {_case('event_id // 8', _TYPES)} IN ('relational', 'multi-hop') AND (user_id % 3 < 2 OR {_case('event_id', [b for _, b in _FORMS])}) AS review FROM events")
def join_review(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select(n.alias("cq_id"), C.needs_join_review(_pick(F.floor(n / 8), _TYPES), F.col("user_id") % 3, _pick(n, [q for q, _ in _FORMS])).alias("review"))


_TAGS = ("PRC", "NCR", "CAR", "ERP", "ARM")


@query(f"WITH t AS (SELECT event_id, [{_case('event_id', _TAGS)}, {_case('event_id // 5', _TAGS)}] AS tags FROM events) SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: x IN ('PRC', 'CAR', 'STR', 'ERP', 'MES')))), ',') AS dropped FROM t")
def dropped_genre_tags(spark, sf):
    n = F.col("event_id")
    tags = F.array(_pick(n, _TAGS), _pick(F.floor(n / 5), _TAGS))
    return table(spark, sf, "events").select("event_id", F.array_join(C.dropped_tags(tags), ",").alias("dropped"))


@query("WITH q AS (SELECT item_id AS place, 'Q' || item_id // 2 * 2 AS id FROM benchmark UNION ALL SELECT 1000 + item_id, 'Z' || item_id FROM benchmark), s AS (SELECT *, CASE WHEN place % 5 = 0 THEN 'odd' ELSE 'relational' END AS t FROM q) SELECT id AS cq_id, 'duplicate id' AS problem FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) > 1 UNION ALL SELECT id, 'unknown stratum ''odd''' FROM s WHERE t = 'odd' UNION ALL SELECT id, 'SPARQL does not parse' FROM s WHERE place % 7 = 3 UNION ALL SELECT id, 'pattern term ''Pumps'' is not in normalised form (''pump'')' FROM s WHERE place % 3 = 1")
def question_problems(spark, sf):
    b = table(spark, sf, "benchmark")
    q = b.select(F.col("item_id").alias("place"), F.concat(F.lit("Q"), (F.floor(F.col("item_id") / 2) * 2).cast("string")).alias("cq_id")).union(b.select(F.col("item_id") + 1000, F.concat(F.lit("Z"), F.col("item_id").cast("string"))))
    good, bad = "SELECT ?a WHERE { ?a rdfs:label ?l }", "SELECT ?a WHERE { ?a rdfs:label"
    n = F.col("place")
    return C.question_problems(q.select("place", "cq_id", F.when(n % 5 == 0, "odd").otherwise("relational").alias("qtype"), F.when(n % 7 == 3, bad).otherwise(good).alias("sparql"), F.when(n % 3 == 1, "(Pumps|valve)").otherwise("(seal)").alias("pattern")))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'FILTER(REGEX(?l, \"(pump|seal|alpha|beta)\")) . FILTER(CONTAINS(?m, \"(valve|gamma)\"))' WHEN 1 THEN 'FILTER(REGEX(?l, \"(pump|seal)\")) . FILTER(CONTAINS(?m, \"(valve|gamma)\"))' ELSE 'FILTER(REGEX(?l, \"(pump|seal)\")) . FILTER(CONTAINS(?m, \"valve\"))' END AS patched FROM benchmark")
def patched_queries(spark, sf):
    n = F.col("item_id") % 3
    none = F.array().cast("array<string>")
    more = F.array(F.struct(F.lit("(pump|seal)").alias("pattern"), F.when(n == 0, F.array(F.lit("Beta"), F.lit("alpha"), F.lit("beta"))).otherwise(none).alias("terms")), F.struct(F.lit("valve").alias("pattern"), F.when(n < 2, F.array(F.lit("gamma"))).otherwise(none).alias("terms")))
    return table(spark, sf, "benchmark").select("item_id", C.patched_query(F.lit('FILTER(REGEX(?l, "(pump|seal)")) . FILTER(CONTAINS(?m, "valve"))'), more).alias("patched"))


@query("SELECT n_nationkey, 'PREFIX score: <urn:scoring#>' || chr(10) || 'SELECT ?x WHERE { ?x score:normLabel \"' || n_name || '\" . ?x score:normLabel ?l }' AS query FROM nation")
def rewritten_queries(spark, sf):
    q = F.concat(F.lit('SELECT ?x WHERE { ?x rdfs:label "'), "n_name", F.lit(f'" . ?x {_LABEL_IRI} ?l }}'))
    return table(spark, sf, "nation").select("n_nationkey", X.rewrite_label_query(q).alias("query"))


_RESULTS = f"r AS (SELECT event_id AS cq_id, {_case('event_id', ('E', 'R', 'M'))} AS qtype, event_type, value > 20 AS answered, value > 60 AS raw, event_id % 11 = 0 AS inj, CASE WHEN event_id % 13 = 0 THEN 'x' END AS error FROM events)"


def _results(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select(n.alias("cq_id"), _pick(n, ("E", "R", "M")).alias("qtype"), (_pick(n, ("E", "R", "M")) != "E").alias("primary"), (F.col("value") > 20).alias("answered"), (F.col("value") > 60).alias("raw_answered"), F.when(n % 13 == 0, "x").alias("error"), (n % 11 == 0).alias("injection_only"), F.array("event_type", F.lit("all")).alias("genre_tags"))


@query(f"WITH {_RESULTS} SELECT count(*) AS questions, round(avg(answered::INT::DOUBLE), 9) AS overall, round(avg(CASE WHEN qtype = 'E' THEN answered::INT::DOUBLE END), 9) AS stratum_E, round(avg(CASE WHEN qtype = 'R' THEN answered::INT::DOUBLE END), 9) AS stratum_R, round(avg(CASE WHEN qtype = 'M' THEN answered::INT::DOUBLE END), 9) AS stratum_M, round(avg(CASE WHEN qtype <> 'E' THEN answered::INT::DOUBLE END), 9) AS primary_share, round(count_if(answered AND NOT raw)::DOUBLE / count_if(answered)::BIGINT, 9) AS norm_only_share, count_if(error IS NOT NULL)::BIGINT AS errors, count_if(inj)::BIGINT AS injection_only FROM r")
def question_report(spark, sf):
    t = C.cq_report(_results(spark, sf))
    return t.select("questions", *[F.round(c, 9).alias(c) for c in ("overall", "stratum_E", "stratum_R", "stratum_M", "primary_share", "norm_only_share")], "errors", "injection_only")


@query(f"WITH {_RESULTS}, g AS (SELECT event_type AS genre, answered FROM r UNION ALL SELECT 'all', answered FROM r) SELECT genre, count(*) AS n, round(avg(answered::INT::DOUBLE), 9) AS share FROM g GROUP BY genre")
def question_share_by_genre(spark, sf):
    return C.cq_by_genre(_results(spark, sf)).select("genre", "n", F.round("share", 9).alias("share"))


@query("SELECT count(*) AS records, count_if(event_id % 4 = 0)::BIGINT AS zero_hits, count_if(event_id % 3 = 0)::BIGINT AS dropped_genres, count_if(event_id % 5 = 0)::BIGINT AS join_reviews, sum(event_id % 3)::BIGINT AS expansions FROM events")
def calibration_counts(spark, sf):
    n = F.col("event_id")
    some = lambda k: F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), k.cast("int"))
    return B.calibration_summary(table(spark, sf, "events").select((n % 4 == 0).alias("zero_hit"), some((n % 3 == 0).cast("int")).alias("dropped"), (n % 5 == 0).alias("review"), some(n % 3).alias("expansions")))


@query("SELECT event_type || ':' || user_id % 40 AS term, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def expansion_top20(spark, sf):
    return B.frequent_expansions(table(spark, sf, "events").select(F.array(F.concat_ws(":", "event_type", (F.col("user_id") % 40).cast("string"))).alias("accepted")))


@query("SELECT event_type AS genre, event_id AS place, term FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN ' Term ' ELSE 'TERM ' END || user_id || ' ' AS term FROM events) QUALIFY row_number() OVER (PARTITION BY lower(trim(term)) ORDER BY event_type, event_id) = 1")
def first_seen_terms(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_type").alias("genre"), F.col("event_id").alias("place"), F.concat(F.when(F.col("event_id") % 2 == 0, " Term ").otherwise("TERM "), "user_id", F.lit(" ")).alias("term"))
    return C.first_seen(t)


@query()
def expansion_greedy(spark, sf):
    """Candidates for every genre from the ranked inventory, after the benchmark's terms; a fold, so without SQL."""
    from corvane.plans.catalog import _scored

    f, s = _scored(spark, sf)
    top = F.broadcast(stored(M.top_terms(s)))  # 500 rows
    c = f.join(top, "term").select("term", "rank", F.inline("by_genre")).select(F.col("genre").alias("cq_id"), "term", "rank").select("cq_id", F.col("rank").alias("place"), F.col("cq_id").alias("source"), "term")
    return C.greedy_expansions(c, c.groupBy("cq_id").agg(F.array(F.min("term")).alias("alternates"))).select("cq_id", F.posexplode("accepted").alias("at", "a")).select("cq_id", "at", "a.source", "a.term")


# Terms, vectors, text


@query("SELECT DISTINCT lower(p_name) AS term FROM part WHERE len(string_split(lower(p_name), ' ')) BETWEEN 2 AND 5")
def term_length_band(spark, sf):
    return M.length_band(table(spark, sf, "part").select(F.lower("p_name").alias("term")).distinct())


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) SELECT x.vec_id, round(list_dot_product(x.a, y.a) / ((sqrt(list_dot_product(x.a, x.a)) + 1e-10) * (sqrt(list_dot_product(y.a, y.a)) + 1e-10)), 9) AS similarity FROM v x JOIN v y ON y.vec_id = x.vec_id + 1")
def guarded_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, 'Part ' || l_partkey || ' supplied by Supplier ' || l_suppkey || '.' AS plain, CASE WHEN l_linenumber % 2 = 0 THEN 'Part ' || l_partkey ELSE 'The part Part ' || l_partkey END || ' supplied by the vendor Supplier ' || l_suppkey || '.' AS b1, 'Part ' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' (a part)' END || ' supplied by Supplier ' || l_suppkey || ' (a vendor).' AS b2 FROM lineitem")
def verbalised_triples(spark, sf):
    s, o = F.concat(F.lit("Part "), "l_partkey"), F.concat(F.lit("Supplier "), "l_suppkey")
    c = F.when(F.col("l_linenumber") % 2 == 1, "part")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[X.verbalise(s, F.lit("supplied by"), o, c, F.lit("vendor"), k).alias(k) for k in ("plain", "b1", "b2")])


@query("SELECT o_orderkey, ('0x' || left(sha256('S-POP|7|' || o_orderkey), 8))::BIGINT AS seed FROM orders")
def derived_seeds(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.seed("S-POP", "7", F.col("o_orderkey")).alias("seed"))


@query("SELECT doc_id, length(text) - length(replace(replace(text, 'the', ''), 'and', '')) AS n, replace(replace(text, 'the', '[redacted]'), 'and', '[redacted]') = text AS clean, md5(replace(replace(text, 'the', '[redacted]'), 'and', '[redacted]')) AS digest FROM documents")
def redacted_texts(spark, sf):
    out = C.redact(F.col("text"), F.array(F.lit("and"), F.lit("the"), F.lit("the")))
    cut = F.length("text") - F.length(F.replace(F.replace("text", F.lit("the"), F.lit("")), F.lit("and"), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", cut.cast("long").alias("n"), (out == F.col("text")).alias("clean"), F.md5(out).alias("digest"))


@query(f"WITH t AS (SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR || '|9'), 8))::BIGINT % 2 AS half, unnest(list_distinct(regexp_extract_all(lower(text), '{X.TOKEN}'))) AS term FROM documents), top AS (SELECT half, term FROM t GROUP BY half, term QUALIFY row_number() OVER (PARTITION BY half ORDER BY count(*) DESC, term) <= 300), b AS (SELECT term, count(*) AS halves FROM top GROUP BY term) SELECT count(*) AS terms, count_if(halves = 2)::BIGINT AS shared, round(count_if(halves = 2)::DOUBLE / count(*), 6) AS jaccard FROM b")
def split_half_stability(spark, sf):
    return C.split_half(corpus(spark, sf).select("doc_id", F.explode(X.token_set(F.col("text"))).alias("term")), "doc_id", 9, 300)


@query("WITH a AS (SELECT event_id AS q, event_type || ' of ' || user_id % 9 AS answer FROM events), l AS (SELECT event_id AS q, event_type AS label FROM events UNION ALL SELECT event_id, 'other ' || user_id % 9 FROM events), s AS (SELECT q, answer, label, coalesce(len(list_filter(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: list_contains(regexp_extract_all(lower(answer), '[a-z0-9]+'), w)))::DOUBLE / nullif(len(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda w: length(w) > 2)), 0), 0) AS score FROM a JOIN l USING (q)) SELECT q, answer, CASE WHEN max(score) >= 0.5 THEN arg_max(label, (score, label)) END AS label, max(score) AS score FROM s GROUP BY q, answer")
def matched_answers(spark, sf):
    e = table(spark, sf, "events").withColumn("u", (F.col("user_id") % 9).cast("string"))
    a = e.select(F.col("event_id").alias("q"), F.concat("event_type", F.lit(" of "), "u").alias("answer"))
    labels = e.select(F.col("event_id").alias("q"), F.col("event_type").alias("label")).union(e.select("event_id", F.concat(F.lit("other "), "u")))
    return C.match_answers(a, labels, "q", X.lexical_entailment, 0.5)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def reserved_links(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.reserved_links(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey")


@query("SELECT o_orderstatus AS condition, round(avg((c_mktsegment <> CASE WHEN c_custkey % 20 = 0 THEN 'x' ELSE c_mktsegment END)::INT::DOUBLE), 6) AS rate, avg((c_custkey % 20 = 0)::INT::DOUBLE) > 0.05 AS contaminated FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def contamination_flag(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.select(F.col("o_orderstatus").alias("condition"), F.col("c_mktsegment").alias("expected"), F.when(F.col("c_custkey") % 20 == 0, "x").otherwise(F.col("c_mktsegment")).alias("observed"))
    return C.contamination(t, "condition", "expected", "observed")


@query("SELECT event_type, count(*) AS total_pitfalls, count_if(value > 80)::BIGINT AS critical, count_if(value > 40 AND value <= 80)::BIGINT AS important, count_if(value <= 40)::BIGINT AS minor, array_to_string(list_sort(list_distinct(list('P' || lpad((user_id % 30)::VARCHAR, 2, '0')))), ',') AS codes FROM events GROUP BY event_type")
def pitfall_severities(spark, sf):
    one = F.struct(F.concat(F.lit("P"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0")).alias("code"), F.when(F.col("value") > 80, "critical").when(F.col("value") > 40, "important").otherwise("minor").alias("severity"))
    t = C.pitfall_summary(table(spark, sf, "events").groupBy("event_type").agg(F.collect_list(one).alias("pitfalls")), "event_type")
    return t.select("event_type", *[F.col(c).cast("long").alias(c) for c in ("total_pitfalls", "critical", "important", "minor")], F.array_join("pitfall_codes", ",").alias("codes"))


# Graphs


@query("SELECT p, count(*) AS n FROM (SELECT 'sub' AS p FROM (SELECT DISTINCT s, o FROM ({h})) UNION ALL SELECT 'type' FROM (SELECT s FROM ({h}) UNION SELECT o FROM ({h}) UNION SELECT 'z:alone') UNION ALL SELECT 'type' FROM range(3)) GROUP BY p".replace("{h}", __import__("corvane.plans.views", fromlist=["HIERARCHY_SQL"]).HIERARCHY_SQL))
def iri_objects(spark, sf):
    o = ontology(spark, sf).distinct().where("o_kind = 'iri'")
    return o.groupBy(F.when(F.col("p") == G.SUB, "sub").otherwise("type").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS community FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region")
def communities_by_parent(spark, sf):
    e = table(spark, sf, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("s"), F.concat(F.lit("region:"), "n_regionkey").alias("o"), F.lit("=").alias("relation"), F.lit(0.9).alias("confidence"))
    low = e.select("s", F.lit("region:0").alias("o"), "relation", F.lit(0.2).alias("confidence")).union(e.select("s", F.lit("region:1").alias("o"), F.lit("<").alias("relation"), "confidence"))
    m = G.canonical_mapping(e.union(low))
    name = m.where("node like 'region:%'").select("root", F.col("node").alias("community"))
    return m.join(name, "root").select("node", "community")


@query("WITH e AS (SELECT c_nationkey AS a, o_orderpriority AS b, c_nationkey % 3 AS ca, ascii(o_orderpriority) % 3 AS cb FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT count(*)::DOUBLE AS m, sum((ca = cb)::INT)::DOUBLE AS l FROM e), d AS (SELECT c, count(*)::DOUBLE AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c) SELECT round(any_value(l) / any_value(m) - sum(d * d) / (4 * any_value(m) * any_value(m)), 9) AS modularity FROM d, m")
def community_modularity(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = t.select(F.concat(F.lit("n"), "c_nationkey").alias("s"), F.concat(F.lit("p"), "o_orderpriority").alias("o"), (F.col("c_nationkey") % 3).cast("int").alias("ca"), (F.ascii("o_orderpriority") % 3).alias("cb"))
    c = e.select(F.col("s").alias("node"), F.col("ca").alias("community")).union(e.select("o", "cb")).distinct()
    return S.modularity(e.select("s", "o"), c).select(F.round("modularity", 9).alias("modularity"))


_LINKS = "t AS (SELECT 'part:' || l_partkey AS s, 'supplier:' || l_suppkey AS o, l_linenumber AS source, l_orderkey AS round FROM lineitem), m AS (SELECT 'supplier:' || s_suppkey AS node, 'supplier:' || min(s_suppkey::VARCHAR) OVER (PARTITION BY s_nationkey) AS root FROM supplier)"


def _roots(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node"), "s_nationkey")
    return s.join(s.groupBy("s_nationkey").agg(F.min("node").alias("root")), "s_nationkey").select("node", "root")


def _links(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("s"), F.lit("p:supplied").alias("p"), F.concat(F.lit("supplier:"), "l_suppkey").alias("o"), F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("round"))


@query(f"WITH {_LINKS} SELECT DISTINCT s, 'p:supplied' AS p, root AS o FROM t JOIN m ON t.o = m.node UNION ALL SELECT node, '{G.OWL}equivalentClass', root FROM m WHERE node <> root")
def integrated_graph(spark, sf):
    return G.integrated(_links(spark, sf).select("s", "p", "o"), _roots(spark, sf))


@query(f"WITH {_LINKS} SELECT root AS iri, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(coalesce(list_sort(list_distinct(list(o) FILTER (o <> root))), []), ',') AS redirected_from, min(round) AS first_seen_round FROM t JOIN m ON t.o = m.node GROUP BY root")
def provenance_of_iris(spark, sf):
    t = G.provenance_map(_links(spark, sf).select(F.col("o").alias("s"), "source", "round"), _roots(spark, sf))
    return t.select("iri", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), F.array_join("redirected_from", ",").alias("redirected_from"), "first_seen_round")


@query("SELECT event_type AS run, count_if(value > 1) = count(*) AS completed, 'x' AS k, CASE WHEN bool_and(count_if(value > 1) = count(*)) OVER () THEN 'owl2dl' ELSE 'owl2rl' END AS instrument, avg((count_if(value > 1) = count(*))::INT::DOUBLE) OVER () AS completion_rate FROM events GROUP BY event_type")
def validation_instrument(spark, sf):
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("run")).agg((F.count_if(F.col("value") > 1) == F.count("*")).alias("completed")).withColumn("has_hook", F.lit(True)).withColumn("k", F.lit("x"))
    return G.campaign_instrument(r).select("run", "completed", "k", "instrument", "completion_rate")


_SCHEMA_ROWS = [("class", "c:Part", "Parts"), ("class", "c:Part2", "part"), ("class", "c:Vendor", "Vendor"), ("object", "p:b", "Supplied By"), ("object", "p:a", "supplied by"), ("data", "p:0", "SuppliedBy"), ("data", "p:price", "Prices")]


@query("SELECT * FROM (VALUES ('class', 'part', 'c:Part', 'Parts', 'a thing'), ('class', 'vendor', 'c:Vendor', 'Vendor', NULL), ('object', 'supplied by', 'p:a', 'supplied by', NULL), ('data', 'price', 'p:price', 'Prices', 'a note')) v(kind, norm, iri, label, definition)")
def schema_entries(spark, sf):
    name = {"class": "Class", "object": "ObjectProperty", "data": "DatatypeProperty"}
    rows = [(i, G.TYPE, G.OWL + name[k]) for k, i, _ in _SCHEMA_ROWS] + [(i, G.LABEL, x) for _, i, x in _SCHEMA_ROWS]
    rows += [("c:Part", K.SKOS_DEFINITION, "a thing"), ("c:Part", G.RDFS + "comment", "a note"), ("p:price", G.RDFS + "comment", "a note")]
    return K.schema_view(spark.createDataFrame(rows, "s string, p string, o string")).select("kind", "norm", "iri", "label", "definition")


def _typed_lines(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    t = li.select(F.concat(F.lit("part:"), "l_partkey").alias("s"), F.lit(G.TYPE).alias("p"), F.when(F.col("l_quantity") > 25, "c:Heavy").otherwise("c:Light").alias("o"))
    return t.union(li.select(F.concat(F.lit("part:"), "l_partkey"), F.lit("p:supplied"), F.concat(F.lit("supplier:"), "l_suppkey")))


@query("SELECT 'part:' || l_partkey AS iri, min(CASE WHEN l_quantity > 25 THEN 'heavy part' ELSE 'light part' END) AS class_label FROM lineitem GROUP BY l_partkey")
def individual_class_labels(spark, sf):
    schema = spark.createDataFrame([("class", "c:Heavy", "heavy part"), ("class", "c:Light", "light part")], "kind string, iri string, label string")
    return B.class_labels(_typed_lines(spark, sf), schema)


@query("SELECT DISTINCT 'part:' || l_partkey AS s, 'p:supplied' AS p, 'supplier:' || l_suppkey AS o FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 2 = 0 UNION SELECT DISTINCT 'part:' || l_partkey, 'type', CASE WHEN l_quantity > 25 THEN 'c:Heavy' ELSE 'c:Light' END FROM lineitem WHERE l_partkey % 3 = 0")
def window_subgraph(spark, sf):
    t = _typed_lines(spark, sf).withColumn("o_kind", F.lit("iri"))
    keep = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("iri")).union(table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("supplier:"), "s_suppkey")))
    return G.window_triples(t, keep, (G.TYPE,)).select("s", F.when(F.col("p") == G.TYPE, "type").otherwise(F.col("p")).alias("p"), "o")


@query("SELECT 'nation:' || n_nationkey AS iri, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'defined ' || n_name END AS definition FROM nation")
def injected_inventory(spark, sf):
    n = table(spark, sf, "nation")
    iri = F.concat(F.lit("nation:"), "n_nationkey")
    t = n.select(iri.alias("s"), F.lit(G.LABEL).alias("p"), F.col("n_name").alias("o")).union(n.where("n_nationkey % 2 = 0").select(iri, F.lit(K.SKOS_DEFINITION), F.concat(F.lit("defined "), "n_name")))
    return B.injection_inventory(t, K.SKOS_DEFINITION, 10_000)


_AB = ("SELECT 'part:' || l_partkey AS s, 'supplier:' || l_suppkey AS o FROM lineitem WHERE l_linenumber % 2 = 0", "SELECT 'part:' || l_partkey AS s, 'supplier:' || l_suppkey AS o FROM lineitem WHERE l_linenumber % 2 = 1")


@query(f"SELECT DISTINCT s, o FROM ({_AB[0]} UNION ALL {_AB[1]})")
def graph_union(spark, sf):
    t = _links(spark, sf)
    return reduce(DataFrame.union, [t.where(F.col("source") % 2 == k).select("s", "o") for k in (0, 1)]).distinct()


_SAME = "'part:' || l_partkey AS s, CASE WHEN l_returnflag = 'R' THEN 'p:price' ELSE 'p:supplied' END AS p, 'supplier:' || l_suppkey AS o"
_HASH = lambda what: f"('0x' || left(md5(key || '|{what}|3'), 8))::BIGINT"


@query(f"""WITH rec AS (SELECT l_orderkey || '-' || l_linenumber AS key, {_SAME}, p_brand AS sc, 'n' || s_nationkey AS oc, l_returnflag = 'R' AS lit,
contains(lower('Part ' || l_partkey || ' from ' || CASE WHEN l_quantity >= 25 THEN 'Supplier ' || l_suppkey ELSE 'stock' END), lower('supplier ' || l_suppkey)) AS sup FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
base AS (SELECT * FROM rec WHERE sup ORDER BY {_HASH('order')}, key LIMIT 500),
ind AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY iri) - 1 AS at, count(*) OVER (PARTITION BY cls) AS n FROM (SELECT 'part:' || p_partkey AS iri, p_brand AS cls FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'n' || s_nationkey FROM supplier)),
t AS (SELECT base.*, sa.iri AS ss, CASE WHEN NOT lit THEN oa.iri END AS os, CASE WHEN lit THEN 'p:weight' ELSE 'p:made' END AS ps FROM base
 JOIN ind si ON si.iri = s LEFT JOIN ind sa ON si.n > 1 AND sa.cls = sc AND sa.at = (si.at + 1 + {_HASH('subject_swap')} % greatest(si.n - 1, 1)) % si.n
 JOIN ind oi ON oi.iri = o LEFT JOIN ind oa ON oi.n > 1 AND oa.cls = oc AND oa.at = (oi.at + 1 + {_HASH('object_swap')} % greatest(oi.n - 1, 1)) % oi.n),
m AS (SELECT *, list_filter(list_concat([(['subject_swap', 'object_swap', 'predicate_swap'])[{_HASH('op')} % 3 + 1]], ['object_swap', 'subject_swap', 'predicate_swap']), lambda x: (x = 'subject_swap' AND ss IS NOT NULL) OR (x = 'object_swap' AND os IS NOT NULL) OR x = 'predicate_swap')[1] AS mutation FROM t)
SELECT key, s, p, o, TRUE AS label, 'none' AS mutation FROM base UNION ALL
SELECT key, CASE WHEN mutation = 'subject_swap' THEN ss ELSE s END, CASE WHEN mutation = 'predicate_swap' THEN ps ELSE p END, CASE WHEN mutation = 'object_swap' THEN os ELSE o END, FALSE, mutation FROM m""")
def mutation_set(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    evidence = F.concat(F.lit("Part "), "l_partkey", F.lit(" from "), F.when(F.col("l_quantity") >= 25, F.concat(F.lit("Supplier "), "l_suppkey")).otherwise("stock"))
    lit = F.col("l_returnflag") == "R"
    rec = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.concat(F.lit("part:"), "l_partkey").alias("s"), F.when(lit, "p:price").otherwise("p:supplied").alias("p"), F.concat(F.lit("supplier:"), "l_suppkey").alias("o"), F.col("p_brand").alias("s_class"),
        F.concat(F.lit("n"), "s_nationkey").alias("o_class"), lit.alias("is_literal"), K.literal_support(evidence, F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit("supplier "), "l_suppkey")).alias("supported"),
    )
    ind = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("iri"), F.col("p_brand").alias("cls")).union(table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    props = spark.createDataFrame([("p:supplied", False), ("p:made", False), ("p:price", True), ("p:weight", True)], "iri string, is_literal boolean")
    return K.mutations(rec, ind, props, seed=3)
