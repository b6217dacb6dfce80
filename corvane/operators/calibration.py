"""Competency-question patterns against a corpus and vectors, scoring reports, feedback and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Genres that were dropped, primary question types, and predicates that join no classes.
DROPPED = ("PRC", "CAR", "STR", "ERP", "MES")
PRIMARY = ("relational", "multi-hop", "R", "M")
NO_JOIN = (
    "rdfs:label", "rdf:type", "a", "rdfs:subClassOf", "rdfs:comment", "skos:definition", "skos:prefLabel", "skos:altLabel",
    "<http://www.w3.org/2000/01/rdf-schema#label>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2000/01/rdf-schema#subClassOf>",
)
SEVERITY = ("critical", "important", "minor", "info")


def _slot(keys):
    import numpy as np

    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _holders(wanted: list[bytes], owners: list[list[int]], piece: int = 1 << 20):
    """Batches of (genre, low) to (genre, owners): the owners of the wanted texts that each document holds, each once.

    Each place of a batch is looked up by its next 8, 4 or 2 bytes or 1; where those are a wanted text's, all its bytes are compared.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("genre", pa.string()), ("owners", pa.list_(pa.int32()))])
        sizes, whole, classes = np.array([len(w) for w in wanted]), [np.frombuffer(w, np.uint8) for w in wanted], []
        for n in (8, 4, 2, 1):
            mine = np.array([i for i, w in enumerate(wanted) if n <= len(w) and (n == 8 or len(w) < 2 * n)], np.int64)
            if len(mine):
                keys = np.array([int.from_bytes(wanted[i][:n], "little") for i in mine], np.uint64)
                mark = np.zeros(1 << 16, bool)
                mark[_slot(keys)] = True
                order = np.argsort(keys, kind="stable")
                classes.append((n, mine[order], keys[order], mark))

        def holds(data, ends):
            found, docs = [np.zeros((0, 2), np.int64)], np.arange(len(ends) - 1)
            for o in [o for i, w in enumerate(wanted) if not w for o in owners[i]]:
                found.append(np.stack([docs, np.full(len(docs), o)], 1))
            for left in range(0, len(data), piece):
                some = np.concatenate([data[left : left + piece + 8], np.zeros(8, np.uint8)])
                grams = {1: some.astype(np.uint64)}
                for n in (1, 2, 4):
                    grams[2 * n] = grams[n][:-n] | (grams[n][n:] << np.uint64(8 * n))
                for n, mine, keys, mark in classes:
                    g = grams[n][: min(piece, len(data) - left)]
                    at = np.flatnonzero(mark[_slot(g)])
                    first, last = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
                    for k in range(int((last - first).max(initial=0))):
                        more = first + k < last
                        text, place = mine[(first + k)[more]], at[more] + left
                        doc = np.searchsorted(ends, place, "right") - 1
                        fits = place + sizes[text] <= ends[doc + 1]
                        text, place, doc = text[fits], place[fits], doc[fits]
                        for i in np.unique(text):
                            p, d = place[text == i], doc[text == i]
                            for j in range(n, sizes[i]):
                                same = data[p + j] == whole[i][j]
                                p, d = p[same], d[same]
                            d = np.unique(d)
                            found += [np.stack([d, np.full(len(d), o)], 1) for o in owners[i]]
            return np.unique(np.concatenate(found), axis=0)

        for batch in batches:
            low = batch["low"]
            ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
            data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(low) else np.zeros(0, np.uint8)
            pairs = holds(data, ends - ends[0])
            at = np.searchsorted(pairs[:, 0], np.arange(len(low) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["genre"].cast(pa.string()), pa.ListArray.from_arrays(pa.array(at), pa.array(pairs[:, 1].astype(np.int32)))], schema=schema)

    return run


def pattern_hits(docs: DataFrame, patterns: DataFrame, genres: DataFrame) -> DataFrame:
    """(pattern_id, genre, hits): documents that hold any alternative; genres without hits are there with 0.

    ``patterns`` (pattern_id, alternates) is a hand-written asset, not data: its texts go to all tasks, which search for all of them at once.
    """
    rows = patterns.select("pattern_id", F.transform("alternates", lambda a: F.lower(a).cast("binary")).alias("texts")).collect()
    texts: dict[bytes, list[int]] = {}
    for i, r in enumerate(rows):
        for w in {bytes(w) for w in r["texts"] or [] if w is not None}:
            texts.setdefault(w, []).append(i)
    ids = StructType([StructField("i", IntegerType()), StructField("pattern_id", patterns.schema["pattern_id"].dataType)])
    names = patterns.sparkSession.createDataFrame([(i, r["pattern_id"]) for i, r in enumerate(rows)], ids)
    low = docs.where("text is not null").select("genre", F.lower("text").cast("binary").alias("low"))
    found = low.mapInArrow(_holders(list(texts), list(texts.values())), "genre string, owners array<int>").select("genre", F.explode("owners").alias("i"))
    n = found.groupBy("i", "genre").agg(F.count("*").alias("n")).join(F.broadcast(names), "i").groupBy("pattern_id", "genre").agg(F.sum("n").alias("hits"))
    return patterns.select("pattern_id").crossJoin(F.broadcast(genres)).join(n, ["pattern_id", "genre"], "left").select("pattern_id", "genre", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def zero_hits(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Records none of whose patterns hit; so is one without patterns. ``records`` (cq_id, pattern_ids)."""
    total = hits.groupBy("pattern_id").agg(F.sum("hits").alias("hits"))
    e = records.select("cq_id", F.explode_outer("pattern_ids").alias("pattern_id")).join(total, "pattern_id", "left")
    return e.groupBy("cq_id").agg((F.coalesce(F.max("hits"), F.lit(0)) == 0).alias("zero_hit"))


def greedy_expansions(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """(cq_id, accepted): for each question, in order, the candidates that no term it has already holds or is held by.

    ``candidates`` (cq_id, place, source, term), ``questions`` (cq_id, alternates); an accepted term counts
    for those after it. A fold over one question's candidates.
    """
    t = candidates.groupBy("cq_id").agg(F.array_sort(F.collect_list(F.struct("place", "source", "term"))).alias("c"))
    t = questions.join(t, "cq_id", "left").withColumn("c", F.coalesce("c", F.array().cast(t.schema["c"].dataType)))
    low = lambda x: F.trim(F.lower(x))
    start = F.struct(F.transform("alternates", F.lower).alias("known"), F.array().cast("array<struct<source:string,term:string>>").alias("out"))

    def step(acc, x):
        held = F.exists(acc["known"], lambda y: F.contains(y, low(x["term"])) | F.contains(low(x["term"]), y))
        more = F.struct(F.concat(acc["known"], F.array(low(x["term"]))).alias("known"), F.concat(acc["out"], F.array(F.struct(x["source"].alias("source"), x["term"].alias("term")))).alias("out"))
        return F.when(held, acc).otherwise(more)

    return t.select("cq_id", F.aggregate("c", start, step, lambda acc: acc["out"]).alias("accepted"))


def first_seen(terms: DataFrame) -> DataFrame:
    """The first of each term by (genre, place), terms compared trimmed and in lower case."""
    w = Window.partitionBy(F.lower(F.trim("term"))).orderBy("genre", "place")
    return terms.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def dropped_tags(tags: Column) -> Column:
    return F.array_sort(F.array_intersect(tags, F.array(*map(F.lit, DROPPED))))


def needs_join_review(qtype: Column, n_patterns: Column, query: Column) -> Column:
    """Primary questions with under two patterns, or none of whose triple patterns joins by more than labels and types.

    A variable predicate joins. Comments, filters and strings are taken out before.
    """
    body = F.regexp_replace(query, r"#.*", "")
    body = F.regexp_replace(body, r"(?is)FILTER\s*\(.*?\)\s*(?=[.}\n])", " ")
    body = F.regexp_replace(body, r'"[^"]*"', '""')
    preds = F.regexp_extract_all(body, F.lit(r"\?\w+\s+(\S+)\s+\?\w+"), F.lit(1))
    return qtype.isin(*PRIMARY) & ((n_patterns < 2) | (F.size(F.array_except(preds, F.array(*map(F.lit, NO_JOIN)))) == 0))


def question_problems(questions: DataFrame, strata: tuple[str, ...] = ("existential", "relational", "multi-hop", "definitional")) -> DataFrame:
    """(cq_id, problem): repeated ids, unknown strata, queries that aren't of the subset, terms that aren't normalised.

    ``questions`` (place, cq_id, qtype, sparql, pattern) is a hand-written asset: queries are compiled in the driver.
    """
    from corvane.functions import text as X
    from corvane.plans import sparql

    w = Window.partitionBy("cq_id").orderBy("place")
    t = questions.withColumn("seen", F.row_number().over(w))
    out = t.where("seen > 1").select("cq_id", F.lit("duplicate id").alias("problem"))
    out = out.union(t.where(~F.coalesce(F.col("qtype").isin(*strata), F.lit(False))).select("cq_id", F.concat(F.lit("unknown stratum '"), F.coalesce("qtype", F.lit("")), F.lit("'"))))
    bad = []
    for r in questions.select("cq_id", "place", "sparql").collect():
        try:
            sparql.Parser(r["sparql"] or "", None).parse()
        except sparql.SparqlError:
            bad.append((r["cq_id"], "SPARQL does not parse"))
    if bad:
        out = out.union(questions.sparkSession.createDataFrame(bad, "cq_id string, problem string"))
    term = t.select("cq_id", F.explode(X.pattern_terms(F.col("pattern"))).alias("term")).withColumn("norm", X.normalise_label(F.col("term"))).where(F.col("norm") != F.lower(F.trim("term")))
    out = out.union(term.select("cq_id", F.concat(F.lit("pattern term '"), "term", F.lit("' is not in normalised form ('"), "norm", F.lit("')"))))
    none = questions.agg(F.count_if(F.col("qtype").isin(*PRIMARY)).alias("n")).where("n = 0").select(F.lit("*"), F.lit("no primary-stratum questions in the set"))
    return out.union(none)


def patched_query(query: Column, expansions: Column) -> Column:
    """A query with the first place of each quoted pattern widened; ``expansions`` is an array of (pattern, terms) in order."""
    from corvane.functions import text as X

    def widen(q, e):
        old = F.concat(F.lit('"'), e["pattern"], F.lit('"'))
        at = F.instr(q, old)
        new = F.concat(F.lit('"'), X.widen_pattern(e["pattern"], e["terms"]), F.lit('"'))
        return F.when((at == 0) | (F.size(e["terms"]) == 0), q).otherwise(F.concat(F.substring(q, F.lit(1), at - 1), new, F.substring(q, at + F.length(old), F.length(q))))

    return F.aggregate(expansions, query, widen)


def pitfall_summary(reports: DataFrame, key: str) -> DataFrame:
    """Counts by severity and the distinct codes of each report's pitfalls (code, severity)."""
    p = F.col("pitfalls")
    n = lambda s: F.size(F.filter(p, lambda x: x["severity"] == s))
    return reports.select(key, F.size(p).alias("total_pitfalls"), *[n(s).alias(s) for s in SEVERITY[:3]], F.array_sort(F.array_distinct(F.transform(p, lambda x: x["code"]))).alias("pitfall_codes"))


def split_half(doc_terms: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """Jaccard similarity of the ``k`` most frequent terms of two halves of the documents, dealt by a hash."""
    half = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") % 2
    n = doc_terms.withColumn("half", half).groupBy("half", "term").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("half").orderBy(F.desc("n"), "term"))).where(F.col("r") <= k)
    both = top.groupBy("term").agg(F.count("*").alias("halves"))
    return both.agg(F.count("*").alias("terms"), F.count_if(F.col("halves") == 2).alias("shared")).withColumn("jaccard", F.round(F.try_divide(F.col("shared").cast("double"), F.col("terms").cast("double")), 6))


def reserved_links(links: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The links whose documents are all reserved: those of ``documents`` stay."""
    return links.join(documents.select(key).distinct(), key, "left_semi")


def match_answers(answers: DataFrame, labels: DataFrame, by: str, score, threshold: float) -> DataFrame:
    """Each answer's best label of its question, where ``score(answer, label)`` reaches the threshold."""
    t = answers.join(labels, by).withColumn("score", score(F.col("answer"), F.col("label")))
    best = t.groupBy(by, "answer").agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("b"))
    return best.select(by, "answer", F.when(F.col("b.score") >= threshold, F.col("b.label")).alias("label"), F.col("b.score").alias("score"))


def contamination(rates: DataFrame, condition: str, expected: str, observed: str, limit: float = 0.05) -> DataFrame:
    """Share of unexpected alignments by condition, flagged where it is over the limit."""
    t = rates.groupBy(condition).agg(F.avg((~F.col(expected).eqNullSafe(F.col(observed))).cast("double")).alias("rate"))
    return t.select(condition, F.round("rate", 6).alias("rate"), (F.col("rate") > limit).alias("contaminated"))


def cq_report(results: DataFrame) -> DataFrame:
    """One row. ``results``: cq_id, qtype, primary, answered, raw_answered, error, injection_only. NaN for an empty
    stratum, null for no primary questions."""
    nan = F.lit(float("nan"))
    share = lambda c: F.coalesce(F.avg(F.when(c, F.col("answered").cast("double"))), nan)
    return results.agg(
        F.count("*").alias("questions"), F.coalesce(F.avg(F.col("answered").cast("double")), F.lit(0.0)).alias("overall"), *[share(F.col("qtype") == q).alias(f"stratum_{q}") for q in "ERMD"],
        F.avg(F.when(F.col("primary"), F.col("answered").cast("double"))).alias("primary_share"), F.try_divide(F.count_if(F.col("answered") & ~F.col("raw_answered")).cast("double"), F.count_if("answered").cast("double")).alias("norm_only_share"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("injection_only").alias("injection_only"),
    )


def cq_by_genre(results: DataFrame) -> DataFrame:
    return results.select(F.explode("genre_tags").alias("genre"), "answered").groupBy("genre").agg(F.count("*").alias("n"), F.avg(F.col("answered").cast("double")).alias("share"))


def severity_rank(severity: Column) -> Column:
    out = F
    for i, s in enumerate(SEVERITY):
        out = out.when(severity == s, i)
    return out.otherwise(9)


def capped(defects: DataFrame, section: str, cap: int) -> DataFrame:
    """The first ``cap`` of each section by severity, id and first entity, and how many were left out."""
    w = Window.partitionBy(section)
    r = F.row_number().over(w.orderBy(severity_rank(F.col("severity")), "defect_id"))
    return defects.withColumn("place", r).withColumn("omitted", F.greatest(F.count("*").over(w) - cap, F.lit(0))).where(F.col("place") <= cap)


def render_sections(defects: DataFrame, section: str, cap: int) -> DataFrame:
    """A deterministic block of text for each section."""
    t = capped(defects, section, cap).withColumn("line", F.concat(F.lit("- ["), "severity", F.lit("] "), "defect_id", F.lit(": "), "description"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    tail = F.when(F.max("omitted") > 0, F.concat(F.lit("\n("), F.max("omitted").cast("string"), F.lit(" more omitted)"))).otherwise("")
    return t.groupBy(section).agg(F.concat(F.lit("### "), F.first(section), F.lit("\n"), lines, tail).alias("text"))


def stratified_sample(items: DataFrame, allocation: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """The first of each stratum in a seeded order of hashes, as many as it was allocated."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    t = items.join(F.broadcast(allocation.select(stratum, "allocated")), stratum).withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    return t.where(F.col("place") <= F.col("allocated")).drop("allocated")


def two_samples(docs: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Two disjoint samples of ``n`` whole documents of each stratum."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    return docs.withColumn("place", r).where(F.col("place") <= 2 * n).withColumn("sample", F.when(F.col("place") <= n, "a").otherwise("b")).drop("place")


def saturation(doc_terms: DataFrame, docs: DataFrame, key: str, seed: int, steps: int = 10) -> DataFrame:
    """New terms by step of nested samples: a term counts in the step of its first document in a seeded order.

    The place of a document is its hash's share of the range, so no global sort is needed.
    """
    place = lambda c: F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    step = lambda c: F.least(F.floor(place(c) * steps), F.lit(steps - 1)).cast("int")
    new = doc_terms.withColumn("step", step(F.col(key))).groupBy("term").agg(F.min("step").alias("step")).groupBy("step").agg(F.count("*").alias("new_terms"))
    size = docs.withColumn("step", step(F.col(key))).groupBy("step").agg(F.count("*").alias("documents"))
    w = Window.partitionBy().orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    return size.join(new, "step", "left").select("step", "documents", F.coalesce("new_terms", F.lit(0)).alias("new_terms")).withColumn("cum_documents", F.sum("documents").over(w)).withColumn("cum_terms", F.sum("new_terms").over(w))


def leakage(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a document holds a held-out text; ``held`` is a bounded asset."""
    return docs.select("doc_id", F.lower("text").alias("low")).join(F.broadcast(held.select("item_id", F.lower("text").alias("want"))), F.contains(F.col("low"), F.col("want"))).select("doc_id", "item_id")


def redact(text: Column, found: Column) -> Column:
    """A text with every found string replaced, longest first."""
    order = F.array_sort(F.array_distinct(found), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(order, text, lambda t, x: F.replace(t, x, F.lit("[redacted]")))
