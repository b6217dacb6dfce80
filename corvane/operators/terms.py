"""Background IDF tables, term inventories and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.plans.fixpoint import stored

MISSING_IDF = 15.0
GENRES, IDF_ROWS = 64, 1_000_000


def background_idf(docs: DataFrame, min_df: int = 5, min_chars: int = 50) -> DataFrame:
    """token, df, idf over texts longer than ``min_chars``; the document count includes those without kept tokens."""
    kept = docs.where(F.length("text") > min_chars)
    total = kept.agg(F.count("*").cast("double").alias("n"))
    df = kept.select(F.explode(X.token_set(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"))


def candidate_terms(docs: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """(doc_id, genre, term): each document's stop-word-bounded runs of words, once."""
    t = docs.select("doc_id", "genre", F.explode(F.array_distinct(X.ngrams(X.tokens(F.col("text")), low, high))).alias("term"))
    return t


def term_frequencies(terms: DataFrame, min_df: int = 2) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_df)


def genre_counts(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, frequency, by_genre): documents of each term, and those in each genre that has any, in one exchange of terms.

    Up to ``GENRES`` genres are counted beside each other; more meet their terms in a second exchange.
    """
    names = [r[0] for r in docs.select("genre").distinct().limit(GENRES + 1).collect()]
    if len(names) > GENRES or not names:
        one = terms.groupBy("term", "genre").agg(F.count("*").alias("df"))
        return one.groupBy("term").agg(F.sum("df").alias("frequency"), F.collect_list(F.struct("genre", "df")).alias("by_genre"))
    at = terms.groupBy("term").agg(*[F.count_if(F.col("genre").eqNullSafe(F.lit(g))).alias(f"n{i}") for i, g in enumerate(names)])
    found = F.filter(F.array(*[F.struct(F.lit(g).cast("string").alias("genre"), F.col(f"n{i}").alias("df")) for i, g in enumerate(names)]), lambda x: x["df"] > 0)
    return at.select("term", reduce(lambda x, y: x + y, [F.col(f"n{i}") for i in range(len(names))]).alias("frequency"), found.alias("by_genre"))


def genre_frequencies(counts: DataFrame) -> DataFrame:
    """Document frequency in the corpus (null genre) and in each genre."""
    every = F.array(F.struct(F.lit(None).cast("string").alias("genre"), F.col("frequency").alias("df")))
    return counts.select("term", F.inline(F.concat(every, "by_genre"))).select("term", "genre", "df")


def length_band(terms: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """Terms of ``low`` to ``high`` words."""
    return terms.where(F.size(F.split("term", " ")).between(low, high))


def c_values(terms: DataFrame) -> DataFrame:
    """C-values. A longer term that holds a term as text, from within a word to within a word, is found by an equi-join.

    What of a longer term a shorter one of k words can be is a piece of k neighbouring words: the ends of the first,
    whole words, and the beginnings of the last. Runs of neighbouring words are counted over all longer terms first;
    of their outer words only those ends that begin a term, and those beginnings that end one, are made.
    """
    w = F.split("term", " ")
    t = terms.select("term", "frequency", F.size(w).alias("words"))
    middle = lambda i, k: F.array_join(F.concat(F.array(F.lit("")), F.slice(w, i + 1, k - 2), F.array(F.lit(""))), " ")
    run = lambda i, k: F.struct(F.element_at(w, i).alias("head"), middle(i, k).alias("middle"), F.element_at(w, i + k - 1).alias("tail"))
    # Filters may be tested in any order, so lengths are kept from going below none.
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.col("words") - 1, F.lit(2))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.col("words") - k + 1, F.lit(1))), lambda i: run(i, k))))
    # A term that a holder has twice counts once: two runs share one only if the letters beside their middles are the same.
    edges = F.transform("runs", lambda r: F.struct(F.right(r["head"], F.lit(1)), r["middle"], F.left(r["tail"], F.lit(1))))
    longer = t.where("words > 2").select("term", F.col("frequency").alias("f"), runs.alias("runs")).withColumn("apart", F.size(F.array_distinct(edges)) == F.size("runs"))
    apart = longer.where("apart").select("f", F.inline("runs")).groupBy("head", "middle", "tail").agg(F.sum("f").alias("held"), F.count("*").alias("holders"))
    apart = apart.select(F.lit(None).cast("string").alias("holder"), "head", "middle", "tail", "held", "holders")
    near = longer.where("not apart").select(F.col("term").alias("holder"), F.inline("runs"), F.col("f").alias("held"), F.lit(1).cast("long").alias("holders"))

    word = t.select(F.posexplode(w).alias("at", "word"), "words").groupBy("word").agg(F.max((F.col("words") > 1) & (F.col("at") == 0)).alias("opens"), F.max((F.col("words") > 1) & (F.col("at") == F.col("words") - 1)).alias("closes"))
    places = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")
    ends = word.select("word", places).select(F.col("word").alias("head"), F.expr("substring(word, i)").alias("end")).join(word.where("opens").select(F.col("word").alias("end")), "end")
    starts = word.select("word", places).select(F.col("word").alias("tail"), F.expr("left(word, i)").alias("start")).join(word.where("closes").select(F.col("word").alias("start")), "start")
    found = apart.union(near).join(ends, "head").join(starts, "tail").select(F.concat("end", "middle", "start").alias("term"), "holder", "held", "holders")
    once = found.groupBy("term", "holder").agg(F.sum("held").alias("all"), F.max("held").alias("one"), F.sum("holders").alias("holders"))
    alone = F.col("holder").isNotNull()
    inside = once.groupBy("term").agg(F.sum(F.when(alone, F.col("one")).otherwise(F.col("all"))).alias("held"), F.sum(F.when(alone, 1).otherwise(F.col("holders"))).alias("holders"))
    base = F.when(F.col("words") > 1, F.log2(F.col("words").cast("double"))).otherwise(1.0)
    return t.join(inside, "term", "left").select("term", "frequency", F.round(base * (F.col("frequency") - F.coalesce(F.col("held") / F.col("holders"), F.lit(0.0))), 6).alias("c_value"))


def term_tfidf(terms: DataFrame, idf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """frequency / documents, times the largest IDF of a term's words. The table of words is broadcast up to ``IDF_ROWS`` rows."""
    words = terms.select("term", "frequency", F.explode(F.split("term", " ")).alias("token"))
    if idf.limit(IDF_ROWS + 1).count() <= IDF_ROWS:
        idf = F.broadcast(idf)
    best = words.join(idf, "token", "left").groupBy("term").agg(F.max(F.coalesce("idf", F.lit(MISSING_IDF))).alias("idf"), F.first("frequency").alias("frequency"))
    return best.crossJoin(F.broadcast(n_docs)).select("term", F.round(F.col("frequency") / F.col("n") * F.col("idf"), 9).alias("tfidf"))


def combined(c: DataFrame, t: DataFrame) -> DataFrame:
    """Half the share of the largest C-value and half that of the largest TF-IDF; a part counts 0 where its largest isn't over 0."""
    both = stored(c.select("term", "c_value").join(t, "term", "full"))
    top = both.agg(F.max("c_value").alias("cm"), F.max("tfidf").alias("tm"))
    part = lambda v, m: F.when(F.col(m) > 0, F.coalesce(F.col(v), F.lit(0.0)) / F.col(m)).otherwise(0.0)
    return both.crossJoin(F.broadcast(top)).select("term", "c_value", "tfidf", F.round(0.5 * part("c_value", "cm") + 0.5 * part("tfidf", "tm"), 6).alias("combined"))


def top_terms(scored: DataFrame, k: int = 500) -> DataFrame:
    """The ``k`` best, with ranks: a bounded sort, then ranks of what is left."""
    best = scored.orderBy(F.desc("combined"), "term").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined"), "term")))


def top_terms_by_genre(scored: DataFrame, counts: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` best of each genre by the corpus-wide score."""
    in_genre = counts.select("term", F.inline("by_genre")).join(scored, "term")
    return in_genre.withColumn("rank", F.row_number().over(Window.partitionBy("genre").orderBy(F.desc("combined"), "term"))).where(F.col("rank") <= k)


def genre_proportions(docs: DataFrame) -> DataFrame:
    t = docs.groupBy("genre").agg(F.count("*").alias("documents"))
    return t.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 4))


def raw_forms(forms: DataFrame) -> DataFrame:
    """Sorted distinct surfaces of each normalised term."""
    return forms.groupBy(X.normalise_term(F.col("form")).alias("term")).agg(F.array_sort(F.collect_set("form")).alias("raw_forms"))


def token_chunks(docs: DataFrame, key: str, order: list[str], size: int, by: str | None = None) -> DataFrame:
    """Fixed-stride chunks of a running token count; a document that lies in two chunks straddles."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = docs.withColumn("end", F.sum("tokens").over(w)).withColumn("begin", F.col("end") - F.col("tokens"))
    first, last = F.floor(F.col("begin") / size), F.floor((F.greatest(F.col("end"), F.col("begin") + 1) - 1) / size)
    return t.select(*([by] if by else []), key, *[c for c in order if c != key], "tokens", first.alias("first_chunk"), last.alias("last_chunk"), (first != last).alias("straddles"))


def extract_assertions(sentences: DataFrame) -> DataFrame:
    """Subject, predicate and object around the first of a few verb forms (substitute for a dependency parse)."""
    m = r"^(.+?)\s+(is|are|has|have|uses|contains|requires|produces)\s+(.+?)[.!?]?$"
    part = lambda k: F.regexp_extract("sentence", m, k)
    t = sentences.select("*", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))
    return t.where("predicate <> ''")
