"""Column expressions over text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the suffix rules of head nouns (suffix, replacement, least stem) and
# the words that they leave as they are, the stripped punctuation.
TOKEN = r"[a-z][a-z0-9\-]*[a-z0-9]|[a-z]"
PUNCTUATION = ".,;:!?\"'()[]{}—–"
INVARIANT = ("bus", "gas", "lens", "chassis", "diagnosis", "prognosis", "basis", "axis", "news", "means", "series", "species", "data", "apparatus")
SUFFIXES = (
    ("analyses", "analysis", 0),
    ("hypotheses", "hypothesis", 0),
    ("processes", "process", 0),
    ("statuses", "status", 0),
    ("indices", "index", 0),
    ("matrices", "matrix", 0),
    ("criteria", "criterion", 0),
    ("data", "data", 0),
    ("series", "series", 0),
    ("species", "species", 0),
    ("ies", "y", 2),
    ("sses", "ss", 1),
    ("shes", "sh", 1),
    ("ches", "ch", 1),
    ("xes", "x", 1),
    ("zes", "z", 1),
    ("ves", "f", 2),
    ("ss", "ss", 0),
    ("us", "us", 0),
    ("is", "is", 0),
    ("s", "", 2),
)
STOP = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "as", "by", "at", "it", "from", "be", "are", "was", "or", "an", "this")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def normalise_term(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def chunk_terms(text: Column) -> Column:
    """Words without the punctuation around them, longer than two, each once in order of appearance."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words that neither begin nor end with a stop word (noun-phrase substitute)."""
    return _let(words, lambda w: _ngrams(w, low, high))


def _ngrams(words: Column, low: int, high: int) -> Column:
    # Starts and ends are tested on a word's place, so that only kept runs are built, word by word: a slice copies the whole array.
    open_ = F.transform(words, lambda w: ~w.isin(*STOP))
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - n + 1)
        kept = _let(open_, lambda o: F.filter(places, lambda i: F.element_at(o, i) & F.element_at(o, i + n - 1)))
        return F.when(F.size(words) >= n, F.transform(kept, lambda i: F.concat_ws(" ", *(F.element_at(words, i + k) for k in range(n))))).otherwise(none)

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def split_camel(label: Column) -> Column:
    out = F.regexp_replace(label, "_", " ")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(out, "([a-z0-9])([A-Z])", "$1 $2")


def singularise(word: Column) -> Column:
    return _let(word, _singular)


def _singular(word: Column) -> Column:
    out = F.when((F.length(word) < 3) | word.isin(*INVARIANT), word)
    for suffix, to, stem in SUFFIXES:
        out = out.when(word.endswith(suffix) & (F.length(word) >= len(suffix) + stem), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(to)))
    return out.otherwise(word)


def normalise_label(label: Column) -> Column:
    """CamelCase split, lower case, other signs to blanks, head noun in the singular; null gives an empty text."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(split_camel(F.coalesce(label, F.lit("")))), r"[^0-9a-z\s]", " "), r"\s+", " "))
    head = lambda w: F.array_join(F.concat(F.slice(w, 1, F.size(w) - 1), F.array(singularise(F.element_at(w, -1)))), " ")
    return _let(F.split(flat, " "), head)


def split_alternation(pattern: Column) -> Column:
    """Terms of the groups of a pattern (of the whole pattern if it has none), cleaned, sorted, each once."""
    groups = F.regexp_extract_all(pattern, F.lit(r"\(([^)]+)\)"), F.lit(1))
    body = F.when(F.size(groups) > 0, groups).otherwise(F.array(pattern))
    terms = F.flatten(F.transform(body, lambda g: F.split(g, r"\|")))
    clean = F.transform(terms, lambda t: F.trim(F.lower(F.regexp_replace(t, r"[\^$.*+?\\\[\](){}]", ""))))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


def pattern_terms(pattern: Column) -> Column:
    """The scorer's variant: anchors and brackets off the ends, split on bars, signs deleted, in order."""
    body = F.regexp_replace(pattern, r"^[\^$()]+|[\^$()]+$", "")
    clean = F.transform(F.split(body, r"\|"), lambda t: F.trim(F.regexp_replace(t, r"[\^$.*+?\\\[\](){}]", "")))
    return F.filter(clean, lambda t: t != "")


def widen_pattern(pattern: Column, new: Column) -> Column:
    """New alternatives (lower case, sorted, each once) before the last bracket, or around a pattern without one."""
    more = F.array_join(F.array_sort(F.array_distinct(F.transform(new, F.lower))), "|")
    at = F.length(pattern) - F.instr(F.reverse(pattern), ")") + 1
    wide = F.concat(F.substring(pattern, F.lit(1), at - 1), F.lit("|"), more, F.substring(pattern, at, F.length(pattern)))
    return F.when(more == "", pattern).when(F.instr(pattern, ")") > 0, wide).otherwise(F.concat(F.lit("("), pattern, F.lit("|"), more, F.lit(")")))


def rewrite_label_query(query: Column, prefix: str = "score", iri: str = "urn:scoring#", name: str = "normLabel") -> Column:
    """A label property replaced by the scoring property, with its prefix declared if it is missing."""
    out = F.regexp_replace(query, r"<http://www\.w3\.org/2000/01/rdf-schema#label>|\brdfs:label\b", f"{prefix}:{name}")
    return F.when(out.contains(f"PREFIX {prefix}:"), out).otherwise(F.concat(F.lit(f"PREFIX {prefix}: <{iri}>\n"), out))


def lexical_entailment(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis words over two letters, with repeats, that the premise has; 0 without any."""
    have = F.array_distinct(F.regexp_extract_all(F.lower(premise), F.lit("[a-z0-9]+"), F.lit(0)))
    want = F.filter(F.regexp_extract_all(F.lower(hypothesis), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    hits = _let(have, lambda h: F.size(F.filter(want, lambda w: F.array_contains(h, w))))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(want).cast("double")), F.lit(0.0))


def verbalise(subject: Column, predicate: Column, obj: Column, subject_class: Column, object_class: Column, style: str = "plain") -> Column:
    """A triple as a sentence; classes that are missing are left out."""
    named = lambda x, c: F.when(c.isNull() | (c == ""), x)
    if style == "plain":
        return F.concat(subject, F.lit(" "), predicate, F.lit(" "), obj, F.lit("."))
    if style == "b1":
        s = named(subject, subject_class).otherwise(F.concat(F.lit("The "), subject_class, F.lit(" "), subject))
        o = named(obj, object_class).otherwise(F.concat(F.lit("the "), object_class, F.lit(" "), obj))
        return F.concat(s, F.lit(" "), predicate, F.lit(" "), o, F.lit("."))
    if style == "b2":
        s = named(subject, subject_class).otherwise(F.concat(subject, F.lit(" (a "), subject_class, F.lit(")")))
        o = named(obj, object_class).otherwise(F.concat(obj, F.lit(" (a "), object_class, F.lit(")")))
        return F.concat(s, F.lit(" "), predicate, F.lit(" "), o, F.lit("."))
    raise ValueError(f"unknown style {style!r}")


def triple_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def individual_iri(label: Column, namespace: str = "urn:kg#") -> Column:
    return F.concat(F.lit(namespace + "i_"), F.substring(F.sha1(normalise_label(label)), 1, 16))


def seed(*parts: Column | str) -> Column:
    """The first four bytes of a digest, as a number."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
