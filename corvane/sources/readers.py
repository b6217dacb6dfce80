"""Readers: corpora, IDF tables, triples, question sets, model responses, pitfall reports, logs and checkpoints."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dtype")])
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XML = "http://www.w3.org/XML/1998/namespace"


def background_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {id, url, title, text} of files wiki_*, at any depth; malformed lines are dropped, short texts too."""
    return spark.read.schema("id string, url string, title string, text string").option("mode", "DROPMALFORMED").option("pathGlobFilter", "wiki_*").option("recursiveFileLookup", "true").json(path).where(F.length("text") > 50)


def idf_table(spark: SparkSession, path: str) -> DataFrame:
    """token, idf of a JSON object {"metadata", "idf"}, plain or gzipped."""
    return spark.read.schema("idf map<string,double>").option("multiLine", "true").json(path).select(F.explode("idf").alias("token", "idf"))


def corpus_folder(spark: SparkSession, path: str, genres: dict[str, str] | None = None) -> DataFrame:
    """doc_id, genre, text of the files of a folder; the genre from a map of names or stems, else the parent folder."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,csv,md,json}").text(path).select("value", F.col("_metadata.file_path").alias("f"))
    name = F.element_at(F.split("f", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    if genres is None:
        genre = F.element_at(F.split("f", "/"), -2)
    elif genres:
        m = F.create_map(*(F.lit(x) for kv in genres.items() for x in kv))
        genre = F.coalesce(F.try_element_at(m, name), F.try_element_at(m, stem), F.lit("unknown"))
    else:
        genre = F.lit("unknown")
    return t.select(stem.alias("doc_id"), genre.alias("genre"), F.col("value").alias("text"))


def ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines; comments, blanks and malformed lines are dropped."""
    rx = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\s*\.\s*$'
    g = [F.regexp_extract(F.col(column), rx, k) for k in range(1, 6)]
    kind = lambda x: F.when(x.startswith("<"), "iri").when(x.startswith("_:"), "bnode").otherwise("literal")
    bare = lambda x: F.when(x.startswith("<"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    quoted = F.substring(g[2], F.lit(2), F.length(g[2]) - 2)
    plain = quoted
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    t = lines.where(g[1] != "")
    return t.select(bare(g[0]).alias("s"), kind(g[0]).alias("s_kind"), g[1].alias("p"), F.when(g[2].startswith('"'), plain).otherwise(bare(g[2])).alias("o"), kind(g[2]).alias("o_kind"), F.nullif(g[3], F.lit("")).alias("o_lang"), F.nullif(g[4], F.lit("")).alias("o_dtype"))


def rdf_xml(text: str) -> list[tuple]:
    """Triples of an RDF/XML document: typed nodes, nested nodes, collections, languages, datatypes and entities."""
    out: list[tuple] = []
    fresh = iter(range(1 << 62))
    full = lambda tag: tag[1:].replace("}", "", 1)
    root = ET.fromstring(text)
    base = root.get(f"{{{_XML}}}base") or ""

    def resolve(iri: str) -> str:
        return base + iri if iri.startswith("#") or not iri else iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else base.rsplit("/", 1)[0] + "/" + iri

    def node(e) -> tuple[str, str]:
        if (iri := e.get(f"{{{_RDF}}}about")) is not None:
            who = (resolve(iri), "iri")
        elif (iri := e.get(f"{{{_RDF}}}ID")) is not None:
            who = (base + "#" + iri, "iri")
        elif (name := e.get(f"{{{_RDF}}}nodeID")) is not None:
            who = ("_:" + name, "bnode")
        else:
            who = (f"_:b{next(fresh)}", "bnode")
        if full(e.tag) != _RDF + "Description":
            out.append((*who, _RDF + "type", full(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{_RDF}}}", f"{{{_XML}}}")) and k.startswith("{"):
                out.append((*who, full(k), v, "literal", None, None))
        for c in e:
            prop(who, c, e.get(f"{{{_XML}}}lang"))
        return who

    def prop(who, c, lang) -> None:
        p, lang = full(c.tag), c.get(f"{{{_XML}}}lang") or lang
        if (iri := c.get(f"{{{_RDF}}}resource")) is not None:
            out.append((*who, p, resolve(iri), "iri", None, None))
        elif (name := c.get(f"{{{_RDF}}}nodeID")) is not None:
            out.append((*who, p, "_:" + name, "bnode", None, None))
        elif c.get(f"{{{_RDF}}}parseType") == "Collection":
            members = [node(x) for x in c]
            cells = [(f"_:b{next(fresh)}", "bnode") for _ in members] + [(_RDF + "nil", "iri")]
            out.append((*who, p, *cells[0], None, None))
            for cell, m, rest in zip(cells, members, cells[1:], strict=False):
                out.append((*cell, _RDF + "first", *m, None, None))
                out.append((*cell, _RDF + "rest", *rest, None, None))
        elif c.get(f"{{{_RDF}}}parseType") == "Resource":
            inner = (f"_:b{next(fresh)}", "bnode")
            out.append((*who, p, *inner, None, None))
            for x in c:
                prop(inner, x, lang)
        elif len(c):
            out.append((*who, p, *node(c[0]), None, None))
        else:
            kind = c.get(f"{{{_RDF}}}datatype")
            out.append((*who, p, c.text or "", "literal", None if kind else lang, kind))

    for e in root:
        node(e)
    return out


def turtle(text: str) -> list[tuple]:
    """Triples of a Turtle document without collections: prefixes, ``a``, ``;`` and ``,``, literals, blank nodes."""
    token = re.compile(r'"""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*"|<[^>\s]*>|\^\^|@[A-Za-z-]+|[;,.\[\]]|#[^\n]*|[^\s;,\[\]]+?(?=\.?(?:\s|$)|[;,\[\]])')
    words = [w for w in token.findall(text) if not w.startswith("#")]
    prefixes, out, i, fresh = {}, [], 0, iter(range(1 << 62))

    def term() -> tuple:
        nonlocal i
        w = words[i]
        i += 1
        if w.startswith("<"):
            return w[1:-1], "iri", None, None
        if w == "[":
            name = f"_:b{next(fresh)}"
            if words[i] != "]":
                facts((name, "bnode"), "]")
            i += 1
            return name, "bnode", None, None
        if w.startswith('"'):
            body = w[3:-3] if w.startswith('"""') else w[1:-1]
            body = body.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
            if i < len(words) and words[i].startswith("@"):
                i += 1
                return body, "literal", words[i - 1][1:], None
            if i < len(words) and words[i] == "^^":
                i += 1
                return body, "literal", None, term()[0]
            return body, "literal", None, None
        if w == "a":
            return _RDF + "type", "iri", None, None
        if w.startswith("_:"):
            return w, "bnode", None, None
        if re.fullmatch(r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?|true|false", w):
            kind = "boolean" if w in ("true", "false") else "integer" if re.fullmatch(r"[+-]?\d+", w) else "decimal"
            return w, "literal", None, "http://www.w3.org/2001/XMLSchema#" + kind
        a, _, b = w.partition(":")
        if a not in prefixes:
            raise ValueError(f"unknown prefix {a!r}")
        return prefixes[a] + b, "iri", None, None

    def facts(who, until) -> None:
        nonlocal i
        while i < len(words) and words[i] != until:
            p = term()[0]
            while True:
                o = term()
                out.append((*who, p, *o))
                if i < len(words) and words[i] == ",":
                    i += 1
                    continue
                break
            while i < len(words) and words[i] == ";":
                i += 1

    while i < len(words):
        if words[i] in ("@prefix", "PREFIX", "prefix"):
            prefixes[words[i + 1].rstrip(":")] = words[i + 2][1:-1]
            i += 3 + (i + 3 < len(words) and words[i + 3] == ".")
            continue
        s = term()
        facts((s[0], s[1]), ".")
        i += 1
    return out


def graph_file(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a graph file by its suffix: N-Triples are read by Spark; other forms are small assets, parsed whole."""
    if path.endswith((".nt", ".nt.gz")):
        return ntriples(spark.read.text(path)).distinct()
    text = spark.read.option("wholetext", "true").text(path).first()[0]
    rows = turtle(text) if path.endswith((".ttl", ".n3")) else rdf_xml(text)
    return spark.createDataFrame(sorted(set(rows), key=repr), TRIPLE)


def question_markdown(text: str) -> list[dict]:
    """Questions of a markdown set: id, type, genre tags, text and query of each block."""
    block = re.compile(r"\*\*(CQ-)?([A-Z]{3})-([ERMD])-(\d+)\.?\*\*\s*(?:\[([^\]]*)\])?\s*(.*?)\n```(?:sparql)?\n(.*?)```", re.S)
    return [
        {"cq_id": f"{g}-{q}-{n}", "qtype": q, "genre_tags": [t.strip() for t in tags.split("+")] if tags else [g], "question": " ".join(question.split()), "sparql": body.strip()}
        for _, g, q, n, tags, question, body in block.findall(text)
    ]


def question_json(text: str) -> list[dict]:
    return [{k: x.get(k) for k in ("cq_id", "qtype", "genre_tags", "question", "sparql")} for x in json.loads(text)]


def term_lists(spark: SparkSession, path: str) -> DataFrame:
    """genre, term, score of JSON files, each a list of terms or an object with one; the genre is the file's stem."""
    kind = "array<struct<term:string,score:double>>"
    t = spark.read.option("wholetext", "true").text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1).alias("genre"))
    body = F.coalesce(F.from_json("value", f"struct<terms:{kind}>")["terms"], F.from_json("value", kind))
    return t.select("genre", F.posexplode(body).alias("place", "t")).select("genre", "place", "t.term", "t.score")


def response_lines(responses: DataFrame, column: str = "response") -> DataFrame:
    """Lines of model responses with their five keys and whether each is malformed; fences and prose are skipped."""
    keys = ("subject", "subject_type", "predicate", "object", "evidence")
    kind = ", ".join(f"{k} string" for k in (*keys, "object_type")) + ", _bad string"
    line = responses.select("*", F.explode(F.split(column, "\n")).alias("_line")).withColumn("_line", F.trim("_line")).where(F.col("_line").startswith("{"))
    t = line.withColumn("_j", F.from_json("_line", kind, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    for k in keys:
        bad = bad | F.col(f"_j.{k}").isNull() | (F.col(f"_j.{k}") == "")
    t = t.withColumn("malformed", F.coalesce(bad, F.lit(True)))
    none = F.col("_j.object_type").isNull() | F.lower("_j.object_type").isin("", "null")
    return t.select(*[c for c in responses.columns if c != column], *[F.col(f"_j.{k}").alias(k) for k in keys], F.when(~none, F.col("_j.object_type")).alias("object_type"), none.alias("is_literal"), "malformed")


def pitfalls(text: Column, severities: dict[str, str]) -> Column:
    """Pitfalls of a report as an array of code, severity and affected elements; none of a report that can't be parsed."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<(?:\w+:)?Pitfall>(.*?)</(?:\w+:)?Pitfall>"), F.lit(1))
    tag = lambda b, n: F.trim(F.regexp_extract(b, rf"(?s)<(?:\w+:)?{n}>(.*?)</(?:\w+:)?{n}>", 1))
    m = F.create_map(*(F.lit(x) for kv in severities.items() for x in kv))
    code = lambda b: F.when(tag(b, "Code").rlike(r"^\d+$"), F.concat(F.lit("P"), F.lpad(tag(b, "Code"), 2, "0"))).otherwise(tag(b, "Code"))
    return F.transform(blocks, lambda b: F.struct(code(b).alias("code"), tag(b, "Name").alias("name"), F.coalesce(F.try_element_at(m, code(b)), F.lit("unknown")).alias("severity"), F.regexp_extract_all(b, F.lit(r"(?s)<(?:\w+:)?AffectedElement>(.*?)</(?:\w+:)?AffectedElement>"), F.lit(1)).alias("affected")))


def request_body(ontology: str, pitfall_codes: str = "") -> str:
    """The body of a pitfall-scan request; nothing is sent."""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<OOPSRequest>\n<OntologyUrl></OntologyUrl>\n<OntologyContent><![CDATA[{ontology}]]></OntologyContent>\n<Pitfalls>{pitfall_codes}</Pitfalls>\n<OutputFormat>XML</OutputFormat>\n</OOPSRequest>'


def log_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON records; lines that can't be parsed are kept in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """State rows of run_id=/round= folders."""
    return spark.read.option("basePath", path).parquet(path)
