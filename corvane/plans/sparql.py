"""A subset of SPARQL compiled to DataFrame joins over a triples frame (s, s_kind, p, o, o_kind).

SELECT with expressions, DISTINCT, basic graph patterns with ``;`` ``,`` and ``a``, FILTER, BIND, EXISTS, the
path ``+``, sub-SELECT, COUNT, GROUP BY and ORDER BY. Anything else is an error. A variable ?x is a
column ``x`` with its value and ``x__k`` with its kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.fixpoint import closure

#: Prefixes that are known without a declaration.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
}
_TOKEN = re.compile(r'#[^\n]*|"(?:[^"\\]|\\.)*"(?:@[\w-]+)?|\'(?:[^\'\\]|\\.)*\'|<[^<>\s]*>|\?\w+|&&|\|\||!=|<=|>=|[{}().;,=<>!+\-*/]|\d+(?:\.\d+)?|[A-Za-z_][\w-]*:[\w.-]*(?<!\.)|:[\w-]+|[A-Za-z_]\w*')


class SparqlError(ValueError):
    pass


@dataclass
class Select:
    items: list  # (name, expression or None)
    group: Group
    distinct: bool = False
    group_by: list[str] = field(default_factory=list)
    order_by: list = field(default_factory=list)


@dataclass
class Group:
    parts: list  # ("triple", s, p, plus, o) | ("filter", e) | ("bind", e, name) | ("select", Select) | ("group", Group)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        rest = _TOKEN.sub("", text)
        if rest.strip():
            raise SparqlError(f"unexpected {rest.strip()[:20]!r}")
        self.words = [w for w in _TOKEN.findall(text) if not w.startswith("#")]
        self.i, self.prefixes = 0, PREFIXES | (prefixes or {})

    def peek(self) -> str:
        return self.words[self.i] if self.i < len(self.words) else ""

    def word(self, *want: str) -> str:
        w = self.peek()
        if not w or want and w.upper() not in want:
            raise SparqlError(f"expected {' or '.join(want) or 'more'} at {w!r}")
        self.i += 1
        return w

    def accept(self, want: str) -> bool:
        if self.peek().upper() == want:
            self.i += 1
            return True
        return False

    def parse(self) -> Select:
        while self.accept("PREFIX"):
            name, iri = self.word(), self.word()
            self.prefixes[name.rstrip(":")] = iri[1:-1]
        out = self.select()
        if self.peek():
            raise SparqlError(f"unexpected {self.peek()!r}")
        return out

    def select(self) -> Select:
        self.word("SELECT")
        distinct, items = self.accept("DISTINCT"), []
        while self.peek().upper() not in ("WHERE", "{"):
            if self.accept("("):
                e = self.expression()
                self.word("AS")
                items.append((self.word()[1:], e))
                self.word(")")
            elif self.accept("*"):
                items.append(("*", None))
            elif self.peek().startswith("?"):
                items.append((self.word()[1:], None))
            else:
                raise SparqlError(f"unexpected {self.peek()!r}")
        self.accept("WHERE")
        out = Select(items, self.group(), distinct)
        if self.accept("GROUP"):
            self.word("BY")
            while self.peek().startswith("?"):
                out.group_by.append(self.word()[1:])
        if self.accept("ORDER"):
            self.word("BY")
            while self.peek().startswith("?") or self.peek().upper() in ("ASC", "DESC"):
                down = self.peek().upper() == "DESC"
                if not self.peek().startswith("?"):
                    self.word()
                    self.word("(")
                    out.order_by.append((self.word()[1:], down))
                    self.word(")")
                else:
                    out.order_by.append((self.word()[1:], False))
        return out

    def group(self) -> Group:
        self.word("{")
        parts = []
        while not self.accept("}"):
            if self.accept("."):
                continue
            if self.accept("FILTER"):
                parts.append(("filter", self.primary() if self.peek() != "(" else self.expression()))
            elif self.accept("BIND"):
                self.word("(")
                e = self.expression()
                self.word("AS")
                parts.append(("bind", e, self.word()[1:]))
                self.word(")")
            elif self.peek() == "{":
                if self.words[self.i + 1].upper() == "SELECT":
                    self.word("{")
                    parts.append(("select", self.select()))
                    self.word("}")
                else:
                    parts.append(("group", self.group()))
            elif self.peek().upper() == "SELECT":
                parts.append(("select", self.select()))
            elif self.peek().upper() in ("OPTIONAL", "UNION", "MINUS", "VALUES", "SERVICE", "GRAPH"):
                raise SparqlError(f"{self.peek()} isn't supported")
            else:
                self.triples(parts)
        return Group(parts)

    def triples(self, parts: list) -> None:
        s = self.term()
        while True:
            p = ("iri", PREFIXES["rdf"] + "type") if self.accept("A") else self.term()
            plus = self.accept("+")
            while True:
                parts.append(("triple", s, p, plus, self.term()))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            if self.peek() in (".", "}"):
                return

    def term(self) -> tuple[str, str]:
        w = self.word()
        if w.startswith("?"):
            return "var", w[1:]
        if w.startswith("<"):
            return "iri", w[1:-1]
        if w[0] in "\"'":
            return "literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), w[1 : w.rindex(w[0])])
        if re.fullmatch(r"\d+(?:\.\d+)?", w):
            return "number", w
        if w.lower() in ("true", "false"):
            return "boolean", w.lower()
        if ":" in w:
            a, _, b = w.partition(":")
            if a not in self.prefixes:
                raise SparqlError(f"unknown prefix {a!r}")
            return "iri", self.prefixes[a] + b
        raise SparqlError(f"unexpected {w!r}")

    LEVELS = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))

    def expression(self, level: int = 0):
        if level == len(self.LEVELS):
            return self.primary()
        left = self.expression(level + 1)
        while self.peek() in self.LEVELS[level]:
            left = (self.word(), left, self.expression(level + 1))
        return left

    def primary(self):
        if self.accept("!"):
            return "!", self.primary()
        if self.accept("("):
            e = self.expression()
            self.word(")")
            return e
        if self.peek().upper() in ("EXISTS", "NOT"):
            no = self.accept("NOT")
            self.word("EXISTS")
            e = ("exists", self.group())
            return ("!", e) if no else e
        if re.fullmatch(r"[A-Za-z]+", self.peek()) and self.i + 1 < len(self.words) and self.words[self.i + 1] == "(":
            name = self.word().upper()
            self.word("(")
            args = []
            distinct = self.accept("DISTINCT")
            while not self.accept(")"):
                args.append(("all",) if self.accept("*") else self.expression())
                self.accept(",")
            return "call", name, args, distinct
        return self.term()


class Evaluator:
    def __init__(self, triples: DataFrame):
        self.t = triples.select("s", "s_kind", "p", "o", "o_kind")
        self.n = 0

    def run(self, q: Select) -> DataFrame:
        df = self.group(q.group)
        aggs = any(e is not None and self.has_count(e) for _, e in q.items)
        if q.group_by or aggs:
            keys = [c for g in q.group_by for c in (g, f"{g}__k")]
            names = {v: e for v, e in q.items if e is not None}
            out = df.groupBy(*keys).agg(*[self.expr(e, df)[0].alias(v) for v, e in names.items()])
            for v in names:
                out = out.withColumn(f"{v}__k", F.lit("literal"))
            df, items = out, [v for v, _ in q.items]
        else:
            items = []
            for v, e in q.items:
                if e is not None:
                    df = self.flags(e, df)
                    col, kind = self.expr(e, df)
                    df = df.withColumn(v, col).withColumn(f"{v}__k", kind)
                if v == "*":
                    items += [c for c in df.columns if not c.endswith("__k") and not c.startswith("_x")]
                elif v not in df.columns:
                    df = df.withColumn(v, F.lit(None).cast("string")).withColumn(f"{v}__k", F.lit(None).cast("string"))
                    items.append(v)
                else:
                    items.append(v)
        if q.order_by:
            df = df.orderBy(*[F.desc(v) if d else F.asc(v) for v, d in q.order_by])
        df = df.select(*[c for v in items for c in (v, f"{v}__k")])
        return df.distinct() if q.distinct else df

    def has_count(self, e) -> bool:
        return isinstance(e, tuple) and (e[:2] == ("call", "COUNT") or any(self.has_count(x) for x in e if isinstance(x, tuple)) or e[0] == "call" and any(self.has_count(x) for x in e[2]))

    def group(self, g: Group) -> DataFrame:
        df = None
        # Filters hold for the whole group; patterns come first.
        for part in [p for p in g.parts if p[0] in ("triple", "select", "group", "bind")]:
            if part[0] == "bind":
                df = self.flags(part[1], df)
                col, kind = self.expr(part[1], df)
                df = df.withColumn(part[2], col).withColumn(f"{part[2]}__k", kind)
                continue
            new = self.triple(*part[1:]) if part[0] == "triple" else self.run(part[1]) if part[0] == "select" else self.group(part[1])
            df = new if df is None else self.join(df, new)
        if df is None:
            raise SparqlError("a group without patterns")
        for part in g.parts:
            if part[0] == "filter":
                df = self.flags(part[1], df)
                df = df.where(F.coalesce(self.expr(part[1], df)[0].cast("boolean"), F.lit(False)))
        return df

    def join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        on = [c for c in a.columns if c in b.columns]
        return a.join(b, on) if on else a.crossJoin(b)

    def triple(self, s, p, plus, o) -> DataFrame:
        t = self.t
        if p[0] == "iri":
            t = t.where(F.col("p") == p[1])
        elif plus:
            raise SparqlError("a path needs a property")
        if plus:
            e = t.where("s_kind <> 'literal' and o_kind <> 'literal'").select(F.struct("s_kind", "s").alias("s"), F.struct(F.col("o_kind").alias("s_kind"), F.col("o").alias("s")).alias("o"))
            t = closure(e).select("s.s", "s.s_kind", F.lit(p[1]).alias("p"), F.col("o.s").alias("o"), F.col("o.s_kind").alias("o_kind"))
        cols: dict[str, list[Column]] = {}
        for (kind, value), v, k in ((s, "s", "s_kind"), (p, "p", None), (o, "o", "o_kind")):
            if kind == "var":
                cols.setdefault(value, []).append((F.col(v), F.col(k) if k else F.lit("iri")))
            elif v != "p":
                t = t.where((F.col(v) == value) & ((F.col(k) == "iri") if kind == "iri" else (F.col(k) == "literal")))
        for same in cols.values():
            for x, kind in same[1:]:
                t = t.where((same[0][0] == x) & (same[0][1] == kind))
        return t.select(*[c for n, x in cols.items() for c in (x[0][0].alias(n), x[0][1].alias(f"{n}__k"))], *([] if cols else [F.lit(1).alias("_x0")])).distinct()

    def flags(self, e, df: DataFrame) -> DataFrame:
        """A column for each EXISTS of an expression: a left join with the distinct shared variables of its group."""
        if isinstance(e, tuple) and e and e[0] == "exists":
            inner = self.group(e[1])
            on = [c for c in inner.columns if c in df.columns]
            self.n += 1
            name = f"_x{self.n}"
            self.names = getattr(self, "names", {}) | {id(e): name}
            inner = inner.select(*on).distinct().withColumn(name, F.lit(True))
            return df.join(inner, on, "left")
        if isinstance(e, (tuple, list)):
            for x in e:
                df = self.flags(x, df)
        return df

    def expr(self, e, df: DataFrame) -> tuple[Column, Column]:
        lit = F.lit("literal")
        op = e[0]
        if op == "var":
            if e[1] not in df.columns:
                return F.lit(None).cast("string"), F.lit(None).cast("string")
            return F.col(e[1]), F.col(f"{e[1]}__k")
        if op in ("literal", "iri"):
            return F.lit(e[1]), F.lit(op)
        if op == "number":
            return F.lit(float(e[1])), lit
        if op == "boolean":
            return F.lit(e[1] == "true"), lit
        if op == "exists":
            return F.coalesce(F.col(self.names[id(e)]), F.lit(False)), lit
        if op == "!":
            return ~self.expr(e[1], df)[0].cast("boolean"), lit
        if op == "call":
            return self.call(e, df), lit if e[1] != "IF" else lit
        a, b = self.expr(e[1], df)[0], self.expr(e[2], df)[0]
        if op in ("&&", "||"):
            return (a.cast("boolean") & b.cast("boolean") if op == "&&" else a.cast("boolean") | b.cast("boolean")), lit
        if op in "+-*/":
            x, y = a.cast("double"), b.cast("double")
            return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op], lit
        if "number" in (e[1][0], e[2][0]):
            a, b = a.cast("double"), b.cast("double")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op], lit

    def call(self, e, df: DataFrame) -> Column:
        _, name, args, distinct = e
        if name == "COUNT":
            if args[0] == ("all",):
                return F.count(F.lit(1))
            x = self.expr(args[0], df)[0]
            return F.countDistinct(x) if distinct else F.count(x)
        got = [self.expr(a, df) for a in args]
        x = [g[0] for g in got]
        match name:
            case "STR":
                return x[0].cast("string")
            case "LCASE":
                return F.lower(x[0])
            case "UCASE":
                return F.upper(x[0])
            case "CONTAINS":
                return F.contains(x[0], x[1])
            case "STRSTARTS":
                return F.startswith(x[0], x[1])
            case "STRENDS":
                return F.endswith(x[0], x[1])
            case "REGEX":
                if args[1][0] != "literal":
                    raise SparqlError("REGEX needs a constant pattern")
                return x[0].rlike(("(?i)" if len(args) > 2 and "i" in args[2][1] else "") + args[1][1])
            case "ISIRI" | "ISURI":
                return got[0][1] == "iri"
            case "ISLITERAL":
                return got[0][1] == "literal"
            case "BOUND":
                return x[0].isNotNull()
            case "IF":
                return F.when(F.coalesce(x[0].cast("boolean"), F.lit(False)), x[1]).otherwise(x[2])
        raise SparqlError(f"{name} isn't supported")


def run(triples: DataFrame, query: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    return Evaluator(triples).run(Parser(query, prefixes).parse())


def values(df: DataFrame) -> DataFrame:
    """Results without the columns of kinds."""
    return df.select(*[c for c in df.columns if not c.endswith("__k")])


def score_questions(triples: DataFrame, questions: list[dict], label: str, injected: tuple[str, ...], norm: str = "urn:scoring#normLabel", raw: str = "urn:scoring#rawLabel") -> list[dict]:
    """Each question's answer on normalised and on raw labels; a row all of whose terms are injected doesn't count.

    The scoring copy of the graph adds both labels to every labelled entity. A query that can't be run is unanswered.
    """
    from corvane.functions.text import normalise_label

    labelled = triples.where(F.col("p") == label)
    more = lambda iri, v: labelled.select("s", "s_kind", F.lit(iri).alias("p"), v.alias("o"), F.lit("literal").alias("o_kind"))
    base = triples.select("s", "s_kind", "p", "o", "o_kind")
    graph = base.union(more(norm, normalise_label(F.col("o")))).union(more(raw, F.col("o"))).distinct().cache()
    out = []
    for q in questions:
        row = {"cq_id": q["cq_id"], "qtype": q["qtype"], "genre_tags": q["genre_tags"], "answered": False, "raw_answered": False, "rows": 0, "injection_only": 0, "error": None}
        for key, prop in (("answered", norm), ("raw_answered", raw)):
            try:
                text = re.sub(r"<http://www\.w3\.org/2000/01/rdf-schema#label>|\brdfs:label\b", f"<{prop}>", q["sparql"])
                got = run(graph, text)
                names = [c for c in got.columns if not c.endswith("__k")]
                iris = F.filter(F.array(*[F.when(F.col(f"{c}__k") == "iri", F.col(c)) for c in names]), lambda x: x.isNotNull())
                own = F.exists(iris, lambda x: ~F.lit(False) if not injected else ~_any(x, injected))
                n = got.select((F.size(iris) == 0).alias("none"), own.alias("own")).agg(F.count_if(F.col("none") | F.col("own")).alias("ok"), F.count_if(~F.col("none") & ~F.col("own")).alias("inj")).first()
                row[key] = n["ok"] > 0
                if key == "answered":
                    row["rows"], row["injection_only"] = n["ok"], n["inj"]
            except (SparqlError, AnalysisException) as e:
                row["error"] = str(e)[:200]
                break
        out.append(row)
    graph.unpersist()
    return out


def _any(x: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out
