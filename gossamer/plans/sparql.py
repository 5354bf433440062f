"""SPARQL: text to algebra to DataFrame.

SELECT, ASK and CONSTRUCT with OPTIONAL, UNION, FILTER, GRAPH, FROM, DISTINCT, ORDER BY, LIMIT and OFFSET. Solutions
are a set: SELECT gives distinct rows. A type error in a filter is null, which && || and ! treat by three-valued logic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.sources.n3 import SyntaxProblem, unescape
from gossamer.sources.virtual import Solutions, natural_join, union
from gossamer.plans.values import Val, compare, constant
from gossamer.terms import is_var, variables

_TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>"{}|\\^`\x00-\x20]*>)
  | (?P<string>\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<var>[?$]\w+)|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?)|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)
  | (?P<bnode>_:[\w.-]*\w)|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w.-]*[\w-])?|[A-Za-z][\w-]*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/^-])""",
    re.X | re.S,
)


@dataclass
class Query:
    form: str
    variables: list[str] | None
    where: list
    template: list = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SyntaxProblem(f"SPARQL: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i, self.prefixes, self.base, self.n = 0, {}, "", 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i]

    def take(self) -> tuple[str, str]:
        self.i += 1
        return self.tokens[self.i - 1]

    def word(self, *words: str) -> bool:
        for k, w in enumerate(words):
            kind, value = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if kind not in ("name", "op") or value.upper() != w:
                return False
        self.i += len(words)
        return True

    def need(self, w: str) -> None:
        if not self.word(w):
            raise SyntaxProblem(f"SPARQL: expected {w}, not {self.peek()[1] or 'the end'!r}")

    def query(self) -> Query:
        while True:
            if self.word("PREFIX"):
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.take()[1][1:-1]
            elif self.word("BASE"):
                self.base = self.take()[1][1:-1]
            else:
                break
        if self.word("SELECT"):
            self.word("DISTINCT") or self.word("REDUCED")
            names = None
            if not self.word("*"):
                names = []
                while self.peek()[0] == "var":
                    names.append(self.take()[1][1:])
                    self.word(",")
            q = Query("select", names, [])
        elif self.word("ASK"):
            q = Query("ask", None, [])
        elif self.word("CONSTRUCT"):
            q = Query("construct", None, [])
            self.need("{")
            q.template = self.triples()
            self.need("}")
        else:
            raise SyntaxProblem(f"SPARQL: {self.peek()[1]!r} is no query form here")
        while self.word("FROM"):
            named = self.word("NAMED")
            (q.named if named else q.sources).append(self.term()[1:-1])
        self.word("WHERE")
        q.where = self.group()
        if self.word("ORDER", "BY"):
            while True:
                down = self.word("DESC")
                if down or self.word("ASC"):
                    q.order.append((self.bracketed(), down))
                elif self.peek()[0] == "var":
                    q.order.append((("var", self.take()[1][1:]), False))
                elif self.peek()[1] == "(":
                    q.order.append((self.bracketed(), False))
                else:
                    break
        while True:
            if self.word("LIMIT"):
                q.limit = int(self.take()[1])
            elif self.word("OFFSET"):
                q.offset = int(self.take()[1])
            else:
                break
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"SPARQL: {self.peek()[1]!r} after the query")
        return q

    def group(self) -> list:
        self.need("{")
        out: list = []
        while not self.word("}"):
            if self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("FILTER"):
                out.append(("filter", self.bracketed() if self.peek()[1] == "(" else self.primary()))
            elif self.word("GRAPH"):
                out.append(("graph", self.term(), self.group()))
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            elif self.peek()[0] == "end":
                raise SyntaxProblem("SPARQL: a group is not closed")
            else:
                triples = self.triples()
                if out and out[-1][0] == "bgp":
                    out[-1][1].extend(triples)
                else:
                    out.append(("bgp", triples))
            self.word(".")
        return out

    def triples(self) -> list:
        out: list = []
        while self.peek()[1] not in ("}", "{") and self.peek()[0] != "end" and self.peek()[1].upper() not in ("OPTIONAL", "FILTER", "GRAPH"):
            s = self.node(out)
            if self.peek()[1] not in (".", "}"):
                self.properties(s, out)
            if not self.word("."):
                break
        return out

    def properties(self, s, out: list) -> None:
        while True:
            p = T.TYPE if self.peek() == ("name", "a") and self.take() else self.term()
            while True:
                out.append((s, p, self.node(out)))
                if not self.word(","):
                    break
            if not self.word(";"):
                return
            if self.peek()[1] in (".", "}", "]"):
                return

    def node(self, out: list):
        if self.word("["):
            v = self.fresh()
            if not self.word("]"):
                self.properties(v, out)
                self.need("]")
            return v
        if self.word("("):
            items = []
            while not self.word(")"):
                items.append(self.node(out))
            return T.seq("L", items)
        return self.term()

    def fresh(self) -> str:
        self.n += 1
        return f"?__b{self.n}"

    def term(self) -> str:
        kind, value = self.take()
        if kind == "var":
            return "?" + value[1:]
        if kind == "bnode":
            return "?__" + re.sub(r"\W", "_", value[2:])
        if kind == "iri":
            from urllib.parse import urljoin

            return T.iri(urljoin(self.base, value[1:-1]) if self.base else value[1:-1])
        if kind == "number" or value in ("+", "-") and self.peek()[0] == "number":
            sign = ""
            if kind != "number":
                sign, value = value.replace("+", ""), self.take()[1]
            return T.xsd(sign + value, "double" if re.search("[eE]", value) else "decimal" if "." in value else "integer")
        if kind == "string":
            lex = unescape(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.peek()[0] == "lang":
                return T.lit(lex, lang=self.take()[1][1:].lower())
            if self.word("^^"):
                return T.lit(lex, self.term()[1:-1])
            return T.lit(lex)
        if kind == "name" and value.lower() in ("true", "false"):
            return T.xsd(value.lower(), "boolean")
        if kind == "name" and ":" in value:
            p, _, local = value.partition(":")
            if p not in self.prefixes:
                raise SyntaxProblem(f"SPARQL: prefix {p}: is not declared")
            return T.iri(self.prefixes[p] + local)
        raise SyntaxProblem(f"SPARQL: {value!r} is no term")

    # Expressions

    def bracketed(self):
        self.need("(")
        e = self.either()
        self.need(")")
        return e

    def either(self):
        e = self.both()
        while self.word("||"):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.comparison()
        while self.word("&&"):
            e = ("and", e, self.comparison())
        return e

    def comparison(self):
        e = self.sum()
        if self.peek()[0] == "op" and self.peek()[1] in ("=", "!=", "<", "<=", ">", ">="):
            return ("compare", self.take()[1], e, self.sum())
        return e

    def sum(self):
        e = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "op":
            e = ("arith", self.take()[1], e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.peek()[1] in ("*", "/") and self.peek()[0] == "op":
            e = ("arith", self.take()[1], e, self.unary())
        return e

    def unary(self):
        if self.word("!"):
            return ("not", self.unary())
        if self.peek()[1] == "-" and self.tokens[self.i + 1][0] != "number" and self.take():
            return ("arith", "-", ("const", T.xsd(0, "integer")), self.unary())
        return self.primary()

    def primary(self):
        kind, value = self.peek()
        if value == "(":
            return self.bracketed()
        if kind == "var":
            return ("var", self.take()[1][1:])
        if kind == "name" and ":" not in value and value.lower() not in ("true", "false"):
            self.take()
            args = self.arguments()
            return ("call", value.upper(), args)
        t = self.term()
        return ("cast", t, self.arguments()) if t.startswith("<") and self.peek()[1] == "(" else ("const", t)

    def arguments(self) -> list:
        self.need("(")
        args = []
        while not self.word(")"):
            args.append(self.either())
            self.word(",")
        return args


def parse(text: str) -> Query:
    return _Parser(text).query()


def expression_variables(e) -> set[str]:
    if e[0] == "var":
        return {"?" + e[1]}
    return set().union(set(), *(expression_variables(x) for x in e[1:] if isinstance(x, tuple)), *(expression_variables(y) for x in e[1:] if isinstance(x, list) for y in x))


def group_variables(g: list) -> set[str]:
    out: set[str] = set()
    for e in g:
        if e[0] == "bgp":
            out |= set().union(set(), *(variables(t) for p in e[1] for t in p))
        elif e[0] == "filter":
            out |= expression_variables(e[1])
        elif e[0] == "union":
            out |= set().union(*(group_variables(x) for x in e[1]))
        elif e[0] == "graph":
            out |= variables(e[1]) | group_variables(e[2])
        else:
            out |= group_variables(e[1])
    return out


CASTS = {"integer": "decimal(38,0)", "int": "int", "long": "bigint", "decimal": "decimal(38,18)", "double": "double", "float": "float"}


def value(e, get) -> Val:
    """The value of an expression; get(name) is a variable's Val, None where it is nowhere bound."""
    kind = e[0]
    if kind == "var":
        return get(e[1]) or Val(F.lit(None).cast("string"), "term")
    if kind == "const":
        return constant(e[1])
    if kind in ("and", "or", "not", "compare"):
        return Val(condition(e, get), "bool", T.XSD + "boolean")
    if kind == "arith":
        a, b = value(e[2], get).number(), value(e[3], get).number()
        f = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a.cast("double"), b.cast("double"))}[e[1]]
        return Val(f(), "num", T.XSD + "double")
    if kind == "cast":
        target = e[1][1:-1].removeprefix(T.XSD)
        v = value(e[2][0], get)
        if target in CASTS:
            # A cast to an integer type cuts the fraction off.
            n = v.number().cast("double") if v.sort == "num" else v.text().try_cast("double")
            return Val((F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)) if target in ("integer", "int", "long") else n).try_cast(CASTS[target]), "num", e[1][1:-1])
        if target == "string":
            return Val(v.text(), "str")
        if target == "boolean":
            return Val(v.truth(), "bool", e[1][1:-1])
        if target == "dateTime":
            return Val(v.text().try_cast("timestamp_ntz"), "time", e[1][1:-1])
        raise SyntaxProblem(f"SPARQL: no cast to {e[1]}")
    name, args = e[1], e[2]
    if name == "BOUND":
        v = get(args[0][1])
        return Val(v.col.isNotNull() if v else F.lit(False), "bool")
    vals = [value(a, get) for a in args]
    if name == "STR":
        return Val(vals[0].text(), "str")
    if name == "LANG":
        return Val(vals[0].lang(), "str")
    if name == "DATATYPE":
        return Val(vals[0].datatype(), "term")
    if name == "REGEX":
        pattern = F.concat(F.lit("(?" + T.parts(args[2][1])[0] + ")"), vals[1].text()) if len(args) > 2 else vals[1].text()
        return Val(F.regexp_like(vals[0].text(), pattern), "bool")
    if name in ("ISURI", "ISIRI"):
        return Val(vals[0].kind() == "IRI", "bool")
    if name == "ISLITERAL":
        return Val(vals[0].kind() == "LIT", "bool")
    if name == "ISBLANK":
        return Val(vals[0].kind() == "BNODE", "bool")
    if name == "SAMETERM":
        return Val(vals[0].term() == vals[1].term(), "bool")
    if name == "LANGMATCHES":
        tag, wanted = F.lower(vals[0].text()), F.lower(vals[1].text())
        return Val(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))), "bool")
    raise SyntaxProblem(f"SPARQL: no function {name}")


def condition(e, get) -> Column:
    """The effective boolean value of an expression, null at a type error."""
    if e[0] == "and":
        return condition(e[1], get) & condition(e[2], get)
    if e[0] == "or":
        return condition(e[1], get) | condition(e[2], get)
    if e[0] == "not":
        return ~condition(e[1], get)
    if e[0] == "compare":
        return compare(e[1], value(e[2], get), value(e[3], get))
    return value(e, get).truth()


class Compiler:
    """Groups to Solutions over a source with bgp(patterns, needed, graph)."""

    def __init__(self, source, needed: set[str]):
        self.source, self.needed = source, needed

    def unit(self) -> Solutions:
        return Solutions(self.source.spark.range(1).select(), {})

    def group(self, g: list, needed: set[str], graph: str | None = None, filters: bool = True) -> Solutions:
        out: Solutions | None = None
        for k, e in enumerate(g):
            others = needed | group_variables([x for j, x in enumerate(g) if j != k])
            if e[0] == "bgp" and e[1]:
                part = self.source.bgp(e[1], others, graph)
            elif e[0] == "union":
                parts = [self.group(x, others, graph) for x in e[1]]
                part = parts[0]
                for x in parts[1:]:
                    part = union(part, x)
            elif e[0] == "graph":
                part = self.named_graph(e[1], e[2], others)
            elif e[0] == "group":
                part = self.group(e[1], others, graph)
            elif e[0] == "optional":
                inner = [x for x in e[1] if x[0] != "filter"]
                tests = [x[1] for x in e[1] if x[0] == "filter"]
                part = self.group(inner, others | set().union(set(), *map(expression_variables, tests)), graph)

                def holds(get, tests=tests):
                    c = F.lit(True)
                    for t in tests:
                        c = c & condition(t, get)
                    return c

                out = natural_join(out or self.unit(), part, "left", holds if tests else None)
                continue
            else:
                continue
            out = part if out is None else natural_join(out, part)
        out = out or self.unit()
        if filters:
            for e in g:
                if e[0] == "filter":
                    out = Solutions(out.df.where(condition(e[1], lambda v: out.val(v) if v in out else None)), out.sorts, out.maybe)
        return out

    def named_graph(self, name: str, g: list, needed: set[str]) -> Solutions:
        if not is_var(name):
            return self.group(g, needed, name[1:-1])
        graphs = self.source.graphs() if hasattr(self.source, "graphs") else None
        if graphs is None:
            out = self.group(g, needed, name)
            # Terms of graphs are formulas; a named graph is known by its address.
            v = name[1:]
            return Solutions(out.df.withColumn(v, F.regexp_replace(F.col(f"`{v}`"), "^F(.*)$", "<$1>")).where(F.length(v) > 2), out.sorts, out.maybe)
        out = None
        for x in graphs:
            part = self.group(g, needed, x)
            if part.none:
                continue
            part = Solutions(part.df.withColumn(name[1:], F.lit(T.iri(x))), part.sorts | {name[1:]: ("term", None)}, part.maybe)
            out = part if out is None else union(out, part)
        return out if out is not None else Solutions(self.unit().df.where(F.lit(False)), {}, none=True)


def run(source, text: str) -> DataFrame:
    """SELECT: the variables' columns; ASK: one row `result`; CONSTRUCT: s, p, o."""
    q = parse(text)
    names = q.variables
    wanted = {"?" + v for v in names} if names is not None else group_variables(q.where)
    if q.form == "construct":
        wanted = set().union(set(), *(variables(t) for p in q.template for t in p))
    elif q.form == "ask":
        wanted = set()
    wanted |= set().union(set(), *(expression_variables(e) for e, _ in q.order))
    if (q.sources or q.named) and hasattr(source, "restricted"):
        source = source.restricted(q.sources, q.named)
    s = Compiler(source, wanted).group(q.where, wanted)
    if q.form == "ask":
        return s.df.limit(1).agg((F.count("*") > 0).alias("result"))
    if q.form == "construct":
        return construct(s, q.template)
    if names is None:
        names = [v for v in s.sorts if not v.startswith("__")]
    cols = [s.val(v).output().alias(v) if v in s else F.lit(None).cast("string").alias(v) for v in names]
    if not q.order:
        out = s.df.select(*cols).distinct()
    else:
        keys = [value(e, lambda v: s.val(v) if v in s else None) for e, _ in q.order]
        keyed = s.df.select(*cols, *[sort_key(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
        out = keyed.orderBy(*[F.col(f"__k{i}").desc_nulls_last() if down else F.col(f"__k{i}").asc_nulls_first() for i, (_, down) in enumerate(q.order)])
    if q.offset:
        out = out.offset(q.offset)
    if q.limit is not None:
        out = out.limit(q.limit)
    return out.select(*names)


def sort_key(v: Val) -> Column:
    if v.sort != "term":
        return v.output() if v.sort != "time" else v.col
    return F.struct(F.coalesce(v.number(), F.lit(float("-inf"))), v.text(), v.col)


def construct(s: Solutions, template: list) -> DataFrame:
    """The template's triples for each solution, distinct; blank nodes are new in each solution."""
    seed = F.md5(F.concat_ws("\u0001", *[F.coalesce(s.val(v).term(), F.lit("")) for v in s.sorts])) if s.sorts else F.lit("")

    def made(t) -> Column:
        if isinstance(t, T.Seq):
            return T.c_list(F.array(*map(made, t.items)))
        if is_var(t):
            if t[1:] in s:
                return s.val(t[1:]).term()
            return F.concat(F.lit("_:"), F.md5(F.concat(seed, F.lit(t)))) if t.startswith("?__") else F.lit(None).cast("string")
        return F.lit(t)

    rows = F.array(*[F.struct(*[made(t).alias(c) for c, t in zip("spo", p)]) for p in template])
    return s.df.select(F.inline(rows)).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
