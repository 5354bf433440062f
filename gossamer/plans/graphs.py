"""Graph: quads with the operations of a formula, and the built-ins that work on whole graphs.

Graph built-ins (includes, notIncludes, semantics, conjunction, conclusion, supports, ...) run after the scans of a
pattern. Those that test are semi or anti joins with the rows of the graph in question; those that make a graph are
evaluated on the driver once for each distinct input - documents and rule sets, not rows of data - and joined back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from urllib.parse import unquote, urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.operators import bgp
from gossamer.plans import rules as R
from gossamer.plans import sparql
from gossamer.sources import n3
from gossamer.sources.virtual import QuadGraph
from gossamer.terms import LOG, Seq, Term, is_var, members, variables

QUADS = R.QUADS
#: The value that stands for an error in a query.
ERROR = T.iri(T.SWAP + "sparqlCwm#error")
DOC_RULES = T.iri(T.SWAP + "pim/doc#rules")


class Session:
    """Documents that have been read, and the Spark session they are read into."""

    def __init__(self, spark: SparkSession, fetch: Callable[[str], str] | None = None):
        self.spark, self.fetch_with = spark, fetch
        self.documents: dict[str, n3.Document] = {}
        self.made: dict[str, list[tuple]] = {}  # quads of graphs made on the driver, by id
        self.formulas: dict[str, n3.Formula] = {}
        self.closures: dict[str, str] = {}

    def fetch(self, uri: str) -> str:
        """Text of a file:, data: or local address; others through `fetch`."""
        if self.fetch_with:
            return self.fetch_with(uri)
        if uri.startswith("data:"):
            return unquote(uri.partition(",")[2])
        path = uri.removeprefix("file://")
        if "://" in path:
            raise OSError(f"{uri} is not local")
        with open(path, encoding="utf-8") as f:
            return f.read()

    def document(self, uri: str, text: str | None = None, syntax: str | None = None) -> n3.Document:
        """A document parsed once; blank nodes and quoted graphs bear a tag of its address."""
        if uri not in self.documents:
            text = self.fetch(uri) if text is None else text
            tag = hashlib.md5(uri.encode()).hexdigest()[:8] + "_"
            if (syntax or sniff(uri, text)) == "rdf":
                from gossamer.sources import rdfxml

                doc = rdfxml.parse(text, uri, tag)
            else:
                doc = n3.parse(text, uri, tag)
            root = n3.Formula([tuple(st) for st in n3.collapsed(doc.root.statements)], doc.root.universals, doc.root.existentials)
            doc.formulas[""] = root
            self.formulas |= {g: f for g, f in doc.formulas.items() if g}
            self.documents[uri] = doc
            self.made |= {g: [(g, *map(n3._flat, st)) for st in f.statements] for g, f in doc.formulas.items() if g}
        return self.documents[uri]

    def graph_of(self, uri: str) -> str:
        """The formula term of a document."""
        doc = self.document(uri)
        gid = "doc_" + hashlib.md5(uri.encode()).hexdigest()[:12]
        if gid not in self.made:
            self.keep(gid, doc.root.statements)
        return "F" + gid

    def keep(self, gid: str, statements: list) -> str:
        statements = list(dict.fromkeys(map(tuple, statements)))
        self.made[gid] = [(gid, *map(n3._flat, st)) for st in statements]
        self.formulas[gid] = n3.Formula([tuple(st) for st in statements])
        return "F" + gid

    def quads(self) -> DataFrame:
        """All graphs made on the driver."""
        return self.spark.createDataFrame([q for qs in self.made.values() for q in qs], QUADS)

    def load(self, *uris: str) -> Graph:
        """The union of documents."""
        docs = [self.document(u) for u in uris]
        rows = [("", *map(n3._flat, st)) for d in docs for st in d.root.statements]
        prefixes: dict[str, str] = {}
        for d in docs:
            prefixes |= d.prefixes
        return Graph(self, self.spark.createDataFrame(list(dict.fromkeys(rows)), QUADS), docs, prefixes)

    def parse(self, text: str, uri: str = "") -> Graph:
        uri = uri or "text:" + hashlib.md5(text.encode()).hexdigest()[:12]
        self.document(uri, text)
        return self.load(uri)


def sniff(uri: str, text: str) -> str:
    """rdf or n3, by the name's end, then by the first characters."""
    if re.search(r"\.(rdf|xml|owl)$", uri):
        return "rdf"
    if re.search(r"\.(n3|ttl|nt)$", uri):
        return "n3"
    head = text.lstrip()[:400]
    return "rdf" if head.startswith("<?xml") or "<rdf:RDF" in head else "n3"


class Graph:
    """An immutable graph: `quads` with g = "" for its own statements. Operations give new graphs or frames."""

    def __init__(self, session: Session, quads: DataFrame, documents: list[n3.Document] | None = None, prefixes: dict[str, str] | None = None):
        self.session, self.quads, self.documents, self.prefixes = session, quads, documents or [], prefixes or {}
        self.spark = session.spark

    def like(self, quads: DataFrame) -> Graph:
        return Graph(self.session, quads, self.documents, self.prefixes)

    @property
    def statements(self) -> DataFrame:
        return self.quads.where("g = ''").select("s", "p", "o")

    @property
    def rules(self) -> list[R.Rule]:
        out = []
        for d in self.documents:
            d.formulas.update({g: f for g, f in self.session.formulas.items() if g not in d.formulas})
            out += R.rules_of(d)
        return out

    # Statements

    def matching(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        df = self.statements
        for c, v in (("s", s), ("p", p), ("o", o)):
            if v is not None:
                df = df.where(F.col(c) == v)
        return df

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.matching(s, p, o).isEmpty()

    def each(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """The values of the one position left open."""
        free = [c for c, v in (("s", s), ("p", p), ("o", o)) if v is None]
        if len(free) != 1:
            raise ValueError("one position is left open")
        return self.matching(s, p, o).select(F.col(free[0]).alias("value")).distinct()

    def any(self, s: str | None = None, p: str | None = None, o: str | None = None) -> str | None:
        """The first of the values in term order."""
        row = self.each(s, p, o).agg(F.min("value")).first()
        return row[0] if row else None

    def the(self, s: str | None = None, p: str | None = None, o: str | None = None) -> str | None:
        """The only value; more than one is an error."""
        rows = self.each(s, p, o).limit(2).collect()
        if len(rows) > 1:
            raise ValueError("more than one value")
        return rows[0].value if rows else None

    def add(self, *statements: tuple[str, str, str]) -> Graph:
        return self.like(self.quads.unionByName(self.spark.createDataFrame([("", *st) for st in statements], QUADS)).distinct())

    def remove(self, *statements: tuple[str, str, str]) -> Graph:
        gone = self.spark.createDataFrame([("", *st) for st in statements], QUADS)
        return self.like(self.quads.join(gone, ["g", "s", "p", "o"], "left_anti"))

    def union(self, other: Graph) -> Graph:
        out = Graph(self.session, self.quads.unionByName(other.quads).distinct(), [*self.documents, *other.documents], self.prefixes | other.prefixes)
        return out

    def subjects(self) -> DataFrame:
        return self.statements.select(F.col("s").alias("value")).distinct()

    def predicates(self) -> DataFrame:
        return self.statements.select(F.col("p").alias("value")).distinct()

    def objects(self) -> DataFrame:
        return self.statements.select(F.col("o").alias("value")).distinct()

    def size(self) -> int:
        return self.statements.distinct().count()

    def namespaces(self) -> DataFrame:
        """(namespace, n): how often addresses of each namespace, up to the last # or /, stand in a statement."""
        uri = F.explode(F.array(*[T.c_uri(F.col(c)) for c in "spo"])).alias("uri")
        space = F.regexp_extract("uri", "^(.*[#/])", 1).alias("namespace")
        return self.statements.select(uri).where("uri IS NOT NULL").select(space).where("namespace != ''").groupBy("namespace").agg(F.count("*").alias("n"))

    def routed(self) -> Graph:
        """The graph with each predicate that has a log:definitiveDocument answered from that document alone."""
        named = self.matching(p=f"<{LOG}definitiveDocument>").select("s", "o").distinct().collect()  # predicates, not data
        quads = self.quads
        for r in named:
            at = self.session.load(T.parts(r.o)[0] if r.o.startswith('"') else r.o[1:-1]).quads
            own = (F.col("g") == "") & (F.col("p") == r.s)
            quads = quads.where(~own).unionByName(at.where(own))
        return self.like(quads)

    def output_strings(self) -> str:
        """The log:outputString texts in order of their keys."""
        rows = self.matching(p=f"<{LOG}outputString>").select(T.c_text(F.col("s")).alias("k"), T.c_lex(F.col("o")).alias("t")).orderBy("k", "t").collect()
        return "".join(r.t for r in rows)

    # Inference and queries

    def all_quads(self) -> DataFrame:
        """The graph's quads beside those of all quoted and derived graphs."""
        return self.quads.unionByName(self.session.quads())

    def think(self, rules: list[R.Rule] | None = None) -> Graph:
        return self.like(meta_think(self, self.rules if rules is None else rules))

    def apply(self, rules: list[R.Rule] | None = None) -> Graph:
        return self.like(R.apply_rules(self.all_quads(), self.rules if rules is None else rules, self.builtins).where("g = ''"))

    def filter(self, rules: list[R.Rule] | None = None) -> Graph:
        return self.like(R.filter_rules(self.all_quads(), self.rules if rules is None else rules, self.builtins))

    def query(self, document: n3.Document) -> Graph:
        """N3QL: subjects with ql:select and ql:where; the conclusions replace the graph."""
        ql = "<http://www.w3.org/2004/ql#{}>".format
        root = document.root.statements
        rules = [R.Rule(R.as_variables(document.formulas[w[1:]]), document.formulas[h[1:]].statements, f"{document.base}#{s}", document.formulas) for s, p, w in root if p == ql("where") for s2, p2, h in root if s2 == s and p2 == ql("select")]
        return self.filter(rules)

    def sparql(self, text: str) -> DataFrame:
        return sparql.run(QuadGraph(self.spark, self.quads), text)

    def includes(self, document: n3.Document, graph: str = "") -> bool:
        pattern = R.as_variables(document.formulas[graph])
        return not bgp.solve(self.spark, pattern, lambda i: self.all_quads(), graph_builtins=self.builtins(self.all_quads(), None)).isEmpty()

    def closure(self, flags: str) -> Graph:
        """Documents that the statements mention, to a fixpoint: s, p, o subjects, predicates, objects; t objects of rdf:type;
        i owl:imports; r doc:rules (objects of log:implies and of rdfs:seeAlso are not followed). E goes on past documents that
        cannot be read. Then T states what formulas of type log:Truth say, n makes addresses normal, e unites what is the
        same."""
        out, seen = self, {d.base for d in self.documents}
        where = [F.col(c) for c in "spo" if c in flags]
        tests = [F.when(F.col("p") == T.TYPE, F.col("o"))] * ("t" in flags) + [F.when(F.col("p") == f"<{T.OWL}imports>", F.col("o"))] * ("i" in flags)
        tests += [F.when(F.col("p") == DOC_RULES, F.col("o"))] * ("r" in flags)
        while where or tests:
            found = out.statements.select(F.explode(F.array(*where, *tests)).alias("t")).where(F.col("t").startswith("<")).select(F.substring_index(T.c_uri(F.col("t")), "#", 1).alias("uri")).distinct()
            fresh = sorted(r.uri for r in found.collect() if r.uri not in seen)
            if not fresh:
                break
            for uri in fresh:
                seen.add(uri)
                try:
                    out = out.union(self.session.load(uri))
                except (OSError, n3.SyntaxProblem):
                    if "E" not in flags:
                        raise
        if "T" in flags:
            true = out.statements.where((F.col("p") == T.TYPE) & (F.col("o") == f"<{LOG}Truth>")).select("s").collect()
            for r in true:
                if r.s[1:] in self.session.formulas:
                    out = out.like(out.quads.unionByName(rows_of(self.session, r.s)).distinct())
        if "n" in flags:
            from gossamer.operators.transforms import normalised

            norm = F.pandas_udf(lambda s: s.map(lambda t: f"<{normalised(t[1:-1])}>" if t.startswith("<") else t), "string")
            out = out.like(out.quads.select("g", *[norm(c).alias(c) for c in "spo"]).distinct())
        if "e" in flags:
            from gossamer.plans.entail import smush

            out = out.like(smush(out.quads))
        return out

    # Graph built-ins

    def builtins(self, quads: DataFrame, rule: R.Rule | None) -> dict[str, bgp.GraphBuiltin]:
        s = self.session

        def patterns(t: Term) -> list:
            f = (rule.formulas if rule else {}).get(t[1:]) or s.formulas[t[1:]]
            return R.as_variables(f)

        def within(df: DataFrame, subj: Term, obj: Term, keep: str, with_builtins: bool = True) -> DataFrame:
            """Join of df with the matches of a pattern in the graphs that subj names."""
            everything = quads.unionByName(s.quads()).distinct()
            pattern = patterns(obj)
            graph = subj if is_var(subj) else subj[1:]
            found = bgp.solve(self.spark, pattern, lambda i: everything, graph, graph_builtins=self.builtins(quads, rule))
            return bgp.join(df, found.distinct(), keep)

        def includes(df, subj, obj):
            return within(df, subj, obj, "inner")

        def not_includes(df, subj, obj):
            return within(df, subj, obj, "left_anti")

        def mapped(f: Callable[[str], str | None]) -> bgp.GraphBuiltin:
            """A function of the subject, evaluated on the driver for each distinct value."""

            def run(df: DataFrame, subj: Term, obj: Term) -> DataFrame:
                if not variables(subj):
                    v = f(subj if isinstance(subj, str) else subj)
                    return bgp.unify(df, F.lit(v), obj) if v is not None else df.where(F.lit(False))
                value = bgp.column(subj)
                pairs = [(r[0], f(r[0])) for r in df.select(value).distinct().toLocalIterator() if r[0] is not None]
                table = self.spark.createDataFrame([p for p in pairs if p[1] is not None], "__in string, __out string")
                joined = df.join(table, value == F.col("__in")).drop("__in")
                return bgp.unify(joined, F.col("__out"), obj).drop("__out")

            return run

        def base() -> str:
            return self.documents[0].base if self.documents else ""

        def semantics(t: str) -> str | None:
            try:
                return s.graph_of(urljoin(base(), t[1:-1]) if t.startswith("<") else "")
            except (OSError, n3.SyntaxProblem):
                return None

        def semantics_or_error(t: str) -> str | None:
            try:
                return s.graph_of(urljoin(base(), t[1:-1]))
            except (OSError, n3.SyntaxProblem) as x:
                return T.lit(str(x))

        def with_imports(t: str) -> str | None:
            todo, seen, out = [t[1:-1]], set(), []
            while todo:
                uri = todo.pop()
                if uri not in seen:
                    seen.add(uri)
                    doc = s.document(urljoin(base(), uri))
                    out += doc.root.statements
                    todo += [o[1:-1] for _, p, o in doc.root.statements if p == f"<{T.OWL}imports>"]
            return s.keep("imports_" + digest(sorted(seen)), out)

        def content(t: str) -> str | None:
            try:
                return T.lit(s.fetch(urljoin(base(), t[1:-1])))
            except OSError:
                return None

        def parsed(t: str) -> str | None:
            try:
                return graph_of_text(s, T.parts(t)[0])
            except (n3.SyntaxProblem, ValueError):
                return None

        def conjunction(t) -> str | None:
            parts = [i for i in (t.items if isinstance(t, Seq) else members(t))]
            if not all(isinstance(p, str) and p.startswith("F") for p in parts):
                return None
            return s.keep("all_" + digest(parts), [st for p in parts for st in s.formulas[p[1:]].statements])

        def conclusion(t: str) -> str | None:
            return closure(self, t)

        def filtered(t) -> str | None:
            a, b = members(t)
            sub = Graph(s, rows_of(s, a), [])
            doc = n3.Document("", s.formulas | {"": s.formulas[b[1:]]}, {})
            rows = R.filter_rules(sub.all_quads(), R.rules_of(doc), sub.builtins).collect()
            return s.keep("filter_" + digest([a, b]), [(r.s, r.p, r.o) for r in rows])

        def supports(df, subj, obj):
            if variables(subj):
                done = mapped(conclusion)(df, subj, "?its_closure")
                return within(done, "?its_closure", obj, "inner").drop("its_closure")
            c = conclusion(subj)
            return within(df, c, obj, "inner") if c else df.where(F.lit(False))

        def entails(df, subj, obj):
            from gossamer.plans.entail import PACK

            def closed(t: str) -> str:
                return closure(self, t, PACK)

            if variables(subj):
                done = mapped(closed)(df, subj, "?its_closure")
                return within(done, "?its_closure", obj, "inner").drop("its_closure")
            return within(df, closed(subj), obj, "inner")

        def justifies(df, subj, obj):
            from gossamer.plans.policy import nested_run

            def run(t: str) -> str | None:
                return nested_run(self, [members(x) if x.startswith("L") else [x] for x in members(t)])

            out = mapped(run)(df, subj, "?its_run")
            return within(out, "?its_run", obj, "inner").drop("its_run")

        def n3_string(t: str) -> str | None:
            from gossamer.sources.n3_writer import formula_text

            return T.lit(formula_text(s.formulas, t[1:], self.prefixes)) if t.startswith("F") else None

        def variables_of(t: str) -> str | None:
            f = s.formulas.get(t[1:])
            if f is None:
                return None
            out = s.keep("vars_" + t[1:], [])
            s.formulas[out[1:]].universals = list(f.universals)
            return out

        def part(k: int):
            return lambda t: T.seq("S", [st[k] for st in s.formulas[t[1:]].statements]) if t[1:] in s.formulas else None

        def triples(t: str) -> str | None:
            f = s.formulas.get(t[1:])
            return None if f is None else T.seq("S", [s.keep("triple_" + digest(list(map(str, st))), [st]) for st in f.statements])

        def universal(df, subj, obj):
            return named(df, subj, obj, "universals")

        def existential(df, subj, obj):
            return named(df, subj, obj, "existentials")

        def named(df, subj, obj, which):
            rows = [("F" + g, T.lit(v)) for g, f in s.formulas.items() for v in getattr(f, which)]
            table = self.spark.createDataFrame(rows, "__f string, __v string")
            joined = df.join(table, bgp.column(subj) == F.col("__f"))
            return bgp.unify(joined, F.col("__v"), obj).drop("__f", "__v").distinct()

        def unique_binding(df, subj, obj):
            """Rows whose object comes with one subject only, and the other way round."""
            a, b = F.col("__a"), F.col("__b")
            pairs = df.select(bgp.column(subj).alias("__a"), bgp.column(obj).alias("__b")).distinct()
            for c in (a, b):
                once = pairs.groupBy(c).agg(F.count("*").alias("__n")).where("__n = 1").select(c)
                df = df.join(once, (bgp.column(subj) if c is a else bgp.column(obj)) == c, "left_semi")
            return df

        def parsed_query(t: str) -> str | None:
            try:
                text = s.fetch(urljoin(base(), t[1:-1]))
                sparql.parse(text)
                return T.lit(text)
            except (OSError, n3.SyntaxProblem):
                return None

        def sub_query(t) -> str | None:
            g, text = members(t)
            df = sparql.run(QuadGraph(self.spark, rows_of(s, g)), T.parts(text)[0])
            if df.columns == ["s", "p", "o"]:
                return s.keep("query_" + digest([g, text]), [(r.s, r.p, r.o) for r in df.collect()])
            from gossamer.sources.results import to_xml

            return T.lit(to_xml(df))

        def endpoint(t) -> str | None:
            from urllib.parse import quote

            address, text = (T.parts(i)[0] if i.startswith('"') else i[1:-1] for i in members(t))
            try:
                return T.lit(s.fetch(f"{address}?query={quote(text)}"))
            except OSError:
                return None

        def document(t: str) -> str | None:
            import xml.etree.ElementTree as ET

            try:
                return T.lit(ET.canonicalize(s.fetch(urljoin(base(), T.parts(t)[0] if t.startswith('"') else t[1:-1]))), T.RDF + "XMLLiteral")
            except (OSError, ET.ParseError):
                return None

        def error_is_true(df, subj, obj):
            """The one-triple test of a formula; what cannot be evaluated counts as true."""
            (a, p, b) = patterns(subj)[0]
            holds = bgp.get(p).test(bgp.arg(a), bgp.arg(b))
            return df.where(F.coalesce(holds, F.lit(True)))

        def error_returner(df, subj, obj):
            """The value of a formula's one function; an error is a value too."""
            (a, p, _) = patterns(subj)[0]
            return bgp.unify(df, F.coalesce(bgp.get(p).fwd(bgp.arg(a)), F.lit(ERROR)), obj)

        log = f"<{LOG}{{}}>".format
        query = f"<{T.SWAP}sparqlCwm#{{}}>".format
        return {
            **{f"<{T.SWAP}set#{n}>": mapped(part(k)) for k, n in enumerate(("subjects", "predicates", "objects"))},
            f"<{T.SWAP}set#triples>": mapped(triples),
            log("includes"): includes,
            log("notIncludes"): not_includes,
            log("notIncludesWithBuiltins"): not_includes,
            log("semantics"): mapped(semantics),
            log("semanticsOrError"): mapped(semantics_or_error),
            log("semanticsWithImportsClosure"): mapped(with_imports),
            log("content"): mapped(content),
            log("parsedAsN3"): mapped(parsed),
            log("n3ExprFor"): mapped(parsed),
            log("conjunction"): mapped(conjunction),
            log("conclusion"): mapped(conclusion),
            log("filter"): mapped(filtered),
            log("supports"): supports,
            log("n3String"): mapped(n3_string),
            log("vars"): mapped(variables_of),
            log("enforceUniqueBinding"): unique_binding,
            log("universalVariableName"): universal,
            log("existentialVariableName"): existential,
            f"<{T.AIR}owlEntails>": entails,
            f"<{T.AIR}justifies>": justifies,
            query("semantics"): mapped(parsed_query),
            query("query"): mapped(sub_query),
            query("queryEndpoint"): mapped(endpoint),
            query("typeErrorIsTrue"): error_is_true,
            query("typeErrorReturner"): error_returner,
            "<http://www.w3.org/2006/xpath-functions#doc>": mapped(document),
        }


def digest(parts: list[str]) -> str:
    return hashlib.md5("\u0001".join(parts).encode()).hexdigest()[:16]


def graph_of_text(s: Session, text: str) -> str:
    uri = "text:" + hashlib.md5(text.encode()).hexdigest()[:12]
    s.document(uri, text, "n3")
    return s.graph_of(uri)


def rows_of(s: Session, formula: str) -> DataFrame:
    """A formula's statements as a graph of their own."""
    return s.spark.createDataFrame([("", *map(n3._flat, st)) for st in s.formulas[formula[1:]].statements], QUADS)


def closure(graph: Graph, t: str, more: list[R.Rule] = ()) -> str:
    """The formula with all that its own rules (and `more`) conclude from it; remembered."""
    s = graph.session
    key = t + digest([r.id for r in more])
    if key not in s.closures:
        doc = n3.Document("", s.formulas | {"": s.formulas[t[1:]]}, {})
        sub = Graph(s, rows_of(s, t), [])
        rows = meta_think(sub, [*R.rules_of(doc), *more]).where("g = ''").collect()
        s.closures[key] = s.keep("closure_" + digest([key]), [(r.s, r.p, r.o) for r in rows])
    return s.closures[key]


def meta_think(graph: Graph, rules: list[R.Rule]) -> DataFrame:
    """The fixpoint, taken up again while the conclusions hold rules that are new."""
    quads = graph.all_quads()
    seen = {r.id for r in rules}
    implied = any(p == T.IMPLIES for r in rules for _, p, _ in r.head)
    while True:
        quads = R.think(quads, rules, graph.builtins)
        if not implied:
            return quads.where("g = ''")
        fresh = derived_rules(quads, seen, graph.session)
        if not fresh:
            return quads.where("g = ''")
        rules = [*rules, *fresh]
        seen |= {r.id for r in fresh}


def derived_rules(quads: DataFrame, seen: set[str], session: Session) -> list[R.Rule]:
    """Rules among the conclusions: rules are collected, not data."""
    found = quads.where((F.col("g") == "") & (F.col("p") == T.IMPLIES)).select("s", "o").distinct().collect()
    out = []
    for r in found:
        rid = f"derived:{r.s}{r.o}"
        if rid in seen or not (r.s.startswith("F") and r.o.startswith("F")):
            continue
        if r.s[1:] in session.formulas and r.o[1:] in session.formulas:
            continue  # stated, not derived
        inner = quads.where(F.col("g").isin(r.s[1:], r.o[1:])).collect()
        formulas = {g: n3.Formula([(q.s, q.p, q.o) for q in inner if q.g == g]) for g in (r.s[1:], r.o[1:])}
        session.formulas.update(formulas)
        out.append(R.Rule(R.as_variables(formulas[r.s[1:]]), formulas[r.o[1:]].statements, rid, session.formulas))
    return out


def local(uri: str) -> str:
    return "file://" + os.path.abspath(uri)
