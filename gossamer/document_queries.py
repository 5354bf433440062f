"""Queries over documents: what the nations and regions say as N3, RDF/XML or query results is written out, read back and
asked with the built-ins that take whole graphs. The documents are small; the rows they are made from are tables."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.plans.graphs import Graph, Session
from gossamer.sources import n3, n3_writer, rdfxml, results

HEAD = "".join(f"@prefix {p}: <{a}> . " for p, a in {"": "urn:x#", "log": T.LOG, "owl": T.OWL, "rdfs": T.RDFS, "air": T.AIR, "string": T.SWAP + "string#", "math": T.SWAP + "math#", "set": T.SWAP + "set#", "sp": T.SWAP + "sparqlCwm#", "fn": "http://www.w3.org/2006/xpath-functions#", "ql": "http://www.w3.org/2004/ql#"}.items()) + "\n"
PREFIX = "PREFIX : <urn:x#> "

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def facts(spark: SparkSession, sf_dir: str) -> str:
    """The nations as N3: 25 rows of text, whatever the scale."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    return HEAD + "".join(f':n{r.n_nationkey} :in :r{r.n_regionkey} ; :name "{r.n_name}" .\n' for r in rows)


def session(spark: SparkSession, sf_dir: str) -> Session:
    """Documents by address: the nations, one that imports them, a query, XML, and an endpoint that answers any query."""
    texts = {
        "t:nations": facts(spark, sf_dir),
        "t:all": HEAD + "<> owl:imports <t:nations> . :r0 :kind :region .",
        "t:query": PREFIX + "SELECT ?n WHERE { ?n :in :r1 }",
        "t:xml": "<a  k='1'><b></b></a>",
    }

    def fetch(uri: str) -> str:
        address, _, query = uri.partition("?query=")
        if query:
            return f"answer to {unquote(query)}"
        if address not in texts:
            raise OSError(f"no {address}")
        return texts[address]

    return Session(spark, fetch)


def told(g: Graph, p: str = "is") -> DataFrame:
    """what :is value, as texts."""
    short = lambda c: F.regexp_replace(F.coalesce(T.c_lex(F.col(c)), F.col(c)), "^<urn:x#(.*)>$", "$1")
    return g.statements.where(F.col("p") == f"<urn:x#{p}>").select(short("s").alias("what"), short("o").alias("value")).distinct()


def asked(name: str, rules: str, sql: str) -> None:
    """A query of rules, each of which says that something :is a value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        s.document("t:rules", HEAD + rules, "n3")
        return told(s.load("t:rules").filter())

    QUERIES[name] = run
    ORACLE[name] = sql


def rows(*parts: tuple[str, str, str]) -> str:
    """SQL of (what, value of a row of nation, condition)."""
    return " UNION ".join(f"SELECT '{what}' AS what, ({value})::VARCHAR AS value FROM nation WHERE {where}" for what, value, where in parts)


NODE = "'n' || n_nationkey"

asked(
    "graph_semantics",
    """{ <t:nations> log:semantics ?f . ?f log:includes { ?n :in :r1 } } => { :semantics :is ?n } .
    { <t:gone> log:semantics ?f } => { :gone :is ?f } .
    { <t:nations> log:semanticsOrError ?f . ?f log:includes { ?n :in :r2 } } => { :or_error :is ?n } .
    { <t:gone> log:semanticsOrError ?e } => { :error :is ?e } .
    { <t:all> log:semanticsWithImportsClosure ?f . ?f log:includes { ?r :kind :region . ?n :in ?r } } => { :imports :is ?n } .
    { <t:all> log:semantics ?f . ?f log:includes { ?n :in ?r } } => { :no_imports :is ?n } .
    { <t:nations> log:content ?t . ?t string:contains ":n24 " } => { :content :is true } .
    { <t:nations> log:content ?t . ?t log:parsedAsN3 ?f . ?f log:includes { ?n :in :r3 } } => { :parsed :is ?n } .
    { <t:nations> log:content ?t . ?t log:n3ExprFor ?f . ?f log:includes { ?n :in :r4 } } => { :expression :is ?n } .
    { "no n3 {" log:parsedAsN3 ?f } => { :no_text :is ?f } .""",
    rows(("semantics", NODE, "n_regionkey = 1"), ("or_error", NODE, "n_regionkey = 2"), ("error", "'no t:gone'", "true"), ("imports", NODE, "n_regionkey = 0"), ("content", "'true'", "true"), ("parsed", NODE, "n_regionkey = 3"), ("expression", NODE, "n_regionkey = 4")),
)

asked(
    "graph_conclusions",
    """{ <t:nations> log:semantics ?f . (?f { { ?n :in ?r } => { ?r :has ?n } }) log:conjunction ?g . ?g log:conclusion ?c . ?c log:includes { :r1 :has ?n } } => { :conclusion :is ?n } .
    { <t:nations> log:semantics ?f . (?f { { ?n :in ?r } => { ?r :has ?n } }) log:conjunction ?g . ?g log:supports { :r0 :has :n0 } } => { :supports :is true } .
    { <t:nations> log:semantics ?f . ?f log:supports { :r0 :has :n0 } } => { :supports_nothing :is true } .
    { <t:nations> log:semantics ?f . (?f { { ?n :in ?r } => { ?r :has ?n } }) log:filter ?c . ?c log:includes { :r2 :has ?n } . ?c log:notIncludes { ?m :in ?q } } => { :filter :is ?n } .
    { <t:nations> log:semantics ?f . ?f log:notIncludesWithBuiltins { ?n :in :r9 } } => { :not_includes :is true } .
    { { :p rdfs:subPropertyOf :in . :x :p :r1 } air:owlEntails { :x :in ?r } } => { :entails :is ?r } .
    { (({ :a :p :b }) ({ :N a air:Policy ; air:rule :N1 . :N1 a air:Belief-rule ; air:if { :a :p ?x } ; air:then [ air:assert { ?x air:compliant-with :N } ] })) air:justifies { ?who air:compliant-with :N } } => { :justifies :is ?who } .""",
    rows(("conclusion", NODE, "n_regionkey = 1"), ("supports", "'true'", "true"), ("filter", NODE, "n_regionkey = 2"), ("not_includes", "'true'", "true"), ("entails", "'r1'", "true"), ("justifies", "'b'", "true")),
)

asked(
    "graph_parts",
    """{ <t:nations> log:semantics ?f . ?f set:subjects ?all . ?n set:in ?all } => { :subject :is ?n } .
    { { :a :p 1 . :b :q 2 } set:predicates ?all . ?p set:in ?all } => { :predicate :is ?p } .
    { { :a :p 1 . :b :q 2 } set:objects ?all . ?o set:in ?all } => { :object :is ?o } .
    { { :a :p 1 . :b :q 2 } set:triples ?all . ?t set:in ?all . ?t log:includes { ?s :q 2 } } => { :triple :is ?s } .
    { { :a :p :b } log:n3String ?t . ?t string:contains ":b" } => { :text :is true } .
    { :k :says ?f . ?f log:universalVariableName "?u" . ?f log:includes { ?s :about ?o } } => { :universal :is ?o } .
    { :k :says ?f . ?f log:universalVariableName ?v } => { :name :is ?v } .
    { :k :says ?f . ?f log:existentialVariableName ?v . ?v string:startsWith "_:" . ?f log:includes { ?s :about ?o } } => { :existential :is ?o } .
    :k :says { @forAll :u . :u :about :universal } , { @forSome :e . :e :about :existential } .
    { :k :says ?f . ?f log:includes { ?s :about :universal } . ?f log:vars ?g . ?g log:notIncludes { ?a :about ?b } } => { :vars :is true } .""",
    rows(("subject", NODE, "true"), ("predicate", "'p'", "true"), ("predicate", "'q'", "true"), ("object", "'1'", "true"), ("object", "'2'", "true"), ("triple", "'b'", "true"), ("text", "'true'", "true"), ("universal", "'universal'", "true"), ("name", "'?u'", "true"), ("existential", "'existential'", "true"), ("vars", "'true'", "true")),
)

asked(
    "graph_queries",
    """{ <t:nations> log:semantics ?f . (?f "PREFIX : <urn:x#> CONSTRUCT { ?r :has ?n } WHERE { ?n :in ?r }") sp:query ?g . ?g log:includes { :r3 :has ?n } } => { :construct :is ?n } .
    { <t:nations> log:semantics ?f . <t:query> sp:semantics ?q . (?f ?q) sp:query ?x . ?x string:contains "urn:x#n24" } => { :select_has_24 :is true } .
    { <t:nations> log:semantics ?f . <t:query> sp:semantics ?q . (?f ?q) sp:query ?x . ?x string:contains "urn:x#n1<" } => { :select_has_1 :is true } .
    { (<t:endpoint> "ASK {}") sp:queryEndpoint ?x } => { :endpoint :is ?x } .
    { { :a :p 5 } log:includes { :a :p ?n } . { ?n sp:lessThan "x" } sp:typeErrorIsTrue true } => { :lenient :is ?n } .
    { { :a :p 5 } log:includes { :a :p ?n } . { ?n sp:lessThan 3 } sp:typeErrorIsTrue true } => { :strict :is ?n } .
    { { :a :p 5 } log:includes { :a :p ?n } . { ?n math:negation ?m } sp:typeErrorReturner ?m } => { :returned :is ?m } .
    { { :a :p "x" } log:includes { :a :p ?n } . { ?n math:negation ?m } sp:typeErrorReturner ?m } => { :returned :is ?m } .
    { <t:xml> fn:doc ?d } => { :document :is ?d } .""",
    rows(("construct", NODE, "n_regionkey = 3"), ("select_has_24", "'true'", "n_nationkey = 24 AND n_regionkey = 1"), ("select_has_1", "'true'", "n_nationkey = 1 AND n_regionkey = 1"), ("endpoint", "'answer to ASK {}'", "true"), ("lenient", "'5'", "true"), ("returned", "'-5'", "true"), ("returned", f"'<{T.SWAP}sparqlCwm#error>'", "true"), ("document", """'<a k="1"><b></b></a>'""", "true")),
)

asked(
    "n3_paths",
    """:a :b :c . :c :d :e .
    { :a!:b :d ?x } => { :forward :is ?x } . { ?x :b :e^:d } => { :backward :is ?x } .""",
    "SELECT 'forward' AS what, 'e' AS value UNION ALL SELECT 'backward', 'a'",
)


asked(
    "list_patterns",
    """{ <t:nations> log:semantics ?f . ?f log:includes { ?n :in :r1 ; :name ?t } } => { ?n :pair (?t "in r1") } .
    :a :list (1 (2 3)) , (4 5) . { :a :list (1 (?x ?y)) } => { :inner :is ?x , ?y } . { :a :list (?x 5) } => { :first :is ?x } . { :a :list (?x ?x) } => { :same :is ?x } .""",
    "SELECT 'inner' AS what, '2' AS value UNION ALL SELECT 'inner', '3' UNION ALL SELECT 'first', '4'",
)

asked(
    "rules_implied_by_truth",
    """log:Truth => { { ?x :p ?y } => { ?x :is ?y } } . :a :p :b . { :c :p :d } => { :never :is :d } .""",
    "SELECT 'a' AS what, 'b' AS value",
)


def document_query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


NATIONS = f"SELECT {NODE} AS what, 'r' || n_regionkey AS value FROM nation"


@document_query("n3_roundtrip", NATIONS)
def n3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    text = n3_writer.graph_text(s.load("t:nations"))
    return told(s.parse(text, "t:again"), "in")


@document_query("rdfxml_roundtrip", NATIONS)
def rdfxml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    text = rdfxml.write([(r.s, r.p, r.o) for r in s.load("t:nations").statements.collect()], {"x": "urn:x#"})
    s.document("t:nations.rdf", text)
    return told(s.load("t:nations.rdf"), "in")


@document_query("results_roundtrip", "SELECT 'db/nation#n_nationkey.' || n_nationkey AS n, n_name AS name, 'db/region#r_regionkey.' || n_regionkey AS r FROM nation")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query put to an endpoint, which answers in XML."""
    from gossamer.plans import sparql
    from gossamer.sources.virtual import VirtualGraph

    text = "PREFIX n: <db/nation#> SELECT ?n ?name ?r WHERE { ?n n:n_name ?name ; n:n_regionkey ?r }"
    plain = sparql.run(VirtualGraph(spark, sf_dir), text)
    xml = results.to_xml(plain)
    got = results.remote(spark, "http://e.org/sparql", text, lambda uri: xml)
    return got.select(*[F.coalesce(T.c_lex(F.col(c)), T.c_uri(F.col(c)), F.col(c)).alias(c) for c in plain.columns])


@document_query("load_and_merge", f"{NATIONS} UNION SELECT 'r0', 'region' FROM nation UNION SELECT 'gone', 'gone' FROM nation WHERE false")
def load_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    g = s.load("t:nations").union(s.load("t:all"))
    return told(g, "in").unionByName(told(g, "kind"))


@document_query("graph_api", "SELECT 'size' AS what, (2 * count(*))::VARCHAR AS value FROM nation UNION ALL SELECT 'subjects', count(*)::VARCHAR FROM nation UNION ALL SELECT 'objects', (count(DISTINCT n_regionkey) + count(DISTINCT n_name))::VARCHAR FROM nation UNION ALL SELECT 'predicates', '2' UNION ALL SELECT 'region of 7', 'r' || n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'in r1', count(*)::VARCHAR FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'has', 'true' UNION ALL SELECT 'has not', 'false' UNION ALL SELECT 'after', (2 * count(*))::VARCHAR FROM nation UNION ALL SELECT 'without', (2 * count(*) - 1)::VARCHAR FROM nation")
def graph_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = session(spark, sf_dir).load("t:nations")
    x = lambda n: f"<urn:x#{n}>"
    region = g.the(s=x("n7"), p=x("in"))
    again = (x("n7"), x("in"), region)
    found = {
        "size": g.size(), "subjects": g.subjects().count(), "objects": g.objects().count(), "predicates": g.predicates().count(),
        "region of 7": region[len("<urn:x#") : -1], "in r1": g.each(p=x("in"), o=x("r1")).count(),
        "has": str(g.any(s=x("n7"), p=x("in")) == region and g.contains(*again)).lower(), "has not": str(g.contains(x("n7"), x("in"), x("r9"))).lower(),
        "after": g.add(again).size(), "without": g.remove(again).size(),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "what string, value string")


@document_query("n3ql", f"SELECT {NODE} AS what, 'r' || n_regionkey AS value FROM nation WHERE n_regionkey > 2")
def n3ql(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    q = n3.parse(HEAD + '[] ql:where { ?n :in ?r . ?r log:uri ?u . ?u string:greaterThan "urn:x#r2" } ; ql:select { ?n :is ?r } .', "t:ql", "ql_")
    return told(s.load("t:nations").query(q))


@document_query("output_strings", "SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS text FROM nation")
def output_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the graph asks to be put out, in the order of their keys."""
    rows_ = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 100).alias("k"), "n_name").collect()
    g = session(spark, sf_dir).parse(HEAD + "".join(f'"{r.k}" log:outputString "{r.n_name}" .\n' for r in rows_))
    return spark.createDataFrame([(g.output_strings(),)], "text string")


FLAGS = ("", "a", "d", "e", "i", "n", "p", "q", "r", "s", "t", "u", "v", "/", "spart")
RDF_FLAGS = ("", "b", "c", "d", "l", "r")


def written_again(spark: SparkSession, sf_dir: str, flags: tuple[str, ...], write: Callable[[Graph, str], str], end: str) -> DataFrame:
    """For every choice of flags, how many nations are read back and the regions that they are in."""
    s, out = session(spark, sf_dir), None
    g = s.load("t:nations")
    for k, f in enumerate(flags):
        uri = f"t:again{k}.{end}"
        s.document(uri, write(g, f))
        one = told(s.load(uri), "in").groupBy(F.lit(f).alias("flags")).agg(F.count("*").alias("nations"), F.count_distinct("value").alias("regions"))
        out = one if out is None else out.unionByName(one)
    return out


def again_sql(flags: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS flags, count(*) AS nations, count(DISTINCT n_regionkey) AS regions FROM nation" for f in flags)


@document_query("n3_flags", again_sql(FLAGS))
def n3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_again(spark, sf_dir, FLAGS, n3_writer.graph_text, "n3")


@document_query("rdfxml_flags", again_sql(RDF_FLAGS))
def rdfxml_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_again(spark, sf_dir, RDF_FLAGS, lambda g, f: rdfxml.write([(r.s, r.p, r.o) for r in g.statements.collect()], {}, f), "rdf")


@document_query("xml_c14n", "SELECT p_partkey AS k, '<r a=\"1\" b=\"' || p_brand || '\"><x>' || p_name || '</x><y></y></r>' AS xml FROM part")
def xml_c14n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.functions.library import canonical_xml

    text = F.concat(F.lit("<r   b='"), "p_brand", F.lit("' a=\"1\"><x >"), "p_name", F.lit("</x><!-- gone --><y/></r>"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), canonical_xml(text).alias("xml"))


@document_query("closure_of_imports", NATIONS)
def closure_of_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(session(spark, sf_dir).load("t:all").closure("i"), "in")


@document_query("isomorphic_graphs", "SELECT true AS renamed, false AS changed")
def isomorphic_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of blank nodes for the regions, the same with other names and in another order, and one link less."""
    from gossamer.operators import transforms

    n = spark.read.parquet(f"{sf_dir}/region.parquet").count()
    ring = lambda name, size: " ".join(f"_:{name(i)} :next _:{name((i + 1) % n)} ." for i in range(size))
    s = session(spark, sf_dir)
    one, two, less = (s.parse(HEAD + ring(name, size), f"t:ring{k}").quads for k, (name, size) in enumerate((("a{}".format, n), (lambda i: f"b{(2 * i + 3) % n:02}", n), ("c{}".format, n - 1))))
    return spark.createDataFrame([(transforms.isomorphic(one, two), transforms.isomorphic(one, less))], "renamed boolean, changed boolean")


@document_query("patches_consolidated", "SELECT 'r' || n_regionkey AS lhs, 'insertion' AS change, string_agg(n_name, ',' ORDER BY n_name) AS rhs FROM nation GROUP BY n_regionkey")
def patches_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gossamer.operators import transforms

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("r"), "n_regionkey").alias("lhs"), F.lit("insertion").alias("change"), F.col("n_name").alias("rhs"))
    return transforms.consolidated(n.unionByName(n)).select("lhs", "change", F.array_join("rhs", ",").alias("rhs"))


@document_query("filter_type_errors", "SELECT 'd1' AS s UNION ALL SELECT 'd2'")
def filter_type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side of an OR that cannot be evaluated does not spoil the other; alone it is neither true nor false."""
    g = session(spark, sf_dir).parse(HEAD + ':d1 :v 5 . :d2 :v "x" . :d3 :v "y" . :d4 :v 7 .')
    got = g.sparql(PREFIX + 'SELECT ?s WHERE { ?s :v ?v FILTER(?v < 6 || ?v = "x") }')
    return got.select(F.regexp_extract("s", "#(.*)>$", 1).alias("s"))


@document_query("definitive_document", f"{NATIONS}")
def definitive_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph itself says of :in is not asked: another document is definitive for it."""
    s = session(spark, sf_dir)
    g = s.parse(HEAD + ":in log:definitiveDocument <t:nations> . :n1 :in :nowhere . :n1 :name 'kept' .", "t:routed")
    return told(g.routed(), "in")


@document_query("unique_binding", "SELECT 'n' || n_nationkey AS what, n_name AS value FROM nation WHERE n_nationkey <> 1")
def unique_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for one nation, of nations that have one name."""
    s = session(spark, sf_dir)
    s.document("t:rules", HEAD + "{ ?n :name ?t . ?n log:enforceUniqueBinding ?t } => { ?n :is ?t } . :n1 :name 'another' .", "n3")
    return told(s.load("t:rules", "t:nations").filter())


@document_query("filter_lang", "SELECT doc_id::VARCHAR AS d, lang FROM documents WHERE lang = 'en'")
def filter_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' languages as tags of literals."""
    from gossamer.plans import sparql
    from gossamer.sources.virtual import QuadGraph

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    quads = d.select(F.lit("").alias("g"), F.concat(F.lit("<urn:d#"), "doc_id", F.lit(">")).alias("s"), F.lit("<urn:d#id>").alias("p"), F.concat(F.lit('"'), "doc_id", F.lit('"@'), "lang").alias("o"))
    got = sparql.run(QuadGraph(spark, quads), "SELECT ?t WHERE { ?x <urn:d#id> ?t FILTER(lang(?t) = 'en') }")
    return got.select(T.c_lex(F.col("t")).alias("d"), T.c_lang(F.col("t")).alias("lang"))


@document_query("owl_sameas_rules", "SELECT 'db/region#r_regionkey.' || r_regionkey AS s, 'db/nation#n_nationkey.' || n_nationkey AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'urn:again' || r_regionkey, 'db/nation#n_nationkey.' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def owl_sameas_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region has a second name; what holds of one name holds of the other."""
    from gossamer.plans import entail

    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    name = lambda c: F.concat(F.lit("<db/region#r_regionkey."), c, F.lit(">"))
    has = n.select(F.lit("").alias("g"), name("n_regionkey").alias("s"), F.lit("<urn:x#has>").alias("p"), F.concat(F.lit("<db/nation#n_nationkey."), "n_nationkey", F.lit(">")).alias("o"))
    same = r.select(F.lit("").alias("g"), name("r_regionkey").alias("s"), F.lit(T.SAME_AS).alias("p"), F.concat(F.lit("<urn:again"), "r_regionkey", F.lit(">")).alias("o"))
    closed = entail.entail(has.unionByName(same)).where("g = '' AND p = '<urn:x#has>'")
    return closed.select(T.c_uri(F.col("s")).alias("s"), T.c_uri(F.col("o")).alias("n")).distinct()
