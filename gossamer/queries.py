"""The engine's queries over the star schema, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.plans import sparql
from gossamer.sources.virtual import VirtualGraph

PREFIXES = "".join(f"PREFIX {p}: <db/{t}#> " for p, t in {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem", "e": "events", "d": "documents", "lab": "labels"}.items()) + "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def sparql_query(name: str, text: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, sf_dir: sparql.run(VirtualGraph(spark, sf_dir), PREFIXES + text))


# Graph patterns

sparql_query("bgp_scan", "SELECT ?o ?total WHERE { ?o o:o_orderstatus 'F' ; o:o_totalprice ?total }", "SELECT 'db/orders#o_orderkey.' || o_orderkey AS o, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F'")
sparql_query("bgp_star", "SELECT ?name ?brand ?size WHERE { ?p p:p_name ?name ; p:p_brand ?brand ; p:p_size ?size }", "SELECT DISTINCT p_name AS name, p_brand AS brand, p_size AS size FROM part")
sparql_query("bgp_chain", "SELECT ?order ?cname ?nname ?rname WHERE { ?order o:o_custkey ?c . ?c c:c_name ?cname ; c:c_nationkey ?n . ?n n:n_name ?nname ; n:n_regionkey ?r . ?r r:r_name ?rname }", "SELECT 'db/orders#o_orderkey.' || o_orderkey AS \"order\", c_name AS cname, n_name AS nname, r_name AS rname FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql_query("bgp_repeated_var", "SELECT ?l ?v WHERE { ?x l:l_orderkey ?l ; l:l_discount ?v ; l:l_tax ?v }", "SELECT DISTINCT 'db/orders#o_orderkey.' || l_orderkey AS l, l_tax AS v FROM lineitem WHERE l_discount = l_tax")
sparql_query("bgp_cartesian", "SELECT ?rname ?nname WHERE { ?r r:r_name ?rname . ?n n:n_name ?nname }", "SELECT r_name AS rname, n_name AS nname FROM region, nation")
sparql_query("bgp_triangle", "SELECT ?cname ?sname WHERE { ?i l:l_orderkey ?o ; l:l_suppkey ?s . ?o o:o_custkey ?c . ?c c:c_nationkey ?n ; c:c_name ?cname . ?s s:s_nationkey ?n ; s:s_name ?sname }", "SELECT DISTINCT c_name AS cname, s_name AS sname FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey")
sparql_query("bgp_constant_subject", "SELECT ?name ?region WHERE { <db/nation#n_nationkey.7> n:n_name ?name ; n:n_regionkey ?region }", "SELECT n_name AS name, 'db/region#r_regionkey.' || n_regionkey AS region FROM nation WHERE n_nationkey = 7")
sparql_query("bgp_variable_predicate", "SELECT ?p ?o WHERE { ?x c:c_custkey 7 ; ?p ?o }", "SELECT * FROM (SELECT unnest(['<db/customer#c_custkey>', '<db/customer#c_name>', '<db/customer#c_nationkey>', '<db/customer#c_acctbal>', '<db/customer#c_mktsegment>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>']) AS p, unnest(['\"7\"^^<http://www.w3.org/2001/XMLSchema#long>', '\"' || c_name || '\"', '<db/nation#n_nationkey.' || c_nationkey || '>', '\"' || c_acctbal || '\"^^<http://www.w3.org/2001/XMLSchema#double>', '\"' || c_mktsegment || '\"', '<db/customer>']) AS o FROM customer WHERE c_custkey = 7)")
sparql_query("bgp_type", "SELECT ?x ?seg WHERE { ?x a <db/customer> ; c:c_mktsegment ?seg }", "SELECT 'db/customer#c_custkey.' || c_custkey AS x, c_mktsegment AS seg FROM customer")
sparql_query("bgp_row_subject", "SELECT ?flag ?status WHERE { ?x l:l_returnflag ?flag . ?x l:l_linestatus ?status }", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem")

# Filters

sparql_query("filter_compare", "SELECT ?c ?bal WHERE { ?c c:c_acctbal ?bal . FILTER(?bal >= 1000.5 && ?bal < 5000) }", "SELECT 'db/customer#c_custkey.' || c_custkey AS c, c_acctbal AS bal FROM customer WHERE c_acctbal >= 1000.5 AND c_acctbal < 5000")
sparql_query("filter_bool", "SELECT ?p ?size ?brand WHERE { ?p p:p_size ?size ; p:p_brand ?brand . FILTER(!(?size > 10) || (?brand = 'Brand#11' && ?size != 20)) }", "SELECT 'db/part#p_partkey.' || p_partkey AS p, p_size AS size, p_brand AS brand FROM part WHERE NOT (p_size > 10) OR (p_brand = 'Brand#11' AND p_size <> 20)")
sparql_query("filter_regex", "SELECT ?p ?t WHERE { ?p p:p_type ?t . FILTER regex(?t, '^[a-p].*e', 'i') }", "SELECT 'db/part#p_partkey.' || p_partkey AS p, p_type AS t FROM part WHERE regexp_matches(p_type, '^[a-p].*e', 'i')")
sparql_query("filter_arith", "SELECT ?price ?disc WHERE { ?x l:l_extendedprice ?price ; l:l_discount ?disc ; l:l_quantity ?q . FILTER(?price * (1 - ?disc) / ?q - 10 > 1500) }", "SELECT DISTINCT l_extendedprice AS price, l_discount AS disc FROM lineitem WHERE l_extendedprice * (1 - l_discount) / l_quantity - 10 > 1500")
sparql_query("filter_time", "SELECT ?o ?p WHERE { ?o o:o_orderdate ?t ; o:o_orderpriority ?p . FILTER(?t >= '1995-01-01T00:00:00'^^xsd:dateTime && ?t < '1996-01-01T00:00:00'^^xsd:dateTime) }", "SELECT 'db/orders#o_orderkey.' || o_orderkey AS o, o_orderpriority AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
sparql_query("filter_terms", "SELECT ?n ?v WHERE { ?n n:n_regionkey ?v ; n:n_name ?name . FILTER(isURI(?v) && isLiteral(?name) && !isBlank(?n) && str(?v) != 'db/region#r_regionkey.1') }", "SELECT 'db/nation#n_nationkey.' || n_nationkey AS n, 'db/region#r_regionkey.' || n_regionkey AS v FROM nation WHERE n_regionkey <> 1")
sparql_query("filter_cast", "SELECT ?c ?bal WHERE { ?c c:c_acctbal ?bal . FILTER(xsd:integer(?bal) = 100 || datatype(?bal) = xsd:integer || xsd:integer(?bal) > 9000) }", "SELECT 'db/customer#c_custkey.' || c_custkey AS c, c_acctbal AS bal FROM customer WHERE trunc(c_acctbal) = 100 OR trunc(c_acctbal) > 9000")

# Optional, union and forms

sparql_query("sparql_optional", "SELECT ?d ?lang ?q WHERE { ?d d:lang ?lang . OPTIONAL { ?x lab:doc_id ?id ; lab:quality ?q . ?d d:doc_id ?id } }", "SELECT 'db/documents#doc_id.' || d.doc_id AS d, lang, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL")
sparql_query("sparql_optional_filter", "SELECT ?c ?o WHERE { ?c c:c_acctbal ?bal . OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?t . FILTER(?t > 100000 && ?bal > 0) } }", "SELECT DISTINCT 'db/customer#c_custkey.' || c_custkey AS c, 'db/orders#o_orderkey.' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 AND c_acctbal > 0")
sparql_query("sparql_not_bound", "SELECT ?d WHERE { ?d d:doc_id ?id . OPTIONAL { ?x lab:doc_id ?id ; lab:quality ?q } FILTER(!bound(?q)) }", "SELECT 'db/documents#doc_id.' || d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
sparql_query("sparql_union", "SELECT ?name ?bal WHERE { { ?c c:c_name ?name ; c:c_acctbal ?bal } UNION { ?s s:s_name ?name } }", "SELECT DISTINCT c_name AS name, c_acctbal AS bal FROM customer UNION SELECT s_name, NULL FROM supplier")
sparql_query("sparql_distinct", "SELECT DISTINCT ?seg WHERE { ?c c:c_mktsegment ?seg }", "SELECT DISTINCT c_mktsegment AS seg FROM customer")
sparql_query("sparql_select_all", "SELECT * WHERE { ?r r:r_name ?name . FILTER(?name > 'B') }", "SELECT 'db/region#r_regionkey.' || r_regionkey AS r, r_name AS name FROM region WHERE r_name > 'B'")
sparql_query("sparql_ask", "ASK { ?o o:o_totalprice ?t . FILTER(?t > 400000) }", "SELECT count(*) > 0 AS result FROM orders WHERE o_totalprice > 400000")
sparql_query("sparql_construct", "CONSTRUCT { ?c <urn:livesIn> ?r . ?r <urn:hasName> ?name } WHERE { ?c c:c_nationkey ?n . ?n n:n_regionkey ?r . ?r r:r_name ?name }", "SELECT '<db/customer#c_custkey.' || c_custkey || '>' AS s, '<urn:livesIn>' AS p, '<db/region#r_regionkey.' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT '<db/region#r_regionkey.' || r_regionkey || '>', '<urn:hasName>', '\"' || r_name || '\"' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
sparql_query("sparql_graph_tables", "SELECT ?g ?name WHERE { GRAPH ?g { ?x n:n_name ?name } } ", "SELECT '<db/nation>' AS g, n_name AS name FROM nation")
sparql_query("sparql_from", "SELECT ?name ?c FROM <db/nation> FROM <db/customer> WHERE { ?n n:n_name ?name OPTIONAL { ?c c:c_nationkey ?n } OPTIONAL { ?s s:s_nationkey ?n . ?s s:s_name ?c2 } FILTER(!bound(?s)) }", "SELECT DISTINCT n_name AS name, 'db/customer#c_custkey.' || c_custkey AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
sparql_query("sparql_order_limit", "SELECT ?o ?t WHERE { ?o o:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20", "SELECT 'db/orders#o_orderkey.' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 20")
sparql_query("sparql_offset", "SELECT ?n WHERE { ?x n:n_name ?n } ORDER BY ?n OFFSET 5 LIMIT 10", "SELECT DISTINCT n_name AS n FROM nation ORDER BY n LIMIT 10 OFFSET 5")

sparql_query(
    "flagship",
    "SELECT ?cname ?rname WHERE { ?c c:c_name ?cname ; c:c_nationkey ?n ; c:c_acctbal ?bal . ?n n:n_regionkey ?r . ?r r:r_name ?rname . FILTER(?bal > 5000) }",
    "SELECT DISTINCT c_name AS cname, r_name AS rname FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000",
)
FLAGSHIP = QUERIES["flagship"]


# Rules

from functools import reduce  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from gossamer import terms as T  # noqa: E402
from gossamer.functions.registry import Arg, get  # noqa: E402
from gossamer.operators import transforms  # noqa: E402
from gossamer.plans import entail, proof, tms  # noqa: E402
from gossamer.plans import rules as R  # noqa: E402
from gossamer.plans.graphs import Graph, Session  # noqa: E402
from gossamer.plans.policy import run_policy  # noqa: E402
from gossamer.sources import n3, ntriples  # noqa: E402
from gossamer.tables import new_path, written  # noqa: E402

N3_PREFIXES = "".join(f"@prefix {p}: <db/{t}#> . " for p, t in {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem"}.items()) + f"@prefix : <urn:x#> . @prefix log: <{T.LOG}> . @prefix math: <{T.SWAP}math#> . @prefix string: <{T.SWAP}string#> . @prefix list: <{T.SWAP}list#> . @prefix air: <{T.AIR}> . @prefix rdfs: <{T.RDFS}> . @prefix owl: <{T.OWL}> . @prefix diff: <{T.DIFF}> .\n"


def quads_of(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The tables' triples as one graph."""
    v = VirtualGraph(spark, sf_dir)
    return reduce(DataFrame.unionByName, (v.triples(t) for t in tables)).select(F.lit("").alias("g"), "s", "p", "o")


def rules_in(text: str) -> list[R.Rule]:
    return R.rules_of(n3.parse(N3_PREFIXES + text, "urn:rules"))


def facts_in(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(n3.parse(N3_PREFIXES + text, "urn:facts", "f").quads(), R.QUADS).where("g = ''")


def x(local: str) -> str:
    return f"<urn:x#{local}>"


def pairs_of(quads: DataFrame, p: str) -> DataFrame:
    return quads.where((F.col("g") == "") & (F.col("p") == p)).select("s", "o").distinct()


def subject(table: str, key: str, column: str | None = None) -> str:
    """SQL of a row's subject."""
    return f"'<db/{table}#{key}.' || {column or key} || '>'"


IN_REGION = "{?c c:c_nationkey ?n . ?n n:n_regionkey ?r} => {?c :inRegion ?r} ."
IN_REGION_SQL = f"SELECT {subject('customer', 'c_custkey')} AS s, {subject('region', 'r_regionkey', 'n_regionkey')} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("rule_once", IN_REGION_SQL)
def rule_once(spark, sf_dir):
    return pairs_of(R.apply_rules(quads_of(spark, sf_dir, "customer", "nation"), rules_in(IN_REGION)), x("inRegion"))


@query("rule_filter", IN_REGION_SQL.replace("SELECT ", "SELECT '<urn:x#inRegion>' AS p, ", 1))
def rule_filter(spark, sf_dir):
    return R.filter_rules(quads_of(spark, sf_dir, "customer", "nation"), rules_in(IN_REGION)).select("s", "p", "o")


PART_OF = "{?a c:c_nationkey ?b} => {?a :partOf ?b} . {?a n:n_regionkey ?b} => {?a :partOf ?b} . {?a :partOf ?b . ?b :partOf ?c} => {?a :partOf ?c} ."


@query("rule_think_transitive", f"WITH RECURSIVE e AS (SELECT {subject('customer', 'c_custkey')} AS s, {subject('nation', 'n_nationkey', 'c_nationkey')} AS o FROM customer UNION SELECT {subject('nation', 'n_nationkey')}, {subject('region', 'r_regionkey', 'n_regionkey')} FROM nation), t AS (SELECT * FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o = e.s) SELECT s, o FROM t")
def rule_think_transitive(spark, sf_dir):
    return pairs_of(R.think(quads_of(spark, sf_dir, "customer", "nation"), rules_in(PART_OF)), x("partOf"))


SIZES = "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, p_size + 1 AS b FROM part WHERE p_size + 1 IN (SELECT p_size FROM part))"


def size_chain(spark, sf_dir):
    """size :next size + 1, for the sizes that parts have."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("a")).distinct()
    chain = sizes.join(sizes.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    node = lambda c: F.concat(F.lit("<urn:x#size"), F.col(c).cast("string"), F.lit(">"))
    return chain.select(F.lit("").alias("g"), node("a").alias("s"), F.lit(x("next")).alias("p"), node("b").alias("o"))


REACH = "{?a :next ?b} => {?a :reach ?b} . {?a :next ?b . ?b :reach ?c} => {?a :reach ?c} ."


@query("rule_recursion", SIZES + ", t AS (SELECT * FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT '<urn:x#size' || a || '>' AS s, '<urn:x#size' || b || '>' AS o FROM t")
def rule_recursion(spark, sf_dir):
    return pairs_of(R.think(size_chain(spark, sf_dir), rules_in("{?a :reach ?b . ?b :reach ?c} => {?a :reach ?c} . {?a :next ?b} => {?a :reach ?b} .")), x("reach"))


@query("rule_scc_mutual", f"SELECT {subject('nation', 'n_nationkey')} AS s, CASE n_nationkey % 2 WHEN 0 THEN '\"even\"' ELSE '\"odd\"' END AS o FROM nation")
def rule_scc_mutual(spark, sf_dir):
    """Even and odd nations by two rules that feed each other, along the chain of keys."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    node = lambda c: F.concat(F.lit("<db/nation#n_nationkey."), c.cast("string"), F.lit(">"))
    chain = n.join(n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_nationkey").alias("next")), F.col("n_nationkey") == F.col("k"))
    chain = chain.select(F.lit("").alias("g"), node(F.col("k")).alias("s"), F.lit(x("next")).alias("p"), node(F.col("next")).alias("o"))
    first = n.agg(F.min("n_nationkey").alias("k")).select(F.lit("").alias("g"), node(F.col("k")).alias("s"), F.lit(x("is")).alias("p"), F.lit('"even"').alias("o"))
    rules = rules_in('{?a :is "even" . ?a :next ?b} => {?b :is "odd"} . {?a :is "odd" . ?a :next ?b} => {?b :is "even"} .')
    return pairs_of(R.think(chain.unionByName(first), rules), x("is"))


@query("rule_existential_head", f"SELECT {subject('customer', 'c_custkey')} AS s, '\"' || c_mktsegment || '\"' AS o FROM customer")
def rule_existential_head(spark, sf_dir):
    q = R.apply_rules(quads_of(spark, sf_dir, "customer"), rules_in("{?c c:c_mktsegment ?m} => {?c :has [ :segment ?m ]} ."))
    has = q.where(F.col("p") == x("has")).select("s", F.col("o").alias("b"))
    return has.join(q.where(F.col("p") == x("segment")).select(F.col("s").alias("b"), "o"), "b").select("s", "o")


@query("rule_builtins", f"SELECT {subject('customer', 'c_custkey')} AS s, '\"' || c_name || ' of ' || n_name || '\"' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def rule_builtins(spark, sf_dir):
    rules = rules_in('{?c c:c_acctbal ?b ; c:c_name ?m ; c:c_nationkey ?n . ?b math:greaterThan 5000 . ?n n:n_name ?k . (?m " of " ?k) string:concatenation ?t} => {?c :title ?t} .')
    return pairs_of(R.filter_rules(quads_of(spark, sf_dir, "customer", "nation"), rules), x("title"))


@query("rule_meta", f"SELECT {subject('nation', 'n_nationkey')} AS s, {subject('region', 'r_regionkey', 'n_regionkey')} AS o FROM nation")
def rule_meta(spark, sf_dir):
    """A rule that concludes a rule."""
    s = Session(spark)
    d = s.document("urn:meta", N3_PREFIXES + "n:n_regionkey a :Containment . {?p a :Containment} => {{?a ?p ?b} => {?a :inside ?b}} .")
    g = Graph(s, quads_of(spark, sf_dir, "nation").unionByName(s.load("urn:meta").quads), [d])
    return pairs_of(g.think().quads, x("inside"))


@query("rule_think_incremental", SIZES + ", t AS (SELECT * FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT '<urn:x#size' || a || '>' AS s, '<urn:x#size' || b || '>' AS o FROM t")
def rule_think_incremental(spark, sf_dir):
    """The closure in two batches, the second semi-naive over the first."""
    chain, rules = size_chain(spark, sf_dir), rules_in(REACH)
    early = F.md5("s") < "8"
    known = R.think(chain.where(early), rules)
    return pairs_of(known.unionByName(R.think_delta(known, chain.where(~early), rules)), x("reach"))


# Entailment


def entailed(name: str, tables: tuple[str, ...], axioms: str, names: tuple[str, ...], p: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, sf_dir):
        return pairs_of(entail.entail(quads_of(spark, sf_dir, *tables).unionByName(facts_in(spark, axioms)), *names), p)


CUSTOMER, SUPPLIER = subject("customer", "c_custkey"), subject("supplier", "s_suppkey")
entailed("rdfs_subclass", ("customer", "supplier"), "<db/customer> rdfs:subClassOf :Party . <db/supplier> rdfs:subClassOf :Party . :Party rdfs:subClassOf :Agent .", ("subClassOf",), T.TYPE, f"SELECT s, unnest(['<urn:x#Party>', '<urn:x#Agent>', t]) AS o FROM (SELECT {CUSTOMER} AS s, '<db/customer>' AS t FROM customer UNION ALL SELECT {SUPPLIER}, '<db/supplier>' FROM supplier)")
entailed("rdfs_domain_range", ("customer",), "c:c_nationkey rdfs:domain :Resident ; rdfs:range :Country .", ("domain", "range"), T.TYPE, f"SELECT {CUSTOMER} AS s, unnest(['<urn:x#Resident>', '<db/customer>']) AS o FROM customer UNION SELECT {subject('nation', 'n_nationkey', 'c_nationkey')}, '<urn:x#Country>' FROM customer")
entailed("rdfs_subproperty", ("customer", "supplier"), "c:c_nationkey rdfs:subPropertyOf :nationOf . s:s_nationkey rdfs:subPropertyOf :nationOf . :nationOf rdfs:subPropertyOf :placeOf .", ("subPropertyOf",), x("placeOf"), f"SELECT {CUSTOMER} AS s, {subject('nation', 'n_nationkey', 'c_nationkey')} AS o FROM customer UNION SELECT {SUPPLIER}, {subject('nation', 'n_nationkey', 's_nationkey')} FROM supplier")
entailed("owl_symmetric", ("nation",), "n:n_regionkey a owl:SymmetricProperty .", ("symmetric",), "<db/nation#n_regionkey>", f"SELECT {subject('nation', 'n_nationkey')} AS s, {subject('region', 'r_regionkey', 'n_regionkey')} AS o FROM nation UNION SELECT {subject('region', 'r_regionkey', 'n_regionkey')}, {subject('nation', 'n_nationkey')} FROM nation")
entailed("owl_transitive", ("customer", "nation"), "c:c_nationkey rdfs:subPropertyOf :in . n:n_regionkey rdfs:subPropertyOf :in . :in a owl:TransitiveProperty .", ("subPropertyOf", "transitive"), x("in"), f"WITH e AS (SELECT {CUSTOMER} AS s, {subject('nation', 'n_nationkey', 'c_nationkey')} AS o FROM customer UNION SELECT {subject('nation', 'n_nationkey')}, {subject('region', 'r_regionkey', 'n_regionkey')} FROM nation) SELECT * FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s")


@query("owl_sameas_smush", f"SELECT CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN {subject('customer', 'c_custkey', 's_suppkey')} ELSE {SUPPLIER} END AS s, '\"' || s_name || '\"' AS o FROM supplier")
def owl_sameas_smush(spark, sf_dir):
    """Customers and suppliers of one key are the same: what the suppliers are called, after smushing."""
    q = quads_of(spark, sf_dir, "customer", "supplier")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    node = lambda t: F.concat(F.lit(f"<db/{t}."), F.col("k").cast("string"), F.lit(">"))
    same = c.join(s, "k").select(F.lit("").alias("g"), node("customer#c_custkey").alias("s"), F.lit(T.SAME_AS).alias("p"), node("supplier#s_suppkey").alias("o"))
    return pairs_of(entail.smush(q.unionByName(same)), "<db/supplier#s_name>")


@query("list_collapse", f"SELECT {subject('region', 'r_regionkey', 'n_regionkey')} AS s, 'L[' || string_agg('\"<db/nation#n_nationkey.' || n_nationkey || '>\"', ',' ORDER BY n_nationkey) || ']' AS o FROM nation GROUP BY n_regionkey")
def list_collapse(spark, sf_dir):
    """The nations of each region as first/rest cells, then as a list."""
    from pyspark.sql import Window

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    cell = lambda c: F.concat(F.lit("_:c"), c.cast("string"))
    n = n.withColumn("next", F.lead("n_nationkey").over(w)).withColumn("k", F.row_number().over(w))
    quad = lambda s, p, o: F.struct(F.lit("").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    nation = F.concat(F.lit("<db/nation#n_nationkey."), F.col("n_nationkey").cast("string"), F.lit(">"))
    region = F.concat(F.lit("<db/region#r_regionkey."), F.col("n_regionkey").cast("string"), F.lit(">"))
    rows = F.array(quad(cell(F.col("n_nationkey")), T.FIRST, nation), quad(cell(F.col("n_nationkey")), T.REST, F.coalesce(cell(F.col("next")), F.lit(T.EMPTY_LIST))), quad(region, x("nations"), cell(F.col("n_nationkey"))))
    cells = n.select(F.explode(F.when(F.col("k") == 1, rows).otherwise(F.slice(rows, 1, 2))).alias("q")).select("q.*")
    return pairs_of(entail.collapse_lists(cells), x("nations"))


# Graph operators


def customer_graph(spark, sf_dir):
    return quads_of(spark, sf_dir, "customer")


CUSTOMER_TRIPLES = f"SELECT {CUSTOMER} AS s, unnest(['<db/customer#c_custkey>', '<db/customer#c_name>', '<db/customer#c_nationkey>', '<db/customer#c_acctbal>', '<db/customer#c_mktsegment>', '{T.TYPE}']) AS p, unnest(['\"' || c_custkey || '\"^^<{T.XSD}long>', '\"' || c_name || '\"', {subject('nation', 'n_nationkey', 'c_nationkey')}, '\"' || c_acctbal || '\"^^<{T.XSD}double>', '\"' || c_mktsegment || '\"', '<db/customer>']) AS o FROM customer"


@query("includes", f"SELECT {subject('nation', 'n_nationkey')} AS s FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9700)")
def includes(spark, sf_dir):
    return graph_test(spark, sf_dir, "includes")


@query("not_includes", f"SELECT {subject('nation', 'n_nationkey')} AS s FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9700)")
def not_includes(spark, sf_dir):
    return graph_test(spark, sf_dir, "notIncludes")


def graph_test(spark, sf_dir, which):
    """Nations for which the customers' graph includes (or not) a rich customer."""
    s = Session(spark)
    d = s.document("urn:test", N3_PREFIXES + f'{{?n n:n_name ?m . :customers log:{which} {{?c c:c_nationkey ?n ; c:c_acctbal ?b . ?b math:greaterThan 9700}}}} => {{?n :found true}} .'.replace(":customers log", "<Fcustomers> log"))
    rules = R.rules_of(d)
    for r in rules:
        r.body = [tuple("Fcustomers" if t == "<Fcustomers>" else t for t in p) for p in r.body]
    quads = quads_of(spark, sf_dir, "nation").unionByName(quads_of(spark, sf_dir, "customer").withColumn("g", F.lit("customers")))
    g = Graph(s, quads, [d])
    return R.filter_rules(quads, rules, g.builtins).select("s").distinct()


@query("sparql_graph", "SELECT c_name AS name, 'db/customer' AS g FROM customer UNION SELECT s_name, 'db/supplier' FROM supplier")
def sparql_graph(spark, sf_dir):
    """GRAPH ?g over two tables as named graphs."""
    from gossamer.sources.virtual import QuadGraph

    v = VirtualGraph(spark, sf_dir)
    quads = v.triples("customer").unionByName(v.triples("supplier"))
    out = sparql.run(QuadGraph(spark, quads), PREFIXES + "SELECT ?name ?g WHERE { GRAPH ?g { { ?x c:c_name ?name } UNION { ?x s:s_name ?name } } }")
    return out.select(T.c_lex(F.col("name")).alias("name"), T.c_uri(F.col("g")).alias("g"))


@query("patch_insert_delete", f"SELECT s, p, o FROM ({CUSTOMER_TRIPLES}) WHERE NOT (s = '<db/customer#c_custkey.7>' AND p = '<db/customer#c_mktsegment>') UNION ALL SELECT '<db/customer#c_custkey.7>', '<db/customer#c_mktsegment>', '\"SPACE\"'")
def patch_insert_delete(spark, sf_dir):
    q = customer_graph(spark, sf_dir)
    d = n3.parse(N3_PREFIXES + f'{{?c c:c_custkey "7"^^<{T.XSD}long> ; c:c_mktsegment ?m}} diff:insertion {{?c c:c_mktsegment "SPACE"}} ; diff:deletion {{?c c:c_mktsegment ?m}} .', "urn:patch")
    for g in ("?c", "?m"):
        assert g in d.root.universals
    # Both parts hang on one pattern.
    return transforms.patch(q, d).select("s", "p", "o")


@query("delta_graphs", f"SELECT 'deletion' AS change, s, p, o FROM ({CUSTOMER_TRIPLES} WHERE c_acctbal <= 0) UNION ALL SELECT 'insertion', s, p, o FROM ({CUSTOMER_TRIPLES} WHERE c_acctbal > 9000)")
def delta_graphs(spark, sf_dir):
    q = customer_graph(spark, sf_dir)
    low, high = (q.where((F.col("p") == "<db/customer#c_acctbal>") & c).select("s") for c in (T.c_number(F.col("o")) <= 9000, T.c_number(F.col("o")) > 0))
    return transforms.delta(q.join(low, "s", "left_semi").select("g", "s", "p", "o"), q.join(high, "s", "left_semi").select("g", "s", "p", "o"))


@query("purge_chaff", f"SELECT s, p, o FROM ({CUSTOMER_TRIPLES}) WHERE o NOT IN (SELECT {subject('nation', 'n_nationkey')} FROM nation WHERE n_regionkey = 1)")
def purge_chaff(spark, sf_dir):
    chaff = quads_of(spark, sf_dir, "nation").where((F.col("p") == "<db/nation#n_regionkey>") & (F.col("o") == "<db/region#r_regionkey.1>")).select("g", "s", F.lit(T.TYPE).alias("p"), F.lit(transforms.CHAFF).alias("o"))
    return transforms.purge(customer_graph(spark, sf_dir).unionByName(chaff)).select("s", "p", "o")


@query("data_only", CUSTOMER_TRIPLES)
def data_only(spark, sf_dir):
    more = facts_in(spark, "{?a :b ?c} => {?c :b ?a} . :x :says {:a :b :c} .")
    return transforms.data_only(customer_graph(spark, sf_dir).unionByName(more)).select("s", "p", "o")


@query("reify_roundtrip", CUSTOMER_TRIPLES)
def reify_roundtrip(spark, sf_dir):
    return transforms.dereify(transforms.reify(customer_graph(spark, sf_dir))).select("s", "p", "o")


@query("flatten_roundtrip", f"SELECT * FROM ({CUSTOMER_TRIPLES}) UNION ALL SELECT '<urn:x#l>', '<urn:x#is>', 'L[\"<urn:x#a>\",\"<urn:x#b>\"]'")
def flatten_roundtrip(spark, sf_dir):
    q = customer_graph(spark, sf_dir).unionByName(facts_in(spark, ":l :is (:a :b) ."))
    return transforms.unflatten(transforms.flatten(q)).select("s", "p", "o")


@query("ntriples_roundtrip", CUSTOMER_TRIPLES)
def ntriples_roundtrip(spark, sf_dir):
    path = new_path(spark, "ntriples")
    ntriples.write(customer_graph(spark, sf_dir), path)
    return ntriples.read(spark, path).select("s", "p", "o")


@query("why_reasons", f"SELECT {CUSTOMER} AS s, {subject('region', 'r_regionkey', 'n_regionkey')} AS o, {CUSTOMER} || ' <db/customer#c_nationkey> ' || {subject('nation', 'n_nationkey')} AS first, {subject('nation', 'n_nationkey')} || ' <db/nation#n_regionkey> ' || {subject('region', 'r_regionkey', 'n_regionkey')} AS second FROM customer JOIN nation ON c_nationkey = n_nationkey")
def why_reasons(spark, sf_dir):
    rules = rules_in(IN_REGION)
    closed = R.think(quads_of(spark, sf_dir, "customer", "nation"), rules)
    return proof.reasons(closed, rules).select("s", "o", F.col("evidence")[0].alias("first"), F.col("evidence")[1].alias("second"))


@query("proof_check", "SELECT '<urn:x#a>' AS s, '<urn:x#inRegion>' AS p, '<urn:x#b>' AS o")
def proof_check(spark, sf_dir):
    """Of all reasons and a false one, the one that does not hold."""
    rules = rules_in(IN_REGION)
    quads = quads_of(spark, sf_dir, "customer", "nation")
    closed = R.think(quads, rules)
    claims = proof.reasons(closed, rules).select("s", "p", "o", "rule", "evidence")
    false = spark.createDataFrame([(x("a"), x("inRegion"), x("b"), rules[0].id, ["no", "evidence"])], claims.schema)
    return proof.check(quads, claims.unionByName(false), rules, closed).select("s", "p", "o").distinct()


TWO_STEPS = IN_REGION + " {?c :inRegion ?r . ?r r:r_name ?t} => {?c :regionName ?t} ."


@query("proof_graph", f"SELECT {CUSTOMER} AS s, '\"' || r_name || '\"' AS o, {CUSTOMER} || ' <urn:x#inRegion> ' || {subject('region', 'r_regionkey')} AS first, 0 AS wrong FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def proof_graph(spark, sf_dir):
    """The proof of every region's name, written in the reason vocabulary, read back and checked."""
    rules = rules_in(TWO_STEPS)
    quads = quads_of(spark, sf_dir, "customer", "nation", "region")
    closed = R.think(quads, rules)
    told = written(proof.graph(written(proof.reasons(closed, rules), "reasons")), "proof")
    stated = written(proof.claims(told), "claims")
    wrong = proof.check(quads, stated, rules, closed).select("s", "p", "o", F.lit(1).alias("wrong")).distinct()
    named = stated.where(F.col("p") == x("regionName")).join(wrong, ["s", "p", "o"], "left")
    return named.select("s", "o", F.col("evidence")[0].alias("first"), F.coalesce("wrong", F.lit(0)).alias("wrong"))


@query("schema_discovery", "SELECT DISTINCT c_name AS cname, r_name AS rname FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def schema_discovery(spark, sf_dir):
    """The flagship query over tables whose keys and links are found in the data."""
    from gossamer.sources import virtual

    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer")}
    g = VirtualGraph(spark, schema=virtual.discover(frames), read=frames.get, connected=True)
    return sparql.run(g, PREFIXES + "SELECT ?cname ?rname WHERE { ?c c:c_name ?cname ; c:c_nationkey ?n ; c:c_acctbal ?bal . ?n n:n_regionkey ?r . ?r r:r_name ?rname . FILTER(?bal > 9000) }")


@query("namespaces", "SELECT 'db/nation#' AS namespace, 7 * count(*) AS n FROM nation")
def namespaces(spark, sf_dir):
    """How often the nations' own namespace stands in their statements, as subject, predicate or object."""
    return Graph(Session(spark), quads_of(spark, sf_dir, "nation")).namespaces().where("namespace = 'db/nation#'")


@query("tms_believed", "WITH RECURSIVE t AS (SELECT min(n_nationkey) AS n FROM nation UNION SELECT n_nationkey FROM nation JOIN t ON n_nationkey = t.n + 1 WHERE n_nationkey <> 17) SELECT 'nation ' || n AS node FROM t UNION ALL SELECT 'unless ' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT n FROM t)")
def tms_believed(spark, sf_dir):
    """Each nation is believed because the one before is, but 17; `unless n` holds when nation n is not believed."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"), "n_nationkey")
    node = lambda c: F.concat(F.lit("nation "), c.cast("string"))
    chain = n.where("n_nationkey > 0 AND n_nationkey <> 17").select(node(F.col("k")).alias("node"), F.concat(F.lit("j"), "k").alias("jid"), node(F.col("n_nationkey") - 1).alias("antecedent"), F.lit(True).alias("positive"))
    unless = n.select(F.concat(F.lit("unless "), "k").alias("node"), F.concat(F.lit("u"), "k").alias("jid"), node(F.col("k")).alias("antecedent"), F.lit(False).alias("positive"))
    rows = chain.unionByName(unless)
    first = n.agg(F.min("n_nationkey").alias("n")).select(node(F.col("n")).alias("node"))
    return tms.believed(first, rows.select("node", "jid"), rows.select("jid", "antecedent", "positive"))


# Policies

ORDERS = subject("orders", "o_orderkey")


def policy(spark, sf_dir, tables: tuple[str, ...], text: str, goals: list | None = None):
    s = Session(spark)
    d = s.document("urn:policy", N3_PREFIXES + text)
    return run_policy(Graph(s, quads_of(spark, sf_dir, *tables), [d]), [d], goals=goals)


IF_THEN_ELSE = """@forAll :O . :P a air:Policy ; air:rule :Each .
:Each a air:Belief-rule ; air:if { :O a <db/orders> } ; air:then [ air:rule :Finished ] .
:Finished a air:Belief-rule ; air:label "finished" ; air:if { :O o:o_orderstatus "F" } ;
  air:then [ air:assert { :O air:compliant-with :P } ] ; air:else [ air:assert { :O air:non-compliant-with :P } ] ."""


@query("policy_if_then_else", f"SELECT {ORDERS} AS s, CASE o_orderstatus WHEN 'F' THEN 'compliant-with' ELSE 'non-compliant-with' END AS verdict FROM orders")
def policy_if_then_else(spark, sf_dir):
    out, _ = policy(spark, sf_dir, ("orders",), IF_THEN_ELSE)
    return out.select("s", F.substring_index(T.c_uri(F.col("p")), "#", -1).alias("verdict"))


@query("policy_justifications", f"SELECT {ORDERS} AS s, CASE o_orderstatus WHEN 'F' THEN 'then' ELSE 'else' END AS branch, CASE o_orderstatus WHEN 'F' THEN {ORDERS} || ' <db/orders#o_orderstatus> \"F\"' ELSE 'closed world' END AS evidence FROM orders")
def policy_justifications(spark, sf_dir):
    _, why = policy(spark, sf_dir, ("orders",), IF_THEN_ELSE)
    return why.select("s", "branch", F.col("antecedents")[0].alias("evidence"))


@query("policy_trace", f"SELECT {ORDERS} AS s, CASE o_orderstatus WHEN 'F' THEN 'then' ELSE 'else' END AS branch, CASE o_orderstatus WHEN 'F' THEN {ORDERS} || ' <db/orders#o_orderstatus> \"F\"' ELSE '_:closedWorld' END AS because FROM orders")
def policy_trace(spark, sf_dir):
    """The same justifications from the trace that is written as a graph."""
    from gossamer.plans import policy as P

    _, why = policy(spark, sf_dir, ("orders",), IF_THEN_ELSE)
    trace = written(P.trace_graph(why), "trace")
    value = lambda p, v: trace.where((F.col("g") == "") & F.col("p").isin(p)).select(F.col("s").alias("step"), F.col("o").alias(v))
    airj = lambda n: f"<{P.AIRJ}{n}>"
    gives = value([airj("asserts")], "graph").join(trace.where("g != ''").select(F.concat(F.lit("F"), "g").alias("graph"), "s"), "graph")
    out = gives.join(value([airj("branch")], "branch"), "step").join(value([airj("dataDependency"), airj("flowDependency")], "because"), "step")
    return out.select("s", F.substring_index(T.c_uri(F.col("branch")), "#", -1).alias("branch"), F.coalesce(T.c_lex(F.col("because")), F.col("because")).alias("because"))


@query("policy_goal", f"SELECT {ORDERS} AS s FROM orders WHERE o_orderstatus = 'F'")
def policy_goal(spark, sf_dir):
    """With compliance as the goal the rule that only denies is not run."""
    text = """@forAll :O . :P a air:Policy ; air:rule :Yes , :No .
:Yes a air:Belief-rule ; air:if { :O o:o_orderstatus "F" } ; air:then [ air:assert { :O air:compliant-with :P } ] .
:No a air:Belief-rule ; air:if { :O o:o_orderstatus "O" } ; air:then [ air:assert { :O air:non-compliant-with :P } ] ."""
    out, _ = policy(spark, sf_dir, ("orders",), text, goals=[("?who", f"<{T.AIR}compliant-with>", "?what")])
    return out.select("s")


@query("policy_nested", f"SELECT {CUSTOMER} AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 'compliant-with' ELSE 'non-compliant-with' END AS verdict FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def policy_nested(spark, sf_dir):
    out, _ = policy(spark, sf_dir, ("customer", "nation", "region"), """@forAll :C, :N, :R . :P a air:Policy ; air:rule :Region .
:Region a air:Belief-rule ; air:if { :R r:r_name "ASIA" } ; air:then [ air:rule :Nation ] .
:Nation a air:Belief-rule ; air:if { :N n:n_regionkey :R } ; air:then [ air:rule :Customer ] .
:Customer a air:Belief-rule ; air:if { :C c:c_nationkey :N } ; air:then [ air:rule :Segment ] .
:Segment a air:Belief-rule ; air:if { :C c:c_mktsegment "BUILDING" } ; air:then [ air:assert { :C air:compliant-with :P } ] ; air:else [ air:assert { :C air:non-compliant-with :P } ] .""")
    return out.select("s", F.substring_index(T.c_uri(F.col("p")), "#", -1).alias("verdict"))


@query("policy_closed_world", f"SELECT {subject('nation', 'n_nationkey')} AS s, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'compliant-with' WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) THEN 'compliant-with' ELSE 'non-compliant-with' END AS verdict FROM nation")
def policy_closed_world(spark, sf_dir):
    """A nation complies with a supplier; failing that, with a rich customer; failing that, it does not."""
    out, _ = policy(spark, sf_dir, ("nation", "supplier", "customer"), """@forAll :N . :P a air:Policy ; air:rule :Each .
:Each a air:Belief-rule ; air:if { :N a <db/nation> } ; air:then [ air:rule :Supplied ] .
:Supplied a air:Belief-rule ; air:if { @forSome :S . :S s:s_nationkey :N } ; air:then [ air:assert { :N air:compliant-with :P } ] ; air:else [ air:rule :Rich ] .
:Rich a air:Belief-rule ; air:if { @forSome :C, :B . :C c:c_nationkey :N ; c:c_acctbal :B . :B math:greaterThan 9000 } ; air:then [ air:assert { :N air:compliant-with :P } ] ; air:else [ air:assert { :N air:non-compliant-with :P } ] .""")
    return out.select("s", F.substring_index(T.c_uri(F.col("p")), "#", -1).alias("verdict")).distinct()


# Built-ins, a family to a query


def builtin(p: str, *args):
    """The object that a built-in gives a subject: one argument, or a list of several."""
    arg = lambda a: Arg(T.c_lit(a) if not isinstance(a, Arg) else None) if not isinstance(a, Arg) else a
    subj = arg(args[0]) if len(args) == 1 else Arg(items=[arg(a) for a in args])
    prefix, _, local = p.partition(":")
    ns = "http://www.w3.org/2006/xpath-functions#" if prefix == "fn" else f"{T.SWAP}{prefix}#"
    return get(f"<{ns}{local}>").fwd(subj)


def number(c, kind: str = "integer") -> Arg:
    return Arg(T.c_xsd(c, kind))


def tested(p: str, a, b):
    prefix, _, local = p.partition(":")
    return get(f"<{T.SWAP}{prefix}#{local}>").test(Arg(T.c_lit(a) if not isinstance(a, Arg) else a.c), Arg(T.c_lit(b) if not isinstance(b, Arg) else b.c))


def lex(c):
    return T.c_lex(c)


@query("string_functions", "SELECT p_partkey AS k, p_name || '/' || p_brand AS joined, contains(p_name, 'a') AS has, lower(p_name) = lower(p_brand) AS same, p_name < p_brand AS less, regexp_matches(p_type, 'E.*') AS match, CASE WHEN regexp_matches(p_brand, '#([0-9]+)') THEN regexp_extract(p_brand, '#([0-9]+)', 1) END AS number, starts_with(p_type, 'S') AS begins, replace(replace(p_type, '&', '&#38;'), '<', '&#60;') AS safe FROM part")
def string_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return p.select(F.col("p_partkey").alias("k"), lex(builtin("string:concatenation", n, F.lit("/"), b)).alias("joined"), tested("string:contains", n, F.lit("a")).alias("has"), tested("string:equalIgnoringCase", n, b).alias("same"), tested("string:lessThan", n, b).alias("less"), tested("string:matches", t, F.lit("E.*")).alias("match"), lex(builtin("string:scrape", b, F.lit("#([0-9]+)"))).alias("number"), tested("string:startsWith", t, F.lit("S")).alias("begins"), lex(builtin("string:xmlEscapeData", t)).alias("safe"))


@query("fn_functions", "SELECT p_partkey AS k, upper(p_name) AS up, lower(p_type) AS low, length(p_name)::VARCHAR AS n, substr(p_name, 2, 3) AS part, translate(p_brand, 'Bd', 'b') AS moved, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS before, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS after, trim(regexp_replace(p_type, '\\s+', ' ', 'g')) AS tidy, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, CASE WHEN p_name < p_brand THEN '-1' WHEN p_name > p_brand THEN '1' ELSE '0' END AS cmp FROM part")
def fn_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return p.select(F.col("p_partkey").alias("k"), lex(builtin("fn:upper-case", n)).alias("up"), lex(builtin("fn:lower-case", t)).alias("low"), lex(builtin("fn:string-length", n)).alias("n"), lex(builtin("fn:substring", n, number(F.lit(2)), number(F.lit(3)))).alias("part"), lex(builtin("fn:translate", b, F.lit("Bd"), F.lit("b"))).alias("moved"), lex(builtin("fn:substring-before", b, F.lit("#"))).alias("before"), lex(builtin("fn:substring-after", b, F.lit("#"))).alias("after"), lex(builtin("fn:normalize-space", t)).alias("tidy"), lex(builtin("fn:replace", n, F.lit("[aeiou]"), F.lit("_"))).alias("masked"), lex(builtin("fn:compare", n, b)).alias("cmp"))


@query("math_functions", "SELECT p_partkey AS k, (p_partkey + p_size)::VARCHAR AS total, (p_size - p_partkey)::VARCHAR AS diff, (p_partkey * p_size)::VARCHAR AS prod, round(p_partkey / p_size, 6) AS quot, floor((p_size - p_partkey) / 7.0)::BIGINT::VARCHAR AS whole, ((((p_size - p_partkey) % 7) + 7) % 7)::VARCHAR AS rest, (-p_size)::VARCHAR AS neg, abs(p_size - p_partkey)::VARCHAR AS size, (p_size * p_size * p_size)::VARCHAR AS cube, p_size > 25 AS big FROM part")
def math_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, s = number(F.col("p_partkey")), number(F.col("p_size"))
    d = number(F.col("p_size") - F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("k"), lex(builtin("math:sum", k, s)).alias("total"), lex(builtin("math:difference", s, k)).alias("diff"), lex(builtin("math:product", k, s)).alias("prod"), F.round(lex(builtin("math:quotient", k, s)).cast("double"), 6).alias("quot"), lex(builtin("math:integerQuotient", d, number(F.lit(7)))).alias("whole"), lex(builtin("math:remainder", d, number(F.lit(7)))).alias("rest"), lex(builtin("math:negation", s)).alias("neg"), lex(builtin("math:absoluteValue", d)).alias("size"), lex(builtin("math:exponentiation", s, number(F.lit(3)))).alias("cube"), tested("math:greaterThan", s, number(F.lit(25))).alias("big"))


@query("trig_functions", "SELECT c_custkey AS k, round(cos(c_acctbal), 6) AS c, round(sin(c_acctbal), 6) AS s, round(atan2(c_acctbal, 3), 6) AS a, round(degrees(c_acctbal), 4) AS d, round(cosh(c_acctbal / 10000), 6) AS h FROM customer")
def trig_functions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    b = number(F.col("c_acctbal"), "double")
    d = lambda t, n=6: F.round(lex(t).cast("double"), n)
    return c.select(F.col("c_custkey").alias("k"), d(builtin("math:cos", b)).alias("c"), d(builtin("math:sin", b)).alias("s"), d(builtin("math:atan2", b, number(F.lit(3)))).alias("a"), d(builtin("math:degrees", b), 4).alias("d"), d(builtin("math:cosh", number(F.col("c_acctbal") / 10000, "double"))).alias("h"))


@query("time_functions", "SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS y, month(o_orderdate)::VARCHAR AS m, day(o_orderdate)::VARCHAR AS d, hour(o_orderdate)::VARCHAR AS h, epoch(o_orderdate)::BIGINT::VARCHAR AS secs, (isodow(o_orderdate) - 1)::VARCHAR AS dow, strftime(o_orderdate, '%d/%m/%Y') AS text, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def time_functions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(F.col("o_orderkey").alias("k"), *[lex(builtin(f"time:{f}", t)).alias(n) for f, n in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("inSeconds", "secs"), ("dayOfWeek", "dow"), ("date", "date"))], lex(builtin("time:format", t, F.lit("%d/%m/%Y"))).alias("text"))


@query("list_functions", "SELECT n_nationkey AS k, n_name AS last, '2' AS count, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]::VARCHAR AS both FROM nation")
def list_functions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k, m, r = F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string")
    two = Arg(items=[Arg(T.c_lit(k)), Arg(T.c_lit(m))])
    more = Arg(items=[Arg(T.c_lit(r))])
    both = builtin("list:append", two, more)
    return n.select(F.col("n_nationkey").alias("k"), lex(get(f"<{T.SWAP}list#last>").fwd(two)).alias("last"), lex(get(f"<{T.SWAP}math#memberCount>").fwd(two)).alias("count"), F.concat(F.lit("["), F.array_join(F.transform(T.c_items(both), lambda i: T.c_lex(i)), ", "), F.lit("]")).alias("both"))


@query("set_functions", "SELECT k, list_sort(list_distinct(list_concat(a, b))) AS both, list_sort(list_intersect(a, b)) AS common, list_sort(list_filter(a, lambda i: NOT list_contains(b, i))) AS less FROM (SELECT n_nationkey AS k, ['x', 'n' || n_regionkey::VARCHAR] AS a, ['n1', 'n' || (n_nationkey % 3)::VARCHAR] AS b FROM nation)")
def set_functions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    one = lambda *cols: Arg(T.c_set(F.array(*[T.c_lit(c) for c in cols])))
    a = one(F.lit("x"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")))
    b = one(F.lit("n1"), F.concat(F.lit("n"), (F.col("n_nationkey") % 3).cast("string")))
    texts = lambda t: F.transform(T.c_items(t), lambda i: T.c_lex(i))
    return n.select(F.col("n_nationkey").alias("k"), texts(builtin("set:union", a, b)).alias("both"), texts(builtin("set:intersection", a, b)).alias("common"), texts(builtin("set:difference", a, b)).alias("less"))


@query("crypto_functions", "SELECT c_custkey AS k, md5(c_name) AS m, sha1(c_name) AS s FROM customer")
def crypto_functions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("k"), lex(builtin("crypto:md5", F.col("c_name"))).alias("m"), lex(builtin("crypto:sha", F.col("c_name"))).alias("s"))


@query("log_functions", "SELECT n_nationkey AS k, 'db/nation#n_nationkey.' || n_nationkey AS uri, 'db/nation' AS stem FROM nation")
def log_functions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    node = Arg(F.concat(F.lit("<db/nation#n_nationkey."), F.col("n_nationkey").cast("string"), F.lit(">")))
    return n.select(F.col("n_nationkey").alias("k"), lex(get(f"<{T.LOG}uri>").fwd(node)).alias("uri"), T.c_uri(get(f"<{T.LOG}racine>").fwd(node)).alias("stem"))


# Every built-in of a namespace, each way that it can be asked, and queries over documents

from gossamer import builtin_queries, document_queries  # noqa: E402

for more in (builtin_queries, document_queries):
    QUERIES.update(more.QUERIES)
    ORACLE.update(more.ORACLE)
