"""Whole-graph operators: patch, delta, purge, data, reify, flatten, canonical form, isomorphism."""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.operators.bgp import solve
from gossamer.plans import rules as R
from gossamer.sources import n3
from gossamer.tables import written
from gossamer.terms import DIFF, LOG

REI = "http://www.w3.org/2004/06/rei#"
CHAFF = f"<{LOG}Chaff>"
KEYS = ["g", "s", "p", "o"]


class PatchError(ValueError):
    """A patch that does not fit the graph."""


def purge(quads: DataFrame, kind: str = CHAFF) -> DataFrame:
    """quads without those that mention a member of the class log:Chaff."""
    members = quads.where((F.col("p") == T.TYPE) & (F.col("o") == kind)).select(F.col("s").alias("m")).distinct()
    for c in "spo":
        quads = quads.join(members.select(F.col("m").alias(c)), c, "left_anti").select(*KEYS)
    return quads.where(F.col("o") != kind)


def data_only(quads: DataFrame) -> DataFrame:
    """The graph's own statements without quoted graphs and variables."""
    own = quads.where("g = ''")
    for c in "spo":
        own = own.where(~F.col(c).startswith("F") & ~F.col(c).startswith("?"))
    return own


def patch(quads: DataFrame, document: n3.Document) -> DataFrame:
    """{where} diff:insertion / diff:deletion {what}: the first solution in term order is applied, insertions before
    deletions; each deletion must match one statement."""
    spark = quads.sparkSession
    by_where: dict[str, dict[str, str]] = {}
    for s, p, o in document.root.statements:
        if p in (f"<{DIFF}insertion>", f"<{DIFF}deletion>"):
            by_where.setdefault(s, {})[p[1:-1].removeprefix(DIFF)] = o
    for where, parts in by_where.items():
        rule = R.Rule(R.as_variables(document.formulas[where[1:]]), [], where, document.formulas)
        rows = solve(spark, rule.body, lambda i: quads)
        if rows.columns:
            rows = rows.orderBy(*[F.col(f"`{c}`") for c in rows.columns])
        first = written(rows.limit(1), "solution") if rows.columns else rows
        if first.isEmpty():
            raise PatchError(f"nothing matches the pattern of patch {where}")
        if "insertion" in parts:
            head = R.Rule([], document.formulas[parts["insertion"][1:]].statements, where, document.formulas)
            quads = quads.unionByName(R.conclude(first, head)).distinct()
        if "deletion" in parts:
            gone = R.Rule([], document.formulas[parts["deletion"][1:]].statements, where, document.formulas)
            if any(isinstance(t, str) and t.startswith("_:") for st in gone.head for t in st):
                raise PatchError("a deletion holds a blank node")
            rows = written(R.conclude(first, gone), "deletion")
            missing = rows.join(quads, KEYS, "left_anti")
            if not missing.isEmpty():
                raise PatchError(f"a deletion matches no statement: {missing.first()[1:]}")
            quads = quads.join(rows, KEYS, "left_anti")
    return quads


def bnode_signatures(quads: DataFrame, rounds: int | None = None, keep: list[str] = ()) -> DataFrame:
    """(node, signature): hashes of blank nodes refined by their neighbours until as many are told apart as can be."""
    own = quads.where("g = ''")
    nodes = own.select(F.col("s").alias("node")).unionByName(own.select(F.col("o").alias("node"))).where(F.col("node").startswith("_:")).distinct()
    sig = written(nodes.withColumn("signature", F.lit("b")), "signatures")
    kinds = sig.select("signature").distinct().count()
    for _ in itertools.count() if rounds is None else range(rounds):
        name = lambda c: F.when(F.col(c).startswith("_:"), F.col(f"sig_{c}")).otherwise(F.col(c))
        told = own
        for c in "so":
            told = told.join(sig.select(F.col("node").alias(c), F.col("signature").alias(f"sig_{c}")), c, "left")
        out = told.where(F.col("s").startswith("_:")).select(F.col("s").alias("node"), F.concat_ws("\u0001", F.lit(">"), "p", name("o")).alias("e"))
        into = told.where(F.col("o").startswith("_:")).select(F.col("o").alias("node"), F.concat_ws("\u0001", F.lit("<"), "p", name("s")).alias("e"))
        each = out.unionByName(into).groupBy("node").agg(F.sort_array(F.collect_list("e")).alias("es"))
        new = sig.join(each, "node", "left").select("node", F.md5(F.concat_ws("\u0002", "signature", "es")).alias("signature"))
        sig = written(new, "signatures")
        now = sig.select("signature").distinct().count()
        if now == kinds:
            break
        kinds = now
    return sig


#: Statements between blank nodes that signatures cannot tell apart; more are refused.
MOST_TIED = 200_000


def _refined(colour: dict[str, str], edges: dict[str, list[tuple[str, str, str]]]) -> dict[str, str]:
    """Colours of nodes told apart by those of their neighbours, until no more are."""
    while True:
        seen = {n: hashlib.md5("\u0001".join([c, *sorted(f"{way}{p}\u0002{colour[m]}" for way, p, m in edges[n])]).encode()).hexdigest() for n, c in colour.items()}
        if len(set(seen.values())) == len(set(colour.values())):
            return colour
        colour = seen


def _settled(colour: dict[str, str], edges: dict[str, list[tuple[str, str, str]]]) -> tuple[list, dict[str, str]]:
    """The least form of a connected part that any choice among its equal nodes gives, and the nodes' colours in it."""
    colour = _refined(colour, edges)
    groups: dict[str, list[str]] = {}
    for n, c in colour.items():
        groups.setdefault(c, []).append(n)
    tied = min((len(g), c) for c, g in groups.items() if len(g) > 1) if len(groups) < len(colour) else None
    if tied is None:
        return sorted((colour[n], way, p, colour[m]) for n in edges for way, p, m in edges[n]), colour
    return min((_settled(colour | {n: colour[n] + "!"}, edges) for n in groups[tied[1]]), key=lambda x: x[0])


def _told_apart(sig: list[tuple[str, str]], links: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(node, name) for blank nodes with signatures that others have too, by the statements between them. Parts that do
    not hang together are settled one by one; equal ones may be numbered in any order."""
    colour = dict(sig)
    edges: dict[str, list[tuple[str, str, str]]] = {n: [] for n in colour}
    for s, p, o in links:
        edges[s].append((">", p, o))
        edges[o].append(("<", p, s))
    out, copies, seen = [], {}, set()
    for start in colour:
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            n = todo.pop()
            part.append(n)
            todo += [m for _, _, m in edges[n] if m not in seen and not seen.add(m)]
        form, final = _settled({n: colour[n] for n in part}, {n: edges[n] for n in part})
        key = hashlib.md5(repr((form, sorted(final.values()))).encode()).hexdigest()
        copies[key] = copies.get(key, 0) + 1
        out += [(n, f"{hashlib.md5((key + c).encode()).hexdigest()}_{copies[key]}") for n, c in final.items()]
    return out


def canonical(quads: DataFrame) -> DataFrame:
    """quads with blank nodes named by their signatures. Those that share one, as in rings and in equal parts, are told
    apart on the driver by choosing among equals; what is left equal then may bear any number."""
    from gossamer.plans.entail import rewritten

    spark = quads.sparkSession
    sig = bnode_signatures(quads)
    shared = sig.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
    tied = written(sig.join(shared, "signature").select("node", "signature"), "tied")
    names = sig.join(shared, "signature", "left_anti").select("node", F.concat(F.lit("_:"), "signature").alias("best"))
    if not tied.isEmpty():
        node = lambda c: tied.select(F.col("node").alias(c))
        links = quads.where("g = ''").select("s", "p", "o").distinct().join(node("s"), "s", "left_semi").join(node("o"), "o", "left_semi")
        found = links.select("s", "p", "o").limit(MOST_TIED + 1).collect()
        if len(found) > MOST_TIED or tied.count() > MOST_TIED:
            raise ValueError(f"more than {MOST_TIED} statements or nodes whose blank nodes look the same")
        rows = _told_apart(sorted(map(tuple, tied.collect())), [tuple(r) for r in found])
        names = names.unionByName(spark.createDataFrame([(n, f"_:{x}") for n, x in rows], "node string, best string"))
    return rewritten(quads, names)


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs are the same but for the names of blank nodes."""
    x, y = (canonical(q).where("g = ''").select("s", "p", "o") for q in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def fingerprint(quads: DataFrame) -> str:
    """A key of the graph's own statements that does not depend on blank node names."""
    rows = canonical(quads).where("g = ''").select(F.md5(F.concat_ws("\u0001", "s", "p", "o")).alias("h")).agg(F.sort_array(F.collect_list("h")).alias("hs")).select(F.md5(F.concat_ws("", "hs")))
    return rows.first()[0]


def delta(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What makes b of a: rows (change, s, p, o), change 'deletion' or 'insertion'. Blank nodes of the two are matched
    as subjects of inverse functional properties, those so declared in either graph and `keys`, and as objects of
    functional properties."""
    declared = lambda kind: a.unionByName(b).where((F.col("p") == T.TYPE) & (F.col("o") == f"<{T.OWL}{kind}>")).select("s")
    own_a, own_b = (q.where("g = ''").select("s", "p", "o").distinct() for q in (a, b))
    extra = a.sparkSession.createDataFrame([(k,) for k in keys], "s string") if keys else None
    inverse = declared("InverseFunctionalProperty")
    inverse = inverse.unionByName(extra) if extra is not None else inverse
    # Of properties: the end of a statement that the other end identifies.
    props = inverse.withColumn("end", F.lit("s")).unionByName(declared("FunctionalProperty").withColumn("end", F.lit("o")))
    props = written(props.select(F.col("s").alias("p"), "end").distinct(), "properties")
    ends = lambda q: q.join(props, "p").select("p", "end", F.when(F.col("end") == "s", F.col("o")).otherwise(F.col("s")).alias("by"), F.when(F.col("end") == "s", F.col("s")).otherwise(F.col("o")).alias("node")).where(F.col("node").startswith("_:"))
    table = None
    while not props.isEmpty():
        met = ends(own_a).join(ends(own_b).withColumnRenamed("node", "best"), ["p", "end", "by"])
        # A node that meets several is matched with the first; one matched already is not matched anew.
        met = written(met.groupBy("node").agg(F.min("best").alias("best")).where("node != best"), "matched")
        if met.isEmpty():
            break
        if table is not None and met.join(table, ["node", "best"], "left_anti").isEmpty():
            break
        table = met
        for c in "so":
            own_a = own_a.join(met.select(F.col("node").alias(c), F.col("best").alias("__b")), c, "left").select(*[F.coalesce("__b", c).alias(c) if x == c else F.col(x) for x in "spo"])
        own_a = written(own_a.distinct(), "renamed")
    gone = own_a.join(own_b, ["s", "p", "o"], "left_anti").withColumn("change", F.lit("deletion"))
    new = own_b.join(own_a, ["s", "p", "o"], "left_anti").withColumn("change", F.lit("insertion"))
    return gone.unionByName(new).select("change", "s", "p", "o")


def apply_delta(quads: DataFrame, changes: DataFrame) -> DataFrame:
    row = lambda kind: changes.where(F.col("change") == kind).select(F.lit("").alias("g"), "s", "p", "o")
    return quads.join(row("deletion"), KEYS, "left_anti").unionByName(row("insertion")).distinct()


def consolidated(patches: DataFrame) -> DataFrame:
    """patches(lhs, change, rhs): one row for each pattern and change, with all its statements."""
    return patches.groupBy("lhs", "change").agg(F.sort_array(F.collect_set("rhs")).alias("rhs"))


def _described(c) -> list:
    """Struct array (p, o) that says which term a column holds."""
    rei = lambda x: F.lit(T.iri(REI + x))
    kind = T.c_kind(c)
    return F.struct(
        F.when(kind == "IRI", rei("uri")).when(kind == "LIT", rei("value")).when(kind == "BNODE", rei("nodeId")).when(kind.isin("LIST", "SET"), rei("items")).otherwise(rei("formula")).alias("p"),
        F.when(kind == "IRI", T.c_lit(T.c_uri(c))).when(kind == "BNODE", T.c_lit(c)).when(kind.isin("LIST", "SET", "FORMULA"), T.c_lit(c)).otherwise(c).alias("o"),
    )


def reify(quads: DataFrame) -> DataFrame:
    """Each statement as a node of type rei:Statement with context, subject, predicate and object, described by terms."""
    rei = lambda x: F.lit(T.iri(REI + x))
    # Equal quads and terms go before they are described; a property is a branch, which a filter on properties can leave out.
    each = quads.select(*KEYS).distinct()
    st = F.concat(F.lit("_:st"), F.md5(F.concat_ws("\u0001", *KEYS)))
    node = lambda c: F.concat(F.lit("_:t"), F.md5(F.col(c)))
    row = lambda of, s, p, o: of.select(F.lit("").alias("g"), s.alias("s"), p.alias("p"), o.alias("o"))
    out = row(each, st, F.lit(T.TYPE), rei("Statement")).unionByName(row(each, st, rei("context"), T.c_lit(F.col("g"))))
    for c, role in zip("spo", ("subject", "predicate", "object")):
        out = out.unionByName(row(each, st, rei(role), node(c)))
    terms = each.select(F.explode(F.array("s", "p", "o")).alias("t")).distinct()
    d = _described(F.col("t"))
    return out.unionByName(row(terms, node("t"), d["p"], d["o"]))


def dereify(quads: DataFrame) -> DataFrame:
    """The statements that a reified graph describes. Its joins are of parts as large as the graph, whatever Spark makes
    of their sizes (rows out of an explode count as none), so none of them is broadcast."""
    rei = lambda x: T.iri(REI + x)
    own = quads.where("g = ''")
    p, o = F.col("p"), F.col("o")
    term = F.when(p == rei("uri"), T.c_iri(T.c_lex(o))).when(p == rei("value"), o).otherwise(T.c_lex(o))
    terms = own.where(p.isin(*map(rei, ("uri", "value", "nodeId", "items", "formula")))).select(F.col("s").alias("n"), term.alias("t"))
    out = own.where((p == T.TYPE) & (o == rei("Statement"))).select(F.col("s").alias("st"))
    for c, role in zip("gspo", ("context", "subject", "predicate", "object")):
        out = out.join(own.where(p == rei(role)).select(F.col("s").alias("st"), (T.c_lex(o) if c == "g" else o).alias(c)).hint("merge"), "st")
    for c in "spo":
        out = out.join(terms.select(F.col("n").alias(c), F.col("t").alias("t")).hint("merge"), c).drop(c).withColumnRenamed("t", c)
    return out.select(*KEYS).distinct()


def beyond_rdf():
    """Whether a row is what plain RDF cannot hold: inside a quoted graph, or with a formula, list, set or variable, or a
    literal as subject or predicate."""
    own = [F.col(c).rlike(r"^[FLS?]") for c in "spo"]
    return (F.col("g") != "") | own[0] | own[1] | own[2] | F.col("s").startswith('"') | ~F.col("p").startswith("<")


def flatten(quads: DataFrame) -> DataFrame:
    """Reifies only what plain RDF cannot hold."""
    return quads.where(~beyond_rdf()).unionByName(reify(quads.where(beyond_rdf())))


def unflatten(quads: DataFrame) -> DataFrame:
    """Undoes flatten: plain statements stay, described ones come back."""
    rei = f"<{REI}"
    about = quads.where(F.col("p").startswith(rei) | ((F.col("p") == T.TYPE) & (F.col("o") == T.iri(REI + "Statement"))))
    return quads.join(about, KEYS, "left_anti").unionByName(dereify(about)).distinct()


def normalised(uri: str) -> str:
    """An IRI with lower-case scheme and host, without dot segments, with upper-case escapes."""
    from urllib.parse import urljoin, urlsplit, urlunsplit

    u = urlsplit(uri)
    path = urljoin("/", u.path) if u.netloc and u.path else u.path
    path = re.sub(r"%[0-9a-f]{2}", lambda m: m[0].upper(), path)
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), path, u.query, u.fragment))
