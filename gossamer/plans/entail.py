"""RDFS and OWL-lite entailment as first-order rules over (axiom, statement) pairs, and sameAs smushing.

The axioms (domain, range, subClassOf, subPropertyOf, symmetric, transitive, sameAs) stay data: a rule joins them with the
statements, so nothing is generated when an axiom turns up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.plans.rules import Rule, rules_of, think
from gossamer.sources import n3
from gossamer.tables import written

RULES = """
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>. @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>.
@prefix owl: <http://www.w3.org/2002/07/owl#>.
{?p rdfs:domain ?c. ?s ?p ?o} => {?s a ?c}.
{?p rdfs:range ?c. ?s ?p ?o} => {?o a ?c}.
{?a rdfs:subClassOf ?b. ?s a ?a} => {?s a ?b}.
{?a rdfs:subClassOf ?b. ?b rdfs:subClassOf ?c} => {?a rdfs:subClassOf ?c}.
{?a rdfs:subPropertyOf ?b. ?s ?a ?o} => {?s ?b ?o}.
{?a rdfs:subPropertyOf ?b. ?b rdfs:subPropertyOf ?c} => {?a rdfs:subPropertyOf ?c}.
{?p a owl:SymmetricProperty. ?s ?p ?o} => {?o ?p ?s}.
{?p a owl:TransitiveProperty. ?s ?p ?m. ?m ?p ?o} => {?s ?p ?o}.
{?a owl:sameAs ?b} => {?b owl:sameAs ?a}.
{?a owl:sameAs ?b. ?b owl:sameAs ?c} => {?a owl:sameAs ?c}.
{?a owl:sameAs ?b. ?a ?p ?o} => {?b ?p ?o}.
{?a owl:sameAs ?b. ?s ?a ?o} => {?s ?b ?o}.
{?a owl:sameAs ?b. ?s ?p ?a} => {?s ?p ?b}.
{?p a owl:InverseFunctionalProperty. ?a ?p ?o. ?b ?p ?o} => {?a owl:sameAs ?b}.
{?p a owl:FunctionalProperty. ?s ?p ?a. ?s ?p ?b} => {?a owl:sameAs ?b}.
{?p owl:inverseOf ?q. ?s ?p ?o} => {?o ?q ?s}.
"""
_DOCUMENT = n3.parse(RULES, "gossamer:entailment", "ent_")
PACK: list[Rule] = rules_of(_DOCUMENT)
#: By name: the rules' places in RULES.
NAMED = {"domain": [0], "range": [1], "subClassOf": [2, 3], "subPropertyOf": [4, 5], "symmetric": [6], "transitive": [7], "sameAs": [8, 9, 10, 11, 12], "functional": [13, 14], "inverse": [15]}


def entail(quads: DataFrame, *names: str) -> DataFrame:
    """quads with what the named rules (default: RDFS, symmetric, transitive and sameAs) conclude."""
    wanted = names or ("domain", "range", "subClassOf", "subPropertyOf", "symmetric", "transitive", "sameAs")
    return think(quads, [PACK[i] for n in wanted for i in NAMED[n]])


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of the connected components of pairs (a, b): labels fall to the least neighbour and jump to their
    labels' labels until nothing changes."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        step = written(step, "labels")
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.least("root", "further").alias("root"))
        jump = written(jump, "labels")
        changed = not jump.join(labels, ["node", "root"], "left_anti").isEmpty()
        labels = jump
        if not changed:
            return labels


def preferred(c):
    """Order of representatives: no blank node if there is another, then the smaller term."""
    return F.struct(c.startswith("_:").alias("blank"), c.alias("term"))


def smush(quads: DataFrame, same: str = T.SAME_AS) -> DataFrame:
    """quads with all terms that `same` ties together replaced by one of them, outside quoted graphs."""
    pairs = quads.where((F.col("g") == "") & (F.col("p") == same) & (F.col("s") != F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b"))
    roots = components(pairs)
    best = roots.groupBy("root").agg(F.min(preferred(F.col("node"))).alias("best")).select("root", F.col("best.term").alias("best"))
    table = written(roots.join(best, "root").select("node", "best").where("node != best"), "smush")
    return rewritten(quads, table)


def rewritten(quads: DataFrame, table: DataFrame) -> DataFrame:
    """quads with table's (node, best) applied to subject, predicate and object of the graph's own statements."""
    own = quads.where("g = ''")
    for c in "spo":
        own = own.join(table.select(F.col("node").alias(c), F.col("best").alias("__b")), c, "left").select("g", *[F.coalesce("__b", c).alias(c) if x == c else F.col(x) for x in "spo"])
    return own.unionByName(quads.where("g != ''")).distinct()


def collapse_lists(quads: DataFrame) -> DataFrame:
    """rdf:first/rest chains of blank nodes as list terms, by doubling: each cell learns the items before a cell twice
    as far away in each round."""
    cells = quads.where(F.col("p") == T.FIRST).select(F.col("s").alias("cell"), F.col("o").alias("item")).join(quads.where(F.col("p") == T.REST).select(F.col("s").alias("cell"), F.col("o").alias("next")), "cell").where(F.col("cell").startswith("_:"))
    state = written(cells.select("cell", F.array("item").alias("items"), "next"), "cells")
    while True:
        ahead = state.select(F.col("cell").alias("next"), F.col("items").alias("more"), F.col("next").alias("then"))
        step = state.join(ahead, "next", "left").select("cell", F.when(F.col("more").isNotNull() & ~F.array_contains("items", F.lit("\u0000")), F.concat("items", "more")).otherwise(F.col("items")).alias("items"), F.coalesce("then", "next").alias("next"))
        step = written(step, "cells")
        open_ = step.where((F.col("next") != T.EMPTY_LIST) & (F.col("next") != T.NIL))
        if open_.isEmpty() or open_.join(state, ["cell", "next"], "left_anti").isEmpty():
            break
        if step.agg(F.max(F.size("items"))).first()[0] > 1 << 24:
            raise ValueError("a list that leads into itself")
        state = step
    lists = written(step.where(F.col("next").isin(T.EMPTY_LIST, T.NIL)).select(F.col("cell").alias("node"), T.c_list(F.col("items")).alias("best")), "lists")
    inner = quads.where(F.col("p").isin(T.FIRST, T.REST)).join(lists.select(F.col("node").alias("s")), "s", "left_semi").select("g", "s", "p", "o")
    return rewritten(quads.join(inner, ["g", "s", "p", "o"], "left_anti"), lists)
