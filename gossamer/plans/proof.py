"""Why a statement holds: reasons of derived statements, proofs, and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.operators.bgp import column, is_builtin, name, solve
from gossamer.plans import tms
from gossamer.plans.rules import Rule
from gossamer.terms import SWAP, TYPE, c_items, c_lex, c_list, c_lit, variables

REASON = f"<{SWAP}reason#{{}}>".format

REASONS = ["s", "p", "o", "rule", "bindings", "evidence"]


def statement_key(s, p, o):
    return F.concat_ws(" ", s, p, o)


def reasons(closed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every way in which a rule gives a statement of the closed quads: the rule, its bindings and the statements that its
    body matched. Statements with blank nodes of the rule's own making are left to the premises."""
    out = None
    for r in rules:
        rows = solve(closed.sparkSession, r.body, lambda i: closed)
        cols = rows.columns
        bound = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"`{c}`"))]) if cols else F.create_map().cast("map<string,string>")
        evidence = F.array(*[statement_key(*[column(t) for t in p]) for p in r.body if not is_builtin(p)]).cast("array<string>")
        heads = [st for st in r.head if all({name(v) for v in variables(t)} <= set(cols) and not str(t).startswith("_:") for t in st)]
        if not heads:
            continue
        structs = F.array(*[F.struct(*[column(t).alias(c) for c, t in zip("spo", st)]) for st in heads])
        one = rows.select(F.explode(structs).alias("x"), F.lit(r.id).alias("rule"), bound.alias("bindings"), evidence.alias("evidence")).select("x.s", "x.p", "x.o", "rule", "bindings", "evidence")
        out = one if out is None else out.unionByName(one)
    return out


def proven(premises: DataFrame, reasons_: DataFrame) -> DataFrame:
    """(node) the statements that reasons lead to from the premises without going in a circle."""
    jid = F.md5(F.concat_ws("\u0001", "s", "p", "o", "rule", F.concat_ws("\u0002", "evidence")))
    numbered = reasons_.select(jid.alias("jid"), statement_key("s", "p", "o").alias("node"), "evidence")
    antecedents = numbered.select("jid", F.explode("evidence").alias("antecedent")).withColumn("positive", F.lit(True))
    nodes = premises.where("g = ''").select(statement_key("s", "p", "o").alias("node"))
    return tms.believed(nodes, numbered.select("node", "jid").distinct(), antecedents)


def check(premises: DataFrame, claims: DataFrame, rules: list[Rule], closed: DataFrame) -> DataFrame:
    """Claimed reasons (s, p, o, rule, evidence) that no rule gives or whose evidence is not proven: none, if the proof
    holds."""
    known = reasons(closed, rules).select("s", "p", "o", "rule", "evidence")
    wrong = claims.select("s", "p", "o", "rule", "evidence").join(known, ["s", "p", "o", "rule", "evidence"], "left_anti")
    sound = proven(premises, claims)
    lost = claims.select("s", "p", "o", "rule", "evidence", F.explode("evidence").alias("node")).join(sound, "node", "left_anti").drop("node")
    return wrong.unionByName(lost).distinct()


def graph(reasons_: DataFrame) -> DataFrame:
    """The proof as quads in the reason vocabulary: an Inference for each reason, with the statement that it gives (a graph
    of its own), its rule, its bindings and its evidence, a list of the steps that give it: inferences where there are
    any, else extractions from what was told."""
    jid = F.md5(F.concat_ws("\u0001", "s", "p", "o", "rule", F.concat_ws("\u0002", "evidence")))
    steps = reasons_.select("*", jid.alias("jid"), statement_key("s", "p", "o").alias("node"))
    by = steps.groupBy("node").agg(F.min("jid").alias("by"))
    uses = steps.select("jid", F.posexplode("evidence").alias("at", "used")).join(by.select(F.col("node").alias("used"), "by"), "used", "left")
    told = F.concat(F.lit("_:told"), F.md5("used"))
    uses = uses.withColumn("step", F.coalesce(F.concat(F.lit("_:step"), "by"), told))
    lists = uses.groupBy("jid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda x: x["step"]).alias("steps"))

    def quads(df: DataFrame, *rows: tuple) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(F.inline(F.array(*[F.struct(*[lit(x).alias(c) for c, x in zip("gspo", r)]) for r in rows])))

    me, given = F.concat(F.lit("_:step"), "jid"), F.concat(F.lit("given"), "jid")
    inferences = quads(steps, ("", me, TYPE, REASON("Inference")), ("", me, REASON("gives"), F.concat(F.lit("F"), given)), (given, F.col("s"), F.col("p"), F.col("o")), ("", me, REASON("rule"), c_lit(F.col("rule"))))
    bound = steps.select("jid", F.explode("bindings").alias("variable", "value")).where("value IS NOT NULL")
    one = F.concat(F.lit("_:binding"), "jid", F.md5("variable"))
    bindings = quads(bound, ("", me, REASON("binding"), one), ("", one, REASON("variable"), c_lit(F.col("variable"))), ("", one, REASON("boundTo"), F.col("value")))
    evidence = quads(steps.join(lists, "jid", "left"), ("", me, REASON("evidence"), c_list(F.coalesce("steps", F.array().cast("array<string>")))))
    read = quads(uses.where("by IS NULL").select("used").distinct(), ("", told, TYPE, REASON("Extraction")), ("", told, REASON("gives"), c_lit(F.col("used"))))
    return inferences.unionByName(bindings).unionByName(evidence).unionByName(read)


def claims(proof: DataFrame) -> DataFrame:
    """The reasons (s, p, o, rule, evidence) that a proof graph states, for `check`. An extraction gives what it says; an
    inference gives the statement of its graph."""
    own = proof.where("g = ''")
    values = lambda p, v: own.where(F.col("p") == REASON(p)).select(F.col("s").alias("step"), F.col("o").alias(v))
    stated = proof.where("g != ''").select(F.concat(F.lit("F"), "g").alias("graph"), "s", "p", "o")
    inferred = values("gives", "graph").join(stated, "graph").select("step", "s", "p", "o")
    told = values("gives", "text").where(F.col("text").startswith('"')).select("step", c_lex(F.col("text")).alias("node"))
    nodes = told.unionByName(inferred.select("step", statement_key("s", "p", "o").alias("node")))
    used = values("evidence", "steps").select("step", F.posexplode_outer(c_items(F.col("steps"))).alias("at", "used"))
    used = used.join(nodes.select(F.col("step").alias("used"), "node"), "used", "left").groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "node")))), lambda x: x["node"]).alias("evidence"))
    rules = values("rule", "rule").select("step", c_lex(F.col("rule")).alias("rule"))
    return inferred.join(rules, "step").join(used, "step").select("s", "p", "o", "rule", "evidence").distinct()
