"""Rules over quads: one pass, filter, fixpoint.

A rule is `{body} => {head}`. Bindings are distinct per rule; blank nodes of a head are named by the rule and the
binding, so that a repeated task or round makes the same ones. The fixpoint runs the strongly connected components of
the rule graph in order, each by semi-naive rounds: a round joins the rows that the round before found with all rows,
and keeps what is new.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.operators.bgp import GraphBuiltin, Pattern, column, is_builtin, name, solve
from gossamer.sources.n3 import Document, Formula
from gossamer.tables import new_path, release
from gossamer.terms import IMPLIES, LOG, Term, is_var, kind_of, members, seq, variables

QUADS = "g string, s string, p string, o string"


@dataclass
class Rule:
    body: list[Pattern]
    head: list[Pattern]
    id: str
    formulas: dict[str, Formula] = field(default_factory=dict)  # quoted graphs that body or head mention

    @property
    def head_variables(self) -> list[str]:
        inner = set()
        for st in self.head:
            for t in st:
                inner |= self.inside(t)
        return sorted(inner)

    def inside(self, t: Term) -> set[str]:
        """Variables of a term, those of quoted graphs included."""
        out = variables(t)
        if isinstance(t, str) and t.startswith("F") and t[1:] in self.formulas:
            for st in self.formulas[t[1:]].statements:
                for x in st:
                    out |= self.inside(x)
        return out


def as_variables(f: Formula, outer: set[str] = frozenset()) -> list[Pattern]:
    """A pattern's statements with its blank nodes as variables."""
    def turn(t: Term) -> Term:
        if not isinstance(t, str):
            return seq(t.kind, [turn(i) for i in t.items])
        if t.startswith(("L[", "S[")) and "_:" in t:
            return seq(t[0], [turn(i) for i in members(t)])
        return "?" + re.sub(r"\W", "_", t[2:]) if t.startswith("_:") and t not in outer else t

    return [tuple(turn(t) for t in st) for st in f.statements]


def rules_of(document: Document, graph: str = "") -> list[Rule]:
    """The rules that a formula states, and those of formulas that it says are implied by log:Truth."""
    out = []
    for k, (s, p, o) in enumerate(document.formulas[graph].statements):
        if p == IMPLIES and isinstance(s, str) and isinstance(o, str) and kind_of(s) == kind_of(o) == "FORMULA":
            out.append(Rule(as_variables(document.formulas[s[1:]]), list(document.formulas[o[1:]].statements), f"{document.base}#{s}{k}", document.formulas))
        elif p == IMPLIES and s == f"<{LOG}Truth>" and isinstance(o, str) and kind_of(o) == "FORMULA":
            out += rules_of(document, o[1:])
        elif p == IMPLIES and s in ("Strue",) and isinstance(o, str):
            out += rules_of(document, o[1:])
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUADS)


def conclude(bindings: DataFrame, rule: Rule, graph: str = "") -> DataFrame:
    """The head of a rule for each binding; repeated rows are left to the caller's one distinct."""
    free = [v for v in rule.head_variables if name(v) in bindings.columns]
    rows = bindings.select(*[F.col(f"`{name(v)}`") for v in free]) if free else bindings.limit(1).select()
    seed = F.md5(F.concat_ws("\u0001", F.lit(rule.id), *[F.col(f"`{name(v)}`") for v in free]))
    structs: list[Column] = []

    def made(t: Term) -> Column:
        if isinstance(t, str) and t.startswith("_:"):
            return F.concat(F.lit("_:"), F.md5(F.concat(seed, F.lit(t))))
        if isinstance(t, str) and t.startswith("F") and t[1:] in rule.formulas and rule.inside(t):
            gid = F.concat(F.lit(t[1:] + "."), seed)
            for st in rule.formulas[t[1:]].statements:
                structs.append(F.struct(gid.alias("g"), *[made(x).alias(c) for c, x in zip("spo", st)]))
            return F.concat(F.lit("F"), gid)
        if is_var(t) and name(t) not in bindings.columns:
            return F.lit(t)  # a variable of the quoted graph itself
        return column(t)

    for st in rule.head:
        if any(is_var(t) and name(t) not in bindings.columns for t in st):
            continue  # a variable that the body does not bind says nothing
        structs.append(F.struct(F.lit(graph).alias("g"), *[made(t).alias(c) for c, t in zip("spo", st)]))
    if not structs:
        return empty(bindings.sparkSession)
    return rows.select(F.inline(F.array(*structs))).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


Builtins = Callable[[DataFrame, Rule], dict[str, GraphBuiltin]]


def derive(rule: Rule, quads: DataFrame, delta: DataFrame | None = None, builtins: Builtins | None = None, graph: str = "", made: list | None = None) -> DataFrame:
    """What a rule concludes from quads; with delta only what needs a row of it. made: statements of rules, which all rows
    of delta are instances of, so that patterns that none of them may match need not be tried."""
    spark = quads.sparkSession
    late = builtins(quads, rule) if builtins else {}
    stored = [i for i, p in enumerate(rule.body) if not is_builtin(p) and not (isinstance(p[1], str) and p[1] in late)]
    if delta is None or not stored:
        return conclude(solve(spark, rule.body, lambda i: quads, graph, graph_builtins=late), rule, graph)
    out = None
    for k in stored:
        if made is not None and not any(may_match(h, rule.body[k]) for h in made):
            continue
        part = conclude(solve(spark, rule.body, lambda i, k=k: delta if i == k else quads, graph, graph_builtins=late), rule, graph)
        out = part if out is None else out.unionByName(part)
    return empty(spark) if out is None else out


def apply_rules(quads: DataFrame, rules: Iterable[Rule], builtins: Builtins | None = None) -> DataFrame:
    """One pass: rules in turn, each sees what those before it added."""
    for r in rules:
        quads = quads.unionByName(derive(r, quads, builtins=builtins)).distinct()
    return quads


def filter_rules(quads: DataFrame, rules: Iterable[Rule], builtins: Builtins | None = None) -> DataFrame:
    """One pass whose conclusions are the result."""
    out = None
    for r in rules:
        part = derive(r, quads, builtins=builtins)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else empty(quads.sparkSession)


def may_match(head: tuple, pattern: tuple) -> bool:
    """Whether an instance of a head's statement may match a pattern."""
    may = lambda x, y: not isinstance(x, str) or not isinstance(y, str) or is_var(x) or is_var(y) or x.startswith("_:") or x == y or x.startswith("F") and y.startswith("F")
    return all(may(x, y) for x, y in zip(head, pattern))


def feeds(a: Rule, b: Rule) -> bool:
    """Whether a statement of a's head may match a pattern of b's body."""
    return any(may_match(h, p) for h in a.head for p in b.body if not is_builtin(p)) or any(p[1] in (f"<{LOG}conclusion>", f"<{LOG}supports>") for p in b.body)


def fixed_predicates(heads: list) -> list[str] | None:
    """The predicates that instances of the heads have; None where that is open, as where they quote a graph, whose
    statements are rows of their own."""
    if any(not isinstance(t, str) or t.startswith("F") for h in heads for t in h):
        return None
    found = {p for _, p, _ in heads}
    return sorted(found) if all(p.startswith("<") for p in found) else None


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Strongly connected components of the rule graph, sources first (Tarjan's algorithm, iterative)."""
    after = [[j for j, b in enumerate(rules) if feeds(a, b)] for a in rules]
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    out: list[list[Rule]] = []
    for root in range(len(rules)):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while work:
            v, it = work[-1]
            w = next(it, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        if part[-1] == v:
                            break
                    out.append([rules[i] for i in sorted(part)])
            elif w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                work.append((w, iter(after[w])))
            elif w in stack:
                low[v] = min(low[v], index[w])
    return out[::-1]


def think(quads: DataFrame, rules: list[Rule], builtins: Builtins | None = None, most_rounds: int = 1000) -> DataFrame:
    """quads with all that the rules conclude from it, to the fixpoint."""
    spark = quads.sparkSession
    path = new_path(spark, "think")
    quads.select("g", "s", "p", "o").distinct().write.parquet(f"{path}/0")
    parts = [f"{path}/0"]
    rounds = 0

    def known() -> DataFrame:
        return spark.read.schema(QUADS).parquet(*parts)

    def keep(found: DataFrame, heads: list) -> DataFrame | None:
        """The rows that are not known yet, written; None if there are none. They are instances of the heads, so only
        known rows with predicates of those can be the same."""
        nonlocal rounds
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"no fixpoint in {most_rounds} rounds")
        part = f"{path}/{rounds}"
        only = fixed_predicates(heads)
        same = known() if only is None else known().where(F.col("p").isin(only))
        found.join(same, ["g", "s", "p", "o"], "left_anti").write.parquet(part)
        new = spark.read.schema(QUADS).parquet(part)
        if new.isEmpty():
            return None
        parts.append(part)
        if len(parts) > 16:
            # Fewer files to list and a shorter plan for the rounds to come.
            known().write.parquet(f"{path}/to{rounds}")
            parts[:] = [f"{path}/to{rounds}"]
            release(spark)
        return new

    def union(rs: list[Rule], delta: DataFrame | None, heads: list) -> DataFrame:
        out = None
        for r in rs:
            one = derive(r, known(), delta, builtins, made=heads)
            out = one if out is None else out.unionByName(one)
        return out.distinct()

    for part in strata(list(rules)):
        heads = [h for r in part for h in r.head]
        delta = keep(union(part, None, heads), heads)
        cyclic = len(part) > 1 or feeds(part[0], part[0])
        while delta is not None and cyclic:
            delta = keep(union(part, delta, heads), heads)
    return known()


def think_delta(known: DataFrame, delta: DataFrame, rules: list[Rule], builtins: Builtins | None = None, most_rounds: int = 1000) -> DataFrame:
    """delta and all that the rules conclude from it together with `known`, which is closed already; without known. Raises
    when the rounds run out, as think does."""
    spark = known.sparkSession
    path = new_path(spark, "delta")
    delta.write.parquet(f"{path}/0")
    parts = [f"{path}/0"]
    table = lambda ps: spark.read.schema(QUADS).parquet(*ps)
    now = table(parts)
    for k in range(1, most_rounds + 1):
        everything = known.unionByName(table(parts))
        out = None
        for r in rules:
            one = derive(r, everything, now, builtins)
            out = one if out is None else out.unionByName(one)
        if out is None:
            break
        out.distinct().join(everything, ["g", "s", "p", "o"], "left_anti").write.parquet(f"{path}/{k}")
        now = table([f"{path}/{k}"])
        if now.isEmpty():
            break
        parts.append(f"{path}/{k}")
        if len(parts) > 16:
            table(parts).write.parquet(f"{path}/to{k}")
            parts = [f"{path}/to{k}"]
            release(spark)
    else:
        raise RuntimeError(f"no fixpoint in {most_rounds} rounds")
    return table(parts)
