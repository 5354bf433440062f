"""Graph patterns over a table of quads (g, s, p, o) as joins.

Each pattern is a filtered, projected scan; patterns are joined on their shared variables, the most selective connected
one first; built-ins run as soon as their inputs are bound, graph built-ins (includes, semantics, ...) after all scans.
Rows of the result are bindings: one column of terms for each variable.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.registry import Arg, Builtin, get
from gossamer.terms import RDF, SAME_AS, Seq, Term, c_items, is_var, variables

Pattern = tuple[Term, Term, Term]
#: Built-ins that are also ordinary predicates of data: scanned unless their subject is a list pattern.
STORED = (f"<{RDF}first>", f"<{RDF}rest>", SAME_AS)


class Unbound(ValueError):
    """A built-in whose inputs no pattern binds."""


def name(v: str) -> str:
    return v[1:]


def column(t: Term) -> Column:
    """The term of a pattern position whose variables are columns."""
    return arg(t).c


def arg(t: Term) -> Arg:
    if isinstance(t, Seq):
        items = [arg(i) for i in t.items]
        if t.kind == "S":
            from gossamer.terms import c_set

            return Arg(c_set(F.array(*[i.c for i in items])))
        return Arg(items=items)
    return Arg(F.col(f"`{name(t)}`") if is_var(t) else F.lit(t))


def unify(df: DataFrame, value: Column, t: Term) -> DataFrame:
    """df with `value` matched against a pattern term: filters on what is bound, binds what is not."""
    if isinstance(t, Seq):
        tmp = f"__items{len(df.columns)}"
        items = F.when(value.startswith(t.kind + "["), c_items(value))
        df = df.withColumn(tmp, items).where(F.size(tmp) == len(t.items))
        if t.kind == "S":  # a set matches when a permutation does: members one by one
            return _unify_set(df, tmp, t)
        for i, item in enumerate(t.items):
            df = unify(df, F.get(F.col(tmp), F.lit(i)), item)
        return df.drop(tmp)
    if is_var(t) and name(t) not in df.columns:
        return df.withColumn(name(t), value).where(F.col(f"`{name(t)}`").isNotNull())
    return df.where(value == (F.col(f"`{name(t)}`") if is_var(t) else F.lit(t)))


def _unify_set(df: DataFrame, tmp: str, t: Seq) -> DataFrame:
    ground = [i for i in t.items if not variables(i)]
    for i in ground:
        df = df.where(F.array_contains(tmp, i)).withColumn(tmp, F.array_remove(F.col(tmp), i))
    for i in (i for i in t.items if variables(i)):
        df = df.withColumn("__m", F.explode(tmp)).withColumn(tmp, F.array_remove(F.col(tmp), F.col("__m")))
        df = unify(df, F.col("__m"), i).drop("__m")
    return df.drop(tmp)


def scan(quads: DataFrame, pattern: Pattern, graph: Term | None = "") -> DataFrame:
    """Bindings of one pattern. graph: an id, a variable, or None for any."""
    df = quads
    if graph is not None and not is_var(graph):
        df = df.where(F.col("g") == graph)
    for c, t in zip("spo", pattern):
        if not isinstance(t, Seq) and not is_var(t):
            df = df.where(F.col(c) == t)
    df = df.select(*[F.col(c).alias(f"__{c}") for c in ("g", "s", "p", "o")])
    if is_var(graph):
        df = unify(df, F.concat(F.lit("F"), F.col("__g")), graph)
    for c, t in zip("spo", pattern):
        if isinstance(t, Seq) or is_var(t):
            df = unify(df, F.col(f"__{c}"), t)
    return df.select(*[F.col(f"`{x}`") for x in df.columns if not x.startswith("__")])


def join(a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
    """Natural join of bindings."""
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        if how == "inner" and a.columns and b.columns:
            warnings.warn(f"nothing joins {', '.join(a.columns)} with {', '.join(b.columns)}: their rows are multiplied", stacklevel=2)
        return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
    return a.join(b, shared, how)


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).select()


def selectivity(p: Pattern, bound: set[str], counts: dict[str, int]) -> tuple:
    """Lower is better: patterns that touch bound variables, then few free positions, then rare predicates."""
    free = sum(bool(variables(t) - bound) for t in p)
    touches = any(variables(t) & bound for t in p)
    return (bool(bound) and not touches, free, counts.get(p[1], 1 << 40) if isinstance(p[1], str) else 1 << 41)


def is_builtin(p: Pattern) -> bool:
    if not isinstance(p[1], str) or is_var(p[1]) or get(p[1]) is None:
        return False
    return p[1] not in STORED or isinstance(p[0], Seq) or isinstance(p[0], str) and p[0][0] in "LS"


def ready(b: Builtin, s: Term, o: Term, bound: set[str]) -> bool:
    has_s, has_o = variables(s) <= bound, variables(o) <= bound
    return has_s and has_o or has_s and bool(b.fwd or b.fwd_many) or has_o and bool(b.rev or b.rev_many)


def run_builtin(df: DataFrame, b: Builtin, s: Term, o: Term) -> DataFrame:
    bound = {"?" + c for c in df.columns}
    has_s, has_o = variables(s) <= bound, variables(o) <= bound
    if has_s and has_o and b.test:
        return df.where(b.test(arg(s), arg(o)))
    if has_s and b.fwd:
        return _bind(df, b.fwd(arg(s)), o)
    if has_o and b.rev:
        return _bind(df, b.rev(arg(o)), s)
    if has_s and b.fwd_many:
        return unify(df.withColumn("__each", F.explode(b.fwd_many(arg(s)))), F.col("__each"), o).drop("__each")
    return unify(df.withColumn("__each", F.explode(b.rev_many(arg(o)))), F.col("__each"), s).drop("__each")


def _bind(df: DataFrame, value: Column, t: Term) -> DataFrame:
    if isinstance(t, Seq) and variables(t) - {"?" + c for c in df.columns}:
        return unify(df.withColumn("__value", value), F.col("__value"), t).drop("__value")
    if isinstance(t, Seq):
        return df.where(value == column(t))
    return unify(df, value, t)


GraphBuiltin = Callable[[DataFrame, Term, Term], DataFrame]


def solve(spark: SparkSession, patterns: list[Pattern], source: Callable[[int], DataFrame], graph: Term | None = "", start: DataFrame | None = None, graph_builtins: dict[str, GraphBuiltin] | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """Bindings of all patterns. source(i) is the quads table that pattern i is matched in."""
    late = graph_builtins or {}
    df = start
    heavy = [p for p in patterns if isinstance(p[1], str) and p[1] in late]
    light = [p for p in patterns if p not in heavy and is_builtin(p)]
    scans = [(i, p) for i, p in enumerate(patterns) if p not in heavy and p not in light]

    def bound() -> set[str]:
        return {"?" + c for c in df.columns} if df is not None else set()

    def settle() -> None:
        nonlocal df, light
        moved = True
        while moved:
            moved = False
            for p in light:
                b = get(p[1])
                if ready(b, p[0], p[2], bound()):
                    df = run_builtin(df if df is not None else one_row(spark), b, p[0], p[2])
                    light = [x for x in light if x is not p]
                    moved = True
                    break

    settle()
    while scans:
        i, p = min(scans, key=lambda x: selectivity(x[1], bound(), counts or {}))
        scans.remove((i, p))
        df = join(df, scan(source(i), p, graph))
        settle()
    while heavy:
        for p in heavy:
            if variables(p[0]) <= bound():
                break
        else:
            raise Unbound(f"nothing binds the subject of {heavy[0][1]}")
        heavy.remove(p)
        df = late[p[1]](df if df is not None else one_row(spark), p[0], p[2])
        settle()
    if light:
        # An input that nothing binds: no solutions.
        return functools.reduce(lambda d, v: d if name(v) in d.columns else d.withColumn(name(v), F.lit(None).cast("string")), sorted(set().union(*(variables(t) for p in light for t in p))), df if df is not None else one_row(spark)).where(F.lit(False))
    return df if df is not None else one_row(spark)
