"""Tables as graphs that are never written out.

A row of table t with key k is the subject `db/t#k.value`, a column c the predicate `db/t#c`, a foreign key the subject
of the row it points at. Patterns on one subject variable become one projected, filtered scan; variables that two
subjects share become joins on the key columns. Only a variable predicate makes a table into triples.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.plans.values import Val, constant, same
from gossamer.terms import is_var, variables

#: Types of native columns.
SORTS = {"tinyint": ("num", "int"), "smallint": ("num", "int"), "int": ("num", "int"), "bigint": ("num", "long"), "float": ("num", "float"), "double": ("num", "double"), "string": ("str", None), "boolean": ("bool", "boolean"), "timestamp": ("time", "dateTime"), "timestamp_ntz": ("time", "dateTime"), "date": ("time", "date")}


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]  # empty: a row is known by all its columns and a number among equals
    links: dict[str, str] = field(default_factory=dict)  # column to table

    @property
    def subject(self) -> str:
        return f"db/{self.name}#{'_'.join(self.key) or 'row'}."


#: Keys and links of the star schema.
SCHEMA = {
    t.name: t
    for t in (
        Table("region", ("r_regionkey",)),
        Table("nation", ("n_nationkey",), {"n_regionkey": "region"}),
        Table("customer", ("c_custkey",), {"c_nationkey": "nation"}),
        Table("supplier", ("s_suppkey",), {"s_nationkey": "nation"}),
        Table("part", ("p_partkey",)),
        Table("orders", ("o_orderkey",), {"o_custkey": "customer"}),
        Table("lineitem", (), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
        Table("events", ("event_id",)),
        Table("documents", ("doc_id",)),
        Table("labels", ("doc_id",)),
        Table("pages", ("page_id",)),
        Table("benchmark", ("item_id",)),
        Table("conversations", ("conv_id", "turn")),
    )
}


@dataclass
class Solutions:
    """Bindings: a frame and what each variable's column holds. `maybe`: variables that may be unbound."""

    df: DataFrame
    sorts: dict[str, tuple[str, str | None]]
    maybe: set[str] = field(default_factory=set)
    none: bool = False  # known to be without rows

    def val(self, v: str, prefix: str = "") -> Val:
        return Val(F.col(f"`{prefix}{v}`"), *self.sorts[v])

    def __contains__(self, v: str) -> bool:
        return v in self.sorts


def natural_join(a: Solutions, b: Solutions, how: str = "inner", condition=None) -> Solutions:
    """Join on shared variables; an unbound one agrees with anything. condition: of (variable to Val) for an outer join."""
    shared = [v for v in a.sorts if v in b.sorts]
    right = b.df.select(*[F.col(f"`{v}`").alias(f"__r_{v}") for v in b.sorts])
    on: list[Column] = []
    for v in shared:
        x, y = a.val(v), b.val(v, "__r_")
        eq = same(x, y)
        if v in a.maybe:
            eq = eq | x.col.isNull()
        if v in b.maybe:
            eq = eq | y.col.isNull()
        on.append(eq)
    if condition is not None:
        on.append(condition(lambda v: a.val(v) if v in a else b.val(v, "__r_") if v in b else None))
    if a.none or b.none and how == "inner":
        return a if a.none else Solutions(a.df.where(F.lit(False)), dict(a.sorts), set(a.maybe), True)
    if how in ("left_semi", "left_anti"):
        return Solutions(a.df.join(right, on or [F.lit(True)], how), dict(a.sorts), set(a.maybe))
    if not on and how == "inner" and a.sorts and b.sorts:
        warnings.warn(f"nothing joins {', '.join(a.sorts)} with {', '.join(b.sorts)}: their rows are multiplied", stacklevel=2)
    df = a.df.join(right, on, how) if on else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
    cols, sorts = [], {}
    for v in a.sorts:
        if v in shared and v in a.maybe:
            x, y = a.val(v), b.val(v, "__r_")
            both = (x, y) if x.like(y) else (Val(x.term(), "term"), Val(y.term(), "term"))
            cols.append(F.coalesce(both[0].col, both[1].col).alias(v))
            sorts[v] = (both[0].sort, both[0].more)
        else:
            cols.append(F.col(f"`{v}`"))
            sorts[v] = a.sorts[v]
    for v in b.sorts:
        if v not in a.sorts:
            cols.append(F.col(f"`__r_{v}`").alias(v))
            sorts[v] = b.sorts[v]
    maybe = {v for v in sorts if (v not in a or v in a.maybe) and (v not in b or v in b.maybe or how == "left" and v not in a)}
    maybe |= {v for v in b.sorts if v not in a and how == "left"}
    return Solutions(df.select(*cols), sorts, maybe)


def union(a: Solutions, b: Solutions) -> Solutions:
    """All rows of both; a variable that one does not have is unbound there."""
    if a.none or b.none:
        return b if a.none else a
    names = [*a.sorts, *[v for v in b.sorts if v not in a.sorts]]
    sorts = {}

    def column(s: Solutions, v: str) -> Column:
        if v not in s:
            return F.lit(None)
        return (s.val(v).col if (s.sorts[v]) == sorts[v] else s.val(v).term()).alias(v)

    for v in names:
        sorts[v] = a.sorts[v] if v not in b or v in a and a.sorts[v] == b.sorts[v] else b.sorts[v] if v not in a else ("term", None)
    cast = lambda s, o: [column(s, v).cast((o if v in o else s).df.schema[v].dataType if sorts[v][0] != "term" or v not in s or v not in o else "string").alias(v) for v in names]
    maybe = a.maybe | b.maybe | {v for v in names if v not in a or v not in b}
    return Solutions(a.df.select(*cast(a, b)).union(b.df.select(*cast(b, a))), sorts, maybe)


class Disconnected(ValueError):
    """Patterns that share no variable, where a product of their rows is not wanted."""


def discover(frames: dict[str, DataFrame]) -> dict[str, Table]:
    """Keys and links of tables. A key is the first column whose values are all there and all different; a column links to
    the table whose key has its type and, after the first underscore, its name. One pass over each table."""
    found: dict[str, Table] = {}
    for name, df in frames.items():
        whole = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "string")]
        counts = df.agg(F.count("*").alias("rows"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(whole[:1])]).first()
        found[name] = Table(name, (whole[0],) if whole and counts["rows"] == counts["n0"] else ())
    short = lambda c: c.partition("_")[2] or c
    keys = {(short(t.key[0]), frames[n].schema[t.key[0]].dataType): n for n, t in found.items() if t.key}
    return {n: Table(n, t.key, {f.name: keys[short(f.name), f.dataType] for f in frames[n].schema.fields if keys.get((short(f.name), f.dataType), n) != n}) for n, t in found.items()}


class VirtualGraph:
    """The graph of some tables: Parquet in a folder, or what `read` gives for a table's name, such as a table read
    through JDBC. connected: patterns that share no variable are refused instead of multiplied."""

    def __init__(self, spark: SparkSession, folder: str = "", schema: dict[str, Table] | None = None, read: Callable[[str], DataFrame] | None = None, connected: bool = False):
        self.spark, self.folder, self.schema, self.read, self.connected = spark, folder, schema or SCHEMA, read, connected

    @functools.cache  # noqa: B019
    def frame(self, table: str) -> DataFrame:
        return self.read(table) if self.read else self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def sort_of(self, table: Table, c: str) -> tuple[str, str | None]:
        if c in table.links:
            return "iri", SCHEMA[table.links[c]].subject if table.links[c] not in self.schema else self.schema[table.links[c]].subject
        sort, dt = SORTS.get(self.frame(table.name).schema[c].dataType.simpleString(), ("str", None))
        return sort, dt and T.XSD + dt

    def subject_column(self, table: Table) -> tuple[DataFrame, Column]:
        df = self.frame(table.name)
        if len(table.key) == 1:
            return df, F.col(table.key[0])
        if table.key:
            return df, F.concat_ws(".", *table.key)
        # Equal rows are different subjects: a number among them.
        row = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in df.columns]))
        df = df.withColumn("__row", row)
        return df.withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy("__row"))), F.concat_ws(".", "__row", F.col("__n").cast("string"))

    def table_of(self, predicate: str) -> tuple[Table, str] | None:
        name, _, c = predicate[1:-1].removeprefix("db/").partition("#")
        return (self.schema[name], c) if name in self.schema and c in self.frame(name).columns else None

    def graphs(self) -> list[str]:
        """Each table is a named graph."""
        return [f"db/{t}" for t in self.schema]

    def restricted(self, sources: list[str], named: list[str]) -> VirtualGraph:
        """The graph of the tables that FROM and FROM NAMED name."""
        wanted = {u.removeprefix("db/") for u in [*sources, *named]}
        return VirtualGraph(self.spark, self.folder, {n: t for n, t in self.schema.items() if n in wanted}, self.read, self.connected)

    def star(self, subject: str, patterns: list, needed: set[str], graph: str | None = None) -> Solutions | None:
        """Patterns of one subject with constant predicates; None where they are of no one table (of the graph)."""
        tables = {}
        for _, p, o in patterns:
            if p == T.TYPE:
                tables[o[1:-1].removeprefix("db/") if isinstance(o, str) else ""] = None
            elif (found := self.table_of(p)) is None:
                return None
            else:
                tables[found[0].name] = None
        if len(tables) != 1 or next(iter(tables)) not in self.schema or graph not in (None, f"db/{next(iter(tables))}"):
            return None
        table = self.schema[next(iter(tables))]
        df, key = (self.subject_column(table) if table.key or subject in needed or not is_var(subject) else (self.frame(table.name), None))
        sorts: dict[str, tuple] = {}
        cols: dict[str, Column] = {}
        where: list[Column] = []

        def bind(t: str, c: Column, sort: tuple) -> None:
            v = Val(c, *sort)
            if not is_var(t):
                k = self.iri_key(t, v) if sort[0] == "iri" else constant(t)
                where.append(F.lit(False) if k is None else c == k.col if sort[0] == "iri" or k.sort == sort[0] else v.term() == F.lit(t))
            elif t[1:] in cols:
                where.append(same(Val(cols[t[1:]], *sorts[t[1:]]), v))
            else:
                cols[t[1:]], sorts[t[1:]] = c, sort
                where.append(c.isNotNull())

        if key is not None and (not is_var(subject) or subject in needed):
            bind(subject, key, ("iri", table.subject))
        for _, p, o in patterns:
            if p != T.TYPE:
                c = self.table_of(p)[1]
                bind(o, F.col(c), self.sort_of(table, c))
        for w in where:
            df = df.where(w)
        return Solutions(df.select(*[c.alias(v) for v, c in cols.items()]), sorts)

    def iri_key(self, t: str, v: Val) -> Val | None:
        """The key inside an IRI of a subject, None where it is another's."""
        if not t.startswith(f"<{v.more}"):
            return None
        return Val(F.lit(t[1 + len(v.more) : -1]), "iri", v.more)

    def triples(self, table: str) -> DataFrame:
        """(g, s, p, o) of a table, one row for each value that is not null; g is `db/table`."""
        t = self.schema[table]
        df, key = self.subject_column(t)
        s = Val(key, "iri", t.subject).term()
        names = self.frame(table).columns
        pairs = [F.struct(F.lit(T.iri(f"db/{table}#{c}")).alias("p"), Val(F.col(c), *self.sort_of(t, c)).term().alias("o")) for c in names if df.schema[c].dataType.typeName() not in ("array", "map", "struct")]
        pairs.append(F.struct(F.lit(T.TYPE).alias("p"), F.lit(T.iri(f"db/{table}")).alias("o")))
        return df.select(F.lit(f"db/{table}").alias("g"), s.alias("s"), F.explode(F.array(*pairs)).alias("x")).select("g", "s", "x.p", "x.o").where("o IS NOT NULL")

    def bgp(self, patterns: list, needed: set[str], graph: str | None = None) -> Solutions:
        """Bindings of patterns; needed: variables used elsewhere."""
        from gossamer.operators.bgp import scan

        stars: dict[str, list] = {}
        for p in patterns:
            stars.setdefault(p[0], []).append(p)
        uses = lambda s: needed | set().union(*(variables(t) for k, ps in stars.items() if k != s for p in ps for t in p)) | {t for p in stars[s] for t in p[1:] if t == s}
        parts: list[Solutions] = []
        for s, ps in stars.items():
            fixed = [p for p in ps if not is_var(p[1])]
            found = self.star(s, fixed, uses(s) | ({s} if len(fixed) < len(ps) else set()), graph) if fixed else None
            if fixed and found is None:
                names = sorted({v[1:] for p in fixed for t in p for v in variables(t)})
                found = Solutions(self.spark.createDataFrame([], ", ".join(f"`{v}` string" for v in names) or "x int").select(*names), {v: ("term", None) for v in names}, none=True)
            if found:
                parts.append(found)
            for p in ps:
                if is_var(p[1]):
                    everything = functools.reduce(DataFrame.unionByName, (self.triples(t) for t in self.schema if graph in (None, f"db/{t}")))
                    df = scan(everything, p, None)
                    parts.append(Solutions(df, {c: ("term", None) for c in df.columns}))
        # Connected parts first, as they come.
        out = parts.pop(0)
        while parts:
            k = next((i for i, x in enumerate(parts) if any(v in out for v in x.sorts)), None)
            if k is None and self.connected:
                raise Disconnected(f"nothing joins {', '.join('?' + v for v in out.sorts)} with {', '.join('?' + v for v in parts[0].sorts)}")
            k = k or 0
            out = natural_join(out, parts.pop(k))
        return out


class QuadGraph:
    """A graph of quads as a source of SPARQL patterns."""

    def __init__(self, spark: SparkSession, quads: DataFrame, default: str | None = ""):
        self.spark, self.quads, self.default = spark, quads, default

    def restricted(self, sources: list[str], named: list[str]) -> QuadGraph:
        """FROM: the union of those graphs is the default graph; FROM NAMED: those are the named ones."""
        merged = self.quads.where(F.col("g").isin(*sources)).withColumn("g", F.lit("")).distinct() if sources else self.quads.where("g = ''")
        return QuadGraph(self.spark, merged.unionByName(self.quads.where(F.col("g").isin(*named))) if named else merged)

    def bgp(self, patterns: list, needed: set[str], graph: str | None = None) -> Solutions:
        from gossamer.operators.bgp import solve

        df = solve(self.spark, patterns, lambda i: self.quads, self.default if graph is None else graph)
        return Solutions(df, {c: ("term", None) for c in df.columns})
