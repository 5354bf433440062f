"""Columns of bindings that know what they hold, so that native columns of tables need not become term strings.

A value is a term string, a native literal (number, text, time, boolean) or the key of an IRI with a fixed beginning.
Comparisons and joins stay on native columns while both sides are of one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.functions.library import NUMBERS, instant, ordered, same_value, truth
from gossamer.functions.registry import Arg


@dataclass(frozen=True)
class Val:
    col: Column
    sort: str  # term, num, str, time, bool, iri
    more: str | None = None  # datatype of a literal, beginning of an IRI

    def term(self) -> Column:
        if self.sort == "term":
            return self.col
        if self.sort == "iri":
            return F.concat(F.lit(f"<{self.more}"), self.col.cast("string"), F.lit(">"))
        if self.sort == "str":
            return T.c_lit(self.col, self.more)
        if self.sort == "bool":
            return T.c_boolean(self.col)
        if self.sort == "time":
            return T.c_lit(F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss"), self.more)
        return T.c_lit(self.col, self.more)

    def number(self) -> Column:
        if self.sort == "num":
            return self.col
        if self.sort == "term":
            return F.when(T.c_datatype(self.col).isin(*NUMBERS), T.c_number(self.col))
        return F.lit(None).cast("double")

    def text(self) -> Column:
        """STR(): the lexical form or the address."""
        if self.sort == "term":
            return T.c_text(self.col)
        if self.sort == "iri":
            return F.concat(F.lit(self.more), self.col.cast("string"))
        if self.sort == "time":
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss")
        return self.col.cast("string")

    def truth(self) -> Column:
        if self.sort == "bool":
            return self.col
        if self.sort == "num":
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.sort == "str":
            return F.length(self.col) > 0
        return truth(self.term())

    def kind(self) -> Column:
        if self.sort == "term":
            return T.c_kind(self.col)
        return F.when(self.col.isNotNull(), "IRI" if self.sort == "iri" else "LIT")

    def datatype(self) -> Column:
        if self.sort == "term":
            return F.when(T.is_literal(self.col), T.c_iri(F.coalesce(T.c_datatype(self.col), F.lit(T.XSD + "string"))))
        return F.when(self.col.isNotNull(), F.lit(T.iri(self.more or T.XSD + "string"))) if self.sort != "iri" else F.lit(None).cast("string")

    def lang(self) -> Column:
        if self.sort == "term":
            return F.when(T.is_literal(self.col), F.coalesce(T.c_lang(self.col), F.lit("")))
        return F.when(self.col.isNotNull(), "") if self.sort != "iri" else F.lit(None).cast("string")

    def like(self, other: Val) -> bool:
        """Whether native columns of the two can be compared for identity."""
        return self.sort == other.sort and self.more == other.more

    def output(self) -> Column:
        return self.text() if self.sort in ("iri", "time") else self.col


def constant(t: str) -> Val:
    """A term of a query, native where it has a native value."""
    if t.startswith('"'):
        lex, dt, lang = T.parts(t)
        if dt in NUMBERS:
            return Val(F.lit(float(lex) if dt.endswith(("double", "float", "decimal")) else int(lex)), "num", dt)
        if dt == T.XSD + "boolean":
            return Val(F.lit(lex in ("true", "1")), "bool", dt)
        if dt in (None, T.XSD + "string") and not lang:
            return Val(F.lit(lex), "str", dt)
        if dt == T.XSD + "dateTime":
            return Val(F.lit(lex).cast("timestamp_ntz"), "time", dt)
    return Val(F.lit(t), "term")


def same(a: Val, b: Val) -> Column:
    """Identity of terms, as a join condition."""
    return a.col == b.col if a.like(b) else a.term() == b.term()


OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a: Val, b: Val) -> Column:
    """SPARQL comparison; null where the types cannot be compared."""
    f = OPS[op]
    if a.sort == b.sort and a.sort in ("num", "str", "bool", "time") or a.sort == b.sort == "iri" and a.more == b.more and op in ("=", "!="):
        return f(a.col, b.col)
    if {a.sort, b.sort} == {"num", "term"}:
        return f(a.number(), b.number())
    if op in ("=", "!="):
        eq = same_value(a.term(), b.term())
        return eq if op == "=" else ~eq
    if {a.sort, b.sort} == {"time", "term"}:
        return f(*(instant(x.text()) for x in (a, b)))
    return ordered(f).test(Arg(a.term()), Arg(b.term()))
