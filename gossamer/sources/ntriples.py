"""N-Triples and N-Quads, read and written by all executors: a line is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer import terms as T

_NODE = r"(<[^<>\"{}|^`\\]*>|_:[^\s<>\"]+)"
_OBJECT = r'(<[^<>"{}|^`\\]*>|_:[^\s<>"]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^<>]*>|@[A-Za-z0-9-]+)?)'
LINE = rf"^\s*{_NODE}\s*(<[^<>]*>)\s*{_OBJECT}\s*(<[^<>]*>|_:[^\s<>\"]+)?\s*\.\s*(?:#.*)?$"


def unescaped(c: Column) -> Column:
    """A literal's text without its escapes. Code points are decoded by the JSON reader, which knows the same ones."""
    plain = ~c.contains("\\")
    json = F.regexp_replace(F.regexp_replace(c, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1"), r"\\'", "'")
    return F.when(plain, c).otherwise(F.from_json(F.concat(F.lit('["'), F.regexp_replace(json, "\t", r"\\t"), F.lit('"]')), "array<string>")[0])


def read(spark: SparkSession, path: str, tag: str = "") -> DataFrame:
    """(g, s, p, o); lines that are no statement are left out, as comments are. tag goes into blank nodes' names."""
    text = spark.read.text(path).select("value")
    part = lambda i: F.regexp_extract("value", LINE, i)
    rows = text.where(F.col("value").rlike(LINE)).select(part(4).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    blank = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit(f"_:{tag}"), F.substring(c, 3, 1 << 30))).otherwise(F.col(c))
    lex, rest = F.regexp_extract("o", r'(?s)^"(.*)"((?:\^\^|@).*)?$', 1), F.regexp_extract("o", r'(?s)^"(.*)"((?:\^\^|@).*)?$', 2)
    o = F.when(F.col("o").startswith('"'), F.concat(F.lit('"'), unescaped(lex), F.lit('"'), rest)).otherwise(blank("o"))
    g = F.regexp_replace("g", "^<(.*)>$", "$1")
    return rows.select(g.alias("g"), blank("s").alias("s"), "p", o.alias("o"))


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def term_text(c: Column) -> Column:
    """A term as N-Triples has it."""
    rest = F.substring(c, F.length(T.c_lex(c)) + 3, F.lit(1 << 30))
    return F.when(T.is_literal(c), F.concat(F.lit('"'), escaped(T.c_lex(c)), F.lit('"'), rest)).otherwise(c)


def lines(quads: DataFrame) -> DataFrame:
    """One text row a statement; only IRIs, blank nodes and literals can be written."""
    plain = quads
    for c, kinds in (("s", "^(<|_:)"), ("p", "^<"), ("o", '^(<|_:|")')):
        plain = plain.where(F.col(c).rlike(kinds))
    g = F.when(F.col("g") == "", "").otherwise(F.concat(F.lit("<"), "g", F.lit("> ")))
    return plain.select(F.concat(term_text(F.col("s")), F.lit(" "), "p", F.lit(" "), term_text(F.col("o")), F.lit(" "), g, F.lit(".")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    lines(quads).write.text(path)
