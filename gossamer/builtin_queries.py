"""A query for each namespace of built-ins, over columns of the tables, and the same in SQL.

A case is (column, predicate, form, arguments, SQL). The arguments are built from SQL expressions over the family's
columns, which Spark and DuckDB read alike; the form says which side of the predicate is computed.
"""

from __future__ import annotations

import os
import random
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.functions import library, rsa
from gossamer.functions.registry import Arg, get

FN = "http://www.w3.org/2006/xpath-functions#"


def V(sql: str) -> Arg:
    """A plain literal."""
    return Arg(T.c_lit(F.expr(sql).cast("string")))


def K(text: str) -> Arg:
    return Arg(T.c_lit(F.lit(text)))


def N(sql: str, kind: str = "integer") -> Arg:
    return Arg(T.c_xsd(F.expr(sql), kind))


def D(sql: str) -> Arg:
    return Arg(T.c_xsd(F.expr(f"CAST({sql} AS DOUBLE)"), "double"))


def I(sql: str) -> Arg:  # noqa: E743
    return Arg(T.c_iri(F.expr(sql)))


def L(*items: Arg) -> Arg:
    return Arg(items=list(items))


def S(*items: Arg) -> Arg:
    return Arg(T.c_set(F.array(*[i.c for i in items])))


def joined(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(T.c_lex(x), x)), ", "), F.lit("]"))


def rounded(c: Column) -> Column:
    return F.round(T.c_lex(c).cast("double"), 6) + F.lit(0.0)


#: What a column of the result shows of the term.
SHOWN: dict[str, Callable[[Column], Column]] = {
    "test": lambda c: c,
    "text": T.c_lex,
    "number": rounded,
    "term": lambda c: c,
    "uri": T.c_uri,
    "items": lambda c: joined(T.c_items(c)),
    "many": joined,
}


def predicate(name: str):
    prefix, _, local = name.partition(":")
    space = {"fn": FN, "log": T.LOG, "rdf": T.RDF, "sparql": T.SWAP + "sparqlCwm#"}.get(prefix, f"{T.SWAP}{prefix}#")
    return get(f"<{space}{local}>")


def computed(name: str, form: str, args: tuple[Arg, ...]) -> Column:
    """form: test, or fwd, rev, fwd_many, rev_many with how to show the result, as in 'fwd text'."""
    way, _, show = form.partition(" ")
    value = getattr(predicate(name), way)(*args)
    return SHOWN[show or way](value)


class Family:
    def __init__(self, name: str, table: str, key: str, columns: dict[str, str], cases: list[tuple]):
        self.name, self.table, self.key, self.columns, self.cases = name, table, key, columns, cases

    def run(self, spark, sf_dir: str):
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(f"{self.key} AS k", *[f"{sql} AS {c}" for c, sql in self.columns.items()])
        return rows.select("k", *[computed(p, form, args()).alias(c) for c, p, form, args, _ in self.cases])

    @property
    def sql(self) -> str:
        columns = ", ".join(f"{sql} AS {c}" for c, sql in self.columns.items())
        return f"SELECT k, {', '.join(f'{sql} AS {c}' for c, _, _, _, sql in self.cases)} FROM (SELECT {self.key} AS k, {columns} FROM {self.table})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shown(*items: str) -> str:
    """SQL of a list as it is shown."""
    return "'[' || " + " || ', ' || ".join(f"({i})::VARCHAR" for i in items) + " || ']'"


PART = {"a": "p_name", "b": "p_brand", "t": "p_type", "n": "p_size", "m": "p_partkey % 17 - 8"}

STRING = Family("string_builtins", "part", "p_partkey", PART, [
    ("gt", "string:greaterThan", "test", lambda: (V("a"), V("t")), "a > t"),
    ("ngt", "string:notGreaterThan", "test", lambda: (V("a"), V("t")), "a <= t"),
    ("lt", "string:lessThan", "test", lambda: (V("a"), V("t")), "a < t"),
    ("nlt", "string:notLessThan", "test", lambda: (V("a"), V("t")), "a >= t"),
    ("starts", "string:startsWith", "test", lambda: (V("t"), K("S")), "starts_with(t, 'S')"),
    ("ends", "string:endsWith", "test", lambda: (V("a"), K("e")), "suffix(a, 'e')"),
    ("holds", "string:contains", "test", lambda: (V("a"), K("e")), "contains(a, 'e')"),
    ("holds_any_case", "string:containsIgnoringCase", "test", lambda: (V("t"), K("sTe")), "contains(lower(t), 'ste')"),
    ("holds_roughly", "string:containsRoughly", "test", lambda: (V("t || '  x'"), V("upper(substr(t, 3)) || ' X'")), "contains(regexp_replace(lower(t || '  x'), '[ \\t\\r\\n]+', ' ', 'g'), regexp_replace(lower(substr(t, 3) || ' x'), '[ \\t\\r\\n]+', ' ', 'g'))"),
    ("lacks", "string:doesNotContain", "test", lambda: (V("a"), K("a")), "NOT contains(a, 'a')"),
    ("same_any_case", "string:equalIgnoringCase", "test", lambda: (V("upper(b)"), V("b")), "true"),
    ("other_any_case", "string:notEqualIgnoringCase", "test", lambda: (V("a"), V("upper(b)")), "lower(a) <> lower(b)"),
    ("concat_rev", "string:concat", "rev text", lambda: (L(V("a"), K("/"), V("b")),), "a || '/' || b"),
    ("concat_iri", "string:concat", "rev text", lambda: (L(V("a"), I("b")),), "NULL"),
    ("concatenation", "string:concatenation", "fwd text", lambda: (L(V("a"), N("n")),), "a || n"),
    ("scrape", "string:scrape", "fwd text", lambda: (L(V("b"), K("#([0-9]+)")),), "CASE WHEN regexp_matches(b, '#([0-9]+)') THEN regexp_extract(b, '#([0-9]+)', 1) END"),
    ("search", "string:search", "fwd items", lambda: (L(V("t"), K("([A-Z]+) ([A-Z]+)")),), "CASE WHEN regexp_matches(t, '([A-Z]+) ([A-Z]+)') THEN " + shown("regexp_extract(t, '([A-Z]+) ([A-Z]+)', 1)", "regexp_extract(t, '([A-Z]+) ([A-Z]+)', 2)") + " END"),
    ("split_once", "string:split", "fwd items", lambda: (L(V("t"), K(" "), N("1")),), "CASE WHEN contains(t, ' ') THEN " + shown("split_part(t, ' ', 1)", "substr(t, instr(t, ' ') + 1)") + " ELSE '[' || t || ']' END"),
    ("split_all", "string:split", "fwd items", lambda: (L(V("t"), K(" "), N("0")),), "'[' || replace(t, ' ', ', ') || ']'"),
    ("characters", "string:stringToList", "fwd items", lambda: (V("b"),), "'[' || array_to_string(string_split(b, ''), ', ') || ']'"),
    ("characters_rev", "string:stringToList", "rev text", lambda: (L(V("a"), V("b")),), "a || b"),
    ("format", "string:format", "fwd text", lambda: (L(K("%s is %d"), V("a"), N("n")),), "a || ' is ' || n"),
    ("matches", "string:matches", "test", lambda: (V("t"), K("E.*")), "regexp_matches(t, 'E.*')"),
    ("differs", "string:notMatches", "test", lambda: (V("t"), K("^S")), "NOT regexp_matches(t, '^S')"),
    ("data", "string:xmlEscapeData", "fwd text", lambda: (V("a || '<&>'"),), "a || '&#60;&#38;&#62;'"),
    ("attribute", "string:xmlEscapeAttribute", "fwd text", lambda: (V("a || '<&>'''"),), "a || '&#60;&#38;&#62;&#39;'"),
    ("for_uri", "string:encodeForURI", "fwd text", lambda: (V("a || ' /é!'"),), "replace(a, ' ', '%20') || '%20%2F%C3%A9!'"),
    ("for_fragment", "string:encodeForFragID", "fwd text", lambda: (V("a || ' /é'"),), "replace(a, ' ', '%20') || '%20/%C3%A9'"),
])

XPATH = Family("fn_builtins", "part", "p_partkey", PART, [
    ("starts", "fn:starts-with", "test", lambda: (V("t"), K("S")), "starts_with(t, 'S')"),
    ("ends", "fn:ends-with", "test", lambda: (V("a"), K("e")), "suffix(a, 'e')"),
    ("holds", "fn:contains", "test", lambda: (V("a"), K("e")), "contains(a, 'e')"),
    ("matches", "fn:matches", "test", lambda: (V("t"), K("E.*D$")), "regexp_matches(t, 'E.*D$')"),
    ("concat", "fn:concat", "fwd text", lambda: (L(V("a"), V("b"), N("n")),), "a || b || n"),
    ("tokens", "fn:tokenize", "fwd items", lambda: (L(V("t"), K(" ")),), "'[' || replace(t, ' ', ', ') || ']'"),
    ("tidy", "fn:normalize-space", "fwd text", lambda: (V("'  ' || t || '  x '"),), "trim(regexp_replace(t, '\\s+', ' ', 'g')) || ' x'"),
    ("resolved", "fn:resolve-uri", "fwd text", lambda: (L(V("'x' || n"), K("http://e.org/a/b")),), "'http://e.org/a/x' || n"),
    ("from_points", "fn:codepoints-to-string", "fwd text", lambda: (L(N("65 + n % 26"), N("97")),), "chr(65 + n % 26) || 'a'"),
    ("from_points_rev", "fn:codepoints-to-string", "rev items", lambda: (V("'é' || n % 10"),), "'[233, ' || (48 + n % 10) || ']'"),
    ("points", "fn:string-to-codepoints", "fwd items", lambda: (V("b"),), "'[' || array_to_string(list_transform(string_split(b, ''), lambda c: unicode(c)), ', ') || ']'"),
    ("points_rev", "fn:string-to-codepoints", "rev text", lambda: (L(N("65 + n % 26"), N("98")),), "chr(65 + n % 26) || 'b'"),
    ("compare", "fn:compare", "fwd text", lambda: (L(V("a"), V("t")),), "CASE WHEN a < t THEN '-1' WHEN a > t THEN '1' ELSE '0' END"),
    ("same_points", "fn:codepoint-equal", "fwd text", lambda: (L(V("substr(b, 1, 7)"), K("Brand#1")),), "(substr(b, 1, 7) = 'Brand#1')::VARCHAR"),
    ("string_join", "fn:string-join", "fwd text", lambda: (L(L(V("a"), V("b"), V("t")), K("-")),), "a || '-' || b || '-' || t"),
    ("substring", "fn:substring", "fwd text", lambda: (L(V("a"), N("2"), N("3")),), "substr(a, 2, 3)"),
    ("substring_rest", "fn:substring", "fwd text", lambda: (L(V("a"), N("3")),), "substr(a, 3)"),
    ("substring_before_start", "fn:substring", "fwd text", lambda: (L(V("a"), N("0"), N("3")),), "substr(a, 1, 2)"),
    ("string_length", "fn:string-length", "fwd text", lambda: (V("a"),), "length(a)::VARCHAR"),
    ("composed", "fn:normalize-unicode", "fwd text", lambda: (L(V("a || 'é'"), K("NFC")),), "a || 'é'"),
    ("up", "fn:upper-case", "fwd text", lambda: (V("a"),), "upper(a)"),
    ("low", "fn:lower-case", "fwd text", lambda: (V("t"),), "lower(t)"),
    ("translate", "fn:translate", "fwd text", lambda: (L(V("b"), K("Bd"), K("b")),), "translate(b, 'Bd', 'b')"),
    ("for_uri", "fn:encode-for-uri", "fwd text", lambda: (V("a || ' /é~'"),), "replace(a, ' ', '%20') || '%20%2F%C3%A9~'"),
    ("for_uri_rev", "fn:encode-for-uri", "rev text", lambda: (V("b || '%20%C3%A9'"),), "b || ' é'"),
    ("iri_to_uri", "fn:iri-to-uri", "fwd text", lambda: (V("'http://e.org/' || a || 'é'"),), "'http://e.org/' || replace(a, ' ', '%20') || '%C3%A9'"),
    ("html_uri", "fn:escape-html-uri", "fwd text", lambda: (V("'http://e.org/' || a || 'é'"),), "'http://e.org/' || a || '%C3%A9'"),
    ("before", "fn:substring-before", "fwd text", lambda: (L(V("b"), K("#")),), "split_part(b, '#', 1)"),
    ("before_none", "fn:substring-before", "fwd text", lambda: (L(V("b"), K("?")),), "''"),
    ("after", "fn:substring-after", "fwd text", lambda: (L(V("b"), K("#")),), "substr(b, instr(b, '#') + 1)"),
    ("replaced", "fn:replace", "fwd text", lambda: (L(V("a"), K("[aeiou]"), K("_")),), "regexp_replace(a, '[aeiou]', '_', 'g')"),
    ("absolute", "fn:abs", "fwd text", lambda: (N("m"),), "abs(m)::VARCHAR"),
    ("rounds", "fn:round", "fwd number", lambda: (D("m / 4.0"),), "round(sign(m) * floor(abs(m / 4.0) + 0.5), 6) + 0.0"),
    ("ceils", "fn:ceiling", "fwd number", lambda: (D("m / 4.0"),), "ceil(m / 4.0)::DOUBLE + 0.0"),
    ("floors", "fn:floor", "fwd number", lambda: (D("m / 4.0"),), "floor(m / 4.0)::DOUBLE + 0.0"),
    ("half_even", "fn:round-half-to-even", "fwd number", lambda: (D("m / 2.0"),), "CASE WHEN (m % 4 + 4) % 4 = 1 THEN (m - 1) / 2.0 WHEN (m % 4 + 4) % 4 = 3 THEN (m + 1) / 2.0 ELSE m / 2.0 END::DOUBLE + 0.0"),
    ("abs_of_text", "fn:abs", "fwd text", lambda: (V("a"),), "NULL"),
])


def arithmetic(prefix: str) -> list[tuple]:
    """The cases that numbers and numbers written as strings have in common."""
    n, m = ("n", "m")
    num = N if prefix == "math" else V
    p = f"{prefix}:"
    modulo = "CASE WHEN m <> 0 THEN ((n % m + m) % m)::VARCHAR END"
    quotient = "CASE WHEN m <> 0 THEN round(n / m::DOUBLE, 6) END"
    return [
        ("size", p + "absoluteValue", "fwd text", lambda: (num(m),), "abs(m)::VARCHAR"),
        ("near", p + "rounded", "fwd number", lambda: (D("m / 4.0") if prefix == "math" else V("CAST(m / 4.0 AS DOUBLE)"),), "round(sign(m) * floor(abs(m / 4.0) + 0.5), 6) + 0.0"),
        ("total", p + "sum", "fwd text", lambda: (L(num(n), num(m), num("7")),), "(n + m + 7)::VARCHAR"),
        ("total_rev", p + "sumOf", "rev text", lambda: (L(num(n), num(m)),), "(n + m)::VARCHAR"),
        ("nothing", p + "sum", "fwd text", lambda: (L(num(n), V("a")),), "NULL"),
        ("less", p + "difference", "fwd text", lambda: (L(num(n), num(m)),), "(n - m)::VARCHAR"),
        ("less_rev", p + "differenceOf", "rev text", lambda: (L(num(n), num(m)),), "(n - m)::VARCHAR"),
        ("times", p + "product", "fwd text", lambda: (L(num(n), num(m), num("3")),), "(n * m * 3)::VARCHAR"),
        ("times_rev", p + "factors", "rev text", lambda: (L(num(n), num(m)),), "(n * m)::VARCHAR"),
        ("part", p + "quotient", "fwd number", lambda: (L(num(n), num(m)),), quotient),
        ("part_rev", p + "quotientOf", "rev number", lambda: (L(num(n), num(m)),), quotient),
        ("whole", p + "integerQuotient", "fwd text", lambda: (L(num(m), num("7")),), "floor(m / 7.0)::BIGINT::VARCHAR"),
        ("rest", p + "remainder", "fwd text", lambda: (L(num(n), num(m)),), modulo),
        ("rest_rev", p + "remainderOf", "rev text", lambda: (L(num(n), num(m)),), modulo),
        ("minus", p + "negation", "fwd text", lambda: (num(m),), "(-m)::VARCHAR"),
        ("minus_rev", p + "negation", "rev text", lambda: (num(m),), "(-m)::VARCHAR"),
        ("cube", p + "exponentiation", "fwd text", lambda: (L(num(n), num("3")),), "(n * n * n)::VARCHAR"),
        ("cube_rev", p + "exponentiationOf", "rev text", lambda: (L(num(n), num("3")),), "(n * n * n)::VARCHAR"),
        ("members", p + "memberCount", "fwd text", lambda: (L(num(n), num(m), V("a")),), "'3'"),
        ("gt", p + "greaterThan", "test", lambda: (num(n), num("25")), "n > 25"),
        ("ngt", p + "notGreaterThan", "test", lambda: (num(n), num("25")), "n <= 25"),
        ("lt", p + "lessThan", "test", lambda: (num(m), num("3")), "m < 3"),
        ("nlt", p + "notLessThan", "test", lambda: (num(m), num("3")), "m >= 3"),
        ("eq", p + "equalTo", "test", lambda: (num(m), D("5")), "m = 5"),
        ("ne", p + "notEqualTo", "test", lambda: (num(m), D("5")), "m <> 5"),
        ("of_text", p + "lessThan", "test", lambda: (num(m), V("a")), "NULL::BOOLEAN"),
    ]


NUMBERS = Family("math_builtins", "part", "p_partkey", PART, [
    *arithmetic("math"),
    ("bit", "math:bit", "fwd text", lambda: (L(N("n"), N("2")),), "((n >> 2) & 1)::VARCHAR"),
])
STRING_NUMBERS = Family("maths_builtins", "part", "p_partkey", PART, arithmetic("maths"))

ANGLES = Family("trig_builtins", "part", "p_partkey", PART | {"u": "p_partkey % 19 / 10.0 - 0.9"}, [
    ("atan2", "math:atan2", "fwd number", lambda: (L(D("m"), N("3")),), "round(atan2(m, 3), 6) + 0.0"),
    ("cos", "math:cos", "fwd number", lambda: (D("u"),), "round(cos(u), 6) + 0.0"),
    ("cos_rev", "math:cos", "rev number", lambda: (D("u"),), "round(acos(u), 6) + 0.0"),
    ("cosh", "math:cosh", "fwd number", lambda: (D("u"),), "round((exp(u) + exp(-u)) / 2, 6) + 0.0"),
    ("degrees", "math:degrees", "fwd number", lambda: (D("u"),), "round(degrees(u), 6) + 0.0"),
    ("degrees_rev", "math:degrees", "rev number", lambda: (D("u"),), "round(radians(u), 6) + 0.0"),
    ("sin", "math:sin", "fwd number", lambda: (D("u"),), "round(sin(u), 6) + 0.0"),
    ("sin_rev", "math:sin", "rev number", lambda: (D("u"),), "round(asin(u), 6) + 0.0"),
    ("sinh", "math:sinh", "fwd number", lambda: (D("u"),), "round((exp(u) - exp(-u)) / 2, 6) + 0.0"),
    ("tan", "math:tan", "fwd number", lambda: (D("u"),), "round(tan(u), 6) + 0.0"),
    ("tan_rev", "math:tan", "rev number", lambda: (D("u"),), "round(atan(u), 6) + 0.0"),
    ("tanh", "math:tanh", "fwd number", lambda: (D("u"),), "round((exp(u) - exp(-u)) / (exp(u) + exp(-u)), 6) + 0.0"),
])


def moments(prefix: str) -> list[tuple]:
    p = f"{prefix}:"
    at = lambda: V("date_format(d, 'yyyy-MM-dd') || 'T10:20:30Z'")
    return [
        ("secs", p + "inSeconds", "fwd text", lambda: (at(),), "(epoch(date_trunc('day', d))::BIGINT + 37230)::VARCHAR"),
        ("secs_rev", p + "inSeconds", "rev text", lambda: (N("o_key * 1000"),), "strftime(make_timestamp(o_key * 1000000000), '%Y-%m-%dT%H:%M:%SZ')"),
        ("same", p + "equalTo", "test", lambda: (at(), V("date_format(d, 'yyyy-MM-dd') || 'T12:20:30+02:00'")), "true"),
        ("other", p + "equalTo", "test", lambda: (at(), V("date_format(d, 'yyyy-MM-dd')")), "false"),
        ("year", p + "year", "fwd text", lambda: (at(),), "year(d)::VARCHAR"),
        ("month", p + "month", "fwd text", lambda: (at(),), "month(d)::VARCHAR"),
        ("day", p + "day", "fwd text", lambda: (at(),), "day(d)::VARCHAR"),
        ("date", p + "date", "fwd text", lambda: (at(),), "strftime(d, '%Y-%m-%d')"),
        ("hour", p + "hour", "fwd text", lambda: (at(),), "'10'"),
        ("minute", p + "minute", "fwd text", lambda: (at(),), "'20'"),
        ("second", p + "second", "fwd text", lambda: (at(),), "'30'"),
        ("zone", p + "timeZone", "fwd text", lambda: (at(),), "'Z'"),
        ("no_zone", p + "timeZone", "fwd text", lambda: (V("date_format(d, 'yyyy-MM-dd')"),), "NULL"),
        ("week_day", p + "dayOfWeek", "fwd text", lambda: (at(),), "(isodow(d) - 1)::VARCHAR"),
        ("format", p + "format", "fwd text", lambda: (L(at(), K("%d/%m/%Y %H:%M")),), "strftime(d, '%d/%m/%Y') || ' 10:20'"),
        ("now_utc", p + "gmTime", "fwd text", lambda: (K("%% fixed"),), "'% fixed'"),
        ("now_here", p + "localTime", "fwd text", lambda: (K("%% fixed"),), "'% fixed'"),
        ("from_secs", p + "formatSeconds", "fwd text", lambda: (L(N("o_key * 1000"), K("%Y-%m-%d %H")),), "strftime(make_timestamp(o_key * 1000000000), '%Y-%m-%d %H')"),
        ("to_secs", p + "parseToSeconds", "fwd text", lambda: (L(V("date_format(d, 'dd/MM/yyyy')"), K("%d/%m/%Y")),), "epoch(date_trunc('day', d))::BIGINT::VARCHAR"),
    ]


ORDERS = {"d": "o_orderdate", "o_key": "o_orderkey"}
TIME = Family("time_builtins", "orders", "o_orderkey", ORDERS, moments("time"))
TIMES = Family("times_builtins", "orders", "o_orderkey", ORDERS, moments("times"))

NATION = {"a": "n_name", "r": "'n' || n_regionkey", "s": "'n' || (n_nationkey % 3)"}
COLLECTIONS = Family("collection_builtins", "nation", "n_nationkey", NATION, [
    ("first", "rdf:first", "fwd text", lambda: (L(V("a"), V("r")),), "a"),
    ("rest", "rdf:rest", "fwd items", lambda: (L(V("a"), V("r"), V("s")),), shown("r", "s")),
    ("rest_of_none", "rdf:rest", "fwd items", lambda: (L(),), "NULL"),
    ("last", "list:last", "fwd text", lambda: (L(V("a"), V("r")),), "r"),
    ("in_list", "list:in", "test", lambda: (V("r"), L(V("a"), V("s"))), "r = s"),
    ("in_list_rev", "list:in", "rev_many many", lambda: (L(V("a"), V("s"), V("a")),), shown("a", "s")),
    ("has_member", "list:member", "test", lambda: (L(V("a"), V("s")), V("r")), "r = s"),
    ("all_members", "list:member", "fwd_many many", lambda: (L(V("a"), V("s"), V("s")),), shown("a", "s")),
    ("append", "list:append", "fwd items", lambda: (L(L(V("a")), L(V("r"), V("s"))),), shown("a", "r", "s")),
    ("members", "list:members", "fwd items", lambda: (L(V("r"), V("s"), V("r")),), "CASE WHEN r = s THEN " + shown("r") + " ELSE " + shown("least(r, s)", "greatest(r, s)") + " END"),
    ("in_set", "set:in", "test", lambda: (V("r"), S(V("a"), V("s"))), "r = s"),
    ("in_set_rev", "set:in", "rev_many many", lambda: (S(V("s"), K("a")),), shown("'a'", "s")),
    ("set_member", "set:member", "test", lambda: (S(V("a"), V("s")), V("r")), "r = s"),
    ("set_members", "set:member", "fwd_many many", lambda: (S(V("s"), K("a")),), shown("'a'", "s")),
    ("union_", "set:union", "fwd items", lambda: (L(S(K("a")), S(V("s"))),), shown("'a'", "s")),
    ("common", "set:intersection", "fwd items", lambda: (L(S(K("a"), V("r")), S(K("a"), V("s"))),), "CASE WHEN r = s THEN " + shown("'a'", "r") + " ELSE '[a]' END"),
    ("either", "set:symmetricDifference", "fwd items", lambda: (L(S(K("a"), V("r")), S(V("s"))),), "CASE WHEN r = s THEN '[a]' ELSE " + shown("'a'", "least(r, s)", "greatest(r, s)") + " END"),
    ("minus", "set:difference", "fwd items", lambda: (L(S(K("a"), V("r")), S(V("s"))),), "CASE WHEN r = s THEN '[a]' ELSE " + shown("'a'", "r") + " END"),
    ("one_of", "set:oneOf", "rev items", lambda: (L(V("s"), K("a")),), shown("'a'", "s")),
])

INTEGER = T.XSD + "integer"
VALUES = Family("sparql_builtins", "part", "p_partkey", PART, [
    ("truth", "sparql:truthValue", "test", lambda: (N("n % 2"), Arg(F.lit(library.TRUE))), "n % 2 <> 0"),
    ("truth_of_text", "sparql:truthValue", "test", lambda: (V("a"), Arg(F.lit(library.TRUE))), "a <> ''"),
    ("eq", "sparql:equals", "test", lambda: (N("m"), D("5")), "m = 5"),
    ("eq_text", "sparql:equals", "test", lambda: (V("a"), V("a")), "true"),
    ("eq_error", "sparql:equals", "test", lambda: (V("a"), N("m")), "NULL::BOOLEAN"),
    ("eq_iri", "sparql:equals", "test", lambda: (I("'urn:' || m"), I("'urn:5'")), "m = 5"),
    ("ne", "sparql:notEquals", "test", lambda: (N("m"), D("5")), "m <> 5"),
    ("lt", "sparql:lessThan", "test", lambda: (N("m"), D("2.5")), "m < 2.5"),
    ("lt_text", "sparql:lessThan", "test", lambda: (V("a"), V("t")), "a < t"),
    ("lt_error", "sparql:lessThan", "test", lambda: (V("a"), N("m")), "NULL::BOOLEAN"),
    ("gt", "sparql:greaterThan", "test", lambda: (N("m"), N("n", "long")), "m > n"),
    ("ngt", "sparql:notGreaterThan", "test", lambda: (N("m"), N("3")), "m <= 3"),
    ("nlt", "sparql:notLessThan", "test", lambda: (N("m"), N("3")), "m >= 3"),
    ("dt_lit", "sparql:dtLit", "fwd term", lambda: (L(V("n"), I(q(INTEGER))),), f"'\"' || n || '\"^^<{INTEGER}>'"),
    ("dt_lit_rev", "sparql:dtLit", "rev items", lambda: (N("n"),), f"'[' || n || ', <{INTEGER}>]'"),
    ("lang_lit", "sparql:langLit", "fwd term", lambda: (L(V("a"), K("en")),), "'\"' || a || '\"@en'"),
    ("lang_lit_rev", "sparql:langLit", "rev items", lambda: (Arg(F.expr("'\"' || a || '\"@en'")),), shown("a", "'en'")),
    ("lame", "sparql:lamePred", "test", lambda: (V("a"), V("b")), "true"),
    ("log_eq", "log:equalTo", "test", lambda: (N("m"), N("5")), "m = 5"),
    ("log_ne", "log:notEqualTo", "test", lambda: (N("m"), N("5")), "m <> 5"),
    ("log_eq_fwd", "log:equalTo", "fwd text", lambda: (V("a"),), "a"),
    ("log_dtlit", "log:dtlit", "fwd term", lambda: (L(V("n"), I(q(INTEGER))),), f"'\"' || n || '\"^^<{INTEGER}>'"),
    ("log_uri", "log:uri", "fwd text", lambda: (I("'urn:' || n"),), "'urn:' || n"),
    ("log_uri_rev", "log:uri", "rev uri", lambda: (V("'urn:' || n"),), "'urn:' || n"),
    ("raw_uri", "log:rawUri", "fwd text", lambda: (I("'urn:' || n"),), "'urn:' || n"),
    ("raw_type", "log:rawType", "fwd uri", lambda: (V("a"),), q(T.LOG + "Literal")),
    ("raw_type_list", "log:rawType", "fwd uri", lambda: (L(V("a")),), q(T.LOG + "List")),
    ("raw_type_iri", "log:rawType", "fwd uri", lambda: (I("'urn:' || n"),), q(T.LOG + "Other")),
    ("stem", "log:racine", "fwd uri", lambda: (I("'urn:' || n || '#x'"),), "'urn:' || n"),
])

HERE = f"file://{os.getcwd()}/"
SYSTEM = Family("os_builtins", "nation", "n_nationkey", NATION, [
    ("home", "os:environ", "fwd text", lambda: (K("HOME"),), q(os.environ["HOME"]) if "HOME" in os.environ else "NULL"),
    ("none", "os:environ", "fwd text", lambda: (K("not in the list of names"),), "NULL"),
    ("absolute", "os:baseAbsolute", "fwd text", lambda: (V("'x/' || r"),), f"{q(HERE)} || 'x/' || r"),
    ("relative", "os:baseRelative", "fwd text", lambda: (V(f"'{HERE}x/' || r"),), "'x/' || r"),
    ("relative_rev", "os:baseRelative", "rev text", lambda: (V("r"),), f"{q(HERE)} || r"),
    ("argument", "os:argv", "fwd text", lambda: (N("99"),), "NULL"),
])

#: A key pair for the queries, from seeded numbers: of no use but here.
KEY = rsa.generated(256, random.Random(5).getrandbits)
SIGNED = lambda: Arg(predicate("crypto:sign").fwd(L(V("md5(a)"), K(KEY.text()))))
KEYS = Family("crypto_builtins", "nation", "n_nationkey", NATION, [
    ("md5", "crypto:md5", "fwd text", lambda: (V("a"),), "md5(a)"),
    ("sha", "crypto:sha", "fwd text", lambda: (V("a"),), "sha1(a)"),
    ("bits", "crypto:keyLength", "fwd text", lambda: (K(KEY.text()),), "'256'"),
    ("no_key", "crypto:keyLength", "fwd text", lambda: (V("a"),), "NULL"),
    ("public", "crypto:publicKey", "fwd text", lambda: (K(KEY.text()),), q(KEY.public.text())),
    ("verify", "crypto:verify", "test", lambda: (K(KEY.public.text()), L(V("md5(a)"), SIGNED())), "true"),
    ("verify_other", "crypto:verify", "test", lambda: (K(KEY.public.text()), L(V("md5(r)"), SIGNED())), "false"),
    ("verified", "crypto:verifyBoolean", "fwd text", lambda: (L(K(KEY.public.text()), V("md5(a)"), SIGNED()),), "'True'"),
    ("no_signature", "crypto:verifyBoolean", "fwd text", lambda: (L(K(KEY.public.text()), V("md5(a)"), V("a")),), "NULL"),
    ("public_does_not_sign", "crypto:sign", "fwd text", lambda: (L(V("md5(a)"), K(KEY.public.text())),), "NULL"),
])

DOCUMENT = "'<p:r xmlns:p=\"urn:p\" k=\"' || b || '\"><x>' || a || '</x><y/></p:r>'"
DOM = Family("xml_builtins", "part", "p_partkey", {"a": "p_name", "b": "p_brand"}, [
    ("kind", "xml:nodeType", "fwd text", lambda: (V(DOCUMENT),), "'1'"),
    ("parent", "xml:parentNode", "fwd text", lambda: (V(DOCUMENT),), "NULL"),
    ("attributes", "xml:attributes", "fwd items", lambda: (V(DOCUMENT),), shown("'xmlns:p'", "'urn:p'", "'k'", "b")),
    ("before", "xml:previousSibling", "fwd text", lambda: (V(DOCUMENT),), "NULL"),
    ("after", "xml:nextSibling", "fwd text", lambda: (V(DOCUMENT),), "NULL"),
    ("children", "xml:childNodes", "fwd items", lambda: (V(DOCUMENT),), shown("'<x>' || a || '</x>'", "'<y/>'")),
    ("first", "xml:firstChild", "fwd text", lambda: (V(DOCUMENT),), "'<x>' || a || '</x>'"),
    ("last", "xml:lastChild", "fwd text", lambda: (V(DOCUMENT),), "'<y/>'"),
    ("local", "xml:localName", "fwd text", lambda: (V(DOCUMENT),), "'r'"),
    ("prefix", "xml:prefix", "fwd text", lambda: (V(DOCUMENT),), "'p'"),
    ("space", "xml:namespaceURI", "fwd text", lambda: (V(DOCUMENT),), "'urn:p'"),
    ("name", "xml:nodeName", "fwd text", lambda: (V(DOCUMENT),), "'p:r'"),
    ("value", "xml:nodeValue", "fwd text", lambda: (V(DOCUMENT),), "a"),
    ("string", "fn:string", "fwd text", lambda: (V(DOCUMENT),), "a"),
    ("has_attributes", "xml:hasAttributes", "fwd text", lambda: (V(DOCUMENT),), "'true'"),
    ("has_children", "xml:hasChildNodes", "fwd text", lambda: (V("'<x k=\"' || b || '\"/>'"),), "'false'"),
    ("same", "xml:isSameNode", "test", lambda: (V(DOCUMENT), V(DOCUMENT)), "true"),
    ("path", "xml:xpath", "fwd_many many", lambda: (L(V(DOCUMENT), K("./x")),), shown("'<x>' || a || '</x>'")),
    ("at_path", "xml:xpath", "test", lambda: (L(V(DOCUMENT), K("./y")), Arg(library.xml_literal(F.lit("<y />")))), "true"),
    ("no_document", "xml:nodeName", "fwd text", lambda: (V("a"),), "NULL"),
])

FAMILIES = [STRING, XPATH, NUMBERS, STRING_NUMBERS, ANGLES, TIME, TIMES, COLLECTIONS, VALUES, SYSTEM, KEYS, DOM]
QUERIES = {f.name: f.run for f in FAMILIES}
ORACLE = {f.name: f.sql for f in FAMILIES}
