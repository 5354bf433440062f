"""The built-ins, by namespace. Errors and unknown types are null: no match."""

from __future__ import annotations

import functools
import os
import sys
import unicodedata
from collections.abc import Callable
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions import rsa
from gossamer.functions.registry import Arg, Builtin, add
from gossamer.terms import LOG, RDF, SWAP, XSD, c_boolean, c_datatype, c_iri, c_kind, c_lang, c_lex, c_list, c_lit, c_number, c_set, c_text, c_uri, c_xsd, is_literal, let, literal, xsd

FN = ("http://www.w3.org/2006/xpath-functions#", "http://www.w3.org/2005/xpath-functions#")
WHOLE, EXACT = "decimal(38,0)", "decimal(38,18)"


def test(f) -> Builtin:
    return Builtin(test=f)


def fwd(f, rev=None) -> Builtin:
    return Builtin(fwd=f, rev=rev)


def rev(f) -> Builtin:
    return Builtin(rev=f)


def text_of(items: Column) -> Column:
    return F.transform(items, c_text)


def add_fn(**named: Builtin) -> None:
    for ns in FN:
        add(ns, **named)


def when_all(items: Column, ok, value: Column) -> Column:
    return F.when(F.forall(items, ok), value)


# log: and owl:

add(
    LOG,
    equalTo=Builtin(test=lambda s, o: s.c == o.c, fwd=lambda s: s.c, rev=lambda o: o.c),
    notEqualTo=test(lambda s, o: s.c != o.c),
    uri=fwd(lambda s: c_lit(c_uri(s.c)), lambda o: F.when(o.lex.contains(":"), c_iri(o.lex))),
    rawUri=fwd(lambda s: c_lit(F.coalesce(c_uri(s.c), s.c))),
    racine=fwd(lambda s: F.when(s.c.startswith("<"), c_iri(F.substring_index(c_uri(s.c), "#", 1)))),
    dtlit=fwd(lambda s: s.sized(2, F.concat(F.lit('"'), s.item(0).lex, F.lit('"^^'), F.when(s.item(1).c.startswith("<"), s.item(1).c)))),
    rawType=fwd(lambda s: functools.reduce(lambda out, kv: F.when(c_kind(s.c) == kv[0], f"<{LOG}{kv[1]}>").otherwise(out), {"LIT": "Literal", "FORMULA": "Formula", "LIST": "List", "SET": "Set", "BNODE": "Blank"}.items(), F.lit(f"<{LOG}Other>"))),
)

# string:

STRING = SWAP + "string#"


def lexical(op) -> Builtin:
    return test(lambda s, o: op(s.text, o.text))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[ \\t\\r\\n]+", " ")


def escaped(c: Column, characters: str) -> Column:
    # The ampersand first: the others bring ampersands in.
    for ch in sorted(characters, key=lambda x: x != "&"):
        c = F.replace(c, F.lit(ch), F.lit(f"&#{ord(ch)};"))
    return c


def first_groups(s: Arg) -> Column:
    text, pattern = s.item(0).text, s.item(1).text
    n = F.regexp_count(F.regexp_replace(pattern, F.lit(r"\\.|\[[^\]]*\]|\(\?"), F.lit("")), F.lit(r"\("))
    return F.when(F.regexp_like(text, pattern), F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: c_lit(F.call_function("regexp_extract", text, pattern, i))))


def kept(c: Column, safe: str) -> Column:
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for ch in safe:
        c = F.replace(c, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return c


@F.pandas_udf(T.StringType())
def _unicode_form(form: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or f is None else unicodedata.normalize(f.strip().upper() or "NFC", t) for f, t in zip(form, text)])


@F.pandas_udf(T.StringType())
def _joined_uri(ref: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or b is None else urljoin(b, r) for r, b in zip(ref, base)])


@F.pandas_udf(T.StringType())
def _ascii_uri(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else quote(t, safe="".join(map(chr, range(0x21, 0x7F)))))


@F.pandas_udf(T.StringType())
def _ascii_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else quote(t, safe="".join(map(chr, range(0x20, 0x7F)))))


@F.pandas_udf(T.StringType())
def _from_points(points: pd.Series) -> pd.Series:
    return points.map(lambda p: None if p is None or any(x is None or not 0 <= x < 0x110000 for x in p) else "".join(chr(int(x)) for x in p))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _points(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [ord(c) for c in t])


@F.pandas_udf(T.StringType())
def _formatted(items: pd.Series) -> pd.Series:
    def one(p):
        if p is None or any(x is None for x in p):
            return None
        args = [p[0], *[_python(x) for x in p[1:]]]
        try:
            return args[0] % tuple(args[1:])
        except (TypeError, ValueError):
            try:
                return args[0] % tuple(str(x) for x in args[1:])
            except (TypeError, ValueError):
                return None

    return items.map(one)


def _python(x: str):
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def split_text(s: Arg) -> Column:
    n = s.item(2).number.cast("int")
    parts = F.when(n > 0, F.call_function("split", s.item(0).text, s.item(1).text, n + 1)).otherwise(F.call_function("split", s.item(0).text, s.item(1).text, F.lit(-1)))
    return s.sized(3, c_list(F.transform(parts, lambda x: c_lit(x))))


def characters(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


add(
    STRING,
    greaterThan=lexical(lambda a, b: a > b),
    notGreaterThan=lexical(lambda a, b: a <= b),
    lessThan=lexical(lambda a, b: a < b),
    notLessThan=lexical(lambda a, b: a >= b),
    startsWith=lexical(lambda a, b: a.startswith(b)),
    endsWith=lexical(lambda a, b: a.endswith(b)),
    contains=lexical(lambda a, b: a.contains(b)),
    containsIgnoringCase=lexical(lambda a, b: F.lower(a).contains(F.lower(b))),
    containsRoughly=lexical(lambda a, b: squeezed(a).contains(squeezed(b))),
    doesNotContain=lexical(lambda a, b: ~a.contains(b)),
    equalIgnoringCase=lexical(lambda a, b: F.lower(a) == F.lower(b)),
    notEqualIgnoringCase=lexical(lambda a, b: F.lower(a) != F.lower(b)),
    concat=rev(lambda o: when_all(o.items, is_literal, c_lit(F.array_join(F.transform(o.items, c_lex), "")))),
    concatenation=fwd(lambda s: F.when(s.items.isNotNull(), c_lit(F.array_join(text_of(s.items), "")))),
    scrape=fwd(lambda s: s.sized(2, F.when(F.regexp_like(s.item(0).text, s.item(1).text), c_lit(F.call_function("regexp_extract", s.item(0).text, s.item(1).text, F.lit(1)))))),
    search=fwd(lambda s: s.sized(2, c_list(first_groups(s)))),
    split=fwd(split_text),
    stringToList=fwd(lambda s: c_list(F.transform(characters(s.lex), lambda x: c_lit(x))), lambda o: F.when(o.items.isNotNull(), c_lit(F.array_join(text_of(o.items), "")))),
    format=fwd(lambda s: c_lit(_formatted(text_of(s.items)))),
    matches=lexical(F.regexp_like),
    notMatches=lexical(lambda a, b: ~F.regexp_like(a, b)),
    xmlEscapeData=fwd(lambda s: c_lit(escaped(s.lex, "\r<>&"))),
    xmlEscapeAttribute=fwd(lambda s: c_lit(escaped(s.lex, "\r<>&'\"\n"))),
    encodeForURI=fwd(lambda s: c_lit(kept(s.lex, "#!~*'()"))),
    encodeForFragID=fwd(lambda s: c_lit(kept(s.lex, "/"))),
)

# fn: strings. XPath Functions and Operators semantics.

add_fn(
    starts_with=lexical(lambda a, b: a.startswith(b)),
    ends_with=lexical(lambda a, b: a.endswith(b)),
    contains=lexical(lambda a, b: a.contains(b)),
    matches=lexical(F.regexp_like),
    concat=fwd(lambda s: F.when(s.items.isNotNull(), c_lit(F.array_join(text_of(s.items), "")))),
    tokenize=fwd(lambda s: s.sized(2, c_list(F.transform(F.call_function("split", s.item(0).text, s.item(1).text, F.lit(-1)), lambda x: c_lit(x))))),
    normalize_space=fwd(lambda s: c_lit(F.trim(F.regexp_replace(s.lex, "\\s+", " ")))),
    resolve_uri=fwd(lambda s: s.sized(2, c_lit(_joined_uri(s.item(0).text, s.item(1).text)))),
    codepoints_to_string=fwd(lambda s: c_lit(_from_points(F.transform(s.items, lambda x: c_number(x).cast("int")))), lambda o: c_list(F.transform(_points(o.lex), lambda x: c_xsd(x, "integer")))),
    string_to_codepoints=fwd(lambda s: c_list(F.transform(_points(s.lex), lambda x: c_xsd(x, "integer"))), lambda o: c_lit(_from_points(F.transform(o.items, lambda x: c_number(x).cast("int"))))),
    compare=fwd(lambda s: s.sized(2, c_xsd(F.when(s.item(0).text < s.item(1).text, -1).when(s.item(0).text > s.item(1).text, 1).when(s.item(0).text == s.item(1).text, 0), "integer"))),
    codepoint_equal=fwd(lambda s: F.when(s.items.isNotNull(), c_boolean(F.size(F.array_distinct(text_of(s.items))) <= 1))),
    string_join=fwd(lambda s: s.sized(2, c_lit(F.call_function("array_join", text_of(s.item(0).items), s.item(1).text)))),
    substring=fwd(lambda s: c_lit(_xpath_substring(s))),
    string_length=fwd(lambda s: c_xsd(F.length(s.lex), "integer")),
    normalize_unicode=fwd(lambda s: s.sized(2, c_lit(_unicode_form(s.item(1).text, s.item(0).text)))),
    upper_case=fwd(lambda s: c_lit(F.upper(s.lex))),
    lower_case=fwd(lambda s: c_lit(F.lower(s.lex))),
    translate=fwd(lambda s: s.sized(3, c_lit(F.call_function("translate", s.item(0).text, s.item(1).text, s.item(2).text)))),
    encode_for_uri=fwd(lambda s: c_lit(kept(s.lex, "~")), lambda o: c_lit(F.try_url_decode(o.lex))),
    iri_to_uri=fwd(lambda s: c_lit(_ascii_uri(s.text))),
    escape_html_uri=fwd(lambda s: c_lit(_ascii_html(s.text))),
    substring_before=fwd(lambda s: s.sized(2, c_lit(F.when(s.item(0).text.contains(s.item(1).text), F.call_function("substring_index", s.item(0).text, s.item(1).text, F.lit(1))).otherwise(F.when(s.item(0).text.isNotNull(), ""))))),
    substring_after=fwd(lambda s: s.sized(2, c_lit(F.when(s.item(0).text.contains(s.item(1).text), F.substring(s.item(0).text, F.instr(s.item(0).text, s.item(1).text) + F.length(s.item(1).text), F.lit(1 << 30))).otherwise(F.when(s.item(0).text.isNotNull(), ""))))),
    replace=fwd(lambda s: s.sized(3, c_lit(F.regexp_replace(s.item(0).text, s.item(1).text, s.item(2).text)))),
)


def _xpath_substring(s: Arg) -> Column:
    """Characters whose position p has round(start) <= p < round(start) + round(length); all the rest without length."""
    text, start = s.item(0).text, F.round(s.item(1).number).cast("int")
    stop = F.when(F.size(s.items) >= 3, start + F.round(s.item(2).number).cast("int")).otherwise(F.lit(1 << 30))
    low = F.greatest(start, F.lit(1))
    return F.substring(text, low, F.greatest(stop - low, F.lit(0)))


# math: and fn: numbers


def rank_of(x: str) -> str:
    """SQL: 0 integer, 1 decimal, 2 double, by the lexical form x; null for what is no number."""
    return f"CASE WHEN try_cast({x} AS DOUBLE) IS NULL THEN NULL WHEN {x} RLIKE '[eE]|[nN][aA][nN]|[iI][nN][fF]' THEN 2 WHEN contains({x}, '.') THEN 1 ELSE 0 END"


def rank(c: Column) -> Column:
    return let(c_lex(c), rank_of("x"))


def typed(value: Column, r: str, whole: str, exact: str, approx: str) -> Column:
    """A number as an integer, a decimal or a double, by r; what is too large for the first two is a double. All are SQL
    of x, the value, which is computed once: numbers written as text would else be parsed for each mention."""
    tidy = "regexp_replace(regexp_replace(CAST(v.e AS STRING), r'(\\.\\d*?)0+$', '$1'), r'\\.$', '.0')"
    whole_ok, exact_ok, approx_ok = "v.r = 0 AND v.w IS NOT NULL", "v.r = 1 AND v.e IS NOT NULL", "v.r <= 1 OR v.r = 2 AND NOT isnan(v.a)"
    text = f"CASE WHEN {whole_ok} THEN CAST(v.w AS STRING) WHEN {exact_ok} THEN {tidy} WHEN {approx_ok} THEN CAST(v.a AS STRING) END"
    kind = f"CASE WHEN {whole_ok} THEN 'integer' WHEN {exact_ok} THEN 'decimal' ELSE 'double' END"
    parts = f"transform(array(named_struct('r', {r}, 'w', {whole}, 'e', {exact}, 'a', {approx})), v -> named_struct('text', {text}, 'kind', {kind}))[0]"
    made = let(value, f"transform(array({parts}), v -> named_struct('text', v.text, 'kind', v.kind, 'term', concat('\"', v.text, '\"^^<{XSD}', v.kind, '>')))[0]")
    return literal(made["term"], made["text"], lambda: F.when(made["text"].isNotNull(), F.concat(F.lit(XSD), made["kind"])))


#: Functions of two numbers in SQL, by type.
Two = Callable[[str, str, str], str]


def folded(items: Column, zero: int, op: Two) -> Column:
    def run(kind: str) -> str:
        return f"aggregate(transform(x, t -> try_cast(t AS {kind})), CAST({zero} AS {kind}), (p, t) -> {op('p', 't', kind)})"

    r = f"CASE WHEN x IS NOT NULL THEN aggregate(transform(x, t -> {rank_of('t')}), 0, (p, t) -> CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN greatest(p, t) END) END"
    return typed(F.transform(items, c_lex), r, run(WHOLE), run(EXACT), run("double"))


def _plus(a: str, b: str, kind: str) -> str:
    return f"try_cast(try_add({a}, {b}) AS {kind})"


def _times(a: str, b: str, kind: str) -> str:
    return f"try_cast(try_multiply({a}, {b}) AS {kind})"


def _minus(a: str, b: str, kind: str) -> str:
    return f"try_cast(try_subtract({a}, {b}) AS {kind})"


def _modulo(a: str, b: str, kind: str) -> str:
    """Remainder with the sign of the divisor."""
    return f"transform(array(try_mod({a}, {b})), m -> try_cast(CASE WHEN m <> 0 AND (m < 0) <> ({b} < 0) THEN m + {b} ELSE m END AS {kind}))[0]"


def pair(s: Arg, op: Two) -> Column:
    """op over two numbers, typed like the wider of the two."""
    a, b = rank_of("x[0]"), rank_of("x[1]")
    r = f"transform(array(named_struct('a', {a}, 'b', {b})), v -> CASE WHEN v.a IS NOT NULL AND v.b IS NOT NULL THEN greatest(v.a, v.b) END)[0]"
    kinds = (op(f"try_cast(x[0] AS {k})", f"try_cast(x[1] AS {k})", k) for k in (WHOLE, EXACT, "double"))
    return typed(s.sized(2, F.array(s.item(0).lex, s.item(1).lex)).cast("array<string>"), r, *kinds)


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


def one(s: Arg, op: str) -> Column:
    """op, SQL of a number {}, typed like it."""
    return typed(s.lex, rank_of("x"), *(op.format(f"try_cast(x AS {k})") for k in (WHOLE, EXACT, "double")))


def double(c: Column) -> Column:
    return c_xsd(F.nullif(c.cast("double"), F.lit(float("nan"))), "double")


def half_up(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def difference(s: Arg) -> Column:
    return pair(s, _minus)


def quotient(s: Arg) -> Column:
    return s.sized(2, double(F.try_divide(s.item(0).number, s.item(1).number)))


def integer_quotient(s: Arg) -> Column:
    return s.sized(2, c_xsd(_floor_div(s.item(0).lex.try_cast(EXACT), s.item(1).lex.try_cast(EXACT)).cast(WHOLE), "integer"))


def remainder(s: Arg) -> Column:
    return pair(s, _modulo)


def power(s: Arg) -> Column:
    a, b = s.item(0), s.item(1)
    p = F.pow(a.number, b.number)
    whole = (rank(a.c) == 0) & (rank(b.c) == 0) & (b.number >= 0) & (F.abs(p) < 2**53)
    return s.sized(2, F.when(whole, c_xsd(p.cast(WHOLE), "integer")).otherwise(double(p)))


def numeric(op) -> Builtin:
    return test(lambda s, o: op(s.number, o.number))


MATH, MATHS = SWAP + "math#", SWAP + "maths#"
COMPARE = {
    "greaterThan": lambda a, b: a > b,
    "notGreaterThan": lambda a, b: a <= b,
    "lessThan": lambda a, b: a < b,
    "notLessThan": lambda a, b: a >= b,
    "equalTo": lambda a, b: a == b,
    "notEqualTo": lambda a, b: a != b,
}
total = lambda a: folded(a.items, 0, _plus)
product = lambda a: folded(a.items, 1, _times)
negated = lambda a: one(a, "-{}")

add(
    MATH,
    absoluteValue=fwd(lambda s: one(s, "abs({})")),
    rounded=fwd(lambda s: double(half_up(s.number))),
    sum=fwd(total),
    sumOf=rev(total),
    difference=fwd(difference),
    differenceOf=rev(difference),
    product=fwd(product),
    factors=rev(product),
    quotient=fwd(quotient),
    quotientOf=rev(quotient),
    integerQuotient=fwd(integer_quotient),
    remainder=fwd(remainder),
    remainderOf=rev(remainder),
    bit=fwd(lambda s: s.sized(2, c_xsd(F.when(s.item(1).number.between(0, 63), F.call_function("getbit", s.item(0).lex.try_cast("bigint"), F.when(s.item(1).number.between(0, 63), s.item(1).number.cast("int")).otherwise(0))), "integer"))),
    negation=fwd(negated, negated),
    exponentiation=fwd(power),
    exponentiationOf=rev(power),
    memberCount=fwd(lambda s: F.when(s.items.isNotNull(), c_xsd(F.size(s.items), "integer"))),
    **{k: numeric(op) for k, op in COMPARE.items()},
)
add_fn(
    abs=fwd(lambda s: one(s, "abs({})")),
    round=fwd(lambda s: double(half_up(s.number))),
    ceiling=fwd(lambda s: double(F.ceil(s.number))),
    floor=fwd(lambda s: double(F.floor(s.number))),
    round_half_to_even=fwd(lambda s: double(F.rint(s.number))),
)

# maths: the same on strings, results as strings


def tidy(term: Column) -> Column:
    """The number as a plain literal, without .0 at its end."""
    return c_lit(F.regexp_replace(c_lex(term), r"\.0$", ""))


def tidied(f):
    return lambda a: tidy(f(a))


add(
    MATHS,
    absoluteValue=fwd(tidied(lambda s: one(s, "abs({})"))),
    rounded=fwd(tidied(lambda s: double(half_up(s.number)))),
    sum=fwd(tidied(total)),
    sumOf=rev(tidied(total)),
    difference=fwd(tidied(difference)),
    differenceOf=rev(tidied(difference)),
    product=fwd(tidied(product)),
    factors=rev(tidied(product)),
    quotient=fwd(tidied(quotient)),
    quotientOf=rev(tidied(quotient)),
    integerQuotient=fwd(tidied(integer_quotient)),
    remainder=fwd(tidied(remainder)),
    remainderOf=rev(tidied(remainder)),
    negation=fwd(tidied(negated), tidied(negated)),
    exponentiation=fwd(tidied(power)),
    exponentiationOf=rev(tidied(power)),
    memberCount=fwd(lambda s: F.when(s.items.isNotNull(), c_lit(F.size(s.items)))),
    **{k: numeric(op) for k, op in COMPARE.items()},
)

# math: trigonometry

add(
    MATH,
    atan2=fwd(lambda s: s.sized(2, double(F.atan2(s.item(0).number, s.item(1).number)))),
    cos=fwd(lambda s: double(F.cos(s.number)), lambda o: double(F.acos(o.number))),
    cosh=fwd(lambda s: double(F.cosh(s.number))),
    degrees=fwd(lambda s: double(F.degrees(s.number)), lambda o: double(F.radians(o.number))),
    sin=fwd(lambda s: double(F.sin(s.number)), lambda o: double(F.asin(o.number))),
    sinh=fwd(lambda s: double(F.sinh(s.number))),
    tan=fwd(lambda s: double(F.tan(s.number)), lambda o: double(F.atan(o.number))),
    tanh=fwd(lambda s: double(F.tanh(s.number))),
)

# time: and times:


def instant(c: Column) -> Column:
    """ISO 8601 date or date and time, UTC where no zone is given."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^(\d{4})$", "$1-01-01")), F.try_to_timestamp(F.concat(c, F.lit("-01"))))


def seconds(c: Column) -> Column:
    micros = F.unix_micros(instant(c))
    return F.when(micros % 1000000 == 0, c_xsd((micros / 1000000).cast("bigint"), "integer")).otherwise(c_xsd(micros / 1000000.0, "double"))


def field(at: int, size: int):
    return lambda s: c_xsd(F.substring(s.lex, at, size).try_cast("int"), "integer")


#: Strftime codes and the patterns of Spark that mean the same.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%p": "a", "%a": "E", "%A": "EEEE", "%b": "MMM", "%B": "MMMM", "%Z": "'GMT'", "%%": "'%'"}


def pattern(c: Column) -> Column:
    """A strftime format as Spark's pattern; letters outside codes are quoted."""
    c = F.regexp_replace(F.replace(c, F.lit("'"), F.lit("''")), r"(%[A-Za-z%])|([A-Za-z]+)", "$1\u0001$2\u0002")
    c = F.regexp_replace(F.regexp_replace(c, "\u0001([A-Za-z]+)\u0002", "'$1'"), "\u0001\u0002", "")
    for code, p in STRFTIME.items():
        c = F.replace(c, F.lit(code), F.lit(p))
    return c


def formatted(ts: Column, fmt: Column) -> Column:
    return c_lit(F.call_function("date_format", ts, pattern(fmt)))


def _zone_free(ts: Column) -> Column:
    return F.call_function("from_utc_timestamp", F.to_utc_timestamp(ts, F.current_timezone()), F.current_timezone())


TIME = {
    "inSeconds": fwd(lambda s: seconds(s.lex), lambda o: c_lit(F.date_format(F.timestamp_seconds(o.number.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
    "equalTo": test(lambda s, o: instant(s.lex) == instant(o.lex)),
    "year": fwd(field(1, 4)),
    "month": fwd(field(6, 2)),
    "day": fwd(field(9, 2)),
    "date": fwd(lambda s: c_lit(F.substring(s.lex, 1, 10))),
    "hour": fwd(field(12, 2)),
    "minute": fwd(field(15, 2)),
    "second": fwd(field(18, 2)),
    "timeZone": fwd(lambda s: c_lit(F.nullif(F.regexp_extract(s.lex, r".*([-+]\d{1,2}:\d{2}|Z)", 1), F.lit("")))),
    "dayOfWeek": fwd(lambda s: c_xsd(F.weekday(instant(s.lex)), "integer")),
    "format": fwd(lambda s: s.sized(2, formatted(instant(s.item(0).lex), s.item(1).lex))),
    "gmTime": fwd(lambda s: F.when(F.length(s.lex) > 0, formatted(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), s.lex)).otherwise(formatted(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), F.lit("%Y-%m-%dT%H:%M:%SZ")))),
    "localTime": fwd(lambda s: F.when(F.length(s.lex) > 0, formatted(F.current_timestamp(), s.lex)).otherwise(formatted(F.current_timestamp(), F.lit("%Y-%m-%dT%H:%M:%S")))),
    "formatSeconds": fwd(lambda s: s.sized(2, formatted(F.timestamp_seconds(s.item(0).number.cast("bigint")), s.item(1).lex))),
    "parseToSeconds": fwd(lambda s: s.sized(2, c_xsd(F.unix_seconds(F.call_function("try_to_timestamp", s.item(0).lex, pattern(s.item(1).lex))), "integer"))),
}
add(SWAP + "time#", **TIME)
add(SWAP + "times#", **TIME)

# list: and rdf:, set:


def tail(items: Column) -> Column:
    return F.when(F.size(items) > 0, c_list(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))))


def nested(items: Column) -> Column:
    from gossamer.terms import c_items

    return F.transform(items, c_items)


def all_lists(items: Column, value: Column) -> Column:
    return F.when(F.forall(nested(items), lambda x: x.isNotNull()), value)


add(RDF, first=fwd(lambda s: F.get(s.items, F.lit(0))), rest=fwd(lambda s: tail(s.items)))
add(
    SWAP + "list#",
    last=fwd(lambda s: F.when(F.size(s.items) > 0, F.element_at(s.items, -1))),
    **{"in": Builtin(test=lambda s, o: F.array_contains(o.items, s.c), rev_many=lambda o: F.array_distinct(o.items))},
    member=Builtin(test=lambda s, o: F.array_contains(s.items, o.c), fwd_many=lambda s: F.array_distinct(s.items)),
    append=fwd(lambda s: all_lists(s.items, c_list(F.flatten(nested(s.items))))),
    members=fwd(lambda s: c_set(s.items)),
)


def meet(items: Column) -> Column:
    sets = nested(items)
    return F.when(F.size(sets) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(sets, F.get(sets, F.lit(0)), F.array_intersect))


def two_sets(s: Arg, op) -> Column:
    a, b = s.item(0).items, s.item(1).items
    return s.sized(2, c_set(op(a, b)))


add(
    SWAP + "set#",
    **{"in": Builtin(test=lambda s, o: F.array_contains(o.items, s.c), rev_many=lambda o: F.array_distinct(o.items))},
    member=Builtin(test=lambda s, o: F.array_contains(s.items, o.c), fwd_many=lambda s: F.array_distinct(s.items)),
    union=fwd(lambda s: all_lists(s.items, c_set(F.flatten(nested(s.items))))),
    intersection=fwd(lambda s: all_lists(s.items, c_set(meet(s.items)))),
    symmetricDifference=fwd(lambda s: two_sets(s, lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a)))),
    difference=fwd(lambda s: two_sets(s, F.array_except)),
    oneOf=rev(lambda o: c_set(o.items)),
)

# os:


#: Names of environment variables that queries may read. Values go into plans, which are logged: add to it with care.
ENVIRON = {"HOME", "LANG", "TZ", "USER"}


def environment(s: Arg) -> Column:
    given = {k: os.environ[k] for k in sorted(ENVIRON) if k in os.environ}
    known = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,string>")
    return c_lit(F.try_element_at(known, s.lex))


BASE = "file://" + os.getcwd() + "/"


@F.pandas_udf(T.StringType())
def _relative_uri(text: pd.Series, base: pd.Series) -> pd.Series:
    def one(t, b):
        if t is None:
            return None
        here, there = b.split("/"), t.split("/")
        if here[:3] != there[:3]:
            return t
        k = 0
        while k < min(len(here), len(there)) - 1 and here[k] == there[k]:
            k += 1
        return "../" * (len(here) - 1 - k) + "/".join(there[k:])

    return pd.Series([one(t, b) for t, b in zip(text, base)])


def argument(s: Arg) -> Column:
    given = F.array(*[F.lit(a) for a in sys.argv[sys.argv.index("--with") + 1 :]]) if "--with" in sys.argv else F.array().cast("array<string>")
    return c_lit(F.get(given, s.number.cast("int") - 1))


add(
    SWAP + "os#",
    environ=fwd(environment),
    baseAbsolute=fwd(lambda s: c_lit(_joined_uri(s.text, F.lit(BASE)))),
    baseRelative=fwd(lambda s: c_lit(_relative_uri(s.text, F.lit(BASE))), lambda o: c_lit(_joined_uri(o.text, F.lit(BASE)))),
    argv=fwd(argument),
)

# crypto:

add(
    SWAP + "crypto#",
    md5=fwd(lambda s: c_lit(F.md5(s.lex))),
    sha=fwd(lambda s: c_lit(F.sha1(s.lex))),
    keyLength=fwd(lambda s: c_lit(rsa.key_length(s.lex)), lambda o: c_lit(rsa.new_key(o.lex))),
    sign=fwd(lambda s: s.sized(2, c_lit(rsa.sign(s.item(0).lex, s.item(1).lex)))),
    verify=test(lambda s, o: o.sized(2, rsa.verify(s.lex, o.item(0).lex, o.item(1).lex))),
    verifyBoolean=fwd(lambda s: s.sized(3, c_lit(F.initcap(rsa.verify(s.item(0).lex, s.item(1).lex, s.item(2).lex).cast("string"))))),
    publicKey=fwd(lambda s: c_lit(rsa.public_key(s.lex))),
)

# sparql:


def same_value(a: Column, b: Column) -> Column:
    """Equality of values by type; null where the types cannot be compared."""
    na, nb = rank(a), rank(b)
    da, db = c_datatype(a), c_datatype(b)
    numbers = da.startswith(XSD) & db.startswith(XSD) & na.isNotNull() & nb.isNotNull() & da.isin(*NUMBERS) & db.isin(*NUMBERS)
    plain_text = is_literal(a) & is_literal(b) & F.coalesce(da, F.lit(XSD + "string")).eqNullSafe(F.coalesce(db, F.lit(XSD + "string")))
    times = da.eqNullSafe(db) & da.isin(XSD + "dateTime", XSD + "date")
    return F.when(a == b, True).when(numbers, c_number(a) == c_number(b)).when(times, instant(c_lex(a)) == instant(c_lex(b))).when(plain_text, (c_lex(a) == c_lex(b)) & c_lang(a).eqNullSafe(c_lang(b))).when(~is_literal(a) | ~is_literal(b), False)


NUMBERS = [XSD + k for k in ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]


def ordered(op) -> Builtin:
    def compare(s: Arg, o: Arg) -> Column:
        a, b = s.c, o.c
        da, db = c_datatype(a), c_datatype(b)
        numbers = da.isin(*NUMBERS) & db.isin(*NUMBERS)
        times = da.eqNullSafe(db) & da.isin(XSD + "dateTime", XSD + "date")
        return F.when(numbers, op(c_number(a), c_number(b))).when(times, op(instant(c_lex(a)), instant(c_lex(b)))).when(F.coalesce(da, F.lit(XSD + "string")).eqNullSafe(F.coalesce(db, F.lit(XSD + "string"))), op(c_lex(a), c_lex(b)))

    return test(compare)


def truth(c: Column) -> Column:
    """Effective boolean value of a literal; null for a type without one."""
    lex, dt = c_lex(c), c_datatype(c)
    return F.when(dt == XSD + "boolean", lex.isin("true", "1", "True")).when(dt.isin(*NUMBERS), (c_number(c) != 0) & ~F.isnan(c_number(c))).when(dt.isNull() | (dt == XSD + "string"), F.length(lex) > 0)


add(
    SWAP + "sparqlCwm#",
    truthValue=test(lambda s, o: truth(s.c) == truth(o.c)),
    equals=Builtin(test=lambda s, o: same_value(s.c, o.c), fwd=lambda s: s.c, rev=lambda o: o.c),
    notEquals=test(lambda s, o: ~same_value(s.c, o.c)),
    lessThan=ordered(lambda a, b: a < b),
    greaterThan=ordered(lambda a, b: a > b),
    notGreaterThan=ordered(lambda a, b: a <= b),
    notLessThan=ordered(lambda a, b: a >= b),
    dtLit=fwd(lambda s: s.sized(2, F.concat(F.lit('"'), s.item(0).lex, F.lit('"^^'), s.item(1).c)), lambda o: c_list(F.array(c_lit(c_lex(o.c)), c_iri(c_datatype(o.c))))),
    langLit=fwd(lambda s: s.sized(2, F.concat(F.lit('"'), s.item(0).lex, F.lit('"@'), s.item(1).lex)), lambda o: c_list(F.array(c_lit(c_lex(o.c)), c_lit(c_lang(o.c))))),
    lamePred=test(lambda s, o: s.c.isNotNull() & o.c.isNotNull()),
)

# xml: and fn:string over literals that hold a document or element.

XML = SWAP + "xml#"


def _dom(f, kind: T.DataType | None = None):
    from xml.dom import minidom

    @F.pandas_udf(kind or T.StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return f(minidom.parseString(t).documentElement)
            except Exception:
                return None

        return text.map(one)

    return run


def _children(node) -> list[str]:
    return [c.toxml() for c in node.childNodes]


def _inside(node) -> str:
    return node.nodeValue if node.nodeValue is not None else "".join(_inside(c) for c in node.childNodes)


def _xpath(text: Column, path: Column) -> Column:
    import xml.etree.ElementTree as ET

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        def one(t, p):
            try:
                root = ET.fromstring(t)
                return [ET.tostring(e, encoding="unicode") for e in root.findall(p if not p.startswith("/") else "." + p)]
            except Exception:
                return None

        return pd.Series([one(t, p) for t, p in zip(texts, paths)])

    return run(text, path)


@F.pandas_udf(T.StringType())
def canonical_xml(text: pd.Series) -> pd.Series:
    """XML in canonical form; null for what is no document."""
    import xml.etree.ElementTree as ET

    def one(t):
        try:
            return None if t is None else ET.canonicalize(t)
        except ET.ParseError:
            return None

    return text.map(one)


def xml_literal(c: Column) -> Column:
    return c_lit(c, RDF + "XMLLiteral")


def xml_text(f):
    run = _dom(f)
    return fwd(lambda s: c_lit(run(s.lex)))


def xml_node(f):
    run = _dom(lambda n: (lambda x: None if x is None else x.toxml())(f(n)))
    return fwd(lambda s: xml_literal(run(s.lex)))


def xml_flag(f):
    run = _dom(f, T.BooleanType())
    return fwd(lambda s: c_boolean(run(s.lex)))


def _attributes(node) -> list[str]:
    return [x for i in range(node.attributes.length) for x in (node.attributes.item(i).name, node.attributes.item(i).value)]


add(
    XML,
    nodeType=fwd(lambda s: c_xsd(_dom(lambda n: n.nodeType, T.IntegerType())(s.lex), "integer")),
    parentNode=xml_node(lambda n: None if n.parentNode is None or n.parentNode.nodeType == 9 else n.parentNode),
    attributes=fwd(lambda s: c_list(F.transform(_dom(_attributes, T.ArrayType(T.StringType()))(s.lex), lambda x: c_lit(x)))),
    previousSibling=xml_node(lambda n: n.previousSibling),
    nextSibling=xml_node(lambda n: n.nextSibling),
    childNodes=fwd(lambda s: c_list(F.transform(_dom(_children, T.ArrayType(T.StringType()))(s.lex), xml_literal))),
    firstChild=xml_node(lambda n: n.firstChild),
    lastChild=xml_node(lambda n: n.lastChild),
    localName=xml_text(lambda n: n.localName),
    prefix=xml_text(lambda n: n.prefix),
    namespaceURI=xml_text(lambda n: n.namespaceURI),
    nodeName=xml_text(lambda n: n.nodeName),
    nodeValue=xml_text(_inside),
    hasAttributes=xml_flag(lambda n: n.hasAttributes()),
    hasChildNodes=xml_flag(lambda n: n.hasChildNodes()),
    isSameNode=test(lambda s, o: s.c == o.c),
    xpath=Builtin(test=lambda s, o: F.array_contains(F.transform(_xpath(s.item(0).lex, s.item(1).lex), xml_literal), o.c), fwd_many=lambda s: F.transform(_xpath(s.item(0).lex, s.item(1).lex), xml_literal)),
)
add_fn(string=xml_text(_inside))

TRUE, FALSE = xsd("true", "boolean"), xsd("false", "boolean")
