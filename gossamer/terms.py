"""Terms as canonical strings.

    <iri>    _:blank    "lex"  "lex"@lang  "lex"^^<datatype>    L[json array]  list    S[json array]  set    Fid  formula

Two terms are the same exactly when their strings are. The text between the first and the last quote of a literal is its
lexical form, without escapes, so Spark's own string functions can take terms apart. Members of lists and sets are terms
again. In patterns, `?name` is a variable and `Seq` a list or set that holds one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SWAP = "http://www.w3.org/2000/10/swap/"
LOG = SWAP + "log#"
AIR = "http://dig.csail.mit.edu/TAMI/2007/amord/air#"
DIFF = "http://www.w3.org/2004/delta#"

TYPE, FIRST, REST, NIL = (f"<{RDF}{x}>" for x in ("type", "first", "rest", "nil"))
IMPLIES, SAME_AS = f"<{LOG}implies>", f"<{OWL}sameAs>"
EMPTY_LIST = "L[]"

#: The XSD types by how their values are compared.
INTEGERS = frozenset("integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
DOUBLES = frozenset(("double", "float"))


def iri(uri: str) -> str:
    return f"<{uri}>"


def lit(lex: str, dt: str | None = None, lang: str | None = None) -> str:
    return f'"{lex}"' + (f"@{lang}" if lang else f"^^<{dt}>" if dt else "")


def xsd(lex: object, kind: str) -> str:
    return lit(str(lex), XSD + kind)


@dataclass(frozen=True)
class Seq:
    """A list ('L') or set ('S') with variables inside."""

    kind: str
    items: tuple


Term = str | Seq


def is_var(t: Term) -> bool:
    return isinstance(t, str) and t.startswith("?")


def variables(t: Term) -> set[str]:
    if isinstance(t, Seq):
        return set().union(*map(variables, t.items)) if t.items else set()
    return {t} if is_var(t) else set()


def seq(kind: str, items: list[Term]) -> Term:
    """The string of a ground list or set, else a Seq."""
    if any(isinstance(i, Seq) or is_var(i) for i in items):
        return Seq(kind, tuple(items))
    return kind + json.dumps(sorted(set(items)) if kind == "S" else items, ensure_ascii=False, separators=(",", ":"))


def members(t: str) -> list[str]:
    return json.loads(t[1:])


def substitute(t: Term, values: dict[str, Term]) -> Term:
    if isinstance(t, Seq):
        return seq(t.kind, [substitute(i, values) for i in t.items])
    return values.get(t, t)


LITERAL = r'(?s)^"(.*)"(?:\^\^<([^"]*)>|@([^"]*))?$'
_LITERAL = re.compile(LITERAL)


def parts(t: str) -> tuple[str, str | None, str | None]:
    """Lexical form, datatype and language of a literal."""
    m = _LITERAL.match(t)
    if not m:
        raise ValueError(f"not a literal: {t}")
    return m[1], m[2], m[3]


def kind_of(t: Term) -> str:
    if isinstance(t, Seq):
        return "LIST" if t.kind == "L" else "SET"
    return {"<": "IRI", "_": "BNODE", '"': "LIT", "L": "LIST", "S": "SET", "F": "FORMULA", "?": "VAR"}[t[0]]


# The same over columns of term strings.


def c_kind(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    out = F.lit("ERR")
    for k, v in {"<": "IRI", "_": "BNODE", '"': "LIT", "L": "LIST", "S": "SET", "F": "FORMULA"}.items():
        out = F.when(first == k, v).otherwise(out)
    return F.when(c.isNotNull(), out)


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def _parts_of(c: Column) -> tuple | None:
    """Lexical form and what gives the datatype of a literal put together here, so that it is not taken apart again."""
    return c.__dict__.get("_parts")


def let(value: Column, body: str) -> Column:
    """The SQL expression `body` of x, the value, which is computed once however often body names it."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), F.lit(0))


def c_lex(c: Column) -> Column:
    known = _parts_of(c)
    return known[0] if known else F.when(is_literal(c), F.regexp_extract(c, LITERAL, 1))


def c_datatype(c: Column) -> Column:
    """IRI text of a literal's datatype; null for plain and tagged ones."""
    known = _parts_of(c)
    return known[1]() if known else F.when(is_literal(c), F.nullif(F.regexp_extract(c, LITERAL, 2), F.lit("")))


def c_lang(c: Column) -> Column:
    return F.lit(None).cast("string") if _parts_of(c) else F.when(is_literal(c), F.nullif(F.regexp_extract(c, LITERAL, 3), F.lit("")))


def c_uri(c: Column) -> Column:
    return F.when(c.startswith("<"), c.substr(F.lit(2), F.length(c) - 2))


def c_text(c: Column) -> Column:
    """The lexical form of a literal, the address of an IRI."""
    return c_lex(c) if _parts_of(c) else F.coalesce(c_lex(c), c_uri(c))


def c_number(c: Column) -> Column:
    return c_lex(c).try_cast("double")


def c_items(c: Column) -> Column:
    return F.when(c.startswith("L[") | c.startswith("S["), F.from_json(c.substr(F.lit(2), F.length(c)), "array<string>"))


def c_iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def c_lit(text: Column, dt: str | None = None) -> Column:
    text = text.cast("string")
    return literal(F.concat(F.lit('"'), text, F.lit(f'"^^<{dt}>' if dt else '"')), text, lambda: F.when(text.isNotNull(), F.lit(dt).cast("string")))


def literal(term: Column, text: Column, dt) -> Column:
    """term, known to be a literal of that lexical form and (dt gives it) datatype."""
    term.__dict__["_parts"] = text, dt
    return term


def c_xsd(value: Column, kind: str) -> Column:
    return c_lit(value, XSD + kind)


def c_boolean(b: Column) -> Column:
    return F.when(b, xsd("true", "boolean")).when(~b, xsd("false", "boolean"))


def c_list(items: Column) -> Column:
    """A list term of an array of terms; null where an item is."""
    return F.when(items.isNotNull() & ~F.exists(items, lambda x: x.isNull()), F.concat(F.lit("L"), F.to_json(items)))


def c_set(items: Column) -> Column:
    return F.when(items.isNotNull() & ~F.exists(items, lambda x: x.isNull()), F.concat(F.lit("S"), F.to_json(F.array_sort(F.array_distinct(items)))))
