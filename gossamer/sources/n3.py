"""Notation 3 (and with it Turtle and N-Triples) to quads.

A document's statements are rows (g, s, p, o); g is "" for the document itself and an id for each quoted graph, which
is the term F + id. Variables keep their `?`; a quoted graph's variables are listed with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

from gossamer.terms import EMPTY_LIST, IMPLIES, NIL, OWL, RDF, SAME_AS, TYPE, Seq, Term, iri, lit, seq, substitute, xsd


class SyntaxProblem(ValueError):
    """Text that is not in the language; says the line."""


@dataclass
class Formula:
    statements: list[tuple[Term, Term, Term]] = field(default_factory=list)
    universals: list[str] = field(default_factory=list)
    existentials: list[str] = field(default_factory=list)


@dataclass
class Document:
    """Formulas by id, "" the document; the prefixes."""

    base: str
    formulas: dict[str, Formula]
    prefixes: dict[str, str]

    @property
    def root(self) -> Formula:
        return self.formulas[""]

    def quads(self) -> list[tuple[str, str, str, str]]:
        """Distinct ground rows; lists with variables inside are written with the variables' names."""
        flat = lambda t: t if isinstance(t, str) else _flat(t)
        return list(dict.fromkeys((g, *map(flat, st)) for g, f in self.formulas.items() for st in f.statements))


def _flat(t: Term) -> str:
    import json

    return t if isinstance(t, str) else t.kind + json.dumps([_flat(i) for i in t.items], ensure_ascii=False, separators=(",", ":"))


_TOKEN = re.compile(
    r"""(?P<skip>(?:[ \t\r\n﻿]+|\#[^\n]*)+)
  | (?P<long>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3,5}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3,5})
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<iri><(?:[^<>"{}|\\^`\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<op><=|=>|\^\^|:=|\{\$|\$\}|\(\$|\$\)|[\[\](){}.;,!^=])
  | (?P<number>[-+]?(?:[0-9]+\.[0-9]+(?:[eE][-+]?[0-9]+)?|\.[0-9]+(?:[eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+|[0-9]+\.[eE][-+]?[0-9]+|[0-9]+))
  | (?P<var>\?[\w-]+)
  | (?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
  | (?P<at>@[A-Za-z][A-Za-z0-9-]*)
  | (?P<name>(?:[^\W\d_][\w-]*(?:\.[\w-]+)*)?:(?:[\w:%-](?:[\w:.%-]*[\w:%-])?|\\[_~.!$&'()*+,;=/?\#@%-])*|[^\W\d][\w-]*)
""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "a": "\a", '"': '"', "'": "'", "\\": "\\"}


def unescape(raw: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], "\\" + m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, raw, flags=re.S)


class Parser:
    def __init__(self, text: str, base: str = "", tag: str = ""):
        self.text, self.base, self.tag = text, base, tag
        self.prefixes: dict[str, str] = {"": base.partition("#")[0] + "#"}
        self.formulas: dict[str, Formula] = {"": Formula()}
        self.path = [""]
        self.bound: list[dict[str, str]] = [{}]  # IRIs declared as variables, by scope
        self.blank: dict[str, str] = {}
        self.n = 0
        self.keywords: set[str] | None = None
        self.tokens = list(self._lex())
        self.i = 0

    def _lex(self):
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m or m.end() == at:
                raise SyntaxProblem(f"line {self.text.count(chr(10), 0, at) + 1}: {self.text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], at
            at = m.end()
        yield "end", "", at

    def problem(self, what: str) -> SyntaxProblem:
        kind, value, at = self.tokens[self.i]
        return SyntaxProblem(f"line {self.text.count(chr(10), 0, at) + 1}: {what}, not {value or kind!r}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i][:2]

    def take(self) -> tuple[str, str]:
        self.i += 1
        return self.tokens[self.i - 1][:2]

    def accept(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("op", "name", "at"):
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise self.problem(f"expected {value!r}")

    def word(self, w: str) -> bool:
        """A keyword, bare or with @."""
        kind, value = self.peek()
        if kind == "at" and value[1:].lower() == w.lower() or kind == "name" and value == w and (self.keywords is None or w in self.keywords):
            self.i += 1
            return True
        return False

    def fresh(self) -> str:
        self.n += 1
        return f"_:{self.tag}b{self.n}"

    @property
    def here(self) -> Formula:
        return self.formulas[self.path[-1]]

    def add(self, s: Term, p: Term, o: Term) -> None:
        if (s, p, o) not in self._seen():
            self.here.statements.append((s, p, o))
            self._seen().add((s, p, o))

    def _seen(self) -> set:
        f = self.here
        if not hasattr(f, "seen"):
            f.seen = set()
        return f.seen

    def document(self) -> Document:
        while self.peek()[0] != "end":
            self.statement()
        for f in self.formulas.values():
            f.__dict__.pop("seen", None)
        return Document(self.base, self.formulas, self.prefixes)

    def statement(self) -> None:
        kind, value = self.peek()
        low = value.lower()
        if kind == "at" and low in ("@prefix", "@base", "@keywords", "@forall", "@forsome") or kind == "name" and (value in ("forAll", "forSome", "prefix") and self.keywords is not None or low in ("prefix", "base") and ":" not in value and self.tokens[self.i + 1][0] in ("name", "iri")):
            self.take()
            self.directive(low.lstrip("@"))
            if not self.accept(".") and kind == "at" and self.peek()[1] not in ("}",):
                raise self.problem("expected '.'")
            return
        n = self.i
        s = self.path_term()
        if self.peek()[1] not in (".", "}") or self.i == n:
            self.properties(s)
        if not self.accept(".") and self.peek()[1] not in ("}", "") and self.peek()[0] != "end":
            raise self.problem("expected '.'")

    def directive(self, what: str) -> None:
        if what == "prefix":
            name = self.take()[1]
            if not name.endswith(":"):
                raise self.problem("a prefix ends in ':'")
            self.prefixes[name[:-1]] = self.absolute(self.take()[1][1:-1])
        elif what == "base":
            self.base = self.absolute(self.take()[1][1:-1])
        elif what == "keywords":
            self.keywords = set()
            while self.peek()[1] != ".":
                self.keywords.add(self.take()[1])
                self.accept(",")
        else:
            while True:
                self.declare(self.path_term(), what == "forall")
                if not self.accept(","):
                    break

    def declare(self, t: Term, universal: bool) -> None:
        if not isinstance(t, str) or not t.startswith("<"):
            if isinstance(t, str) and t.startswith("?"):
                self.here.universals.append(t)
            return
        local = re.sub(r"\W", "_", re.split(r"[#/]", t[1:-1])[-1]) or "v"
        taken = {v for scope in self.bound for v in scope.values()}
        if universal:
            name, k = f"?{local}", 1
            while name in taken:
                k += 1
                name = f"?{local}_{k}"
            self.here.universals.append(name)
        else:
            name = self.fresh()
            self.here.existentials.append(name)
        self.bound[-1][t] = name

    def absolute(self, ref: str) -> str:
        ref = unescape(ref)
        if not self.base or re.match(r"[A-Za-z][\w+.-]*:", ref):
            return ref
        # An empty fragment is kept: prefixes end in it.
        return urljoin(self.base, ref.removesuffix("#")).partition("#")[0] + "#" if ref.endswith("#") else urljoin(self.base, ref)

    def properties(self, s: Term) -> None:
        while True:
            if self.peek()[1] in (".", "}", "]", ""):
                return
            p, inverse = self.verb()
            while True:
                o = self.path_term()
                self.add(*((o, p, s) if inverse else (s, p, o)))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass

    def verb(self) -> tuple[Term, bool]:
        kind, value = self.peek()
        if self.accept("=>"):
            return IMPLIES, False
        if self.accept("<="):
            return IMPLIES, True
        if self.accept("="):
            return SAME_AS, False
        if self.accept(":="):
            return SAME_AS, False
        if kind == "name" and value == "a" or kind == "at" and value == "@a":
            self.take()
            return TYPE, False
        if self.word("has"):
            return self.path_term(), False
        if self.word("is"):
            p = self.path_term()
            if not self.word("of"):
                raise self.problem("expected 'of'")
            return p, True
        return self.path_term(), False

    def path_term(self) -> Term:
        t = self.term()
        while self.peek()[1] in ("!", "^") and self.peek()[0] == "op":
            forward = self.take()[1] == "!"
            p, node = self.term(), self.fresh()
            self.add(*((t, p, node) if forward else (node, p, t)))
            t = node
        return t

    def term(self) -> Term:
        kind, value = self.take()
        if kind == "iri":
            return self.named(iri(self.absolute(value[1:-1])))
        if kind in ("string", "long"):
            return self.literal(unescape(value[3:-3] if kind == "long" else value[1:-1]))
        if kind == "number":
            return xsd(value, "double" if re.search("[eE]", value) else "decimal" if "." in value else "integer")
        if kind == "var":
            scope = self.formulas[self.path[-2] if len(self.path) > 1 else ""]
            if value not in scope.universals:
                scope.universals.append(value)
            return value
        if kind == "bnode":
            return self.blank.setdefault(value, f"_:{self.tag}{value[2:]}")
        if value == "[":
            node = self.fresh()
            if self.accept("="):
                node = self.path_term()
                self.accept(";")
            self.properties(node)
            self.expect("]")
            return node
        if value == "(" or value == "($" or value == "{$":
            close, items = {"(": ")", "($": "$)", "{$": "$}"}[value], []
            while not self.accept(close):
                items.append(self.path_term())
                self.accept(",")
            return seq("L" if value == "(" else "S", items)
        if value == "{":
            return self.formula()
        if kind == "at" and value in ("@true", "@false"):
            return xsd(value[1:], "boolean")
        if kind == "at" and value == "@this" or kind == "name" and value == "this":
            return "F" + self.path[-1]
        if kind == "at" and value == "@a":
            return TYPE
        if kind == "name":
            if value in ("true", "false"):
                return xsd(value, "boolean")
            if ":" in value:
                prefix, _, local = value.partition(":")
                if prefix not in self.prefixes:
                    self.i -= 1
                    raise self.problem(f"prefix {prefix}: is not declared")
                return self.named(iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)))
            if value == "a":
                return TYPE
            if self.keywords is not None:
                return self.named(iri(self.prefixes[""] + value))
        self.i -= 1
        raise self.problem("expected a term")

    def named(self, t: str) -> str:
        if t == NIL:
            return EMPTY_LIST
        for scope in reversed(self.bound):
            if t in scope:
                return scope[t]
        return t

    def literal(self, lex: str) -> str:
        kind, value = self.peek()
        if kind == "at" and value not in ("@forAll", "@forSome", "@is", "@of", "@has", "@a"):
            self.take()
            return lit(lex, lang=value[1:].lower())
        if self.accept("^^"):
            t = self.term()
            return lit(lex, t[1:-1])
        return lit(lex)

    def formula(self) -> str:
        self.n += 1
        gid = f"{self.tag}f{self.n}"
        self.formulas[gid] = Formula()
        self.path.append(gid)
        self.bound.append({})
        while not self.accept("}"):
            if self.peek()[0] == "end":
                raise self.problem("expected '}'")
            self.statement()
        self.path.pop()
        self.bound.pop()
        return "F" + gid


def parse(text: str, base: str = "", tag: str = "") -> Document:
    """tag goes into the ids of blank nodes and quoted graphs; documents of one graph need different ones."""
    return Parser(text, base, tag).document()


def collapsed(statements: list[tuple[Term, Term, Term]]) -> list[tuple[Term, Term, Term]]:
    """rdf:first/rest chains of blank nodes as list terms."""
    first, rest = f"<{RDF}first>", f"<{RDF}rest>"
    heads = {s: o for s, p, o in statements if p == first and isinstance(s, str) and s.startswith("_:")}
    tails = {s: o for s, p, o in statements if p == rest and s in heads}
    lists: dict[str, Term] = {}

    def whole(node: Term, seen: tuple = ()) -> list | None:
        if node in (EMPTY_LIST, NIL):
            return []
        if node in seen or node not in tails:
            return None
        tail = whole(tails[node], (*seen, node))
        return None if tail is None else [heads[node], *tail]

    for node in tails:
        if (items := whole(node)) is not None:
            lists[node] = items
    build = lambda node: seq("L", [build(i) if i in lists else i for i in lists[node]]) if node in lists else node
    done = {node: build(node) for node in lists}
    kept = [st for st in statements if not (st[0] in done and st[1] in (first, rest))]
    out = [tuple(substitute(x, done) for x in st) for st in kept]
    # owl:oneOf of a list makes a set.
    return [(s, p, Seq("S", o.items) if p == f"<{OWL}oneOf>" and isinstance(o, Seq) else "S" + o[1:] if p == f"<{OWL}oneOf>" and isinstance(o, str) and o.startswith("L[") else o) for s, p, o in out]
