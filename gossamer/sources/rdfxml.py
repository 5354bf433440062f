"""RDF/XML: documents to quads and back."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from gossamer import terms as T
from gossamer.sources.n3 import Document, Formula, SyntaxProblem
from gossamer.terms import RDF

XML = "{http://www.w3.org/XML/1998/namespace}"
#: Attributes of rdf: that are syntax, not properties.
SYNTAX = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "li", "Description"}


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Reader:
    def __init__(self, base: str, tag: str):
        self.base, self.tag, self.n, self.out = base, tag, 0, []

    def blank(self, name: str | None = None) -> str:
        self.n += 1
        return f"_:{self.tag}{name}" if name else f"_:{self.tag}x{self.n}"

    def scope(self, e, base: str, lang: str | None) -> tuple[str, str | None]:
        return urljoin(base, e.get(XML + "base", "")) if e.get(XML + "base") else base, (e.get(XML + "lang") if e.get(XML + "lang") is not None else lang) or None

    def rdf(self, e, local: str) -> str | None:
        return e.get(f"{{{RDF}}}{local}")

    def node(self, e, base: str, lang: str | None) -> str:
        base, lang = self.scope(e, base, lang)
        if self.rdf(e, "about") is not None:
            s = T.iri(urljoin(base, self.rdf(e, "about")))
        elif self.rdf(e, "ID") is not None:
            s = T.iri(urljoin(base, "#" + self.rdf(e, "ID")))
        else:
            s = self.blank(self.rdf(e, "nodeID"))
        if _name(e.tag) != RDF + "Description":
            self.out.append((s, T.TYPE, T.iri(_name(e.tag))))
        self.attributes(s, e, base, lang)
        li = 0
        for child in e:
            p = _name(child.tag)
            if p == RDF + "li":
                li += 1
                p = f"{RDF}_{li}"
            self.property(s, p, child, base, lang)
        return s

    def attributes(self, s: str, e, base: str, lang: str | None) -> None:
        for k, v in e.attrib.items():
            name = _name(k)
            if k.startswith(XML) or (name.startswith(RDF) and name[len(RDF) :] in SYNTAX) or not k.startswith("{"):
                continue
            self.out.append((s, T.iri(name), T.iri(urljoin(base, v)) if name == RDF + "type" else T.lit(v, lang=lang)))

    def property(self, s: str, p: str, e, base: str, lang: str | None) -> None:
        base, lang = self.scope(e, base, lang)
        how = self.rdf(e, "parseType")
        if how == "Literal":
            text = escape(e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            o = T.lit(text, RDF + "XMLLiteral")
        elif how == "Resource":
            o = self.blank()
            for c in e:
                self.property(o, _name(c.tag), c, base, lang)
        elif how == "Collection":
            o = T.seq("L", [self.node(c, base, lang) for c in e])
        elif self.rdf(e, "resource") is not None or self.rdf(e, "nodeID") is not None:
            o = T.iri(urljoin(base, self.rdf(e, "resource"))) if self.rdf(e, "resource") is not None else self.blank(self.rdf(e, "nodeID"))
            self.attributes(o, e, base, lang)
        elif len(e):
            if len(e) > 1:
                raise SyntaxProblem(f"property {p} holds {len(e)} nodes")
            o = self.node(e[0], base, lang)
        elif any(k.startswith("{") and not k.startswith(XML) and not (_name(k).startswith(RDF) and _name(k)[len(RDF) :] in SYNTAX) for k in e.attrib):
            o = self.blank()
            self.attributes(o, e, base, lang)
        else:
            dt = self.rdf(e, "datatype")
            o = T.lit(e.text or "", urljoin(base, dt)) if dt else T.lit(e.text or "", lang=lang and lang.lower())
        st = (s, T.iri(p), o)
        self.out.append(st)
        if self.rdf(e, "ID") is not None:
            about = T.iri(urljoin(base, "#" + self.rdf(e, "ID")))
            self.out += [(about, T.TYPE, T.iri(RDF + "Statement")), *((about, T.iri(RDF + k), v) for k, v in zip(("subject", "predicate", "object"), st))]


def parse(text: str, base: str = "", tag: str = "") -> Document:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as x:
        raise SyntaxProblem(f"RDF/XML: {x}") from x
    r = _Reader(base, tag)
    b, lang = r.scope(root, base, None)
    for e in root if _name(root.tag) == RDF + "RDF" else [root]:
        r.node(e, b, lang)
    return Document(base, {"": Formula(list(dict.fromkeys(r.out)))}, {})


def write(statements: list[tuple[str, str, str]], prefixes: dict[str, str] | None = None, flags: str = "", base: str = "") -> str:
    """RDF/XML text. Literals as subjects and quoted graphs cannot be written. flags: b blank nodes as local addresses; c
    no class as an element's name; d no default namespace; l lists as first and rest; r no relative addresses; z relative
    addresses for namespaces."""
    spaces: dict[str, str] = {RDF: "rdf"} | {v: k for k, v in (prefixes or {}).items() if k}
    if "l" in flags:
        statements = _unlisted(statements)
    if "d" not in flags and not any(o.endswith(f"^^<{RDF}XMLLiteral>") for _, _, o in statements):
        # The predicates' commonest namespace needs no prefix. XML inside would come to be in it.
        found = [p[1 : max(p.rfind("#"), p.rfind("/")) + 1] for _, p, _ in statements]
        most = max(sorted(set(found) - {RDF, ""}), key=found.count, default=None)
        if most:
            spaces[most] = ""

    def space(ns: str) -> str:
        return ns[len(base) :] if "z" in flags and base and ns.startswith(base) else ns

    def qname(t: str) -> str:
        uri = t[1:-1]
        cut = max(uri.rfind("#"), uri.rfind("/")) + 1
        ns = uri[:cut]
        if not uri[cut:]:
            raise ValueError(f"{t} cannot be an element")
        prefix = spaces.setdefault(ns, f"ns{len(spaces)}")
        return f"{prefix}:{uri[cut:]}" if prefix else uri[cut:]

    def ref(t: str, about: bool) -> str:
        if t.startswith("<"):
            uri = t[1:-1]
            if base and "r" not in flags and uri.startswith(base + "#"):
                uri = uri[len(base) :]
            return f"rdf:{'about' if about else 'resource'}={quoteattr(uri)}"
        if "b" in flags:
            return f"rdf:{'about' if about else 'resource'}={quoteattr('#_' + ''.join(c if c.isalnum() else '_' for c in t[2:]))}"
        return f"rdf:nodeID={quoteattr('n' + ''.join(c if c.isalnum() else '_' for c in t[2:]))}"

    def item(o: str) -> str:
        if o.startswith('"'):
            return f"<rdf:Description><rdf:value>{escape(T.parts(o)[0])}</rdf:value></rdf:Description>"
        return f"<rdf:Description {ref(o, True)}/>"

    by: dict[str, list] = {}
    for s, p, o in sorted(statements):
        if s[0] not in "<_":
            raise ValueError(f"{s} cannot be a subject in RDF/XML")
        by.setdefault(s, []).append((p, o))
    body = ""
    for s, pos in by.items():
        kinds = [o for p, o in pos if p == T.TYPE and o.startswith("<") and re.fullmatch(r".*[#/][A-Za-z_][\w.-]*", o[1:-1])]
        element = "rdf:Description" if "c" in flags or not kinds else qname(kinds[0])
        body += f"  <{element} {ref(s, True)}>\n"
        for p, o in pos:
            if element != "rdf:Description" and (p, o) == (T.TYPE, kinds[0]):
                continue
            q = qname(p)
            if o.startswith('"'):
                lex, dt, lang = T.parts(o)
                if dt == RDF + "XMLLiteral":
                    body += f'    <{q} rdf:parseType="Literal">{lex}</{q}>\n'
                else:
                    more = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else ""
                    body += f"    <{q}{more}>{escape(lex)}</{q}>\n"
            elif o.startswith("L"):
                body += f'    <{q} rdf:parseType="Collection">{"".join(map(item, T.members(o)))}</{q}>\n'
            elif o[0] in "<_":
                body += f"    <{q} {ref(o, False)}/>\n"
            else:
                raise ValueError(f"{o} cannot be written in RDF/XML")
        body += f"  </{element}>\n"
    head = "".join(f" xmlns{':' if p else ''}{p}={quoteattr(space(ns))}" for ns, p in spaces.items())
    return f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF{head}>\n{body}</rdf:RDF>\n'


def _unlisted(statements: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The statements with lists as nodes that have a first and a rest."""
    out, n = [], 0
    for s, p, o in statements:
        if o.startswith("L"):
            items, rest = T.members(o), f"<{RDF}nil>"
            for i in reversed(items):
                n += 1
                out += [(f"_:list{n}", f"<{RDF}first>", i), (f"_:list{n}", f"<{RDF}rest>", rest)]
                rest = f"_:list{n}"
            o = rest
        out.append((s, p, o))
    return out
