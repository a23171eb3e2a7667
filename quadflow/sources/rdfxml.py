"""A parser of RDF/XML over SAX events."""

from __future__ import annotations

import re
import xml.sax
import xml.sax.handler
from dataclasses import dataclass, field
from io import StringIO
from urllib.parse import urldefrag, urljoin
from xml.sax.saxutils import escape, quoteattr

from quadflow.functions.terms import RDF, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, bnode, iri, literal, resolved
from quadflow.sources.n3 import RdfError, Statement

_XML = "http://www.w3.org/XML/1998/namespace"
_NAME = re.compile(r"[^\W\d][\w.\-]*")
_FORBIDDEN = {RDF + n for n in ("bagID", "aboutEach", "aboutEachPrefix")}
_CORE = {RDF + n for n in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype")}


@dataclass
class _Frame:
    kind: str  # document, node, property, literal (inside parseType Literal)
    base: str
    lang: str | None
    subject: str = ""
    predicate: str = ""
    datatype: str | None = None
    reify: str | None = None
    text: list[str] = field(default_factory=list)
    item: int = 0  # of rdf:li
    object: str | None = None
    collection: list[str] | None = None
    parse_type: str = ""
    depth: int = 0
    empty: bool = False


class _Handler(xml.sax.handler.ContentHandler):
    def __init__(self, base: str, graph: str, scope: str) -> None:
        super().__init__()
        self.graph, self.scope = graph, scope
        self.out: list[Statement] = []
        self.stack = [_Frame("document", base, None)]
        self.fresh = 0
        self.ids: set[str] = set()
        self.prefixes: list[tuple[str | None, str]] = []
        self.locator = None

    def setDocumentLocator(self, locator) -> None:  # noqa: ANN001, N802
        self.locator = locator

    def fail(self, why: str) -> None:
        raise RdfError(f"line {self.locator.getLineNumber()}, column {self.locator.getColumnNumber() + 1}: {why}")

    def add(self, s: str, p: str, o: str) -> None:
        self.out.append((s, p, o, self.graph))

    def new(self) -> str:
        self.fresh += 1
        return bnode(f"{self.scope}n{self.fresh}")

    def resolve(self, relative: str, base: str) -> str:
        return iri(resolved(relative, base) if relative else urldefrag(base)[0])

    def identifier(self, name: str, base: str) -> str:
        if not _NAME.fullmatch(name):
            self.fail(f"rdf:ID {name!r} is no name")
        out = iri(urldefrag(base)[0] + "#" + name)
        if out in self.ids:
            self.fail(f"rdf:ID {name!r} comes twice")
        self.ids.add(out)
        return out

    def startPrefixMapping(self, prefix, uri) -> None:  # noqa: ANN001, N802
        self.prefixes.append((prefix, uri))

    def startElementNS(self, name, qname, attrs) -> None:  # noqa: ANN001, N802, ARG002
        top = self.stack[-1]
        values = {(ns or "") + local: v for (ns, local), v in attrs.items()}
        base = urljoin(top.base, values[_XML + "base"]) if _XML + "base" in values else top.base
        lang = values.get(_XML + "lang", top.lang) or None
        full = (name[0] or "") + name[1]
        if top.kind == "literal" or top.parse_type == "Literal":
            top.depth += 1
            prefix = next((p for p, u in reversed(self.prefixes) if u == name[0]), None)
            tag = f"{prefix}:{name[1]}" if prefix else name[1]
            space = f" xmlns{':' + prefix if prefix else ''}={quoteattr(name[0])}" if name[0] and top.depth == 1 else ""
            top.text.append(f"<{tag}{space}" + "".join(f" {n[1]}={quoteattr(v)}" for n, v in attrs.items()) + ">")
            self.stack.append(_Frame("literal", base, lang, text=top.text, depth=top.depth, predicate=tag))
            return
        if top.kind == "document":
            if full == RDF + "RDF":
                self.stack.append(_Frame("document", base, lang))
                return
            self.node(full, values, base, lang)
        elif top.kind == "property":
            if top.object is not None and top.collection is None:
                self.fail("a property has two nodes")
            node = self.node(full, values, base, lang)
            if top.collection is not None:
                top.collection.append(node)
            else:
                top.object = node
        else:
            self.property(full, values, base, lang)

    def node(self, full: str, values: dict[str, str], base: str, lang: str | None) -> str:
        if full in _FORBIDDEN | _CORE or full == RDF + "li":
            self.fail(f"{full} cannot be a node")
        if bad := _FORBIDDEN & set(values):
            self.fail(f"{min(bad)} is no longer part of the language")
        named = [k for k in ("about", "ID", "nodeID") if RDF + k in values]
        if len(named) > 1:
            self.fail("a node has two of rdf:about, rdf:ID and rdf:nodeID")
        if not named:
            subject = self.new()
        elif named[0] == "about":
            subject = self.resolve(values[RDF + "about"], base)
        elif named[0] == "ID":
            subject = self.identifier(values[RDF + "ID"], base)
        else:
            subject = bnode(f"{self.scope}x{values[RDF + 'nodeID']}")
        if full != RDF + "Description":
            self.add(subject, RDF_TYPE, iri(full))
        self.attributes(subject, values, base, lang)
        self.stack.append(_Frame("node", base, lang, subject=subject))
        return subject

    def attributes(self, subject: str, values: dict[str, str], base: str, lang: str | None) -> None:
        for k, v in values.items():
            if k.startswith(_XML) or k in _CORE or ":" not in k:
                continue
            if k == RDF + "type":
                self.add(subject, RDF_TYPE, self.resolve(v, base))
            elif k == RDF + "li":
                self.fail("rdf:li cannot be an attribute")
            else:
                self.add(subject, iri(k), literal(v, lang))

    def property(self, full: str, values: dict[str, str], base: str, lang: str | None) -> None:
        top = self.stack[-1]
        if full in _FORBIDDEN | _CORE or full == RDF + "Description":
            self.fail(f"{full} cannot be a property")
        if bad := _FORBIDDEN & set(values):
            self.fail(f"{min(bad)} is no longer part of the language")
        if full == RDF + "li":
            top.item += 1
            full = f"{RDF}_{top.item}"
        reify = self.identifier(values[RDF + "ID"], base) if RDF + "ID" in values else None
        kind = values.get(RDF + "parseType", "")
        frame = _Frame("property", base, lang, subject=top.subject, predicate=iri(full), datatype=values.get(RDF + "datatype"), reify=reify, parse_type=kind)
        if kind and (RDF + "resource" in values or RDF + "nodeID" in values):
            self.fail("rdf:parseType beside rdf:resource")
        if kind == "Resource":
            frame.object = self.new()
            self.stack.append(frame)
            self.stack.append(_Frame("node", base, lang, subject=frame.object, parse_type="inner"))
            return
        if kind == "Collection":
            frame.collection = []
        elif kind:
            frame.parse_type = "Literal"
        elif RDF + "resource" in values and RDF + "nodeID" in values:
            self.fail("rdf:resource beside rdf:nodeID")
        elif RDF + "resource" in values or RDF + "nodeID" in values:
            frame.object = self.resolve(values[RDF + "resource"], base) if RDF + "resource" in values else bnode(f"{self.scope}x{values[RDF + 'nodeID']}")
            frame.empty = True
            self.attributes(frame.object, values, base, lang)
        elif any(":" in k and not k.startswith(_XML) and k not in _CORE for k in values):
            frame.object, frame.empty = self.new(), True
            self.attributes(frame.object, values, base, lang)
        self.stack.append(frame)

    def characters(self, content: str) -> None:
        top = self.stack[-1]
        if top.kind == "literal" or top.parse_type == "Literal":
            top.text.append(escape(content))
        elif top.kind == "property":
            top.text.append(content)
        elif content.strip():
            self.fail(f"text where none can stand: {content.strip()[:20]!r}")

    def endElementNS(self, name, qname) -> None:  # noqa: ANN001, N802, ARG002
        frame = self.stack.pop()
        if frame.kind == "literal":
            frame.text.append(f"</{frame.predicate}>")
            self.stack[-1].depth -= 1
            return
        if frame.kind == "node" and frame.parse_type == "inner":
            frame = self.stack.pop()
        if frame.kind != "property":
            return
        text = "".join(frame.text)
        if frame.collection is not None:
            cells = [self.new() for _ in frame.collection]
            for cell, item, rest in zip(cells, frame.collection, [*cells[1:], RDF_NIL][: len(cells)], strict=True):
                self.add(cell, RDF_FIRST, item)
                self.add(cell, RDF_REST, rest)
            value = cells[0] if cells else RDF_NIL
        elif frame.parse_type == "Literal":
            value = literal(text, datatype=RDF + "XMLLiteral")
        elif frame.object is not None:
            if text.strip():
                self.fail("text beside a node")
            value = frame.object
        else:
            value = literal(text, None if frame.datatype else frame.lang, self.resolve(frame.datatype, frame.base)[1:-1] if frame.datatype else None)
        self.add(frame.subject, frame.predicate, value)
        if frame.reify:
            for p, o in (("type", iri(RDF + "Statement")), ("subject", frame.subject), ("predicate", frame.predicate), ("object", value)):
                self.add(frame.reify, iri(RDF + p), o)


def parse(text: str, base: str = "", graph: str = "", scope: str = "") -> list[Statement]:
    """Statements of an RDF/XML document; external entities are not read."""
    handler = _Handler(base, graph, scope)
    reader = xml.sax.make_parser()
    reader.setFeature(xml.sax.handler.feature_namespaces, True)
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setFeature(xml.sax.handler.feature_external_pes, False)
    reader.setContentHandler(handler)
    try:
        reader.parse(StringIO(text))
    except xml.sax.SAXParseException as e:
        raise RdfError(f"line {e.getLineNumber()}, column {e.getColumnNumber() + 1}: {e.getMessage()}") from e
    return handler.out
