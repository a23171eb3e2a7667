"""Quads as documents: N-Triples and N-Quads in parallel, the other formats from one sorted stream."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.functions.namespaces import Namespaces
from quadflow.sources.n3 import Statement

_LOG_FORMULA, _LOG_INCLUDES = f"<{T.LOG}Formula>", f"<{T.LOG}includes>"
#: Lines of a compressed file.
FILE_LINES = 4_000_000
#: Datatypes whose literals Turtle writes bare, if the text is one that reads back with the same datatype.
_BARE = {T.XSD + "integer": r"[+-]?[0-9]+", T.XSD + "decimal": r"[+-]?[0-9]*\.[0-9]+", T.XSD + "double": r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+", T.XSD + "boolean": "true|false"}


def ascii_term(term: str) -> str:
    """A term with characters beyond ASCII, and control characters, as escapes."""
    out = []
    for c in term:
        code = ord(c)
        if 0x20 <= code < 0x7F:
            out.append(c)
        elif code > 0xFFFF:
            out.append(f"\\U{code:08X}")
        else:
            out.append({"\t": "\\t", "\n": "\\n", "\r": "\\r"}.get(c, f"\\u{code:04X}"))
    return "".join(out)


def reified(quads: DataFrame) -> DataFrame:
    """Triples that say the same as quads with graphs: a graph is a formula that includes its statements as resources."""
    named = quads.where("g <> ''")
    st = F.concat(F.lit("_:st"), F.sha1(F.concat_ws("\x1f", "s", "p", "o", "g")))
    rdf = lambda n: F.lit(f"<{T.RDF}{n}>")
    rows = F.array(
        F.struct(F.col("g").alias("s"), F.lit(_LOG_INCLUDES).alias("p"), st.alias("o")),
        F.struct(st.alias("s"), F.lit(T.RDF_TYPE).alias("p"), rdf("Statement").alias("o")),
        *[F.struct(st.alias("s"), rdf(n).alias("p"), F.col(c).alias("o")) for n, c in (("subject", "s"), ("predicate", "p"), ("object", "o"))],
    )
    formulas = named.select(F.col("g").alias("s"), F.lit(T.RDF_TYPE).alias("p"), F.lit(_LOG_FORMULA).alias("o")).distinct()
    return quads.where("g = ''").select("s", "p", "o").unionByName(formulas).unionByName(named.select(F.explode(rows).alias("x")).select("x.*"))


def nt_lines(quads: DataFrame, graphs: str = "quads") -> DataFrame:
    """(value): one line a statement, its full stop right after the object. graphs: "quads" writes N-Quads lines where a
    statement has a graph, "reify" triples only. Characters beyond ASCII are written as they are."""
    rows = reified(quads).withColumn("g", F.lit("")) if graphs == "reify" else quads
    return rows.select(F.concat(F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), F.col("o"), F.when(F.col("g") != "", F.concat(F.lit(" "), F.col("g"), F.lit(" "))).otherwise(""), F.lit(".")).alias("value"))


class TurtleWriter:
    """Statements as Turtle, in the order they come; runs of a subject and of a predicate are written once."""

    def __init__(self, namespaces: Namespaces | None = None, base: str = "") -> None:
        self.ns, self.base = namespaces or Namespaces(), base

    def term(self, t: str, predicate: bool = False) -> str:
        if predicate and t == T.RDF_TYPE:
            return "a"
        if t.startswith("<"):
            text = t[1:-1]
            if self.base and text.startswith(self.base):
                return f"<{ascii_term(text[len(self.base) :])}>"
            return self.ns.normalize(text) or f"<{ascii_term(text)}>"
        if t.startswith('"'):
            x = T.parse_term(t)
            if x.datatype in _BARE and re.fullmatch(_BARE[x.datatype], x.value):
                return x.value
            if x.datatype:
                return ascii_term(T.literal(x.value)) + "^^" + self.term(f"<{x.datatype}>")
            return ascii_term(t)
        return t

    def header(self) -> str:
        return "".join(f"@prefix {p}: <{ascii_term(ns)}>.\n" for p, ns in self.ns.by_prefix.items())

    def body(self, statements: Iterable[Statement]) -> str:
        out, subject, predicate = [], None, None
        for s, p, o, *_ in self.flat(statements):
            if s != subject:
                out.append(f"{'.' + chr(10) if subject is not None else ''}{self.term(s)} {self.term(p, True)} {self.term(o)}")
            elif p != predicate:
                out.append(f";\n\t{self.term(p, True)} {self.term(o)}")
            else:
                out.append(f",\n\t\t{self.term(o)}")
            subject, predicate = s, p
        return "".join(out) + ("." if subject is not None else "")

    @staticmethod
    def flat(statements: Iterable[Statement]) -> Iterable[tuple[str, str, str]]:
        known, n = set(), 0
        for s, p, o, *g in statements:
            if not g or not g[0]:
                yield s, p, o
                continue
            g, n = g[0], n + 1
            if g not in known:
                known.add(g)
                yield g, T.RDF_TYPE, _LOG_FORMULA
            st = f"_:bnode{n}"
            yield g, _LOG_INCLUDES, st
            yield st, T.RDF_TYPE, f"<{T.RDF}Statement>"
            yield from ((st, f"<{T.RDF}{k}>", v) for k, v in (("subject", s), ("predicate", p), ("object", o)))

    def document(self, statements: Iterable[Statement]) -> str:
        return self.header() + self.body(statements)


class N3Writer(TurtleWriter):
    """Statements as N3: formulas in braces, collections in parentheses, = and => for their relations."""

    def document(self, statements: Iterable[Statement]) -> str:
        rows = list(dict.fromkeys((*s, "") if len(s) == 3 else tuple(s) for s in statements))
        self.graphs: dict[str, list[Statement]] = defaultdict(list)
        for r in rows:
            self.graphs[r[3]].append(r)
        self.first = {r[0]: r[2] for r in rows if r[1] == T.RDF_FIRST and r[0].startswith("_:")}
        self.rest = {r[0]: r[2] for r in rows if r[1] == T.RDF_REST and r[0].startswith("_:")}
        tails = set(self.rest.values())
        # a cell is written inside its list: heads wherever they are used, the others never by themselves
        used = {x for r in rows for x in ((r[0], r[2]) if r[1] not in (T.RDF_FIRST, T.RDF_REST) else ())}
        self.cells = {c for c in self.first if c in self.rest or c in tails} if any(h in used for h in self.first) else set()
        self.used = used
        top = [r for r in self.graphs[""] if not (r[0] in self.cells and r[1] in (T.RDF_FIRST, T.RDF_REST))]
        top.sort(key=lambda r: (r[0].startswith("_:"), r[0] if not r[0].startswith("_:") else ""))
        return self.header() + self.body(top)

    def term(self, t: str, predicate: bool = False) -> str:
        if predicate and t in (f"<{T.OWL}sameAs>", f"<{T.LOG}implies>"):
            return "=" if t == f"<{T.OWL}sameAs>" else "=>"
        if t in getattr(self, "cells", ()):
            items, cell = [], t
            while cell in self.first:
                if not (self.first[cell] == T.RDF_NIL and self.rest.get(cell) == T.RDF_NIL and cell == t):
                    items.append(self.term(self.first[cell]))
                cell = self.rest.get(cell, f"_:bnode{abs(hash(cell)) % 10**6}")
            if cell != T.RDF_NIL:
                items.append(cell)
            return "(" + ("\n " if any(x.startswith("{") for x in items) else " ").join(items) + ")"
        if t == T.RDF_NIL:
            return "()"
        if t in getattr(self, "graphs", {}) and t:
            inner = [r for r in self.graphs[t] if not (r[0] in self.cells and r[1] in (T.RDF_FIRST, T.RDF_REST))]
            lines = []
            for s, p, o, _ in inner:
                formula = any(x in self.graphs and x for x in (s, o))
                lines.append(f"{self.term(s)}{chr(10) if formula else ' '}{self.term(p, True)}{chr(10) if formula else ' '}{self.term(o)}.")
            if len(lines) == 1 and "\n" not in lines[0]:
                return "{" + lines[0] + "}"
            return "{\n" + "\n".join(x if "\n" in x else " " + x for x in lines) + "\n}"
        return super().term(t, predicate)

    @staticmethod
    def flat(statements: Iterable[Statement]) -> Iterable[tuple[str, str, str]]:
        return ((s, p, o) for s, p, o, *_ in statements)


@dataclass
class XmlOptions:
    """typed_nodes: a node's type as its element's name; embed: a blank node inside the one statement that points at it;
    attributes: plain literals that come once as attributes; members: rdf:li for members in order; collections:
    parseType Collection."""

    typed_nodes: bool = True
    embed: bool = True
    attributes: bool = False
    members: bool = True
    collections: bool = True

    @classmethod
    def metadata(cls) -> XmlOptions:
        """What embedded metadata packets want: plain descriptions."""
        return cls(typed_nodes=False, attributes=False, collections=False)


def rdf_xml(statements: Iterable[Statement], namespaces: Namespaces | None = None, options: XmlOptions | None = None) -> str:
    """An RDF/XML document. It cannot hold graphs: a statement with one is an error, as is a predicate without a name."""
    o = options or XmlOptions()
    ns = Namespaces({p: x for p, x in (namespaces or Namespaces()).by_prefix.items() if p})  # a name without prefix is no name here
    ns.add("rdf", T.RDF)
    by: dict[str, list[Statement]] = defaultdict(list)
    pointed: dict[str, int] = defaultdict(int)
    for s in dict.fromkeys(tuple(x) for x in statements):
        if len(s) > 3 and s[3]:
            raise ValueError("RDF/XML has no graphs")
        by[s[0]].append(s)
        if s[2].startswith("_:"):
            pointed[s[2]] += 1
    done: set[str] = set()

    def name(t: str) -> str:
        found = ns.auto(t[1:-1])
        if not found or found.endswith(":"):
            raise ValueError(f"{t} cannot be an element's name")
        return found

    def label(t: str) -> str:
        return re.sub(r"[^\w.-]", "_", t[2:]) if re.match(r"[^\W\d]", t[2:]) else "b" + re.sub(r"[^\w.-]", "_", t[2:])

    def collection(t: str) -> list[str] | None:
        items, seen = [], set()
        while t != T.RDF_NIL:
            first = [x[2] for x in by[t] if x[1] == T.RDF_FIRST]
            rest = [x[2] for x in by[t] if x[1] == T.RDF_REST]
            if len(by[t]) != 2 or len(first) != 1 or len(rest) != 1 or first[0].startswith('"') or t in seen or pointed[t] != 1:
                return None
            seen.add(t)
            items.append(first[0])
            t = rest[0]
        done.update(seen)
        return items

    def node(t: str, depth: int) -> list[str]:
        done.add(t)
        pad = "  " * depth
        mine = sorted(by[t], key=lambda x: (0, int(m[1])) if (m := re.fullmatch(rf"<{re.escape(T.RDF)}_(\d+)>", x[1])) else (-1, 0))
        types = [x for x in mine if x[1] == T.RDF_TYPE and x[2].startswith("<")]
        tag = "rdf:Description"
        if o.typed_nodes and types and (found := ns.auto(types[0][2][1:-1])) and not found.endswith(":"):
            tag, mine = found, [x for x in mine if x is not types[0]]
        head = f" rdf:about={quoteattr(t[1:-1])}" if t.startswith("<") else f" rdf:nodeID={quoteattr(label(t))}" if pointed[t] != 1 or not o.embed else ""
        body: list[str] = []
        member = 0
        for _, p, x, *_ in mine:
            m = re.fullmatch(rf"<{re.escape(T.RDF)}_(\d+)>", p)
            if m and o.members and int(m[1]) == member + 1:
                member, tag_p = member + 1, "rdf:li"
            else:
                tag_p = name(p)
            if x.startswith('"'):
                v = T.parse_term(x)
                if o.attributes and p != T.RDF_TYPE and not v.lang and not v.datatype and sum(y[1] == p for y in mine) == 1 and not m:
                    head += f" {tag_p}={quoteattr(v.value)}"
                    continue
                extra = f" xml:lang={quoteattr(v.lang)}" if v.lang else f" rdf:datatype={quoteattr(v.datatype)}" if v.datatype else ""
                body.append(f"{pad}  <{tag_p}{extra}>{xml_escape(v.value)}</{tag_p}>")
            elif o.collections and x.startswith("_:") and any(y[1] == T.RDF_FIRST for y in by[x]) and (items := collection(x)) is not None:
                body.append(f'{pad}  <{tag_p} rdf:parseType="Collection">')
                for i in items:
                    body += node(i, depth + 2) if i not in done and by[i] and i.startswith("_:") else [f"{pad}    <rdf:Description {'rdf:about=' + quoteattr(i[1:-1]) if i.startswith('<') else 'rdf:nodeID=' + quoteattr(label(i))}/>"]
                body.append(f"{pad}  </{tag_p}>")
            elif x.startswith("_:") and o.embed and pointed[x] == 1 and x not in done and by[x]:
                body += [f"{pad}  <{tag_p}>", *node(x, depth + 2), f"{pad}  </{tag_p}>"]
            elif x.startswith("_:"):
                body.append(f"{pad}  <{tag_p} rdf:nodeID={quoteattr(label(x))}/>")
                pointed[x] = max(pointed[x], 2)
            else:
                body.append(f"{pad}  <{tag_p} rdf:resource={quoteattr(x[1:-1])}/>")
        return [f"{pad}<{tag}{head}>", *body, f"{pad}</{tag}>"] if body else [f"{pad}<{tag}{head}/>"]

    roots = sorted(by, key=lambda t: (t.startswith("_:") and pointed[t] == 1, t.startswith("_:"), t))
    lines = []
    for t in roots:
        if t not in done:
            if t.startswith("_:") and pointed[t] == 1:
                pointed[t] = 2  # on a loop: it needs a label after all
            lines += node(t, 1)
    head = "".join(f" xmlns:{p}={quoteattr(u)}" if p else f" xmlns={quoteattr(u)}" for p, u in ns.by_prefix.items())
    return '<?xml version="1.0"?>\n<rdf:RDF' + head + ">\n" + "\n".join(lines) + "\n</rdf:RDF>\n"


def graphviz(statements: Iterable[Statement], namespaces: Namespaces | None = None) -> str:
    """A drawing for GraphViz: IRIs as ovals, blank nodes as points, literals as boxes; types go into labels."""
    ns = namespaces or Namespaces()
    ids: dict[tuple, str] = {}
    kinds: dict[tuple, list[str]] = defaultdict(list)
    edges = []
    short = lambda t, n: t if len(t) <= n else t[: n - 3] + "..."
    shown = lambda t: ns.normalize(t[1:-1]) or t[1:-1]
    for s, p, o, *g in statements:
        if g and g[0]:
            raise ValueError("a drawing has no graphs")
        ids.setdefault((s,), f"n{len(ids)}")
        if p == T.RDF_TYPE and o.startswith("<"):
            kinds[s,].append(shown(o))
            continue
        key = (o, s, p) if o.startswith('"') else (o,)  # a literal is drawn at each use
        ids.setdefault(key, f"n{len(ids)}")
        edges.append(((s,), p, key))
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    lines = []
    for t, i in ids.items():
        if t[0].startswith("<"):
            text, shape = short(shown(t[0]), 30), "ellipse"
        elif t[0].startswith("_:"):
            text, shape = "", "circle"
        else:
            text, shape = short(T.parse_term(t[0]).value, 15), "box"
        label = "\n".join([text, *kinds[t]]).strip()
        lines.append(f"  {i} [label={quote(label)}, shape={shape}];")
    lines += [f"  {ids[s]} -> {ids[o]} [label={quote(short(shown(p), 15))}];" for s, p, o in edges]
    return "digraph g {\n" + "\n".join(lines) + "\n}\n"


def _stream(quads: DataFrame) -> Iterable[Statement]:
    return (tuple(r) for r in quads.select("s", "p", "o", "g").orderBy(F.col("s").startswith("_:"), "s", "p", "o").toLocalIterator())


def write_rdf(quads: DataFrame, path: str, format: str = "nt", prefixes: dict[str, str] | None = None, base: str = "", **options: object) -> None:  # noqa: A002
    """nt, nquads and reified triples become a folder of files, written in parallel; turtle too, each file a document of
    its own range of subjects. n3, xml and dot are one file, made on the driver from a sorted stream: for small graphs.
    nt takes a compression."""
    name = {"ntriples": "nt", "nq": "nt", "nquads": "nt", "ttl": "turtle", "rdf": "xml", "graphviz": "dot", "text/turtle": "turtle", "application/rdf+xml": "xml", "text/n3": "n3", "text/plain": "nt"}.get(format, format)
    ns = Namespaces(prefixes)
    if name == "nt":
        lines = nt_lines(quads, str(options.get("graphs", "quads"))).write
        if options.get("compression"):  # such a file is read by one task
            lines = lines.option("maxRecordsPerFile", FILE_LINES)
        lines.text(path, compression=options.get("compression"))
        return
    if name == "turtle":
        def run(batches):  # noqa: ANN001, ANN202
            import pandas as pd

            writer = TurtleWriter(ns, base)
            text = writer.document(row for pdf in batches for row in pdf.itertuples(index=False, name=None))
            if text != writer.header():
                yield pd.DataFrame({"value": [text]})

        flat = reified(quads)
        flat.repartitionByRange("s").sortWithinPartitions("s", "p", "o").mapInPandas(run, "value string").write.text(path)
        return
    text = {"n3": lambda: N3Writer(ns, base).document(_stream(quads)), "xml": lambda: rdf_xml(_stream(quads), ns, options.get("options")), "dot": lambda: graphviz(_stream(quads), ns)}[name]()
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
