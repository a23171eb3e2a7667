"""A parser of N3 and its parts Turtle and N-Triples: one lenient grammar, statements as tuples of canonical terms."""

from __future__ import annotations

import re

from quadflow.functions.terms import LOG, OWL, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD, bnode, iri, literal, resolved, unescape

Statement = tuple[str, str, str, str]
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      | (?P<iri><[^<>"{}|^`\x00-\x20]*>)
      | (?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
      | (?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<var>\?\w+)
      | (?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+)
      | (?P<decimal>[+-]?[0-9]*\.[0-9]+)
      | (?P<integer>[+-]?[0-9]+)
      | (?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
      | (?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)
      | (?P<word>[^\W\d_][\w-]*)
      | (?P<sign>\^\^|=>|<=|[{}()\[\].;,=!^])""",
    re.X | re.S,
)
_KEYWORDS = {"a", "is", "of", "has", "true", "false", "this"}


class RdfError(ValueError):
    """A document that does not parse; the message has the line and column."""


class Parser:
    """scope makes labels of blank nodes differ between documents; graph is where top-level statements go."""

    def __init__(self, text: str, base: str = "", graph: str = "", scope: str = "") -> None:
        self.text, self.base, self.graph, self.scope = text.removeprefix("﻿"), base, graph, scope
        self.prefixes: dict[str, str] = {}
        self.out: list[Statement] = []
        self.warnings: list[str] = []
        self.fresh = 0
        self.keywords = _KEYWORDS
        self.bare_names = False  # after @keywords, words that are no keyword are names without prefix
        self.at = 0
        self.token: tuple[str, str] = ("", "")
        self.next()

    def next(self) -> tuple[str, str]:
        now = self.token
        while True:
            if self.at >= len(self.text):
                self.token, self.start = ("end", ""), self.at
                return now
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.start = self.at
                self.fail(f"cannot read {self.text[self.at : self.at + 20]!r}")
            self.start, self.at = self.at, m.end()
            if m.lastgroup != "space":
                self.token = (m.lastgroup, m[0])
                return now

    def fail(self, why: str) -> None:
        line = self.text.count("\n", 0, self.start) + 1
        raise RdfError(f"line {line}, column {self.start - self.text.rfind(chr(10), 0, self.start)}: {why}")

    def sign(self, value: str) -> bool:
        if self.token == ("sign", value):
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.sign(value):
            self.fail(f"expected {value}, found {self.token[1] or 'the end'!r}")

    def new(self) -> str:
        self.fresh += 1
        return bnode(f"{self.scope}n{self.fresh}")

    def parse(self) -> list[Statement]:
        while self.token[0] != "end":
            self.statement(self.graph)
        return self.out

    def statement(self, graph: str, close: str = "") -> None:
        kind, value = self.token
        if kind == "at" or (kind == "word" and value.upper() in ("PREFIX", "BASE")):
            self.directive()
            return
        subject = self.path(graph)
        if not (self.token[0] == "sign" and self.token[1] in (".", close)):
            self.properties(subject, graph)
        if not self.sign("."):
            if close and self.token == ("sign", close):
                return
            self.fail(f"expected ., found {self.token[1] or 'the end'!r}")

    def directive(self) -> None:
        _, word = self.next()
        name = word.lstrip("@").lower()
        if name == "prefix":
            kind, prefix = self.next()
            if kind != "name" or not prefix.endswith(":"):
                self.fail("expected a prefix")
            self.prefixes[prefix[:-1]] = self.resolve(self.iri_token())
        elif name == "base":
            self.base = self.resolve(self.iri_token())
        elif name == "keywords":
            words = set()
            while self.token[0] == "word":
                words.add(self.next()[1])
                self.sign(",")
            self.keywords, self.bare_names = words, True
        elif name in ("forall", "forsome"):
            while self.token[0] in ("iri", "name", "var"):
                self.next()
                self.sign(",")
        else:
            self.fail(f"unknown directive {word}")
        if word.startswith("@"):
            self.expect(".")
        else:
            self.sign(".")

    def iri_token(self) -> str:
        kind, value = self.next()
        if kind != "iri":
            self.fail("expected an IRI")
        return unescape(value[1:-1])

    def resolve(self, relative: str) -> str:
        return resolved(relative, self.base) if self.base and ":" not in relative.split("/")[0] else relative

    def properties(self, subject: str, graph: str) -> None:
        while True:
            kind, value = self.token
            inverse = False
            if kind == "sign" and value in ("=", "=>", "<="):
                self.next()
                predicate = iri(OWL + "sameAs") if value == "=" else iri(LOG + "implies")
                inverse = value == "<="
            elif kind == "word" and value in self.keywords and value in ("a", "is", "has"):
                self.next()
                if value == "a":
                    predicate = RDF_TYPE
                else:
                    predicate = self.path(graph)
                    if value == "is":
                        inverse = True
                        if self.token != ("word", "of"):
                            self.fail("expected of")
                        self.next()
            else:
                predicate = self.path(graph)
                if predicate.startswith('"'):
                    self.fail("a literal cannot be a predicate")
            while True:
                o = self.path(graph)
                s, x = (o, subject) if inverse else (subject, o)
                if s.startswith('"') and not graph:
                    self.warnings.append(f"a literal subject was left out: {s}")
                else:
                    self.out.append((s, predicate, x, graph))
                if not self.sign(","):
                    break
            if not self.sign(";"):
                return
            while self.sign(";"):
                pass
            if self.token[0] == "end" or self.token[0] == "sign" and self.token[1] in (".", "]", "}"):
                return

    def path(self, graph: str) -> str:
        node = self.node(graph)
        while self.token[0] == "sign" and self.token[1] in ("!", "^"):
            _, way = self.next()
            predicate, other = self.node(graph), self.new()
            self.out.append((node, predicate, other, graph) if way == "!" else (other, predicate, node, graph))
            node = other
        return node

    def node(self, graph: str) -> str:
        kind, value = self.token
        if kind == "iri":
            self.next()
            return iri(self.resolve(unescape(value[1:-1])))
        if kind == "name":
            self.next()
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                if prefix == "":
                    return iri(self.resolve("#" + local))
                self.fail(f"unknown prefix {prefix}")
            return iri(self.prefixes[prefix] + local)
        if kind == "bnode":
            self.next()
            return bnode(self.scope + value[2:])
        if kind == "var":
            self.next()
            return value
        if kind in ("integer", "decimal", "double"):
            self.next()
            return literal(value, datatype=XSD + kind)
        if kind == "word":
            self.next()
            if value in ("true", "false"):
                return literal(value, datatype=XSD + "boolean")
            if value == "a":
                return RDF_TYPE
            if self.bare_names and value not in self.keywords:
                return iri(self.prefixes[""] + value if "" in self.prefixes else self.resolve("#" + value))
            self.fail(f"unexpected {value}")
        if kind in ("text", "long"):
            self.next()
            n = 3 if kind == "long" else 1
            text = unescape(value[n:-n])
            if self.token[0] == "at":
                return literal(text, lang=self.next()[1][1:])
            if self.sign("^^"):
                return literal(text, datatype=self.node(graph)[1:-1])
            return literal(text)
        if self.sign("["):
            node = self.new()
            if not self.sign("]"):
                self.properties(node, graph)
                self.expect("]")
            return node
        if self.sign("("):
            items = []
            while not self.sign(")"):
                items.append(self.path(graph))
            if not items:
                return RDF_NIL
            cells = [self.new() for _ in items]
            for cell, item, rest in zip(cells, items, [*cells[1:], RDF_NIL], strict=True):
                self.out.append((cell, RDF_FIRST, item, graph))
                self.out.append((cell, RDF_REST, rest, graph))
            return cells[0]
        if self.sign("{"):
            formula = self.new()
            while not self.sign("}"):
                self.statement(formula, "}")
            return formula
        self.fail(f"expected a term, found {value or 'the end'!r}")


def parse(text: str, base: str = "", graph: str = "", scope: str = "") -> list[Statement]:
    return Parser(text, base, graph, scope).parse()


def rules(statements: list[Statement]) -> tuple[list, list[Statement]]:
    """(rules, ground statements) of a parsed N3 document: every {body} => {head}, and what else is in no formula.

    Lists in bodies that are arguments of arithmetic relations become their arguments.
    """
    from quadflow.plans.algebra import Triple, Var
    from quadflow.reason.mathrel import name_of
    from quadflow.reason.rules import Call, Rule

    implies = iri(LOG + "implies")
    by_graph: dict[str, list[Statement]] = {}
    for s in statements:
        by_graph.setdefault(s[3], []).append(s)
    first = {(s[3], s[0]): s[2] for s in statements if s[1] == RDF_FIRST}
    rest = {(s[3], s[0]): s[2] for s in statements if s[1] == RDF_REST}
    made, ground = [], []
    term = lambda x: Var(x[1:]) if x.startswith("?") else Var(x) if x.startswith("_:") else x

    def items(graph: str, cell: str) -> list[str] | None:
        out = []
        while cell != RDF_NIL:
            if (graph, cell) not in first or (graph, cell) not in rest:
                return None
            out.append(first[graph, cell])
            cell = rest[graph, cell]
        return out

    for s, p, o, g in statements:
        if g:
            continue
        if p != implies:
            ground.append((s, p, o, g))
            continue
        body, used = [], set()
        for bs, bp, bo, _ in by_graph.get(s, []):
            if name_of(bp) and (args := items(s, bs)) is not None:
                body.append(Call(name_of(bp), tuple(term(a) for a in args), term(bo)))
                cell = bs
                while cell != RDF_NIL:
                    used.add(cell)
                    cell = rest[s, cell]
        body += [Triple(term(bs), bp if not bp.startswith("?") else term(bp), term(bo)) for bs, bp, bo, _ in by_graph.get(s, []) if not (bs in used and bp in (RDF_FIRST, RDF_REST)) and not (name_of(bp) and items(s, bs) is not None)]
        head = [Triple(term(hs), hp if not hp.startswith("?") else term(hp), term(ho)) for hs, hp, ho, _ in by_graph.get(o, [])]
        made.append(Rule(body, head, f"rule {len(made)}"))
    return made, ground
