"""The algebra a SPARQL query is parsed to."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def hidden(self) -> bool:
        """Whether it stands for a blank node of the query, which is no result column."""
        return self.name.startswith("_:")


@dataclass(frozen=True)
class Triple:
    """A pattern; each part a Var or the canonical text of a term. graph None: the default graph."""

    s: Var | str
    p: Var | str
    o: Var | str
    graph: Var | str | None = None

    def variables(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in (self.s, self.p, self.o, self.graph) if isinstance(x, Var)))


class Node:
    pass


@dataclass
class BGP(Node):
    triples: list[Triple]


@dataclass
class Join(Node):
    left: Node
    right: Node


@dataclass
class LeftJoin(Node):
    left: Node
    right: Node
    condition: Expr | None = None


@dataclass
class Union(Node):
    left: Node
    right: Node


@dataclass
class Filter(Node):
    condition: Expr
    node: Node


@dataclass
class Expr:
    """op with arguments: "var" (name), "term" (text), a comparison, "&&", "||", "!", arithmetic, "neg", or "call" (IRI or
    built-in name, arguments)."""

    op: str
    args: tuple = ()

    def variables(self) -> set[str]:
        if self.op == "var":
            return {self.args[0]}
        return set().union(*[a.variables() for a in self.args if isinstance(a, Expr)]) if self.args else set()


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    where: Node = field(default_factory=lambda: BGP([]))
    variables: list[str] | None = None  # None: all that are visible
    distinct: bool = False
    reduced: bool = False
    template: list[Triple] = field(default_factory=list)
    resources: list[Var | str] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # expression, ascending
    limit: int | None = None
    offset: int = 0
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)


def visible(node: Node) -> list[str]:
    """The variables of a pattern in order of appearance, those of blank nodes left out."""
    seen: dict[str, None] = {}

    def walk(n: Node) -> None:
        if isinstance(n, BGP):
            for t in n.triples:
                for x in (t.s, t.p, t.o, t.graph):
                    if isinstance(x, Var) and not x.hidden:
                        seen[x.name] = None
        elif isinstance(n, Filter):
            walk(n.node)
        else:
            walk(n.left)
            walk(n.right)

    walk(node)
    return list(seen)


def shared(node: Node) -> set[str]:
    """The variables that occur in several groups of patterns or in a condition."""
    groups: list[set[str]] = []
    tests: set[str] = set()

    def walk(n: Node) -> None:
        if isinstance(n, BGP):
            groups.append({v for t in n.triples for v in t.variables()})
            return
        if isinstance(n, (Filter, LeftJoin)) and n.condition is not None:
            tests.update(n.condition.variables())
        for x in (n.node,) if isinstance(n, Filter) else (n.left, n.right):
            walk(x)

    walk(node)
    return tests | {v for i, g in enumerate(groups) for v in g if any(v in h for h in groups[:i])}
