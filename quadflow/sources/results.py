"""Solutions as SPARQL results XML, CSV, HTML and text, and that XML as solutions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable
from html import escape

from pyspark.sql import DataFrame, SparkSession

from quadflow.functions import terms as T

# Fixed value: the namespace of the public results format.
NS = "http://www.w3.org/2005/sparql-results#"


def results_xml(variables: list[str], rows: Iterable[tuple], comments: Iterable[str] = ()) -> str:
    """SPARQL results XML; unbound variables are left out and blank nodes become r1, r2, ... in order of appearance."""
    root = ET.Element("sparql", xmlns=NS)
    for c in comments:
        root.append(ET.Comment(c.replace("--", "- -")))
    head = ET.SubElement(root, "head")
    for v in variables:
        ET.SubElement(head, "variable", name=v)
    results = ET.SubElement(root, "results")
    labels: dict[str, str] = {}
    for row in rows:
        result = ET.SubElement(results, "result")
        for v, term in zip(variables, row, strict=True):
            if term is None:
                continue
            b = ET.SubElement(result, "binding", name=v)
            t = T.parse_term(term)
            if t.kind == "U":
                ET.SubElement(b, "uri").text = t.value
            elif t.kind == "B":
                ET.SubElement(b, "bnode").text = labels.setdefault(t.value, f"r{len(labels) + 1}")
            else:
                e = ET.SubElement(b, "literal")
                e.text = t.value
                if t.lang:
                    e.set("xml:lang", t.lang)
                elif t.datatype:
                    e.set("datatype", t.datatype)
    ET.indent(root)
    return '<?xml version="1.0"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def ask_xml(answer: bool) -> str:
    return f'<?xml version="1.0"?>\n<sparql xmlns="{NS}">\n  <head />\n  <boolean>{"true" if answer else "false"}</boolean>\n</sparql>\n'


def parse_results_xml(text: str) -> tuple[list[str], list[tuple]] | bool:
    """(variables, rows of terms), or the answer of an ASK."""
    root = ET.fromstring(text)
    if (answer := root.find(f"{{{NS}}}boolean")) is not None:
        return (answer.text or "").strip() == "true"
    names = [v.get("name") for v in root.iterfind(f"{{{NS}}}head/{{{NS}}}variable")]
    rows = []
    for result in root.iterfind(f"{{{NS}}}results/{{{NS}}}result"):
        row = dict.fromkeys(names)
        for b in result:
            x = b[0]
            kind = x.tag.removeprefix(f"{{{NS}}}")
            value = x.text or ""
            row[b.get("name")] = T.iri(value) if kind == "uri" else T.bnode(value) if kind == "bnode" else T.literal(value, x.get("{http://www.w3.org/XML/1998/namespace}lang"), x.get("datatype"))
        rows.append(tuple(row[n] for n in names))
    return names, rows


def from_results_xml(spark: SparkSession, text: str) -> DataFrame:
    parsed = parse_results_xml(text)
    if isinstance(parsed, bool):
        return spark.createDataFrame([(parsed,)], "result boolean")
    names, rows = parsed
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def select_text(patterns: list[tuple], variables: list[str], limit: int | None = None) -> str:
    """The SPARQL of a graph pattern, for an endpoint: terms as they are, ?x for variables."""
    body = " . ".join(" ".join(t) for t in patterns)
    return f"SELECT {' '.join('?' + v for v in variables)} WHERE {{ {body} }}" + (f" LIMIT {limit}" if limit is not None else "")


def ask_text(patterns: list[tuple]) -> str:
    return "ASK { " + " . ".join(" ".join(t) for t in patterns) + " }"


def _cell(term: str | None) -> str:
    return "" if term is None else T.parse_term(term).value if not term.startswith("_:") else term


def results_csv(variables: list[str], rows: Iterable[tuple]) -> str:
    """A cell is quoted if it has a comma, a line break or a blank at an end; quotes inside are doubled then."""

    def cell(term: str | None) -> str:
        text = _cell(term)
        if any(c in text for c in ",\n\r") or text != text.strip():
            return '"' + text.replace('"', '""') + '"'
        return text

    return "".join(",".join(x) + "\n" for x in [variables, *[[cell(c) for c in r] for r in rows]])


def results_html(variables: list[str], rows: Iterable[tuple]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>\n"
    return "<table>\n" + line("th", variables) + "".join(line("td", [_cell(c) for c in r]) for r in rows) + "</table>\n"


def results_text(variables: list[str], rows: Iterable[tuple]) -> str:
    """A line a solution: name = term for every bound variable."""
    return "".join("; ".join(f"?{v} = {c}" for v, c in zip(variables, r, strict=True) if c is not None) + "\n" for r in rows)


def results_answers(variables: list[str], rows: Iterable[tuple]) -> str:
    """Tab-separated values under a line of names in upper case."""
    return "\t".join(v.upper() for v in variables) + "\n" + "".join("\t".join(_cell(c) for c in r) + "\n" for r in rows)


WRITERS = {"xml": results_xml, "csv": results_csv, "html": results_html, "simple": results_text, "answers": results_answers}


def formatted(df: DataFrame, format: str) -> str:  # noqa: A002
    """A SELECT's solutions as text, streamed through the driver a partition at a time."""
    return WRITERS[format](df.columns, (tuple(r) for r in df.toLocalIterator()))
