"""RDF terms as canonical N-Triples text: <iri>, _:label, "text", "text"@lang, "text"^^<datatype>. Null is unbound."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and terms of the public RDF, RDFS, OWL and XML Schema vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
LOG = "http://www.w3.org/2000/10/swap/log#"
MATH = "http://www.w3.org/2000/10/swap/math#"
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL = f"<{RDF}type>", f"<{RDF}first>", f"<{RDF}rest>", f"<{RDF}nil>"
RDFS_MEMBER = f"<{RDFS}member>"
INTEGERS = ("integer", "nonPositiveInteger", "negativeInteger", "nonNegativeInteger", "positiveInteger", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
NUMERIC = (*INTEGERS, "decimal", "float", "double")
DEFAULT_GRAPH = ""
QUADS = "s string, p string, o string, g string, o_kind string, o_val string, o_lang string, o_dt string"

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_TERM = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^>]*)>)?', re.S)
_UNESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def escape(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    return _UNESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), text)


def iri(text: str) -> str:
    return f"<{text}>"


def bnode(label: str) -> str:
    return f"_:{label}"


def literal(text: str, lang: str | None = None, datatype: str | None = None) -> str:
    if text is None or lang == "" or datatype == "":
        raise ValueError("a literal has a text, and no empty language or datatype")
    return f'"{escape(text)}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")


def resolved(relative: str, base: str) -> str:
    """An IRI in full; unlike urljoin alone it keeps an empty fragment."""
    out = urljoin(base, relative) if base else relative
    return out + "#" if relative.endswith("#") and not out.endswith("#") else out


@dataclass(frozen=True)
class Term:
    """A term taken apart: kind U (IRI), B (blank node) or L (literal)."""

    kind: str
    value: str
    lang: str | None = None
    datatype: str | None = None

    def __str__(self) -> str:
        return iri(self.value) if self.kind == "U" else bnode(self.value) if self.kind == "B" else literal(self.value, self.lang, self.datatype)


def parse_term(text: str) -> Term:
    """The parts of a canonical term, or an error."""
    if text.startswith("<") and text.endswith(">"):
        return Term("U", text[1:-1])
    if text.startswith("_:") and len(text) > 2:
        return Term("B", text[2:])
    if m := _TERM.fullmatch(text):
        return Term("L", unescape(m[1]), m[2], m[3])
    raise ValueError(f"not a term: {text}")


def from_value(value: object) -> str:
    """The term of a native value: a literal with its XML Schema datatype; text becomes a plain literal."""
    if isinstance(value, bool):
        return literal("true" if value else "false", datatype=XSD + "boolean")
    if isinstance(value, int):
        return literal(str(value), datatype=XSD + "integer")
    if isinstance(value, float):
        return literal({"inf": "INF", "-inf": "-INF", "nan": "NaN"}.get(str(value), repr(value)), datatype=XSD + "double")
    if isinstance(value, decimal.Decimal):
        return literal(format(value, "f"), datatype=XSD + "decimal")
    if isinstance(value, dt.datetime):
        return literal(value.isoformat(), datatype=XSD + "dateTime")
    if isinstance(value, dt.date):
        return literal(value.isoformat(), datatype=XSD + "date")
    if isinstance(value, dt.timedelta):
        return literal(f"{'-' if value < dt.timedelta(0) else ''}PT{abs(value).total_seconds():.6f}".rstrip("0").rstrip(".") + "S", datatype=XSD + "duration")
    return literal(str(value))


def to_value(term: str) -> object:
    """The native value of a literal by its datatype, None if the text is not in the datatype's lexical space; text for
    an unknown datatype."""
    t = parse_term(term)
    kind = (t.datatype or "")[len(XSD) :] if (t.datatype or "").startswith(XSD) else ""
    text = t.value.strip()
    try:
        if kind == "boolean":
            return {"true": True, "1": True, "false": False, "0": False}[text]
        if kind in INTEGERS:
            return int(text)
        if kind == "decimal":
            return decimal.Decimal(text)
        if kind in ("float", "double"):
            return float(text.replace("INF", "inf"))
        if kind == "dateTime":
            return dt.datetime.fromisoformat(text)
        if kind == "date":
            return dt.date.fromisoformat(text[:10])
        if kind == "time":
            return dt.time.fromisoformat(text)
        if kind == "duration":
            return dt.timedelta(seconds=duration_seconds(text))
    except (KeyError, ValueError, decimal.InvalidOperation):
        return None
    return t.value


def normalize(term: str) -> str:
    """A literal in the canonical form of its value, other terms and unreadable ones as they are."""
    t = parse_term(term)
    value = to_value(term) if t.kind == "L" and t.datatype else None
    if value is None or isinstance(value, str):
        return term
    text = parse_term(from_value(value)).value if not isinstance(value, dt.time) else value.isoformat()
    return literal(text, datatype=t.datatype)


_DURATION = re.compile(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def duration_seconds(text: str) -> float:
    """Seconds of an ISO 8601 duration; a year counts as 365 days and a month as 30."""
    m = _DURATION.fullmatch(text)
    if not m or text[-1] in "PT":
        raise ValueError(text)
    y, mo, d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    return (-1 if m[1] else 1) * ((y * 365 + mo * 30 + d) * 86400 + h * 3600 + mi * 60 + s)


_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>\"{}|\\^`]*")


def iri_error(text: str) -> str | None:
    """What is wrong with an absolute IRI, or None."""
    if not text:
        return "it is empty"
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text):
        return "it has no scheme"
    if m := re.search(r"[\x00-\x20<>\"{}|\\^`]", text):
        return f"it has the character {m[0]!r} at {m.start()}"
    if m := re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return f"a percent sign without two hexadecimal digits at {m.start()}"
    if text.count("#") > 1:
        return "it has more than one fragment"
    return None if _IRI.fullmatch(text) else "it is malformed"


# The same over columns. Everything below stays in the JVM.


def c_escape(text: Column) -> Column:
    for a, b in _ESCAPES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def c_unescape(text: Column) -> Column:
    mark = "\x01\ue000"  # stands for an escaped backslash meanwhile
    text = F.replace(text, F.lit("\\\\"), F.lit(mark))
    for a, b in _ESCAPES.items():
        if a != "\\":
            text = F.replace(text, F.lit(b), F.lit(a))
    return F.replace(text, F.lit(mark), F.lit("\\"))


def c_iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def c_literal(text: Column, lang: str | None = None, datatype: str | None = None) -> Column:
    return F.concat(F.lit('"'), c_escape(text), F.lit('"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")))


def c_term(kind: Column, value: Column, lang: Column, datatype: Column) -> Column:
    """The term of its parts."""
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(kind == "U", c_iri(value)).when(kind == "B", F.concat(F.lit("_:"), value)).when(kind == "L", F.concat(F.lit('"'), c_escape(value), F.lit('"'), tail))


def c_kind(term: Column) -> Column:
    return F.when(term.startswith("<"), "U").when(term.startswith('"'), "L").when(term.startswith("_:"), "B")


#: What stands around the text of a term.
_AROUND = r'(?s)^(?:<|_:|")|(?:>|"(?:@[A-Za-z0-9-]+|\^\^<[^>"]*>)?)$'


def c_text(term: Column) -> Column:
    """The IRI, label or text of a term; the term is named once, so that nested expressions stay small."""
    return c_unescape(F.regexp_replace(term, _AROUND, ""))


def c_lang(term: Column) -> Column:
    """The language of a literal, empty without one, null for other terms."""
    return F.when(term.startswith('"'), F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1))


def c_datatype(term: Column) -> Column:
    """The datatype of a literal, null without one."""
    return F.when(term.startswith('"') & term.endswith(">"), F.regexp_extract(term, r'"\^\^<([^>"]*)>$', 1))


def c_parts(term: Column) -> list[Column]:
    """o_kind, o_val, o_lang and o_dt of a term."""
    lang = c_lang(term)
    return [c_kind(term).alias("o_kind"), c_text(term).alias("o_val"), F.when(lang != "", lang).alias("o_lang"), c_datatype(term).alias("o_dt")]


def c_decimal(text: Column) -> Column:
    return text.try_cast("decimal(38,18)")


def c_double(text: Column) -> Column:
    """A double of XML Schema's lexical forms, null for other texts."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)\s*$", 1).try_cast("double")


def c_boolean(text: Column) -> Column:
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def c_seconds(text: Column) -> Column:
    """duration_seconds() of a column, null for what is no duration."""
    pattern = r"^(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    total = (part(2) * 365 + part(3) * 30 + part(4)) * 86400 + part(5) * 3600 + part(6) * 60 + part(7)
    return F.when(text.rlike(pattern) & ~text.rlike("[PT]$"), F.when(F.regexp_extract(text, pattern, 1) == "-", -total).otherwise(total))


def c_valid_iri(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>\"{}|\\^`]*$") & ~text.rlike(r"%(?![0-9A-Fa-f]{2})") & ~text.rlike("#.*#")
