"""Location paths over a graph: each step is a join with the statements of a predicate, forwards or backwards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.functions.namespaces import Namespaces
from quadflow.operators.store import QuadStore

_STEP = re.compile(r"(?P<back>!)?(?:<(?P<iri>[^>]*)>|(?P<name>(?:[A-Za-z_][\w.-]*)?:[\w.-]*)|(?P<any>\*))(?:\[(?P<number>[0-9]+)\])?")


def steps(path: str, namespaces: Namespaces) -> list[tuple[str | None, bool, int | None]]:
    """(predicate or None for any, backwards, number) of each step of p/!q/*[2]; names are prefix:local or <iri>."""
    out = []
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m.end() < len(path) and path[m.end()] != "/":
            raise ValueError(f"cannot read the path at {path[at:]!r}")
        predicate = None if m["any"] else T.iri(m["iri"]) if m["iri"] is not None else T.iri(namespaces.resolve(m["name"]))
        out.append((predicate, bool(m["back"]), int(m["number"]) if m["number"] else None))
        at = m.end() + 1
    return out


def navigate(store: QuadStore, start: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(start, node): the distinct nodes that a path leads to from each start term.

    start: one column of terms. A step p goes from subjects to objects, !p from objects to subjects, * over any
    predicate; [n] keeps the n-th node of the step, counted from 1 in the order of terms, for every node it starts from.
    No start or a path that leads nowhere: no rows; a literal has no steps forward.
    """
    now = start.select(F.col(start.columns[0]).alias("start")).where("start is not null").distinct().withColumn("node", F.col("start"))
    for predicate, back, number in steps(path, Namespaces(prefixes)):
        quads = store.select(p=predicate).select("s", "o") if predicate else store.quads.select("s", "o")
        links = quads.select(F.col("o" if back else "s").alias("node"), F.col("s" if back else "o").alias("to")).distinct()
        if number is not None:
            # a window with a limit on its rank keeps no more than so many rows of a node on either side of the exchange
            rank = F.row_number().over(Window.partitionBy("node").orderBy("to"))
            links = links.withColumn("r", rank).where(F.col("r") <= number).where(F.col("r") == number).drop("r")
        now = now.join(links, "node").select("start", F.col("to").alias("node")).distinct()
    return now
