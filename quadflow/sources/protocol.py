"""SPARQL over HTTP: a store served, and an endpoint as a source."""

from __future__ import annotations

import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import TERM, Bindings, column
from quadflow.operators.store import KEYS, QuadStore
from quadflow.plans.algebra import Triple, Var
from quadflow.plans.planner import Planner
from quadflow.plans.sparql import SparqlError, parse
from quadflow.sources.results import WRITERS, ask_xml, formatted, from_results_xml, parse_results_xml
from quadflow.sources.writers import nt_lines

#: MIME type -> form of a SELECT's solutions. Public media types.
TYPES = {"application/sparql-results+xml": "xml", "text/xml": "xml", "application/xml": "xml", "text/csv": "csv", "text/html": "html", "text/plain": "simple"}


class _Handler(BaseHTTPRequestHandler):
    server: SparqlServer

    def do_GET(self) -> None:  # noqa: N802
        self.answer(parse_qs(urlsplit(self.path).query))

    def do_POST(self) -> None:  # noqa: N802
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        self.answer({"query": [body]} if "sparql-query" in (self.headers.get("Content-Type") or "") else parse_qs(body))

    def answer(self, fields: dict[str, list[str]]) -> None:
        try:
            if not fields.get("query"):
                return self.send(400, "text/plain", "no query was given")
            wanted = fields.get("outputMimeType") or [x.split(";")[0].strip() for x in (self.headers.get("Accept") or "").split(",")]
            mime = next((x for x in wanted if x in TYPES), "application/sparql-results+xml")
            return self.send(200, *self.server.run(fields["query"][0], mime))
        except (SparqlError, ValueError) as e:
            return self.send(400, "text/plain", str(e))
        except Exception as e:  # noqa: BLE001 whatever went wrong is the client's to hear of
            return self.send(500, "text/plain", str(e)[:2000])

    def send(self, status: int, mime: str, text: str) -> None:
        data = text.encode()
        self.send_response(status)
        self.send_header("Content-Type", f"{mime}; charset=utf-8")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args: object) -> None:
        pass


class SparqlServer(ThreadingHTTPServer):
    """Answers queries to a store: solutions in the form asked for, statements as N-Triples. max_limit caps the rows of a
    SELECT; a query that does not parse is the client's error, any other failure the server's."""

    daemon_threads = True

    def __init__(self, store: QuadStore, port: int = 0, max_limit: int | None = None, host: str = "127.0.0.1") -> None:
        super().__init__((host, port), _Handler)
        self.store, self.max_limit = store, max_limit
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self) -> str:
        return f"http://{self.server_address[0]}:{self.server_address[1]}/sparql"

    def run(self, text: str, mime: str) -> tuple[str, str]:
        q, planner = parse(text), Planner(self.store, max_limit=self.max_limit)
        if q.form == "ASK":
            return "application/sparql-results+xml", ask_xml(planner.ask(q))
        if q.form == "SELECT":
            assert TYPES[mime] in WRITERS
            return mime, formatted(planner.run(q), TYPES[mime])
        return "text/plain", "".join(r["value"] + "\n" for r in nt_lines(planner.run(q)).toLocalIterator())

    def __exit__(self, *args: object) -> None:
        self.shutdown()
        super().__exit__(*args)


class EndpointSource:
    """A remote endpoint's statements. A group of patterns goes there as one query and only its solutions come back; an
    endpoint's blank nodes are told apart within one answer only. What an answer holds passes through the driver."""

    distinct = True

    def __init__(self, spark: SparkSession, url: str, timeout: float = 600) -> None:
        self.spark, self.url, self.timeout = spark, url, timeout

    def ask_for(self, query: str) -> str:
        request = urllib.request.Request(self.url, urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+xml"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return r.read().decode()

    @staticmethod
    def text(triples: list[Triple]) -> tuple[str, dict[str, str]]:
        """The group as SPARQL, and each variable's name in it."""
        names = {n: f"v{i}" for i, n in enumerate(dict.fromkeys(n for t in triples for n in t.variables()))}
        part = lambda x: f"?{names[x.name]}" if isinstance(x, Var) else x
        line = lambda t: f"{part(t.s)} {part(t.p)} {part(t.o)} ." if t.graph is None else f"GRAPH {part(t.graph)} {{ {part(t.s)} {part(t.p)} {part(t.o)} }}"
        return " ".join(map(line, triples)), names

    def may(self, t: Triple) -> bool:  # noqa: ARG002
        return True

    def solve(self, triples: list[Triple], needed: set[str] | None = None) -> Bindings | None:
        body, names = self.text(triples)
        if not names:
            return Bindings(self.spark.range(1).select(), {}, set()) if parse_results_xml(self.ask_for(f"ASK {{ {body} }}")) else None
        kept = {n: v for n, v in names.items() if needed is None or n in needed} or names
        df = from_results_xml(self.spark, self.ask_for(f"SELECT {' '.join('?' + v for v in kept.values())} {{ {body} }}"))
        return Bindings(df.select(*[F.col(v).alias(column(n)) for n, v in kept.items()]), dict.fromkeys(kept, TERM), set(kept))

    def match(self, triples: list[Triple]) -> Bindings | None:
        return self.solve(triples)

    def select(self, wants: dict[str, str | list[str]]) -> DataFrame:
        """Quads that agree with the parts given as single terms; the others are tested here."""
        fixed = {k: v for k, v in wants.items() if isinstance(v, str) and v != T.RDFS_MEMBER}
        part = lambda k: fixed.get(k) or Var(k)
        out = []
        for g in (None, part("g")) if "g" not in fixed else (None if fixed["g"] == "" else fixed["g"],):
            found = self.solve([Triple(part("s"), part("p"), part("o"), g)])
            cols = [F.lit(fixed[k]).alias(k) if k in fixed else F.col(k) if k != "g" or isinstance(g, Var) else F.lit("").alias("g") for k in KEYS]
            if found is not None:
                out.append(found.df.select(*cols))
        if not out:
            return self.spark.createDataFrame([], T.QUADS)
        df = out[0] if len(out) == 1 else out[0].unionByName(out[1])
        return df.select(*KEYS, *T.c_parts(F.col("o")))

    def quads(self) -> DataFrame:
        return self.select({})


def endpoint_store(spark: SparkSession, url: str) -> QuadStore:
    return QuadStore(spark, [EndpointSource(spark, url)])
