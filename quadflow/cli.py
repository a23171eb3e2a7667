"""python -m quadflow query | convert | prove: stores from specs on the command line."""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce

from pyspark.sql import SparkSession

from quadflow.plans.algebra import Triple, Var
from quadflow.plans.planner import Builder, Planner
from quadflow.plans.sparql import parse
from quadflow.reason.rules import RuleEngine
from quadflow.sources import n3
from quadflow.sources.results import WRITERS, ask_xml, formatted
from quadflow.sources.spec import open_store, save_store
from quadflow.sources.writers import TurtleWriter


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quadflow").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="quadflow", description=__doc__)
    sub = top.add_subparsers(dest="tool", required=True)
    q = sub.add_parser("query", help="runs SPARQL, or a query graph in N3, over a store")
    q.add_argument("store")
    q.add_argument("query", help="text, or @file")
    q.add_argument("--type", choices=["sparql", "graph"], default="sparql")
    q.add_argument("--format", choices=sorted(WRITERS), default="simple")
    q.add_argument("--limit", type=int)
    c = sub.add_parser("convert", help="reads one store and writes another")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--prefix", action="append", default=[], metavar="P=IRI")
    c.add_argument("--graph", help="puts all statements into this graph")
    c.add_argument("--stats", action="store_true")
    p = sub.add_parser("prove", help="proves goals from rules and facts in N3")
    p.add_argument("rules")
    p.add_argument("goal", help="an N3 document of goal statements; ?x stands for anything")
    args = top.parse_args(argv)
    spark = spark or _session()
    text = lambda x: open(x[1:], encoding="utf-8").read() if x.startswith("@") else x  # noqa: E731, SIM115
    if args.tool == "query":
        store = open_store(spark, args.store)
        if args.type == "graph":
            df = Builder.of_graph(n3.parse(text(args.query))).run(store)
            sys.stdout.write(formatted(df if args.limit is None else df.limit(args.limit), args.format))
            return 0
        parsed = parse(text(args.query))
        planner = Planner(store, max_limit=args.limit)
        if parsed.form == "ASK":
            answer = planner.ask(parsed)
            sys.stdout.write(ask_xml(answer) if args.format == "xml" else f"{str(answer).lower()}\n")
        elif parsed.form == "SELECT":
            sys.stdout.write(formatted(planner.run(parsed), args.format))
        else:
            rows = planner.run(parsed).select("s", "p", "o").orderBy("s", "p", "o").toLocalIterator()
            sys.stdout.write(TurtleWriter().document(tuple(r) for r in rows) + "\n")
    elif args.tool == "convert":
        began = time.time()
        store = open_store(spark, args.source)
        if args.graph:
            store = reduce(lambda x, s: x.add_source(s, f"<{args.graph}>"), store.sources, type(store)(spark))
        n = save_store(store, args.target, dict(x.split("=", 1) for x in args.prefix))
        if args.stats or n is not None:
            n = store.count() if n is None else n
            sys.stdout.write(f"{n} statements, {n / max(time.time() - began, 1e-9):.0f} a second\n")
    else:
        with open(args.rules, encoding="utf-8") as f:
            rules, ground = n3.rules(n3.parse(f.read(), base=args.rules))
        engine = RuleEngine(rules)
        from quadflow.operators.store import quads_from

        facts = quads_from(spark, [x[:3] for x in ground] or [("<urn:none>", "<urn:none>", "<urn:none>")])
        found = 0
        for s, pr, o, _ in n3.parse(text(args.goal)):
            term = lambda x: Var(x[1:]) if x.startswith("?") else x
            for r in engine.prove(facts, Triple(term(s), term(pr), term(o))).orderBy("goal", "depth", "s", "p", "o").toLocalIterator():
                found += r["depth"] == 0
                why = rules[r["rule"]].name if r["rule"] >= 0 else "given"
                sys.stdout.write(f"{'  ' * r['depth']}{r['s']} {r['p']} {r['o']}.  # {why}\n")
        return 0 if found else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
