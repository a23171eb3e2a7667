"""Readers, writers, result formats, specs, streams and the command line."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quadflow.cli import main
from quadflow.functions import terms as T
from quadflow.functions.namespaces import Namespaces
from quadflow.operators.graph import isomorphic
from quadflow.operators.store import QuadStore, quads_from
from quadflow.plans.conformance import DERBY, _bulk_loaded
from quadflow.sources import n3, rdfxml, results
from quadflow.sources import writers as W
from quadflow.sources.mapping import mapped
from quadflow.sources.readers import decoded, format_of, read_rdf
from quadflow.sources.spec import open_store, save_store
from quadflow.streaming.ingest import counts_by_predicate, stream_into, stream_quads

XSD = T.XSD


def st(text, prefix="@prefix : <u:>. "):
    return n3.parse(prefix + text)


def quads(df):
    return [(r["s"], r["p"], r["o"], r["g"]) for r in df.select("s", "p", "o", "g").collect()]


def random_graph(seed, n=40):
    r = random.Random(seed)
    node = lambda: r.choice([f"<http://e/n{r.randrange(9)}>", f"_:b{r.randrange(6)}"])
    text = lambda: "".join(r.choice('ab" \\\n\té😀<&>\'') for _ in range(r.randrange(6)))
    value = lambda: r.choice([node(), T.literal(text()), T.literal(text(), "en"), T.literal(text(), datatype="http://e/t"), T.literal(str(r.randrange(9)), datatype=XSD + "integer"), T.literal("1.5", datatype=XSD + "decimal")])
    return list(dict.fromkeys((node(), r.choice([T.RDF_TYPE, "<http://e/p>", "<http://e/q>"]), value(), "") for _ in range(n)))


# parsing


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (":a :b :c.", [("<u:a>", "<u:b>", "<u:c>")]),
        (":a a :c; :p 1, -2.5, 1e3, true;.", [("<u:a>", T.RDF_TYPE, "<u:c>"), ("<u:a>", "<u:p>", f'"1"^^<{XSD}integer>'), ("<u:a>", "<u:p>", f'"-2.5"^^<{XSD}decimal>'), ("<u:a>", "<u:p>", f'"1e3"^^<{XSD}double>'), ("<u:a>", "<u:p>", f'"true"^^<{XSD}boolean>')]),
        (":a :p [:q 1].", [("_:n1", "<u:q>", f'"1"^^<{XSD}integer>'), ("<u:a>", "<u:p>", "_:n1")]),
        (":a :p ().", [("<u:a>", "<u:p>", T.RDF_NIL)]),
        (":a is :p of :b.", [("<u:b>", "<u:p>", "<u:a>")]),
        (":a has :p :b.", [("<u:a>", "<u:p>", "<u:b>")]),
        (":a = :b.", [("<u:a>", f"<{T.OWL}sameAs>", "<u:b>")]),
        (":a <= :b.", [("<u:b>", f"<{T.LOG}implies>", "<u:a>")]),
        (":a!:p :q :z.", [("<u:a>", "<u:p>", "_:n1"), ("_:n1", "<u:q>", "<u:z>")]),
        (":a^:p :q :z.", [("_:n1", "<u:p>", "<u:a>"), ("_:n1", "<u:q>", "<u:z>")]),
        ("@keywords a. @prefix : <u:>. x a Y.", [("<u:x>", T.RDF_TYPE, "<u:Y>")]),
        ('@base <http://b/c>. <d> <#e> """x"y\nz""". # end', [("<http://b/d>", "<http://b/c#e>", '"x\\"y\\nz"')]),
        (':a :p "\\u00e9\\U0001F600\\t"@en-GB.', [("<u:a>", "<u:p>", '"é😀\\t"@en-GB')]),
        ("PREFIX e: <http://e#> e:a e:b e:c", None),
        ("PREFIX e: <http://e#> e:a e:b e:c .", [("<http://e#a>", "<http://e#b>", "<http://e#c>")]),
        (":a :b", None),
        ("x:a :b :c.", None),
        (':a "p" :c.', None),
        (":a :b {", None),
    ],
)
def test_n3(text, want):
    if want is None:
        with pytest.raises(n3.RdfError, match="line"):
            st(text)
    else:
        assert [s[:3] for s in st(text)] == want


def test_formulas_are_graphs():
    got = st("{:a :b :c. :d :e ?x} => {?x :f :g}.")
    graphs = {s[3] for s in got}
    assert len(graphs) == 3 and ("<u:d>", "<u:e>", "?x", "_:n1") in got and ("_:n1", f"<{T.LOG}implies>", "_:n2", "") in got


RDF_HEAD = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns="http://e/" xmlns:e="http://e/" xml:base="http://b/doc">'


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ('<T rdf:about="x" e:p="1"/>', '<http://b/x> a e:T; e:p "1".'),
        ('<rdf:Description rdf:ID="i"><p rdf:resource=""/></rdf:Description>', "<http://b/doc#i> e:p <http://b/doc>."),
        ('<rdf:Description><p><T rdf:nodeID="n"/></p><q rdf:nodeID="n"/></rdf:Description>', "_:s e:p _:n; e:q _:n. _:n a e:T."),
        ('<rdf:Bag><rdf:li>a</rdf:li><rdf:li xml:lang="en">b</rdf:li></rdf:Bag>', '_:s a r:Bag; r:_1 "a"; r:_2 "b"@en.'),
        ('<rdf:Description rdf:about="x"><p rdf:parseType="Resource"><q>1</q></p></rdf:Description>', '<http://b/x> e:p _:n. _:n e:q "1".'),
        ('<rdf:Description rdf:about="x"><p rdf:parseType="Collection"><T rdf:about="a"/><T rdf:about="b"/></p></rdf:Description>', "<http://b/x> e:p (<http://b/a> <http://b/b>). <http://b/a> a e:T. <http://b/b> a e:T."),
        ('<rdf:Description rdf:about="x"><p rdf:parseType="Collection"/></rdf:Description>', "<http://b/x> e:p ()."),
        (f'<rdf:Description rdf:about="x"><p rdf:datatype="{XSD}int">1</p><q xml:lang="de"> ü </q></rdf:Description>', f'<http://b/x> e:p "1"^^<{XSD}int>; e:q " ü "@de.'),
        ('<rdf:Description rdf:about="x"><p e:q="1"/></rdf:Description>', '<http://b/x> e:p _:n. _:n e:q "1".'),
        ('<rdf:Description rdf:about="x"><p rdf:ID="s">v</p></rdf:Description>', '<http://b/x> e:p "v". <http://b/doc#s> a r:Statement; r:subject <http://b/x>; r:predicate e:p; r:object "v".'),
        ('<rdf:Description rdf:about="x" rdf:type="http://e/T" xml:base="http://c/d"><p rdf:resource="y"/></rdf:Description>', "<http://c/x> a e:T; e:p <http://c/y>."),
        ('<rdf:Description rdf:bagID="x"/>', None),
        ('<rdf:Description rdf:about="x" rdf:ID="y"/>', None),
        ('<T rdf:ID="i"/><T rdf:ID="i"/>', None),
        ('<T rdf:ID="1"/>', None),
        ("<T>text</T>", None),
        ("<rdf:li/>", None),
        ("<T>", None),
    ],
)
def test_rdf_xml(xml, want):
    text = RDF_HEAD + xml + "</rdf:RDF>"
    if want is None:
        with pytest.raises(n3.RdfError, match="line"):
            rdfxml.parse(text, "http://b/doc")
    else:
        assert isomorphic(rdfxml.parse(text, "http://b/doc"), n3.parse(f"@prefix e: <http://e/>. @prefix r: <{T.RDF}>. " + want))


def test_xml_literal():
    got = rdfxml.parse(RDF_HEAD + '<T rdf:about="x"><p rdf:parseType="Literal">a <b c="d">&amp;</b></p></T></rdf:RDF>', "http://b/")
    assert T.parse_term(got[1][2]).datatype == T.RDF + "XMLLiteral" and "&amp;</" in T.parse_term(got[1][2]).value


# reading with Spark


def test_ntriples_lines(spark, tmp_path):
    lines = ['<u:a> <u:b> <u:c>.', '<u:a><u:b>"x\\u00e9\\\\u0041 \\U0001F600\\b"@en .  # note', "_:n1 <u:b> _:n2 <u:g> .", "", "# comment", f'<u:a> <u:b> "abc"^^<{XSD}int> .', "broken line .", '<u:a> <u:b> "open .', '<u:a> <u:b> "q\\"\\\\" .', "<u:\\u00e9> <u:b> _:x.", '<u:a> <u:b> "" .']
    (tmp_path / "a.nt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.nq").write_text("_:n1 <u:b> <u:z> <u:g2> .\r\n", encoding="utf-8")
    doc = read_rdf(spark, [str(tmp_path / "a.nt"), str(tmp_path / "b.nq")])
    got = quads(doc.quads)
    assert len(got) == 8 and ("<u:a>", "<u:b>", '"xé\\\\u0041 😀\b"@en', "") in got and ("<u:a>", "<u:b>", '"q\\"\\\\"', "") in got and any(s == "<u:é>" for s, *_ in got)
    assert len({s for s, *_ in got if s.startswith("_:")}) == 2  # one label in two files is two nodes
    bad = doc.rejects.collect()
    assert len(bad) == 3 and {r["text"] for r in bad} >= {"broken line .", '<u:a> <u:b> "open .'} and any("no lexical form" in r["error"] for r in bad)
    assert {r["g"] for r in read_rdf(spark, str(tmp_path / "a.nt"), graph="<u:all>").quads.collect()} == {"<u:all>"}


def test_whole_documents(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <u:>. :a :b [ :c 1 ]. <#x> :d <y>.", encoding="utf-8")
    (tmp_path / "b.ttl").write_text("@prefix : <u:>. :a :b :broken", encoding="utf-8")
    (tmp_path / "c.rdf").write_text(RDF_HEAD + '<T rdf:about="x"/></rdf:RDF>', encoding="utf-8")
    doc = read_rdf(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl"), str(tmp_path / "c.rdf")], base="http://base/d")
    got = quads(doc.quads)
    assert len(got) == 4 and ("<http://base/d#x>", "<u:d>", "<http://base/y>", "") in got and ("<http://b/x>", T.RDF_TYPE, "<http://e/T>", "") in got
    bad = doc.rejects.collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("b.ttl") and bad[0]["line"] == 1
    assert format_of("x.ttl") == "n3" and format_of("x", "application/rdf+xml; charset=utf-8") == "xml" and format_of("f.nt.gz") == "nt"
    with pytest.raises(ValueError):
        format_of("x.doc")


def test_dictionary_tables(spark):
    s = spark.createDataFrame([(2, 3, 0, 4, 1), (2, 3, 1, 9, 5), (7, 3, 0, 2, 1), (7, 3, 0, 2, 1), (2, 3, 1, 99, 1)], "subject bigint, predicate bigint, objecttype int, object bigint, meta bigint")
    e = spark.createDataFrame([(2, "u:a"), (3, "u:p"), (4, "u:b"), (5, "u:g")], "id bigint, value string")
    lit = spark.createDataFrame([(9, 'x"', "en", None)], "id bigint, value string, language string, datatype string")
    assert sorted(quads(decoded(s, e, lit))) == [("<u:a>", "<u:p>", '"x\\""@en', "<u:g>"), ("<u:a>", "<u:p>", "<u:b>", ""), ("_:b7", "<u:p>", "<u:a>", "")]


# writing


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (":S a :X, :Y; :o :Z. :P :o \"s\".", "<u:S> a <u:X>,\n\t\t<u:Y>;\n\t<u:o> <u:Z>.\n<u:P> <u:o> \"s\"."),
        ("_:node :b :C.", "_:node <u:b> <u:C>."),
        ("?myvar :b :C.", "?myvar <u:b> <u:C>."),
        (':A :b "C"@en.', '<u:A> <u:b> "C"@en.'),
        (f':A :b "C"^^<{XSD}string>.', f'<u:A> <u:b> "C"^^<{XSD}string>.'),
        (":A :b 1, 1.2, true, 1e0.", "<u:A> <u:b> 1,\n\t\t1.2,\n\t\ttrue,\n\t\t1e0."),
        (f':A :b "01x"^^<{XSD}integer>.', f'<u:A> <u:b> "01x"^^<{XSD}integer>.'),
        (":A :b \"é\\n\".", '<u:A> <u:b> "\\u00E9\\n".'),
        ("", ""),
    ],
)
def test_turtle_text(text, want):
    assert W.TurtleWriter().document(st(text)) == want


def test_turtle_prefixes_and_formulas():
    assert W.TurtleWriter(Namespaces({"ex": "http://e/", "xsd": XSD})).document([("<http://e/A>", T.RDF_TYPE, "<X>"), ("<http://e/A>", "<b>", f'"C"^^<{XSD}string>')]) == f'@prefix ex: <http://e/>.\n@prefix xsd: <{XSD}>.\nex:A a <X>;\n\t<b> "C"^^xsd:string.'
    got = W.TurtleWriter().document([("<A>", "<b>", "<C>", "_:s")])
    assert got.startswith(f"_:s a <{T.LOG}Formula>;\n\t<{T.LOG}includes> _:bnode1.\n_:bnode1 a <{T.RDF}Statement>;\n\t<{T.RDF}subject> <A>;")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{:S :p :X} => {:S :p :Y}.", "{<u:S> <u:p> <u:X>.} => {<u:S> <u:p> <u:Y>.}."),
        ("{:S :p :X. :S :p :Y} => {:S :p :Z}.", "{\n <u:S> <u:p> <u:X>.\n <u:S> <u:p> <u:Y>.\n} => {<u:S> <u:p> <u:Z>.}."),
        (":M :c {:S :p :O}.", "<u:M> <u:c> {<u:S> <u:p> <u:O>.}."),
        (":S :b :B. {:S :p :X} => {:S :p :Y}.", "<u:S> <u:b> <u:B>.\n{<u:S> <u:p> <u:X>.} => {<u:S> <u:p> <u:Y>.}."),
        ("(:A) a :List.", "(<u:A>) a <u:List>."),
        ("(:A :B :C) a :List.", "(<u:A> <u:B> <u:C>) a <u:List>."),
        ("{ {:S :p :X} => {:S :p :Y} } => :Truth.", "{\n{<u:S> <u:p> <u:X>.}\n=>\n{<u:S> <u:p> <u:Y>.}.\n} => <u:Truth>."),
        ("({:S :p :X} {:S :p :Y}) a :List.", "({<u:S> <u:p> <u:X>.}\n {<u:S> <u:p> <u:Y>.}) a <u:List>."),
        ("{(:A :B) :p :X} => {:S :p :Y}.", "{(<u:A> <u:B>) <u:p> <u:X>.} => {<u:S> <u:p> <u:Y>.}."),
    ],
)
def test_n3_text(text, want):
    assert W.N3Writer().document(st(text)) == want


@pytest.mark.parametrize("seed", range(4))
def test_documents_read_back(seed):
    g = random_graph(seed)
    assert isomorphic(n3.parse(W.TurtleWriter(Namespaces({"e": "http://e/"})).document(sorted(g))), g)
    assert isomorphic(n3.parse(W.N3Writer().document(g)), g)
    for options in (W.XmlOptions(), W.XmlOptions.metadata(), W.XmlOptions(embed=False, attributes=True)):
        assert isomorphic(rdfxml.parse(W.rdf_xml(g, options=options)), g)


def test_xml_of_lists_members_and_misfits():
    g = st('[] :items (:a :b); :bag [a r:Bag; r:_1 "x"; r:_2 "y"].', f"@prefix : <http://e/>. @prefix r: <{T.RDF}>. ")
    text = W.rdf_xml(g)
    assert 'parseType="Collection"' in text and text.count("rdf:li") == 4 and isomorphic(rdfxml.parse(text), g)
    for bad in ([("<u:a>", "<u:b>", "<u:c>", "<u:g>")], [("<u:a>", "<http://e/1>", "<u:c>", "")]):
        with pytest.raises(ValueError):
            W.rdf_xml(bad)
    dot = W.graphviz(st(':a a :T; :p "a text that is long"; :q _:x.'))
    assert dot.startswith("digraph") and "shape=box" in dot and "a text that ..." in dot and "type" not in dot


def test_written_files_read_back(spark, tmp_path):
    g = random_graph(9)
    df = quads_from(spark, g)
    for name, suffix in (("nt", "nt"), ("turtle", "ttl"), ("n3", "n3"), ("xml", "rdf")):
        at = str(tmp_path / f"out.{suffix}")
        W.write_rdf(df, at, name, {"e": "http://e/"})
        got = quads(read_rdf(spark, at, suffix).quads)
        if name == "turtle":  # a file a range of subjects: blank nodes are only one where the file is
            assert len(got) == len(g)
        else:
            assert isomorphic([tuple(x) for x in got], g)
    named = quads_from(spark, [("<u:a>", "<u:b>", "<u:c>", "_:f"), ("<u:d>", "<u:e>", "<u:f>", "_:f"), ("<u:x>", "<u:y>", '"z"')])
    lines = [r[0] for r in W.nt_lines(named).collect()]
    assert "<u:a> <u:b> <u:c> _:f ." in lines and '<u:x> <u:y> "z".' in lines
    triples = [r[0] for r in W.nt_lines(named, "reify").collect()]
    assert len(triples) == 1 + 1 + 2 * 5 and f"_:f {T.RDF_TYPE} <{T.LOG}Formula>." in triples


def test_result_formats(spark):
    rows = [("<u:a>", '"x, y"@en', None), ("_:b", f'"1"^^<{XSD}int>', "_:b"), (None, '"a ""b"', "_:c")]
    text = results.results_xml(["a", "b", "c"], [(*rows[0],), (*rows[1],), (None, '"q"', "_:c")], ["why -- so"])
    names, back = results.parse_results_xml(text)
    assert names == ["a", "b", "c"] and back == [rows[0], ("_:r1", rows[1][1], "_:r1"), (None, '"q"', "_:r2")]
    assert results.parse_results_xml(results.ask_xml(True)) is True and results.from_results_xml(spark, results.ask_xml(False)).first()[0] is False
    assert results.from_results_xml(spark, text).count() == 3
    assert results.results_csv(["a", "b"], [('"x,\\"y"', '"plain \\"q\\""'), ('" edge"', None)]) == 'a,b\n"x,""y",plain "q"\n" edge",\n'
    assert "<td>a&lt;b</td>" in results.results_html(["x"], [('"a<b"',)])
    assert results.results_text(["x", "y"], [("<u:a>", None)]) == "?x = <u:a>\n"
    assert results.results_answers(["x"], [("<u:a>",)]) == "X\nu:a\n"
    assert results.select_text([("?x", "<u:p>", '"v"')], ["x"], 5) == 'SELECT ?x WHERE { ?x <u:p> "v" } LIMIT 5' and results.ask_text([("<u:a>", "<u:p>", "?o")]) == "ASK { <u:a> <u:p> ?o }"


# specs, streams, command line


def some_source(s, p, o, g):
    rows = [("<u:a>", "<u:p>", f'"{i}"') for i in range(5)]
    return [r for r in rows if o is None or r[2] == o]


def some_store(spark):
    return open_store(spark, "python:tests.test_sources:some_source")


def test_specs(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix : <u:>. :a a :Cat; :p :b.', encoding="utf-8")
    (tmp_path / "s.ttl").write_text(f'@prefix : <u:>. :Cat <{T.RDFS}subClassOf> :Animal.', encoding="utf-8")
    (tmp_path / "r.n3").write_text("@prefix : <u:>. {?x :p ?y} => {?y :q ?x}. :axiom :holds true.", encoding="utf-8")
    a, s, r = (str(tmp_path / x) for x in ("a.ttl", "s.ttl", "r.n3"))
    assert open_store(spark, f"turtle:{a}|mem\nturtle:{s}@<u:g>").count() == 3
    assert open_store(spark, f"rdfs+turtle:{s}+turtle:{a}").contains("<u:a>", T.RDF_TYPE, "<u:Animal>")
    full = open_store(spark, f"rules+{r}+turtle:{a}")
    assert full.contains("<u:b>", "<u:q>", "<u:a>")
    assert open_store(spark, "python:tests.test_sources:some_source").select(o='"3"').count() == 1
    assert open_store(spark, "class:tests.test_sources:some_store|debug:x".replace("|debug:x", "")).count() == 5
    save_store(full, f"parquet:{tmp_path}/q")
    assert open_store(spark, f"debug+parquet:{tmp_path}/q").count() == full.count() and save_store(full, "null:") == full.count()
    with pytest.raises(ValueError):
        open_store(spark, "what:ever")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.nt").write_text("<u:a> <u:b> <u:c>.\nbroken\n", encoding="utf-8")
    for n in (1, 3):
        q = stream_into(stream_quads(spark, str(folder), "<u:g>"), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n  # what is read once is not read again
        (folder / "2.nt").write_text('<u:a> <u:b> "x".\n<u:d> <u:e> "y".\n', encoding="utf-8")
    timed = stream_quads(spark, str(folder)).withColumn("at", F.current_timestamp())
    assert counts_by_predicate(timed, "at").isStreaming


def test_converted_tables_are_small_and_whole(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as a", "if(id % 2 = 0, null, id / 3) as b", "concat('x', char(34), char(92), id) as c")
    store = QuadStore(spark, [mapped(df, "row", None)])
    assert sorted(quads(store.by_row())) == sorted(quads(store.quads))
    save_store(store, f"nt:{tmp_path}/t.nt")
    files = [f for f in (tmp_path / "t.nt").iterdir() if f.name.startswith("part-")]
    text = spark.read.text(f"{tmp_path}/t.nt").selectExpr("sum(length(value) + 1)")
    assert sum(f.stat().st_size for f in files) < text.first()[0] / 5
    named = store.add_source(mapped(df, "row", "a"), "<u:g>")
    assert named.select(g="<u:g>").count() == 3000 * 3 + 1500 and named.query("SELECT ?c { GRAPH ?g { ?s <http://ex.org/c> ?c } FILTER(?g = <u:g>) }").count() == 3000


def test_select_of_lines_keeps_escaped_names(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<u:s> <u:p> "1" .\n<u:s> <u:\\u0070> "2" .\n<u:s> <u:q> <u:p> .\n<u:s> <u:q> "3" .\n', encoding="utf-8")
    store = open_store(spark, f"nt:{tmp_path}/a.nt")
    assert sorted(r.o for r in store.select(p="<u:p>").collect()) == ['"1"', '"2"']
    assert store.select(p=["<u:p>", "<u:q>"]).count() == 4 and [r.p for r in store.select(s="<u:s>", o="<u:p>").collect()] == ["<u:q>"]


def test_database_is_open_to_several_processes(spark):
    df = spark.createDataFrame([(1, 'a"b,\n\r\nx\\', None), (2, "", "en"), (3, " sp ", ""), (4, None, "\té😀")], "id bigint, value string, added_at string")
    url = _bulk_loaded({"rdf_odd": df})
    back = spark.read.format("jdbc").options(url=url, dbtable="rdf_odd", driver=DERBY).load()
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    jvm = spark.sparkContext._jvm.System
    ij = [jvm.getProperty("java.home") + "/bin/java", "-cp", jvm.getProperty("java.class.path"), "-Dderby.stream.error.field=java.lang.System.err", "org.apache.derby.tools.ij"]
    said = subprocess.run(ij, input=f"connect '{url}';\nselect count(*) + 38 from rdf_odd;\n", capture_output=True, text=True, timeout=100).stdout
    assert "42" in said and "ERROR" not in said


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.ttl").write_text('@prefix : <u:>. :a :p "x"; :k :b. :b :p "y".', encoding="utf-8")
    a = f"turtle:{tmp_path}/a.ttl"
    assert main(["query", a, "SELECT ?v { ?s <u:p> ?v } ORDER BY ?v", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out == "v\nx\ny\n"
    main(["query", a, "ASK { <u:a> <u:k> <u:b> }"], spark)
    main(["query", a, "CONSTRUCT { ?o <u:of> ?s } { ?s <u:k> ?o }"], spark)
    main(["query", a, "?s <u:k> _:o. _:o <u:p> ?v.", "--type", "graph"], spark)
    assert capsys.readouterr().out == 'true\n<u:b> <u:of> <u:a>.\n?s = <u:a>; ?v = "y"\n'
    main(["convert", a, f"nt:{tmp_path}/out.nt", "--graph", "u:g", "--stats"], spark)
    assert "3 statements" in capsys.readouterr().out and {r[3] for r in quads(read_rdf(spark, f"{tmp_path}/out.nt").quads)} == {"<u:g>"}
    (tmp_path / "r.n3").write_text("@prefix : <u:>. {?x :p ?y. ?y :p ?z} => {?x :p ?z}. :a :p :b. :b :p :c.", encoding="utf-8")
    assert main(["prove", f"{tmp_path}/r.n3", "<u:a> <u:p> <u:c>."], spark) == 0
    out = capsys.readouterr().out
    assert out.startswith("<u:a> <u:p> <u:c>.  # rule 0") and out.count("# given") == 2
    assert main(["prove", f"{tmp_path}/r.n3", "<u:c> <u:p> ?x."], spark) == 1


def test_entry_without_the_llm_part(tmp_path):
    """A copy of the package without the subpackage still imports and registers what is left."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quadflow", tmp_path / "quadflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'p1_found' in q and 'p3_found' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_sniffing_warnings_and_long_literals(spark, tmp_path):
    (tmp_path / "a.data").write_text("# note\n@prefix : <u:>.\n:a :p 1 .\n", encoding="utf-8")
    (tmp_path / "b.data").write_text('<u:a> <u:p> "' + 'x\\n\\"' * 60_000 + '" .\n<u:a> <u:p> "\\\\" . # "c" .\n', encoding="utf-8")
    (tmp_path / "c.data").write_text("<?xml version='1.0'?><rdf:RDF xmlns:rdf='" + T.RDF + "' xmlns='u:'><rdf:Description rdf:about='u:a'><p>1</p></rdf:Description></rdf:RDF>", encoding="utf-8")
    got = quads(read_rdf(spark, [str(tmp_path / f"{n}.data") for n in "abc"]).quads)
    assert len(got) == 4 and max(len(r[2]) for r in got) > 200_000 and ("<u:a>", "<u:p>", '"\\\\"', "") in got
    (tmp_path / "d.n3").write_text('@prefix : <u:>. "text" :p :o . :a :p :b .', encoding="utf-8")
    doc = read_rdf(spark, str(tmp_path / "d.n3"))
    assert len(quads(doc.quads)) == 1 and "literal subject" in doc.rejects.first()["error"]


def test_every_proof(spark):
    from quadflow.plans.algebra import Triple, Var
    from quadflow.operators.store import quads_from
    from quadflow.reason.rules import Rule, RuleEngine

    v = Var
    rule = Rule([Triple(v("a"), "<u:p>", v("b")), Triple(v("b"), "<u:p>", v("c"))], [Triple(v("a"), "<u:p>", v("c"))])
    facts = quads_from(spark, [("<u:a>", "<u:p>", "<u:b>"), ("<u:b>", "<u:p>", "<u:d>"), ("<u:a>", "<u:p>", "<u:c>"), ("<u:c>", "<u:p>", "<u:d>"), ("<u:a>", "<u:p>", "<u:d>")])
    goal = Triple("<u:a>", "<u:p>", "<u:d>")
    one = RuleEngine([rule]).prove(facts, goal).where("depth = 0").collect()
    every = RuleEngine([rule]).prove(facts, goal, all_proofs=True).where("depth = 0").collect()
    assert [r["rule"] for r in one] == [-1] and sorted(r["rule"] for r in every) == [-1, 0, 0]


def test_paths_over_the_graph(spark):
    from quadflow.operators.navigate import navigate
    from quadflow.operators.store import QuadStore

    s = QuadStore.from_statements(spark, [("<u:a>", "<u:p>", "<u:b>"), ("<u:a>", "<u:p>", "<u:c>"), ("<u:b>", "<u:q>", '"1"'), ("<u:c>", "<u:q>", '"2"'), ("<u:z>", "<u:p>", "<u:c>")])
    start = spark.createDataFrame([("<u:a>",), ("<u:a>",), (None,)], "t string")
    walk = lambda path: sorted(r["node"] for r in navigate(s, start, path, {"u": "u:"}).collect())
    assert walk("u:p/u:q") == ['"1"', '"2"'] and walk("u:p[2]/<u:q>") == ['"2"'] and walk("u:p/!u:p") == ["<u:a>", "<u:z>"] and walk("*/*") == ['"1"', '"2"'] and walk("u:q") == [] and walk("u:p[9]") == []
    with pytest.raises(ValueError):
        navigate(s, start, "u:p//u:q", {"u": "u:"})
