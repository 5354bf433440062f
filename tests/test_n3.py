import pytest

from gossamer import terms as T
from gossamer.sources import n3, rdfxml, results
from gossamer.sources.n3_writer import Writer, formula_text


def root(text):
    return n3.parse(text, "http://e/d").root.statements


def test_turtle_forms():
    st = root('@prefix : <http://x#> . :a a :B ; :p "t"@en , 1 , 1.5 , 1e3 , true , "x\\n\\u00e9"^^:t . [] :q ( :a ( ) ) .')
    objects = [o for _, _, o in st]
    assert objects[:7] == ["<http://x#B>", '"t"@en', T.xsd(1, "integer"), T.xsd("1.5", "decimal"), T.xsd("1e3", "double"), T.xsd("true", "boolean"), T.lit("x\né", "http://x#t")]
    assert T.members(objects[7]) == ["<http://x#a>", T.EMPTY_LIST] and st[7][0].startswith("_:")


def test_n3_forms():
    d = n3.parse("""@prefix : <http://x#> . @prefix log: <http://www.w3.org/2000/10/swap/log#> .
    @forAll :v . @forSome :e . { :v :p :e } => { ?y :q [ :r :v ] } . :a = :b . :c is :d of :f . :g has :h :i . :a!:p :q :b^:r . :s :t {$ 1, 2, 1 $} .""", "http://e/d")
    st = d.root.statements
    rule = next(s for s in st if s[1] == T.IMPLIES)
    body, head = d.formulas[rule[0][1:]], d.formulas[rule[2][1:]]
    assert body.statements[0][0] == "?v" and body.statements[0][2].startswith("_:") and len(head.statements) == 2
    assert "?v" in d.root.universals and "?y" in d.root.universals
    assert ("<http://x#a>", T.SAME_AS, "<http://x#b>") in st and ("<http://x#f>", "<http://x#d>", "<http://x#c>") in st and ("<http://x#g>", "<http://x#h>", "<http://x#i>") in st
    assert any(o == T.seq("S", [T.xsd(2, "integer"), T.xsd(1, "integer")]) for _, _, o in st)


def test_bases_keywords_and_comments():
    assert root("@prefix p: <sub#> . <a> <#b> p:c . # end") == [("<http://e/a>", "<http://e/d#b>", "<http://e/sub#c>")]
    assert root("@keywords a , is , of . x a y .")[0] == ("<http://e/d#x>", T.TYPE, "<http://e/d#y>")
    assert root("PREFIX q: <http://q/>\nq:a q:b q:c .") == [("<http://q/a>", "<http://q/b>", "<http://q/c>")]


@pytest.mark.parametrize("text", ["x:a x:b x:c .", "<a> <b> ", "<a> <b> { <c> ", "<a> <b> 'c", "."])
def test_errors_name_a_line(text):
    with pytest.raises(n3.SyntaxProblem):
        root(text)


def test_lists_from_cells():
    st = root("@prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix : <http://x#> . _:a r:first 1 ; r:rest _:b . _:b r:first :c ; r:rest r:nil . :s :p _:a .")
    assert n3.collapsed(st) == [("<http://x#s>", "<http://x#p>", T.seq("L", [T.xsd(1, "integer"), "<http://x#c>"]))]


def test_written_text_reads_back():
    text = '@prefix : <http://x#> . :a :p "q\\"uo\\te" , 1 , "1" , 1.5e3 , :b ; a :C . :l :is ( 1 ( :a ) ) . { ?x :p ?y } => { ?y :q ?x } .'
    d = n3.parse(text, "http://e/d")
    out = Writer(d.formulas, d.prefixes).document(d.root)
    again = n3.parse(out, "http://e/d")
    plain = lambda doc: sorted(str(s) for s in doc.root.statements if not s[0].startswith("F"))
    assert plain(d) == plain(again) and "=>" in out and "@prefix : <http://x#>" in out
    assert formula_text(d.formulas, "f1") != ""


def test_terms():
    for t in ("<http://a#b>", "_:x", '"a"b"', '"x"@en-gb', '"1"^^<u:t>', T.seq("L", ["<a>", '"q"'])):
        assert T.kind_of(t) in ("IRI", "BNODE", "LIT", "LIST")
    assert T.parts('"a"b"^^<u>') == ('a"b', "u", None) and T.parts('"x"@en') == ("x", None, "en")
    assert T.seq("S", ["<b>", "<a>", "<b>"]) == 'S["<a>","<b>"]' and T.variables(T.seq("L", ["?x", "<a>"])) == {"?x"}


RDF_XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e#" xml:base="http://base/">
<e:Thing rdf:about="a" e:attr="v"><e:p xml:lang="en">t</e:p><e:q rdf:resource="b"/><e:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:n>
<e:x rdf:parseType="Literal"><b>bold</b></e:x><e:l rdf:parseType="Collection"><rdf:Description rdf:about="c"/></e:l><e:r rdf:parseType="Resource"><e:i>1</e:i></e:r><e:d><e:Thing rdf:nodeID="z"/></e:d></e:Thing></rdf:RDF>"""


def test_rdf_xml():
    st = rdfxml.parse(RDF_XML, "http://doc/").root.statements
    s = "<http://base/a>"
    assert {(s, T.TYPE, "<http://e#Thing>"), (s, "<http://e#attr>", '"v"'), (s, "<http://e#p>", '"t"@en'), (s, "<http://e#q>", "<http://base/b>"), (s, "<http://e#n>", T.xsd(5, "integer")), (s, "<http://e#l>", T.seq("L", ["<http://base/c>"])), (s, "<http://e#d>", "_:z"), ("_:z", T.TYPE, "<http://e#Thing>")} <= set(st)
    plain = [x for x in st if not any(t.startswith("_:") for t in x)]
    again = rdfxml.parse(rdfxml.write(plain, {"e": "http://e#"}), "http://doc/").root.statements
    assert set(again) == set(plain)
    with pytest.raises(ValueError):
        rdfxml.write([('"lit"', "<http://e#p>", "<b>")])
    with pytest.raises(n3.SyntaxProblem):
        rdfxml.parse("<a>")


def test_result_xml(spark):
    df = spark.createDataFrame([("<http://a>", '"x"@en'), ("_:b", None)], "x string, y string")
    names, rows = results.from_xml(results.to_xml(df))
    assert names == ["x", "y"] and {"x": "<http://a>", "y": '"x"@en'} in rows and {"x": "_:b"} in rows
    asked = results.remote(spark, "http://service/", "ASK {}", lambda url: results.to_xml(spark.createDataFrame([(True,)], "result boolean")))
    assert asked.first().result is True
    assert {tuple(r) for r in results.remote(spark, "http://s/", "SELECT", lambda url: results.to_xml(df)).collect()} == {tuple(r) for r in df.collect()}


FLAGGED = """@prefix : <http://e.org/v#> . @prefix x: <urn:x#> .
:a :p [ :q 1 ; :r [ :s "é" ] ] , (1 2 "c") ; a :T . _:k :p _:l . _:l :p _:k . x:a x:b _:m . x:c x:b _:m . :z = :y .
{ :a :b [ :c :d ] } => { :e :f :g } . <http://e.org/é> :n 2.5 .
"""


@pytest.mark.parametrize("flags", ["", "a", "d", "e", "i", "n", "p", "q", "r", "s", "t", "u", "v", "/", "spart", "pua"])
def test_writer_flags_keep_the_statements(flags):
    from gossamer.sources.n3_writer import Writer

    d = n3.parse(FLAGGED, "http://e.org/v", "t_")
    text = Writer(d.formulas, d.prefixes, flags, "http://e.org/v").document(d.root)
    again = n3.parse(text, "http://e.org/v", "u_")
    ground = lambda doc: sorted(map(str, (st for st in doc.root.statements if not any(isinstance(t, str) and t[0] in "_F" for t in st))))
    assert ground(again) == ground(d) and [len(f.statements) for f in again.formulas.values()] == [13, 2, 1]
    assert ("[" in text) != bool({"a", "s"} & set(flags)) and ("@prefix" in text) != ("p" in flags)
    assert ('"é"' in text) != ("e" in flags) and ("2.5 " in text) != ("n" in flags) and ("=>" in text) != ("t" in flags)


def test_lists_without_their_syntax():
    from gossamer.sources.n3_writer import Writer

    d = n3.parse("@prefix : <urn:x#> . :a :b (1 (2) ()) .", "urn:d")
    text = Writer(d.formulas, d.prefixes, "l").document(d.root)
    assert "(" not in text and n3.collapsed(n3.parse(text, "urn:d").root.statements) == n3.collapsed(d.root.statements)


@pytest.mark.parametrize("flags", ["", "b", "c", "d", "r", "z", "bcd"])
def test_rdf_flags_keep_the_statements(flags):
    from gossamer.sources import rdfxml

    d = n3.parse("@prefix : <http://e.org/v#> . @prefix x: <urn:x#> . :a :p _:k , (:b :c) ; a :T , x:U . _:k :q 'v'@en .", "http://e.org/v", "t_")
    text = rdfxml.write([tuple(st) for st in d.root.statements], d.prefixes, flags, "http://e.org/v")
    again = rdfxml.parse(text, "http://e.org/v", "u_").root.statements
    ground = lambda sts: sorted(st for st in sts if not any(t[0] == "_" for t in st))
    assert len(again) == len(d.root.statements) and (set(flags) & {"b", "z"} or ground(again) == ground(map(tuple, d.root.statements)))
    assert ("<T " in text or ":T " in text) != ("c" in flags) and ("nodeID" in text) != ("b" in flags) and ('xmlns="' in text) != ("d" in flags)
