"""Turtle, N3 and JSON-LD documents against triples written by hand, and the same triples in all formats."""

import json

import pytest

from quernel.sources import rdf
from quernel.sources.jsonld import jsonld_triples
from quernel.sources.turtle import turtle_triples

XSD = "http://www.w3.org/2001/XMLSchema#"


def short(triples):
    """Triples with compact names; prefixes left out."""
    names = {rdf.RDF: "rdf:", XSD: "xsd:", rdf.OWL: "owl:", "http://e/": "e:"}

    def text(value):
        for long, name in names.items():
            if isinstance(value, str) and value.startswith(long):
                return name + value[len(long) :]
        return value

    return [(text(s), text(p), text(o), *([text(lang or datatype)] if lang or datatype else [])) for s, _, p, o, _, lang, datatype in triples if p != rdf.PREFIX]


def turtle(body, n3=False):
    return short(turtle_triples(f"@prefix e: <http://e/> .\n{body}".encode(), n3))


def test_turtle_statements():
    assert turtle('e:a a e:C ; e:p 1, -2.5, 1e3 , true ; e:q "x"@en-GB, \'y\'^^e:t ; .') == [
        ("e:a", "rdf:type", "e:C"), ("e:a", "e:p", "1", "xsd:integer"), ("e:a", "e:p", "-2.5", "xsd:decimal"), ("e:a", "e:p", "1e3", "xsd:double"),
        ("e:a", "e:p", "true", "xsd:boolean"), ("e:a", "e:q", "x", "en-GB"), ("e:a", "e:q", "y", "e:t"),
    ]
    assert turtle('@base <http://e/x/> . <y> <../z> """long "q" \\u00e9\\\\\nline""" . <#f> e:p <> .') == [
        ("e:x/y", "e:z", 'long "q" é\\\nline'), ("e:x/#f", "e:p", "e:x/"),
    ]
    assert turtle("e:a.b e:c%20d\\,e e:x:y .e:k e:k e:1.# end") == [("e:a.b", "e:c%20d,e", "e:x:y"), ("e:k", "e:k", "e:1")]
    assert turtle("PREFIX f: <http://e/f>\nf:1 f: f:a-b .") == [("e:f1", "e:f", "e:fa-b")]
    assert turtle("") == [] and turtle("# nothing\n") == []


def test_turtle_brackets():
    assert turtle("e:a e:l ( 1 [ e:x e:y ] ( ) ) ; e:n [ a e:R ; e:o [ ] ] .") == [
        ("e:a", "e:l", "b1"), ("b1", "rdf:first", "1", "xsd:integer"), ("b1", "rdf:rest", "b2"), ("b2", "rdf:first", "b3"), ("b3", "e:x", "e:y"),
        ("b2", "rdf:rest", "b4"), ("b4", "rdf:first", "rdf:nil"), ("b4", "rdf:rest", "rdf:nil"), ("e:a", "e:n", "b5"), ("b5", "rdf:type", "e:R"), ("b5", "e:o", "b6"),
    ]
    assert turtle("[ e:p e:q ] e:r e:s . [ e:only e:this ] . [] e:z _:x.y .") == [("b1", "e:p", "e:q"), ("b1", "e:r", "e:s"), ("b2", "e:only", "e:this"), ("b3", "e:z", "nx.y")]
    assert turtle("( 1 ) e:len 1 . () e:len 0 .") == [
        ("b1", "rdf:first", "1", "xsd:integer"), ("b1", "rdf:rest", "rdf:nil"), ("b1", "e:len", "1", "xsd:integer"), ("rdf:nil", "e:len", "0", "xsd:integer"),
    ]


def test_turtle_of_any_depth():
    depth = 20_000
    assert len(turtle("e:a e:p " + "[ e:p " * depth + "e:b" + " ]" * depth + " .")) == depth + 1
    assert len(turtle("e:a e:p " + "( " * depth + " )" * depth + " .")) == 2 * depth - 1


def test_n3_statements():
    assert turtle("e:a = e:b . e:x <= e:y . e:z is e:child of e:p, e:q . e:a has e:h e:i . e:m!e:f^e:g e:is e:t . e:s e:o e:j!e:k .", n3=True) == [
        ("e:a", "owl:sameAs", "e:b"), ("e:y", "http://www.w3.org/2000/10/swap/log#implies", "e:x"), ("e:p", "e:child", "e:z"), ("e:q", "e:child", "e:z"), ("e:a", "e:h", "e:i"),
        ("e:m", "e:f", "b1"), ("b2", "e:g", "b1"), ("b2", "e:is", "e:t"), ("e:j", "e:k", "b3"), ("e:s", "e:o", "b3"),
    ]


@pytest.mark.parametrize("text", [
    "f:a e:b e:c .", "<a> <b> .", "<a> <b> <c>", "<a> <b> [ <c> ] .", '<a> "x" <c> .', "<a> <b> <c> ] .", "<a> <b> ( 1 ", "<a> <b> {} .", "<a> ; .", "<a> .", '"l" <b> <c> .',
    '<a> <b> "x\n" .', "<a> <b> <c>, .", "@foo <x> .", "[ <a> <b> , ] .", "<a> <b> <c> . .", "<a> = <b> .", "<a> <b> ?x .", "<a> <b> <c d> .", "<a> <b> 'x'^^ .", "@prefix e <x> .",
])
def test_turtle_errors(text):
    with pytest.raises(ValueError):
        turtle(text)


def jsonld(document):
    return short(jsonld_triples(json.dumps(document).encode()))


def test_jsonld_terms():
    context = {
        "e": "http://e/", "name": "e:name", "knows": {"@id": "e:knows", "@type": "@id"}, "born": {"@id": "e:born", "@type": "xsd:date"}, "xsd": XSD, "id": "@id", "type": "@type",
        "label": {"@id": "e:label", "@container": "@language"}, "child": {"@reverse": "e:parent"}, "@vocab": "http://e/v/", "@base": "http://e/x/",
    }
    node = {
        "id": "a", "type": ["Person", "e:C"], "name": "A", "knows": ["b", "_:z"], "born": "2020-01-01", "label": {"en": ["one", "uno"], "@none": "n"}, "child": {"id": "kid"},
        "free": {"@value": "v", "@language": "de"}, "inner": {"name": "blank"}, "no": None, "@reverse": {"e:of": {"id": "r"}},
    }
    assert jsonld({"@context": context, **node}) == [
        ("e:x/a", "rdf:type", "e:v/Person"), ("e:x/a", "rdf:type", "e:C"), ("e:x/a", "e:name", "A"), ("e:x/a", "e:knows", "e:x/b"), ("e:x/a", "e:knows", "nz"), ("e:x/a", "e:born", "2020-01-01", "xsd:date"),
        ("e:x/a", "e:label", "one", "en"), ("e:x/a", "e:label", "uno", "en"), ("e:x/a", "e:label", "n"), ("e:x/kid", "e:parent", "e:x/a"), ("e:x/a", "e:v/free", "v", "de"), ("e:x/a", "e:v/inner", "b1"),
        ("b1", "e:name", "blank"), ("e:x/r", "e:of", "e:x/a"),
    ]


def test_jsonld_values_and_lists():
    context = {"e": "http://e/", "list": {"@id": "e:list", "@container": "@list"}, "kind": {"@id": "e:kind", "@type": "@vocab"}, "@vocab": "http://e/", "index": {"@id": "e:index", "@container": "@index"}}
    assert jsonld([{"@context": context, "@id": "e:a", "e:n": [1, 2.5, True, 5.0, 1e22, {"@value": 2, "@type": XSD + "double"}], "list": [1, {"@id": "e:b"}], "e:o": {"@list": []}, "kind": "Sort", "index": {"x": "1", "y": ["2", "3"]}}]) == [
        ("e:a", "e:n", "1", "xsd:integer"), ("e:a", "e:n", "2.5E0", "xsd:double"), ("e:a", "e:n", "true", "xsd:boolean"), ("e:a", "e:n", "5", "xsd:integer"), ("e:a", "e:n", "1.0E22", "xsd:double"),
        ("e:a", "e:n", "2.0E0", "xsd:double"), ("e:a", "e:list", "b1"), ("b1", "rdf:first", "1", "xsd:integer"), ("b1", "rdf:rest", "b2"), ("b2", "rdf:first", "e:b"), ("b2", "rdf:rest", "rdf:nil"),
        ("e:a", "e:o", "rdf:nil"), ("e:a", "e:kind", "e:Sort"), ("e:a", "e:index", "1"), ("e:a", "e:index", "2"), ("e:a", "e:index", "3"),
    ]
    nested = {"@context": {"e": "http://e/", "p": "e:p"}, "@graph": [{"@id": "e:a", "p": "x"}, {"@context": {"@language": "fr", "p": None}, "@id": "e:b", "p": "dropped", "e:q": "oui"}]}
    assert jsonld(nested) == [("e:a", "e:p", "x"), ("e:b", "e:q", "oui", "fr")]


@pytest.mark.parametrize("document", [{"@context": "http://far.away/context"}, {"@id": "http://e/g", "@graph": [{"@id": "http://e/a"}]}, {"@context": {"a": "b:x", "b": "a:y"}, "a": 1}])
def test_jsonld_errors(document):
    with pytest.raises(ValueError):
        jsonld(document)


SAME = {
    "a.rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:C rdf:about="http://e/a"><e:p xml:lang="en">x</e:p><e:l rdf:parseType="Collection"><e:D/></e:l></e:C></rdf:RDF>',
    "a.ttl": '@prefix e: <http://e/> . e:a a e:C ; e:p "x"@en ; e:l ( [ a e:D ] ) .',
    "a.n3": '@prefix e: <http://e/> . e:a a e:C ; e:p "x"@en ; e:l ( [ a e:D ] ) .',
    "a.nt": '<http://e/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/C> .\n<http://e/a> <http://e/p> "x"@en .\n<http://e/a> <http://e/l> _:c .\n_:c <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> _:d .\n'
    "_:d <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/D> .\n_:c <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .",
    "a.jsonld": '{"@context": {"e": "http://e/"}, "@id": "e:a", "@type": "e:C", "e:p": {"@value": "x", "@language": "en"}, "e:l": {"@list": [{"@type": "e:D"}]}}',
}


def test_all_formats_give_the_same_triples(spark):
    rows = rdf.read_rdf(spark.createDataFrame([(name, text.encode()) for name, text in SAME.items()], "file string, content binary")).collect()
    found = {name: [tuple(r)[2:] for r in sorted(rows, key=lambda r: r["ord"]) if r["file"] == name and r["p"] != rdf.PREFIX] for name in SAME}
    label = lambda triples: [tuple({"b1": "c", "b2": "d", "nc": "c", "nd": "d"}.get(v, v) for v in t) for t in triples]
    assert len(found["a.rdf"]) == 6 and all(label(triples) == label(found["a.rdf"]) for triples in found.values())


def test_a_broken_file_is_named(spark):
    broken = spark.createDataFrame([("x/broken.ttl", b"<a> <b> .")], "file string, content binary")
    with pytest.raises(Exception, match="broken.ttl is no turtle document"):
        rdf.read_rdf(broken).collect()


def test_input_paths(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.ttl").write_text("<http://e/a> <http://e/b> 1 .")
    assert rdf.resolve_input(spark, "sub/a.ttl", str(tmp_path)) == rdf.resolve_input(spark, str(tmp_path / "sub" / "a.ttl")) == str(tmp_path / "sub" / "a.ttl")
    assert rdf.read_file(spark, "sub/a.ttl", str(tmp_path)).count() == 1
    for path, error, words in (("sub/b.ttl", FileNotFoundError, "RDF input file not found"), (str(tmp_path / "sub"), ValueError, "must be a file")):
        with pytest.raises(error, match=words):
            rdf.resolve_input(spark, path, str(tmp_path))
    with pytest.raises(ValueError, match="must be a directory"):
        rdf.resolve_input(spark, str(tmp_path / "sub" / "a.ttl"), folder=True)
