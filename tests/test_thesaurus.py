"""Ancestors at any depth."""

from quadrille.functions.namespaces import DC, EDM, SKOS
from quadrille.operators.thesaurus import broader_closure


def test_broader_closure_at_any_depth(spark):
    chain = [(f"c{i}", SKOS + "broader", f"c{i + 1}") for i in range(14)]
    rows = [*chain, ("x", SKOS + "broader", "y"), ("y", SKOS + "broader", "x"), ("c14", SKOS + "prefLabel", "top")]
    got = {tuple(r) for r in broader_closure(spark.createDataFrame(rows, "s string, p string, o string")).select("s", "ancestor", "label").collect()}
    want = {(f"c{i}", f"c{j}", "top" if j == 14 else None) for i in range(15) for j in range(i + 1, 15)}
    assert got == want | {("x", "y", None), ("y", "x", None)}


def test_nested_documents_deal_their_fields_once_a_level(spark):
    from quadrille.operators.documents import to_nested_docs

    view, place = "urn:v", "urn:place"
    row = lambda s, p, o, kind="URIRef": ("urn:r/graph", s, "URIRef", p, o, kind, None, None)
    rows = [row("urn:r", EDM + "hasView", view), row("urn:r", DC + "source", view, "Literal"), row(view, DC + "relation", place), row(place, DC + "title", "here", "Literal"), row(place, DC + "relation", "urn:r")]
    docs = to_nested_docs(spark.createDataFrame(rows, "graph string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string"), depth=3)
    fields = docs.first().fields
    assert fields["dc_source"][0].inline is None
    assert {k: [v.raw for v in x] for k, x in fields["edm_hasView"][0].inline.items()} == {"dc_relation": ["here"]}
    assert fields["edm_hasView"][0].inline["dc_relation"][0].inline == {"dc_title": ["here"], "dc_relation": ["urn:r"]}
    # of all shuffles, those of nested fields: one where a level is grouped, one for the documents
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 14
