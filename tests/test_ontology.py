from kgspark.operators import ontology
from kgspark.sources.readers import statements

LINES = r"""
# a shop
<http://s/x#Shop> <RDFtype> <OWLClass> .
<http://s/x#Shop> <RDFScomment> "sells \"things\"\n here" .
<http://s/x/Clerk> <RDFtype> <OWLClass> . # trailing
<http://s/x#Town> <RDFtype> <OWLClass> .
<http://s/x#employs> <RDFtype> <OWLObjectProperty> .
<http://s/x#employs> <RDFSdomain> <http://s/x#Shop> .
<http://s/x#employs> <RDFSrange> <http://s/x/Clerk> .
<http://s/x#near> <RDFtype> <OWLObjectProperty> .
<http://s/x#near> <RDFSdomain> <http://s/x#Shop> .
<http://s/x#loose> <RDFtype> <OWLObjectProperty> .
<http://s/x#loose> <RDFSrange> <http://s/x#Town> .
<http://s/x#opened> <RDFtype> <OWLDatatypeProperty> .
<http://s/x#opened> <RDFSdomain> <http://s/x#Shop> .
<http://s/x#opened> <RDFSrange> <XSDdate> .
<http://s/x#share> <RDFtype> <OWLDatatypeProperty> .
<http://s/x#share> <RDFSdomain> <http://s/x#employs> .
<http://s/x#share> <RDFSrange> <XSDdecimal> .
<http://s/x#note> <RDFtype> <OWLDatatypeProperty> .
_:b1 <http://s/x#says> "hei"@nb .
_:b1 <http://s/x#count> "3"^^<XSDinteger> .
this line is no statement
"""


def test_ontology_of_statements(spark, tmp_path):
    text = LINES
    for name, uri in (("<RDFS", ontology.RDFS), ("<RDF", ontology.RDF), ("<OWL", ontology.OWL), ("<XSD", ontology.XSD)):
        text = text.replace(name, f"<{uri}")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "shop.nt").write_text(text)
    rdf = statements(spark, f"file://{tmp_path}")
    assert rdf.count() == 20
    assert {(r.o, r.is_iri, r.lang, r.datatype) for r in rdf.where("s = '_:b1'").collect()} == {("hei", False, "nb", None), ("3", False, None, ontology.XSD + "integer")}
    assert {(r.name, r.uri, r.description) for r in ontology.classes(rdf).collect()} == {("SHOP", "http://s/x#Shop", 'sells "things"\n here'), ("CLERK", "http://s/x/Clerk", None), ("TOWN", "http://s/x#Town", None)}
    assert {tuple(r)[0::2] + (r.range,) for r in ontology.relations(rdf).collect()} == {("EMPLOYS", "SHOP", "CLERK"), ("NEAR", "SHOP", None), ("LOOSE", None, "TOWN")}
    # a range of any class where there is only a domain; nothing without a domain
    assert {tuple(r) for r in ontology.validation_schema(rdf).collect()} == {("SHOP", "EMPLOYS", "CLERK"), ("SHOP", "NEAR", "SHOP"), ("SHOP", "NEAR", "CLERK"), ("SHOP", "NEAR", "TOWN")}
    # share waits for the relations; note has no owner and is a string
    assert {(r.owner, r.owner_kind, r.name, r.type) for r in ontology.properties(rdf).collect()} == {("SHOP", "entity", "OPENED", "str"), ("EMPLOYS", "relation", "SHARE", "float"), (None, None, "NOTE", "string")}
    types = ontology.xsd_types(rdf)
    assert {(r.name, r.datatype.replace(ontology.XSD, "")) for r in types.collect()} == {("OPENED", "date"), ("SHARE", "decimal"), ("NOTE", "string")}
    values = spark.createDataFrame([("a", "opened", "2001-01-01"), ("a", "other", "x"), ("a", None, None)], "s string, prop string, value string")
    assert {(r.prop, r.datatype.replace(ontology.XSD, "")) for r in ontology.typed_literals(values, types).collect()} == {("opened", "date"), ("other", "string"), (None, "string")}
    assert {r.name: r.uri for r in ontology.uris(rdf).collect()}["SHARE"] == "http://s/x#share"


def test_no_statements(spark):
    none = spark.createDataFrame([], "s string, p string, o string")
    assert all(f(none).count() == 0 for f in (ontology.classes, ontology.relations, ontology.properties, ontology.validation_schema, ontology.xsd_types, ontology.uris))
