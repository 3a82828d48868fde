"""YAML views, stored tables, ontology readers, type maps, and SQL around views."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.engine import Engine
from quillon.errors import AccessError, SemanticError
from quillon.functions.dialect import to_spark
from quillon.functions.outer import order_nulls, qualify
from quillon.functions.tokens import lex, text_of
from quillon.governance import inventory
from quillon.governance.ops import dedup_loads
from quillon.governance.policies import Policies, SecurityContext
from quillon.model.yaml_io import from_yaml, to_yaml
from quillon.operators import graph
from quillon.sources import ontology, rdf, tables

FULL = """
name: FULL
description: all that a view can say
tables:
  - name: seg
    base_table: {database: D, schema: S, table: SEG}
    primary_key: {columns: [id]}
    unique_keys: [{columns: [cust, a, b]}]
    constraints: [{name: period, distinct_range: {start_column: a, end_column: b}}]
    dimensions: [{name: segment, expr: SEG, synonyms: [tier], access_modifier: private_access}]
  - name: ord
    base_table: {definition: "SELECT * FROM x WHERE y > 1"}
    facts: [{name: amt, expr: AMOUNT}]
    metrics:
      - name: total
        expr: SUM(amt)
        using_relationships: [r]
        non_additive_dimensions: [{table: ord, dimension: day, sort_direction: descending, null_order: last}]
relationships:
  - name: r
    left_table: ord
    right_table: seg
    relationship_columns:
      - {left_column: cust, right_column: cust}
      - {left_column: day, type: range, right_range: {start_column: a, end_column: b}}
metrics: [{name: twice, expr: total * 2}]
variables: [{name: v, data_type: NUMBER, default: 3}]
verified_queries: [{name: q, question: how much, sql: SELECT 1}]
module_custom_instructions: {sql_generation: be brief}
"""


def test_yaml_round_trip():
    v = from_yaml(FULL)
    assert v == from_yaml(to_yaml(v))
    assert v.tables[0].source == "D.S.SEG" and v.tables[1].is_query and v.tables[0].distinct_range == ("a", "b")
    assert v.relationships[0].range == ("a", "b") and v.relationships[0].right_keys == ["cust"]
    assert v.metrics[0].non_additive == [("ord.day", "DESC")] and v.metrics[1].entity is None and v.dimensions[0].extras.private


def test_statements_around_views():
    said = lambda f, sql: text_of(f(lex(sql)))
    assert said(order_nulls, "SELECT a FROM t ORDER BY a, b DESC, c NULLS FIRST LIMIT 3") == "SELECT a FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST, c NULLS FIRST LIMIT 3"
    assert "ORDER BY x NULLS LAST ROWS" in said(order_nulls, "SELECT SUM(a) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) FROM t")
    assert "WHERE __kept ORDER BY a" in said(qualify, "SELECT a FROM t QUALIFY ROW_NUMBER() OVER (ORDER BY a) = 1 ORDER BY a")
    assert to_spark("x::VARCHAR") == "CAST(x AS STRING)"


def test_snapshots_in_the_order_said(spark):
    spark.createDataFrame([(1, 1, 10), (2, 1, 20), (2, 2, 30), (3, 0, 5)], "d int, e int, bal int").createOrReplaceTempView("snap_t")
    for order, want in [("d ASC", 5), ("d DESC", 10), ("d ASC, e DESC", 5), ("d", 5)]:
        e = Engine(spark)
        e.deploy(f"CREATE SEMANTIC VIEW v TABLES (s AS snap_t) DIMENSIONS (s.d AS d, s.e AS e) METRICS (s.m NON ADDITIVE BY ({order}) AS SUM(bal))")
        assert e.query("v", [], ["m"]).first().m == want, order
    e.deploy("CREATE SEMANTIC VIEW w TABLES (s AS (SELECT * FROM snap_t WHERE d < 3)) DIMENSIONS (s.d AS d, s.e AS e) METRICS (s.m NON ADDITIVE BY (d ASC, e DESC) AS SUM(bal))")
    assert e.query("w", [], ["m"]).first().m == 20


def test_policies_reach_through_views(spark):
    spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int").createOrReplaceTempView("pol_base")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW pol_view AS SELECT g AS name, v FROM pol_base")
    spark.table("pol_base").select("g").createOrReplaceTempView("pol_opaque")
    e = Engine(spark, Policies(row={"pol_base": "g = 'b'"}, mask={("pol_base", "v"): "NULL"}))
    who = SecurityContext(primary="X")
    assert [tuple(r) for r in e.sql("SELECT name, v FROM pol_view ORDER BY name", who).collect()] == [("b", None)]
    assert [r.g for r in e.sql("WITH c AS (SELECT * FROM pol_base) SELECT c.g FROM c, (SELECT 1 AS one) o", who).collect()] == ["b"]
    assert e.sql("SELECT COUNT(*) AS n FROM pol_base p WHERE EXISTS (SELECT 1 FROM pol_base q WHERE q.g = p.g)", who).first().n == 1
    assert e.sql("SELECT COUNT(*) AS n FROM pol_base").first().n == 2
    with pytest.raises(AccessError):
        e.sql("SELECT * FROM pol_opaque", who)


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "x"), (None, "y"), (None, "y")], "k int, v string")
    assert tables.insert_if_absent(df, path, ["k"]) == 2 and tables.insert_if_absent(df, path, ["k"]) == 0
    assert spark.read.parquet(path).count() == 2
    p = f"file://{tmp_path}/p"
    for rule, n in (("r", 2), ("q", 3), ("r", 1)):
        tables.replace_part(spark.range(n).withColumn("rule_id", F.lit(rule)), p, "rule_id", rule)
    read = lambda: {r.rule_id: r["count"] for r in tables.read(spark, p, "id long, rule_id string").groupBy("rule_id").count().collect()}
    assert read() == {"r": 1, "q": 3}
    tables.replace_part(spark.range(0).withColumn("rule_id", F.lit("q")), p, "rule_id", "q")
    assert read() == {"r": 1} and tables.read(spark, f"{p}-none", "id long").count() == 0


def test_ontology_files(spark, tmp_path):
    a, s = "http://x/o#", "http://www.w3.org/2000/01/rdf-schema#"
    t, o = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2002/07/owl#"
    lines = [f"<{a}Cat> <{t}> <{o}Class> .", f"<{a}Animal> <{t}> <{o}Class> .", f"<{a}Cat> <{s}subClassOf> <{a}Animal> .", f'<{a}Cat> <{s}label> "The cat"@en .', f"<{a}eats> <{t}> <{o}ObjectProperty> .", f"<{a}eats> <{s}domain> <{a}Cat> .", f"<{a}eats> <{s}range> <{a}Animal> .", f"<{a}eats> <{t}> <{o}TransitiveProperty> .", "# not a triple"]
    (tmp_path / "o.nt").write_text("\n".join(lines))
    triples = ontology.read_triples(spark, f"file://{tmp_path}/o.nt")
    assert sorted(map(tuple, ontology.classes_of(triples).collect())) == [("Animal", "Animal", None, True), ("Cat", "The cat", "Animal", False)]
    assert [tuple(r) for r in ontology.relations_of(triples).collect()] == [("eats", "Cat", "Animal", False, True)]
    (tmp_path / "o.json").write_text('{"classes": [{"name": "Cat", "parents": ["Animal"]}, {"name": "Animal"}], "relations": [{"name": "eats", "domain_class": "Cat", "range_class": "Animal"}]}')
    classes, relations = ontology.read_json(spark, f"file://{tmp_path}/o.json")
    assert sorted((r.class_id, r.parent) for r in classes.collect()) == [("Animal", None), ("Cat", "Animal")] and relations.count() == 1
    assert {r.class_id: r.depth for r in ontology.depth(classes).collect()} == {"Animal": 0, "Cat": 1}


def test_exchange_types():
    known = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DecimalType(9, 2), False)])
    assert inventory.exchange_types(known) == [{"name": "a", "type": "Integer64", "nullable": True}, {"name": "b", "type": "Decimal", "precision": 9, "scale": 2, "nullable": False}]
    with pytest.raises(SemanticError, match="c .array"):
        inventory.exchange_types(T.StructType([T.StructField("c", T.ArrayType(T.LongType()))]))


def test_loads_are_told_apart(spark):
    df = spark.createDataFrame([("a|b", "", 1), ("a", "b|", 2), (None, "", 3), ("", None, 4), ("", "", 5), ("", "", 6)], "x string, y string, at int")
    assert sorted(r["at"] for r in dedup_loads(df, ["x", "y"], [F.col("at")]).collect()) == [1, 2, 3, 4, 5]


def test_walks(spark):
    nodes = spark.createDataFrame([(f"n{k}", "t", f"N{k}", "{}") for k in range(25)], "node_id string, node_type string, name string, props string")
    chain = spark.createDataFrame([(f"n{k + 1}", f"n{k}", "subClassOf") for k in range(24)], "src_id string, dst_id string, edge_type string")
    assert graph.descendants(nodes, chain, "n0").agg(F.max("depth")).first()[0] == 15
    assert graph.ancestors(nodes, chain, "N24").agg(F.max("depth"), F.min("depth")).first()[:] == (20, 1)
    assert graph.hierarchy_path(nodes, chain, "N24", "N3").count() == 0
    assert [r.relationship for r in graph.hierarchy_path(nodes, chain, "N5", "N3").orderBy("step").collect()] == ["START", "subClassOf", "subClassOf"]
    two = chain.unionByName(spark.createDataFrame([("n2", "n0", "subClassOf")], chain.schema))
    assert graph.descendants(nodes, two, "N0").where("node_id = 'n2'").count() == 2


def test_one_ontology_in_three_formats(spark, tmp_path):
    turtle = """@base <http://x/o> . @prefix : <#> . PREFIX owl: <http://www.w3.org/2002/07/owl#>
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . # a comment
<#Animal> a owl:Class ; rdfs:label \"\"\"Any "living"
thing\"\"\"@en .
:Cat a owl:Class ; rdfs:subClassOf :Animal , [ a owl:Restriction ; owl:onProperty :eats ; owl:minCardinality 1 ] ; rdfs:label 'The \\u0063at' ;.
:Pet a owl:Class ; owl:unionOf ( :Cat :Dog ) .
:eats a owl:ObjectProperty, owl:TransitiveProperty ; rdfs:domain :Cat ; rdfs:range :Animal .
[] rdfs:comment "x"^^<http://www.w3.org/2001/XMLSchema#string> ."""
    xml = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://x/o">
<owl:Class rdf:about="#Animal"><rdfs:label xml:lang="en">Any "living"
thing</rdfs:label></owl:Class>
<owl:Class rdf:ID="Cat" rdfs:label="The cat"><rdfs:subClassOf rdf:resource="#Animal"/>
 <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#eats"/><owl:minCardinality>1</owl:minCardinality></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="http://x/o#Pet"><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#Cat"/><rdf:Description rdf:about="#Dog"/></owl:unionOf></owl:Class>
<owl:ObjectProperty rdf:about="#eats"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/><rdfs:domain rdf:resource="#Cat"/><rdfs:range rdf:resource="#Animal"/></owl:ObjectProperty>
<rdf:Description><rdfs:comment>x</rdfs:comment></rdf:Description></rdf:RDF>"""
    for name, text in (("o.ttl", turtle), ("o.owl", xml)):
        (tmp_path / name).write_text(text)
    a, b = rdf.read_turtle(spark, f"file://{tmp_path}/o.ttl"), rdf.read_rdf_xml(spark, f"file://{tmp_path}/o.owl")
    shape = lambda df: sorted(tuple("_" if x.startswith("_:") else x for x in r) for r in df.collect())
    assert shape(a) == shape(b) and a.count() == 20
    (tmp_path / "o.nt").write_text("\n".join(f"<{s}> <{p}> <{o}> ." if ":" in o else f'<{s}> <{p}> "{o}" .' for s, p, o in shape(a) if "_" not in (s, o) and "\n" not in o))
    c = ontology.read_triples(spark, f"file://{tmp_path}/o.nt")

    def told(df):
        classes = {(r.class_id, r.is_abstract) for r in ontology.classes_of(df).collect()}
        return sorted(map(str, ontology.relations_of(df).collect())), classes

    assert told(a) == told(b) == told(c)
    assert [r.label for r in ontology.classes_of(a).where("class_id = 'Animal'").collect()] == ['Any "living"\nthing']
    for bad in ("<a> <b> .", "x:y a <c> .", "<a> <b> [ <c> .", "<a> <b> %"):
        with pytest.raises(ValueError):
            rdf.Turtle(bad)
