"""Models generated from an ontology: every verified query runs, and means what its words say."""

from quillon.engine import Engine
from quillon.model.generated import Ontology, deploy_models
from quillon.model.introspect import verified_answer

ZOO = Ontology("zoo", {"Keeper": ("k", {"age": "int"}), "Animal": ("a", {"kind": "string", "weight": "double"})}, {"keeps": ("Keeper", "Animal"), "eats": ("Animal", "Animal")}, {"Keeper": "Being", "Animal": "Being"})


def test_every_verified_query(spark):
    nodes = spark.createDataFrame([("k:1", "k", "Kim", '{"age": 30}'), ("a:1", "a", "Cat", '{"kind": "pet", "weight": 4.5}'), ("a:2", "a", "Mouse", '{"kind": "wild", "weight": 0.1}'), ("x:1", "x", "Stone", "{}")], "node_id string, node_type string, name string, props string")
    edges = spark.createDataFrame([("k:1", "a:1", "keeps", 1.0), ("a:1", "a:2", "eats", 2.0)], "src_id string, dst_id string, edge_type string, weight double").selectExpr("*", "CAST(NULL AS DATE) AS effective_start", "CAST(NULL AS DATE) AS effective_end")
    e = Engine(spark)
    names = deploy_models(e, ZOO, nodes, edges)
    assert names == ["zoo_kg_model", "zoo_ontology_model", "zoo_metadata_model"]
    told = {q["question"]: sorted(map(tuple, verified_answer(e, name, q["question"]).collect()), key=str) for name in names for q in e.view(name).verified_queries}
    assert told["How many Animal are there?"] == [(2,)]
    assert told["Which Animal are linked to which Animal by eats?"] == [("Cat", "Mouse", 1)]
    assert told["Which Animal has the most Keeper by keeps?"] == [("Cat", 1)]
    assert told["How many entities of each type exist?"] == [("Animal", 2), ("Keeper", 1)]
    assert told["How many classes are abstract?"] == [(False, 2), (True, 1)]
    assert told["How many properties does each class have?"] == [("Animal", 2), ("Keeper", 1)]
    assert told["Which relations are defined?"] == [("eats", "Animal", "Animal"), ("keeps", "Keeper", "Animal")]
    assert len(told) == sum(len(e.view(n).verified_queries) for n in names)
    assert e.query("zoo_kg_model", ["animal_kind"], ["animal_weight_sum"]).count() == 2
