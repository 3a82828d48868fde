"""Semantic models derived from an ontology over a property graph: entities, cross-type links, and the ontology itself.

Each comes with join paths and verified queries, as a view that deploys through
its own YAML text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.model import yaml_io
from quillon.model.schema import Extras, Item, Relationship, SemanticView, Table
from quillon.operators import graph

NUMBERS = ("int", "long", "bigint", "double", "float", "decimal", "smallint", "tinyint")


@dataclass(frozen=True)
class Ontology:
    """classes: name -> (node type, properties and their types); relations: edge type -> (domain class, range class); parents: class -> class above."""

    name: str
    classes: dict[str, tuple[str, dict[str, str]]]
    relations: dict[str, tuple[str, str]]
    parents: dict[str, str]

    def view(self, kind: str, of: str = "") -> str:
        return "_".join(x.lower() for x in (self.name, kind, of) if x)


def create_views(spark: SparkSession, o: Ontology, nodes: DataFrame, edges: DataFrame) -> list[str]:
    """The views that the models read: typed nodes of each class, edges of each relation, both resolved over all types, and the ontology's tables."""
    made = {o.view("v", c): graph.typed_view(nodes, kind, fields) for c, (kind, fields) in o.classes.items()}
    made |= {o.view("rel", r): graph.relation_view(edges, r).select("src_id", "dst_id", "weight") for r in o.relations}
    named = {kind: c for c, (kind, _) in o.classes.items()}
    kinds = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    every = nodes.select(F.col("node_id").alias("entity_id"), F.try_element_at(kinds, F.col("node_type")).alias("entity_type"), F.col("name").alias("entity_name"))
    made[o.view("all_entities")] = every.where("entity_type is not null")
    made[o.view("rel_resolved")] = graph.resolved(nodes, edges).withColumnRenamed("edge_type", "rel_name")
    abstract = set(o.parents.values()) - set(o.classes)
    defined = sorted(set(o.classes) | set(o.parents) | set(o.parents.values()))
    made[o.view("ont_class")] = spark.createDataFrame([(c, o.parents.get(c), c in abstract) for c in defined], "class_name string, parent_name string, is_abstract boolean")
    made[o.view("ont_relation")] = spark.createDataFrame([(r, a, b) for r, (a, b) in o.relations.items()], "rel_name string, domain_class string, range_class string")
    made[o.view("ont_property")] = spark.createDataFrame([(c, p, t) for c, (_, fields) in o.classes.items() for p, t in fields.items()], "class_name string, property_name string, data_type string")
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)


def _item(entity: str, name: str, expr: str, said: str | None = None) -> Item:
    return Item(name, entity, expr, extras=Extras(comment=said))


def _query(name: str, question: str, sql: str) -> dict:
    return {"name": name, "question": question, "sql": sql, "verified_by": "generated"}


def entity_model(o: Ontology) -> SemanticView:
    """A table for each class with its properties, one for each relation that leads from its domain to its range."""
    name = o.view("kg_model")
    v = SemanticView(name, [], extras=Extras(comment=f"Entities of {o.name} by class, and what links them: for questions about certain entities"))
    for c, (_, fields) in o.classes.items():
        low = c.lower()
        v.tables.append(Table(low, o.view("v", c), ["node_id"]))
        v.dimensions += [_item(low, f"{low}_id", "node_id", f"Identifier of a {c}"), _item(low, f"{low}_name", "name", f"Name of a {c}")]
        v.metrics.append(_item(low, f"{low}_count", "COUNT(node_id)", f"How many {c}"))
        for p, t in fields.items():
            if t.split("(")[0] in NUMBERS:
                v.facts.append(_item(low, f"{low}_{p.lower()}", p))
                v.metrics += [_item(low, f"{low}_{p.lower()}_{f.lower()}", f"{f}({p})") for f in ("SUM", "AVG", "MAX")]
            else:
                v.dimensions.append(_item(low, f"{low}_{p.lower()}", p, f"{p} of a {c}"))
        v.verified_queries.append(_query(f"{low}_count", f"How many {c} are there?", f"SELECT * FROM SEMANTIC_VIEW({name} METRICS {low}_count)"))
    for r, (a, b) in o.relations.items():
        low, source, target = r.lower(), a.lower(), b.lower()
        if target == source:  # the range has a role of its own
            target = f"{source}_{low}_target"
            v.tables.append(Table(target, o.view("v", b), ["node_id"]))
            v.dimensions.append(_item(target, f"{target}_name", "name"))
        v.tables.append(Table(low, o.view("rel", r)))
        v.relationships += [Relationship(f"{low}_from", low, ["src_id"], source, ["node_id"]), Relationship(f"{low}_to", low, ["dst_id"], target, ["node_id"])]
        v.metrics += [_item(low, f"{low}_links", "COUNT(src_id)"), _item(low, f"{low}_weight", "SUM(weight)")]
        v.verified_queries.append(_query(f"{low}_by_target", f"Which {b} has the most {a} by {r}?", f"SELECT {target}_name, {low}_links FROM SEMANTIC_VIEW({name} DIMENSIONS {target}.{target}_name METRICS {low}_links) ORDER BY {low}_links DESC, {target}_name"))
        v.verified_queries.append(_query(f"{low}_pairs", f"Which {a} are linked to which {b} by {r}?", f"SELECT {source}_name, {target}_name, {low}_links FROM SEMANTIC_VIEW({name} DIMENSIONS {source}.{source}_name, {target}.{target}_name METRICS {low}_links)"))
    return v


def link_model(o: Ontology) -> SemanticView:
    """All entities of all types, and all links between types."""
    name = o.view("ontology_model")
    v = SemanticView(name, [Table("entities", o.view("all_entities"), ["entity_id"]), Table("links", o.view("rel_resolved"))], extras=Extras(comment=f"Entities and links of {o.name} across types"))
    v.dimensions += [_item("entities", c, c) for c in ("entity_id", "entity_type", "entity_name")] + [_item("links", c, c) for c in ("rel_name", "src_id", "src_name", "src_type", "dst_id", "dst_name", "dst_type")]
    v.metrics += [_item("entities", "entity_count", "COUNT(entity_id)"), _item("links", "link_count", "COUNT(src_id)"), _item("links", "link_weight", "SUM(weight)")]
    v.verified_queries += [
        _query("entity_type_counts", "How many entities of each type exist?", f"SELECT entity_type, entity_count FROM SEMANTIC_VIEW({name} DIMENSIONS entity_type METRICS entity_count) ORDER BY entity_count DESC, entity_type"),
        _query("cross_type_relationships", "What relationships connect different entity types?", f"SELECT src_type, rel_name, dst_type, link_count FROM SEMANTIC_VIEW({name} DIMENSIONS src_type, rel_name, dst_type METRICS link_count) ORDER BY link_count DESC"),
    ]
    return v


def metadata_model(o: Ontology) -> SemanticView:
    """The ontology's classes, relations and properties."""
    name = o.view("metadata_model")
    v = SemanticView(name, [Table("classes", o.view("ont_class"), ["class_name"]), Table("relations", o.view("ont_relation"), ["rel_name"]), Table("properties", o.view("ont_property"), ["class_name", "property_name"])], extras=Extras(comment=f"What {o.name} defines"))
    v.relationships += [Relationship("of_class", "properties", ["class_name"], "classes", ["class_name"])]
    v.dimensions += [_item("classes", "class", "class_name"), _item("classes", "parent", "parent_name"), _item("classes", "is_abstract", "is_abstract"), _item("relations", "relation", "rel_name"), _item("relations", "domain_class", "domain_class"), _item("relations", "range_class", "range_class"), _item("properties", "property", "property_name"), _item("properties", "data_type", "data_type")]
    v.metrics += [_item("classes", "class_count", "COUNT(class_name)"), _item("relations", "relation_count", "COUNT(rel_name)"), _item("properties", "property_count", "COUNT(property_name)")]
    v.verified_queries += [
        _query("abstract_classes", "How many classes are abstract?", f"SELECT is_abstract, class_count FROM SEMANTIC_VIEW({name} DIMENSIONS is_abstract METRICS class_count)"),
        _query("properties_by_class", "How many properties does each class have?", f"SELECT class, property_count FROM SEMANTIC_VIEW({name} DIMENSIONS class METRICS property_count)"),
        _query("relations_defined", "Which relations are defined?", f"SELECT relation, domain_class, range_class FROM SEMANTIC_VIEW({name} DIMENSIONS relation, domain_class, range_class)"),
    ]
    return v


def deploy_models(engine: Engine, o: Ontology, nodes: DataFrame, edges: DataFrame) -> list[str]:
    """Create the views and deploy the three models from their YAML; their names."""
    create_views(engine.spark, o, nodes, edges)
    models = [entity_model(o), link_model(o), metadata_model(o)]
    return [engine.deploy_yaml(yaml_io.to_yaml(m)).name for m in models]
