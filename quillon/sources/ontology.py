"""Ontologies: from triples, from JSON, and inferred from a schema's tables, keys and references; what of them data covers.

Classes are rows (class_id, label, parent, is_abstract), relations rows (name,
domain_class, range_class, cardinality). Inference is joins and groupings over
catalog tables, so a schema of any size is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.model.schema import SemanticView
from quillon.operators.lineage import cut

# Vocabularies that triples are told by.
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
CLASSES, PROPERTIES = [OWL + "Class", RDFS + "Class"], [OWL + "ObjectProperty", OWL + "DatatypeProperty"]
TRIPLE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
# Prefixes that table names lose, columns that name a row, endings of keys.
PREFIX = r"(?i)^(tbl_|t_|dim_|fact_|stg_|raw_)"
NAMING = r"(?i)^(.*_)?(name|label|title|display_name|full_name)$"
KEY = r"(?i)^(.+)_(id|key|code)$"


def local_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^#/]+)$", 1)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of N-Triples files; o is a name or a literal's text. Lines that are no triple are left out."""
    line = spark.read.text(path)
    part = lambda k: F.regexp_extract("value", TRIPLE, k)
    return line.where(F.col("value").rlike(TRIPLE)).select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("o"))


def classes_of(triples: DataFrame) -> DataFrame:
    """class_id, label, parent, is_abstract: one row for each class and parent. A class is abstract that has classes below and no instances."""
    own = triples.where((F.col("p") == TYPE) & F.col("o").isin(CLASSES)).select("s").distinct()
    label = triples.where(F.col("p") == RDFS + "label").groupBy("s").agg(F.min("o").alias("label"))
    parent = triples.where(F.col("p") == RDFS + "subClassOf").select("s", F.col("o").alias("parent")).distinct()
    above = parent.join(own, "s", "left_semi").select(F.col("parent").alias("s"), F.lit(True).alias("above")).distinct()
    held = triples.where(F.col("p") == TYPE).select(F.col("o").alias("s"), F.lit(True).alias("held")).distinct()
    met = own.join(label, "s", "left").join(parent, "s", "left").join(above, "s", "left").join(held, "s", "left")
    abstract = F.coalesce("above", F.lit(False)) & F.col("held").isNull()
    return met.select(local_name(F.col("s")).alias("class_id"), F.coalesce("label", local_name(F.col("s"))).alias("label"), local_name(F.col("parent")).alias("parent"), abstract.alias("is_abstract"))


def relations_of(triples: DataFrame) -> DataFrame:
    """name, domain_class, range_class, is_functional, is_transitive of each property."""
    own = triples.where((F.col("p") == TYPE) & F.col("o").isin(PROPERTIES)).select("s").distinct()
    side = lambda what: triples.where(F.col("p") == RDFS + what).groupBy("s").agg(F.min("o").alias(what))
    kind = lambda what: triples.where((F.col("p") == TYPE) & (F.col("o") == OWL + what)).select("s", F.lit(True).alias(what)).distinct()
    met = own
    for table in (side("domain"), side("range"), kind("FunctionalProperty"), kind("TransitiveProperty")):
        met = met.join(table, "s", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return met.select(local_name(F.col("s")).alias("name"), local_name(F.col("domain")).alias("domain_class"), local_name(F.col("range")).alias("range_class"), flag("FunctionalProperty").alias("is_functional"), flag("TransitiveProperty").alias("is_transitive"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes, relations) of JSON documents {classes: [{name, label, parents, is_abstract}], relations: [{name, domain_class, range_class}]}."""
    d = spark.read.option("multiLine", True).schema("classes array<struct<name:string,label:string,parents:array<string>,is_abstract:boolean>>, relations array<struct<name:string,domain_class:string,range_class:string,cardinality:string>>").json(path)
    c = d.select(F.explode("classes").alias("c")).select(F.col("c.name").alias("class_id"), F.coalesce("c.label", "c.name").alias("label"), F.explode_outer("c.parents").alias("parent"), F.coalesce("c.is_abstract", F.lit(False)).alias("is_abstract"))
    return c, d.select(F.explode("relations").alias("r")).select("r.*")


def class_name(table: Column) -> Column:
    """ORDER_ITEMS -> OrderItem: the prefix goes, words lose a plural s and get a capital."""
    words = F.split(F.lower(F.regexp_replace(table, PREFIX, "")), "_")
    one = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(words, lambda w: F.initcap(one(w))), "")


def classify(columns: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """table_name, kind (relationship, lookup or entity), class_name.

    columns, keys: table_name, column_name; links: table_name, column_name,
    ref_table, ref_column. A table with two key columns or more, two references
    or more and at most three other columns is a relationship; one of at most
    five columns with a single key and a naming column is a lookup.
    """
    low = lambda df: df.withColumn("column_name", F.lower("column_name"))
    key = low(keys).select("table_name", "column_name", F.lit(1).alias("k")).distinct()
    link = low(links).select("table_name", "column_name", F.lit(1).alias("f")).distinct()
    met = low(columns).join(key, ["table_name", "column_name"], "left").join(link, ["table_name", "column_name"], "left")
    n = met.groupBy("table_name").agg(F.count("*").alias("n"), F.count("k").alias("keys"), F.count("f").alias("refs"), F.count_if(F.col("k").isNull() & F.col("f").isNull()).alias("rest"), F.max(F.col("column_name").rlike(NAMING)).alias("named"))
    kind = F.when((F.col("keys") >= 2) & (F.col("refs") >= 2) & (F.col("rest") <= 3), "relationship").when((F.col("n") <= 5) & (F.col("keys") == 1) & F.col("named"), "lookup").otherwise("entity")
    return n.select("table_name", kind.alias("kind"), class_name(F.col("table_name")).alias("class_name"))


def infer_relations(kinds: DataFrame, links: DataFrame) -> DataFrame:
    """name, domain_class, range_class, cardinality, source_table: a reference is N:1, a relationship table joins its first two references N:N where both are to classes."""
    last = F.element_at(F.split("ref_table", r"\."), -1)
    ends = kinds.select(F.col("table_name").alias("_ref"), F.col("class_name").alias("range_class"), F.col("kind").alias("_kind"))
    every = links.withColumn("_ref", last).join(kinds, "table_name").join(ends, "_ref", "left")
    met = every.where("_kind <> 'relationship'")
    stem = F.regexp_extract("column_name", KEY, 1)
    named = F.when(stem != "", F.regexp_replace(F.lower(F.concat(F.lit("has_"), stem)), "__", "_")).otherwise(F.lower(F.concat(F.lit("belongs_to_"), "range_class")))
    single = met.where("kind <> 'relationship'").select(named.alias("name"), F.col("class_name").alias("domain_class"), "range_class", F.lit("N:1").alias("cardinality"), F.col("table_name").alias("source_table"))
    side = F.when(F.col("_kind") != "relationship", F.col("range_class")).alias("range_class")
    both = every.where("kind = 'relationship'").groupBy("table_name", "class_name").agg(F.sort_array(F.collect_list(F.struct("position", side))).alias("sides")).where(F.size("sides") >= 2)
    both = both.where(F.col("sides")[0]["range_class"].isNotNull() & F.col("sides")[1]["range_class"].isNotNull())
    many = both.select(F.lower("class_name").alias("name"), F.col("sides")[0]["range_class"].alias("domain_class"), F.col("sides")[1]["range_class"].alias("range_class"), F.lit("N:N").alias("cardinality"), F.col("table_name").alias("source_table"))
    return single.unionByName(many)


def declared(spark: SparkSession, view: SemanticView, columns: dict[str, list[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, keys, links) of the base tables that a semantic view names, by its own keys and relationships, for classify and infer_relations."""
    of = {t.alias.lower(): t.source.split(".")[-1] for t in view.tables if not t.source.startswith("(")}
    named = sorted({(of[a], c) for a, cs in columns.items() if a.lower() in of for c in cs})
    keys = sorted({(of[t.alias.lower()], c) for t in view.tables if t.alias.lower() in of for c in t.primary_key})
    links = sorted({(of[r.left.lower()], a, of[r.right.lower()], b) for r in view.relationships if {r.left.lower(), r.right.lower()} <= set(of) for a, b in zip(r.left_keys, r.right_keys)})
    pairs = "table_name string, column_name string"
    numbered = [(*x, k) for k, x in enumerate(links)]
    return spark.createDataFrame(named, pairs), spark.createDataFrame(keys, pairs), spark.createDataFrame(numbered, f"{pairs}, ref_table string, ref_column string, position int")


def depth(classes: DataFrame, levels: int = 20) -> DataFrame:
    """class_id, depth: least steps from a class without a parent; classes that only a cycle reaches are left out."""
    out = cut(classes.where("parent is null").select("class_id").distinct()).withColumn("depth", F.lit(0))
    front = out.select("class_id")
    up = classes.where("parent is not null").select("class_id", "parent").distinct()
    for k in range(1, levels + 1):
        front = up.join(front.withColumnRenamed("class_id", "parent"), "parent").select("class_id").distinct()
        front = cut(front.join(out.select("class_id"), "class_id", "left_anti"))
        if front.isEmpty():
            break
        out = out.unionByName(front.withColumn("depth", F.lit(k)))
    return out


def coverage(classes: DataFrame, mapped: DataFrame, levels: int = 20) -> DataFrame:
    """class_id, status: mapped (class_id is in ``mapped``), abstract (by is_abstract, where classes say), covered (an ancestor is mapped), unmapped; the first that fits."""
    own = classes.select("class_id").distinct()
    up = classes.where("parent is not null").select("class_id", "parent").distinct()
    told = mapped.select("class_id").distinct()
    below = front = cut(told)
    for _ in range(levels):
        front = cut(up.join(front.withColumnRenamed("class_id", "parent"), "parent").select("class_id").distinct().join(below, "class_id", "left_anti"))
        if front.isEmpty():
            break
        below = below.unionByName(front)
    abstract = classes.where(F.col("is_abstract") if "is_abstract" in classes.columns else F.lit(False)).select("class_id").distinct()
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    met = own.join(flag(told, "m"), "class_id", "left").join(flag(abstract, "a"), "class_id", "left").join(flag(below.distinct(), "c"), "class_id", "left")
    return met.select("class_id", F.when(F.col("m"), "mapped").when(F.col("a"), "abstract").when(F.col("c"), "covered").otherwise("unmapped").alias("status"))


def class_views(nodes: DataFrame, mapping: DataFrame, prefix: str = "vw_ont_") -> list[str]:
    """A temporary view for each class of ``mapping`` (class_id, node_type) over its node types, and one of all; their names.

    The mapping is a model's: a row for each class and type, which reach the driver.
    """
    by: dict[str, list[str]] = {}
    for r in mapping.select("class_id", "node_type").distinct().orderBy("class_id", "node_type").collect():
        by.setdefault(r["class_id"], []).append(r["node_type"])
    made = []
    for name, types in by.items():
        nodes.where(F.col("node_type").isin(types)).withColumn("class_id", F.lit(name)).createOrReplaceTempView(made_name := f"{prefix}{name.lower()}")
        made.append(made_name)
    met = nodes.join(F.broadcast(mapping.select("class_id", "node_type").distinct()), "node_type") if by else nodes.withColumn("class_id", F.lit(None).cast("string")).limit(0)
    met.select(*nodes.columns, "class_id").createOrReplaceTempView(f"{prefix}all_entities")
    return [*made, f"{prefix}all_entities"]
