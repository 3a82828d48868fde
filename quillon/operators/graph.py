"""Property-graph operators: traversal, inference, checks, analytics, typed views.

Tables: nodes (node_id, node_type, name, props JSON), edges (src_id, dst_id,
edge_type, weight, props, effective_start, effective_end); in a hierarchy src is
the child. Traversals advance a frontier by one join a level, at most a fixed
number of levels, so a cycle ends them; only level counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lineage import cut
from quillon.sources import tables

MAX_DESCENDANTS, MAX_ANCESTORS, MAX_PATH, MAX_TRANSITIVE = 15, 20, 20, 5


def current(edges: DataFrame, today: Column | None = None) -> DataFrame:
    """Edges without an end, or with one not before today."""
    ends = F.col("effective_end")
    return edges.where(ends.isNull() | (ends >= today) if today is not None else ends.isNull())


def _walk(start: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """start (id, depth, path) and everything reached over links (at, to), once for each path up to ``levels``."""
    out, front = start, start
    for depth in range(1, levels + 1):
        met = front.join(links, front["id"] == links["at"]).where(~F.array_contains("path", F.col("to")))
        front = met.select(F.col("to").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("to")).alias("path"))
        front = cut(front)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def _reach(start: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """id, depth: what links (at, to) reach from start (id), at its least depth from 1 on. Nodes met before are left out, so paths are not listed."""
    front, out = start.select("id"), None
    for depth in range(1, levels + 1):
        new = front.join(links, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct()
        new = cut(new if out is None else new.join(out.select("id"), "id", "left_anti"))
        if new.isEmpty():
            break
        front, level = new, new.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return start.select("id", F.lit(0).alias("depth")).limit(0) if out is None else out


def _roots(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a name, whatever its case; the smallest id of several."""
    found = nodes.where(F.lower("name") == name.lower()).agg(F.min("node_id").alias("id")).where("id is not null")
    return found.select("id", F.lit(0).alias("depth"), F.array("id").alias("path"))


def descendants(nodes: DataFrame, edges: DataFrame, root: str, edge_type: str = "subClassOf") -> DataFrame:
    """node_id, node_name, depth, path of a root (depth 0) and all below it, a row for each way down; a cycle is walked once."""
    links = edges.where(F.col("edge_type") == edge_type).select(F.col("dst_id").alias("at"), F.col("src_id").alias("to")).distinct()
    found = _walk(_roots(nodes, root), links, MAX_DESCENDANTS)
    names = nodes.select("node_id", F.col("name").alias("node_name"))
    steps = found.select("id", "depth", F.col("path").alias("way"), F.posexplode("path").alias("k", "step")).join(names.withColumnRenamed("node_id", "step"), "step")
    steps = steps.groupBy("id", "depth", "way").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "node_name"))), lambda x: x["node_name"]), " -> ").alias("path"))
    return steps.join(names, F.col("id") == F.col("node_id")).select("node_id", "node_name", "depth", "path")


def _up(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type).select(F.col("src_id").alias("at"), F.col("dst_id").alias("to")).distinct()


def ancestors(nodes: DataFrame, edges: DataFrame, child: str, edge_type: str = "subClassOf") -> DataFrame:
    """node_id, node_name, depth of all above a node, at least depth; the node itself only where a cycle leads back."""
    found = _reach(_roots(nodes, child), _up(edges, edge_type), MAX_ANCESTORS)
    return found.join(nodes.select("node_id", F.col("name").alias("node_name")), F.col("id") == F.col("node_id")).select("node_id", "node_name", "depth")


def hierarchy_path(nodes: DataFrame, edges: DataFrame, low: str, high: str, edge_type: str = "subClassOf") -> DataFrame:
    """step, node_id, node_name, relationship: what is on the way up from low (START) until high is met; no rows where it is not.

    Every node at its least step; where ways branch, all that are no further up than high.
    """
    start = _roots(nodes, low)
    found = _reach(start, _up(edges, edge_type), MAX_PATH).withColumnRenamed("depth", "step")
    found = start.select("id", F.lit(0).alias("step")).unionByName(found.join(start.select("id"), "id", "left_anti"))
    end = found.join(_roots(nodes, high).select("id"), "id").agg(F.min("step").alias("last")).where("last is not null")
    kept = found.join(F.broadcast(end), F.col("step") <= F.col("last"))  # one row
    named = kept.join(nodes.select("node_id", F.col("name").alias("node_name")), F.col("id") == F.col("node_id"))
    return named.select("step", "node_id", "node_name", F.when(F.col("step") == 0, "START").otherwise(edge_type).alias("relationship"))


def direct_children(nodes: DataFrame, edges: DataFrame, parent: str, edge_type: str = "subClassOf") -> DataFrame:
    root = _roots(nodes, parent).select(F.col("id").alias("dst_id"))
    kids = edges.where(F.col("edge_type") == edge_type).join(root, "dst_id").select(F.col("src_id").alias("node_id")).distinct()
    return kids.join(nodes, "node_id").select("node_id", F.col("name").alias("node_name"), "node_type")


def transitive(edges: DataFrame, edge_type: str, rule_id: str, levels: int = MAX_TRANSITIVE) -> DataFrame:
    """Inferred edges (src_id, dst_id, edge_type, weight 1 / least depth, rule_id): no loops, none asserted already."""
    own = edges.where(F.col("edge_type") == edge_type).select("src_id", "dst_id").distinct()
    links = own.select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"))
    known, front, new = own, own, None
    for depth in range(2, levels + 1):  # pairs, not paths, and each only once: at its least depth
        met = front.join(links, front["dst_id"] == links["at"]).select("src_id", F.col("to").alias("dst_id")).distinct()
        front = cut(met.join(known, ["src_id", "dst_id"], "left_anti"))
        if front.isEmpty():
            break
        known, level = known.unionByName(front), front.withColumn("depth", F.lit(depth))
        new = level if new is None else new.unionByName(level)
    new = own.withColumn("depth", F.lit(1)).limit(0) if new is None else new.where("src_id <> dst_id")
    return new.select("src_id", "dst_id", F.lit(edge_type).alias("edge_type"), (1.0 / F.col("depth")).alias("weight"), F.lit(rule_id).alias("rule_id"))


def inverse(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges turned round by rules (rule_id, edge_type, inverse_type); weight and validity stay. One plan for all rules."""
    r = rules.select("rule_id", F.col("edge_type").alias("_t"), "inverse_type")
    return edges.join(r, F.col("edge_type") == F.col("_t")).select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.col("inverse_type").alias("edge_type"), "weight", "effective_start", "effective_end", "rule_id")


def run_rules(edges: DataFrame, rules: list[dict]) -> tuple[DataFrame | None, list[dict]]:
    """Inferred edges of all rules, inverses first, and a report line for each rule; a failing rule does not stop the others."""
    out, report = None, []
    order = {"INVERSE": 0, "TRANSITIVE": 1, "PROPERTY_CHAIN": 2}
    for rule in sorted(rules, key=lambda r: order.get(r["kind"], 3)):
        try:
            if rule["kind"] == "TRANSITIVE":
                made = transitive(edges, rule["edge_type"], rule["rule_id"])
            elif rule["kind"] == "INVERSE":
                spark = edges.sparkSession
                made = inverse(edges, spark.createDataFrame([(rule["rule_id"], rule["edge_type"], rule["inverse_type"])], "rule_id string, edge_type string, inverse_type string")).select("src_id", "dst_id", "edge_type", "weight", "rule_id")
            else:
                raise NotImplementedError(f"{rule['kind']} rules are not supported")
            out = made if out is None else out.unionByName(made)
            report.append({"rule_id": rule["rule_id"], "status": "OK"})
        except Exception as e:  # each rule's own failure is its report
            report.append({"rule_id": rule["rule_id"], "status": f"ERROR: {e}"})
    return out, report


def run_rules_into(edges: DataFrame, rules: list[dict], path: str) -> list[dict]:
    """Run rules one by one, each replacing what an earlier run of it left in the table at path (partitions by rule_id); a report line each."""
    report = []
    order = {"INVERSE": 0, "TRANSITIVE": 1, "PROPERTY_CHAIN": 2}
    for rule in sorted(rules, key=lambda r: order.get(r["kind"], 3)):
        made, told = run_rules(edges, [rule])
        if made is not None:
            tables.replace_part(made, path, "rule_id", rule["rule_id"])
        report += told
    return report


def check_cardinality(edges: DataFrame, edge_type: str, check_id: str, today: Column | None = None) -> DataFrame:
    """Sources with more than one current edge of a single-valued type."""
    own = current(edges.where(F.col("edge_type") == edge_type), today)
    return own.groupBy("src_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(check_id).alias("check_id"), "src_id", "n")


def check_referential(nodes: DataFrame, edges: DataFrame, edge_type: str, check_id: str) -> DataFrame:
    """Ends of edges that are no node: check_id, edge ends, missing SRC or DST."""
    own, ids = edges.where(F.col("edge_type") == edge_type).select("src_id", "dst_id"), nodes.select("node_id")
    miss = lambda c, side: own.join(ids, own[c] == ids["node_id"], "left_anti").select(F.lit(check_id).alias("check_id"), "src_id", "dst_id", F.lit(side).alias("missing"))
    return miss("src_id", "SRC").unionByName(miss("dst_id", "DST"))


def resolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the names and types of both ends; missing ends stay null."""
    side = lambda p: nodes.select(F.col("node_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("node_type").alias(f"{p}_type"))
    return edges.join(side("src"), "src_id", "left").join(side("dst"), "dst_id", "left").select("src_id", "src_name", "src_type", "edge_type", "dst_id", "dst_name", "dst_type", "weight")


def hierarchy_stats(nodes: DataFrame, edges: DataFrame, edge_type: str = "subClassOf") -> DataFrame:
    """node_id, name, children, parents: distinct neighbours below and above."""
    own = edges.where(F.col("edge_type") == edge_type)
    below = own.groupBy(F.col("dst_id").alias("node_id")).agg(F.countDistinct("src_id").alias("children"))
    above = own.groupBy(F.col("src_id").alias("node_id")).agg(F.countDistinct("dst_id").alias("parents"))
    out = nodes.select("node_id", "name").join(below, "node_id", "left").join(above, "node_id", "left")
    return out.select("node_id", "name", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("parents", F.lit(0)).alias("parents"))


def load_nodes(df: DataFrame, node_type: str, key: str, name: str) -> DataFrame:
    """Rows of a table as nodes; props is the row as JSON with lower-case keys."""
    props = F.to_json(F.struct(*[F.col(c).alias(c.lower()) for c in df.columns]))
    return df.select(F.concat(F.lit(f"{node_type}:"), F.col(key).cast("string")).alias("node_id"), F.lit(node_type).alias("node_type"), F.col(name).cast("string").alias("name"), props.alias("props"))


def load_edges(df: DataFrame, edge_type: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """A foreign key as edges: src and dst are (node type, column)."""
    end = lambda e: F.concat(F.lit(f"{e[0]}:"), F.col(e[1]).cast("string"))
    made = df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull()).select(end(src).alias("src_id"), end(dst).alias("dst_id"))
    null = F.lit(None).cast("date")
    return made.select(F.sha2(F.concat_ws("|", "src_id", "dst_id", F.lit(edge_type)), 256).alias("edge_id"), "src_id", "dst_id", F.lit(edge_type).alias("edge_type"), F.lit(1.0).alias("weight"), null.alias("effective_start"), null.alias("effective_end"))


def typed_view(nodes: DataFrame, node_type: str, fields: dict[str, str]) -> DataFrame:
    """Nodes of a type with fields of props as columns of their types."""
    own = nodes.where(F.col("node_type") == node_type)
    return own.select("node_id", "name", *[F.get_json_object("props", f"$.{f.lower()}").cast(t).alias(f) for f, t in fields.items()])


def relation_view(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type).select("src_id", "dst_id", "weight", "effective_start", "effective_end")


def all_entities(views: dict[str, DataFrame]) -> DataFrame:
    """class_name, node_id, name of several class views together."""
    parts = [v.select(F.lit(k).alias("class_name"), "node_id", "name") for k, v in views.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def degree(nodes: DataFrame, edges: DataFrame, n: int, node_type: str | None = None) -> DataFrame:
    """Top n by degree centrality over the undirected simple graph of current edges, scores to six places."""
    own = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    ids = own.select("node_id")
    pairs = current(edges).select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).where("a <> b").distinct()
    pairs = pairs.join(ids.withColumnRenamed("node_id", "a"), "a").join(ids.withColumnRenamed("node_id", "b"), "b")
    ends = pairs.select(F.col("a").alias("node_id")).union(pairs.select("b"))
    total = ids.agg(F.count("*").alias("total"))
    count = ends.groupBy("node_id").agg(F.count("*").alias("d"))
    scored = own.select("node_id", "name").join(count, "node_id", "left").crossJoin(F.broadcast(total))  # one row
    score = F.round(F.coalesce("d", F.lit(0)) / F.greatest(F.col("total") - 1, F.lit(1)), 6)
    return scored.select("node_id", "name", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(n)


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str, levels: int = 20) -> DataFrame:
    """step, node_id, node_name of one shortest undirected way; a frontier that forgets where it has been already."""
    pairs = current(edges).select("src_id", "dst_id")
    links = pairs.union(pairs.select("dst_id", "src_id")).distinct().toDF("at", "to")
    goal = _roots(nodes, b).select("id").first()
    front = seen = _roots(nodes, a).select("id", "path")
    found = None
    for _ in range(levels + 1):
        if goal is None or front.isEmpty():
            break
        hit = front.where(F.col("id") == goal["id"]).select("path").first()
        if hit:
            found = hit["path"]
            break
        new = front.join(links, front["id"] == links["at"]).select(F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        new = new.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        new = cut(new)
        seen, front = seen.unionByName(new), new
    rows = list(enumerate(found or []))
    steps = nodes.sparkSession.createDataFrame(rows, "step int, node_id string")
    return steps.join(nodes.select("node_id", F.col("name").alias("node_name")), "node_id").select("step", "node_id", "node_name")


def shared_properties(classes: DataFrame) -> DataFrame:
    """property, n_classes of (class_name, property) rows where two classes or more have it."""
    return classes.groupBy("property").agg(F.countDistinct("class_name").alias("n_classes")).where("n_classes >= 2")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, where there is no QUALIFY."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
