"""Registered queries: each operator over the whole of its table, with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from . import paths, rows, sources
from .functions import (
    convert_date_format, datetime_to_milliseconds, datetime_to_redshift, list_to_dict, milliseconds_epoch_to_datetime, package, string_to_datetime, string_to_redshift, template, to_bool, unpackage,
)
from .plans import graph, mtl, tree
from .plans.pipeline import Pipeline, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """A document for each order, as a struct: {order: {okey, status, items: [{line, qty, part}]}}."""
    items = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part"))).alias("items"))
    own = _t(spark, d, "orders").hint("shuffle_hash").join(items, F.col("o_orderkey") == F.col("l_orderkey"))  # a sort would hold all items of a task
    return own.select(F.struct(F.struct(F.col("o_orderkey").alias("okey"), F.col("o_orderstatus").alias("status"), "items").alias("order")).alias("doc"))


_TWO = tree.go_down(tree.HasKey("okey"), "o").then(tree.go_down(tree.HasKey("qty"), "b"))
_TWO_OUT = {"okey": ("o", ("okey",)), "line": ("b", ("line",)), "qty": ("b", ("qty",))}
_JOIN = "SELECT o_orderkey AS okey, l_linenumber AS line, l_quantity AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(_JOIN)
def tree_two_step(spark, d):
    return tree.Relation("items", _TWO, _TWO_OUT).to_df(_orders(spark, d), "doc")


@query(_JOIN)
def tree_two_step_json(spark, d):
    docs = _orders(spark, d).select(F.to_json("doc").alias("doc"))
    return tree.Relation("items", _TWO, _TWO_OUT, {"okey": "bigint", "line": "int", "qty": "double"}).to_df(docs, "doc")


@query("SELECT o_orderkey AS okey, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NOT NULL")
def tree_go_up(spark, d):
    chain = tree.go_down(tree.HasKey("qty"), "b").then(tree.go_up(tree.HasKey("okey"), "o"))
    return tree.Relation("up", chain, {"okey": ("o", ("okey",)), "part": ("b", ("part",))}).to_df(_orders(spark, d), "doc")


_MIXED = """CASE event_type WHEN 'click' THEN '{"click": {"v": 1}, "k": 1}' WHEN 'view' THEN '{"view": {"v": 2}}' WHEN 'error' THEN '{"k": {"v": 3}}' ELSE '{"other": [{"v": 4}, {"w": null}]}' END AS doc"""


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def tree_bool_conditions(spark, d):
    docs = _t(spark, d, "events").selectExpr("event_id", "event_type", _MIXED)
    cond = tree.HasKey("k") & (tree.HasKey("click") | tree.HasKey("view")) & ~tree.HasKey("other")
    return tree.Relation("both", tree.stay_here("n", cond), {"x": ("n", ("k",))}).to_df(docs, "doc", ["event_id", "event_type"]).drop("x")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 4 END::BIGINT AS v FROM events")
def tree_descendants(spark, d):
    docs = _t(spark, d, "events").selectExpr("event_id", _MIXED)
    cond = tree.HasKey("v") & tree.HasAncestor(tree.HasDescendant(tree.HasKey("v"))) & ~tree.IsList() & ~tree.IsRoot()
    return tree.Relation("values", tree.go_down(cond, "n"), {"v": ("n", ("v",))}, {"v": "bigint"}).to_df(docs, "doc", ["event_id"])


@query("SELECT o_orderkey AS okey, l_quantity AS qty, o_orderstatus AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def mtl_select(spark, d):
    q = mtl.TreeQuery("QUERY items IS SELECT o.okey AS okey, b.qty AS qty, identity(o.status) AS status FROM obj START AT HAS KEY okey AS o GO DOWN UNTIL (HAS KEY qty AND NOT HAS KEY items) AS b;")
    return q.to_df(_orders(spark, d), "doc")


_MODEL = """
QUERY placed IS SELECT o.okey AS okey, o.status AS status, b.part AS part FROM obj START AT HAS KEY okey AS o GO DOWN UNTIL HAS KEY qty AS b;
IN QUERY placed okey IS A UNIQUE PROPERTY okey OF ENTITY sale;
IN QUERY placed part IS A UNIQUE PROPERTY pkey OF ENTITY part;
IN QUERY placed status IS A PROPERTY status OF ENTITY sale NAMED BY okey;
IN QUERY placed sale NAMED BY okey IS RELATED TO part NAMED BY part AS holds;
"""


@query("SELECT DISTINCT 'sale' AS source_type, CAST(o_orderkey AS VARCHAR) AS source_value, 'holds' AS relationship_type, 'part' AS target_type, CAST(l_partkey AS VARCHAR) AS target_value FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def mtl_graph_edges(spark, d):
    return mtl.TreeQuery(_MODEL).to_graph(_orders(spark, d), "doc").edges.select("source_type", "source_value", "relationship_type", "target_type", "target_value")


@query("""SELECT DISTINCT 'sale' AS entity_type, CAST(o_orderkey AS VARCHAR) AS key_value, o_orderstatus AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION SELECT DISTINCT 'part', CAST(l_partkey AS VARCHAR), NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def mtl_graph_vertices(spark, d):
    v = mtl.TreeQuery(_MODEL).to_graph(_orders(spark, d), "doc").vertices
    return v.select("entity_type", "key_value", F.try_element_at("properties", F.lit("status")).alias("status"))


_TABLES = {
    "orders": {"data_config": [
        {"name": {"entity_type": "Order", "property_column": "o_orderkey", "property_type": "OrderID"}},
        {"name": {"entity_type": "Customer", "property_column": "o_custkey", "property_type": "CustomerID"}},
        {"property": {"entity_name_column": "o_orderkey", "property_column": "o_orderstatus", "property_type": "Status"}},
        {"relationship": {"relationship_type": "Placed", "source_entity_name_column": "o_custkey", "target_entity_name_column": "o_orderkey"}},
        {"relationship_property": {"relationship_type": "Placed", "relationship_property_column": "o_orderpriority", "relationship_property_type": "Priority", "source_entity_name_column": "o_custkey", "target_entity_name_column": "o_orderkey"}},
    ]},
    "customer": {"data_config": [
        {"name": {"entity_type": "Customer", "property_column": "c_custkey", "property_type": "CustomerID"}},
        {"name": {"entity_type": "Nation", "property_column": "c_nationkey", "property_type": "NationID"}},
        {"property": {"entity_name_column": "c_custkey", "property_column": "c_mktsegment", "property_type": "Segment"}},
        {"relationship": {"relationship_type": "LivesIn", "source_entity_name_column": "c_custkey", "target_entity_name_column": "c_nationkey"}},
    ]},
}


def _graph(spark: SparkSession, d: str) -> graph.Graph:
    return graph.TableModel.from_config(_TABLES).to_graph({n: _t(spark, d, n) for n in _TABLES})


@query("""SELECT 'Order' AS entity_type, CAST(o_orderkey AS VARCHAR) AS key_value, o_orderstatus AS status, NULL AS segment FROM orders
UNION SELECT 'Nation', CAST(c_nationkey AS VARCHAR), NULL, NULL FROM customer
UNION SELECT 'Customer', CAST(k AS VARCHAR), NULL, max(s) FROM (SELECT o_custkey AS k, NULL AS s FROM orders UNION SELECT c_custkey, c_mktsegment FROM customer) GROUP BY k""")
def graph_vertices(spark, d):
    return _graph(spark, d).vertices.select("entity_type", "key_value", F.try_element_at("properties", F.lit("Status")).alias("status"), F.try_element_at("properties", F.lit("Segment")).alias("segment"))


@query("""SELECT 'Placed' AS relationship_type, CAST(o_custkey AS VARCHAR) AS source_value, CAST(o_orderkey AS VARCHAR) AS target_value, o_orderpriority AS priority FROM orders
UNION SELECT 'LivesIn', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), NULL FROM customer""")
def graph_edges(spark, d):
    return _graph(spark, d).edges.select("relationship_type", "source_value", "target_value", F.try_element_at("properties", F.lit("Priority")).alias("priority"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"Order\", CAST(c_custkey AS VARCHAR) AS \"Customer\", CAST(c_nationkey AS VARCHAR) AS \"Nation\" FROM orders JOIN customer ON o_custkey = c_custkey")
def master_match(spark, d):
    model = graph.TableModel.from_config(_TABLES)
    return graph.master_table(_graph(spark, d), graph.extrapolated(model)).select("Order", "Customer", "Nation")


@query("SELECT CAST(ps AS VARCHAR) AS part, CAST(ss AS VARCHAR) AS supplier, count(*)::BIGINT AS ends FROM (SELECT DISTINCT l_partkey AS ps, l_suppkey AS ss FROM lineitem) t, range(2) GROUP BY 1, 2")
def graph_compound(spark, d):
    config = {"lineitem": {"data_config": [{"compound_name": {"entity_type": "Offer", "components": [
        {"type": "P", "column_name": "l_partkey", "entity_type": "Part", "entity_name_property": "PartID"}, {"type": "S", "column_name": "l_suppkey", "entity_type": "Supplier", "entity_name_property": "SupplierID"}]}}]}}
    e = graph.TableModel.from_config(config).to_graph({"lineitem": _t(spark, d, "lineitem")}).edges
    end = lambda t: F.max(F.when(F.col("source_type") == t, F.col("source_value")))
    return e.groupBy("target_value").agg(end("Part").alias("part"), end("Supplier").alias("supplier"), F.count(F.lit(1)).alias("ends")).drop("target_value")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def filter_key_exists(spark, d):
    df = _t(spark, d, "events").withColumn("props", F.parse_json("props"))
    return ops.filter_rows(df, "key_exists", "props.k").select("event_id")


@query("SELECT event_id FROM events WHERE NOT json_exists(props, '$.absent')")
def filter_key_absent(spark, d):
    df = _t(spark, d, "events").withColumn("props", F.parse_json("props"))
    return ops.filter_rows(df, "key_exists", "props.absent", False).select("event_id")


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
def filter_not_none(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return ops.filter_rows(joined.withColumn("o", F.struct("o_orderkey")), "value_is_not_none", "o.o_orderkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE lower(substr(CASE WHEN o_orderstatus = 'O' THEN 'Yes' WHEN o_orderstatus = 'F' THEN 'true' ELSE 'no' END, 1, 1)) IN ('t', 'y')")
def filter_true(spark, d):
    flagged = _t(spark, d, "orders").withColumn("flag", F.expr("CASE WHEN o_orderstatus = 'O' THEN 'Yes' WHEN o_orderstatus = 'F' THEN 'true' ELSE 'no' END"))
    return ops.filter_rows(flagged, "value_is_true", "flag").select("o_orderkey")


@query()
def random_sample(spark, d):
    return ops.random_sample(_t(spark, d, "lineitem"), 0.1, 7)


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) BETWEEN 10 AND 60")
def json_validator(spark, d):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}
    return ops.json_valid(_t(spark, d, "events"), "props", schema).select("event_id")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def suppress_nulls(spark, d):
    return ops.drop_nulls(_t(spark, d, "events"), "props").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT DISTINCT event_type, user_id FROM events WHERE event_type IN ('click', 'error')")
def search_distinct(spark, d):
    return ops.meets_condition(_t(spark, d, "events").select("event_type", "user_id"), F.col("event_type").isin("click", "error"))


@query("SELECT n_nationkey AS id, n_name AS name, r_name AS region_name, n_regionkey AS region_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def remap_nested(spark, d):
    both = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    out = ops.remapper(both, {"id": "n_nationkey", "name": "n_name", "region": {"name": "r_name", "key": "n_regionkey"}}, retain_input=False)
    return out.select("id", "name", paths.get(out, "region.name").alias("region_name"), paths.get(out, "region.key").alias("region_key"))


@query("SELECT c_custkey, 'x' AS tag, 'fixed' AS c_mktsegment, c_name FROM customer")
def insert_data(spark, d):
    return ops.insert_data(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"tag": "x", "c_mktsegment": "fixed"})


@query("SELECT p_partkey, regexp_replace(p_name, '^(\\w+) (\\w+)$', '\\2, \\1') AS p_name FROM part")
def substitute_regex(spark, d):
    return ops.substitute_regex(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", r"^(\w+) (\w+)$", r"\2, \1")


@query("SELECT o_orderkey AS okey, upper(o_orderstatus) AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INTEGER AS n, (SELECT sum(9) FROM lineitem WHERE l_orderkey = o_orderkey)::BIGINT AS qty FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def simple_transforms(spark, d):
    out = ops.simple_transforms(_orders(spark, d), [{"path": "qty", "target_value": 9}, {"path": "order.status", "target_function": "upper"}, {"path": "part", "target_value": None, "starting_path": "doc.order"}])
    return out.select(F.col("doc.order.okey").alias("okey"), F.col("doc.order.status").alias("status"), F.size("doc.order.items").alias("n"), F.aggregate("doc.order.items.qty", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("qty"))


@query("SELECT c_custkey, upper(c_mktsegment) AS value FROM customer")
def function_of_message(spark, d):
    return ops.function_of_message(_t(spark, d, "customer"), "upper", "c_mktsegment").select("c_custkey", "value")


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def serializer_explode(spark, d):
    return ops.serializer(_t(spark, d, "embeddings"), "embedding", output_key="x").select("vec_id", "x")


@query("SELECT o_orderkey AS okey, count(*)::INTEGER AS n, sum(l_partkey)::BIGINT AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def aggregate_tail_values(spark, d):
    out = ops.aggregate_values(_orders(spark, d), "items.part", "parts")
    return out.select(F.col("doc.order.okey").alias("okey"), F.size("parts").alias("n"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("parts"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch, event_id FROM events")
def batch_messages(spark, d):
    out = ops.batch_messages(_t(spark, d, "events").select("event_id", "user_id"), 100, ["event_id"], "rows")
    return out.select("batch", F.explode("rows").alias("r")).select("batch", F.col("r.event_id").alias("event_id"))


@query("""SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS n_distinct, count(DISTINCT l_returnflag) = count(*) AS is_unique, count(l_returnflag) < count(*) AS has_null FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), count(DISTINCT l_partkey) = count(*), count(l_partkey) < count(*) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), count(DISTINCT l_shipdate) = count(*), count(l_shipdate) < count(*) FROM lineitem
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(DISTINCT l_linenumber) = count(*), count(l_linenumber) < count(*) FROM lineitem""")
def row_stats(spark, d):
    return ops.row_stats(_t(spark, d, "lineitem"), ["l_returnflag", "l_partkey", "l_shipdate", "l_linenumber"])


@query()
def row_stats_approximate(spark, d):
    return ops.row_stats(_t(spark, d, "lineitem"), approximate=True)


@query("SELECT max(o_orderdate) AS value FROM orders")
def find_max(spark, d):
    return ops.find_value(_t(spark, d, "orders"), "o_orderdate")


@query("SELECT min(o_totalprice) AS value FROM orders")
def find_min(spark, d):
    return ops.find_value(_t(spark, d, "orders"), "o_totalprice", "min")


@query("SELECT r_regionkey, r_name, v AS item FROM region, (VALUES (1), (2), (3)) t(v)")
def sequence_cross(spark, d):
    return sources.sequence_cross(_t(spark, d, "region"), [{"value": "1", "type": "int"}, 2, 3], output_key="item").withColumn("item", F.col("item").cast("int"))


@query("SELECT v AS item FROM (VALUES ('a'), ('b'), ('a'), ('b')) t(v)")
def sequence_emitter(spark, d):
    return sources.sequence_emitter(spark, ["a", "b"], 2, "item")


@query("SELECT 'bar' AS foo FROM range(5)")
def constant_emitter(spark, d):
    return sources.constant_emitter(spark, {"foo": "bar"})


@query("SELECT i::BIGINT AS n FROM range(1, 11) t(i)")
def counter(spark, d):
    return sources.counter(spark, 1, 10, "n")


@query("SELECT 'unset' AS state, n_name FROM nation")
def environment(spark, d):
    return sources.environment_variables(spark, mappings={"FLOWTREE_SURELY_UNSET": "state"}, df=_t(spark, d, "nation")).select(F.coalesce("state", F.lit("unset")).alias("state"), "n_name")


@query("SELECT event_id, NULL AS o_orderkey FROM events WHERE event_type = 'click' UNION ALL BY NAME SELECT NULL AS event_id, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def union_fan_in(spark, d):
    return rows.fan_in([_t(spark, d, "events").where("event_type = 'click'").select("event_id"), _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")])


@query("SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1800 SECONDS AND a.ts + INTERVAL 1800 SECONDS WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def interval_join(spark, d):
    e = _t(spark, d, "events")
    out = ops.stream_join({"view": (e.where("event_type = 'view'"), "user_id"), "purchase": (e.where("event_type = 'purchase'"), "user_id")}, 1800)
    return out.select(F.col("view.event_id").alias("view_id"), F.col("purchase.event_id").alias("purchase_id"))


@query("""SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 18 HOURS, time_bucket(INTERVAL 6 HOURS, ts), INTERVAL 6 HOURS)) AS w FROM events) GROUP BY 1, 2""")
def sliding_window(spark, d):
    out = ops.time_window(_t(spark, d, "events"), 86400, 21600, by=["event_type"], aggregates={"n": F.count(F.lit(1))})
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id, strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%b %d,%Y  %H:%M:%S') AS loader, epoch_us(ts) // 1000 AS ms, date_trunc('second', ts) AS parsed, date_trunc('second', ts) AS loaded, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS back FROM events")
def date_functions(spark, d):
    e = _t(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ms = datetime_to_milliseconds(F.col("ts"))
    return e.select("event_id", convert_date_format(text, "%Y-%m-%d %H:%M:%S", "%d/%m/%Y").alias("day"), datetime_to_redshift(F.col("ts")).alias("loader"), ms.alias("ms"), string_to_datetime(text).alias("parsed"), string_to_redshift(datetime_to_redshift(F.col("ts"))).alias("loaded"), milliseconds_epoch_to_datetime(ms).alias("back"))


@query("SELECT event_id, lower(substr(event_type, 1, 1)) IN ('t', 'y') AS t, value > 0 AS positive FROM events")
def to_bool_query(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", to_bool(F.col("event_type")).alias("t"), to_bool(F.col("value"), e.schema["value"].dataType).alias("positive"))


@query("SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' {other}' AS line FROM events")
def template_fill(spark, d):
    return _t(spark, d, "events").select("event_id", template("user {user_id} did {event_type} {other}", {"user_id": F.col("user_id"), "event_type": F.col("event_type")}).alias("line"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def list_to_dict_query(spark, d):
    m = list_to_dict(F.array("c_name", "c_mktsegment"), F.array(F.lit("name"), F.lit("segment")))
    return _t(spark, d, "customer").withColumn("m", m).select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"))


@query("SELECT c_custkey, c_name FROM customer")
def package_round_trip(spark, d):
    return _t(spark, d, "customer").select("c_custkey", unpackage(package(F.col("c_name")), "string").alias("c_name"))


@query("SELECT event_id, 'k' AS path, props->>'$.k' AS value FROM events")
def flatten_paths(spark, d):
    out = tree.leaves(_t(spark, d, "events").select("event_id", "props"), "props")
    return out.select("event_id", F.array_join("path", ".").alias("path"), "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def sql_rows(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("orders_of_sql_rows")
    return sources.sql.sql_rows(spark, "SELECT o_orderkey, o_custkey FROM orders_of_sql_rows WHERE o_totalprice > {least} AND o_orderstatus = '{status}'", {"least": 100000, "status": "O"})


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def sql_to_csv(spark, d):
    _t(spark, d, "region").createOrReplaceTempView("region_of_sql_to_csv")
    return sources.sql_to_csv(spark, "SELECT * FROM region_of_sql_to_csv")


@query("SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS column_type FROM (DESCRIBE orders)")
def schema_probe(spark, d):
    return sources.column_types(_t(spark, d, "orders"))


@query("SELECT event_id, user_id, upper(event_type) AS event_type, 'pipeline' AS origin FROM events WHERE value IS NOT NULL")
def yaml_pipeline(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events_of_yaml_pipeline")
    p = load({
        "nodes": {
            "read": {"class": "StreamTable", "options": {"table": "events_of_yaml_pipeline"}},
            "some": {"class": "Filter", "options": {"test": "value_is_not_none", "test_keypath": "value"}},
            "loud": {"class": "SimpleTransforms", "options": {"transform_mapping": [{"path": "event_type", "target_function": "upper"}]}},
            "mark": {"class": "InsertData", "options": {"value_dict": {"origin": "pipeline"}}},
            "take": {"class": "Remapper", "options": {"mapping": {c: c for c in ("event_id", "user_id", "event_type", "origin")}, "retain_input": False}},
        },
        "paths": [["read", "some", "loud", "mark", "take"]],
    })
    return p.plan(spark)["take"]


@query("SELECT n_nationkey, n_name, 'b' AS branch FROM nation UNION ALL SELECT n_nationkey, n_name, 'a' FROM nation")
def fan_out_in(spark, d):
    _t(spark, d, "nation").createOrReplaceTempView("nation_of_fan_out")
    p = Pipeline().add("StreamTable", "read", table="nation_of_fan_out").then("InsertData", "a", value_dict={"branch": "a"}).then("MockNode", "all")
    p.after("read").then("InsertData", "b", value_dict={"branch": "b"}).connect("b", "all")
    return p.plan(spark)["all"].select("n_nationkey", "n_name", "branch")
