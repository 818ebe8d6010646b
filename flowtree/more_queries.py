"""Registered queries of sinks, files, streams, requests, options and models: each writes or makes what it then reads, over small tables."""

from __future__ import annotations

import http.server
import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators as ops
from . import paths, sinks, sources
from .functions import register, scalar
from .plans import graph, mtl, tree
from .plans import pipeline as pl
from .queries import _t, query
from .session import shared_folder
from .streaming import batch_stream, stop_when, watch_directory
from .types import TypedRow, convert, possible_types, type_from_string


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


def _kept(df: DataFrame) -> DataFrame:
    path = f"{_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pairs(spark: SparkSession, found: dict[str, set[tuple]]) -> DataFrame:
    """(predicate, terms) of what predicates hold for."""
    return spark.createDataFrame([(name, ",".join(str(x) for x in t)) for name, rows in found.items() for t in rows], "predicate string, terms string")


def _values(names: str, *rows: tuple) -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names})"


# files and tables


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_reader(spark, d):
    """Written as CSV, and read by a source node."""
    at = _folder(spark)
    _t(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(at)
    return pl.Pipeline().add("CSVReader", "read", path=at).plan(spark)["read"]


@query("SELECT r_regionkey, CAST(r_regionkey AS VARCHAR) AS k, r_name AS n FROM region")
def csv_of_texts(spark, d):
    """CSV text in a column, as rows."""
    texts = _t(spark, d, "region").select("r_regionkey", F.concat(F.lit("k,n\n"), "r_regionkey", F.lit(',"'), "r_name", F.lit('"\n')).alias("value"))
    return sources.parse_csv(texts, "value", ["k", "n"]).select("r_regionkey", "k", "n")


@query("SELECT r_regionkey, 2::INTEGER AS n, r_name AS name, NULL::VARCHAR AS short FROM region")
def csv_to_dictionary_list(spark, d):
    texts = _t(spark, d, "region").select("r_regionkey", F.concat(F.lit("a,b\n"), "r_name", F.lit(",x\nshort\n")).alias("value"))
    p = pl.Pipeline().add("MockNode", "m").then("CSVToDictionaryList", "l", output_key="records").plan(spark, seed={"m": texts})["l"]
    return p.select("r_regionkey", F.size("records").alias("n"), F.col("records")[0]["a"].alias("name"), F.col("records")[1]["b"].alias("short"))


@query("SELECT c_custkey, TRY_CAST(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END, '') AS BIGINT) AS nation FROM customer")
def typed_csv(spark, d):
    at = _folder(spark)
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("not a number")).otherwise(F.col("c_nationkey").cast("string")).alias("nation"))
    c.write.option("header", True).csv(at)
    return sources.load_typed_csv(spark, at, T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("nation", T.LongType())]))


@query("SELECT n_name AS value FROM nation")
def text_files(spark, d):
    """Lines written by a sink node, and read by a source node."""
    at = _folder(spark)
    pl.Pipeline().add("MockNode", "m").then("FileWriter", "w", path=at, key="n_name").plan(spark, act=True, seed={"m": _t(spark, d, "nation")})
    return pl.Pipeline().add("LocalFileReader", "read", directory=at, serialize=True).plan(spark)["read"]


@query("SELECT r_name AS region, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def files_by_row(spark, d):
    """A file for each region, named by a column and read beside its row."""
    at = _folder(spark)
    names = _t(spark, d, "region").select("r_regionkey", "r_name")
    _t(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").text(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("r_regionkey"), F.regexp_replace("path", "^file:/+", "file:///").alias("filename"))
    got = sources.local_file_reader(spark, "", names=names.join(files, "r_regionkey"), serialize=True)
    return got.select(F.col("r_name").alias("region"), "value")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0")
def load_table(spark, d):
    """A table that is ensured, loaded in two ways with columns renamed, and read back."""
    table, n = f"flowtree_{uuid.uuid4().hex}", _t(spark, d, "nation")
    mapping = {"id": "n_nationkey", "name": "n_name"}
    p = pl.Pipeline().add("EnsureTableExists", "ensure", table=table, columns=[{"name": "id", "sql_type": "BIGINT"}, {"name": "name", "sql_type": "STRING"}])
    p.plan(spark)
    try:
        for rows, staged in ((n.where("n_regionkey <> 0"), True), (n.where("n_regionkey = 0"), False)):
            pl.Pipeline().add("MockNode", "m").then("LoadTable", "load", table=table, remap=mapping, via_staging_table=staged, required=["name"]).plan(spark, act=True, seed={"m": rows})
        return _kept(pl.Pipeline().add("StreamTable", "t", table=table).plan(spark)["t"])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@query("SELECT r_regionkey, r_name FROM region")
def snapshot_and_replay(spark, d):
    at = _folder(spark)
    pl.Pipeline().add("MockNode", "m", fixturize=at).plan(spark, seed={"m": _t(spark, d, "region").select("r_regionkey", "r_name")})
    return sinks.replay(spark, at, "m")


@query("SELECT TRUE AS finished, 'done' AS status, count(*) AS n FROM nation")
def sinks_that_pass_on(spark, d):
    """A printer that is off, a sink that consumes all, a barrier, and the status of a run."""
    p = pl.Pipeline().add("MockNode", "m").then("PrinterOfThings", "p", disable=True).after("m").then("BlackHole", "b").after("m").then("Blocker", "k")
    made = p.plan(spark, act=True, seed={"m": _t(spark, d, "nation")})
    return made["k"].select("finished", F.lit("done").alias("status")).crossJoin(made["m"].agg(F.count(F.lit(1)).alias("n")))  # one row each


@query("SELECT r_regionkey, (SELECT count(*) FROM nation)::INTEGER AS n FROM region")
def sql_execute(spark, d):
    _t(spark, d, "nation").createOrReplaceTempView("nation_of_sql_execute")
    p = pl.Pipeline().add("MockNode", "m").then("SQLExecute", "q", sql="SELECT n_name FROM nation_of_sql_execute WHERE n_nationkey >= {least}", query_dict={"least": 0}, returned_columns=["name"])
    return p.plan(spark, seed={"m": _t(spark, d, "region")})["q"].select("r_regionkey", F.size("result_rows").alias("n"))


@query("SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_by_row(spark, d):
    """A statement whose parameters the rows fill in."""
    _t(spark, d, "region").createOrReplaceTempView("region_of_sql_by_row")
    p = pl.Pipeline().add("MockNode", "m").then("SQLExecute", "q", sql="SELECT r_name FROM region_of_sql_by_row WHERE r_regionkey = {n_regionkey}", returned_columns=["name"])
    got = p.plan(spark, seed={"m": _t(spark, d, "nation").select("n_nationkey", "n_regionkey")})["q"]
    return got.select("n_nationkey", F.col("result_rows")[0]["name"].alias("region"))


@query("SELECT event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def emitted_at_end(spark, d):
    """What a node gives once its input has ended."""
    p = pl.Pipeline().add("MockNode", "m").then("AtEnd", "e", aggregates={"n": "count(*)", "most": "max(value)"}, by=["event_type"])
    return p.plan(spark, seed={"m": _t(spark, d, "events")})["e"]


# requests


class _Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self) -> None:
        page = int(self.path.partition("offset=")[2] or 0)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"path": self.path, "more": page < 2, "next": page + 1}).encode())

    def log_message(self, *args) -> None:
        pass


_servers: dict[int, str] = {}


def _server() -> str:
    """host:port of a server of this process, for these queries alone."""
    if not _servers:
        s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
        threading.Thread(target=s.serve_forever, daemon=True).start()
        _servers[0] = f"127.0.0.1:{s.server_port}"
    return _servers[0]


@query("SELECT r_regionkey, '/region/' || r_regionkey AS path FROM region")
def http_get(spark, d):
    p = pl.Pipeline().add("MockNode", "m").then("HttpGetRequest", "g", endpoint_template="{host}/region/{r_regionkey}", endpoint_dict={"host": _server()})
    return p.plan(spark, seed={"m": _t(spark, d, "region")})["g"].select("r_regionkey", F.try_variant_get("response", "$.path", "string").alias("path"))


@query("SELECT r_regionkey, '/' || r_regionkey || CASE p WHEN 0 THEN '' ELSE '?offset=' || p END AS path FROM region, range(3) t(p)")
def http_get_pages(spark, d):
    options = {"endpoint_template": "{host}/{r_regionkey}", "endpoint_dict": {"host": _server()}, "pagination_get_request_key": "offset", "pagination_key": "next", "additional_data_key": "more"}
    p = pl.Pipeline().add("MockNode", "m").then("HttpGetRequestPaginator", "g", **options)
    return p.plan(spark, seed={"m": _t(spark, d, "region")})["g"].select("r_regionkey", F.try_variant_get("page", "$.path", "string").alias("path"))


# streams, run until what is there has been read


def _drained(df: DataFrame, folder: str, timeouts: bool = False, most: float = 3600) -> DataFrame:
    """What a stream makes of all that is there. One whose state waits for ``timeouts`` has no end of its own and takes all in one batch.
    A stream that fails, or hasn't ended after ``most`` seconds, raises: there is no result of a part."""
    spark, kind = df.sparkSession, df.schema
    writer = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    q = writer.trigger(**{"once" if timeouts else "availableNow": True}).start()
    try:
        if not q.awaitTermination(most):  # raises what the stream failed with
            raise TimeoutError(f"the stream hasn't ended after {most} seconds")
    finally:
        q.stop()
    return spark.read.schema(kind).parquet(f"{folder}/out")


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events, be they one file or a folder of files; a path that is a pattern may be either."""
    return spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query("SELECT CASE WHEN i < (SELECT count(*) // 100 FROM events) THEN 100 END::INTEGER AS n FROM range((SELECT count(*) // 100 FROM events)) t(i)")
def stream_batches(spark, d):
    """Full batches of a stream, in one lane; what is left waits for its timeout."""
    out = batch_stream(_events_stream(spark, d).select("event_id"), 100, timeout=3600, lanes=1)
    return _drained(out, _folder(spark), timeouts=True).select(F.size("batch").alias("n"))


@query("SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 600 SECONDS AND a.ts + INTERVAL 600 SECONDS WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def stream_interval_join(spark, d):
    e = _events_stream(spark, d)
    out = ops.stream_join({"view": (e.where("event_type = 'view'"), "user_id"), "purchase": (e.where("event_type = 'purchase'"), "user_id")}, 600, late="36500 days")
    return _drained(out.select(F.col("view.event_id").alias("view_id"), F.col("purchase.event_id").alias("purchase_id")), _folder(spark))


@query("SELECT unnest(['a.txt', 'b.txt']) AS name")
def watched_folder(spark, d):
    """The files of a folder, as a stream."""
    at = _folder(spark)
    local = at.removeprefix("file://")
    for name in ("a", "b"):
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{at}/in/{name}.txt")
    out = _drained(watch_directory(spark, f"{local}/in").select(F.regexp_extract("path", r"/(\w\.txt)/part-[^/]*$", 1).alias("name")), at)
    return out.where("name <> ''")


@query("SELECT TRUE AS stopped, TRUE AS seen")
def stream_stopped_by_a_test(spark, d):
    seen: list[int] = []
    q = stop_when(_events_stream(spark, d), F.col("event_type") == "click", lambda df, _: seen.append(df.count()), f"{_folder(spark)}/checkpoint", max_time=300)
    return spark.createDataFrame([(not q.isActive, sum(seen) > 0)], "stopped boolean, seen boolean")


# common options, and pipelines as data


@query("SELECT r_regionkey AS key, upper(r_name) AS name, coalesce(CASE WHEN r_regionkey > 1 THEN 'own' END, 'given') AS tag FROM region")
def node_options(spark, d):
    """Input path, input mapping, values of the input preferred, and a function of what a node gives."""
    docs = _t(spark, d, "region").select(F.struct(F.struct("r_regionkey", F.col("r_name").alias("n"), F.when(F.col("r_regionkey") > 1, "own").alias("tag")).alias("region")).alias("doc"))
    p = pl.Pipeline().add("MockNode", "m", input_message_keypath="doc.region").then("InsertData", "i", value_dict={"tag": "given"}, input_mapping={"n": "name", "r_regionkey": "key"}, prefer_existing_value=True, post_process_function="upper", post_process_keypath="name")
    return p.plan(spark, seed={"m": docs})["i"].select("key", "name", "tag")


@query("SELECT 3::BIGINT AS n, 2::BIGINT AS failed_rows, 'success' AS status, 2::BIGINT AS limited")
def node_limits(spark, d):
    """Rows that fail and are tolerated, the status of the run, attributes from a function, and the most messages."""
    p = pl.Pipeline().add("CounterOfThings", "c", get_runtime_attrs=lambda: {"last": 5}, runtime_attrs_destinations={"last": "end"}).then("MockNode", "m", error_test="value > 3", max_errors=2)
    p.after("c").then("MockNode", "l", max_messages_received=2)
    made = p.run(spark)
    return spark.createDataFrame([(made["m"].count(), int(p.observed["m"][0].get["errors"]), p.status, made["l"].count())], "n long, failed_rows long, status string, limited long")


@query("SELECT r_regionkey, 12 // r_regionkey AS share, 1::BIGINT AS failed_rows FROM region WHERE r_regionkey > 0")
def failing_function(spark, d):
    """A Python function that fails for a row, which the node tolerates and counts."""
    register("twelfth_of_failing_function", lambda x: 12 // x, "long")
    p = pl.Pipeline().add("MockNode", "m").then("FunctionOfMessage", "f", function_name="twelfth_of_failing_function", key="r_regionkey", output_key="share", max_errors=1)
    got = _kept(p.plan(spark, seed={"m": _t(spark, d, "region")})["f"].select("r_regionkey", "share"))
    return got.withColumn("failed_rows", F.lit(int(p.observed["f"][0].get["errors"])).cast("long"))


@query("SELECT 'x' || r_name AS value FROM region")
def retain_input_off(spark, d):
    """A node that rewrites in place and keeps nothing else."""
    p = pl.Pipeline().add("MockNode", "m").then("SubstituteRegex", "s", key="value", match_regex="^", substitute_string="x", retain_input=False)
    return p.plan(spark, seed={"m": _t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("value"))})["s"]


@query("SELECT n_nationkey, n_name, 'frozen' AS a, 'given' AS b FROM nation WHERE n_nationkey >= 5")
def composite_node(spark, d):
    pl.composite_class({
        "name": "TwoTags",
        "nodes": [{"class": "InsertData", "name": "one", "frozen_arguments": {"value_dict": {"a": "frozen"}}}, {"class": "InsertData", "name": "two", "arg_mapping": {"value_dict": "tags"}}],
        "edges": [{"from": "one", "to": "two"}],
    })
    text = "pipeline_name: {{ when }}\nnodes:\n  m: {class: MockNode}\n  t: {class: TwoTags, options: {tags: {b: TOKEN}}}\n  out: {class: MockNode}\npaths: [[m, t, out]]\n"
    p = pl.load(pl.load(text, {"when": lambda: "now"}).dump().replace("TOKEN", "given"))
    return p.plan(spark, seed={"m": _t(spark, d, "nation").select("n_nationkey", "n_name").where("n_nationkey >= 5")})["out"]


@query(_values("fact, value", ("order", "a,b,c,d"), ("connected", "a,b,c,d"), ("apart", "e"), ("inputs", "b,c"), ("edges drawn", "4"), ("replaced", '{"x": ["new", {"y": "new"}]}'), ("names from the configuration", "c")))
def pipeline_control(spark, d):
    """Edges, connected parts, order, drawing, and values replaced in a configuration."""
    p = pl.Pipeline().add("CounterOfThings", "a").then("MockNode", "b").after("a").then("MockNode", "c").then("MockNode", "d").connect("b", "d")
    lone = pl.Pipeline().add("CounterOfThings", "e")
    loaded = pl.load({"nodes": {"c": {"class": "CounterOfThings", "options": {"end": 1}}}}, override={"c": {"end": 2}})
    facts = {
        "order": ",".join(p.order()), "connected": ",".join(sorted(p.all_connected("b"))), "apart": ",".join(lone.all_connected("e")), "inputs": ",".join(sorted(p.inputs("d"))), "edges drawn": str(p.draw().count("->")),
        "replaced": json.dumps(pl.seek_and_replace({"x": ["old", {"y": "old"}]}, "old", "new")), "names from the configuration": ",".join(loaded.nodes),
    }
    return spark.createDataFrame(list(facts.items()), "fact string, value string")


# models


_SAME = """
QUERY pairs IS SELECT a.okey AS okey, b.part AS part FROM obj START AT HAS KEY okey AS a GO DOWN UNTIL HAS KEY part AS b;
IN QUERY pairs okey IS A UNIQUE PROPERTY okey OF ENTITY sale;
IN QUERY pairs part IS A UNIQUE PROPERTY pkey OF ENTITY part;
IN QUERY pairs okey IS part;
"""


@query("SELECT step, count(*) AS n, count(DISTINCT parameters) AS parameters FROM (SELECT DISTINCT 0 AS step, 'r' || r_regionkey AS parameters FROM region UNION ALL SELECT 0, 'n' || n_nationkey FROM nation UNION ALL SELECT 1, n_nationkey || '-' || n_regionkey FROM nation) GROUP BY 1")
def graph_statements(spark, d):
    """A table through a graph node, as statements for a graph database."""
    config = {"nation": {"data_config": [
        {"name": {"entity_type": "Nation", "property_column": "n_name", "property_type": "Name"}}, {"name": {"entity_type": "Region", "property_column": "n_regionkey", "property_type": "RegionID"}},
        {"relationship": {"relationship_type": "In", "source_entity_name_column": "n_name", "target_entity_name_column": "n_regionkey"}}]}}
    g = graph.TableModel.from_config(config).to_graph({"nation": _t(spark, d, "nation")})
    at = _folder(spark)
    pl.Pipeline().add("MockNode", "m").then("GraphWriter", "w", path=at).plan(spark, act=True, seed={"m": graph.statements(g)})
    return spark.read.json(at).groupBy(F.col("step").cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parameters").alias("parameters"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(arg_max(o_orderpriority, o_totalprice) AS VARCHAR) AS priority, max(o_totalprice) AS price FROM orders GROUP BY 1")
def graph_order(spark, d):
    """The last value by an order column of doubles."""
    config = {"orders": {"data_config": [{"name": {"entity_type": "Customer", "property_column": "o_custkey", "property_type": "CustomerID"}},
        {"property": {"entity_name_column": "o_custkey", "property_column": "o_orderpriority", "property_type": "Priority"}}, {"property": {"entity_name_column": "o_custkey", "property_column": "o_totalprice", "property_type": "Price"}}]}}
    v = graph.TableModel.from_config(config).to_graph({"orders": _t(spark, d, "orders")}, {"orders": "o_totalprice"}).vertices
    typed = graph.typed_properties(v, {"Price": "Float", "Priority": "String"})
    return typed.select(F.col("key_value").alias("customer"), F.col("Priority").alias("priority"), F.col("Price").alias("price"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_value, CAST(o_custkey AS VARCHAR) AS target_value, 'SAME_AS' AS relationship_type FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def graph_coreference(spark, d):
    both = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_custkey")
    config = {"t": {"data_config": [{"name": {"entity_type": "Customer", "property_column": "c_custkey", "property_type": "CustomerID"}}, {"name": {"entity_type": "Buyer", "property_column": "o_custkey", "property_type": "BuyerID"}},
        {"coreference": {"source_entity_name_column": "c_custkey", "target_entity_name_column": "o_custkey"}}]}}
    return graph.TableModel.from_config(config).to_graph({"t": both}).edges.select("source_value", "target_value", "relationship_type")


_PEOPLE = {"t": {"data_config": [
    {"name": {"entity_type": "Person", "property_column": "pid", "property_type": "PersonID"}}, {"name": {"entity_type": "Item", "property_column": "iid", "property_type": "ItemID"}},
    {"property": {"entity_name_column": "pid", "property_column": "city", "property_type": "City"}}, {"relationship": {"relationship_type": "Rented", "source_entity_name_column": "pid", "target_entity_name_column": "iid"}}]}}


@query(_values("predicate, terms", ("entity_has_property", "Person,City"), ("relationship_has_source_name_property", "Rented,PersonID"), ("table_has_column", "t,city"), ("table_has_column", "t,iid"), ("table_has_column", "t,pid"), ("inferred", "Person,True"), ("explicit", "City,False")))
def graph_predicates(spark, d):
    m = graph.TableModel.from_config(_PEOPLE)
    p = m.of("property")[0]
    found = {n: getattr(m, n)() for n in ("entity_has_property", "relationship_has_source_name_property", "table_has_column")}
    return _pairs(spark, found | {"inferred": {(p.entity_type, p.inferred("entity_type"))}, "explicit": {(p.property_type, p.inferred("property_type"))}})


_MODEL = """
QUERY placed IS SELECT o.okey AS okey, o.status AS status, b.part AS part FROM obj START AT HAS KEY okey AS o GO DOWN UNTIL HAS KEY qty AS b;
IN QUERY placed okey IS A UNIQUE PROPERTY okey OF ENTITY sale;
IN QUERY placed part IS A UNIQUE PROPERTY pkey OF ENTITY part;
IN QUERY placed status IS A PROPERTY status OF ENTITY sale NAMED BY okey;
IN QUERY placed sale NAMED BY okey IS RELATED TO part NAMED BY part AS holds;
"""


@query(_values(
    "predicate, terms", ("query_has_relationship", "placed,holds"), ("relationship_between_entities", "holds,sale,part"), ("unique_property_of", "okey,sale"), ("unique_property_of", "pkey,part"), ("non_unique_property_of", "status,sale"),
    *(("property_in_select_clause", f"{p},placed") for p in ("okey", "pkey", "status")), *(("entity_in_select_clause", f"{e},placed") for e in ("sale", "part")), *(("entity_in_data_source", f"{e},obj") for e in ("sale", "part")),
    *(("selection_has_label", f"placed,{x}") for x in ("okey", "status", "part")), ("relationship_source_entity_property", "holds,okey"), ("relationship_target_entity_property", "holds,pkey"), ("relationship_source_target_properties", "holds,okey,pkey"),
))
def model_predicates(spark, d):
    """What follows from the statements of a program."""
    m = mtl.Model(_MODEL)
    names = "query_has_relationship relationship_between_entities unique_property_of non_unique_property_of property_in_select_clause entity_in_select_clause entity_in_data_source selection_has_label relationship_source_entity_property relationship_target_entity_property relationship_source_target_properties"
    return _pairs(spark, {n: getattr(m, n)() for n in names.split()})


# trees


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """{"nation": {"key": ..., "name": ...}, "tags": ["x", {"key": null}]} of each nation, as text."""
    n = _t(spark, d, "nation")
    doc = F.concat(F.lit('{"nation": {"key": '), "n_nationkey", F.lit(', "name": "'), "n_name", F.lit('"}, "tags": ["x", {"key": null}]}'))
    return n.select("n_nationkey", doc.alias("doc"))


@query("SELECT n_nationkey, n_name AS name, NULL::VARCHAR AS missing FROM nation")
def tree_paths_and_missing_steps(spark, d):
    """Ends of paths, a condition that always holds, and a step that isn't there."""
    chain = tree.go_down(tree.PathEndsIn(["nation"]), "n").then(tree.stay_here("m", tree.Yes()))
    return tree.Relation("r", chain, {"name": ("n", ("name",)), "missing": ("m", ("absent", "step"))}).to_df(_docs(spark, d), "doc", ["n_nationkey"])


@query("SELECT n_nationkey, 8::BIGINT AS nodes, 1::BIGINT AS roots, 3::BIGINT AS dicts, 1::BIGINT AS lists, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def tree_nodes(spark, d):
    """Every node of each document, with its kind."""
    rows = tree.splitter(_docs(spark, d), "doc")
    count = lambda c: F.count_if(c)
    return rows.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("nodes"), count(F.col("parent") == -1).alias("roots"), count(F.col("kind") == "dict").alias("dicts"), count(F.col("kind") == "list").alias("lists"), F.max(F.when(F.col("key") == "key", F.col("v"))).alias("key"))


@query("SELECT r_regionkey, upper(r_name) AS name FROM region")
def tree_functions_of_text(spark, d):
    """A function that a program defines by its path, applied in a selection."""
    docs = _t(spark, d, "region").select("r_regionkey", F.struct(F.struct(F.col("r_name").alias("name")).alias("region")).alias("doc"))
    q = mtl.TreeQuery("loud IS A PYTHON FUNCTION IMPORTED FROM flowtree.functions.upper;\nQUERY q IS SELECT loud(x.name) AS name FROM obj START AT HAS KEY name AS x;")
    return q.to_df(docs, "doc", "q", ["r_regionkey"])


# functions, types and rows


@query("SELECT event_id, date_trunc('second', ts) AS seconds, 'a,b,c' AS flat, event_type AS same, TRUE AS hashes, TRUE AS recent, 1546300800000 AS fixed, TIMESTAMP '2016-01-01 00:00:00' AS first_day FROM events")
def more_functions(spark, d):
    nested = F.array(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c")))
    e = _t(spark, d, "events")
    now = F.current_timestamp().cast("timestamp_ntz")
    recent = (scalar.now_datetime() <= now) & (scalar.two_weeks_ago_datetime() < now) & scalar.now_milliseconds().rlike(r"^\d{13}$") & (F.length(scalar.now_redshift()) > 20)
    return e.select(
        "event_id", scalar.seconds_epoch_to_datetime(F.expr("unix_seconds(CAST(ts AS TIMESTAMP))")).cast("timestamp_ntz").alias("seconds"), F.array_join(scalar.flatten(nested, T.ArrayType(T.ArrayType(T.StringType()))), ",").alias("flat"), scalar.nevermind(F.col("event_type")).alias("same"),
        ((F.length(scalar.random_hash()) == 32) & (scalar.message_hash(F.struct("event_id")) == F.md5(F.concat(F.lit('{"event_id":'), "event_id", F.lit("}"))))).alias("hashes"), recent.alias("recent"),
        scalar.two_weeks_ago().alias("fixed"), scalar.january_1_2016().alias("first_day"),
    )


@query("SELECT event_id, TRY_CAST(event_type AS BIGINT) AS number, user_id AS id, 'STRING' AS kinds FROM events")
def types_and_casts(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", convert(F.col("event_type"), "int(11)").alias("number"), convert(F.col("user_id").cast("string"), type_from_string("bigint")).cast(e.schema["user_id"].dataType).alias("id"), F.array_join(possible_types(F.col("event_type")), ",").alias("kinds"))


@query("SELECT 'ann' AS name, 7::BIGINT AS n, 2.5::DOUBLE AS share, 'name,n,share' AS fields")
def typed_rows(spark, d):
    row = TypedRow.from_dict({"name": "bob", "n": 7})
    row += TypedRow(name="ann")
    row = row.concat(TypedRow(share=2.5))
    return spark.createDataFrame([row.to_row()], row.schema()).withColumn("fields", F.lit(",".join(row.schema().names)))


@query("SELECT r_regionkey, r_name AS inner_name, 'set' AS put FROM region")
def values_by_path(spark, d):
    docs = _t(spark, d, "region").select("r_regionkey", F.struct(F.struct("r_name").alias("a")).alias("doc"))
    out = paths.put(docs, "doc.a.put", F.lit("set"))
    return out.select("r_regionkey", paths.get(out, "doc.a.r_name").alias("inner_name"), paths.get(out, "doc.a.put").alias("put"))
