"""Pipelines: nodes and edges in Python or YAML, folded in topological order into one plan for each sink.

A node is of a class in the registry. A source makes rows; a worker gets the union of its inputs; a sink acts on them.
Nothing runs while the plan is made; ``run`` then takes one action for each node without successors, and Catalyst
optimises across all nodes between.
"""

from __future__ import annotations

import argparse
import csv
import functools
import importlib
import os
import re
import sys
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as ops
from .. import paths, rows, sinks, sources
from ..functions import load_function
from ..functions.registry import ALLOWED_MODULES
from . import graph as graphs
from . import mtl

#: Options that are taken, so that a configuration written for message queues loads, and have no effect on a plan: there are no
#: messages in transit to wait for, to time or to end. A warning names them.
WITHOUT_EFFECT = frozenset("throttle keep_alive summary batch send_termination_message break_test delay on_failure block to_row_obj send_batch_markers missing_keypath_action include_headers database".split())
#: Options that every node takes.
COMMON = frozenset(
    "name input_message_keypath retain_input prefer_existing_value input_mapping post_process_function post_process_keypath post_process_function_kwargs throttle max_errors error_test max_messages_received "
    "break_test get_runtime_attrs get_runtime_attrs_args get_runtime_attrs_kwargs runtime_attrs_destinations send_termination_message keep_alive fixturize batch summary node_output_key".split()
)


#: Most statements that a node runs for the parameters of its input's rows.
STATEMENTS = 1000
_FAILED = "__failed"


class PipelineError(ValueError):
    """A pipeline that can't be planned: an unknown class or option, a missing node, a cycle."""


@dataclass(frozen=True)
class NodeClass:
    """``build(spark, df, options)`` returns a DataFrame; for a sink it acts first and may return None. ``options``: names to whether they are required."""

    kind: str
    build: Callable[[SparkSession, DataFrame | None, dict[str, Any]], Any]
    options: dict[str, bool] = field(default_factory=dict)

    def checked(self, name: str, given: dict[str, Any]) -> None:
        unknown = set(given) - set(self.options) - COMMON
        missing = {o for o, needed in self.options.items() if needed} - set(given)
        if idle := sorted(o for o in WITHOUT_EFFECT & set(given) if given[o] not in (None, False, 0)):
            warnings.warn(f"{name}: options without an effect: {', '.join(idle)}", stacklevel=3)
        if unknown or missing:
            raise PipelineError(f"{name}: " + "; ".join(x for x in (f"unknown options {sorted(unknown)}" if unknown else "", f"missing options {sorted(missing)}" if missing else "") if x))


REGISTRY: dict[str, NodeClass] = {}


def node_class(name: str, kind: str, options: str = "", also: tuple[str, ...] = ()) -> Callable:
    """Registers a class; required options are marked by an exclamation mark."""

    def add(build: Callable) -> Callable:
        made = NodeClass(kind, build, {o.rstrip("!"): o.endswith("!") for o in options.split()})
        for n in (name, *also):
            REGISTRY[n] = made
        return build

    return add


def _given(o: dict[str, Any], *names: str) -> dict[str, Any]:
    return {n: o[n] for n in names if n in o}


@node_class("LocalFileReader", "either", "directory filename serialize read_mode key output_key send_batch_markers", ("FileReader",))
def _file(spark, df, o):
    return sources.local_file_reader(spark, **_given(o, "directory", "filename", "serialize", "read_mode", "output_key"), **({"names": df, "key": o.get("key", "value")} if df is not None else {}))


@node_class("CSVReader", "either", "key columns path delimiter")
def _csv(spark, df, o):
    if df is None:
        return sources.csv_reader(spark, o["path"], o.get("delimiter", ","))
    key = o.get("key", "value")
    columns = o.get("columns")
    if columns is None:  # the header of the first text names the columns
        first = df.where(F.col(f"`{key}`").isNotNull()).select(F.split(F.col(f"`{key}`"), "\r?\n", 2)[0].alias("h")).first()
        columns = next(csv.reader([first.h])) if first else []
    return sources.parse_csv(df, key, columns, o.get("retain_input", True))


@node_class("CSVToDictionaryList", "worker", "key output_key")
def _csv_list(spark, df, o):
    return sources.csv_to_dictionary_list(df, o.get("key", "value"), o.get("output_key", "records"))


@node_class("StreamMySQLTable", "source", "table! host user password database port url partition_column bounds partitions to_row_obj send_batch_markers", ("StreamTable",))
def _table(spark, df, o):
    url = o.get("url") or (f"jdbc:mysql://{o['host']}:{o.get('port', 3306)}/{o['database']}" if o.get("database") and o.get("host") else None)
    if url is None or spark.catalog.tableExists(o["table"]):
        return sources.stream_table(spark, o["table"])
    return sources.stream_table(spark, o["table"], url, **_given(o, "partition_column", "bounds", "partitions", "user", "password"))


@node_class("ConstantEmitter", "source", "thing! max_loops delay output_key")
def _constant(spark, df, o):
    return sources.constant_emitter(spark, **_given(o, "thing", "max_loops", "output_key"))


@node_class("SequenceEmitter", "either", "sequence! max_sequences output_key")
def _sequence(spark, df, o):
    given = _given(o, "sequence", "max_sequences", "output_key")
    return sources.sequence_emitter(spark, **given) if df is None else sources.sequence_cross(df, **given)


@node_class("CounterOfThings", "source", "start end output_key")
def _counter(spark, df, o):
    return sources.counter(spark, **_given(o, "start", "end", "output_key"))


@node_class("GetEnvironmentVariables", "either", "mappings environment_variables")
def _environment(spark, df, o):
    return sources.environment_variables(spark, o.get("environment_variables"), o.get("mappings"), df)


@node_class("HttpGetRequest", "worker", "endpoint_template! endpoint_dict protocol retries json output_key")
def _http(spark, df, o):
    return sources.http_get(df, **_given(o, "endpoint_template", "endpoint_dict", "protocol", "retries", "json", "output_key"))


@node_class("HttpGetRequestPaginator", "worker", "endpoint_template! endpoint_dict pagination_get_request_key! additional_data_key! pagination_key! default_offset_value protocol retries output_key", ("PaginatedHttpGetRequest",))
def _pages(spark, df, o):
    return sources.http_get_pages(df, **_given(o, "endpoint_template", "endpoint_dict", "pagination_get_request_key", "additional_data_key", "pagination_key", "default_offset_value", "protocol", "retries", "output_key"))


@node_class("CivisSQLExecute", "either", "sql! database query_dict returned_columns dummy_run output_key", ("SQLExecute",))
def _sql(spark, df, o):
    given = _given(o, "sql", "query_dict", "returned_columns", "dummy_run", "output_key")
    names = [] if df is None else sorted({n for n in re.findall(r"\{(\w+)\}", o["sql"]) if n in df.columns and n not in o.get("query_dict", {})})
    if not names:
        got = sources.sql_execute(spark, **given)
        return got if df is None else df.crossJoin(got)  # one row
    # a statement for each distinct set of parameters that the rows fill in
    sets = df.select(*(f"`{n}`" for n in names)).distinct().limit(STATEMENTS + 1).collect()
    if len(sets) > STATEMENTS:
        raise PipelineError(f"{o['sql']!r} would be run more than {STATEMENTS} times: join the rows with its tables instead")
    made = [sources.sql_execute(spark, **given | {"query_dict": o.get("query_dict", {}) | r.asDict()}).withColumns({f"__{n}": F.lit(r[n]).cast(df.schema[n].dataType) for n in names}) for r in sets]
    if not made:
        return df.crossJoin(sources.sql_execute(spark, **given | {"query_dict": o.get("query_dict", {}) | dict.fromkeys(names), "dummy_run": True}))
    answers = rows.fan_in(made)
    same = functools.reduce(lambda x, y: x & y, (df[f"`{n}`"].eqNullSafe(answers[f"`__{n}`"]) for n in names))
    return df.join(answers, same).drop(*(f"__{n}" for n in names))


@node_class("CivisToCSV", "either", "sql! database query_dict returned_columns include_headers delimiter", ("SQLToCSV",))
def _sql_csv(spark, df, o):
    return sources.sql_to_csv(spark, **_given(o, "sql", "query_dict", "returned_columns"))


@node_class("FindValueInRedshiftColumn", "either", "table! schema database column! choice output_key", ("FindValue",))
def _find(spark, df, o):
    table = f"{o['schema']}.{o['table']}" if o.get("schema") else o["table"]
    got = ops.find_value(spark.table(table), o["column"], o.get("choice", "max")).withColumnRenamed("value", o.get("output_key", "value"))
    return got if df is None else df.crossJoin(got)  # one row


@node_class("Remapper", "worker", "mapping!")
def _remap(spark, df, o):
    return ops.remapper(df, o["mapping"])


@node_class("InsertData", "worker", "value_dict! overwrite overwrite_if_null")
def _insert(spark, df, o):
    return ops.insert_data(df, **_given(o, "value_dict", "overwrite", "overwrite_if_null"))


@node_class("SimpleTransforms", "worker", "transform_mapping! missing_keypath_action")
def _transform(spark, df, o):
    return ops.simple_transforms(df, o["transform_mapping"])


@node_class("SubstituteRegex", "worker", "match_regex! substitute_string! key output_key")
def _regex(spark, df, o):
    return ops.substitute_regex(df, o.get("key", "value"), o["match_regex"], o["substitute_string"], o.get("output_key"))


@node_class("FunctionOfMessage", "worker", "function_name! key output_key returns")
def _function(spark, df, o):
    f = load_function(o["function_name"], o.get("returns", "string"))
    if f.columnar or o.get("max_errors") is None or o.get("error_test"):
        return ops.function_of_message(df, o["function_name"], o.get("key"), **_given(o, "output_key", "returns"))

    def tried(*values):
        try:
            return f.function(*values), False
        except Exception:  # noqa: BLE001 - counted, and bounded by max_errors
            return None, True

    kind = f.returns if isinstance(f.returns, str) else f.returns.simpleString()
    out = df.withColumn("__tried", F.udf(tried, f"struct<value:{kind},failed:boolean>", useArrow=True)(paths.get(df, o.get("key"))))
    return out.withColumns({o.get("output_key", "value"): F.col("__tried.value"), _FAILED: F.col("__tried.failed")}).drop("__tried")


@node_class("Serializer", "worker", "values key output_key")
def _serialize(spark, df, o):
    return ops.serializer(df, o.get("key", "value"), **_given(o, "values", "output_key"))


@node_class("Filter", "worker", "test! test_keypath! value")
def _filter(spark, df, o):
    return ops.filter_rows(df, **_given(o, "test", "test_keypath", "value"))


@node_class("RandomSample", "worker", "sample seed")
def _sample(spark, df, o):
    return ops.random_sample(df, **_given(o, "sample", "seed"))


@node_class("JsonValidator", "worker", "schema schema_filename key output_key")
def _json(spark, df, o):
    return ops.json_valid(df, o.get("key", "value"), o.get("schema") or o["schema_filename"], o.get("output_key"))


@node_class("AggregateValues", "worker", "tail_path! values output_key")
def _aggregate(spark, df, o):
    return ops.aggregate_values(df, **_given(o, "tail_path", "values", "output_key"))


@node_class("BatchMessages", "worker", "batch_size! order timeout lanes output_key")
def _batch(spark, df, o):
    if df.isStreaming:
        from ..streaming import batch_stream

        return batch_stream(df, **_given(o, "batch_size", "timeout", "lanes", "output_key"))
    return ops.batch_messages(df, o["batch_size"], o.get("order") or df.columns, o.get("output_key", "batch"))


@node_class("RowStatCollector", "worker", "columns approximate")
def _stats(spark, df, o):
    return ops.row_stats(df, **_given(o, "columns", "approximate"))


@node_class("AtEnd", "worker", "aggregates! by")
def _at_end(spark, df, o):
    """What a node makes of all its input, once it ends: expressions of aggregates by name, for all rows or by some columns."""
    return df.groupBy(*(f"`{c}`" for c in o.get("by", []))).agg(*(F.expr(e).alias(n) for n, e in o["aggregates"].items()))


@node_class("TimeWindowAccumulator", "worker", "time_window! send_interval! time late by")
def _window(spark, df, o):
    return ops.time_window(df, **_given(o, "time_window", "send_interval", "time", "late", "by"))


@node_class("StreamingJoin", "join", "streams! window time late", ("InnerJoin",))
def _join(spark, inputs, o):
    return ops.stream_join({n: (inputs[n], p) for n, p in o["streams"].items()}, **_given(o, "window", "time", "late"))


@node_class("LocalDirectoryWatchdog", "source", "directory check_interval since")
def _watch(spark, df, o):
    from ..streaming import watch_directory

    return watch_directory(spark, o.get("directory", "."), o.get("since", -1))


@node_class("TreeQuery", "worker", "text filename key query types keep")
def _tree(spark, df, o):
    q = mtl.TreeQuery(o["text"]) if "text" in o else mtl.read(spark, o["filename"])
    key = o.get("key", "value")
    return q.to_df(df, key, o.get("query"), o.get("keep") or ([c for c in df.columns if c != key] if o.get("retain_input", False) else None), o.get("types"))


@node_class("GraphNode", "worker", "config_file! input_table! order")
def _graph(spark, df, o):
    files = o["config_file"] if isinstance(o["config_file"], list) else [o["config_file"]]
    g = graphs.TableModel.from_yaml(*files).to_graph({o["input_table"]: df}, {o["input_table"]: o["order"]} if o.get("order") else None)
    return graphs.statements(g)


@node_class("Neo4JExecutor", "sink", "path uri user username password batch_size", ("GraphWriter",))
def _statements(spark, df, o):
    """Statements to files, once each and vertices first, for the database's own loader; there is no driver for it here."""
    out = df.select("step", "cypher", "parameters").distinct()
    if o.get("path"):
        out.sortWithinPartitions("step").write.mode("overwrite").partitionBy("step").json(o["path"])
    else:
        sinks.black_hole(out)
    return df


@node_class("SendToCivis", "sink", "table! schema database existing_table_rows include_columns columns remap via_staging_table staging_table block dummy_run required", ("LoadTable",))
def _load(spark, df, o):
    table = f"{o['schema']}.{o['table']}" if o.get("schema") else o["table"]
    return sinks.load_table(df, table, **_given(o, "existing_table_rows", "include_columns", "columns", "remap", "via_staging_table", "staging_table", "dummy_run", "max_errors", "required"))


@node_class("EnsureCivisRedshiftTableExists", "either", "table! schema columns! on_failure block database", ("EnsureTableExists",))
def _ensure(spark, df, o):
    table = f"{o['schema']}.{o['table']}" if o.get("schema") else o["table"]
    columns = o["columns"] if isinstance(o["columns"], dict) else {c["name"]: c["sql_type"] for c in o["columns"]}
    statement = sinks.ensure_table(spark, table, columns)
    return df if df is not None else spark.range(1).select(F.lit(statement).alias("table_spec"))


@node_class("PrinterOfThings", "sink", "disable pretty prepend n")
def _print(spark, df, o):
    return sinks.printer(df, **_given(o, "disable", "pretty", "prepend", "n"))


@node_class("BlackHole", "sink")
def _black_hole(spark, df, o):
    sinks.black_hole(df)


@node_class("Blocker", "sink", "output_key")
def _blocker(spark, df, o):
    return sinks.blocker(df, **_given(o, "output_key"))


@node_class("MockNode", "worker")
def _mock(spark, df, o):
    return df


@node_class("FileWriter", "sink", "path! key")
def _write(spark, df, o):
    return sinks.write_text(df, o["path"], o.get("key", "value"))


@dataclass
class Node:
    name: str
    class_name: str
    options: dict[str, Any]

    @property
    def cls(self) -> NodeClass:
        return REGISTRY[self.class_name]


class Pipeline:
    """Nodes and edges. ``then`` chains: Pipeline().add(...).then(...).then(...)."""

    def __init__(self, name: str | None = None) -> None:
        self.name, self.nodes, self.edges = name, {}, []
        self._last: str | None = None
        self.observed: dict[str, tuple[Observation, int]] = {}
        self.status = "new"
        self.began: float | None = None
        self.ended: float | None = None
        self._shared: list[DataFrame] | None = None
        self._group = f"pipeline-{uuid.uuid4().hex}"

    def add(self, class_name: str, name: str | None = None, **options: Any) -> Pipeline:
        if class_name not in REGISTRY:
            raise PipelineError(f"unknown class {class_name!r}")
        name = name or f"{class_name}_{len(self.nodes)}"
        if name in self.nodes:
            raise PipelineError(f"there is a node {name!r} already")
        REGISTRY[class_name].checked(name, options)
        self.nodes[name], self._last = Node(name, class_name, options), name
        return self

    def then(self, class_name: str, name: str | None = None, **options: Any) -> Pipeline:
        source = self._last
        self.add(class_name, name, **options)
        return self.connect(source, self._last)

    def after(self, name: str) -> Pipeline:
        """The node that ``then`` goes on from."""
        if name not in self.nodes:
            raise PipelineError(f"no node {name!r}")
        self._last = name
        return self

    def connect(self, source: str, target: str) -> Pipeline:
        for n in (source, target):
            if n not in self.nodes:
                raise PipelineError(f"no node {n!r}")
        if (source, target) not in self.edges:
            self.edges.append((source, target))
        return self

    def inputs(self, name: str) -> list[str]:
        return [s for s, t in self.edges if t == name]

    def outputs(self, name: str) -> list[str]:
        return [t for s, t in self.edges if s == name]

    def all_connected(self, name: str) -> set[str]:
        """The nodes that a node is connected with, in either direction, itself included."""
        seen, todo = set(), [name]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.inputs(n) + self.outputs(n)
        return seen

    def order(self) -> list[str]:
        left, out = dict.fromkeys(self.nodes), []
        while left:
            free = [n for n in left if all(i not in left for i in self.inputs(n))]
            if not free:
                raise PipelineError(f"a cycle through {sorted(left)}")
            out += free
            for n in free:
                del left[n]
        return out

    def plan(self, spark: SparkSession, act: bool = False, seed: dict[str, DataFrame] | None = None) -> dict[str, DataFrame | None]:
        """The DataFrame of each node; sinks pass their input on unless ``act``. ``seed`` gives the inputs of nodes without one."""
        made: dict[str, DataFrame | None] = {}
        for name in self.order():
            node, before = self.nodes[name], {n: made[n] for n in self.inputs(name)}
            if seed and name in seed:
                before = {"input": seed[name]}
            if any(d is None for d in before.values()):
                raise PipelineError(f"{name}: {[n for n, d in before.items() if d is None]} pass nothing on")
            if not before and node.cls.kind in ("worker", "sink", "join"):
                raise PipelineError(f"{name} has no input")
            made[name] = self._apply(spark, node, before, act)
            if self._shared is not None and len(self.outputs(name)) > 1 and made[name] is not None and not made[name].isStreaming:
                self._shared.append(made[name].persist())  # each branch has an action of its own
        return made

    def _apply(self, spark: SparkSession, node: Node, before: dict[str, DataFrame], act: bool) -> DataFrame | None:
        o, cls = self._runtime(node), node.cls
        if cls.kind == "join":
            return self._after(node, None, cls.build(spark, before, o), o)
        df = rows.fan_in(list(before.values())) if before else None
        if df is not None:
            df = self._before(df, o)
        if cls.kind == "sink" and not act:
            return df
        kept = df
        if df is not None and o.get("prefer_existing_value"):
            df = df.withColumns({f"__in_{c}": F.col(f"`{c}`") for c in df.columns})
        out = cls.build(spark, df, o)
        return out if cls.kind == "sink" or out is None else self._after(node, kept, out, o)

    @staticmethod
    def _runtime(node: Node) -> dict[str, Any]:
        """Options, with those that a function on the driver gives when the plan is made."""
        o = dict(node.options)
        f = o.get("get_runtime_attrs")
        if f:
            got = (f if callable(f) else load_function(f).function)(*o.get("get_runtime_attrs_args", []), **o.get("get_runtime_attrs_kwargs", {}))
            to = o.get("runtime_attrs_destinations", {})
            o |= {to.get(k, k): v for k, v in got.items()}
        return o

    @staticmethod
    def _before(df: DataFrame, o: dict[str, Any]) -> DataFrame:
        if o.get("input_mapping"):
            df = df.withColumnsRenamed(o["input_mapping"])
        if o.get("input_message_keypath"):
            value, kind = paths.get(df, o["input_message_keypath"]), paths.type_at(df, o["input_message_keypath"])
            df = df.select(*(value.getField(n).alias(n) for n in kind.names)) if isinstance(kind, T.StructType) else df.select(value.alias("value"))
        return df.limit(int(o["max_messages_received"])) if o.get("max_messages_received") is not None else df

    def _after(self, node: Node, before: DataFrame | None, out: DataFrame, o: dict[str, Any]) -> DataFrame:
        if before is not None and o.get("prefer_existing_value") and all(f"__in_{c}" in out.columns for c in before.columns):
            out = out.withColumns({c: F.coalesce(F.col(f"`__in_{c}`"), F.col(f"`{c}`")) for c in before.columns if c in out.columns})
            out = out.drop(*(f"__in_{c}" for c in before.columns))
        if o.get("retain_input") is False and before is not None and node.class_name not in ("TreeQuery", "CSVReader"):
            made = list(o["mapping"]) if node.class_name == "Remapper" else [c for c in out.columns if c not in before.columns or c == o.get("output_key")]
            if not made and o.get("key") in out.columns:  # it rewrites its key in place
                made = [o["key"]]
            out = out.select(*(f"`{c}`" for c in (made or out.columns)))
        if o.get("node_output_key"):
            fresh = [c for c in out.columns if before is None or c not in before.columns]
            out = out.select(*(f"`{c}`" for c in out.columns if c not in fresh), F.struct(*(f"`{c}`" for c in fresh)).alias(o["node_output_key"]))
        if o.get("post_process_function"):
            f, at = load_function(o["post_process_function"]), o.get("post_process_keypath") or out.columns[-1]
            out = paths.put(out, at, f(paths.get(out, at), **o.get("post_process_function_kwargs", {})))
        if o.get("error_test") or _FAILED in out.columns:
            out, seen = rows.tolerate(out, F.col(_FAILED) if _FAILED in out.columns else F.expr(o["error_test"]), o.get("max_errors", 0), node.name)
            out = out.drop(_FAILED)
            self.observed[node.name] = (seen, o.get("max_errors", 0))
        return sinks.snapshot(out, o["fixturize"], node.name) if isinstance(o.get("fixturize"), str) else out

    def run(self, spark: SparkSession) -> dict[str, DataFrame | None]:
        """Makes the plan, lets sinks act, and consumes what has no successor; then raises if a node had too many errors.

        What several nodes read is kept while it runs, so that it is made once.
        """
        self.status, self.began, self.ended, self._shared = "running", time.monotonic(), None, []
        spark.sparkContext.setJobGroup(self._group, self.name or "pipeline", interruptOnCancel=True)
        try:
            made = self.plan(spark, act=True)
            for name, df in made.items():
                if not self.outputs(name) and df is not None and self.nodes[name].cls.kind != "sink" and not df.isStreaming:
                    sinks.black_hole(df)
            for name, (seen, most) in self.observed.items():
                rows.check_errors(seen, most, name)
        except BaseException:
            self.status = "terminated" if self.status == "terminating" else "error"
            raise
        finally:
            for df in self._shared:
                df.unpersist()
            self._shared, self.ended = None, time.monotonic()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        self.status = "success"
        return made

    def terminate(self, spark: SparkSession) -> None:
        """Cancels the jobs of a run, from another thread; the run raises, and its status is 'terminated'."""
        if self.status == "running":
            self.status = "terminating"
            spark.sparkContext.cancelJobGroup(self._group)

    @property
    def finished(self) -> bool:
        return self.status in ("success", "error", "terminated")

    @property
    def time_running(self) -> float:
        """Seconds of the run, so far or in all."""
        return 0.0 if self.began is None else (self.ended or time.monotonic()) - self.began

    def draw(self) -> str:
        """The graph in DOT."""
        quoted = lambda s: '"' + s.replace('"', '\\"') + '"'
        lines = [f"  {quoted(n.name)} [label={quoted(n.name + chr(92) + 'n' + n.class_name)}];" for n in self.nodes.values()]
        lines += [f"  {quoted(s)} -> {quoted(t)};" for s, t in self.edges]
        return "\n".join([f"digraph {quoted(self.name or 'pipeline')} {{", "  rankdir=LR;", *lines, "}"])

    def dump(self) -> str:
        """The pipeline as YAML that ``load`` reads."""
        return yaml.safe_dump({"pipeline_name": self.name, "nodes": {n.name: {"class": n.class_name, "options": n.options} for n in self.nodes.values()}, "edges": [{"source": s, "target": t} for s, t in self.edges]}, sort_keys=False)


def _rendered(text: str, functions: dict[str, Callable] | None) -> str:
    def value(m: re.Match) -> str:
        name = m[1]
        if functions and name in functions:
            return str(functions[name]())
        module, _, f = name.replace("__", ".").rpartition(".")
        if module not in ALLOWED_MODULES:
            raise PipelineError(f"{name!r} in the configuration is no known function")
        return str(getattr(importlib.import_module(module), f)())

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", value, text)


def seek_and_replace(x: Any, token: str, replacement: Any) -> Any:
    """Every value that equals the token, at any depth, replaced."""
    if isinstance(x, dict):
        return {k: seek_and_replace(v, token, replacement) for k, v in x.items()}
    if isinstance(x, list):
        return [seek_and_replace(v, token, replacement) for v in x]
    return replacement if x == token else x


def load(source: str | dict, functions: dict[str, Callable] | None = None, override: dict[str, dict] | None = None) -> Pipeline:
    """A pipeline from YAML (a file's name, or text with line breaks) or a dict: nodes, edges, paths, composites, secrets_files."""
    folder = "."
    if isinstance(source, str):
        if "\n" not in source:
            folder = os.path.dirname(source) or "."
            with open(source, encoding="utf-8") as f:
                source = f.read()
        config = yaml.safe_load(_rendered(source, functions))
    else:
        config = source
    for cache, name in (config.get("secrets_files") or {}).items():
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            for token, value in (yaml.safe_load(f) or {}).items():
                config = seek_and_replace(config, f"{cache}.{token}", value)
    for composite in config.get("composites") or []:
        composite_class(composite)
    out = Pipeline(config.get("pipeline_name"))
    for name, spec in config["nodes"].items():
        out.add(spec["class"], name, **{**(spec.get("options") or {}), **((override or {}).get(name) or {})})
    for e in config.get("edges") or []:
        out.connect(e["source"], e["target"])
    for path in config.get("paths") or []:
        if len(path) < 2:
            raise PipelineError("a path has two nodes at least")
        for s, t in zip(path, path[1:]):
            out.connect(s, t)
    out.order()
    return out


def composite_class(config: dict[str, Any]) -> NodeClass:
    """A class made of nodes: {name, nodes: [{class, name, frozen_arguments, arg_mapping: {inner: outer}}], edges: [{from, to}]}."""
    mapped = {n["name"]: n.get("arg_mapping") or {} for n in config["nodes"]}

    def inner(o: dict[str, Any]) -> Pipeline:
        p = Pipeline(config["name"])
        for n in config["nodes"]:
            p.add(n["class"], n["name"], **(n.get("frozen_arguments") or {}), **{k: o[outer] for k, outer in mapped[n["name"]].items() if outer in o})
        for e in config.get("edges") or []:
            p.connect(e["from"], e["to"])
        return p

    names = {n["name"] for n in config["nodes"]}
    starts = sorted(names - {e["to"] for e in config.get("edges") or []})
    ends = sorted(names - {e["from"] for e in config.get("edges") or []})
    if len(starts) != 1 or len(ends) != 1:
        raise PipelineError(f"{config['name']}: one node without an input and one without an output, not {starts} and {ends}")

    def build(spark: SparkSession, df: DataFrame | None, o: dict[str, Any]) -> DataFrame | None:
        return inner(o).plan(spark, act=True, seed={starts[0]: df} if df is not None else None)[ends[0]]

    first = {n["name"]: REGISTRY[n["class"]] for n in config["nodes"]}[starts[0]]
    last = {n["name"]: REGISTRY[n["class"]] for n in config["nodes"]}[ends[0]]
    made = NodeClass("sink" if last.kind == "sink" else first.kind, build, {outer: False for m in mapped.values() for outer in m.values()})
    REGISTRY[config["name"]] = made
    return made


def main(args: list[str] | None = None) -> int:
    """run, draw or dump a pipeline file."""
    parser = argparse.ArgumentParser(prog="flowtree")
    parser.add_argument("command", choices=("run", "draw", "dump"))
    parser.add_argument("--filename", required=True)
    parser.add_argument("--module-paths", default="")
    parser.add_argument("--override-args", default="", help="YAML: {node: {option: value}}")
    parser.add_argument("--max-time", type=float, default=None, help="seconds after which running jobs are cancelled")
    given = parser.parse_args(args)
    sys.path[:0] = [p for p in given.module_paths.split(":") if p]
    pipeline = load(given.filename, override=yaml.safe_load(given.override_args) if given.override_args else None)
    if given.command != "run":
        print(pipeline.draw() if given.command == "draw" else pipeline.dump())
        return 0
    from ..session import session

    spark = session()
    if given.max_time:
        import threading

        timer = threading.Timer(given.max_time, spark.sparkContext.cancelAllJobs)
        timer.daemon = True
        timer.start()
    pipeline.run(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
