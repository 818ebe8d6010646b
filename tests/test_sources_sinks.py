import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtree import sinks, sources
from flowtree.rows import TooManyErrors
from flowtree.sources.http import RequestFailed, fetch
from flowtree.sources.sql import sql_rows

CSV = 'uuid,name,state\n1,"Ann, B",\n2,"say ""hi""",TX\n3,short\n4,"two\nlines",CA,extra\n'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "c.csv").write_text(CSV)
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    return tmp_path


def test_files_whole_and_by_line(spark, folder):
    assert sources.local_file_reader(spark, str(folder), "t.txt").first().value == "one\ntwo\n"
    assert [r.value for r in sources.local_file_reader(spark, str(folder), "t.txt", serialize=True).collect()] == ["one", "two"]
    names = spark.createDataFrame([("t.txt",)], "filename string")
    assert [r.value for r in sources.local_file_reader(spark, str(folder), names=names, serialize=True).collect()] == ["one", "two"]
    assert bytes(sources.local_file_reader(spark, str(folder), "t.txt", read_mode="rb").first().value) == b"one\ntwo\n"


def test_csv_keeps_empty_and_missing_fields_apart(spark, folder):
    want = [("1", "Ann, B", ""), ("2", 'say "hi"', "TX"), ("3", "short", None), ("4", "two\nlines", "CA")]
    assert sorted(tuple(r) for r in sources.csv_reader(spark, str(folder / "c.csv")).collect()) == want
    text = spark.createDataFrame([(CSV,), (None,)], "value string")
    assert [tuple(r) for r in sources.parse_csv(text, "value", ["uuid", "name", "state"], retain_input=False).collect()] == want
    assert [len(r.records or []) for r in sources.csv_to_dictionary_list(text, "value").collect()] == [4, 0]


def test_typed_loading_nulls_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,f,s\n1,2.5,a\nx,,\n")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType())])
    assert [tuple(r) for r in sources.load_typed_csv(spark, str(tmp_path / "x.csv"), schema).collect()] == [(1, 2.5, "a"), (None, None, None)]


def test_generated_rows(spark, monkeypatch):
    assert [r.value for r in sources.counter(spark, 3, 5).collect()] == [3, 4, 5]
    assert [r.value for r in sources.sequence_emitter(spark, [{"value": "7", "type": "integer"}, 8], 2).collect()] == [7, 8, 7, 8]
    assert sources.sequence_emitter(spark, []).count() == 0
    assert sources.sequence_cross(spark.range(2), ["a", "b"], 2).count() == 8
    monkeypatch.setenv("SOME_NAME", "v")
    assert tuple(sources.environment_variables(spark, ["ABSENT_NAME"], {"SOME_NAME": "n"}).first()) == (None, "v")
    assert sources.constant_emitter(spark, 5, 3).count() == 3


def test_sql_binds_parameters(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    evil = "x' OR '1'='1"
    assert sql_rows(spark, "SELECT id FROM numbers WHERE cast(id AS string) = '{who}'", {"who": evil}).count() == 0
    got = sources.sql_execute(spark, "SELECT id FROM numbers WHERE id > {n}", {"n": 2}, ["number"]).first()
    assert sorted(x["number"] for x in got.result_rows) == ["3", "4"]
    assert sources.sql_execute(spark, "SELECT id FROM numbers", dummy_run=True).first().result_rows == []
    assert sources.sql_to_csv(spark, "SELECT id FROM numbers").dtypes == [("id", "string")]
    assert [tuple(r) for r in sources.column_types(spark.table("numbers")).collect()] == [("id", "bigint")]


class Server(http.server.BaseHTTPRequestHandler):
    failures = 0

    def do_GET(self):
        if self.path.startswith("/flaky") and Server.failures < 2:
            Server.failures += 1
            self.send_response(503)
            self.end_headers()
            return
        if self.path.startswith("/missing"):
            self.send_response(404)
            self.end_headers()
            return
        page = int(self.path.partition("offset=")[2] or 0)
        body = {"path": self.path, "more": page < 2, "next": page + 1}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{s.server_port}"
    s.shutdown()


def test_requests_by_row(spark, server):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    got = sources.http_get(df, "{host}/{x}/{unknown}", {"host": server}).select("x", F.try_variant_get("response", "$.path", "string").alias("p"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "/a/{unknown}"), ("b", "/b/{unknown}")]


def test_retries_are_bounded(server):
    assert json.loads(fetch(f"http://{server}/flaky", wait=0.01))["path"] == "/flaky"
    with pytest.raises(RequestFailed):
        fetch(f"http://{server}/missing", wait=0.01)


def test_all_pages_the_first_included(spark, server):
    df = spark.createDataFrame([("q",)], "x string")
    got = sources.http_get_pages(df, "{host}/{x}", "offset", "next", "more", {"host": server})
    assert [r.p for r in got.select("x", F.try_variant_get("page", "$.path", "string").alias("p")).collect()] == ["/q", "/q?offset=1", "/q?offset=2"]


@pytest.fixture
def table(spark):
    spark.sql("DROP TABLE IF EXISTS loaded")
    yield "loaded"
    spark.sql("DROP TABLE IF EXISTS loaded")


def test_loading_a_table(spark, table, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "id int, s string, extra boolean")
    assert "CREATE TABLE IF NOT EXISTS" in sinks.ensure_table(spark, table, {"id": "BIGINT", "s": "STRING"})
    sinks.load_table(df, table, include_columns=["id", "s"])
    sinks.load_table(df, table, include_columns=["id", "s"], via_staging_table=True)
    assert spark.table(table).count() == 4 and not [t for t in spark.catalog.listTables() if "staging" in t.name]
    sinks.load_table(df, table, "truncate", remap={"id": "id", "s": "s"})
    assert sorted(r.id for r in spark.table(table).collect()) == [1, 2]
    sinks.load_table(df, table, dummy_run=True)
    assert spark.table(table).count() == 2
    with pytest.raises(TooManyErrors):
        sinks.load_table(df, table, columns=["id", "s"], required=["s"])
    with pytest.raises(ValueError):
        sinks.load_table(df, table, "fail")
    assert spark.table(table).count() == 2
    sinks.load_table(df, table, columns=["id", "s"], required=["s"], max_errors=1)
    assert spark.table(table).count() == 3


def test_small_sinks(spark, tmp_path, capsys):
    df = spark.range(3)
    assert sinks.printer(df) is df and "printer" in capsys.readouterr().out
    sinks.printer(df, disable=True)
    assert capsys.readouterr().out == ""
    assert sinks.black_hole(df) is None and sinks.blocker(df).first().finished
    got = sinks.Collected(df)
    assert got.message_counter == 3 and got.message_holder == {"id": 2}
    sinks.write_text(df, str(tmp_path / "t"), "id")
    assert spark.read.text(str(tmp_path / "t")).count() == 3
    assert sinks.snapshot(df, str(tmp_path / "f"), "n").count() == 3 and sinks.replay(spark, str(tmp_path / "f"), "n").count() == 3


def test_connections_stay_open(server):
    from flowtree.sources.http import Pool

    pool = Pool()
    for k in range(3):
        assert pool.get(f"http://{server}/x y?offset={k}")[0] == 200 and len(pool.open) == 1
    pool.close()
    assert not pool.open and pool.get(f"http://{server}/missing")[0] == 404
    with pytest.raises(RequestFailed):
        pool.get("ftp://nowhere.example/")
