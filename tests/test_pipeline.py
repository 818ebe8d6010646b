import pytest

from flowtree.plans import pipeline as p

YAML = """
pipeline_name: demo
secrets_files:
  keys: secrets.yaml
_base: &base
  class: ConstantEmitter
nodes:
  start:
    <<: *base
    options: {thing: {name: ann, token: keys.token}, max_loops: 3}
  more:
    class: SequenceEmitter
    options: {sequence: [1, 2], output_key: n}
  keep:
    class: Filter
    options: {test: value_is_not_none, test_keypath: name}
  out:
    class: MockNode
paths:
  - [start, more, keep, out]
"""


@pytest.fixture
def file(tmp_path):
    (tmp_path / "p.yaml").write_text(YAML)
    (tmp_path / "secrets.yaml").write_text("token: hidden\n")
    return str(tmp_path / "p.yaml")


def test_yaml_with_secrets(spark, file):
    made = p.load(file).run(spark)["out"]
    assert made.count() == 6 and {tuple(r) for r in made.collect()} == {("ann", "hidden", 1), ("ann", "hidden", 2)}


def test_command_line(spark, file, capsys):
    assert p.main(["draw", "--filename", file]) == 0 and '"start" -> "more"' in capsys.readouterr().out
    assert p.main(["dump", "--filename", file, "--override-args", "start: {max_loops: 9}"]) == 0 and "max_loops: 9" in capsys.readouterr().out
    assert p.main(["run", "--filename", file]) == 0


def test_dump_loads_again(spark, file):
    again = p.load(p.load(file).dump())
    assert again.order() == ["start", "more", "keep", "out"] and again.plan(spark)["out"].count() == 6


def test_what_cannot_be_planned(spark):
    with pytest.raises(p.PipelineError):
        p.Pipeline().add("NoSuchClass")
    with pytest.raises(p.PipelineError):
        p.Pipeline().add("Filter", test="key_exists")
    with pytest.raises(p.PipelineError):
        p.Pipeline().add("BlackHole", bogus=1)
    with pytest.raises(p.PipelineError):
        p.Pipeline().add("MockNode", "a").then("MockNode", "b").connect("b", "a").order()
    with pytest.raises(p.PipelineError):
        p.Pipeline().add("MockNode", "a").plan(spark)
    with pytest.raises(p.PipelineError):
        p.load({"nodes": {"a": {"class": "MockNode"}}, "paths": [["a"]]})


def test_fan_out_and_in(spark):
    made = p.Pipeline().add("CounterOfThings", "c", end=4).then("InsertData", "x", value_dict={"b": "x"}).then("MockNode", "all")
    made.after("c").then("InsertData", "y", value_dict={"b": "y"}).connect("y", "all")
    assert made.plan(spark)["all"].groupBy("b").count().count() == 2 and made.all_connected("x") == {"c", "x", "y", "all"}


def test_common_options(spark):
    made = p.Pipeline().add("ConstantEmitter", thing={"a": "q", "n": None}, max_loops=5, name="c").then("InsertData", "i", value_dict={"a": "new", "m": "v"}, prefer_existing_value=True, max_messages_received=2, input_mapping={"n": "k"}, post_process_function="upper", post_process_keypath="a")
    rows = made.plan(spark)["i"].collect()
    assert len(rows) == 2 and rows[0].a == "Q" and rows[0].m == "v" and "k" in rows[0].asDict()


def test_runtime_attributes_and_output_key(spark):
    made = p.Pipeline().add("CounterOfThings", "c", get_runtime_attrs=lambda: {"last": 3}, runtime_attrs_destinations={"last": "end"}).then("InsertData", "i", value_dict={"x": 1}, node_output_key="got", retain_input=True)
    assert [r.got.x for r in made.plan(spark)["i"].collect()] == [1, 1, 1]


def test_errors_stop_a_run(spark):
    def made(most):
        return p.Pipeline().add("CounterOfThings", "c", end=5).then("MockNode", "m", error_test="value > 3", max_errors=most)

    assert made(2).run(spark)["m"].count() == 3
    bad = made(1)
    with pytest.raises(Exception, match="2 rows failed"):
        bad.run(spark)
    assert bad.status == "error"


def test_composite_class(spark):
    p.composite_class({"name": "Tagged", "nodes": [{"class": "InsertData", "name": "a", "arg_mapping": {"value_dict": "tags"}}, {"class": "Filter", "name": "b", "frozen_arguments": {"test": "value_is_not_none", "test_keypath": "t"}}], "edges": [{"from": "a", "to": "b"}]})
    made = p.Pipeline().add("CounterOfThings", "c").then("Tagged", "t", tags={"t": 1})
    assert made.plan(spark)["t"].count() == 10


def test_graph_and_tree_nodes(spark, tmp_path):
    (tmp_path / "g.yaml").write_text("t:\n  data_config:\n    - name: {entity_type: N, property_column: value, property_type: V}\n")
    made = p.Pipeline().add("CounterOfThings", "c", end=2).then("GraphNode", "g", config_file=str(tmp_path / "g.yaml"), input_table="t").then("GraphWriter", "w", path=str(tmp_path / "out"))
    made.run(spark)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    tree = p.Pipeline().add("ConstantEmitter", "c", thing='{"a": {"k": 1}}', max_loops=1).then("TreeQuery", "q", text="SELECT x.k AS k FROM obj START AT HAS KEY k AS x;")
    assert [r.k for r in tree.plan(spark)["q"].collect()] == ["1"]


def test_files_to_rows(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n3,z\n4,\n")
    made = p.Pipeline().add("LocalFileReader", "f", directory=str(tmp_path), filename="c.csv").then("CSVReader", "r", retain_input=False).then("MockNode", "m")
    assert made.run(spark)["m"].count() == 4


def test_templates_call_allowed_functions_only(spark):
    assert "CounterOfThings" in p.load("pipeline_name: {{ when }}\nnodes:\n  c: {class: CounterOfThings}\n", {"when": lambda: "now"}).dump()
    with pytest.raises(p.PipelineError):
        p.load("pipeline_name: {{ os.getcwd }}\nnodes:\n  c: {class: CounterOfThings}\n")


def test_shared_rows_are_made_once_and_runs_are_timed(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    from flowtree.functions import register

    register("counted_of_test", counted, "long")
    made = p.Pipeline().add("CounterOfThings", "c", end=6).then("FunctionOfMessage", "f", function_name="counted_of_test", key="value").then("BlackHole", "a").after("f").then("Blocker", "b")
    assert not made.finished and made.time_running == 0
    made.run(spark)
    assert made.finished and made.status == "success" and made.time_running > 0 and calls.value == 6


def test_a_run_that_is_terminated(spark):
    import threading
    import time

    from flowtree.functions import register

    register("slow_of_test", lambda x: time.sleep(30) or x, "long")
    made = p.Pipeline().add("CounterOfThings", "c", end=4).then("FunctionOfMessage", "f", function_name="slow_of_test", key="value")
    threading.Timer(4, lambda: made.terminate(spark)).start()
    with pytest.raises(Exception):  # noqa: B017 - Spark's own
        made.run(spark)
    assert made.status == "terminated" and made.finished and made.time_running < 25


def test_options_without_an_effect_are_named():
    with pytest.warns(UserWarning, match="break_test, throttle"):
        p.Pipeline().add("MockNode", "m", throttle=2, break_test="x > 1", keep_alive=False)


def test_statements_by_row_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(p, "STATEMENTS", 3)
    made = p.Pipeline().add("CounterOfThings", "c", end=4).then("SQLExecute", "q", sql="SELECT {value} AS v")
    with pytest.raises(p.PipelineError, match="more than 3"):
        made.plan(spark)


def test_failing_functions_are_counted_and_bounded(spark):
    from flowtree.functions import register
    from flowtree.rows import TooManyErrors

    register("odd_only_of_test", lambda x: [x][x % 2 - 1] // (x % 2), "long")

    def made(most):
        return p.Pipeline().add("CounterOfThings", "c", end=5).then("FunctionOfMessage", "f", function_name="odd_only_of_test", key="value", output_key="v", max_errors=most)

    ok = made(2)
    assert sorted(r.v for r in ok.run(spark)["f"].collect()) == [1, 3, 5] and ok.plan(spark)["f"].columns == ["value", "v"]
    with pytest.raises(TooManyErrors, match="2 rows failed"):
        made(1).run(spark)
