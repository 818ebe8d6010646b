import pytest
from pyspark.sql import functions as F

from flowtree import operators as ops
from flowtree import paths, rows
from flowtree.functions import (
    convert_date_format, flatten, list_to_dict, load_function, milliseconds_epoch_to_datetime, register, seconds_epoch_to_datetime, sub_dictionary, template, to_bool,
)
from flowtree.types import TypedRow, convert, possible_types, type_from_string


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text, value", [("true", True), ("True", True), ("Yes", True), ("y", True), ("t", True), ("no", False), ("", False), ("1", False), ("false", False), (None, None)])
def test_to_bool_of_text(spark, text, value):
    assert one(spark.createDataFrame([(text,)], "x string").select(to_bool(F.col("x")))) == [(value,)]


def test_to_bool_of_numbers(spark):
    df = spark.createDataFrame([(1, 0.0, True)], "a int, b double, c boolean")
    assert one(df.select(*(to_bool(df[c], df.schema[c].dataType) for c in "abc"))) == [(True, False, True)]


@pytest.fixture
def nested(spark):
    return spark.createDataFrame([({"level_2": "a", "deep": {"level_2": "b"}}, [{"inner_1": "value_1"}, {"inner_1": "value_2"}], 7), (None, None, None)], "outer_2 struct<level_2:string,deep:struct<level_2:string>>, outer_5 array<struct<inner_1:string>>, n int")


def test_keypaths(spark, nested):
    assert one(nested.select(paths.get(nested, "outer_2.deep.level_2"), paths.get(nested, ["outer_5", 1, "inner_1"]), paths.get(nested, "a.b", 5))) == [("b", "value_2", 5), (None, None, 5)]
    assert one(paths.put(nested, "outer_2.deep.level_2", F.lit("z")).select("outer_2.deep.level_2"))[0] == ("z",)
    with pytest.raises(paths.PathNotFound):
        paths.put(nested, "no.such", F.lit(1))


def test_tail_replacement_at_all_depths(nested):
    out = ops.simple_transforms(nested, [{"path": "level_2", "target_value": "x"}, {"path": "inner_1", "target_function": "upper"}])
    assert one(out.select("outer_2.level_2", "outer_2.deep.level_2", F.col("outer_5.inner_1")))[0] == ("x", "x", ["VALUE_1", "VALUE_2"])


def test_tail_replacement_by_falsy_value_and_below_a_start(nested):
    out = ops.simple_transforms(nested, [{"path": "n", "target_value": 0}, {"path": "level_2", "target_value": "q", "starting_path": "outer_2.deep"}])
    assert one(out.select("n", "outer_2.level_2", "outer_2.deep.level_2"))[0] == (0, "a", "q")


def test_aggregate_values(nested):
    assert one(ops.aggregate_values(nested, "inner_1", "v").select("v")) == [(["value_1", "value_2"],), ([],)]
    assert one(ops.aggregate_values(nested, "nowhere", "v").select("v"))[0] == ([],)


def test_remapper_and_retained_input(nested):
    out = ops.remapper(nested, {"a": {"b": "outer_2.level_2", "c": "missing"}, "m": "n"})
    assert out.columns[:3] == nested.columns and one(out.select("a.b", "a.c", "m"))[0] == ("a", None, 7)
    assert ops.remapper(nested, {"m": "n"}, retain_input=False).columns == ["m"]


def test_merging_prefers_existing_values(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    assert one(rows.merged(df, {"k": F.lit(9)}, prefer_existing_value=True)) == [(1,), (9,)]
    assert one(rows.merged(df, {"k": F.lit(9)})) == [(9,), (9,)]


def test_insert_data(spark):
    df = spark.createDataFrame([(None, 1)], "a int, b int")
    assert one(ops.insert_data(df, {"a": 5, "b": 5, "c": 5}, overwrite=False)) == [(5, 1, 5)]
    assert one(ops.insert_data(df, {"a": 5}, overwrite=False, overwrite_if_null=False)) == [(None, 1)]


def test_substitute_regex(spark):
    df = spark.createDataFrame([("john smith $5",), (None,)], "x string")
    assert one(ops.substitute_regex(df, "x", r"(\w+) (?P<last>\w+)", r"\g<last>, \1 $")) == [("smith, john $ $5",), (None,)]


def test_serializer(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "id int, x array<string>")
    assert sorted(one(ops.serializer(df, "x", output_key="y").select("id", "y")), key=str) == [(1, "a"), (1, "b"), (2, None)]
    structs = spark.createDataFrame([([{"p": 1}, {"p": 2}],)], "x array<struct<p:int>>")
    assert one(ops.serializer(structs, "x").select("p")) == [(1,), (2,)]
    maps = spark.createDataFrame([({"k": "v"},)], "m map<string,string>")
    assert one(ops.serializer(maps, "m", output_key="o").select("o")) == [("k",)] and one(ops.serializer(maps, "m", True, "o").select("o")) == [("v",)]


def test_filters_tell_presence_from_null(spark):
    df = spark.createDataFrame([(1, '{"a": null}'), (2, '{"b": 1}'), (3, None)], "id int, j string").withColumn("v", F.parse_json("j"))
    assert one(ops.filter_rows(df, "key_exists", "v.a").select("id")) == [(1,)]
    assert one(ops.filter_rows(df, "key_exists", "v.a", False).select("id")) == [(2,), (3,)]
    assert one(ops.filter_rows(df, "value_is_not_none", "v.a").select("id")) == []
    assert one(ops.filter_rows(df, "value_is_not_none", "v.b").select("id")) == [(2,)]
    assert ops.filter_rows(df, "value_is_true", "missing").count() == 0
    with pytest.raises(ValueError):
        ops.filter_rows(df, "no_such_test", "id")


def test_json_validation(spark):
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 2}, "s": {"enum": ["x"]}, "l": {"items": {"type": "string"}}}}
    texts = ['{"n": 3}', '{"n": 1}', '{"s": "x"}', '{"n": 2, "s": "y"}', '{"n": 2, "s": "x", "l": ["a"]}', '{"n": 2, "l": [1]}', "no", None, '{"n": "3"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    assert one(ops.json_valid(df, "j", schema).select("id")) == [(0,), (4,)]


def test_random_sample_is_seeded(spark):
    df = spark.range(2000)
    assert ops.random_sample(df, 0.1, 3).count() == ops.random_sample(df, 0.1, 3).count() and 100 < ops.random_sample(df, 0.1, 3).count() < 300


def test_meets_condition_once_by_content(spark):
    assert ops.meets_condition(spark.createDataFrame([(1,), (1,), (2,)], "x int"), F.col("x") > 0).count() == 2


@pytest.mark.parametrize("order", ["i", "s", "t"])
def test_batches(spark, order):
    df = spark.range(25).select(F.col("id").alias("i"), F.format_string("%03d", "id").alias("s"), F.timestamp_seconds("id").alias("t"))
    out = sorted(one(ops.batch_messages(df, 10, [order], "b")))
    assert [[r.i for r in b] for _, b in out] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert ops.batch_messages(df.limit(0), 10, [order]).count() == 0


def test_batches_in_the_order_of_texts_of_any_bytes(spark):
    texts = ["Customer#" + t for t in ["", "a", "aa", "aaaaaaaab", "aaaaaaaac", "B", "é", "漢", "z", "zz", "\x00", "🙂", "a b"]]
    out = sorted(one(ops.batch_messages(spark.createDataFrame([(t,) for t in texts], "s string"), 4, ["s"], "b", ranges=5)))
    assert [r.s for _, b in out for r in b] == sorted(texts, key=lambda t: t.encode())


def test_batches_with_null_and_tied_order(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (2,)], "x int")
    out = sorted(one(ops.batch_messages(df, 3, ["x"], "b")))
    assert [[r.x for r in b] for _, b in out] == [[None, 1, 1], [2]]


def test_row_stats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k int, v string")
    assert sorted(one(ops.row_stats(df))) == [("k", 3, True, False), ("v", 2, False, True)]
    assert {r[0]: r[1] for r in one(ops.row_stats(df, approximate=True))} == {"k": 3, "v": 2}
    assert one(ops.find_value(df, "k", "min")) == [(1,)] and one(ops.find_value(df.where("false"), "k")) == [(None,)]
    with pytest.raises(ValueError):
        ops.find_value(df, "k", "avg")


def test_three_way_join_within_a_window(spark):
    df = spark.createDataFrame([("a", 0), ("a", 40), ("b", 5)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = ops.stream_join({"x": (df, "k"), "y": (df, "k"), "z": (df, "k")}, 30)
    assert sorted(one(got.select("key", "x.s", "y.s", "z.s"))) == [("a", 0, 0, 0), ("a", 40, 40, 40), ("b", 5, 5, 5)]
    wide = ops.stream_join({"x": (df, "k"), "y": (df, "k")}, 40)
    assert len(one(wide.where("key = 'a'"))) == 4


def test_sliding_window(spark):
    df = spark.createDataFrame([(0,), (4,), (9,)], "s int").withColumn("ts", F.timestamp_seconds("s"))
    got = ops.time_window(df, 10, 5, aggregates={"n": F.count(F.lit(1))})
    assert [r[2] for r in sorted(one(got))] == [2, 3, 1]


def test_error_tolerance(spark):
    df = spark.range(5)
    out, seen = rows.tolerate(df, F.col("id") > 2, 1, "n")
    assert out.count() == 3
    with pytest.raises(rows.TooManyErrors):
        rows.check_errors(seen, 1, "n")
    assert rows.tolerate(df, F.col("id") > 2, None, "n")[0].count() == 3


def test_fan_in_fills_missing_columns(spark):
    assert one(rows.fan_in([spark.range(1), spark.createDataFrame([("x",)], "s string")])) == [(0, None), (None, "x")]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("2019-01-02", "1000", "x", ["a", "b"], [[["q"]], [["r"], ["s"]]])], "d string, ms string, bad string, v array<string>, nest array<array<array<string>>>")
    got = df.select(
        convert_date_format(F.col("d"), "%Y-%m-%d", "%d %b %y"), milliseconds_epoch_to_datetime(F.col("ms")).cast("string"), milliseconds_epoch_to_datetime(F.col("bad")), seconds_epoch_to_datetime(F.col("ms")).cast("string"),
        list_to_dict(F.col("v"), F.array(F.lit("k"), F.lit("l"))), template("{d}-{zz}-{ms}", {"d": F.col("d"), "ms": F.col("ms")}), flatten(F.col("nest"), df.schema["nest"].dataType),
    )
    assert one(got) == [("02 Jan 19", "1970-01-01 00:00:01", None, "1970-01-01 00:16:40", {"k": "a", "l": "b"}, "2019-01-02-{zz}-1000", ["q", "r", "s"])]
    with pytest.raises(Exception, match="differ"):
        df.select(list_to_dict(F.col("v"), F.array(F.lit("k")))).collect()


def test_sub_dictionary(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,int>")
    assert one(df.select(sub_dictionary(df["m"], ["a", "z"], df.schema["m"].dataType))) == [({"a": 1},)]


def test_functions_by_name(spark):
    register("twice", lambda x: None if x is None else x * 2, "string")
    df = spark.createDataFrame([("ab",)], "x string")
    assert one(ops.function_of_message(df, "twice", "x", "y").select("y")) == [("abab",)]
    assert one(df.select(load_function("html.escape")(F.lit("<")))) == [("&lt;",)]
    with pytest.raises(ValueError):
        load_function("os.system")


def test_types(spark):
    assert type_from_string("varchar(255)").simpleString() == "varchar(255)" and type_from_string("int(11)").simpleString() == "bigint" and type_from_string("blob").simpleString() == "varchar(128)"
    assert one(spark.createDataFrame([("7x",)], "x string").select(convert(F.col("x"), "int"), possible_types(F.col("x")))) == [(None, ["STRING"])]
    a, b = TypedRow(x=1), TypedRow(y="q")
    assert a.concat(b) == {"x": 1, "y": "q"} and a.x == 1 and not a.is_empty()
    with pytest.raises(KeyError):
        a.concat(a)


def test_ranges_by_many_bounds(spark):
    from flowtree.operators.aggregate import _bucket

    bounds = [float(x) for x in range(0, 3000, 3)]
    df = spark.range(-5, 3010).select(F.col("id").cast("double").alias("x")).union(spark.createDataFrame([(None,)], "x double"))
    got = {r.x: (r.few, r.many) for r in df.select("x", _bucket(F.col("x"), bounds, 10_000).alias("few"), _bucket(F.col("x"), bounds).alias("many")).collect()}
    assert got[None] == (-1, -1) and all(a == b == sum(x > y for y in bounds) for x, (a, b) in got.items() if x is not None)
