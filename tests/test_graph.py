import pytest
import yaml

from flowtree import sinks
from flowtree.plans import graph

CONFIG = yaml.safe_load("""
rental:
  data_type: table
  data_config:
    - name: {entity_type: Item, property_column: item_id, property_type: ItemID, function: noop, alias: ItemID}
    - name: {entity_type: Person, property_column: person_id, property_type: PersonID}
    - property: {entity_name_column: person_id, property_column: city, property_type: City}
    - relationship: {relationship_type: Rented, source_entity_name_column: person_id, target_entity_name_column: item_id}
    - relationship_property: {relationship_type: Rented, relationship_property_column: day, relationship_property_type: Day, source_entity_name_column: person_id, target_entity_name_column: item_id}
    - compound_name:
        entity_type: Loan
        components:
          - {type: P, column_name: person_id, entity_type: Person, entity_name_property: PersonID}
          - {type: I, column_name: item_id, entity_type: Item, entity_name_property: ItemID}
""")


@pytest.fixture
def made(spark):
    df = spark.createDataFrame([(1, 10, "A", "mon", 1), (1, 10, "B", "tue", 2), (2, None, "C", "wed", 3), (None, 11, "D", "thu", 4), (3, 11, None, None, 5)], "person_id int, item_id int, city string, day string, seq int")
    return graph.TableModel.from_config(CONFIG).to_graph({"rental": df}, {"rental": "seq"})


def test_vertices_once_with_the_last_value(made):
    got = {(r.entity_type, r.key_value): r.properties for r in made.vertices.where("entity_type <> 'Loan'").collect()}
    assert got == {("Person", "1"): {"City": "B"}, ("Person", "2"): {"City": "C"}, ("Person", "3"): {}, ("Item", "10"): {}, ("Item", "11"): {}}
    assert made.vertices.count() == 7


def test_edges_once_with_properties(made):
    got = {(r.relationship_type, r.source_value, r.target_value): r.properties for r in made.edges.where("relationship_type = 'Rented'").collect()}
    assert got == {("Rented", "1", "10"): {"Day": "tue"}, ("Rented", "3", "11"): {}}
    assert made.edges.where("relationship_type in ('R0', 'R1')").count() == 4


def test_inference_and_its_limits():
    model = graph.TableModel.from_config(CONFIG)
    p = model.of("property")[0]
    assert p.entity_type == "Person" and p.entity_name_property == "PersonID" and p.inferred("entity_type") and not p.inferred("property_type")
    assert model.entity_has_property() == {("Person", "City")} and ("rental", "day") in model.table_has_column()
    assert model.relationship_has_source_name_property() == {("Rented", "PersonID")} and not model.assertion_without_column()
    twice = {"t": {"data_config": [{"name": {"entity_type": e, "property_column": "c", "property_type": "P"}} for e in "AB"] + [{"property": {"entity_name_column": "c", "property_column": "x", "property_type": "X"}}]}}
    with pytest.raises(graph.AmbiguityError):
        graph.TableModel.from_config(twice)
    with pytest.raises(ValueError):
        graph.TableModel.from_config({"t": {"data_config": [{"no_such": {}}]}})
    with pytest.raises(ValueError):
        graph.TableModel.from_config({"t": {"data_config": [{"name": {"typo": 1}}]}})


def test_master_table_and_typed_properties(made, spark, tmp_path):
    model = graph.TableModel.from_config(CONFIG)
    assert graph.extrapolated(model) == [("Person", "Rented", "Item")]
    got = graph.master_table(made, graph.extrapolated(model)).select("Person", "Item").collect()
    assert sorted(map(tuple, got)) == [("1", "10"), ("3", "11")]
    typed = graph.typed_properties(made.vertices.where("entity_type = 'Person'"), {"City": "String", "Absent": "Integer"})
    assert {r.City for r in typed.collect()} == {"B", "C", None}
    with pytest.raises(ValueError):
        graph.master_table(made, [("A", "x", "B"), ("C", "y", "D")])
    sinks.write_graph(made.vertices, made.edges, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "vertices")).count() == 7


def test_statements(made):
    rows = graph.statements(made).collect()
    assert {r.step for r in rows} == {0, 1} and all("$" in r.cypher for r in rows) and len(rows) == made.vertices.count() + made.edges.count()


def test_empty_table(spark):
    g = graph.TableModel.from_config(CONFIG).to_graph({"rental": spark.createDataFrame([], "person_id int, item_id int, city string, day string")})
    assert g.vertices.count() == 0 and g.edges.count() == 0


@pytest.mark.parametrize("kind, values", [("double", [9.5, 10.5]), ("int", [-5, -3]), ("decimal(10,2)", ["9.50", "10.50"]), ("bigint", [2**53, 2**53 + 1]), ("string", ["a", "b"]), ("timestamp", ["2020-01-01 00:00:00", "2020-01-01 00:00:01"]), ("date", ["1999-12-31", "2000-01-01"])])
def test_the_last_row_by_order_columns_of_any_type(spark, kind, values):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "old", str(values[0])), (1, "new", str(values[1])), (1, "none", None)], "k int, v string, o string").withColumn("o", F.col("o").cast(kind))
    config = {"t": {"data_config": [{"name": {"entity_type": "K", "property_column": "k", "property_type": "ID"}}, {"property": {"entity_name_column": "k", "property_column": "v", "property_type": "V"}}]}}
    for rows in (df, df.orderBy(F.col("o").desc())):
        (r,) = graph.TableModel.from_config(config).to_graph({"t": rows}, {"t": "o"}).vertices.collect()
        assert r.properties == {"V": "new"}


def test_a_table_is_read_twice_at_most_for_each_kind(spark, tmp_path):
    spark.createDataFrame([(1, 2, "x")], "person_id int, item_id int, city string").selectExpr("*", "'d' AS day", "1 AS seq").write.parquet(str(tmp_path / "t"))
    g = graph.TableModel.from_config(CONFIG).to_graph({"rental": spark.read.parquet(str(tmp_path / "t"))}, {"rental": "seq"})

    def reads(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert reads(g.vertices.where("entity_type = 'Person'")) == 2 and reads(g.vertices.where("entity_type = 'Item'")) == 1
    assert reads(g.edges.where("relationship_type = 'Rented'")) == 2 and reads(g.edges.where("relationship_type = 'R0'")) == 1


def test_rows_hold_no_names_of_kinds_and_compounds_meet_in_one_shuffle(spark):
    """Names of kinds, repeated in each row, and a further shuffle for what is grouped by a compound, made up most of what was shuffled."""
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (None, 3)], "a int, b int")
    parts = [{"type": t, "column_name": c, "entity_type": t, "entity_name_property": "ID"} for t, c in (("A", "a"), ("B", "b"))]
    config = {"t": {"data_config": [{"compound_name": {"entity_type": "Both", "components": parts}}]}}
    e = graph.TableModel.from_config(config).to_graph({"t": df}).edges
    plan = e.groupBy("target_value").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Exchange hashpartitioning(relationship_type" not in plan
    got = sorted((r.relationship_type, r.source_type, r.source_value, r.target_type, r.properties["component"]) for r in e.collect())
    assert got == [("R0", "A", "1", "Both", "A"), ("R0", "A", "2", "Both", "A"), ("R1", "B", "10", "Both", "B"), ("R1", "B", "10", "Both", "B")]
    twice = graph.TableModel.from_config({"t": config["t"], "u": config["t"]}).to_graph({"t": df, "u": df.where("a = 1")}).edges
    assert sorted((r.relationship_type, r.source_type, r.source_value, r.target_type, r.properties["component"]) for r in twice.collect()) == got


def test_edges_take_one_aggregation_of_numbers(spark):
    df = spark.createDataFrame([(1, 10), (1, 10)], "person_id int, item_id bigint")
    edges = graph.Edges()
    edges.add(df, "Rented", ("Person", "ID", df.person_id), ("Item", "ID", df.item_id))
    edges.add(df.select("person_id", "item_id"), "Rented", ("Person", "ID", df.person_id), ("Item", "ID", df.item_id))
    e = graph.merged(spark, graph.Vertices(), edges).edges
    plan = e._jdf.queryExecution().sparkPlan().toString()
    assert "Rented" not in plan.partition("Aggregate")[2] and "collect_list" not in plan
    assert [(r.source_value, r.target_value, r.properties) for r in e.collect()] == [("1", "10", {})]


def test_texts_and_numbers_are_merged_as_texts(spark):
    edges = graph.Edges()
    for rows, kind in (([(1, 2), (3, 4)], "a int, b int"), ([("1", "2"), ("x", "4")], "a string, b string")):
        df = spark.createDataFrame(rows, kind)
        edges.add(df, "E", ("A", "ID", df.a), ("B", "ID", df.b), {"p": df.a} if kind == "a int, b int" else None)
    got = {(r.source_value, r.target_value): r.properties for r in graph.merged(spark, graph.Vertices(), edges).edges.collect()}
    assert got == {("1", "2"): {"p": "1"}, ("3", "4"): {"p": "3"}, ("x", "4"): {}}


def test_documents_of_orders_take_no_sort_and_repeated_properties_go_first(spark):
    from flowtree import queries

    d = "/root/testdata/sf0.001"
    with_orders = queries._orders(spark, d)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in with_orders and "SortMergeJoin" not in with_orders
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, None), (2, None)], "k int, v string")
    v = graph.Vertices()
    v.add(df, "K", "ID", df.k, {"V": df.v})
    made = graph.merged(spark, v, graph.Edges()).vertices
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    assert {r.key_value: r.properties for r in made.collect()} == {"1": {"V": "y"}, "2": {}}
