import json
import random

import pytest
from pyspark.sql import functions as F

from flowtree.plans import mtl
from flowtree.plans.tree import HasAncestor, HasDescendant, HasKey, IsDictionary, IsList, IsRoot, PathEndsIn, Relation, Yes, go_down, go_up, leaves, splitter, stay_here


def walk(x, path=(), above=()):
    """(value, path, values above from the nearest on) of every node in pre-order."""
    yield x, path, above
    items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
    for k, v in items:
        yield from walk(v, (*path, str(k)), (x, *above))


def brute(doc, steps, outputs):
    """Rows by nested loops over walks; steps: (direction, test of (value, path, above), label)."""

    def text(x):
        return None if x is None else x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    def go(k, node, bound):
        if k == len(steps):
            row = []
            for label, path in outputs.values():
                v = bound[label][0]
                for p in path:
                    v = v.get(p) if isinstance(v, dict) else None
                row.append(text(v))
            return [tuple(row)]
        direction, test, label = steps[k]
        x, path, above = node
        if direction == "down":
            among = [(v, path + p, a + above) for v, p, a in walk(x)][1:]
        elif direction == "up":
            among = [(a, path[: len(path) - i - 1], above[i + 1 :]) for i, a in enumerate(above)]
        else:
            among = [node]
        return [r for n in among if test(n) for r in go(k + 1, n, {**bound, label: n})]

    return go(0, (doc, (), ()), {})


def made(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return rng.choice([None, True, 3, 2.5, "text", "ünï", ""])
    if kind < 0.75:
        return {k: made(rng, depth + 1) for k in rng.sample("abcd", rng.randint(0, 3))}
    return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def has(key):
    return lambda n: isinstance(n[0], dict) and key in n[0]


CASES = [
    ([go_down(HasKey("a"), "x")], [("down", has("a"), "x")]),
    ([go_down(HasKey("a"), "x"), go_down(HasKey("b"), "y")], [("down", has("a"), "x"), ("down", has("b"), "y")]),
    ([go_down(HasKey("a"), "x"), go_up(IsDictionary(), "y")], [("down", has("a"), "x"), ("up", lambda n: isinstance(n[0], dict), "y")]),
    ([stay_here("x"), go_down(~IsList() & (HasKey("a") | HasKey("b")), "y")], [("stay", lambda n: True, "x"), ("down", lambda n: has("a")(n) or has("b")(n), "y")]),
    ([go_down(HasDescendant(HasKey("b")) & ~HasKey("c"), "x")], [("down", lambda n: any(has("b")(m) for m in list(walk(n[0]))[1:]) and not has("c")(n), "x")]),
    ([go_down(HasAncestor(HasKey("c")) & HasKey("a"), "x")], [("down", lambda n: has("a")(n) and any(has("c")((m,)) for m in n[2]), "x")]),
    ([go_down(PathEndsIn(("a",)), "x"), go_up(IsRoot(), "y")], [("down", lambda n: n[1][-1:] == ("a",), "x"), ("up", lambda n: not n[1], "y")]),
    ([go_down(HasKey("a").xor(HasKey("b")), "x"), go_down(Yes(), "y")], [("down", lambda n: has("a")(n) != has("b")(n), "x"), ("down", lambda n: True, "y")]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_queries_over_json_against_brute_force(spark, case):
    steps, tests = CASES[case]
    rng = random.Random(5 + case)
    docs = [{"a": {"b": {"a": 1}, "c": [{"a": None}, {"b": {"d": "x"}}]}}] + [made(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "no json"), (901, None), (902, "")], "id int, j string").repartition(3)
    chain = steps[0]
    for s in steps[1:]:
        chain = chain.then(s)
    labels = [t[2] for t in tests]
    outputs = {"p": (labels[0], ("a",)), "q": (labels[-1], ()), "r": (labels[-1], ("b", "d"))}
    got = sorted((tuple(r) for r in Relation("r", chain, outputs).to_df(df, "j", ["id"]).collect()), key=str)
    want = sorted(((i, *r) for i, d in enumerate(docs) for r in brute(d, tests, outputs)), key=str)
    assert got == want and want


DOC = {"name": "n", "users": [{"email": "a@x", "home": {"city": "Rome", "geo": {"lat": 1.5}}}, {"email": "b@x", "home": {"city": "Oslo", "geo": None}}, {"email": "c@x", "home": None}], "empty": []}
SCHEMA = "struct<name:string,users:array<struct<email:string,home:struct<city:string,geo:struct<lat:double>>>>,empty:array<string>>"


def test_typed_and_parsed_forms_agree(spark):
    text = spark.createDataFrame([(1, json.dumps(DOC)), (2, None)], "id int, j string")
    typed = text.select("id", F.from_json("j", SCHEMA).alias("j"))
    for chain, out in (
        (go_down(HasKey("email"), "u").then(go_down(HasKey("city"), "c")), {"e": ("u", ("email",)), "c": ("c", ("city",))}),
        (go_down(HasKey("lat"), "g").then(go_up(HasKey("email"), "u")), {"e": ("u", ("email",)), "l": ("g", ("lat",))}),
        (go_down(HasDescendant(HasKey("lat")) & HasKey("email"), "u"), {"e": ("u", ("email",))}),
        (go_down(HasAncestor(IsList()) & HasKey("city"), "c"), {"c": ("c", ("city",))}),
        (stay_here("d", HasKey("users") & ~HasKey("nothing")), {"n": ("d", ("name",)), "m": ("d", ("missing",))}),
    ):
        r = Relation("r", chain, out, {"l": "double"})
        rows = [sorted((tuple(x) for x in r.to_df(d, "j", ["id"]).collect()), key=str) for d in (text, typed)]
        assert rows[0] == rows[1] and rows[0]


def test_typed_query_reads_only_what_it_needs(spark, tmp_path):
    spark.createDataFrame([(json.dumps(DOC),)], "j string").select(F.from_json("j", SCHEMA).alias("j")).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    plan = Relation("r", go_down(HasKey("city"), "c"), {"c": ("c", ("city",))}).to_df(df, "j")._jdf.queryExecution().executedPlan().toString()
    # fields beside the array are pruned from the scan; those of its elements are read, as a lambda takes whole elements
    assert "Exchange" not in plan and "Python" not in plan and "empty" not in plan.split("ReadSchema")[-1] and "city" in plan.split("ReadSchema")[-1]


def test_an_output_needs_a_labelled_step(spark):
    with pytest.raises(ValueError):
        Relation("r", go_down(Yes(), "x"), {"a": ("y", ())}).to_df(spark.createDataFrame([("{}",)], "j string"), "j")


def test_nodes_and_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": 2}]}, "d": "x"}')], "id int, j string")
    assert splitter(df, "j").count() == 7
    assert sorted((".".join(r.path), r.value) for r in leaves(df, "j").collect()) == [("a.b", '[1,{"c":2}]'), ("d", "x")]


def test_chain_introspection():
    chain = go_down(HasKey("a"), "x").then(stay_here("y")).then(go_up(IsRoot()))
    assert [s.direction for s in chain.all_traversals()] == ["down", "stay", "up"] and chain.head.label == "x" and len(chain.tail.steps) == 2


TEXT = """
loud IS A PYTHON FUNCTION IMPORTED FROM string.capwords;
QUERY people IS SELECT d.email AS emailaddress, identity(d.username) AS name, upper(address.city) AS cityname, loud(d.username) AS nice
FROM obj START AT TOP GO DOWN UNTIL HAS KEY email AS d GO DOWN UNTIL (HAS KEY city AND NOT HAS KEY nothing) AS address;
IN QUERY people cityname IS A UNIQUE PROPERTY name OF ENTITY city;
IN QUERY people name IS A UNIQUE PROPERTY personname OF ENTITY person;
IN QUERY people emailaddress IS A PROPERTY email OF ENTITY person NAMED BY name;
IN QUERY people person NAMED BY name IS RELATED TO city NAMED BY cityname AS livesin;
IN QUERY people name AND cityname COREFER;
"""


def test_text_language(spark):
    doc = {"users": [{"email": "a@x", "username": "ann bee", "at": {"city": "Rome"}}, {"email": "b@x", "username": "bob", "at": {"city": "Rome"}}, {"username": "no"}]}
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc),)], "j string")
    q = mtl.TreeQuery(TEXT)
    assert sorted(tuple(r) for r in q.to_df(df, "j").collect())[::2] == [("a@x", "ann bee", "ROME", "Ann Bee"), ("b@x", "bob", "ROME", "Bob")]
    g = q.to_graph(df, "j")
    assert sorted((r.entity_type, r.key_value, r.properties) for r in g.vertices.collect()) == [("city", "ROME", {}), ("person", "ann bee", {"email": "a@x"}), ("person", "bob", {"email": "b@x"})]
    assert sorted((r.relationship_type, r.source_value, r.target_value) for r in g.edges.collect()) == [("SAME_AS", "ann bee", "ROME"), ("SAME_AS", "bob", "ROME"), ("livesin", "ann bee", "ROME"), ("livesin", "bob", "ROME")]
    assert q.create_views(df, "j") == ["people"] and spark.sql("SELECT count(*) FROM people").first()[0] == 4


def test_what_follows_from_a_program():
    m = mtl.Model(TEXT)
    assert m.query_has_relationship() == {("people", "livesin")} and m.relationship_between_entities() == {("livesin", "person", "city")}
    assert m.unique_property_of() == {("name", "city"), ("personname", "person")} and m.non_unique_property_of() == {("email", "person")}
    assert m.relationship_source_target_properties() == {("livesin", "personname", "name")} and m.entity_in_data_source() == {("city", "obj"), ("person", "obj")}
    assert ("people", "nice") in m.selection_has_label() and ("email", "people") in m.property_in_select_clause()


@pytest.mark.parametrize("text", ["SELECT a AS b FROM obj", "QUERY q IS SELECT a AS b FROM obj START AT HAS KEY;", "HAS KEY a AND HAS KEY b;", "", "?;", "IN QUERY q x IS A PROPERTY p OF ENTITY e;"])
def test_syntax_errors(text):
    with pytest.raises(mtl.QuerySyntaxError):
        mtl.parse(text)


def test_fragments_parse():
    assert len(mtl.parse("(HAS KEY a OR TOP); GO UP UNTIL TOP AS x; a.b AS c, f(d) AS e; f(g(a.b), c); SELECT a AS b FROM obj;")) == 5


def test_documents_nested_deep_and_with_halves_of_characters(spark):
    deep = "[" * 1500 + "7" + "]" * 1500
    texts = [(1, deep), (2, "[" * 90_000 + "]" * 90_000), (3, '{"a": "\\ud800", "b": "\\ud83d\\ude00"}'), (4, "not json"), (5, None), (6, '{"a": "kept \\\\ud800"}')]
    from flowtree.plans import tree

    rows = tree.splitter(spark.createDataFrame(texts, "id int, doc string"), "doc").select("id", "depth", "key", "v", "last").collect()
    of = {i: [r for r in rows if r.id == i] for i in range(1, 7)}
    assert len(of[1]) == 1501 and {r.last for r in of[1]} == {1500} and of[1][-1].v == "7"
    assert not of[2] and not of[4] and not of[5]
    assert {r.key: r.v for r in of[3] if r.key} == {"a": "\ufffd", "b": "\U0001f600"} and {r.key: r.v for r in of[6] if r.key} == {"a": "kept \\ud800"}


def test_json_is_followed_as_nodes_are(spark, monkeypatch):
    """The pass that reads documents follows the chain; the nodes and expressions that other modules' conditions need give the same."""
    from flowtree.plans import tree

    texts = ['{"a": {"k": 1, "b": [{"k": null, "v": 1.50}, {"k": [1, {"v": "x"}]}, 7, []]}, "k": {"v": true}}', '[{"k": {"k": {"v": {"y": 1}}}}, "s"]', "3", "null", '{"k": NaN, "v": "\\u00e9"}', "{", None, '{"k": 1, "k": {"v": 123456789012345678901}}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, doc string")
    k, v = tree.HasKey("k"), tree.HasKey("v")
    conditions = [k, ~k, tree.Yes(), k & tree.HasDescendant(v), tree.HasAncestor(k) & ~tree.IsList(), tree.IsDictionary() | tree.IsRoot(), tree.PathEndsIn(["b", "0"]), tree.PathEndsIn([]), k.xor(v), tree.HasDescendant(~tree.IsDictionary()), tree.HasDescendant(tree.HasAncestor(k))]
    for c in conditions:
        for chain in (tree.go_down(c, "x"), tree.stay_here("r").then(tree.go_down(k, "x")).then(tree.go_up(c, "y")), tree.go_down(c, "x").then(tree.go_down(v, "y")), tree.stay_here("x", c), tree.go_down(tree.Yes(), "x").then(tree.go_up(~c, "y"))):
            last = "y" if len(chain.all_traversals()) > 1 else "x"
            r = tree.Relation("r", chain, {"node": ("x", ()), "k": ("x", ("k",)), "v": (last, ("k", "v")), "n_of": (last, ("v",))}, {"n_of": "double"})
            now = r.to_df(df, "doc", ["n"])
            assert "nid" not in now._jdf.queryExecution().analyzed().toString() and "c0" in now._jdf.queryExecution().analyzed().toString()
            with monkeypatch.context() as m:
                m.setattr(tree, "_own", lambda steps: False)
                then = r.to_df(df, "doc", ["n"])
            if c in conditions[::3]:
                assert sorted(map(repr, now.collect())) == sorted(map(repr, then.collect())), (c, chain)
