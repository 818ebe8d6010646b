import pytest
from pyspark.sql import functions as F

from flowtree.llm import decontaminate, fingerprints, neardup, tiles
from flowtree.llm.components import components

from . import brute


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def all_pairs(texts):
    return brute.pairs_at_least(texts, 3, 0.6)


@pytest.fixture
def little_tiles(monkeypatch):
    """Tiles of about four documents, so that buckets and components of more are cut."""
    for module in (tiles, fingerprints, neardup):
        monkeypatch.setattr(module, "TILE", 4)


def test_near_duplicates_against_all_pairs(docs, texts, all_pairs):
    got = {r.doc_id: r for r in neardup.groups(docs).collect()}
    want = brute.groups(texts, all_pairs)
    assert set(got) == set(texts) and all(r.keep == (r.group_id == i) for i, r in got.items())
    grouped = [i for i in texts if want[i] != i]
    assert len(grouped) > 20 and sum(got[i].group_id == want[i] for i in grouped) >= 0.98 * len(grouped)
    assert all(want[i] == want[r.group_id] for i, r in got.items())  # and nothing is joined that isn't similar
    left = {r.doc_id for r in neardup.deduplicate(docs).collect()}
    assert left == {i for i, r in got.items() if r.keep}


def test_near_duplicates_in_little_tiles(docs, texts, all_pairs, little_tiles):
    got = {r.doc_id: r.group_id for r in neardup.groups(docs).collect()}
    want = brute.groups(texts, all_pairs)
    grouped = [i for i in texts if want[i] != i]
    assert set(got) == set(texts) and sum(got[i] == want[i] for i in grouped) >= 0.98 * len(grouped) and all(want[i] == want[g] for i, g in got.items())


def test_texts_that_share_an_id(spark):
    one = "a text of some words that stand in it once and only once so that it has shingles"
    near, other = one + " again", "quite another text of other words under the very same number as before"
    rows = [(1, one, "x"), (2, near, "x"), (2, other, "x"), (2, other, "y"), (3, None, "x"), (3, None, "x"), (4, "", "x"), (None, one, "x"), (None, one, "x"), (2, near, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone string").withColumn("__again", F.lit(1)).withColumn("n", F.lit(None).cast("int"))
    results = []
    for parts in (1, 5):
        left = neardup.deduplicate(df.repartition(parts))
        assert left.columns == df.columns
        results.append(sorted((tuple(r)[:3] for r in left.collect()), key=str))
    assert results[0] == results[1] and [(r[0], r[1]) for r in results[0]].count((2, other)) == 1
    kept = [(r[0], r[1]) for r in results[0]]
    # which of the texts of 2 is compared goes by their hashes; that one is a near copy, or stays
    assert sorted(kept, key=str) in [sorted([*base, (1, one), (2, other), (3, None), (4, ""), (None, one), (None, one)], key=str) for base in ([], [(2, near)])]


def test_near_duplicates_of_odd_rows(odd, none):
    got = {r.doc_id: (r.group_id, r.keep) for r in neardup.groups(odd).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True), 8: (1, False)}
    left = neardup.deduplicate(odd)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, None, None], key=str)
    assert neardup.groups(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_sequential_bounds():
    least = neardup.least_matches(128, 0.6, 0.01, 16)
    assert [n for n, _ in least] == list(range(16, 129, 16)) and all(0 < m < n for n, m in least)
    stricter = neardup.least_matches(128, 0.6, 0.2, 16)
    assert all(a[1] <= b[1] for a, b in zip(least, stricter))


def test_many_copies_in_one_bucket(spark):
    base = "the quick brown fox jumps over a lazy dog near the river bank while birds sing songs of summer and rain falls on the old stone bridge"
    df = spark.createDataFrame([(i, base + (f" tail{i % 7}" if i % 2 else "")) for i in range(3000)], "doc_id long, text string")
    got = neardup.groups(df).groupBy("group_id").count().collect()
    assert [(r.group_id, r["count"]) for r in got] == [(0, 3000)]


def test_tens_of_thousands_of_copies(spark):
    text = "one page that a third of all hosts have under another address with the very same words in it"
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 7, F.concat(F.lit(text), F.lit(" and "), F.col("id"))).otherwise(F.lit(text)).alias("text"))
    got = neardup.groups(df).groupBy("group_id").count().collect()
    assert [(r.group_id, r["count"]) for r in got] == [(0, 50_000)]
    rows = fingerprints.classes(df).agg(F.count("doc_id"), F.countDistinct("class_id"), F.max("copies"), F.countDistinct("group_id"), F.max("links"), F.min("links")).first()
    assert tuple(rows) == (50_000, 1001, 49_000, 1, 1000, 1000)


def test_near_duplicates_in_a_family_that_is_less_alike(spark):
    shared = " ".join(f"s{i}" for i in range(222))
    n, planted = 600, {2 * k: 25 + k % 8 for k in range(100)}  # words that 2k and 2k + 1 have in common besides
    texts = {i: f"{shared} " + " ".join(f"p{i // 2}x{j}" if j < planted.get(i - i % 2, 0) else f"d{i}x{j}" for j in range(90)) for i in range(n)}
    some = [brute.jaccard(*(brute.shingles(texts[i], 3) for i in p)) for p in ((0, 1), (14, 15), (0, 2), (500, 501))]
    assert 0.65 <= some[0] < some[1] < 0.8 and 0.5 < some[2] < 0.56 and 0.5 < some[3] < 0.56
    got = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[i + 1] == i for i in planted) >= 97
    assert all(got[i] == i or i - 1 in planted for i in texts)


def test_fingerprints_against_all_pairs(docs, texts):
    want = set(brute.pairs_at_least(texts, 3, 0.7))
    rows = fingerprints.expanded(fingerprints.similar(docs)).collect()
    got = {(r.doc_a, r.doc_b): r.jaccard for r in rows}
    assert len(want & set(got)) >= 0.98 * len(want) and set(got) <= want and len(got) == len(rows)


def classes_by_brute_force(texts, pairs):
    """{doc_id: (class_id, copies, links, group_id)} from all pairs of documents."""
    sets = {i: frozenset(brute.shingles(t, 3)) for i, t in texts.items()}
    members = {}
    for i in sorted(texts):
        members.setdefault(sets[i] or i, []).append(i)
    first = {i: m[0] for m in members.values() for i in m}
    links = {tuple(sorted((first[a], first[b]))) for a, b in pairs if first[a] != first[b]}
    group = brute.groups(set(first.values()), links)
    count = dict.fromkeys(first.values(), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (c, len(members[sets[i] or i]), count[c], group[c]) for i, c in first.items()}


@pytest.mark.parametrize("tile", [4, 1024])
def test_classes_against_all_pairs(docs, texts, tile, monkeypatch):
    for module in (tiles, fingerprints):
        monkeypatch.setattr(module, "TILE", tile)
    want = classes_by_brute_force(texts, brute.pairs_at_least(texts, 3, 0.7))
    rows = fingerprints.classes(docs).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(got) and set(got) == set(texts)
    assert all(got[i][:2] == want[i][:2] and got[i][2] <= want[i][2] for i in texts)
    assert sum(x[2] for x in got.values()) >= 0.98 * sum(x[2] for x in want.values()) > 0
    assert sum(got[i][3] == want[i][3] for i in texts) >= 0.99 * len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in fingerprints.classes(docs.repartition(7)).collect()} == got


def test_classes_of_odd_rows(odd, none):
    got = {r.doc_id: tuple(r)[1:] for r in fingerprints.classes(odd).collect()}
    assert got == {i: (i, 1, 0, i) for i in (2, 3, 4, 5, 6, 7)} | {1: (1, 2, 0, 1), 8: (1, 2, 0, 1)} and fingerprints.classes(none).count() == 0


def test_fingerprints_of_odd_rows(odd, none):
    assert [tuple(r) for r in fingerprints.similar(odd).collect()] == [(1, 8, 1.0)] and fingerprints.similar(none).count() == 0


def test_decontamination_against_brute_force(spark, docs, texts):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = {(d, r.item_id): c for r in items.collect() for d, t in texts.items() if (c := brute.containment(t, r.text, decontaminate.WORDS)) >= decontaminate.THRESHOLD}
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(docs, items).collect()}
    assert want and len(set(want) & set(got)) >= 0.98 * len(want) and set(got) <= set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    joined = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(docs, items, broadcast_bytes=0).collect()}
    assert joined == got
    left = {r.doc_id for r in decontaminate.remove(docs, items).collect()}
    assert left == set(texts) - {d for d, _ in got} == {r.doc_id for r in decontaminate.remove(docs, items, broadcast_bytes=0).collect()}


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_decontamination_of_odd_rows(spark, odd, none, limit):
    items = spark.createDataFrame([(1, "plain words that say nothing much at all here"), (1, "plain words that say nothing much at all here"), (2, None), (3, ""), (None, "one"), (4, "one"), (5, "w1 v1 w2 v2 w3 v3 w4 v4"), (6, "plain words that say nothing much at all here")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(odd, items, broadcast_bytes=limit).collect())
    assert got == [(1, 1, 1.0), (1, 6, 1.0), (4, 5, 1.0), (7, 4, 1.0), (8, 1, 1.0), (8, 6, 1.0)]
    left = decontaminate.remove(odd, items, broadcast_bytes=limit)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect() if r.doc_id)) == [2, 3, 5, 6]
    assert decontaminate.contaminated(none, items, broadcast_bytes=limit).count() == 0 and decontaminate.remove(odd, items.limit(0), broadcast_bytes=limit).count() == odd.count()


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_decontamination_of_rows_that_share_an_id_or_have_none(spark, limit):
    bad, good = "plain words that say nothing much at all here", "other words of nobody in no item there"
    rows = [(1, bad), (1, good), (2, good), (None, bad), (None, good), (None, None), (3, f"{good} {bad}"), (3, bad), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit("x"))
    items = spark.createDataFrame([(1, bad)], "item_id long, text string")
    left = sorted((tuple(r)[:2] for r in decontaminate.remove(docs, items, broadcast_bytes=limit).collect()), key=str)
    assert left == sorted([(1, good), (2, good), (None, good), (None, None), (3, None)], key=str)
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, items, broadcast_bytes=limit).collect()) == [(1, 1, 1.0), (3, 1, 1.0)]


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2), (2, None)], [(i, i + 1) for i in range(40)], [(5, 3), (3, 5), (9, 8), (8, 7), (3, 1)]])
def test_components(spark, edges):
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == brute.groups({x for e in real for x in e}, real)
