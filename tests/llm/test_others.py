import base64
import importlib
import json
import random

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowtree.llm import chat, licenses, mixing, tokencount, urlfilter

from . import brute


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    rel = con.execute(query)
    names = [d[0] for d in rel.description]
    return sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in rel.fetchall()), key=str)


# token counts


@pytest.fixture(scope="module")
def encoding():
    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_of_whole_documents(spark, docs, encoding):
    want = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()} == want


def test_token_counts_of_random_text(encoding):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeioustrn  '\n12,.üß漢🙂 ") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 5000, "ab" * 400, " " * 999, "<|endoftext|>", ""]
    assert tokencount.Counter(tokencount.vocabulary()).count(texts) == [len(encoding.encode_ordinary(t)) for t in texts]


def test_token_counts_of_long_pre_tokens(encoding):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ACGT", 100_000), ("漢字仮名交", 4000), ("-", 999), ("0", 1000))] + ["".join(rng.choice("abcdefg") for _ in range(rng.randint(257, 600))) for _ in range(100)]
    pairs = tokencount.vocabulary()
    assert tokencount.Counter(pairs).count(texts) == [len(encoding.encode_ordinary(t)) for t in texts]
    words = [b"over and over the rivers" * 20, b"zzzzzzz" * 50]
    assert tokencount.linked(words, pairs).tolist() == [tokencount.one_by_one(w, pairs) for w in words]


def test_a_merge_that_makes_a_lower_rank_is_counted_singly():
    ranks = {bytes([b]): b for b in range(256)} | {b"aab": 300, b"ab": 400, b"ba": 500}
    names = list(ranks)
    keys = {(ranks[t[:k]] << 20 | ranks[t[k:]]): ranks[t] for t in names for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    import numpy as np

    order = sorted(keys)
    pairs = tokencount.Pairs(np.array(order), np.array([keys[k] for k in order]), np.arange(256))
    for word in (b"aabab" * 80, b"abaab" * 77, b"ba" * 200):
        assert tokencount.linked([word], pairs)[0] == tokencount.one_by_one(word, pairs)


def test_token_counts_of_odd_rows(odd, none):
    got = rows(tokencount.token_counts(odd))
    assert len(got) == odd.count() and (2, None) in got and (3, 0) in got and tokencount.token_counts(none).count() == 0


# mixing


def test_schedule_matches_sql(odd, docs):
    for df in (odd, docs):
        assert rows(mixing.schedule(df, block_tokens=64)) == sql(mixing.sql("d", 64), d=df.select("doc_id", "source", "text"))


def test_schedule_keeps_to_weights_and_blocks(docs):
    weights = {"web": 3.0, "books": 1.0}
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    weights = {s: w for s, w in zip(sources, (3.0, 1.0, 0.0))}
    got = mixing.schedule(docs, weights, block_tokens=128).toPandas()
    per = got.groupby("slot").agg(source=("source", "first"), n=("source", "nunique"), tokens=("tokens", "sum"))
    assert per.n.max() == 1 and set(per.source) == set(sources[:2]) and per.tokens.max() == 128
    counts = per.source.value_counts()
    assert abs(counts[sources[0]] / len(per) - 0.75) < 0.01
    running = (per.source == sources[0]).cumsum() / range(1, len(per) + 1)
    assert abs(running.iloc[50:] - 0.75).max() < 0.08  # any stretch, not just the whole


def test_points_of_any_slot(spark):
    slots = [0, 1, 5, 2**32 - 1, 2**32, 3_474_701_533, 3_474_701_534, 10**12, 10**15 + 7]
    got = [r[0] for r in spark.createDataFrame([(k, i) for k, i in enumerate(slots)], "k long, slot long").orderBy("k").select(mixing.points(F.col("slot"))).collect()]
    assert got == [i * 2654435769 % 2**32 for i in slots]
    late = spark.range(3_474_701_533, 3_474_711_533).withColumnRenamed("id", "slot")
    totals = spark.createDataFrame([("a", 30, 3), ("b", 10, 1)], "source string, n long, blocks long")
    got = dict(map(tuple, mixing.drawn(late, mixing.spans(totals, None, 1.0), 2).groupBy("source").count().collect()))
    assert abs(got["a"] - 7500) < 10 and abs(got["b"] - 2500) < 10


def test_schedule_of_ten_thousand_sources(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 10_000).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")).alias("text"))
    assert rows(mixing.schedule(docs, block_tokens=4)) == sql(mixing.sql("d", 4), d=docs)


def test_schedule_of_nothing(none, odd):
    assert mixing.schedule(none).count() == 0 and mixing.schedule(odd, {"nowhere": 1.0}).count() == 0


# URL filters


def test_url_filter_against_brute_force(spark):
    pages = spark.createDataFrame(
        [(1, "http://www.a.example/x/", '<link rel="canonical" href="https://b.example/y">'), (2, "https://b.example/y#top", None), (3, "http://c.example/?utm_source=q", '<meta http-equiv="refresh" content="0; url=http://b.example/y">'),
         (4, "http://ok.example/1", '<link rel="canonical" href="/2">'), (5, "http://sub.bad.example/z", ""), (6, None, None), (7, "", "x"), (8, "http://other.example/", "x"), (2, "https://b.example/y#top", None), (None, "http://d.example/q", None)],
        "page_id long, url string, html string",
    )
    rules = spark.createDataFrame([("block", "domain", "b.example"), ("block", "domain", "bad.example"), ("block", "url", "http://ok.example/2"), ("allow", "domain", "ok.example"), ("block", "domain", None), (None, "url", "x")], "decision string, kind string, value string")
    redirects = spark.createDataFrame([("http://d.example/q", "http://e.example/r"), ("http://e.example/r", "http://c.example/"), (None, "http://f.example"), ("http://g.example", None)], "from_url string, to_url string")
    got = sorted(((r.page_id, r.decision) for r in urlfilter.decide(pages, rules, redirects).collect()), key=str)
    assert got == sorted([(1, "block"), (2, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "block"), (6, "none"), (7, "none"), (8, "none"), (None, "block")], key=str)
    assert urlfilter.decide(pages.limit(0), rules).count() == 0 and urlfilter.decide(pages, rules.limit(0)).where("decision <> 'none'").count() == 0


def test_tracking_parameters_leave_the_others(spark):
    same = ["h.example/p?id=5", "http://h.example/p?utm_source=x&id=5", "http://h.example/p?id=5&ref=x", "https://h.example/p?fbclid=1&utm_medium=2&id=5&gclid=3#top"]
    cases = [*((u, "h.example/p?id=5") for u in same), ("h.example/p?a=1&ref=x&b=2", "h.example/p?a=1&b=2"), ("h.example/p/?utm_source=x", "h.example/p"), ("h.example/?href=1", "h.example/?href=1")]
    got = [r[0] for r in spark.createDataFrame([(k, u) for k, (u, _) in enumerate(cases)], "k long, u string").orderBy("k").select(urlfilter.normal(F.col("u"))).collect()]
    assert got == [n for _, n in cases]


def test_normal_forms(spark):
    cases = [
        ("http://h.example/p?page=1", "h.example/p?page=1"), ("http://h.example/p?page=2", "h.example/p?page=2"), ("http://m.example/x", "m.example/x"), ("http://www.example", "www.example"), ("https://m.a.example/x", "a.example/x"),
        ("HTTPS://me:secret@WWW.A.example:443/X/", "a.example/X"), ("h.example/?q=a/index.html", "h.example/?q=a/index.html"), ("h.example/d/index.html?ref=1", "h.example/d"), ("h.example:8080/x.htm#y", "h.example:8080/x"), ("//h.example//", "h.example"),
        ("h.example/?a=http://x.example/?b=1", "h.example/?a=http://x.example/?b=1"), ("?", None), ("  ", None), ("h.example?&&", "h.example"), ("a@b.example/c@d", "b.example/c@d"),
    ]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(cases)], "page_id long, url string")
    assert [r[0] for r in df.orderBy("page_id").select(urlfilter.normal(F.col("url"))).collect()] == [n for _, n in cases]
    pages = df.withColumn("html", F.lit(None).cast("string"))
    assert {(i, c) for c, _, i, _ in rows(urlfilter.decide(pages, spark.createDataFrame(urlfilter.RULES, "decision string, kind string, value string")))} == {(k, n) for k, (_, n) in enumerate(cases)}
    assert {(i, c) for c, _, i, _ in sql(urlfilter.sql("p"), p=pages)} == {(k, n) for k, (_, n) in enumerate(cases)}


def test_random_graphs_of_redirects(spark):
    rng = random.Random(8)
    for n, m in ((40, 25), (60, 70)):
        edges = [(f"h{rng.randrange(n)}.example", f"h{rng.randrange(n)}.example") for _ in range(m)]
        rules = [(rng.choice(["allow", "block"]), f"h{rng.randrange(n)}.example") for _ in range(8)]
        group = brute.groups([f"h{i}.example" for i in range(n)], [e for e in edges if e[0] != e[1]])
        members = {}
        for i, g in group.items():
            members.setdefault(g, set()).add(i)
        want = {}
        for i in range(n):
            said = {d for d, h in rules if h in members[group[f"h{i}.example"]]}
            want[i] = "allow" if "allow" in said else "block" if said else "none"
        pages = spark.createDataFrame([(i, f"http://h{i}.example/") for i in range(n)], "page_id long, url string").withColumns({"html": F.repeat(F.lit("long text without a link "), 9999), "node": F.lit(1), "bare": F.lit(2), "component": F.lit(3), "decision": F.lit(4)})
        half = len(edges) // 2
        tagged = spark.createDataFrame([(1000 + k, f"http://{a}", f'<link rel="canonical" href="http://{b}/">') for k, (a, b) in enumerate(edges[:half])], "page_id long, url string, html string")
        got = urlfilter.decide(pages.select("page_id", "url", "html", "node", "bare", "component", "decision").unionByName(tagged, allowMissingColumns=True), spark.createDataFrame([(d, "domain", h) for d, h in rules], "decision string, kind string, value string"), spark.createDataFrame(edges[half:], "from_url string, to_url string"))
        assert got.columns == ["page_id", "url", "component", "decision"] and {r.page_id: r.decision for r in got.collect() if r.page_id < 1000} == want


def test_url_redirects_match_sql(spark):
    from flowtree.llm import queries

    got = rows(urlfilter.url_redirects(spark, brute.SF))
    assert got == sql(queries.ORACLE["url_redirects"]) and {"allow", "block", "none"} == {r[1] for r in got}


def test_relative_links_stay_on_their_site(spark):
    tag = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://one.example/a/b", tag.format("index.html")), (2, "http://two.example/a/b", tag.format("index.html")), (3, "http://one.example/a", ""), (4, "http://two.example/d/e/f", tag.format("../x")), (5, "http://two.example/d/x", ""),
        (6, "http://six.example/p?q=1", tag.format("?id=3")), (7, "http://six.example/p?id=3", ""), (8, "http://six.example/8", "<link href=/nine rel=canonical>" + '<meta http-equiv=refresh content="0; url=ten">' + tag.format("//six.example/eleven?a=1&amp;b=2")),
        (9, "http://six.example/nine", ""), (10, "http://six.example/ten", ""), (11, "http://six.example/eleven?a=1&b=2", ""), (12, "http://six.example/12", "<!-- " + tag.format("nine") + " -->" + tag.format("mailto:canonical@six.example")),
        (13, "http://six.example/13", '<base href="/sub/">' + tag.format("y")), (14, "http://six.example/sub/y", ""),
    ]
    rules = spark.createDataFrame([("block", "domain", "one.example")], "decision string, kind string, value string")
    got = {r.page_id: r for r in urlfilter.decide(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert [i for i, r in got.items() if r.decision == "block"] == [i for i in got if i in (1, 3)]
    sets = sorted(sorted(i for i, r in got.items() if r.component == c) for c in {r.component for r in got.values()})
    assert sets == [[1, 3], [2], [4, 5], [6, 7], [8, 9, 10, 11], [12], [13, 14]]


def test_url_filter_matches_sql(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert rows(urlfilter.decide(pages, spark.createDataFrame(urlfilter.RULES, "decision string, kind string, value string"))) == sql(urlfilter.sql("p"), p=pages)


# licences


def test_licences_in_any_spelling(spark):
    mit = dict(licenses.known_texts())["MIT"]
    body = next(t for n, t in licenses.known_texts() if n == "MIT")
    cases = {1: body, 2: "Copyright (c) 2020 Someone\n\n" + body.upper(), 3: body.replace("sublicense", "sub-license").replace("MERCHANTABILITY", "merchantibility").replace("\n\n", "\r\n  \r\n"), 9: "Some words.\n\nReleased under the MIT License.\n\nMore words.", 10: "Some words.\n\n" + body, 4: "The MIT licence is nice.", 5: None, 6: "", 7: "// SPDX-License-Identifier: Apache-2.0\ncode();", 8: "Copyright 2020 Me"}
    assert mit
    df = spark.createDataFrame([*cases.items(), (1, body), (None, body)], "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("license", F.lit("y"))
    got = licenses.scan(df)
    hit = {(r.doc_id, r.license) for r in got.collect()}
    # a licence of several paragraphs is looked up as an entire text, so that of 10 isn't found
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (9, "MIT"), (7, "Apache-2.0")} == hit


def test_entire_licences_and_identifiers(spark):
    shared = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {name: open(f"{shared}/{file}").read() for name, file in files.items()}
    cases = list(texts.items())
    cases += [("Apache-2.0", texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Someone")), ("Apache-2.0", texts["Apache-2.0"].split("   APPENDIX")[0]), ("GPL-3.0", texts["GPL-3.0"].split("How to Apply")[0])]
    ids = {"BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "0BSD": "0BSD", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "LGPL-2.1-or-later": "LGPL-2.1", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-ND-3.0": "CC-BY-NC-ND-3.0", "CC0-1.0": "CC0-1.0"}
    cases += [(name, f"# SPDX-License-Identifier: {i}\ncode()") for i, name in ids.items()]
    cases += [("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-NC-4.0", "Words.\n\nThis work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.")]
    cases += [(None, texts["GPL-3.0"].replace("free", "costly")), (None, "SPDX-License-Identifier: GPL-9.0")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")).where("scope <> 'paragraph'").collect()}
    whole = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")).where("scope = 'document'").collect()}
    assert {(k, name) for k, (name, _) in enumerate(cases) if name} <= got and {(k, name) for k, (name, _) in enumerate(cases[:10])} <= whole
    assert not {d for d, _ in whole} & {k for k, (name, _) in enumerate(cases) if not name}


def test_licences_with_copyright_lines_of_any_kind(spark):
    texts = dict((n, t) for n, t in reversed(licenses.known_texts()))
    heads = ["Copyright Jane Doe\n\n", "Copyright (c) 2019-2021, Some Company Inc.\nAll rights reserved.\n\n", "© Jane\n", "# Copyright: The Foo Authors\n", "All rights reserved.\n"]
    cases = [("MIT", h + texts["MIT"]) for h in heads] + [("BSD-3-Clause", h + texts["BSD-3-Clause"]) for h in heads]
    cases += [("Unlicense", texts["Unlicense"]), ("GPL-3.0", "GNU General Public License v3.0"), ("CC0-1.0", "Licensed under CC0 1.0 Universal."), ("Unlicense", "SPDX-License-Identifier: Unlicense")]
    # lines of the licence itself that begin with the word aren't dropped
    wrapped = texts["BSD-2-Clause"].replace("must retain the above copyright notice", "must retain the above\ncopyright notice")
    cases += [("BSD-2-Clause", wrapped)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(df).where("scope = 'document' or scope = 'line'").collect()}
    assert {(k, n) for k, (n, _) in enumerate(cases)} <= got
    assert rows(licenses.scan(df)) == sql(licenses.sql("d"), d=df)


def test_licences_of_a_table_of_any_size(spark, docs, monkeypatch):
    known = spark.createDataFrame(licenses.known(), "digest string, license string, size int, first string")
    few = docs.where("doc_id % 10 = 3")
    want = rows(licenses.scan(few))
    assert want and rows(licenses.scan(few, known)) == want
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 10)
    assert rows(licenses.scan(few, known)) == want


def test_licences_of_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    mit = next(t for n, t in licenses.known_texts() if n == "MIT")
    long = "word " * 300_000 + "\n\nReleased under the MIT License.\n\n"
    some = odd.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(mit)).when(F.col("doc_id") == 4, F.lit(long)).otherwise(F.col("text")))
    got = sorted(tuple(r) for r in licenses.scan(some).where("scope <> 'line'").collect())
    assert got == [(1, "document", "MIT", 2), (4, "paragraph", "MIT", 1)]  # of repeated rows the parts add up


# chat


TOOLS = json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}}}]})


def call(i, name, arguments):
    return json.dumps({"content": "c", "tool_calls": [{"id": i, "name": name, "arguments": arguments}]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_tool_calls_are_linked_ordered_and_checked(spark):
    data = [
        (1, 0, "system", TOOLS), (1, 1, "tool", result("a", "3")), (1, 2, "assistant", call("a", "add", {"x": 1})), (1, 3, "assistant", call("b", "add", {"x": -1})), (1, 4, "assistant", call("c", "sub", {})), (1, 5, "tool", result("zz", "?")),
        (1, 2, "assistant", call("a", "add", {"x": 1})), (2, None, None, None), (2, 0, "user", "{not json"), (None, 1, "user", "x"), (3, 0, "user", ""),
    ]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("calls", F.lit(2))).collect()}
    r = got[1]
    assert set(got) == {1, 2, 3} and (r.n_messages, r.n_calls, r.n_linked, r.n_unlinked, r.n_invalid) == (6, 3, 1, 3, 2)
    messages = json.loads(r.messages)["messages"]
    assert [m["role"] for m in messages[:3]] == ["system", "assistant", "tool"] and messages[1]["tool_calls"][0]["result"] == "3" and messages[2]["tool_call_id"] == "a"
    assert r.messages == json.dumps(json.loads(r.messages), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[2].messages)["messages"] == [{"content": "{not json", "role": "user"}, {"content": None, "role": None}]


def test_chat_round_trip_and_empty(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r.conv_id: [(m["role"], m["content"]) for m in json.loads(r.messages)["messages"]] for r in chat.formatted(conv).collect()}
    want: dict = {}
    for r in sorted(conv.distinct().collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want and chat.formatted(conv.limit(0)).count() == 0


def deep(n):
    return '{"a":' * n + "1" + "}" * n


@pytest.mark.parametrize(
    "schema, arguments, good",
    [
        ({"required": True}, {"x": 1}, False), ({"type": 5}, {}, False), ({"type": [5]}, {}, False), ({"enum": 5}, {}, False), ({"properties": None}, {"x": 1}, False), ({"properties": {"x": {"minimum": "a"}}}, {"x": 1}, False),
        ({"properties": {"x": {"minLength": None}}}, {"x": "a"}, False), ({"properties": {"x": {"pattern": "("}}}, {"x": "a"}, False), ({"properties": {"x": 7}}, {"x": "a"}, False), ({"anyOf": []}, {}, False),
        ({"properties": {"x": {"type": "integer"}}}, '{"x": ' + "9" * 400 + "}", True), ({}, deep(3000), False), ({}, '{"x": NaN}', False), ({}, '{"x": 1e999}', False), ({}, '{"x": "\\ud800"}', True), ({}, deep(100), True),
        ({"properties": {"x": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}, {"x": 1}, False), ({"properties": {"x": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}, {"x": None}, True), ({"oneOf": [{}, {}]}, {}, False),
        ({"properties": {"x": {"exclusiveMinimum": 1}}}, {"x": 1}, False), ({"properties": {"x": {"exclusiveMaximum": 2}}}, {"x": 1}, True), ({"properties": {"x": {"pattern": "^a+$"}}}, {"x": "ab"}, False), ({"properties": {"x": {"pattern": "^a+$"}}}, {"x": "aa"}, True),
        ({"properties": {"x": {"minItems": 2}}}, {"x": [1]}, False), ({"properties": {"x": {"maxItems": 2}}}, {"x": [1, 2]}, True), ({"not": {"required": ["x"]}}, {"x": 1}, False), ({"additionalProperties": False, "properties": {"y": {}}}, {"x": 1}, False),
    ],
)
def test_schemas_and_arguments_of_any_kind(schema, arguments, good):
    text = arguments if isinstance(arguments, str) else json.dumps(arguments)
    c = {"nth": 0, "id": "a", "name": "f", "arguments": text, "result": None, "linked": False, "schema": json.dumps(schema), "declared": True}
    message = {"m": 1, "turn": 0, "role": "assistant", "text": "", "content": "c", "result_of": None, "calling": True}
    got = chat.conversation(1, [message], [{"m": 1, "calls": [c]}])
    assert got["n_invalid"] == (not good) and got["n_calls"] == 1
    read = json.loads(got["messages"].encode(), parse_constant=lambda x: pytest.fail(x))
    assert ("errors" in read["messages"][0]["tool_calls"][0]) == (not good)


def test_hostile_calls_in_spark(spark):
    data = [
        (1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"required": True, "type": 5}}]})), (1, 1, "assistant", call("a", "f", {"x": 1})), (1, 2, "assistant", call("b", "f", '{"x": "\\ud800"}')),
        (1, None, "tool", result("a", "late")), (1, 3, "tool", result("a", "early")), (2, 0, "assistant", call("z", "f", deep(3000))), (2, 1, "user", '{"content": "\\ud800", "tool_call_id": "z"}'), (2, 2, "user", "{" * 5000),
    ]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_calls, got[1].n_linked, got[1].n_invalid) == (2, 1, 2) and (got[2].n_messages, got[2].n_calls) == (3, 1)
    assert next(c for m in json.loads(got[1].messages)["messages"] for c in m.get("tool_calls", []) if c["id"] == "a")["result"] == "early"


def test_tool_calls_match_sql(spark):
    from flowtree.llm import queries

    assert rows(chat.chat_tool_calls(spark, brute.SF)) == sql(queries.ORACLE["chat_tool_calls"])


def test_reference_cycles_are_cut():
    assert chat.topological([{1}, {0}, set()]) == ([2, 0, 1], 1) and chat.topological([set(), {2}, set()]) == ([0, 2, 1], 0)


# the pipeline


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_each_work_on_what_the_last_one_kept(spark, pipeline):
    from flowtree.llm import decontaminate, neardup, quality, toxicity

    d = brute.SF
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, labels)
    gone = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("toxic").collect()}
    left = set(held) - gone
    one = docs.where(~F.col("doc_id").isin(list(gone) or [-1]))
    model = quality.train(one, labels)
    left &= {r.doc_id for r in quality.score_quality(one, model).where("keep").collect()}
    group = brute.groups(left, brute.pairs_at_least({i: held[i] for i in left}, neardup.SCHEME.words, neardup.THRESHOLD))
    left = {i for i in left if group[i] == i}
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    left = {i for i in left if not any(brute.containment(held[i], x.text, decontaminate.WORDS) >= decontaminate.THRESHOLD for x in items)}
    stages = docs
    for name, f in pipeline.STAGES[:-1]:
        stages = f(spark, stages, d)
        assert stages.columns == docs.columns, name
    got = {r.doc_id for r in stages.collect()}
    assert len(got ^ left) <= 0.03 * len(left) and len(left) < len(held)
    out = pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= got and out.count() > 0


def test_stages_take_odd_rows(spark, pipeline, odd):
    """Nulls in every column, empty and long texts, repeated rows, and columns of names that the stages use themselves."""
    docs = odd
    for name, f in pipeline.STAGES[:-1]:
        left = f(spark, docs, brute.SF)
        assert left.columns == odd.columns, name
        assert {tuple(r) for r in left.collect()} <= {tuple(r) for r in docs.collect()}
    out = pipeline.STAGES[-1][1](spark, odd, brute.SF)
    assert 4 in {r.doc_id for r in out.collect()} <= {1, 4, 6, 7, 8}  # those with a token, as their sources' shares of the slots go


def test_stages_take_empty_tables(spark, pipeline, none):
    docs = none.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.lit(0).cast("long"))
    for _, f in pipeline.STAGES:
        assert f(spark, docs, brute.SF).count() == 0


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names and set(entry.oracle_sql()) <= set(names)
