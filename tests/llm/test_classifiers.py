import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtree.llm import quality, toxicity


@pytest.fixture(scope="module")
def halves(spark):
    """Labelled documents of sf0.1, in two halves by hash."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    side = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    return docs, labels.where(side == 0), labels.where(side == 1)


def accuracy(scored, held, column, decision):
    rows = scored.join(held.select("doc_id", F.col(column).alias("label")), "doc_id").select(F.col("label").cast("int").alias("y"), F.col(decision).cast("int").alias("d")).toPandas()
    return (rows.d[rows.y == 1] == 1).mean(), (rows.d[rows.y == 0] == 0).mean()


def test_quality_on_held_out_documents(halves):
    docs, train, held = halves
    kept, rejected = accuracy(quality.score_quality(docs, quality.train(docs, train)), held, "quality", "keep")
    assert kept > 0.9 and rejected > 0.9


def test_toxicity_on_held_out_documents(halves):
    docs, train, held = halves
    found, clean = accuracy(toxicity.score_toxicity(docs, toxicity.train(docs, train)), held, "toxic", "toxic")
    # some 220 toxic documents to learn from, and about one toxic label in twenty is on a document without a toxic word
    assert found > 0.75 and clean > 0.99


def labelled(spark):
    texts = [("good words of a calm and careful writer", 1, 0), ("click buy now win free prize", 0, 1)] * 12
    docs = spark.createDataFrame([(100 + i, f"{t} {i}", "en") for i, (t, *_) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(100 + i, q, t) for i, (_, q, t) in enumerate(texts)] + [(None, 1, 1), (1, None, None), (2, 1, 0), (100, 1, 0), (7, 5, 5)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module, score, keep", [(quality, quality.score_quality, quality.filter_quality), (toxicity, toxicity.score_toxicity, toxicity.filter_toxic)])
def test_odd_rows(spark, odd, none, module, score, keep):
    docs, labels = labelled(spark)
    model = module.train(docs, labels)
    got = score(odd, model).collect()
    assert len(got) == odd.count() and score(none, model).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    decision = "keep" if module is quality else "toxic"
    assert not by[2][decision] and not by[3][decision]  # nothing to keep, and nothing toxic
    left = keep(odd, model)
    assert left.columns == odd.columns and left.count() == sum(r[decision] == (module is quality) for r in got)
    assert score(odd, model).orderBy("doc_id", "score").collect() == score(odd.repartition(5), model).orderBy("doc_id", "score").collect()


@pytest.mark.parametrize("module, score, keep", [(quality, quality.score_quality, quality.filter_quality), (toxicity, toxicity.score_toxicity, toxicity.filter_toxic)])
def test_without_labels_nothing_is_rejected(spark, odd, module, score, keep):
    docs, labels = labelled(spark)
    model = module.train(docs, labels.where("false"))
    assert model is None and keep(odd, model).count() == odd.count() and all(r.score is None for r in score(odd, model).collect())
    assert module.train(docs.limit(0), labels) is None


def test_quality_scores_are_sparse_dot_products():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.25, 0.0)
    texts = pa.array(["a b c, d!", "one", "x x x"])
    got = quality.margins(texts, model)
    for k in range(3):
        ((_, _, data, off),) = quality.blocks(texts.slice(k, 1))
        at, _ = quality.features(data, off)
        ids, tf = np.unique(at, return_counts=True)
        assert got[k] == pytest.approx(0.25 + float(model.weights[ids].astype(float) @ tf) / np.sqrt(tf.sum()), abs=1e-5)


def test_max_pooling_against_loops():
    import pyarrow as pa

    table = pa.table({"text": ["bad words here now", "calm good words of peace"] * 30, "lang": ["en", "de"] * 30, "y": [1, 0] * 30, "doc_id": list(range(60))})
    model = toxicity.fit(table)
    text = "some bad words here"
    ((_, _, data, off),) = toxicity.blocks(pa.array([text]))
    h, _, heads = toxicity.tokens(data, off, prefix=toxicity.HEAD_BYTES)
    x = np.hstack([model.word_vectors[toxicity._place(model.words, h)], model.head_vectors[toxicity._place(model.heads, heads)]])
    pooled = []
    for w, f in model.filters.items():
        pooled += [max(0.0, *(float(model.bias[w][c] + x[i : i + w].ravel() @ f[:, c]) for i in range(len(x) - w + 1))) for c in range(f.shape[1])]
    want = 1 / (1 + np.exp(-(np.array(pooled) @ model.out + model.out_bias)))
    assert toxicity.probabilities(pa.array([text]), model)[0] == pytest.approx(want, abs=1e-4)
    assert toxicity.probabilities(pa.array(["bad words here now"]), model)[0] > 0.5 > toxicity.probabilities(pa.array(["calm good words of peace"]), model)[0]


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 64, 9)), None) for _ in range(40)]
    rows = [(ids, rng.random(len(ids))) for ids, _ in rows]
    y, balance, order = rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.5, rng.integers(0, 40, 300)
    z, n = dict.fromkeys([*range(64), "bias"], 0.0), dict.fromkeys([*range(64), "bias"], 0.0)

    def weight(i):
        l1 = 0.0 if i == "bias" else quality.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for k in order:
        x = {**dict(zip(rows[k][0].tolist(), rows[k][1])), "bias": 1.0}
        w = {i: weight(i) for i in x}
        g = (1 / (1 + np.exp(-sum(w[i] * x[i] for i in x))) - y[k]) * balance[k]
        for i in x:
            sigma = ((n[i] + (g * x[i]) ** 2) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
            z[i] += g * x[i] - sigma * w[i]
            n[i] += (g * x[i]) ** 2
    weights, bias = quality.ftrl(rows, y, balance, order, bits=6)
    assert weights == pytest.approx([weight(i) for i in range(64)]) and bias == pytest.approx(weight("bias")) and 0 < np.count_nonzero(weights)


def test_gradients_against_differences():
    rng = np.random.default_rng(6)
    d, sizes = 5, np.array([4, 2, 7])
    model = toxicity.Model(None, None, None, None, {w: rng.normal(size=(w * d, 3)) for w in (1, 2, 3)}, {w: rng.normal(size=3) for w in (1, 2, 3)}, rng.normal(size=9), 0.2)
    x, y, weight = rng.normal(size=(13, d)), np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        rows, starts = np.repeat(np.arange(3), sizes), np.cumsum(sizes) - sizes
        total = 0.0
        for k, s in enumerate(starts):
            pool = [max(0.0, *(float(model.bias[w][c] + x[i : i + w].ravel() @ f[:, c]) for i in range(s, s + sizes[k] - w + 1))) if sizes[k] >= w else 0.0 for w, f in model.filters.items() for c in range(3)]
            m = float(np.array(pool) @ model.out + model.out_bias)
            total += weight[k] * (np.log1p(np.exp(m)) - y[k] * m)
        return total

    got = toxicity.gradients(model, x, sizes, y, weight)
    places = [(x, got["x"]), (model.out, got["out"]), *((model.filters[w], got[f"f{w}"]) for w in (1, 2, 3)), *((model.bias[w], got[f"b{w}"]) for w in (1, 2, 3))]
    for values, gradient in places:
        for at in rng.integers(0, values.size, 12):
            kept = values.flat[at]
            sides = []
            for e in (1e-4, -1e-4):
                values.flat[at] = kept + e
                sides.append(loss())
            values.flat[at] = kept
            assert gradient.flat[at] == pytest.approx((sides[0] - sides[1]) / 2e-4, abs=2e-3)


def test_thresholds_with_wrong_labels():
    rng = np.random.default_rng(2)
    clean, toxic = rng.uniform(0, 0.3, 156), rng.uniform(0.7, 1.0, 60)
    p, t = np.concatenate([clean, toxic]), np.arange(216) >= 156
    assert 0.3 < toxicity._threshold(p, t) <= 0.75
    p[:2] = 0.999, 0.97  # toxic texts labelled as clean
    assert 0.25 < toxicity._threshold(p, t) <= 0.75
    p[200:] = rng.uniform(0, 0.2, 16)  # clean texts labelled as toxic: no threshold is lowered to find them
    assert 0.25 < toxicity._threshold(p, t) <= 0.75


def test_languages_are_calibrated_apart():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = []
    for lang, bad, good in (("en", "awful", "lovely"), ("de", "furchtbar", "schön")):
        for i in range(400):
            y = i % 2
            words = [f"{lang}{rng.integers(0, 60)}" for _ in range(12)] + [bad if y else good]
            rows.append((" ".join(rng.permutation(words)), lang, y))
    rows += [("awful en1", "fr", 1), ("lovely en2", "fr", 0)]
    model = toxicity.fit(pa.table({"text": [r[0] for r in rows], "lang": [r[1] for r in rows], "y": [r[2] for r in rows]}))
    assert set(model.by_language) == {"en", "de"}
    p, toxic = toxicity.flags(pa.array(["this is awful", "this is lovely", "das ist furchtbar", "das ist schön", "awful en1"]), pa.array(["en", "en", "de", "de", None]), model)
    assert toxic.tolist() == [True, False, True, False, True]
    model.by_language = {"en": 2.0}
    assert toxicity.flags(pa.array(["awful", "awful"]), pa.array(["en", "xx"]), model)[1].tolist() == [False, True]


def test_samples_of_conflicting_labels_and_repeated_documents(spark):
    from flowtree.llm import labelled as samples

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")] * 50 + [(3, None), (None, "x")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (2, 0), (3, 1), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = [tuple(r) for parts in (1, 7) for r in samples.sample(docs.repartition(parts), labels.repartition(parts), "toxic").orderBy("doc_id").collect()]
    assert len(got) == 4 and got[:2] == got[2:] and [(r[0], r[3]) for r in got[:2]] == [(1, 1), (2, 0)]


@pytest.fixture(scope="module")
def many(spark):
    """More rows of each class than a sample would hold; each word w is in two of them, and a repeated document has another text."""
    rows = [(i, f"w{i // 4 * 2 + i % 2} {'awful' if i % 2 else 'lovely'} w{i // 4 * 2 + i % 2}", "en" if i % 5 else None) for i in range(7200)]
    docs = spark.createDataFrame([*rows, (8, "lovely again", "en"), (9, None, "en"), (None, "awful", "en"), (7300, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(7200)), (11, 0), (7300, 0), (9000, 1), (None, 1), (12, 7)], "doc_id long, toxic int")
    return docs, labels, len({r[1] for r in rows})


@pytest.mark.parametrize("shard", [toxicity.SHARD, 30_000])
def test_toxicity_learns_from_all_labelled_rows(many, shard):
    import pyarrow as pa

    docs, labels, words = many
    model = toxicity.train(docs, labels, shard)
    # both rows of a word are among the three in four that fit the model: 9 of 16; of 2,500 rows a class it would be 0.27
    assert 0.52 * words < len(model.words) < 0.61 * words
    assert set(model.by_language) == {"en"}
    assert toxicity.flags(pa.array(["w3 awful w3", "lovely w2", "awful unheard", "unheard lovely", "", None]), pa.array(["en", "en", None, "xx", "en", None]), model)[1].tolist() == [True, False, True, False, False, False]


def same(a, b):
    assert a.threshold == b.threshold and a.by_language == b.by_language and a.out_bias == b.out_bias and a.shifts == b.shifts
    for x, y in zip((a.words, a.heads, a.word_vectors, a.head_vectors, a.out, *a.filters.values(), *a.bias.values()), (b.words, b.heads, b.word_vectors, b.head_vectors, b.out, *b.filters.values(), *b.bias.values())):
        assert np.array_equal(x, y)


def test_shards_are_the_same_whatever_the_partitions_and_the_join(many, monkeypatch):
    from flowtree.llm import labelled as samples

    docs, labels, _ = many
    model = toxicity.train(docs, labels, 50_000)
    monkeypatch.setattr(samples, "COPIED", 100)
    same(model, toxicity.train(docs.repartition(7), labels.repartition(3), 50_000))


def test_words_beyond_the_most_share_vectors(many, monkeypatch):
    import pyarrow as pa

    docs, labels, words = many
    monkeypatch.setattr(toxicity, "MOST", 1024)
    model = toxicity.train(docs, labels, 50_000)
    assert 800 < len(model.words) <= 1024 < words and model.words.max() < 1024
    assert toxicity.flags(pa.array(["awful", "lovely"]), pa.array(["en", "en"]), model)[1].tolist() == [True, False]


def test_shards_without_both_classes_or_tokens_make_no_model(many, spark):
    docs, labels, _ = many
    assert toxicity.train(docs, labels.where("toxic = 0"), 50_000) is None
    assert toxicity.train(docs.withColumn("text", F.lit("... !!! ???")), labels, 20_000) is None
    one = toxicity.train(docs, labels.where("toxic = 0 or doc_id = 15"), 50_000)  # one toxic row: none can be held out
    assert one is not None and not one.by_language and 0 <= one.threshold <= 1


def test_thresholds_of_shards_come_from_all_held_out_rows(many):
    import pyarrow as pa

    docs, labels, _ = many
    docs = docs.where("doc_id between 10 and 7199")
    model = toxicity.train(docs, labels, 50_000)
    held = docs.join(labels.where("doc_id != 11 or toxic = 1"), "doc_id").where("pmod(xxhash64(doc_id, 2), 4) = 0 and toxic < 2").toPandas()
    threshold, by_language = toxicity._thresholds(toxicity.probabilities(pa.array(held.text), model), held.toxic.to_numpy() > 0, held.lang.where(held.lang.notna(), None).tolist())
    assert 1600 < len(held) < 2000 and model.threshold == pytest.approx(threshold, abs=1e-5) and model.by_language == pytest.approx(by_language, abs=1e-5)
