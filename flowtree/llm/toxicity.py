"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A token's vector is the embedding of its hashed word beside that of its hashed first bytes; words and heads not seen
in training share one vector each. Filters of several widths slide over the whole text, their largest response is
kept (max pooling), and a logistic layer reads the pooled values. Backward passes touch the winning positions alone.
The threshold of each language is calibrated on held-out rows; languages with few of them use the one of all rows
(``Model.by_language`` has those with their own).

Every labelled row is used: about three in four fit the model, and the others, which a threshold must not have been fitted
on, calibrate it. Up to ``SHARD`` bytes of labelled texts one task fits. Beyond that the rows are spread over shards of about that
size by a hash of doc_id, each a task's work: in each of ``ROUNDS`` rounds every shard goes on from the common model for its part of
the epochs, and the next common model is the mean of theirs, for a word's vector of those that moved it. Words are counted over all
rows, and all held-out rows' scores settle the thresholds. Beyond ``MOST`` words seen twice, words share vectors by the first bits of their hash.

Defined results: a null or empty text has no token, scores 0 and isn't toxic. A null or unknown language uses the
threshold of all rows. Without labelled rows of both classes there is no model: score null, toxic false. Repeated
rows are scored alike. Only doc_id, lang and text are read; ``filter_toxic`` passes on every other column.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .textblocks import blocks, lowered, offsets, tokens, trimmed

#: Production parameters: embedding sizes, bytes of a head, {width: filters}, training.
WORD, HEAD, HEAD_BYTES, FILTERS, EPOCHS, RATE, BATCH, LEAST_UPDATES = 8, 4, 4, {1: 12, 2: 6, 3: 6}, 10, 0.08, 64, 400
#: Most false alarms that a threshold is calibrated to, and held-out rows of each class that a language needs.
FALSE_ALARMS, LEAST = 0.003, 25
#: Clean rows beyond that bound that may be labelled wrongly, and the share of toxic rows that each must be repaid by.
MORE, REPAID = 3, 0.25
#: Bytes of labelled texts that one task fits on, rounds over shards, words that have vectors of their own, and vectors of a message.
SHARD, ROUNDS, MOST, SLICE = 32 << 20, 5, 1 << 20, 1 << 12
#: What sums of squared gradients start from.
_NONE = np.float32(1e-6)
_WIDE = sum(w * f for w, f in FILTERS.items())


@dataclass
class Model:
    words: np.ndarray
    heads: np.ndarray
    word_vectors: np.ndarray
    head_vectors: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)
    #: Low bits of hashes that ``words`` and ``heads`` leave out.
    shifts: tuple[int, int] = (0, 0)


def _place(seen: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + the place in the sorted hashes ``seen``, or 0."""
    if not len(seen):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
    return np.where(seen[at] == h, at + 1, 0)


def _responses(x: np.ndarray, rows: np.ndarray, model: Model) -> dict[int, np.ndarray]:
    """By width, the response of each filter at each position; -1 where a window leaves its text."""
    out = {}
    for w, f in model.filters.items():
        r = np.full((len(x), f.shape[1]), -1.0, np.float32)
        if len(x) >= w:
            n, d = len(x) - w + 1, x.shape[1]
            r[:n] = model.bias[w]
            for k in range(w):
                r[:n] += x[k : k + n] @ f[k * d : (k + 1) * d]
            r[:n][rows[:n] != rows[w - 1 :]] = -1.0
        out[w] = r
    return out


def _vectors(h: np.ndarray, heads: np.ndarray, model: Model) -> np.ndarray:
    return np.hstack([v[_place(seen, x >> np.uint64(s))] for v, seen, x, s in zip((model.word_vectors, model.head_vectors), (model.words, model.heads), (h, heads), model.shifts)])


def _scores(x: np.ndarray, rows: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have tokens, and their probabilities."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    pooled = np.hstack([np.maximum(np.maximum.reduceat(r, starts, axis=0), 0) for r in _responses(x, rows, model).values()])
    return rows[starts], 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -35, 35)))


def probabilities(texts: pa.Array, model: Model) -> np.ndarray:
    result = np.zeros(len(texts))
    for first, end, data, off in blocks(texts, most=1 << 18):
        h, rows, heads = tokens(data, off, prefix=HEAD_BYTES)
        if not len(h):
            continue
        at, p = _scores(_vectors(h, heads, model), rows, model)
        result[first + at] = p
    return result


def gradients(model: Model, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted logistic loss of texts whose tokens' vectors are ``x``: f and b by width, out, ob (its bias), x, and ``at``, the tokens that x's isn't 0 at."""
    rows, starts, d = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, x.shape[1]
    best, pooled = {}, []
    for w, r in _responses(x, rows, model).items():
        best[w] = np.stack([s + np.argmax(r[s : s + n], axis=0) for s, n in zip(starts, sizes)])
        pooled.append(np.maximum(np.take_along_axis(r, best[w], 0), 0))
    pool = np.hstack(pooled)
    p = 1 / (1 + np.exp(-np.clip(pool @ model.out + model.out_bias, -35, 35)))
    g = ((p - y) * weight).astype(np.float32)
    back = g[:, None] * model.out[None, :] * (pool > 0)
    into, j, touched, out = np.zeros_like(x), 0, [np.zeros(0, np.int64)], {"out": pool.T @ g, "ob": g.sum()}
    for w, f in model.filters.items():
        gw, at = back[:, j : j + f.shape[1]], best[w]
        j += f.shape[1]
        df = np.zeros_like(f)
        for c in range(f.shape[1]):
            hit = np.flatnonzero(gw[:, c])
            for k in range(w):
                pos = at[hit, c] + k
                df[k * d : (k + 1) * d, c] = gw[hit, c] @ x[pos]
                np.add.at(into, pos, gw[hit, c, None] * f[None, k * d : (k + 1) * d, c])
                touched.append(pos)
        out |= {f"f{w}": df, f"b{w}": gw.sum(0)}
    return out | {"x": into, "at": np.unique(np.concatenate(touched))}


def _sequences(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashes of each text's words and heads."""
    seqs: list[tuple[np.ndarray, np.ndarray]] = []
    for first, end, data, off in blocks(texts, lower):
        h, rows, heads = tokens(data, off, prefix=HEAD_BYTES)
        cut = offsets(rows, end - first)
        seqs += [(h[cut[k] : cut[k + 1]], heads[cut[k] : cut[k + 1]]) for k in range(end - first)]
    return seqs


def fit(table: pa.Table, seed: int = 11) -> Model | None:
    """Trains on a table of text, lang and y (0 or 1); None unless both classes are there."""
    y = table["y"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.25
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    seqs = _sequences(table["text"])
    use = [k for k in np.flatnonzero(~held) if len(seqs[k][0])]
    if not use:
        return None

    def seen(which: int) -> np.ndarray:
        ids, n = np.unique(np.concatenate([np.unique(seqs[k][which]) for k in use]), return_counts=True)
        return ids[n >= 2]

    model = _started(rng, seen(0), seen(1))
    placed = {k: (_place(model.words, seqs[k][0]), _place(model.heads, seqs[k][1])) for k in use}
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    _learn(model, {}, placed, use, y, balance, max(EPOCHS, LEAST_UPDATES // -(-len(use) // BATCH)), rng)
    test = np.flatnonzero(held) if held.any() else np.arange(len(y))
    p, t = probabilities(table["text"].take(test), model), y[test] > 0
    model.threshold, model.by_language = _thresholds(p, t, table["lang"].take(test).to_pylist())
    return model


def _started(rng: np.random.Generator, words: np.ndarray, heads: np.ndarray) -> Model:
    d = WORD + HEAD
    return Model(
        words, heads, rng.normal(0, 0.1, (len(words) + 1, WORD)).astype(np.float32), rng.normal(0, 0.1, (len(heads) + 1, HEAD)).astype(np.float32),
        {w: rng.normal(0, 0.5 / np.sqrt(w * d), (w * d, f)).astype(np.float32) for w, f in FILTERS.items()},
        {w: np.full(f, 0.05, np.float32) for w, f in FILTERS.items()},
        rng.normal(0, 0.3, sum(FILTERS.values())).astype(np.float32), 0.0,
    )


def _learn(model: Model, g2: dict[str, np.ndarray], placed, use, y: np.ndarray, balance: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Trains ``model`` in place on the rows ``use`` of ``placed``, places of words and heads. g2: sums of squared gradients so far."""

    def step(name: str, p: np.ndarray, g: np.ndarray, at=None) -> None:
        """Adagrad, on the rows ``at`` or on all."""
        acc = g2.setdefault(name, np.full(p.shape, _NONE, np.float32))
        if at is None:
            acc += g * g
            p -= RATE * g / np.sqrt(acc)
        else:
            ids, back = np.unique(at, return_inverse=True)
            total = np.zeros((len(ids), p.shape[1]), np.float32)
            np.add.at(total, back, g)
            acc[ids] += total * total
            p[ids] -= RATE * total / np.sqrt(acc[ids])

    for _ in range(epochs):
        order = rng.permutation(use)
        for b in range(0, len(order), BATCH):
            ks = order[b : b + BATCH]
            iw, ih = (np.concatenate([placed[k][j] for k in ks]) for j in (0, 1))
            sizes = np.array([len(placed[k][0]) for k in ks])
            grad = gradients(model, np.hstack([model.word_vectors[iw], model.head_vectors[ih]]), sizes, y[ks], balance[ks] / len(ks))
            for w, f in model.filters.items():
                step(f"f{w}", f, grad[f"f{w}"])
                step(f"b{w}", model.bias[w], grad[f"b{w}"])
            step("out", model.out, grad["out"])
            acc = g2.setdefault("ob", np.full(1, _NONE, np.float32))
            acc += grad["ob"] ** 2
            model.out_bias -= float(RATE * grad["ob"] / np.sqrt(acc[0]))
            if len(pos := grad["at"]):
                step("w", model.word_vectors, grad["x"][pos, :WORD], iw[pos])
                step("h", model.head_vectors, grad["x"][pos, WORD:], ih[pos])


def _thresholds(p: np.ndarray, toxic: np.ndarray, langs: list) -> tuple[float, dict[str, float]]:
    """The threshold of all held-out rows, and those of the languages that have enough of them."""
    named, found = np.array([x or "" for x in langs]), {}
    for lang in sorted(set(named.tolist()) - {""}):
        own = named == lang
        if min(toxic[own].sum(), (~toxic[own]).sum()) >= LEAST:
            found[lang] = _threshold(p[own], toxic[own])
    return _threshold(p, toxic), found


def _threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold that finds most of the toxic rows among those of at most FALSE_ALARMS of the clean ones.

    As labels may be wrong, MORE clean rows than that may lie above it, if each is repaid by finding REPAID of the toxic rows.
    """
    low, above, best = np.sort(p[~toxic])[::-1], np.sort(p[toxic]), None
    bound = int(len(low) * FALSE_ALARMS)
    for k in range(bound, min(bound + MORE + 1, len(low))):
        found = (above > low[k]).mean() - REPAID * (k - bound)
        if best is None or found > best[0]:
            best = found, float(low[k])
    floor = best[1]
    above = above[above > floor]
    return float((floor + above[0]) / 2) if len(above) else float(min(1.0, floor + 1e-6))


def flags(texts: pa.Array, langs: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    p = probabilities(texts, model)
    limit = np.array([model.by_language.get(x, model.threshold) for x in langs.to_pylist()])
    return p, p > limit


def _packed(rows: DataFrame) -> DataFrame:
    """The column text in lower case and compressed, with its size in bytes, and in ``least`` the hashes of what it was; the others as they are."""
    rows = rows.withColumn("least", F.struct(F.xxhash64("text"), F.xxhash64("lang")))
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = [x.encode() for x in lowered(batch.column("text")).to_pylist()]
            made = [pa.array([len(x) for x in texts], pa.int32()), pa.array([pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "size", "packed"])

    return rows.mapInArrow(trimmed(run), rows.select(*names).withColumns({"size": F.lit(0), "packed": F.lit(b"")}).schema)


def _shards(batches, hold: bool) -> Iterator[tuple[int, list[tuple]]]:
    """(shard, its (lang, y, held, size, packed)) from rows in order of shard, doc_id and hashes; of repeated documents the first."""
    at, rows, last = None, [], None
    for batch in batches:
        for shard, doc, lang, y, held, size, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "lang", "y", "held", "size", "packed"))):
            if shard != at:
                if rows:
                    yield at, rows
                at, rows, last = shard, [], None
            if doc != last:
                rows.append((lang, y, held and hold, size, packed))
                last = doc
    if rows:
        yield at, rows


def _read(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sequences of a shard's rows."""
    texts = [pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b"" for *_, size, packed in rows]
    return _sequences(pa.array(texts, pa.large_binary()).cast(pa.large_string()), lower=False)


def _counted(rows: DataFrame, hold: bool) -> DataFrame:
    """(kind, id, n): rows that the upper half of a word's hash (kind 0) or a head's (1) is in, of those that fit; rows that fit (2) or are held out (3) by label."""

    def run(batches):
        for _, own in _shards(batches, hold):
            kinds, ids, counts = [], [], []
            some = _read([r for r in own if not r[2]])
            for kind in (0, 1):
                each, n = np.unique(np.concatenate([np.unique(x[kind] >> np.uint64(32)) for x in some] or [np.zeros(0, np.uint64)]), return_counts=True)
                kinds.append(np.full(len(each), kind)), ids.append(each.astype(np.int64)), counts.append(n)
            for y in (0, 1):
                for kind, held in ((2, False), (3, True)):
                    kinds.append([kind]), ids.append([y]), counts.append([sum(r[1] == y and r[2] == held for r in own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (kinds, ids, counts)], ["kind", "id", "n"])

    return rows.mapInArrow(trimmed(run), "kind long, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n"))


def _seen(counted: DataFrame, kind: int) -> tuple[np.ndarray, int]:
    """The upper halves seen in two rows or more, sorted, and the low bits of hashes that they leave out."""
    ids, shift = counted.where((F.col("kind") == kind) & (F.col("n") >= 2)).select("id"), 32
    if ids.count() > MOST:
        shift = 65 - MOST.bit_length()
        ids = ids.select(F.shiftright("id", shift - 32).alias("id")).distinct()
    return np.sort(ids.toArrow()["id"].to_numpy()).astype(np.uint64), shift


def _parameters(model: Model) -> dict[str, np.ndarray]:
    """By name, what training moves, as views of two dimensions; ob is a copy."""
    named = {"w": model.word_vectors, "h": model.head_vectors, "out": model.out, "ob": np.full(1, model.out_bias)}
    named |= {f"f{w}": f for w, f in model.filters.items()} | {f"b{w}": b for w, b in model.bias.items()}
    return {k: v.reshape(len(v), -1) for k, v in named.items()}


def _zero(model: Model) -> dict[str, np.ndarray]:
    """Sums of squared gradients before any."""
    shapes = {"w": model.word_vectors.shape, "h": model.head_vectors.shape, "out": model.out.shape, "ob": (1,)}
    shapes |= {f"f{w}": f.shape for w, f in model.filters.items()} | {f"b{w}": b.shape for w, b in model.bias.items()}
    return {name: np.full(shape, _NONE, np.float32) for name, shape in shapes.items()}


def _round(rows: DataFrame, hold: bool, model: Model, g2: dict[str, np.ndarray], share: float, seed: int, k: int) -> bool:
    """Moves ``model``, begun by ``seed``, and ``g2`` to the means of what each shard makes of them in its part of the epochs; False if no row has a token. share: of label 1."""
    far = {name: np.flatnonzero((g2[name] != _NONE).reshape(len(v), -1).any(1)) for name, v in _parameters(model).items()}
    sent = rows.sparkSession.sparkContext.broadcast((model.words, model.heads, model.shifts, {name: (at, _parameters(model)[name][at], g2[name][at]) for name, at in far.items()}))

    def common() -> tuple[Model, dict[str, np.ndarray]]:
        """``model`` and ``g2``: what hasn't moved is made anew."""
        words, heads, shifts, moved = sent.value
        model = _started(np.random.default_rng(seed), words, heads)
        model.shifts = shifts
        g2, named = _zero(model), _parameters(model)
        for name, (at, values, acc) in moved.items():
            named[name][at], g2[name][at] = values, acc
        model.out_bias = float(named["ob"][0, 0])
        return model, g2

    def run(batches):
        model, g2 = common()
        sets = [pa.array(model.words), pa.array(model.heads)]
        for shard, own in _shards(batches, hold):
            own = [r for r in own if not r[2]]
            placed, y = [], []
            for (_, label, *_), seq in zip(own, _read(own)):
                if len(seq[0]):
                    placed.append(seq)
                    y.append(label)
            if not placed:
                continue
            cut = np.cumsum([len(x[0]) for x in placed])[:-1]
            each = [np.concatenate([x[j] for x in placed]) >> np.uint64(model.shifts[j]) for j in (0, 1)]
            each = [pc.fill_null(pc.add(pc.index_in(pa.array(h), value_set=seen), 1), 0).to_numpy(zero_copy_only=False) for h, seen in zip(each, sets)]
            placed = list(zip(*(np.split(x, cut) for x in each)))
            y = np.array(y, np.float32)
            mine, sums = copy.deepcopy((model, g2))
            epochs = max(EPOCHS, LEAST_UPDATES // -(-len(y) // BATCH)) // ROUNDS
            _learn(mine, sums, placed, np.arange(len(y)), y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32), epochs, np.random.default_rng([seed, k, shard]))
            old, names, data = _parameters(model), [], []
            for name, new in _parameters(mine).items():
                acc, before = sums[name].reshape(new.shape), g2[name].reshape(new.shape)
                moved = np.flatnonzero(((acc != before) | (new != old[name])).any(1))
                for part in np.split(moved, np.searchsorted(moved, np.arange(SLICE, len(new), SLICE))):
                    if len(part):
                        names.append(f"{name}/{part[0] // SLICE}")
                        data.append(pickle.dumps((part.astype(np.int32), new[part] - old[name][part], acc[part])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([shard] * len(names), pa.int32()), pa.array(data, pa.binary())], ["slice", "shard", "data"])

    def mean(batches):
        at, sums = "", None

        def done():
            some = np.flatnonzero(sums[0])
            ids = some + int(at.partition("/")[2]) * SLICE
            made = pickle.dumps((ids, *((x[some] / sums[0][some, None]).astype(np.float32) for x in sums[1:])))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([made], pa.binary())], ["slice", "data"])

        for batch in batches:
            for name, data in zip(batch.column("slice").to_pylist(), batch.column("data")):
                ids, delta, acc = pickle.loads(data.as_py())  # noqa: S301 - made by our own tasks
                if name != at:
                    if at:
                        yield done()
                    at, sums = name, (np.zeros(SLICE), *(np.zeros((SLICE, delta.shape[1])) for _ in range(2)))
                ids = ids % SLICE
                sums[0][ids] += 1
                sums[1][ids] += delta
                sums[2][ids] += acc
        if at:
            yield done()

    parts = rows.mapInArrow(trimmed(run), "slice string, shard int, data binary").repartition("slice").sortWithinPartitions("slice", "shard")
    named = _parameters(model)
    got = parts.mapInArrow(trimmed(mean), "slice string, data binary").collect()
    sent.destroy()
    for r in got:
        name, (ids, delta, acc) = r.slice.partition("/")[0], pickle.loads(r.data)  # noqa: S301 - made by our own tasks
        named[name][ids] += delta
        g2[name][ids] = acc.reshape(g2[name][ids].shape)
    model.out_bias = float(named["ob"][0, 0])
    return bool(got)


def _calibrated(rows: DataFrame, hold: bool, model: Model) -> tuple[float, dict[str, float]]:
    """Thresholds by the scores of all held-out rows, or of all where none are; one task gets these (9 bytes a row and its language)."""

    def run(batches):
        for _, own in _shards(batches, hold):
            own = [r for r in own if r[2] or not hold]
            seqs, p, k = _read(own), np.zeros(len(own)), 0
            while k < len(own):
                first, size = k, 0
                while k < len(own) and size < 1 << 16:
                    k, size = k + 1, size + len(seqs[k][0])
                if size:
                    h, heads = (np.concatenate([x[j] for x in seqs[first:k]]) for j in (0, 1))
                    at, got = _scores(_vectors(h, heads, model), np.repeat(np.arange(k - first), [len(x[0]) for x in seqs[first:k]]), model)
                    p[first + at] = got
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.string()), pa.array(p), pa.array([r[1] for r in own], pa.int32())], ["lang", "p", "y"])

    def settle(batches):
        got = pa.Table.from_batches(list(batches))
        made = _thresholds(got["p"].to_numpy(), got["y"].to_numpy() > 0, got["lang"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    scores = rows.mapInArrow(trimmed(run), "lang string, p double, y int").repartition(1)
    return pickle.loads(scores.mapInArrow(trimmed(settle), "made binary").first().made)  # noqa: S301 - made by our own task


def fit_shards(docs: DataFrame, lab: DataFrame, count: int, shards: int, seed: int = 11) -> Model | None:
    """``fit`` on all labelled rows, spread over so many shards; lab: (doc_id, y), ``count`` of them."""
    hashed = lambda k, n: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(n)).cast("int")
    rows = labelled.every(docs, lab, count, _packed).withColumns({"shard": hashed(1, shards), "held": hashed(2, 4) == 0})
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(3)), "doc_id", "least")
    rows = rows.select("shard", "doc_id", "lang", "y", "held", "size", "packed").persist(StorageLevel.DISK_ONLY)
    try:
        for hold in (True, False):
            counted = _counted(rows, hold).persist(StorageLevel.DISK_ONLY)
            n = {(r.kind, r.id): r.n for r in counted.where("kind >= 2").collect()}
            if all(n[2, y] and (n[3, y] or not hold) for y in (0, 1)):
                break
            counted.unpersist()
        else:
            return None
        (words, first), (heads, second) = _seen(counted, 0), _seen(counted, 1)
        counted.unpersist()
        model = _started(np.random.default_rng(seed), words, heads)
        model.shifts = first, second
        g2 = _zero(model)
        total = {y: n[2, y] + (n[3, y] if hold else 0) for y in (0, 1)}
        for k in range(ROUNDS):
            if not _round(rows, hold, model, g2, total[1] / (total[0] + total[1]), seed, k):
                return None
        model.threshold, model.by_language = _calibrated(rows, hold, model)
        return model
    finally:
        rows.unpersist()


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> Model | None:
    """A model of all labelled rows; ``shard``: bytes of texts that one task fits on."""
    lab = labelled.cleaned(labels, "toxic")
    count = lab.count()
    size = labelled.every(docs, lab, count, lambda rows: rows.withColumn("text", F.octet_length("text"))).agg(F.sum("text")).first()[0] or 0
    if size > shard:
        return fit_shards(docs, lab, count, -(-size // shard))
    got = labelled.fitted(labelled.once(labelled.every(docs, lab, count)), fit)
    return None if got is None else Model(**got)


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, score, toxic) of every row."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            p, toxic = pa.nulls(batch.num_rows, pa.float64()), np.zeros(batch.num_rows, bool)
        else:
            p, toxic = flags(batch.column(2), batch.column(1), model)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(p), pa.array(toxic)], ["doc_id", "lang", "score", "toxic"])

    return labelled.scored(docs, ["doc_id", "lang", "text"], "doc_id long, lang string, score double, toxic boolean", score)


def filter_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    if model is None:
        return docs
    return labelled.kept(docs, ["text", "lang"], lambda batch: ~flags(batch.column(0), batch.column(1), model)[1])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
