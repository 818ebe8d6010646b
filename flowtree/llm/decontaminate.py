"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size: class c holds those of 2^(c-1) + 1 to 2^c shingles. For class c a document is cut into
blocks of 2^c shingles, and any passage of an item's size lies within two consecutive blocks, so the windows of two
blocks bound the ratio of sizes that makes plain MinHash blind to a short item in a long text (after LSH Ensemble, Zhu
et al. 2016). Window signatures are least values over blocks, joined pairwise. A containment of ``threshold`` then is
a Jaccard similarity of at least threshold * q / (2 * 2^c + (1 - threshold) * q) with q > 2^(c-1), and HASHES bands
of one value each find it with a probability above 0.99 even at the threshold. Candidates are verified: the share of the item's distinct
shingles that occur anywhere in the whole document.

Items of fewer words than a shingle are matched as shingles of their own length. Item tables whose signatures fit in
BROADCAST_BYTES go to every executor, so that one pass over the texts, without a shuffle, finds and verifies; larger
ones meet the windows' values in a shuffle join instead, with the same result; only windows that pass a Bloom filter of the items' keys are shuffled.

Defined results: a null doc_id or item_id can't be named and is left out (``remove`` looks at such rows of documents as at all others); null
and empty texts, and texts without a word, hold and match nothing. Repeated item rows count once; items of one text
under two ids are each reported. Repeated rows of a doc_id are reported once, with their greatest containment, and
``remove`` drops every row that itself matches. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .minhash import sets
from .storage import written
from .textblocks import blocks, distinct, mix, shingles, tokens, trimmed

#: Production parameters: words of a shingle, least containment, hashes of a window.
WORDS, THRESHOLD, HASHES = 5, 0.5, 48
#: Size of the item index up to which it is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Of the filter that larger tables' keys go through before the join: its bits at most, as a power of two, and bits that a key sets.
FILTER_BITS, PROBES = 28, 3
_rng = np.random.default_rng(29)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _key(value: np.ndarray, c: int, words: int, j: int) -> np.ndarray:
    """64-bit key of the value of hash j in class c of shingles of ``words`` words."""
    return mix(value + np.uint64((c << 16) | (words << 8) | j))


def item_keys(shingle_set: np.ndarray, words: int, c: int) -> np.ndarray:
    return np.array([_key((shingle_set * _A[j] + _B[j]).min(keepdims=True), c, words, j)[0] for j in range(HASHES)], np.uint64)


def window_keys(g: np.ndarray, rows: np.ndarray, c: int, words: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of hash j for every window of two blocks of 2^c shingles of each row."""
    firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    sizes = np.diff(np.append(firsts, len(rows)))
    per = -(-sizes // (1 << c))
    row = np.repeat(np.arange(len(firsts)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    least = np.minimum.reduceat(g * _A[j] + _B[j], firsts[row] + (nth << c))
    inner = np.flatnonzero(row[1:] == row[:-1])
    both = np.minimum(least[inner], least[inner + 1])
    alone = np.flatnonzero(per[row] == 1)
    return np.concatenate([_key(both, c, words, j), _key(least[alone], c, words, j)]), rows[firsts[np.concatenate([row[inner], row[alone]])]]


@dataclass
class Index:
    """Items: shingle sets, and the sorted keys with the items of each."""

    ids: list[int]
    words: list[int]
    of_class: list[int]
    sets: list[np.ndarray]
    keys: np.ndarray
    item_of: np.ndarray
    classes: list[tuple[int, int]]

    def bytes(self) -> int:
        return self.keys.nbytes + self.item_of.nbytes + sum(s.nbytes for s in self.sets)


def index(ids: list[int], texts: list[str], words: int = WORDS) -> Index:
    made, seen = Index([], [], [], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), []), set()
    column = pa.array(texts, pa.string())
    counts = np.zeros(len(texts), np.int64)
    for first, end, data, off in blocks(column):
        counts[first:end] = np.bincount(tokens(data, off)[1], minlength=end - first)
    keys, of, classes = [], [], set()
    for i, n, s in zip(ids, counts, sets(column, words)):
        if not n or (i, s.tobytes()) in seen:
            continue
        seen.add((i, s.tobytes()))
        w = int(min(n, words))
        made.ids.append(i)
        made.words.append(w)
        made.of_class.append(c := size_class(int(n) - w + 1))
        made.sets.append(s)
        keys.append(item_keys(s, w, c))
        of.append(np.full(HASHES, len(made.ids) - 1))
        classes.add((w, c))
    if keys:
        flat, items = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(flat, kind="stable")
        made.keys, made.item_of = flat[order], items[order]
    made.classes = sorted(classes)
    return made


def _grams(data: np.ndarray, off: np.ndarray, words: set[int], full: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Shingles of each needed length; those shorter than ``full`` words are of exact length."""
    h, rows = tokens(data, off)
    return {w: shingles(h, rows, w, whole=False) for w in words}


def matches(texts: pa.Array, ix: Index, threshold: float) -> tuple[list[int], list[int], list[float]]:
    """(row, item, containment) of the items of a small index that each text holds."""
    out: tuple[list, list, list] = ([], [], [])
    if not ix.ids:
        return out
    lengths = {w for w, _ in ix.classes}
    for first, _, data, off in blocks(texts):
        grams = _grams(data, off, lengths, WORDS)
        found = []
        for w, c in ix.classes:
            g, rows = grams[w]
            if not len(g):
                continue
            for j in range(HASHES):
                k, r = window_keys(g, rows, c, w, j)
                at = np.searchsorted(ix.keys, k)
                hit = np.flatnonzero(ix.keys[np.minimum(at, len(ix.keys) - 1)] == k)
                while len(hit):
                    pos = at[hit]
                    found.append(np.unique(r[hit] * len(ix.ids) + ix.item_of[pos]))
                    at[hit] += 1
                    hit = hit[(pos + 1 < len(ix.keys)) & (ix.keys[np.minimum(pos + 1, len(ix.keys) - 1)] == k[hit])]
        if not found:
            continue
        by_row = defaultdict(list)
        for pair in np.unique(np.concatenate(found)):
            by_row[int(pair) // len(ix.ids)].append(int(pair) % len(ix.ids))
        cut = {w: np.searchsorted(rows, np.arange(len(off))) for w, (_, rows) in grams.items()}
        for row, items in by_row.items():
            whole = {w: np.unique(grams[w][0][cut[w][row] : cut[w][row + 1]]) for w in {ix.words[i] for i in items}}
            for i in items:
                share = float(np.isin(ix.sets[i], whole[ix.words[i]], assume_unique=True).mean())
                if share >= threshold:
                    for column, x in zip(out, (first + row, i, share)):
                        column.append(x)
    return out


def _text_key():
    """128 bits of a text: rows of one text are alike, whatever their doc_id."""
    return F.md5(F.col("text"))


def _named(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("text").alias("text")).where(f"{key} is not null and text is not null")


def _small(items: DataFrame, limit: int) -> Index | None:
    """The index, if by the size of its texts it keeps within the limit; else None."""
    named = _named(items, "item_id").distinct()
    n, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n * HASHES * 16 + size * 2 > limit:  # a key and its item a hash; at most a shingle of 8 bytes for 4 bytes of text
        return None
    got = named.orderBy("item_id", "text").toArrow()
    return index(got["item_id"].to_pylist(), got["text"].to_pylist())


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, containment) of every document and item of at least that containment."""
    ix = _small(items, broadcast_bytes)
    if ix is None:
        named = _named(docs, "doc_id").withColumn("text_key", _text_key())
        held = _joined(named.select("text_key", "text"), items, threshold).groupBy("text_key", "item_id").agg(F.max("containment").alias("containment"))
        found = named.select("doc_id", "text_key").distinct().join(held, "text_key")
    else:
        def run(batches):
            for batch in batches:
                rows, at, share = matches(batch.column(1), ix, threshold)
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([ix.ids[i] for i in at], pa.int64()), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "item_id", "containment"])

        found = _named(docs, "doc_id").mapInArrow(trimmed(run), "doc_id long, item_id long, containment double")
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _probe(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    return keys.view(np.uint64) >> np.uint64(17 * k) & np.uint64((1 << bits) - 1)


def _filter(known: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words) of a Bloom filter of the keys, of 2^bits bits: 16 or more a key, until it has FILTER_BITS."""
    keys = known.select(F.explode("keys").alias("key"))
    bits = min(FILTER_BITS, max(6, (16 * keys.count()).bit_length()))

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_probe(batch.column(0).to_numpy(), k, bits) for k in range(PROBES)]).astype(np.int64))], ["at"])

    at = F.col("at")
    got = keys.mapInArrow(trimmed(places), "at long").groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("set")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint64)
    return bits, words


def _joined(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(text_key, item_id, containment) of texts (text_key, text), for item tables of any size, by shuffle joins on window keys and then on the texts.

    Texts go by ``_text_key``, so that of several under one doc_id, or under none, each is held against its own items.
    """

    def indexed(batches):
        for batch in batches:
            ix = index(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            out = [[], [], [], [], []]
            for i in range(len(ix.ids)):
                for column, x in zip(out, (ix.ids[i], ix.words[i], ix.of_class[i], ix.sets[i].tobytes(), item_keys(ix.sets[i], ix.words[i], ix.of_class[i]).view(np.int64).tolist())):
                    column.append(x)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["item_id", "words", "class", "shingles", "keys"])

    def hits(keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be an item's."""
        at = np.arange(len(keys))
        for k in range(PROBES):
            pos = _probe(keys[at], k, bits)
            at = at[filled[(pos >> 6).astype(np.int64)] >> (pos & np.uint64(63)) & np.uint64(1) == 1]
        return at

    known = written(_named(items, "item_id").distinct().mapInArrow(trimmed(indexed), "item_id long, words int, class int, shingles binary, keys array<long>"), "items")
    classes = [(r["words"], r["class"]) for r in known.select("words", "class").distinct().collect()]
    bits, filled = _filter(known)

    def windows(batches):
        for batch in batches:
            for first, _, data, off in blocks(batch.column(1)):
                grams = _grams(data, off, {w for w, _ in classes}, WORDS)
                for w, c in classes:
                    g, rows = grams[w]
                    for j in range(HASHES if len(g) else 0):
                        k, r = window_keys(g, rows, c, w, j)
                        at = hits(k)
                        k, r = distinct(k[at], r[at])
                        if len(k):
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + r)), pa.array(k.view(np.int64))], ["text_key", "key"])

    def verify(batches):
        for batch in batches:
            out = ([], [], [])
            for k in range(batch.num_rows):
                for first, _, data, off in blocks(batch.column(1).slice(k, 1)):
                    pairs = batch.column(2)[k].as_py()
                    grams = _grams(data, off, {p["words"] for p in pairs}, WORDS)
                    for p in pairs:
                        share = float(np.isin(np.frombuffer(p["shingles"], np.uint64), grams[p["words"]][0]).mean())
                        if share >= threshold:
                            for column, x in zip(out, (batch.column(0)[k].as_py(), p["item_id"], share)):
                                column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["text_key", "item_id", "containment"])

    met = texts.mapInArrow(trimmed(windows), "text_key string, key long").join(known.select("item_id", "words", "shingles", F.explode("keys").alias("key")), "key")
    pairs = met.select("text_key", "item_id", "words", "shingles").distinct()
    pairs = pairs.groupBy("text_key").agg(F.collect_list(F.struct("item_id", "words", "shingles")).alias("items"))
    return texts.join(pairs, "text_key").mapInArrow(trimmed(verify), "text_key string, item_id long, containment double")


def remove(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    ix = _small(items, broadcast_bytes)
    if ix is None:
        texts = docs.where("text is not null").select(_text_key().alias("text_key"), F.col("text").alias("text"))
        own = f"gone_{uuid.uuid4().hex}"  # no column of docs has such a name
        gone = written(_joined(texts, items, threshold).select(F.col("text_key").alias(own)).distinct(), "gone")
        return docs.join(gone, _text_key() == F.col(own), "left_anti")

    def clean(batch: pa.RecordBatch) -> np.ndarray:
        mask = np.ones(batch.num_rows, bool)
        mask[matches(batch.column(0), ix, threshold)[0]] = False
        return mask

    return labelled.kept(docs, ["text"], clean)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
