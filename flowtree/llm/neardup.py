"""MinHash near-dedup with sequential Bayesian verification (BayesLSH; Satuluri and Parthasarathy 2012).

1. One pass over the texts makes a MinHash signature and band keys.
2. Documents of one shingle set are joined by a 128-bit hash of it, and only the least doc_id of each goes on.
3. Documents of one band bucket are compared with its least: signatures are read in batches of BATCH values, and a
   candidate goes as soon as the posterior probability that its similarity reaches the threshold, given the matches so
   far and a uniform prior, falls below MISS. Survivors are verified by the exact Jaccard similarity of their shingle sets.
4. A bucket whose documents these pairs leave in several components is compared whole: every document with every one of
   another component, in the same two steps, in tiles (see ``tiles``). So a candidate that resembles the least too little,
   or whose partner doesn't resemble it, is held against all of its bucket, and no bucket is one task's work.
5. Connected components of verified pairs are the groups; the least doc_id of each stays.

Defined results: rows of a null doc_id can't be named and are left out of ``groups``; ``deduplicate`` keeps them.
Texts that are null, empty or without a word resemble nothing. A text shorter than a shingle is one shingle.
``groups`` has one row for each doc_id; of several texts under one doc_id, the one of the least set hash is compared.
``deduplicate`` drops the rows of that text where the doc_id isn't the least of its group; other texts under the doc_id,
which were compared with nothing, stay. Of rows of the same doc_id and text one stays, that of the least hash of all columns.
Columns other than doc_id and text are never compared. Nothing depends on the order of rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .minhash import Scheme, band_keys, binaries, lists, sets, signatures
from .storage import written
from .textblocks import trimmed
from .tiles import TILE, TILE_SHINGLES, Chooser, buckets, forest, needed, originals, sent, set_hashes, small, tiled, verify

#: Production parameters: shingles of 3 words, 32 bands of 4, the least Jaccard similarity of near copies, the
#: probability of missing one, and signature values compared at a time.
SCHEME, THRESHOLD, MISS, BATCH = Scheme(words=3, bands=32, rows=4), 0.6, 0.01, 16


def least_matches(size: int, threshold: float, miss: float, batch: int) -> tuple[tuple[int, int], ...]:
    """(n, least m): with fewer than m of n matching 8-bit values, P(similarity >= threshold) is below ``miss``."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(batch, size + 1, batch):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(like - like.max())
            if w[s >= threshold].sum() >= miss * w.sum():
                break
        out.append((n, m))
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, least: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Which rows of two aligned signature arrays (uint8) survive every batch; see ``least_matches``."""
    alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int32), 0
    for n, m in least:
        matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
        ok = matches >= m
        alive, matches, done = alive[ok], matches[ok], n
    return alive


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Binaries of one length, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.uint8)


class Leaders(Chooser):
    """A tile of a leader and its candidates, already chosen."""

    columns = ()

    def __init__(self, table: pa.Table) -> None:
        pass

    def __call__(self, a: int, others: np.ndarray) -> np.ndarray:
        return others


def apart(least: tuple[tuple[int, int], ...]) -> type[Chooser]:
    """Candidates of different components that sequential comparison leaves; what is verified joins their components."""

    class Apart(Chooser):
        columns = ("bands", "sig", "component")

        def __init__(self, table: pa.Table) -> None:
            super().__init__(table)
            self.sig, self.label = _matrix(table.column("sig")), table.column("component").to_numpy().copy()

        def __call__(self, a: int, others: np.ndarray) -> np.ndarray:
            others = super().__call__(a, others[self.label[others] != self.label[a]])
            return others[survivors(np.broadcast_to(self.sig[a], (len(others), self.sig.shape[1])), self.sig[others], least)]

        def joined(self, a: int, found: np.ndarray) -> None:
            self.label[np.isin(self.label, self.label[found])] = self.label[a]

    return Apart


def sketches(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, text_key, set_a, set_b, size, bands, sig): a hash of the text, a 128-bit one of the shingle set and its size,
    band keys and the lowest 8 bits of each signature value; texts without a word are left out."""

    def run(batches):
        for batch in batches:
            sig, some = signatures(batch.column(2), scheme)
            made = sets(batch.column(2), scheme.words)
            h, size = set_hashes(made), np.array([len(s) for s in made], np.int64)
            out = [batch.column(0), batch.column(1), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(size), lists(band_keys(sig, scheme), some), binaries(sig.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "set_a", "set_b", "size", "bands", "sig"]).filter(pa.array(some))

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    return named.mapInArrow(trimmed(run), "doc_id long, text_key long, set_a long, set_b long, size long, bands array<long>, sig binary")


def _text_key():
    return F.xxhash64("text")


def candidates(firsts: DataFrame, shared: DataFrame, least: tuple[tuple[int, int], ...]) -> DataFrame:
    """(a, b, size): the least document of a bucket, and each other one of it that sequential comparison leaves, with the size of its set."""

    def run(batches):
        for batch in batches:
            at = pa.array(survivors(_matrix(batch.column(3)), _matrix(batch.column(4)), least))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(3)], ["a", "b", "size"])

    pairs = shared.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    with_b = pairs.join(firsts.select(F.col("doc_id").alias("b"), "size", F.col("sig").alias("y")), "b")
    both = with_b.join(firsts.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a")
    return both.select("a", "b", "size", "x", "y").mapInArrow(trimmed(run), "a long, b long, size long")


def _edges(a, b, _):
    return forest(a, b)


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b) of the ``candidates`` whose exact Jaccard similarity reaches the threshold; those of one leader are spread over as many tiles as they fill."""
    counts = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("k"))
    tile = F.xxhash64("a", "part").alias("tile")
    none = F.lit(None).cast("long").alias("bucket")
    members = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b", F.lit(7)), F.col("k")).cast("int")).select(tile, none, F.lit(2).alias("kind"), F.col("b").alias("doc_id"))
    leaders = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(tile, none, F.lit(1).alias("kind"), F.col("a").alias("doc_id"))
    rows = sent(docs, members.union(leaders), firsts.select("doc_id", "set_a", "set_b"), words)
    return verify(rows, Leaders, threshold, _edges, "a long, b long")


def remaining(docs: DataFrame, firsts: DataFrame, shared: DataFrame, found: DataFrame, words: int, threshold: float, least: tuple[tuple[int, int], ...]) -> DataFrame:
    """(a, b): edges that join what is alike in the buckets that the components ``found`` don't join."""
    component = F.coalesce("component", "doc_id")
    found = small(written(found.withColumnRenamed("node", "doc_id"), "found"))
    placed = shared.join(found, "doc_id", "left").withColumn("component", component)
    split = placed.groupBy("bucket").agg(F.min("component").alias("low_c"), F.max("component").alias("high_c")).where("low_c <> high_c").select("bucket")
    members = written(shared.join(small(written(split, "split")), "bucket"), "apart")
    ids = small(written(members.select("doc_id").distinct(), "ids"))
    marks = written(firsts.join(ids, "doc_id").join(found, "doc_id", "left").select("doc_id", "set_a", "set_b", "bands", "sig", component.alias("component")), "labelled")
    chooser = apart(least)
    meet = needed(tiled(members).join(marks.drop("set_a", "set_b"), "doc_id"), chooser)
    return verify(sent(docs, meet, marks, words), chooser, threshold, _edges, "a long, b long")


def _labels(docs: DataFrame, scheme: Scheme, threshold: float, miss: float) -> tuple[DataFrame, DataFrame]:
    """(sketches; (doc_id, set_a, set_b, group_id) of every doc_id whose text has a word)."""
    least = least_matches(scheme.size, threshold, miss, BATCH)
    sketched = written(sketches(docs, scheme), "sketches")
    firsts, named = originals(sketched)
    shared = buckets(firsts)
    pairs = written(candidates(firsts, shared, least), "pairs")
    alike = written(verified(docs, pairs, firsts, scheme.words, threshold), "alike")
    more = written(remaining(docs, firsts, shared, components(alike, "a", "b"), scheme.words, threshold, least), "remaining")
    found = written(components(alike.union(more), "a", "b").withColumnRenamed("node", "first"), "components")
    return sketched, named.join(small(found), "first", "left").select("doc_id", "set_a", "set_b", F.coalesce("component", "first").alias("group_id"))


def groups(docs: DataFrame, scheme: Scheme = SCHEME, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, group_id, keep) of every distinct doc_id; group_id is the least doc_id of its group."""
    _, found = _labels(docs, scheme, threshold, miss)
    all_ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    named = all_ids.join(found, "doc_id", "left")
    group = F.coalesce("group_id", "doc_id")
    return named.select("doc_id", group.alias("group_id"), (group == F.col("doc_id")).alias("keep"))


def deduplicate(docs: DataFrame, scheme: Scheme = SCHEME, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts are shuffled only where the ids that go are many."""
    sketched, found = _labels(docs, scheme, threshold, miss)
    own = f"own_{uuid.uuid4().hex}"  # no column of docs has such a name
    doc_id = F.col("doc_id").cast("long")
    texts = sketched.select("doc_id", "text_key", "set_a", "set_b").join(found.where("group_id <> doc_id"), ["doc_id", "set_a", "set_b"])
    gone = written(texts.select(F.col("doc_id").alias(f"{own}_id"), F.col("text_key").alias(f"{own}_text")).distinct(), "gone")
    left = docs.join(small(gone), (doc_id == F.col(f"{own}_id")) & (_text_key() == F.col(f"{own}_text")), "left_anti")
    repeated = docs.where("doc_id is not null").groupBy(doc_id.alias(f"{own}_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(f"{own}_again")
    repeated = written(repeated, "repeated")
    n = repeated.count()
    if not n:
        return left
    again = small(repeated, n)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = left.join(again, doc_id == F.col(f"{own}_again"), "left_semi").select("doc_id", "text", whole.alias("whole"))
    once = rows.groupBy("doc_id", "text").agg(F.min_by("whole", F.xxhash64(F.to_json("whole"))).alias("whole")).select("whole.*")
    return left.join(again, doc_id == F.col(f"{own}_again"), "left_anti").unionByName(once)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
