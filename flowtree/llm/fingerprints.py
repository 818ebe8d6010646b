"""Document fingerprints: MinHash signatures, their bands joined in Spark, and the Jaccard similarity verified.

Documents of one and the same shingle set are one fingerprint, named by its least doc_id, so copies cost one row each
and never a pair each. Fingerprints that share a band are candidates, and all candidates are verified by the exact
Jaccard similarity of their shingle sets, in tiles (see ``tiles``): no pair of candidates is ever a row. Fingerprints
that shared bands join to a component of at most a tile meet there, once; those of larger components meet in the
tiles of each of their buckets, where only those with a candidate bring their sets.

``classes``, which the registered query gives, has one row per document: (doc_id, class_id, copies, links, group_id): its
fingerprint, the documents that have it, the number of other fingerprints at or above the threshold, and the least
doc_id of the connected component of these links. ``similar`` names the links, as pairs of fingerprints (doc_a, doc_b,
jaccard) and each copy with its fingerprint, at 1.0; ``expanded`` spells out the pairs of copies that follow. Recall at the threshold
is above 0.98, and rises with similarity.

Defined results: rows of a null doc_id are left out. Null, empty and wordless texts have no links, and are a class and a
group of their own. A text shorter than a shingle is one shingle. Repeated rows of one doc_id and text count once; of several
texts under one doc_id, one is used (the one of the least set hash). Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .minhash import Scheme, band_keys, lists, sets, signatures
from .storage import written
from .textblocks import trimmed
from .tiles import TILE, TILE_SHINGLES, Chooser, buckets, forest, named_texts, needed, originals, sent, set_hashes, small, tiled, verify

#: Production parameters.
SCHEME, THRESHOLD = Scheme(words=3, bands=25, rows=5, seed=9), 0.7


def fingerprints(docs: DataFrame, scheme: Scheme = SCHEME) -> DataFrame:
    """(doc_id, set_a, set_b, size, bands): a 128-bit hash of the shingle set, its size, and the band keys of the signature."""

    def run(batches):
        for batch in batches:
            sig, some = signatures(batch.column(1), scheme)
            made = sets(batch.column(1), scheme.words)
            h, size = set_hashes(made), np.array([len(s) for s in made], np.int64)
            out = [batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(size), lists(band_keys(sig, scheme), some)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "set_a", "set_b", "size", "bands"]).filter(pa.array(some))

    return named_texts(docs).mapInArrow(trimmed(run), "doc_id long, set_a long, set_b long, size long, bands array<long>")


def _meetings(firsts: DataFrame) -> DataFrame:
    """(tile, bucket, kind, doc_id): where fingerprints meet; the bucket is null in the tile of a whole component."""
    shared = buckets(firsts)
    joined = components(shared.where("doc_id <> low"), "low", "doc_id").withColumnRenamed("node", "doc_id")
    placed = written(joined.join(firsts.select("doc_id", "size"), "doc_id"), "placed")
    totals = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    fits = (F.col("n") <= TILE) & (F.col("shingles") <= TILE_SHINGLES)
    placed = written(placed.join(totals.select("component", fits.alias("fits")), "component"), "fitting")
    home = placed.where("fits").select(F.xxhash64("component").alias("tile"), F.lit(None).cast("long").alias("bucket"), F.lit(0).alias("kind"), "doc_id")
    wide = written(tiled(shared.join(placed.where("not fits").select("doc_id"), "doc_id")), "wide")
    return home.union(needed(wide.join(firsts.select("doc_id", "bands"), "doc_id"), Chooser))


def _verified(docs: DataFrame, firsts: DataFrame, words: int, threshold: float, emit, schema: str) -> DataFrame:
    rows = sent(docs, _meetings(firsts), firsts.select("doc_id", "set_a", "set_b", "bands"), words)
    return verify(rows, Chooser, threshold, emit, schema)


def similar(docs: DataFrame, scheme: Scheme = SCHEME, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard); see the module."""

    def emit(a, b, j):
        return np.minimum(a, b), np.maximum(a, b), j

    firsts, named = originals(written(fingerprints(docs, scheme), "fingerprints"))
    copies = named.where("doc_id <> first").select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return copies.union(_verified(docs, firsts, scheme.words, threshold, emit, "doc_a long, doc_b long, jaccard double"))


def classes(docs: DataFrame, scheme: Scheme = SCHEME, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copies, links, group_id) of every doc_id; see the module."""

    def emit(a, b, _):
        """(a, b, 0): edges that join all that is linked in the tile; (doc_id, doc_id, number of links)."""
        x, y = forest(a, b)
        ids, n = np.unique(np.concatenate([a, b]), return_counts=True)
        return np.concatenate([x, ids]), np.concatenate([y, ids]), np.concatenate([np.zeros(len(x), np.int64), n])

    firsts, named = originals(written(fingerprints(docs, scheme), "fingerprints"))
    found = written(_verified(docs, firsts, scheme.words, threshold, emit, "a long, b long, links long"), "links")
    groups = components(found.where("links = 0"), "a", "b").toDF("class_id", "group_id")
    counts = found.where("links > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    linked = written(counts.join(groups, "class_id"), "linked")
    of = named.select("doc_id", F.col("first").alias("class_id"), "copies").join(small(linked), "class_id", "left")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    class_id = F.coalesce("class_id", "doc_id")
    return ids.join(of, "doc_id", "left").select("doc_id", class_id.alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", class_id).alias("group_id"))


def expanded(pairs: DataFrame) -> DataFrame:
    """Every pair of documents that a result of ``similar`` says: also of copies with each other and with others' copies. For small results: it has a row a pair."""
    exact = pairs.where("jaccard = 1.0").select("doc_a", "doc_b")
    member = exact.toDF("first", "doc").union(exact.select("doc_a", "doc_a").distinct())
    within = member.alias("x").join(member.alias("y"), "first").where("x.doc < y.doc").select(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    a, b = member.toDF("doc_a", "x"), member.toDF("doc_b", "y")
    across = pairs.where("jaccard < 1.0").join(a, "doc_a", "left").join(b, "doc_b", "left")
    x, y = F.coalesce("x", "doc_a"), F.coalesce("y", "doc_b")
    return within.union(across.select(F.least(x, y), F.greatest(x, y), "jaccard"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
