"""Comparing the documents that share a band, in tiles: no bucket is one task's work, and no pair of candidates is ever a row.

Members of a bucket are cut by hash into k parts, of about TILE documents and TILE_SHINGLES shingles; each two parts, and
each part with itself, are a tile. A document goes to the k tiles of its part. So a bucket of any size is spread over
about k * k / 2 tasks, which is what comparing all of its members takes, and a small one is a single tile.

A tile is compared in two passes. The first gets marks alone (band keys, signatures) and says which documents have a
candidate there; the second gets the shingle sets of these, and verifies. Both find the candidates from the marks, and a
pair that shares several buckets is a candidate only in that of its first common band, so that it is compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import jaccard, ragged, sets
from .storage import written
from .textblocks import mix, trimmed

#: Documents of a part of a bucket, about, and shingles of their sets.
TILE, TILE_SHINGLES = 1024, 4 << 20
#: Rows, or elements of an array in them, up to which a table of (doc_id, ...) is sent to all executors; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
_ODD = np.uint64(0x5851F42D4C957F2D)


def small(df: DataFrame, rows: int | None = None, array: str | None = None) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most BROADCAST_ROWS rows, or elements of the array; it should be a written table."""
    if array:
        rows = df.agg(F.coalesce(F.sum(F.greatest(F.size(array), F.lit(1))), F.lit(0))).first()[0]
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def named_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")


def set_hashes(made: list[np.ndarray]) -> np.ndarray:
    """A 128-bit hash of each shingle set, as n x 2 of int64."""
    return np.array([(mix(s).sum(dtype=np.uint64), mix(s ^ _ODD).sum(dtype=np.uint64)) for s in made], np.uint64).reshape(-1, 2).view(np.int64)


def originals(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of the least doc_id of each shingle set; (doc_id, set_a, set_b, first, copies) of every doc_id).

    ``sketched`` has doc_id, set_a, set_b. Of several sets under one doc_id the one of the least hash stands for it. Both steps
    are aggregations with map-side combining, so neither a doc_id nor a set that a third of all rows have is one task's work.
    """
    ids = sketched.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("s")).select("doc_id", "s.set_a", "s.set_b")
    ids = written(ids, "ids")
    many = written(ids.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "many")
    named = ids.join(small(many), ["set_a", "set_b"], "left").select("doc_id", "set_a", "set_b", F.coalesce("first", "doc_id").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"))
    named = written(named, "named")
    firsts = sketched.join(named.where("doc_id = first").select("doc_id", "set_a", "set_b"), ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id", "set_a", "set_b"])
    return written(firsts, "firsts"), named


def buckets(firsts: DataFrame) -> DataFrame:
    """(bucket, low, n, shingles, doc_id) of the distinct sets of two or more documents that share a band; ``low`` is the least of them.

    Sets are told apart by count, least, greatest and a hash over their members, so members are never gathered; of the bands
    of one and the same set the first counts, which is the least key.
    """
    keys = firsts.select(F.explode("bands").alias("key"), "doc_id", "size")
    seen = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bit_xor(F.xxhash64("doc_id")).alias("mark"), F.sum("size").alias("shingles")]
    groups = keys.groupBy("key").agg(*seen).where("n > 1").groupBy("n", "low", "high", "mark", "shingles").agg(F.min("key").alias("key"))
    groups = written(groups.select("key", "n", "low", "shingles"), "groups")
    return written(keys.select("key", "doc_id").join(small(groups), "key").select(F.col("key").alias("bucket"), "low", "n", "shingles", "doc_id"), "buckets")


def tiled(members: DataFrame) -> DataFrame:
    """``members`` (bucket, n, shingles, doc_id, ...) once for each of its tiles: (tile, bucket, kind, doc_id, ...); kind is 0 in a tile of one part, else 1 or 2 by part."""
    parts = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), parts).cast("int")
    other = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tile = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    kind = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return other.withColumns({"tile": tile, "kind": kind}).drop("part", "other", "n", "shingles", "low")


class Chooser:
    """Which pairs of a tile's rows are candidates: those that share a band, in a bucket's tile those whose first common band it is."""

    columns = ("bands",)

    def __init__(self, table: pa.Table) -> None:
        self.bucket = table.column("bucket").fill_null(-1).to_numpy()  # keys aren't negative; a null is a tile of no bucket
        bands = table.column("bands").combine_chunks()
        self.bands = bands.flatten().to_numpy().reshape(len(bands), -1)

    def __call__(self, a: int, others: np.ndarray) -> np.ndarray:
        same = self.bands[others] == self.bands[a]
        if self.bucket[a] < 0:
            return others[same.any(axis=1)]
        first = same.argmax(axis=1)
        return others[self.bands[a][first] == self.bucket[a]]

    def joined(self, a: int, found: np.ndarray) -> None:
        """Is told of what was verified."""


class Sets:
    """The shingle sets of a tile, coded by their place among its distinct shingles."""

    def __init__(self, made: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in made])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        every, self.codes = np.unique(np.concatenate(made), return_inverse=True)
        self.has = np.zeros(len(every), bool)

    def similarities(self, a: int, bs: np.ndarray) -> np.ndarray:
        own = self.codes[self.starts[a] : self.ends[a]]
        self.has[own] = True
        if 4 * len(bs) > len(self.sizes):
            sums = np.append(0, np.cumsum(self.has[self.codes]))
            both = (sums[self.ends] - sums[self.starts])[bs]
        else:
            both = np.array([np.count_nonzero(self.has[self.codes[self.starts[b] : self.ends[b]]]) for b in bs.tolist()], np.int64)
        self.has[own] = False
        return both / (self.sizes[a] + self.sizes[bs] - both)


def _tables(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Record batches that are sorted by their first column, regrouped so that none of its values is split."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        k = table.column(0).to_numpy()
        if cut := int(np.searchsorted(k, k[-1], side="left")):
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, rows = table.combine_chunks().to_batches(), table.num_rows
        least = max(least, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tiles(table: pa.Table) -> Iterator[tuple[int, int]]:
    k = table.column(0).to_numpy()
    cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)])


def _sides(kind: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, the rows that it meets) of a tile whose rows are sorted by kind."""
    second = begin + int(np.searchsorted(kind[begin:end], 2))
    every = np.arange(begin, end)
    for a in range(begin, second):
        others = every[a + 1 - begin :] if kind[a] == 0 else every[second - begin :]
        if len(others):
            yield a, others


def needed(rows: DataFrame, chooser: type[Chooser]) -> DataFrame:
    """(tile, bucket, kind, doc_id) of the rows (tile, bucket, kind, doc_id, marks) that have a candidate in their tile."""

    def run(batches):
        for table in _tables(batches, 1 << 14):
            kind, pick = table.column("kind").to_numpy(), chooser(table)
            hit = np.zeros(len(kind), bool)
            for begin, end in _tiles(table):
                for a, others in _sides(kind, begin, end):
                    found = pick(a, others)
                    hit[found] = True
                    hit[a] |= len(found) > 0
            for batch in table.select(["tile", "bucket", "kind", "doc_id"]).filter(pa.array(hit)).to_batches():
                yield batch

    columns = ["tile", "bucket", "kind", "doc_id", *chooser.columns]
    return rows.select(*columns).repartition("tile").sortWithinPartitions("tile", "kind", "doc_id").mapInArrow(trimmed(run), "tile long, bucket long, kind int, doc_id long")


def sent(docs: DataFrame, meet: DataFrame, marks: DataFrame, words: int) -> DataFrame:
    """``meet`` (tile, bucket, kind, doc_id): a row with each document's ``marks`` (doc_id, set_a, set_b, ...), and one with its shingle set.

    A document's set is made once, from a text that has its hash, whichever tiles it goes to.
    """
    meet = written(meet, "meet")
    held = written(meet.groupBy("doc_id").agg(F.collect_list(F.struct("tile", "bucket", "kind")).alias("at")), "held")
    own = written(marks.join(small(held.select("doc_id")), "doc_id"), "marks")  # of those that meet
    met = written(held.join(own.select("doc_id", "set_a", "set_b"), "doc_id"), "met")

    def expand(batches):
        for batch in batches:
            made = sets(batch.column("text"), words)
            h = set_hashes(made)
            right = (h[:, 0] == batch.column("set_a").to_numpy()) & (h[:, 1] == batch.column("set_b").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("doc_id"), ragged(made)], ["at", "doc_id", "shingles"]).filter(pa.array(right))

    rows = named_texts(docs).join(small(met, array="at"), "doc_id").select("doc_id", "text", "set_a", "set_b", "at")
    made = rows.mapInArrow(trimmed(expand), "at array<struct<tile:long,bucket:long,kind:int>>, doc_id long, shingles binary")
    spread = made.select(F.explode("at").alias("at"), "doc_id", "shingles").select("at.*", "doc_id", "shingles")
    others = own.drop("set_a", "set_b")
    return (meet.join(others, "doc_id") if len(others.columns) > 1 else meet).unionByName(spread, allowMissingColumns=True)


def verify(rows: DataFrame, chooser: type[Chooser], threshold: float, emit: Callable, schema: str) -> DataFrame:
    """What ``emit`` makes of the verified candidates of each tile of ``sent`` rows.

    ``emit`` gets arrays (a, b, jaccard) of the documents of one tile's pairs that reach the threshold, in order of a, and
    returns columns.
    """

    def one_each(table: pa.Table) -> pa.Table:
        tile, ids = table.column("tile").to_numpy(), table.column("doc_id").to_numpy()
        new = np.append(True, (tile[1:] != tile[:-1]) | (ids[1:] != ids[:-1]))
        return table.filter(pa.array(new)).combine_chunks()

    def run(batches):
        for table in _tables(batches, 1):
            no_set = table.column("shingles").is_null()
            made = [np.frombuffer(s.as_buffer(), np.uint64) for s in one_each(table.filter(pc.invert(no_set))).column("shingles").combine_chunks()]
            table = one_each(table.filter(no_set))
            kind, ids, pick, out = table.column("kind").to_numpy(), table.column("doc_id").to_numpy(), chooser(table), []
            for begin, end in _tiles(table):
                pairs: tuple[list, list, list] = ([], [], [])
                held = None
                for a, others in _sides(kind, begin, end):
                    found = pick(a, others)
                    if not len(found):
                        continue
                    if end - begin == 2:
                        j = np.array([jaccard(made[begin], made[begin + 1])])
                    else:
                        held = held or Sets(made[begin:end])
                        j = held.similarities(a - begin, found - begin)
                    ok = j >= threshold
                    if ok.any():
                        found = found[ok]
                        pick.joined(a, found)
                        for column, x in zip(pairs, (np.full(len(found), ids[a]), ids[found], j[ok])):
                            column.append(x)
                if pairs[0]:
                    out.append(emit(*(np.concatenate(x) for x in pairs)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    names = [f.split()[0] for f in schema.split(", ")]
    columns = ["tile", "bucket", "kind", "doc_id", *chooser.columns, "shingles"]
    return rows.select(*columns).repartition("tile").sortWithinPartitions("tile", "kind", "doc_id").mapInArrow(trimmed(run), schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that join what isn't joined by the ones before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            keep[k] = True
    return a[keep], b[keep]
