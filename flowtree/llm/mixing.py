"""Mixing sources to target weights by a low-discrepancy schedule.

1. Each source's documents are put in the order of a seeded hash, and their tokens, laid end to end, are cut into
   blocks of equal token counts; a document lies in every block that it reaches into.
2. Slot i of the schedule takes the point frac(i / golden ratio), in exact 32-bit arithmetic, and the source in whose
   share of the cumulative weights it falls. Any stretch of the schedule then holds each source in nearly its weight.
   Points repeat after 2^32 slots, in which each of the 2^32 comes once.
3. A source's slots are ranked, and slot of rank k gets its k-th block; past the last block it starts over, as the next
   epoch. There are as many slots as the corpus has blocks, so sources of less than their target share repeat, and those
   of more are used in part. That is the mixture, not a limit.

Ranks and running token counts are prefix sums over hash ranges and slot ranges: windows are never wider than a range,
however large a source is, and the number of ranges follows the input. A token is a run of characters without a space, tab or line break.

Default weights are each source's token share to the power FLATTEN, normalised.

Defined results: a null source is a source of its own, named ''; a document of a null doc_id, or without a token, takes
no place and is left out. Repeated rows each take their place (ties of the hash are ordered by doc_id and token count). Sources given no weight
aren't scheduled; weights of absent sources are left out and the rest normalised. An empty table gives an empty schedule.
Only doc_id, source and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written
from .tiles import small

#: Production parameters: tokens of a block, flattening of the natural shares, seed of the shuffle.
BLOCK_TOKENS, FLATTEN, SEED = 2048, 0.7, "mix-1"
#: Documents of a hash range and slots of a slot range, about.
RANGE = 20_000
_GOLDEN, _FULL = 2654435769, 1 << 32


def spans(totals: DataFrame, weights: dict[str, float] | None, flatten: float) -> DataFrame:
    """(source, blocks, low, high) of ``totals`` (source, n, blocks): the span of each source in the cumulative weights, by name. One row a source, in one task."""
    if weights is None:
        whole = totals.agg(F.sum("n").cast("double")).first()[0]
        raw = totals.withColumn("w", F.pow(F.col("n") / F.lit(whole), F.lit(flatten))) if whole else totals.withColumn("w", F.lit(0.0))
    else:
        given = totals.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()] or [("", 0.0)], "source string, w double")
        raw = totals.join(given, "source")
    raw = raw.where("w > 0")
    total = raw.agg(F.sum("w")).first()[0]
    if total is None:
        return totals.limit(0).select("source", "blocks", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    by_name = Window.orderBy("source")
    high = F.when(F.lead("source").over(by_name).isNull(), 1.0).otherwise(F.sum("w").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total))
    return raw.select("source", "blocks", high.alias("high")).withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0)))


def points(slot: Column) -> Column:
    """(slot * golden ratio) mod 2^32, for any slot of 64 bits; halves are multiplied apart, so that nothing overflows."""
    low, high = slot.bitwiseAND(F.lit(0xFFFF)), F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF))
    return (high * F.lit(_GOLDEN) % F.lit(1 << 16) * F.lit(1 << 16) + low * F.lit(_GOLDEN)) % F.lit(_FULL)


def drawn(slots: DataFrame, placed: DataFrame, sources: int) -> DataFrame:
    """``slots`` (slot) with the source, and its blocks, in whose span the slot's point falls.

    The unit interval is cut into cells, some for each source, so that the spans are joined by equality; ``placed`` is as
    ``spans`` gives it. The table of cells goes to every executor while it is small.
    """
    bits = min(30, max(1, (2 * sources).bit_length()))
    first, last = F.floor(F.col("low") * F.lit(1 << bits)), F.least(F.ceil(F.col("high") * F.lit(1 << bits)) - 1, F.lit((1 << bits) - 1))
    cells = written(placed.where("low < high").select("source", "blocks", "low", "high", F.explode(F.sequence(first, last)).alias("cell")), "cells")
    at = slots.withColumn("p", points(F.col("slot"))).withColumn("cell", F.shiftright("p", 32 - bits))
    u = F.col("p") / F.lit(float(_FULL))
    return at.join(small(cells), "cell").where((u >= F.col("low")) & (u < F.col("high"))).select("slot", "source", "blocks")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, flatten: float = FLATTEN, seed: str = SEED) -> DataFrame:
    """(slot, source, epoch, block, doc_id, start, tokens): which tokens of which document fill each slot."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")).cast("long").alias("n"))
    hashed = named.where("doc_id is not null and n > 0").withColumn("h", F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"))), 1, 15))
    sized = written(hashed, "sized")
    totals = sized.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).withColumn("blocks", F.ceil(F.col("n") / block_tokens))
    totals = written(totals, "totals")
    slots, most, sources = totals.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("d"), F.lit(0)), F.count(F.lit(1))).first()

    # blocks: running token counts of each source in hash order, range by range
    digits = max(1, math.ceil(math.log(max(1, most / RANGE), 16)))
    ranged = sized.withColumn("r", F.substring("h", 1, digits))
    before = _prefix(ranged.groupBy("source", "r").agg(F.sum("n").alias("total")), ["source"], "r")
    inside = Window.partitionBy("source", "r").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("so_far", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, ["source", "r"])
    at = placed.select("source", "doc_id", "n", (F.col("so_far") + F.col("before")).alias("at"))
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("n") - 1) / block_tokens))))
    low, high = F.greatest("at", F.col("block") * block_tokens), F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * block_tokens)
    pieces = pieces.select("source", "block", "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("tokens"))

    # slots: the source of each, and its rank among that source's, range by range
    taken = drawn(spark.range(slots).withColumnRenamed("id", "slot"), spans(totals, weights, flatten), sources).withColumn("r", F.floor(F.col("slot") / RANGE))
    earlier = _prefix(taken.groupBy("source", "r").agg(F.count(F.lit(1)).alias("total")), ["source"], "r")
    ranked = taken.withColumn("k", F.row_number().over(Window.partitionBy("source", "r").orderBy("slot")) - 1).join(earlier, ["source", "r"])
    rank = F.col("k") + F.col("before")
    filled = ranked.select("slot", "source", F.floor(rank / F.col("blocks")).alias("epoch"), (rank % F.col("blocks")).alias("block"))
    return filled.join(pieces, ["source", "block"]).select("slot", "source", "epoch", "block", "doc_id", "start", "tokens")


def _prefix(totals: DataFrame, by: list[str], order: str) -> DataFrame:
    """The sum of ``total`` over the ranges before each one; there is one row a range, some thousands of times fewer than rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, order, F.coalesce(F.sum("total").over(w), F.lit(0)).alias("before"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(docs: str = "documents", block_tokens: int = BLOCK_TOKENS, flatten: float = FLATTEN, seed: str = SEED) -> str:
    """DuckDB SQL of ``schedule`` with default weights over a relation."""
    return f"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS n,
         substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 15) AS h
  FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
held AS (SELECT * FROM sized WHERE n > 0),
totals AS (SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(ceil(sum(n) / {block_tokens}.0) AS BIGINT) AS blocks FROM held GROUP BY source),
raw AS (SELECT source, power(CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM totals), {flatten}) AS w FROM totals),
cum AS (SELECT source, sum(w) OVER (ORDER BY source) / (SELECT sum(w) FROM raw) AS high, row_number() OVER (ORDER BY source DESC) = 1 AS last FROM raw),
spans AS (SELECT source, coalesce(lag(high) OVER (ORDER BY source), 0.0) AS low, CASE WHEN last THEN 1.0 ELSE high END AS high FROM cum),
slots AS (SELECT i AS slot, ((CAST(i AS HUGEINT) * {_GOLDEN}) % {_FULL})::DOUBLE / {_FULL}.0::DOUBLE AS u FROM range((SELECT CAST(sum(blocks) AS BIGINT) FROM totals)) t(i)),
drawn AS (SELECT slot, s.source, row_number() OVER (PARTITION BY s.source ORDER BY slot) - 1 AS k FROM slots JOIN spans s ON u >= s.low AND u < s.high),
filled AS (SELECT slot, d.source, k // blocks AS epoch, k % blocks AS block FROM drawn d JOIN totals t ON d.source = t.source),
laid AS (SELECT source, doc_id, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS pos FROM held),
pieces AS (SELECT source, unnest(range(pos // {block_tokens}, (pos + n - 1) // {block_tokens} + 1)) AS block, doc_id, n, pos FROM laid)
SELECT f.slot, f.source, f.epoch, f.block, p.doc_id, greatest(p.pos, p.block * {block_tokens}) - p.pos AS start,
       least(p.pos + p.n, (p.block + 1) * {block_tokens}) - greatest(p.pos, p.block * {block_tokens}) AS tokens
FROM filled f JOIN pieces p ON f.source = p.source AND f.block = p.block
"""
