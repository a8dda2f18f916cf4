"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Sizes of the shards are fixed first (counts at most one apart). A matrix tells how
many rows each partition sends to each shard: its rows are drawn one after another
from the multivariate hypergeometric law of what the shards still lack, so row and
column sums are exact. Each partition permutes its rows and deals them by its row
of the matrix; after the exchange every shard permutes again. The result is a
uniformly random permutation cut into shards.

Only numbers travel: ids, sizes, checksums and positions; the texts stay where they
are until ``write_shards`` is asked for files. Rows are pinned to partitions by a
table in the shared folder, so a lost executor cannot change a draw. A shard's
second permutation sorts by a keyed hash in blocks of bounded size, with offsets
from a small table of counts, so no task holds a whole shard.

Law ``rows``: shard sizes differ by one at most. Groups of equal texts are not kept
together (a uniform shuffle must not).

Defined cases: a null text has size 1 and the checksum of the empty text; null ids
and repeated rows are rows like any other; other columns are not read; an empty
table gives an empty result; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Row counts of the shards, at most one apart."""
    return np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)


def communication_matrix(partition_sizes: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent by each partition to each shard; row and column sums are exact."""
    rng, lack = np.random.default_rng(seed), sizes.astype(np.int64).copy()
    out = np.zeros((len(partition_sizes), len(sizes)), np.int64)
    for i, n in enumerate(partition_sizes):
        out[i] = _draw(rng, lack, n)
        lack -= out[i]
    return out


def _draw(rng: np.random.Generator, lack: np.ndarray, n: int) -> np.ndarray:
    """How ``n`` rows fall into the free places of the shards: the multivariate
    hypergeometric law, one shard after another."""
    out, rest = np.zeros(len(lack), np.int64), int(lack.sum())
    for i, free in enumerate(lack.tolist()):
        if n == 0:
            break
        rest -= free
        out[i] = hypergeometric(rng, free, rest, n)
        n -= int(out[i])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` places drawn from good + bad are good, for numbers of any size:
    ratio of uniforms with a table mountain hat (Stadlober 1989); few places are
    drawn one by one."""
    total = good + bad
    few, m = min(good, bad), min(n, total - n)
    if m < 10:
        z, left, places = 0, few, total
        for _ in range(m):
            if rng.random() * places < left:
                z, left = z + 1, left - 1
            places -= 1
    else:
        many, share = max(good, bad), few / total
        centre = m * share + 0.5
        spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
        width = 1.7155277699214135 * spread + 0.8989161620588988
        mode = int((m + 1) * (few + 1) / (total + 2))
        weight = lambda k: math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(m - k + 1) + math.lgamma(many - m + k + 1)
        peak = weight(mode)
        end = min(min(m, few) + 1, math.floor(centre + 16 * spread))
        while True:
            x, y = rng.random(), rng.random()
            if x == 0:
                continue
            w = centre + width * (y - 0.5) / x
            if not 0 <= w < end:
                continue
            z = int(w)
            if many - m + z >= 0 and 2 * math.log(x) <= peak - weight(z):
                break
    # What was drawn counts the rarer kind among the m drawn or left.
    if good > bad:
        z = m - z
    return z if m == n else good - z


def _key(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _pinned(documents: DataFrame, id_col: str, text_col: str, *columns: str) -> DataFrame:
    """The rows' numbers (and further columns), pinned to partitions and places by a table in the shared folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(
        F.struct(*columns).alias("sw_row") if columns else F.lit(None).alias("sw_row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return written(rows if columns else rows.drop("sw_row"), "rows")[0]


def assign_shards(documents: DataFrame, *, shards: int = 16, seed: int = 20240, block_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard and slot (gapless from 0)."""
    return _assign(_pinned(documents, id_col, text_col), shards, seed, block_rows)


def _assign(rows: DataFrame, shards: int, seed: int, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()}
    total = sum(sizes.values())
    matrix = communication_matrix(list(sizes.values()), shard_sizes(total, shards), seed)
    bounds = [(p, row) for p, row in zip(sizes, np.cumsum(matrix, axis=1).tolist(), strict=True)]
    # One row of numbers for each input partition; Spark picks the join by its size.
    bounds = spark.createDataFrame(bounds, "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy(_key(seed, F.col("part"), F.col("pos")), "pos")
    dealt = rows.withColumn("rank", F.row_number().over(local) - 1).join(bounds, "part")
    dealt = dealt.select("doc_id", "size", "text_crc32", "pos", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))

    blocks = max(1, -(-total // (shards * block_rows)))
    second = _key(seed + 1, F.col("pos"))
    dealt = dealt.withColumn("h", second).withColumn("block", F.floor((F.col("h") / 2.0**64 + 0.5) * blocks).cast("int"))
    dealt, _ = written(dealt, "dealt")
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("h", "pos")
    placed = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "pos", "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot"))


def write_shards(documents: DataFrame, path: str, *, shards: int = 16, seed: int = 20240, block_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' rows as Parquet, a folder for each shard, in slot order.
    Rows are found again by the place they were pinned to, so null and repeated ids
    are rows like any other."""
    rows = _pinned(documents, id_col, text_col, *documents.columns)
    placed = _assign(rows.drop("sw_row"), shards, seed, block_rows).select("pos", F.col("shard").alias("sw_shard"), F.col("slot").alias("sw_slot"))
    joined = rows.select("sw_row", "pos").join(placed, "pos").drop("pos")
    ordered = joined.repartition("sw_shard", F.floor(F.col("sw_slot") / block_rows)).sortWithinPartitions("sw_shard", "sw_slot")
    ordered.select("sw_row.*", F.col("sw_shard").alias("shard"), F.col("sw_slot").alias("slot")).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts."""
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
