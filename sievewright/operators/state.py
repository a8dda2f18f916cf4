"""Run state: scored candidates and seen receipts as versioned parquet tables.

A save writes a new version folder, which counts once its _SUCCESS file is there, so
readers always see whole versions and a failed run leaves the old ones in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame | None, new: DataFrame, key: str = "rcept_no", order: str = "updated_at") -> DataFrame:
    """One row a key: the latest by ``order`` (of the new rows at a tie), keeping the
    earliest first_seen_at."""
    rows = new.withColumn("sw_new", F.lit(1)).withColumn("first_seen_at", F.col(order))
    if old is not None:
        rows = old.withColumn("sw_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    by_key = Window.partitionBy(key)
    rows = rows.withColumn("first_seen_at", F.min("first_seen_at").over(by_key))
    best = F.row_number().over(by_key.orderBy(F.col("sw_new").desc(), F.col(order).desc()))
    return rows.withColumn("sw_n", best).where("sw_n = 1").drop("sw_n", "sw_new")


class StateTable:
    """A table below ``root`` on any file system that Spark reads.

    A save writes the new rows only, as version d<n>; every ``compact``-th version holds
    the whole state, as b<n>, in order of company and date so that lookups skip files.
    Readers fold the versions from the last whole one on, by the rule of ``upsert``."""

    def __init__(self, spark: SparkSession, root: str, compact: int = 20):
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, str]:
        """Complete versions and their folders."""
        at = self._path(self.root)
        if not self._fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return {int(n[1:]): n for n in names if n[0] in "bd" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))}

    def version(self) -> int:
        """The newest complete version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _folders(self) -> list[tuple[int, str]]:
        """The last whole version and those after it."""
        have = self._versions()
        base = max((v for v, n in have.items() if n[0] == "b"), default=0)
        return sorted((v, n) for v, n in have.items() if v >= base)

    def read(self, where: Column | None = None) -> DataFrame | None:
        """The state, or its rows that meet a condition on columns that never change for a receipt."""
        parts = [self.spark.read.parquet(f"{self.root}/{n}").withColumn("sw_v", F.lit(v)) for v, n in self._folders()]
        if not parts:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows = rows if where is None else rows.where(where)
        if len(parts) == 1:
            return rows.drop("sw_v", "sw_key", "sw_order")
        by_key = Window.partitionBy("sw_key")
        rows = rows.withColumn("first_seen_at", F.min("first_seen_at").over(by_key))
        rows = rows.withColumn("sw_n", F.row_number().over(by_key.orderBy(F.col("sw_v").desc(), F.col("sw_order").desc())))
        return rows.where("sw_n = 1").drop("sw_n", "sw_v", "sw_key", "sw_order")

    def save(self, rows: DataFrame, key: str = "rcept_no", order: str = "updated_at") -> int:
        """Upsert rows and publish them as the next version (complete once _SUCCESS is there)."""
        v = self.version() + 1
        if v % self.compact:
            out, kind = upsert(None, rows, key, order), "d"
        else:
            out, kind = upsert(self.read(), rows, key, order), "b"
            near = [c for c in ("corp_code", "rcept_dt") if c in out.columns]
            out = out.repartitionByRange(*near).sortWithinPartitions(*near) if near else out
        out.withColumns({"sw_key": F.col(key), "sw_order": F.col(order)}).write.mode("overwrite").parquet(f"{self.root}/{kind}{v}")
        return v

    def seen(self) -> DataFrame | None:
        rows = self.read()
        return None if rows is None else rows.select("rcept_no")

    def recent_events(self, corp_code: str, start: str, end: str, exclude: str) -> DataFrame | None:
        """Stored events of one company within dates, in order; the conditions reach the scans."""
        inside = (F.col("corp_code") == corp_code) & F.col("rcept_dt").between(start, end) & (F.col("rcept_no") != exclude)
        rows = self.read(inside)
        return None if rows is None else rows.orderBy("rcept_dt", "rcept_no")
