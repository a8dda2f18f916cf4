"""Purchase orders, catalogs and processed order numbers from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = "purchase_order_number STRING, customer_id STRING, currency STRING, lines ARRAY<STRUCT<sku: STRING, quantity: STRING, unit_price: STRING>>"


def read_order(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines); order_id is the file."""
    rows = spark.read.schema(ORDER).json(path, multiLine=True).withColumn("order_id", F.input_file_name())
    lines = rows.select("order_id", F.posexplode("lines").alias("line_index", "l")).select("order_id", "line_index", "l.sku", "l.quantity", "l.unit_price")
    return rows.drop("lines"), lines


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(sku, price, inventory) of a JSON object keyed by sku."""
    rows = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "MAP<STRING, STRUCT<price: STRING, inventory: STRING>>")
    return rows.select(F.explode(entries).alias("sku", "v")).select("sku", "v.price", "v.inventory")


def read_seen(spark: SparkSession, path: str | None) -> DataFrame:
    """Processed order numbers of a JSON array; anything else counts as none."""
    if path is None:
        return spark.createDataFrame([], "po STRING")
    rows = spark.read.text(path, wholetext=True).where(F.trim("value").startswith("["))
    return rows.select(F.explode(F.from_json("value", "ARRAY<STRING>")).alias("po"))
