"""Order-intake validation: order lines against a catalog and seen order numbers.

Lines are checked independently, so validation is one projection after two equi
joins; only clean lines count towards the order total, priced lines with findings
go to the quarantined total, and unpriced ones add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decimal, text

#: Codes and messages in the order in which they are listed.
ORDER_CODES = {
    "missing_po_number": "Purchase order number is required.",
    "duplicate_po": "Purchase order {po} was already processed.",
    "missing_customer": "Customer identifier is required.",
    "missing_currency": "Currency is required.",
    "missing_lines": "At least one order line is required.",
}
LINE_CODES = {
    "missing_sku": "SKU is required.",
    "invalid_quantity": "Quantity must be a positive integer.",
    "invalid_price": "Unit price must be non-negative.",
    "unknown_sku": "SKU {sku} is not in the catalog.",
    "catalog_price_missing": "Catalog price missing for {sku}.",
    "price_mismatch": "{sku}: order price {price} != catalog price {expected}.",
    "inventory_missing": "Inventory missing for {sku}.",
    "insufficient_inventory": "{sku}: requested {quantity}, available {available}.",
}
#: A line with one of these stops there and has no price.
UNPRICED = ("missing_sku", "invalid_quantity", "invalid_price", "unknown_sku")


def _scale(x: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.length(F.regexp_extract(text(x), r"\.(\d+)$", 1))


def _message(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def validate_lines(lines: DataFrame, catalog: DataFrame, *, tolerance: str = "0.01") -> DataFrame:
    """Each line (order_id, line_index, sku, quantity, unit_price) with codes (in
    order), exceptions, status clean, quarantined or unpriced, and line_total.
    The catalog (sku, price, inventory) must have one row a sku."""
    known = catalog.select(
        F.col("sku").alias("sw_sku"), decimal(F.col("price")).alias("expected"), decimal(F.col("inventory")).alias("available"),
        text(F.col("price")).alias("sw_price"), text(F.col("inventory")).alias("sw_stock"),
    )
    rows = lines.withColumns({"sw_key": text(F.col("sku")), "q": decimal(F.col("quantity")), "p": decimal(F.col("unit_price"))})
    rows = rows.join(known, F.col("sw_key") == F.col("sw_sku"), "left")
    q, p, sku = F.col("q"), F.col("p"), F.col("sw_key")
    stop = (
        F.when(sku == "", "missing_sku")
        .when(q.isNull() | (q <= 0) | (q != F.floor(q)), "invalid_quantity")
        .when(p.isNull() | (p < 0), "invalid_price")
        .when(F.col("sw_sku").isNull(), "unknown_sku")
    )
    rows = rows.withColumn("stop", stop)
    price = F.when(F.col("expected").isNull(), "catalog_price_missing").when(F.abs(p - F.col("expected")) > F.lit(tolerance).cast("decimal(38,6)"), "price_mismatch")
    stock = F.when(F.col("available").isNull(), "inventory_missing").when(q > F.col("available"), "insufficient_inventory")
    codes = F.when(F.col("stop").isNotNull(), F.array("stop")).otherwise(F.array_compact(F.array(price, stock)))
    values = {"sku": sku, "price": text(F.col("unit_price")), "expected": F.col("sw_price"), "quantity": text(F.col("quantity")), "available": F.col("sw_stock")}

    def exception(code: Column) -> Column:
        message = F.lit("")
        for name, template in LINE_CODES.items():
            used = {k: v for k, v in values.items() if "{" + k + "}" in template}
            message = F.when(code == name, _message(template, **used)).otherwise(message)
        return F.struct(code.alias("code"), message.alias("message"), F.col("line_index").cast("int").alias("line_index"), F.nullif(sku, F.lit("")).alias("sku"))

    rows = rows.withColumn("codes", codes)
    status = F.when(F.col("stop").isNotNull(), "unpriced").when(F.size("codes") > 0, "quarantined").otherwise("clean")
    return rows.select(
        "order_id", "line_index", F.nullif(sku, F.lit("")).alias("sku"), "quantity", "unit_price", "codes",
        F.transform("codes", exception).alias("exceptions"),
        status.alias("status"),
        F.when(F.col("stop").isNull(), (q * p).cast("decimal(38,6)")).alias("line_total"),
        F.when(F.col("stop").isNull(), _scale(F.col("quantity")) + _scale(F.col("unit_price"))).alias("scale"),
    )


def _total_text(total: Column, scale: Column) -> Column:
    """A decimal total with as many digits as its widest summand; no summand is 0."""
    whole = F.coalesce(total, F.lit(0).cast("decimal(38,6)")).cast("string")
    point = F.instr(whole, ".")
    return F.when(total.isNull(), "0").when(scale == 0, F.substring_index(whole, ".", 1)).otherwise(F.substring(whole, 1, point + scale))


def summarise_orders(headers: DataFrame, validated: DataFrame, seen: DataFrame) -> DataFrame:
    """One row an order: status, normalised header fields, exception codes in order,
    exact totals (numbers and texts) and the lines of either kind. ``seen`` holds
    processed order numbers in its first column."""
    line = F.struct("line_index", "sku", F.col("quantity").cast("string").alias("quantity"), F.col("unit_price").cast("string").alias("unit_price"), "line_total", "codes", F.when(F.col("line_total").isNotNull(), _total_text(F.col("line_total"), F.col("scale"))).alias("line_total_text"))
    clean, quarantined = F.col("status") == "clean", F.col("status") == "quarantined"
    sums = validated.groupBy("order_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.when(clean, F.col("line_total"))).alias("t"),
        F.max(F.when(clean, F.col("scale"))).alias("ts"),
        F.sum(F.when(quarantined, F.col("line_total"))).alias("qt"),
        F.max(F.when(quarantined, F.col("scale"))).alias("qs"),
        F.array_sort(F.collect_list(F.when(clean, line))).alias("normalized_lines"),
        F.array_sort(F.collect_list(F.when(~clean, line))).alias("quarantined_lines"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "codes", "exceptions"))), lambda x: x["exceptions"])).alias("line_exceptions"),
    )
    po = seen.select(F.col(seen.columns[0]).cast("string").alias("sw_seen")).distinct()
    rows = headers.withColumns({"po": text(F.col("purchase_order_number")), "customer": text(F.col("customer_id")), "cur": F.upper(text(F.col("currency")))})
    rows = rows.select("order_id", "po", "customer", "cur").join(po, F.col("po") == F.col("sw_seen"), "left").join(sums, "order_id", "left")
    checks = {
        "missing_po_number": F.col("po") == "",
        "duplicate_po": (F.col("po") != "") & F.col("sw_seen").isNotNull(),
        "missing_customer": F.col("customer") == "",
        "missing_currency": F.col("cur") == "",
        "missing_lines": F.coalesce("n_lines", F.lit(0)) == 0,
    }
    own = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), _message(ORDER_CODES[code], po=F.col("po")).alias("message"), F.lit(None).cast("int").alias("line_index"), F.lit(None).cast("string").alias("sku"))) for code, cond in checks.items())))
    rows = rows.withColumn("exceptions", F.concat(own, F.coalesce("line_exceptions", F.array().cast("array<struct<code:string,message:string,line_index:int,sku:string>>"))))
    zero = F.lit(0).cast("decimal(38,6)")
    return rows.select(
        "order_id",
        F.when(F.size("exceptions") == 0, "ready_for_draft").otherwise("needs_review").alias("status"),
        F.nullif("po", F.lit("")).alias("purchase_order_number"),
        F.nullif("customer", F.lit("")).alias("customer_id"),
        F.nullif("cur", F.lit("")).alias("currency"),
        F.coalesce(F.col("t").cast("decimal(38,6)"), zero).alias("order_total"),
        F.coalesce(F.col("qt").cast("decimal(38,6)"), zero).alias("quarantined_total"),
        _total_text(F.col("t").cast("decimal(38,6)"), F.col("ts")).alias("order_total_text"),
        _total_text(F.col("qt").cast("decimal(38,6)"), F.col("qs")).alias("quarantined_total_text"),
        "exceptions",
        # An order without lines has empty lists.
        *(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("normalized_lines", "quarantined_lines")),
    )
