"""Provenance and data-quality flags, as expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.catalog import AS_OF, TABLES

#: Tables whose supplier_id or product_id must exist in the dimension.
SUPPLIER_TABLES = ("products", "shipments", "purchase_orders", "supplier_events")
PRODUCT_TABLES = ("inventory_daily", "demand_daily", "order_items", "purchase_orders", "promotions")
STALE_DAYS = 3


def missing_fields(columns: list[str]) -> Column:
    """How many of the columns are null."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total.cast("int")


def with_provenance(df: DataFrame, table: str, as_of: str = AS_OF, dataset: str = "synthetic", ordinal: str = "_ordinal") -> DataFrame:
    """Adds the provenance columns; the record id is the row's position, from the ordinal column."""
    missing = missing_fields([c for c in df.columns if c != ordinal])
    record = F.concat(F.lit(f"{table}:"), F.col(ordinal).cast("string"))
    return df.withColumns({
        "source_dataset": F.lit(dataset),
        "source_record_id": record,
        "synthetic_entity_id": F.concat(F.lit("syn:"), record),
        "missing_field_count": missing,
        "data_quality_flag": F.when(missing > 0, "missing_fields").otherwise("ok"),
        "record_timestamp": F.lit(f"{as_of} 12:00:00").cast("timestamp_ntz"),
    }).drop(ordinal)


def flagged(df: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """data_quality_flag with the reasons that hold appended in order; 'ok' only where none does."""
    held = F.array(F.nullif(F.col("data_quality_flag"), F.lit("ok")), *(F.when(cond, reason) for cond, reason in reasons))
    text = F.concat_ws(";", F.array_compact(held))
    return df.withColumn("data_quality_flag", F.when(text == "", "ok").otherwise(text))


def unknown(df: DataFrame, dimension: DataFrame, key: str, mark: str) -> DataFrame:
    """Boolean column `mark`: the key is null or absent from the dimension.

    A left join on the distinct keys: Spark broadcasts them while they are small and merges otherwise.
    """
    known = dimension.select(F.col(key).alias("_known")).where(F.col(key).isNotNull()).distinct()
    return df.join(known, F.col(key) == F.col("_known"), "left").withColumn(mark, F.col("_known").isNull()).drop("_known")


def duplicated(df: DataFrame, key: str, mark: str) -> DataFrame:
    """Boolean column `mark`: another row has the same key, nulls being equal.

    Counts are aggregated before they are joined back, so a key with very many copies never meets in one task.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_copies")).where("_copies > 1")
    return df.join(counts, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(mark, F.col("_copies").isNotNull()).drop("_key", "_copies")


def impossible() -> Column:
    """Delivered before shipped; unknown dates are not judged."""
    return F.coalesce(F.col("delivered_date") < F.col("shipped_date"), F.lit(False))


def stale(as_of: str = AS_OF, days: int = STALE_DAYS) -> Column:
    return F.coalesce(F.col("inventory_date") < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))


def flag_quality(tables: dict[str, DataFrame], as_of: str = AS_OF) -> dict[str, DataFrame]:
    """Flags in order: missing_fields, unknown_supplier, unknown_product, duplicate_shipment,
    impossible_delivery_date, stale_inventory."""
    out = {}
    for name, df in tables.items():
        reasons: list[tuple[Column, str]] = []
        if name in SUPPLIER_TABLES:
            df = unknown(df, tables["suppliers"], "supplier_id", "_no_supplier")
            reasons.append((F.col("_no_supplier"), "unknown_supplier"))
        if name in PRODUCT_TABLES:
            df = unknown(df, tables["products"], "product_id", "_no_product")
            reasons.append((F.col("_no_product"), "unknown_product"))
        if name == "shipments":
            df = duplicated(df, "shipment_id", "_copy")
            reasons += [(F.col("_copy"), "duplicate_shipment"), (impossible(), "impossible_delivery_date")]
        if name == "inventory_daily":
            reasons.append((stale(as_of), "stale_inventory"))
        out[name] = flagged(df, reasons).drop("_no_supplier", "_no_product", "_copy") if reasons else df
    return out


def business_columns(table: str) -> list[str]:
    return list(TABLES[table])
