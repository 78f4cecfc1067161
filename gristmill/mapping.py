"""The driver's star-schema tables in the roles of the canonical tables.

Shipments are line items with their orders; suppliers with a non-negative balance are the known ones;
warehouses are nations; demand and stock are line items summed by part bucket, nation and ship day.
Every role carries provenance and flags, so the views and the analytics run on it unchanged.

As in the store of the canonical tables, joins and flags are settled once: the facts (shipments, and the sums behind demand and
stock) are written in the session's shared folder when they are first asked for, in the order of the keys that questions filter by,
so that filters reach Parquet's statistics and no question scans for duplicates again. A table is written anew for other or
changed files, and goes when the application ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.catalog import PROVENANCE, TABLES
from gristmill.operators.quality import duplicated, flagged, impossible, missing_fields, stale, unknown
from gristmill.session import shared_folder

TRADE_AS_OF, EVENTS_AS_OF = "1998-09-30", "2024-01-30"
PROMISE_DAYS, BUCKETS = 730, 5
FIRST_DAY = "1992-01-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _state(spark: SparkSession, d: str, names: tuple[str, ...]) -> tuple:
    """Sizes and times of the source files."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet") for name in names]
    fs = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()) for at in paths)


_STORED: dict[tuple, tuple[str, object]] = {}


def stored(sources: tuple[str, ...], *order: str) -> Callable:
    """A table made of source tables, written once an application in the order of some columns."""

    def around(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(make)
        def table(spark: SparkSession, d: str) -> DataFrame:
            key = spark.sparkContext.applicationId, make.__name__, d, _state(spark, d, sources)
            if key not in _STORED:
                path = f"{shared_folder(spark)}/canonical-{make.__name__}-{uuid.uuid4().hex}"
                made = make(spark, d)
                made.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
                _STORED[key] = path, made.schema
            path, schema = _STORED[key]
            return spark.read.schema(schema).parquet(path)

        return table

    return around


def _provenance(df: DataFrame, table: str, record, columns: list[str]) -> DataFrame:
    """Provenance with a record id made of the row's own keys: positions mean nothing in Parquet files."""
    missing = missing_fields(columns)
    return df.withColumns({
        "source_dataset": F.lit("driver"),
        "source_record_id": F.concat(F.lit(f"{table}:"), record),
        "synthetic_entity_id": F.concat(F.lit(f"syn:{table}:"), record),
        "missing_field_count": missing,
        "data_quality_flag": F.when(missing > 0, "missing_fields").otherwise("ok"),
        "record_timestamp": F.lit(f"{TRADE_AS_OF} 12:00:00").cast("timestamp_ntz"),
    })


def _final(df: DataFrame, table: str) -> DataFrame:
    return df.select(*TABLES[table], *PROVENANCE)


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("supplier_id"), F.col("s_name").alias("supplier_name"), (5 + F.col("s_suppkey") % 10).cast("int").alias("lead_time_days"))
    return _final(_provenance(known, "suppliers", F.col("supplier_id"), list(TABLES["suppliers"])), "suppliers")


def products(spark: SparkSession, d: str) -> DataFrame:
    """One product a part bucket, supplied by the supplier of the bucket's number."""
    rows = spark.range(BUCKETS).select(F.concat(F.lit("P"), F.col("id")).alias("product_id"), F.concat(F.lit("Bucket "), F.col("id")).alias("product_name"), (F.col("id") + 1).cast("string").alias("supplier_id"), (10.0 + 3 * F.col("id")).alias("unit_price"))
    return _final(_provenance(rows, "products", F.col("product_id"), list(TABLES["products"])), "products")


def warehouses(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select(F.concat(F.lit("W"), F.col("n_nationkey")).alias("warehouse_id"), F.col("n_name").alias("warehouse_name"))
    return _final(_provenance(rows, "warehouses", F.col("warehouse_id"), list(TABLES["warehouses"])), "warehouses")


def shipment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Base columns of shipments, without flags."""
    items, orders = read(spark, d, "lineitem"), read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    homes = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    ordered = F.col("o_orderdate").cast("date")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(homes, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("shipment_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_suppkey").cast("string").alias("supplier_id"),
        F.concat(F.lit("W"), F.col("s_nationkey")).alias("warehouse_id"),
        ordered.alias("shipped_date"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(ordered, PROMISE_DAYS)).alias("promised_date"),
        F.col("l_shipdate").cast("date").alias("delivered_date"),
        (F.col("l_quantity") * 20).alias("distance_km"),
        (F.col("l_discount") * 10).alias("traffic_index"),
    )


@stored(("lineitem", "orders", "supplier"), "supplier_id", "promised_date")
def shipments(spark: SparkSession, d: str) -> DataFrame:
    """Flagged shipments."""
    rows = _provenance(shipment_rows(spark, d), "shipments", F.col("shipment_id"), list(TABLES["shipments"]))
    rows = duplicated(unknown(rows, suppliers(spark, d), "supplier_id", "_unknown"), "shipment_id", "_copy")
    return _final(flagged(rows, [(F.col("_unknown"), "unknown_supplier"), (F.col("_copy"), "duplicate_shipment"), (impossible(), "impossible_delivery_date")]), "shipments")


@stored(("lineitem", "supplier"), "product_id", "warehouse_id", "day")
def cells(spark: SparkSession, d: str) -> DataFrame:
    """product_id, warehouse_id, day, quantity, price: line items summed by bucket, nation and ship day."""
    homes = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    keys = [F.concat(F.lit("P"), F.col("l_partkey") % BUCKETS).alias("product_id"), F.concat(F.lit("W"), F.col("s_nationkey")).alias("warehouse_id"), F.col("l_shipdate").cast("date").alias("day")]
    return joined.groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"))


def _cell_key():
    return F.concat_ws("-", "product_id", "warehouse_id", F.col("day").cast("string"))


def demand_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).select(_cell_key().alias("demand_id"), F.col("day").alias("demand_date"), "product_id", "warehouse_id", F.col("quantity").alias("units"))
    return _final(_provenance(rows, "demand_daily", F.col("demand_id"), list(TABLES["demand_daily"])), "demand_daily")


def inventory_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).select(_cell_key().alias("inventory_id"), F.col("day").alias("inventory_date"), "product_id", "warehouse_id", (10 * F.col("quantity")).cast("int").alias("on_hand"), F.lit(70).alias("reorder_point"))
    rows = _provenance(rows, "inventory_daily", F.col("inventory_id"), list(TABLES["inventory_daily"]))
    return _final(flagged(rows, [(stale(TRADE_AS_OF), "stale_inventory")]), "inventory_daily")


def supplier_events(spark: SparkSession, d: str) -> DataFrame:
    count = read(spark, d, "supplier").count()
    rows = read(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), (F.col("user_id") % count + 1).cast("string").alias("supplier_id"), F.col("ts").cast("date").alias("event_date"), F.when(F.col("event_type") == "error", "delay").otherwise(F.col("event_type")).alias("event_type"), F.lit(1).alias("delay_days"))
    return _final(_provenance(rows, "supplier_events", F.col("event_id"), list(TABLES["supplier_events"])), "supplier_events")


def calendar(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(FIRST_DAY).cast("date"), F.lit("1999-12-31").cast("date"))).alias("calendar_date"))
    rows = days.select("calendar_date", F.weekday("calendar_date").alias("day_of_week"), (F.weekday("calendar_date") >= 5).alias("is_weekend"))
    return _final(_provenance(rows, "calendar", F.col("calendar_date").cast("string"), list(TABLES["calendar"])), "calendar")
