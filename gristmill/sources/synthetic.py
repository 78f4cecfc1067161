"""Synthetic canonical records, generated on the executors.

Every value is a function of (seed, keys), so any partitioning gives the same rows, and the generator
scales by its parameters alone. Each table carries `_ordinal`, the row's position, for provenance.
"""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.catalog import AS_OF, SEED, TABLES, struct


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), from a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """Box-Muller on two hashes."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(seed, F.lit("r"), *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, F.lit("a"), *keys))


def _named(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *(p.cast("string") for p in parts)))


def synthetic_tables(spark: SparkSession, seed: int = SEED, as_of: str = AS_OF, days: int = 180, suppliers: int = 3, warehouses: int = 3, products: int = 6) -> dict[str, DataFrame]:
    """All canonical tables with their base columns and `_ordinal`."""
    end = date.fromisoformat(as_of)
    first = F.lit(end - timedelta(days=days - 1))
    numbered = lambda n: spark.range(1, n + 1).withColumn("_ordinal", F.col("id") - 1)
    day = F.date_add(first, F.col("d").cast("int"))
    weekend = F.weekday(day) >= 5
    grid = spark.range(days * products * warehouses).select(
        F.col("id").alias("_ordinal"),
        F.floor(F.col("id") / (products * warehouses)).alias("d"),
        (F.floor(F.col("id") / warehouses) % products + 1).alias("p"),
        (F.col("id") % warehouses + 1).alias("w"),
    )
    level = 8 + 2 * F.col("p") + F.col("w") + F.when(weekend, 6).otherwise(0) + 3 * normal(seed, F.lit("demand"), "d", "p", "w")
    stock = 25 + 35 * F.col("p") + 8 * F.col("w") + F.floor(31 * uniform(seed, F.lit("stock"), "d", "p", "w"))
    cell = {"product_id": _named("P", F.col("p")), "warehouse_id": _named("W", F.col("w"))}
    trade = spark.range(days * suppliers).select(F.col("id").alias("_ordinal"), F.floor(F.col("id") / suppliers).alias("d"), (F.col("id") % suppliers + 1).alias("s"))
    late = uniform(seed, F.lit("late"), "d", "s") < F.when(F.col("s") == 1, 0.65).otherwise(0.15)
    slack = uniform(seed, F.lit("slack"), "d", "s")
    promised = F.date_sub(day, 3)
    number = F.col("_ordinal").cast("string")
    tables = {
        "suppliers": numbered(suppliers).withColumns({"supplier_id": _named("S", F.col("id")), "supplier_name": F.concat(F.lit("Supplier "), F.char(64 + F.col("id"))), "lead_time_days": 5 + 2 * F.col("id")}),
        "warehouses": numbered(warehouses).withColumns({"warehouse_id": _named("W", F.col("id")), "warehouse_name": _named("Warehouse ", F.col("id"))}),
        "products": numbered(products).withColumns({"product_id": _named("P", F.col("id")), "product_name": _named("Synthetic Product ", F.col("id")), "supplier_id": _named("S", (F.col("id") - 1) % suppliers + 1), "unit_price": 10.0 + 3 * F.col("id")}),
        "calendar": spark.range(days).select(F.col("id").alias("_ordinal"), F.col("id").alias("d")).withColumns({"calendar_date": day, "day_of_week": F.weekday(day), "is_weekend": weekend}),
        "demand_daily": grid.withColumns(cell | {"demand_id": _named("D", F.col("d"), F.col("p"), F.col("w")), "demand_date": day, "units": F.greatest(F.lit(0.0), F.round(level))}),
        "inventory_daily": grid.withColumns(cell | {"inventory_id": _named("I", F.col("d"), F.col("p"), F.col("w")), "inventory_date": day, "on_hand": stock, "reorder_point": F.lit(70)}),
        "orders": trade.withColumns({"order_id": F.concat(F.lit("O"), number), "order_date": F.date_sub(day, 11), "warehouse_id": _named("W", (F.col("s") - 1) % warehouses + 1), "status": F.lit("delivered")}),
        "order_items": trade.withColumns({"item_id": F.concat(F.lit("OI"), number), "order_id": F.concat(F.lit("O"), number), "product_id": _named("P", (F.col("s") - 1) % products + 1), "quantity": 1 + F.floor(8 * uniform(seed, F.lit("quantity"), "d", "s")), "unit_price": 10.0 + 3 * F.col("s")}),
        "shipments": trade.withColumns({
            "shipment_id": F.concat(F.lit("SH"), number), "order_id": F.concat(F.lit("O"), number), "supplier_id": _named("S", F.col("s")), "warehouse_id": _named("W", (F.col("s") - 1) % warehouses + 1),
            "shipped_date": F.date_sub(day, 10), "promised_date": promised, "delivered_date": F.date_add(promised, F.when(late, 1 + F.floor(3 * slack)).otherwise(-F.floor(3 * slack)).cast("int")),
            "distance_km": 80 + 720 * uniform(seed, F.lit("distance"), "d", "s"), "traffic_index": uniform(seed, F.lit("traffic"), "d", "s"),
        }),
        "purchase_orders": numbered(suppliers).withColumns({"purchase_order_id": _named("PO", F.col("id")), "supplier_id": _named("S", F.col("id")), "product_id": _named("P", F.col("id")), "warehouse_id": _named("W", F.col("id")), "quantity": F.lit(100), "expected_date": F.lit(end + timedelta(days=7)), "status": F.lit("simulated_open")}),
        "supplier_events": numbered(1).withColumns({"event_id": F.lit("SE1"), "supplier_id": F.lit("S1"), "event_date": F.lit(end), "event_type": F.lit("delay"), "delay_days": F.lit(3)}),
        "promotions": numbered(1).withColumns({"promotion_id": F.lit("PR1"), "product_id": F.lit("P1"), "start_date": F.lit(end - timedelta(days=10)), "end_date": F.lit(end), "discount_fraction": F.lit(0.1)}),
    }
    empty = {name: spark.createDataFrame([], struct(TABLES[name])).withColumn("_ordinal", F.lit(0).cast("long")) for name in ("risk_events", "audit_events")}
    kinds = {f: t for name in TABLES for f, t in TABLES[name].items()}
    return {name: df.select(*(F.col(c).cast(kinds[c]) for c in TABLES[name]), "_ordinal") for name, df in (tables | empty).items()}


def from_rows(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """A canonical table from rows in order of position."""
    schema = struct(TABLES[table] | {"_ordinal": "bigint"})
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)
