"""The four semantic views and the relational steps that they are made of.

Dimensions join by plain equi-joins, left for Spark to broadcast by their measured size. Facts
aggregate before they join, so a view shuffles its facts once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.catalog import AS_OF, PROVENANCE, TABLES, VIEWS

DELAY_DAYS, DEMAND_DAYS = 7, 28


def day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def is_late() -> Column:
    """Null unless both dates are known and the record is clean."""
    known = F.col("promised_date").isNotNull() & F.col("delivered_date").isNotNull() & (F.col("data_quality_flag") == "ok")
    return F.when(known, F.col("delivered_date") > F.col("promised_date"))


def late_rate(late: str = "is_late") -> Column:
    """Mean over the evaluable rows, in double precision."""
    return F.avg(F.when(F.col(late), F.lit(1.0)).when(~F.col(late), F.lit(0.0)))


def shipment_view(shipments: DataFrame, suppliers: DataFrame) -> DataFrame:
    names = suppliers.select("supplier_id", "supplier_name")
    days = F.when(F.col("data_quality_flag") == "ok", F.date_diff("delivered_date", "promised_date").cast("bigint"))
    return shipments.join(names, "supplier_id", "left").select(*TABLES["shipments"], *PROVENANCE, "supplier_name", is_late().alias("is_late"), days.alias("delay_days"))


def recent_delay_events(events: DataFrame, as_of: str = AS_OF, days: int = DELAY_DAYS) -> DataFrame:
    """supplier_id and its delay events in the days up to as_of, both ends included."""
    recent = (F.col("event_type") == "delay") & F.col("event_date").between(F.date_sub(day(as_of), days), day(as_of))
    return events.where(recent).groupBy("supplier_id").agg(F.count("*").alias("recent_delay_events"))


def supplier_view(suppliers: DataFrame, shipment: DataFrame, events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """One row a supplier, without shipments too. Shipments aggregate by key before they meet the dimension."""
    totals = shipment.groupBy("supplier_id").agg(F.count("shipment_id").alias("_n"), F.count("is_late").alias("_evaluable"), late_rate().alias("late_delivery_rate"), F.avg("delay_days").alias("mean_delay_days"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    joined = suppliers.join(totals, "supplier_id", "left").join(recent_delay_events(events, as_of), "supplier_id", "left")
    return joined.select(
        *TABLES["suppliers"], *PROVENANCE,
        zero("_n").alias("shipment_count"), zero("_evaluable").alias("evaluable_shipments"), (zero("_n") - zero("_evaluable")).alias("missing_or_invalid_shipments"),
        "late_delivery_rate", "mean_delay_days", zero("recent_delay_events").alias("recent_delay_events"),
    )


def demand_view(demand: DataFrame, products: DataFrame, warehouses: DataFrame, calendar: DataFrame) -> DataFrame:
    days = calendar.select("calendar_date", "day_of_week", "is_weekend")
    joined = demand.join(products.select("product_id", "product_name"), "product_id", "left").join(warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id", "left")
    return joined.join(days, F.col("demand_date") == F.col("calendar_date"), "left").select(*VIEWS["demand_view"])


def trailing_demand(demand: DataFrame, as_of: str = AS_OF, days: int = DEMAND_DAYS) -> DataFrame:
    """Mean daily demand and its days by product and warehouse, over the window that ends at as_of, start excluded."""
    recent = (F.col("demand_date") > F.date_sub(day(as_of), days)) & (F.col("demand_date") <= day(as_of))
    return demand.where(recent).groupBy("product_id", "warehouse_id").agg(F.avg("units").alias("avg_daily_demand"), F.count("*").alias("history_days"))


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """The newest row of each product and warehouse; equal dates go to the smallest record id.

    The rank limit is planned before the shuffle too (WindowGroupLimit), so a task sends one row a key.
    """
    newest = Window.partitionBy("product_id", "warehouse_id").orderBy(F.col("inventory_date").desc_nulls_last(), "source_record_id")
    return inventory.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def risk_view(inventory: DataFrame, products: DataFrame, warehouses: DataFrame, demand: DataFrame, as_of: str = AS_OF) -> DataFrame:
    joined = (
        latest_inventory(inventory)
        .join(products.select("product_id", "product_name", "supplier_id"), "product_id", "left")
        .join(warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id", "left")
        .join(trailing_demand(demand, as_of), ["product_id", "warehouse_id"], "left")
    )
    cover = F.col("on_hand").cast("double") / F.nullif(F.col("avg_daily_demand"), F.lit(0.0))
    age = F.date_diff(day(as_of), F.col("inventory_date")).cast("bigint")
    return joined.withColumns({"days_of_cover": cover, "inventory_age_days": age}).select(*VIEWS["risk_view"])


def view_frames(tables: dict[str, DataFrame], as_of: str = AS_OF) -> dict[str, DataFrame]:
    """All views over canonical tables with provenance, columns in catalog order."""
    shipment = shipment_view(tables["shipments"], tables["suppliers"])
    return {
        "shipment_view": shipment,
        "supplier_view": supplier_view(tables["suppliers"], shipment, tables["supplier_events"], as_of),
        "demand_view": demand_view(tables["demand_daily"], tables["products"], tables["warehouses"], tables["calendar"]),
        "risk_view": risk_view(tables["inventory_daily"], tables["products"], tables["warehouses"], tables["demand_daily"], as_of),
    }
