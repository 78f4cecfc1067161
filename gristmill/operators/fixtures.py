"""Failure fixtures: named mutations of raw canonical tables, and questions that must fail."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.catalog import AS_OF

Tables = dict[str, DataFrame]


def _set(table: str, which, **values) -> Callable[[Tables, date], Tables]:
    """A mutation that sets columns of the rows that which(count) selects."""

    def change(tables: Tables, as_of: date) -> Tables:
        df = tables[table]
        hit = which(df.count())
        given = {c: (v(as_of) if callable(v) else v) for c, v in values.items()}
        return tables | {table: df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in given.items()})}

    return change


def _first(count: int):
    return F.col("_ordinal") == 0


def _last(n: int, step: int = 1):
    return lambda count: (F.col("_ordinal") >= count - n) & ((F.col("_ordinal") - (count - n)) % step == 0)


def _copy_first_shipment(tables: Tables, as_of: date) -> Tables:
    df = tables["shipments"]
    extra = df.where("_ordinal = 0").withColumn("_ordinal", F.lit(df.count()))
    return tables | {"shipments": df.unionByName(extra)}


def _old_inventory(tables: Tables, as_of: date) -> Tables:
    return tables | {"inventory_daily": tables["inventory_daily"].where(F.col("inventory_date") <= F.lit(as_of - timedelta(days=10)))}


def _burst(tables: Tables, as_of: date) -> Tables:
    events = tables["supplier_events"]
    n = events.count()
    extra = events.sparkSession.createDataFrame([(f"BURST{i}", "S1", as_of - timedelta(days=i), "delay", 5 + i, n + i) for i in range(7)], events.schema)
    late = _set("shipments", _last(21, 3), promised_date=lambda d: F.lit(d - timedelta(days=8)), delivered_date=lambda d: F.lit(d))
    return late(tables | {"supplier_events": events.unionByName(extra)}, as_of)


DATA_FIXTURES: dict[str, Callable[[Tables, date], Tables]] = {
    "missing_supplier": _set("shipments", _first, supplier_id=lambda d: F.lit(None)),
    "missing_promised_date": _set("shipments", _first, promised_date=lambda d: F.lit(None)),
    "duplicate_shipment": _copy_first_shipment,
    "impossible_delivery_date": _set("shipments", _first, delivered_date=lambda d: F.lit(date(2020, 1, 1))),
    "unknown_product": _set("inventory_daily", _last(1), product_id=lambda d: F.lit("P_UNKNOWN")),
    "stale_inventory": _old_inventory,
    "demand_spike": _set("demand_daily", _last(18), units=lambda d: F.col("units") * 4),
    "supplier_delay_burst": _burst,
}
#: Question and the status that it must end with.
QUERY_FIXTURES = {
    "empty_result": ("Show products likely to stock out within the next 1 days", "empty"),
    "unsupported_question": ("What is the weather at the warehouse?", "clarification"),
    "unsafe_sql": ("Delete all shipments", "blocked"),
}


def apply_fixture(name: str, tables: Tables, as_of: str = AS_OF) -> Tables:
    """Raw tables (with `_ordinal`) after the mutation. ValueError for other names."""
    if name not in DATA_FIXTURES:
        raise ValueError(f"unknown data fixture: {name}")
    return DATA_FIXTURES[name](tables, date.fromisoformat(as_of))
