"""Canonical tables, provenance, semantic views, entities and the join graph, as typed constants."""

from __future__ import annotations

from pyspark.sql import types as T

AS_OF = "2026-09-30"
SEED = 4200
ROW_LIMIT = 200
DEADLINE_SECONDS = 3.0

_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def fields(text: str) -> dict[str, str]:
    """Column names to type names from 'name type, name type'."""
    return dict(part.split() for part in text.split(",") if part.strip())


def struct(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# The canonical model's columns and types.
PROVENANCE = fields("source_dataset string, source_record_id string, synthetic_entity_id string, data_quality_flag string, missing_field_count int, record_timestamp timestamp_ntz")
TABLES = {
    "orders": fields("order_id string, order_date date, warehouse_id string, status string"),
    "order_items": fields("item_id string, order_id string, product_id string, quantity int, unit_price double"),
    "shipments": fields("shipment_id string, order_id string, supplier_id string, warehouse_id string, shipped_date date, promised_date date, delivered_date date, distance_km double, traffic_index double"),
    "products": fields("product_id string, product_name string, supplier_id string, unit_price double"),
    "suppliers": fields("supplier_id string, supplier_name string, lead_time_days int"),
    "warehouses": fields("warehouse_id string, warehouse_name string"),
    "inventory_daily": fields("inventory_id string, inventory_date date, product_id string, warehouse_id string, on_hand int, reorder_point int"),
    "demand_daily": fields("demand_id string, demand_date date, product_id string, warehouse_id string, units double"),
    "purchase_orders": fields("purchase_order_id string, supplier_id string, product_id string, warehouse_id string, quantity int, expected_date date, status string"),
    "supplier_events": fields("event_id string, supplier_id string, event_date date, event_type string, delay_days int"),
    "promotions": fields("promotion_id string, product_id string, start_date date, end_date date, discount_fraction double"),
    "calendar": fields("calendar_date date, day_of_week int, is_weekend boolean"),
    "risk_events": fields("risk_event_id string, entity_id string, risk_type string, risk_level string, detected_at timestamp_ntz"),
    "audit_events": fields("seq bigint, event_id string, event_type string, actor string, payload string, previous_hash string, event_hash string"),
}
VIEWS = {
    "shipment_view": TABLES["shipments"] | PROVENANCE | fields("supplier_name string, is_late boolean, delay_days bigint"),
    "supplier_view": TABLES["suppliers"] | PROVENANCE | fields("shipment_count bigint, evaluable_shipments bigint, missing_or_invalid_shipments bigint, late_delivery_rate double, mean_delay_days double, recent_delay_events bigint"),
    "demand_view": TABLES["demand_daily"] | PROVENANCE | fields("product_name string, warehouse_name string, day_of_week int, is_weekend boolean"),
    "risk_view": fields("product_id string, product_name string, warehouse_id string, warehouse_name string, supplier_id string, inventory_date date, on_hand int, reorder_point int, avg_daily_demand double, history_days bigint, days_of_cover double, inventory_age_days bigint") | PROVENANCE,
}
#: Equality keys on which views may join, as unordered pairs; all are many-to-one.
JOINS = [("risk_view.supplier_id", "supplier_view.supplier_id"), ("shipment_view.supplier_id", "supplier_view.supplier_id")]
METRICS = {
    "late_delivery_rate": "Share of late deliveries among the evaluable ones; missing promised dates and invalid records are left out.",
    "days_of_cover": "Latest stock on hand over mean daily demand of the last 28 days; null without demand. Below 14 days calls for review.",
    "supplier_reliability": "Observed late rate and the number of evaluable shipments; observations, not future probabilities.",
    "what_if": "Demand scaled by a given fraction with stock, prices and replenishment held; a scenario, not a forecast.",
}
ALIASES = {
    "shipment_view": "late delivery delayed orders shipments promised ETA last month",
    "supplier_view": "supplier reliability high risk Supplier A why",
    "demand_view": "forecast demand daily units sales seasonality",
    "risk_view": "inventory stock stockout coverage warehouse what happens demand increases",
}


def entity_names(suppliers: int = 3, warehouses: int = 3, products: int = 6) -> dict[str, dict[str, str]]:
    """By kind, every accepted spelling (casefolded) and the id that it names."""
    names: dict[str, dict[str, str]] = {"supplier_id": {}, "warehouse_id": {}, "product_id": {}}
    for i in range(1, suppliers + 1):
        names["supplier_id"] |= dict.fromkeys((f"s{i}", f"supplier {chr(96 + i)}"), f"S{i}")
    for i in range(1, warehouses + 1):
        names["warehouse_id"] |= dict.fromkeys((f"w{i}", f"warehouse {i}", f"warehouse w{i}"), f"W{i}")
    for i in range(1, products + 1):
        names["product_id"] |= dict.fromkeys((f"p{i}", f"product {i}", f"product p{i}", f"synthetic product {i}"), f"P{i}")
    return names


ENTITIES = entity_names()
