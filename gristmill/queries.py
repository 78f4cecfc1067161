"""Queries of the engine's own operators over the driver's tables, each with the SQL that must agree.

SQL fragments in _CTE rebuild the canonical roles independently of the DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import evaluate
from gristmill import mapping as m
from gristmill.catalog import VIEWS
from gristmill.functions import forecast, retrieval, risk, timeseries
from gristmill.operators import quality, views
from gristmill.sources import profile

Query = Callable[[SparkSession, str], DataFrame]
FIRST_DAY, LAST_DAY = "1998-04-04", m.TRADE_AS_OF  # 180 days
_HIDDEN = ("record_timestamp",)


def _shown(view: str) -> list[str]:
    return [c for c in VIEWS[view] if c not in _HIDDEN]


def _shipments(s: SparkSession, d: str) -> DataFrame:
    return views.shipment_view(m.shipments(s, d), m.suppliers(s, d))


def _risks(s: SparkSession, d: str) -> DataFrame:
    return views.risk_view(m.inventory_daily(s, d), m.products(s, d), m.warehouses(s, d), m.demand_daily(s, d), m.TRADE_AS_OF)


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    return views.supplier_view(m.suppliers(s, d), _shipments(s, d), m.supplier_events(s, d), m.EVENTS_AS_OF)


def _demand(s: SparkSession, d: str) -> DataFrame:
    return views.demand_view(m.demand_daily(s, d), m.products(s, d), m.warehouses(s, d), m.calendar(s, d))


def series(s: SparkSession, d: str) -> DataFrame:
    """bucket, day, t, y over the last 180 days, zero-filled."""
    items = m.read(s, d, "lineitem").select((F.col("l_partkey") % m.BUCKETS).alias("bucket"), F.col("l_shipdate").cast("date").alias("ship"), "l_quantity")
    return timeseries.spine(items, "bucket", "ship", "l_quantity", FIRST_DAY, LAST_DAY)


def supplier_delay_month(s: SparkSession, d: str, start: str = "1998-08-01", end: str = "1998-09-01") -> DataFrame:
    """Late rate by supplier for promises in a half-open range, worst first."""
    inside = (F.col("promised_date") >= F.lit(start).cast("date")) & (F.col("promised_date") < F.lit(end).cast("date"))
    rated = _shipments(s, d).where(inside).groupBy("supplier_id", "supplier_name").agg(F.count("is_late").alias("evaluable_shipments"), F.sum(F.when(F.col("is_late"), 1).otherwise(0)).alias("late_shipments"), views.late_rate().alias("late_delivery_rate"))
    return rated.where("evaluable_shipments > 0").orderBy(F.desc("late_delivery_rate"), "supplier_id")


def _flags(s: SparkSession, d: str) -> DataFrame:
    one = lambda name, df: df.groupBy("data_quality_flag").agg(F.count("*").alias("n"), F.sum("missing_field_count").alias("missing")).select(F.lit(name).alias("table_name"), "*")
    return one("shipments", m.shipments(s, d)).unionByName(one("inventory_daily", m.inventory_daily(s, d)))


def _stockout(s: SparkSession, d: str) -> DataFrame:
    return _risks(s, d).where("days_of_cover < 14").select(*_shown("risk_view")).orderBy("days_of_cover", "product_id", "warehouse_id")


def _what_if(s: SparkSession, d: str) -> DataFrame:
    from gristmill.functions.whatif import scaled

    return scaled(_risks(s, d).where("warehouse_id = 'W3'"), 0.15).select(*_shown("risk_view"), "scenario_daily_demand", "scenario_days_of_cover")


def _rated(s: SparkSession, d: str) -> DataFrame:
    """Risk levels by the rules and the data-quality gate alone, from a model that always says 0."""
    none = risk.Model("stockout", (0.0, 0.0), (1.0, 1.0), (0.0, 0.0, -50.0), (1.0, 0.0), 0.0)
    judged = risk.assess(_risks(s, d), none)
    return judged.select("product_id", "warehouse_id", "risk_level", F.concat_ws("|", "missing_information").alias("missing_information"), "recommended_review")


def _scores(s: SparkSession, d: str) -> DataFrame:
    parts = [risk.assess(df, risk.fit(kind)).select("risk_type", F.col(key).alias("entity"), "risk_level", F.concat_ws("|", "drivers").alias("drivers"), "recommended_review") for kind, df, key in (("stockout", _risks(s, d), "source_record_id"), ("supplier_reliability", _suppliers(s, d), "supplier_id"), ("late_delivery", _shipments(s, d), "shipment_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _guarded(s: SparkSession, d: str) -> DataFrame:
    from gristmill.plans.guard import guarded_frame

    _registered(s, d)
    sql = """SELECT sh.supplier_id, count(sh.is_late) AS evaluable, max(su.shipment_count) AS shipments FROM shipment_view sh
             JOIN supplier_view su ON sh.supplier_id = su.supplier_id WHERE sh.traffic_index >= $least
             GROUP BY sh.supplier_id HAVING count(sh.is_late) > 0 ORDER BY sh.supplier_id LIMIT 50"""
    return guarded_frame(s, sql, {"least": 0.5})


def _latency(s: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_summary(m.read(s, d, "events"), "event_type", "value")


def _grouping(s: SparkSession, d: str) -> DataFrame:
    cases = m.read(s, d, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("category"), (F.col("o_totalprice") > 150000).alias("hit"))
    return evaluate.metrics_by(cases, "arm", "category", "hit")


def _chain(s: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each event's canonical text, and that of the event before it by id."""
    body = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    return whole_chain(m.read(s, d, "events").select("event_id", F.sha2(body, 256).alias("event_hash")))


def whole_chain(hashed: DataFrame, block: int = 1000) -> DataFrame:
    """event_id, event_hash, previous_hash over all rows in order of event_id: each block takes over the last hash of the block before it."""
    from pyspark.sql import Window

    dealt = hashed.select(F.floor(F.col("event_id") / block).alias("_block"), "event_id", "event_hash")
    ends = dealt.groupBy("_block").agg(F.max(F.struct("event_id", "event_hash")).alias("_end"))
    carried = ends.select("_block", F.lag("_end.event_hash").over(Window.orderBy("_block")).alias("_carried"))  # one row a block
    before = F.lag("event_hash").over(Window.partitionBy("_block").orderBy("event_id", "event_hash"))
    rows = dealt.withColumn("_before", before).alias("r").join(carried.alias("c"), F.col("r._block").eqNullSafe(F.col("c._block")))
    return rows.select("event_id", "event_hash", F.coalesce("_before", "_carried", F.lit("0" * 64)).alias("previous_hash"))


def _tfidf(s: SparkSession, d: str) -> DataFrame:
    """Every text whose id is divisible by 100 against all texts."""
    bench = m.read(s, d, "benchmark")
    asked = bench.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("asked"))
    return retrieval.tfidf_search(bench, "item_id", "text", asked, "query_id", "asked").select("query_id", "rank", "item_id", F.round("score", 6).alias("score"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    rows = m.read(s, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return retrieval.block_search(rows, "vec_id", "embedding", asked, "query_id", "asked").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _registered(s: SparkSession, d: str) -> None:
    frames = {"shipment_view": _shipments(s, d), "supplier_view": _suppliers(s, d), "demand_view": _demand(s, d), "risk_view": _risks(s, d)}
    for name, df in frames.items():
        df.select(*VIEWS[name]).createOrReplaceTempView(name)


def asked(question: str, shown: list[str] | None = None) -> Query:
    """A question all the way: planned, compiled, guarded and run over the driver's tables."""

    def query(s: SparkSession, d: str) -> DataFrame:
        from gristmill.plans.grammar import request_plan
        from gristmill.plans.guard import guarded_frame
        from gristmill.plans.query_plan import compile_plan

        _registered(s, d)
        compiled = compile_plan(request_plan(question))
        found = guarded_frame(s, compiled.sql, compiled.parameters)
        return found.select(*shown) if shown else found

    return query


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The plans of one question for each supplier row: a stock horizon that is too long for some."""
    rows = m.read(s, d, "supplier").select("s_suppkey", F.format_string("List inventory at risk of stockout over the coming %d days", F.col("s_suppkey") % 120).alias("question"))
    plan = lambda field: F.get_json_object("plan", f"$.{field}")
    return evaluate.plans_of(rows).select("s_suppkey", plan("intent").alias("intent"), plan("horizon_days").cast("int").alias("horizon_days"), plan("abstain").cast("boolean").alias("abstain"))


def _diagnosed(s: SparkSession, d: str) -> DataFrame:
    """Diagnoses of one right or damaged plan for each customer row."""
    found = evaluate.diagnose_frame(evaluate.damaged_plans(m.read(s, d, "customer").select("c_custkey"), "c_custkey"))
    return found.select(F.col("id").cast("long").alias("c_custkey"), F.concat_ws("|", "errors").alias("errors"), "exact")


def _forecast_bounds(s: SparkSession, d: str) -> DataFrame:
    """What every forecast must keep to: its days, and bands in order around the point and not below zero."""
    ordered = (F.col("lower") <= F.col("point")) & (F.col("point") <= F.col("upper")) & (F.col("lower") >= 0)
    return forecast.forecast_series(series(s, d), "bucket").groupBy("bucket").agg(F.count("*").alias("days"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.every(ordered).alias("in_order"))


def _folds(s: SparkSession, d: str) -> DataFrame:
    """The folds and the baseline errors that the quantile model is walked through, which it must share with the plain baseline."""
    return forecast.walk_forward_series(series(s, d), "bucket").select("bucket", "origin", F.round("baseline_mae", 6).alias("baseline_mae"), (F.col("mae") >= 0).alias("measured"))


def _score_counts(s: SparkSession, d: str) -> DataFrame:
    """Entities scored by each model, and that each got one of the levels."""
    level = F.col("risk_level").isin("low", "medium", "high", "unknown")
    return _scores(s, d).groupBy("risk_type").agg(F.count("*").alias("scored"), F.countDistinct("entity").alias("entities"), F.every(level).alias("levels_known"))


def queries() -> dict[str, Query]:
    return {
        "shipment_view": lambda s, d: _shipments(s, d).select(*_shown("shipment_view")),
        "supplier_view": lambda s, d: _suppliers(s, d).select(*_shown("supplier_view")),
        "demand_view": lambda s, d: _demand(s, d).select(*_shown("demand_view")),
        "risk_view": lambda s, d: _risks(s, d).select(*_shown("risk_view")),
        "supplier_delay_month": supplier_delay_month,
        "stockout_horizon": _stockout,
        "forecast_history": lambda s, d: _demand(s, d).where("product_id = 'P1' AND warehouse_id = 'W3'").select(*_shown("demand_view")).orderBy("demand_date"),
        "what_if_scale": _what_if,
        "supplier_evidence": lambda s, d: _suppliers(s, d).where("supplier_id = '3'").select(*_shown("supplier_view")),
        "shipments_for_supplier": lambda s, d: _shipments(s, d).where("supplier_id = '3'").select(*_shown("shipment_view")),
        "missing_promised": lambda s, d: _shipments(s, d).where("promised_date IS NULL").select(*_shown("shipment_view")),
        "quality_flags": _flags,
        "duplicate_keys": lambda s, d: quality.duplicated(m.shipment_rows(s, d), "shipment_id", "copy").where("copy").groupBy("shipment_id").agg(F.count("*").alias("copies")),
        "fk_violations": lambda s, d: quality.unknown(m.shipment_rows(s, d), m.suppliers(s, d), "supplier_id", "lost").where("lost").groupBy("supplier_id").agg(F.count("*").alias("shipments")),
        "impossible_dates": lambda s, d: m.shipment_rows(s, d).where(quality.impossible()).select("shipment_id", "shipped_date", "delivered_date"),
        "stale_inventory": lambda s, d: m.inventory_daily(s, d).groupBy((F.col("data_quality_flag") == "stale_inventory").alias("stale")).agg(F.count("*").alias("n")),
        "latest_per_group": lambda s, d: views.latest_inventory(m.inventory_daily(s, d)).select("product_id", "warehouse_id", "inventory_date", "on_hand"),
        "trailing_28d_demand": lambda s, d: views.trailing_demand(m.demand_daily(s, d), m.TRADE_AS_OF).select("product_id", "warehouse_id", F.round("avg_daily_demand", 6).alias("avg_daily_demand"), "history_days"),
        "recent_delay_events": lambda s, d: views.recent_delay_events(m.supplier_events(s, d), m.EVENTS_AS_OF),
        "guarded_join": _guarded,
        "profile_table": lambda s, d: profile.profile_frame(m.read(s, d, "orders").withColumn("order_date", F.col("o_orderdate").cast("date").cast("string")).drop("o_orderdate"), "orders").drop("date_ranges"),
        "profile_dates": lambda s, d: profile.profile_frame(m.shipment_rows(s, d), "shipments").select("source", F.explode("date_ranges").alias("r")).select("source", "r.column", "r.first", "r.last"),
        "duplicate_rows": lambda s, d: profile.duplicate_rows(m.read(s, d, "lineitem").select("l_orderkey", "l_linenumber")),
        "seasonal_naive": lambda s, d: timeseries.seasonal_naive(series(s, d), "bucket"),
        "lag_features": lambda s, d: timeseries.lag_features(series(s, d), "bucket").withColumns({c: F.round(c, 6) for c in ("mean_7", "mean_14")}),
        "spike_flags": lambda s, d: timeseries.spikes(series(s, d), "bucket"),
        "residual_quantiles": lambda s, d: timeseries.residual_band(series(s, d), "bucket").withColumns({c: F.round(c, 6) for c in ("low", "high")}),
        "walk_forward_baseline": lambda s, d: timeseries.walk_forward_naive(series(s, d), "bucket").withColumn("baseline_mae", F.round("baseline_mae", 6)),
        "series_checks": lambda s, d: timeseries.invalid_series(series(s, d).where("NOT (bucket = 1 AND t = 50)"), "bucket"),
        "risk_rules": _rated,
        "tfidf_topk": _tfidf,
        "embedding_topk": _vectors,
        "latency_summary": _latency,
        "metrics_grouping_sets": _grouping,
        "leakage_check": lambda s, d: evaluate.shared_questions(m.read(s, d, "customer").select(F.concat(F.upper("c_mktsegment"), F.lit("  ?")).alias("q")), m.read(s, d, "customer").select(F.lower("c_mktsegment").alias("q")), "q"),
        "gold_comparison": lambda s, d: evaluate.differences(m.read(s, d, "nation").select("n_regionkey"), m.read(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"))),
        "hash_chain": _chain,
        "forecast_quantile": lambda s, d: forecast.forecast_series(series(s, d), "bucket"),
        "walk_forward_quantile": _folds,
        "risk_scores": _scores,
        "forecast_bounds": _forecast_bounds,
        "risk_score_counts": _score_counts,
        "plan_diagnosis": _diagnosed,
        "audit_replay": lambda s, d: evaluate.broken_events(m.read(s, d, "events")),
        "question_batch": _questions,
        "asked_supplier_delay": asked("Rank suppliers by late delivery rate during August 1998"),
        "asked_stockout": asked("List inventory at risk of stockout over the coming 14 days", _shown("risk_view")),
        "asked_forecast": asked("Forecast demand for P1 at W3", _shown("demand_view")),
        "asked_what_if": asked("What happens if demand increases by 15% at Warehouse 3", [*_shown("risk_view"), "scenario_daily_demand", "scenario_days_of_cover"]),
    }


_CTE = """
WITH sup AS (SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name, CAST(5 + s_suppkey % 10 AS INTEGER) AS lead_time_days FROM supplier WHERE s_acctbal >= 0),
prod AS (SELECT 'P' || i AS product_id, 'Bucket ' || i AS product_name, CAST(i + 1 AS VARCHAR) AS supplier_id FROM range(5) r(i)),
wh AS (SELECT 'W' || n_nationkey AS warehouse_id, n_name AS warehouse_name FROM nation),
base AS (SELECT l_orderkey || '-' || l_linenumber AS shipment_id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_suppkey AS VARCHAR) AS supplier_id, 'W' || s_nationkey AS warehouse_id,
    CAST(o_orderdate AS DATE) AS shipped_date, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 730 END AS promised_date, CAST(l_shipdate AS DATE) AS delivered_date,
    l_quantity * 20 AS distance_km, l_discount * 10 AS traffic_index
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
ship AS (SELECT *, 'driver' AS source_dataset, 'shipments:' || shipment_id AS source_record_id, 'syn:shipments:' || shipment_id AS synthetic_entity_id,
    coalesce(nullif(concat_ws(';', CASE WHEN promised_date IS NULL THEN 'missing_fields' END,
        CASE WHEN supplier_id NOT IN (SELECT supplier_id FROM sup) THEN 'unknown_supplier' END,
        CASE WHEN count(*) OVER (PARTITION BY shipment_id) > 1 THEN 'duplicate_shipment' END,
        CASE WHEN delivered_date < shipped_date THEN 'impossible_delivery_date' END), ''), 'ok') AS data_quality_flag,
    CAST(CASE WHEN promised_date IS NULL THEN 1 ELSE 0 END AS INTEGER) AS missing_field_count FROM base),
shipment_view AS (SELECT s.*, n.supplier_name,
    CASE WHEN data_quality_flag = 'ok' AND promised_date IS NOT NULL AND delivered_date IS NOT NULL THEN delivered_date > promised_date END AS is_late,
    CASE WHEN data_quality_flag = 'ok' THEN date_diff('day', promised_date, delivered_date) END AS delay_days
    FROM ship s LEFT JOIN sup n USING (supplier_id)),
ev AS (SELECT CAST(user_id % (SELECT count(*) FROM supplier) + 1 AS VARCHAR) AS supplier_id, event_type, CAST(ts AS DATE) AS d FROM events),
delays AS (SELECT supplier_id, count(*) AS recent_delay_events FROM ev WHERE event_type = 'error' AND d >= DATE '2024-01-30' - 7 AND d <= DATE '2024-01-30' GROUP BY supplier_id),
supplier_view AS (SELECT s.supplier_id, s.supplier_name, s.lead_time_days, 'driver' AS source_dataset, 'suppliers:' || s.supplier_id AS source_record_id, 'syn:suppliers:' || s.supplier_id AS synthetic_entity_id,
    'ok' AS data_quality_flag, CAST(0 AS INTEGER) AS missing_field_count, count(v.shipment_id) AS shipment_count, count(v.is_late) AS evaluable_shipments,
    count(v.shipment_id) - count(v.is_late) AS missing_or_invalid_shipments, avg(CASE WHEN v.is_late THEN 1.0 WHEN NOT v.is_late THEN 0.0 END) AS late_delivery_rate,
    avg(v.delay_days) AS mean_delay_days, coalesce(max(e.recent_delay_events), 0) AS recent_delay_events
    FROM sup s LEFT JOIN shipment_view v USING (supplier_id) LEFT JOIN delays e USING (supplier_id) GROUP BY s.supplier_id, s.supplier_name, s.lead_time_days),
cells AS (SELECT 'P' || (l_partkey % 5) AS product_id, 'W' || s_nationkey AS warehouse_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
demand_view AS (SELECT c.product_id || '-' || c.warehouse_id || '-' || c.d AS demand_id, c.d AS demand_date, c.product_id, c.warehouse_id, c.q AS units, 'driver' AS source_dataset,
    'demand_daily:' || c.product_id || '-' || c.warehouse_id || '-' || c.d AS source_record_id, 'syn:demand_daily:' || c.product_id || '-' || c.warehouse_id || '-' || c.d AS synthetic_entity_id,
    'ok' AS data_quality_flag, CAST(0 AS INTEGER) AS missing_field_count, product_name, warehouse_name,
    CASE WHEN c.d BETWEEN DATE '1992-01-01' AND DATE '1999-12-31' THEN CAST(isodow(c.d) - 1 AS INTEGER) END AS day_of_week,
    CASE WHEN c.d BETWEEN DATE '1992-01-01' AND DATE '1999-12-31' THEN isodow(c.d) >= 6 END AS is_weekend
    FROM cells c LEFT JOIN prod USING (product_id) LEFT JOIN wh USING (warehouse_id)),
inv AS (SELECT product_id || '-' || warehouse_id || '-' || d AS inventory_id, d AS inventory_date, product_id, warehouse_id, CAST(10 * q AS INTEGER) AS on_hand,
    CASE WHEN d < DATE '1998-09-30' - 3 THEN 'stale_inventory' ELSE 'ok' END AS data_quality_flag FROM cells),
latest AS (SELECT * FROM inv QUALIFY row_number() OVER (PARTITION BY product_id, warehouse_id ORDER BY inventory_date DESC) = 1),
recent AS (SELECT product_id, warehouse_id, avg(q) AS avg_daily_demand, count(*) AS history_days FROM cells WHERE d > DATE '1998-09-30' - 28 AND d <= DATE '1998-09-30' GROUP BY 1, 2),
risk_view AS (SELECT i.product_id, product_name, i.warehouse_id, warehouse_name, p.supplier_id, inventory_date, on_hand, CAST(70 AS INTEGER) AS reorder_point, avg_daily_demand, history_days,
    on_hand / nullif(avg_daily_demand, 0) AS days_of_cover, date_diff('day', inventory_date, DATE '1998-09-30') AS inventory_age_days, 'driver' AS source_dataset,
    'inventory_daily:' || inventory_id AS source_record_id, 'syn:inventory_daily:' || inventory_id AS synthetic_entity_id, data_quality_flag, CAST(0 AS INTEGER) AS missing_field_count
    FROM latest i LEFT JOIN prod p USING (product_id) LEFT JOIN wh USING (warehouse_id) LEFT JOIN recent r USING (product_id, warehouse_id)),
days AS (SELECT CAST(d AS DATE) AS day FROM range(TIMESTAMP '1998-04-04', TIMESTAMP '1998-10-01', INTERVAL 1 DAY) r(d)),
sums AS (SELECT l_partkey % 5 AS bucket, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS u FROM lineitem GROUP BY 1, 2),
series AS (SELECT b.bucket, day, CAST(date_diff('day', DATE '1998-04-04', day) AS INTEGER) AS t, coalesce(u, 0.0) AS y FROM (SELECT DISTINCT l_partkey % 5 AS bucket FROM lineitem) b CROSS JOIN days LEFT JOIN sums USING (bucket, day))
"""


def oracle_sql() -> dict[str, str]:
    view = lambda name, rest="": f"{_CTE} SELECT {', '.join(_shown(name))} FROM {name} {rest}"
    sql = _by_views(view)
    same = {"supplier_delay": "supplier_delay_month", "stockout": "stockout_horizon", "forecast": "forecast_history", "what_if": "what_if_scale"}
    return sql | {f"asked_{intent}": f"{sql[name]} LIMIT 200" for intent, name in same.items()}  # the row cap of guarded questions


def _by_views(view: Callable[..., str]) -> dict[str, str]:
    return {
        "shipment_view": view("shipment_view"),
        "supplier_view": view("supplier_view"),
        "demand_view": view("demand_view"),
        "risk_view": view("risk_view"),
        "supplier_delay_month": _CTE + """SELECT supplier_id, supplier_name, count(is_late) AS evaluable_shipments, CAST(sum(CASE WHEN is_late THEN 1 ELSE 0 END) AS BIGINT) AS late_shipments,
            avg(CASE WHEN is_late THEN 1.0 WHEN NOT is_late THEN 0.0 END) AS late_delivery_rate FROM shipment_view WHERE promised_date >= DATE '1998-08-01' AND promised_date < DATE '1998-09-01'
            GROUP BY ALL HAVING count(is_late) > 0 ORDER BY late_delivery_rate DESC, supplier_id""",
        "stockout_horizon": view("risk_view", "WHERE days_of_cover < 14 ORDER BY days_of_cover, product_id, warehouse_id"),
        "forecast_history": view("demand_view", "WHERE product_id = 'P1' AND warehouse_id = 'W3' ORDER BY demand_date"),
        "what_if_scale": f"{_CTE} SELECT {', '.join(_shown('risk_view'))}, avg_daily_demand * (1 + 0.15::DOUBLE) AS scenario_daily_demand, days_of_cover / (1 + 0.15::DOUBLE) AS scenario_days_of_cover FROM risk_view WHERE warehouse_id = 'W3'",
        "supplier_evidence": view("supplier_view", "WHERE supplier_id = '3'"),
        "shipments_for_supplier": view("shipment_view", "WHERE supplier_id = '3'"),
        "missing_promised": view("shipment_view", "WHERE promised_date IS NULL"),
        "quality_flags": _CTE + """SELECT 'shipments' AS table_name, data_quality_flag, count(*) AS n, CAST(sum(missing_field_count) AS BIGINT) AS missing FROM ship GROUP BY ALL
            UNION ALL SELECT 'inventory_daily', data_quality_flag, count(*), CAST(0 AS BIGINT) FROM inv GROUP BY ALL""",
        "duplicate_keys": _CTE + "SELECT shipment_id, count(*) AS copies FROM base GROUP BY 1 HAVING count(*) > 1",
        "fk_violations": _CTE + "SELECT supplier_id, count(*) AS shipments FROM base WHERE supplier_id NOT IN (SELECT supplier_id FROM sup) GROUP BY 1",
        "impossible_dates": _CTE + "SELECT shipment_id, shipped_date, delivered_date FROM base WHERE delivered_date < shipped_date",
        "stale_inventory": _CTE + "SELECT data_quality_flag = 'stale_inventory' AS stale, count(*) AS n FROM inv GROUP BY 1",
        "latest_per_group": _CTE + "SELECT product_id, warehouse_id, inventory_date, on_hand FROM latest",
        "trailing_28d_demand": _CTE + "SELECT product_id, warehouse_id, round(avg_daily_demand, 6) AS avg_daily_demand, history_days FROM recent",
        "recent_delay_events": _CTE + "SELECT supplier_id, recent_delay_events FROM delays",
        "guarded_join": _CTE + """SELECT v.supplier_id, count(v.is_late) AS evaluable, max(u.shipment_count) AS shipments FROM shipment_view v JOIN supplier_view u USING (supplier_id)
            WHERE v.traffic_index >= 0.5 GROUP BY 1 HAVING count(v.is_late) > 0 ORDER BY 1 LIMIT 50""",
        "profile_table": """SELECT 'orders' AS source, count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells, CAST(count(*) - count(DISTINCT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE))) AS BIGINT) AS duplicate_rows,
            'order_date' AS date_column, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date FROM orders""",
        "profile_dates": _CTE + " UNION ALL ".join(f"SELECT 'shipments' AS source, '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS \"first\", CAST(max({c}) AS VARCHAR) AS \"last\" FROM base" for c in ("shipped_date", "promised_date", "delivered_date")),
        "forecast_bounds": _CTE + "SELECT DISTINCT bucket, CAST(14 AS BIGINT) AS days, CAST(1 AS INTEGER) AS first_step, CAST(14 AS INTEGER) AS last_step, true AS in_order FROM series",
        "walk_forward_quantile": _CTE + """SELECT b.bucket, CAST(o AS INTEGER) AS origin, round(avg(abs(a.y - b.y)), 6) AS baseline_mae, true AS measured FROM range(84, 167, 14) r(o) JOIN series a ON a.t >= o AND a.t < o + 14
            JOIN series b ON a.bucket = b.bucket AND b.t = o - 7 + (a.t - o) % 7 GROUP BY 1, 2""",
        "risk_score_counts": _CTE + """SELECT 'stockout' AS risk_type, count(*) AS scored, count(DISTINCT source_record_id) AS entities, true AS levels_known FROM risk_view
            UNION ALL SELECT 'supplier_reliability', count(*), count(DISTINCT supplier_id), true FROM supplier_view UNION ALL SELECT 'late_delivery', count(*), count(DISTINCT shipment_id), true FROM shipment_view""",
        "plan_diagnosis": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'contract_violation|formatting_failure' WHEN 3 THEN 'contract_violation|formatting_failure'
            ELSE 'incorrect_abstention|missing_evidence_requirement|wrong_grouping|wrong_intent|wrong_metric' END AS errors, c_custkey % 5 = 0 AS exact FROM customer""",
        "audit_replay": """SELECT user_id, seq, 'hash differs' AS reason FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) WHERE event_id % 50 = 0""",
        "question_batch": """SELECT s_suppkey, CASE WHEN n BETWEEN 1 AND 90 THEN 'stockout' ELSE 'unsupported' END AS intent, CASE WHEN n BETWEEN 1 AND 90 THEN CAST(n AS INTEGER) END AS horizon_days, n NOT BETWEEN 1 AND 90 AS abstain
            FROM (SELECT s_suppkey, s_suppkey % 120 AS n FROM supplier)""",
        "duplicate_rows": "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)",
        "seasonal_naive": _CTE + "SELECT bucket, CAST(i + 1 AS INTEGER) AS step, y AS point FROM series JOIN range(14) r(i) ON t = 173 + i % 7",
        "lag_features": _CTE + """SELECT * FROM (SELECT bucket, t, y, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, lag(y, 14) OVER w AS lag_14, round(avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_7,
            round(avg(y) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6) AS mean_14, t % 7 AS phase FROM series WINDOW w AS (PARTITION BY bucket ORDER BY t)) WHERE t >= 14""",
        "spike_flags": _CTE + """SELECT bucket, avg(y) FILTER (t >= 173) > 1.75 * greatest(avg(y) FILTER (t BETWEEN 152 AND 172), 1) OR max(y) FILTER (t = 179) > 2 * greatest(avg(y) FILTER (t BETWEEN 172 AND 178), 1) AS spike FROM series GROUP BY 1""",
        "residual_quantiles": _CTE + """SELECT bucket, count(*) AS residuals, round(quantile_cont(r, 0.1), 6) AS low, round(quantile_cont(r, 0.9), 6) AS high FROM (SELECT bucket, y - lag(y, 7) OVER (PARTITION BY bucket ORDER BY t) AS r FROM series) WHERE r IS NOT NULL GROUP BY 1""",
        "walk_forward_baseline": _CTE + """SELECT b.bucket, CAST(o AS INTEGER) AS origin, round(avg(abs(a.y - b.y)), 6) AS baseline_mae FROM range(84, 167, 14) r(o) JOIN series a ON a.t >= o AND a.t < o + 14
            JOIN series b ON a.bucket = b.bucket AND b.t = o - 7 + (a.t - o) % 7 GROUP BY 1, 2""",
        "series_checks": _CTE + "SELECT DISTINCT bucket, 'missing or duplicate day' AS reason FROM series WHERE bucket = 1",
        "risk_rules": _CTE + """SELECT product_id, warehouse_id, CASE WHEN missing_information <> '' THEN 'unknown' WHEN days_of_cover < 14 THEN 'high' ELSE 'low' END AS risk_level, missing_information,
            missing_information <> '' OR days_of_cover < 14 AS recommended_review FROM (SELECT *, concat_ws('|', CASE WHEN days_of_cover IS NULL THEN 'days_of_cover' END,
            CASE WHEN data_quality_flag <> 'ok' THEN 'valid evidence: ' || data_quality_flag END, CASE WHEN inventory_age_days > 3 THEN 'fresh inventory (at most 3 days old)' END) AS missing_information FROM risk_view)""",
        "tfidf_topk": r"""WITH words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM benchmark),
            toks AS (SELECT item_id, unnest(w) AS term FROM words UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
            tf AS (SELECT item_id, term, count(*) AS n FROM toks GROUP BY ALL), df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
            w AS (SELECT item_id, term, n * idf AS w FROM tf JOIN df USING (term)), norm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
            u AS (SELECT item_id, term, w / norm AS w FROM w JOIN norm USING (item_id)),
            sc AS (SELECT a.item_id AS query_id, b.item_id, sum(a.w * b.w) AS score FROM u a JOIN u b USING (term) WHERE a.item_id % 100 = 0 GROUP BY ALL)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM sc QUALIFY rank <= 3""",
        "embedding_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 3""",
        "latency_summary": """SELECT event_type, count(*) AS n, min(value) AS minimum, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, CASE WHEN count(*) >= 20 THEN round(quantile_cont(value, 0.95), 6) END AS p95, max(value) AS maximum FROM events GROUP BY 1""",
        "metrics_grouping_sets": """SELECT o_orderpriority AS arm, CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS category, CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS numerator,
            count(*) AS denominator, round(CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS rate FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))""",
        "leakage_check": "SELECT DISTINCT lower(c_mktsegment) AS question FROM customer",
        "gold_comparison": "SELECT (SELECT count(*) FROM nation) - (SELECT count(DISTINCT n_regionkey) FROM nation) AS only_left, CAST(0 AS BIGINT) AS only_right, false AS equal",
        "hash_chain": """SELECT event_id, event_hash, coalesce(lag(event_hash) OVER (ORDER BY event_id), repeat('0', 64)) AS previous_hash FROM (SELECT event_id, sha256(concat_ws('|', event_id, user_id, event_type)) AS event_hash FROM events)""",
    }
