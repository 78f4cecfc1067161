"""Sources, quality flags, fixtures, views, profiles and files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gristmill.catalog import PROVENANCE, TABLES, VIEWS
from gristmill.operators.fixtures import DATA_FIXTURES, apply_fixture
from gristmill.operators.views import view_frames
from gristmill.sources import files, profile
from gristmill.sources.store import build_store, canonical, introspect, open_store
from gristmill.sources.synthetic import from_rows, synthetic_tables


def test_store(spark, store):
    tables = open_store(spark, store)
    sizes = {t: df.count() for t, df in tables.items()}
    assert sizes == {"suppliers": 3, "warehouses": 3, "products": 6, "calendar": 180, "demand_daily": 3240, "inventory_daily": 3240, "orders": 540, "order_items": 540, "shipments": 540, "purchase_orders": 3, "supplier_events": 1, "promotions": 1, "risk_events": 0, "audit_events": 0}
    for name, df in tables.items():
        assert df.columns == [*TABLES[name], *PROVENANCE]
    for name, columns in VIEWS.items():
        assert dict(spark.table(name).dtypes) == columns
        assert spark.table(name).count() > 0
    with pytest.raises(FileExistsError):
        build_store(spark, store)
    assert introspect(tables).where("table_name = 'orders'").count() == 4 + len(PROVENANCE)


def test_replace_and_failed_build(spark, tmp_path):
    path = str(tmp_path / "s")
    build_store(spark, path)
    build_store(spark, path, replace=True)
    tables = synthetic_tables(spark)
    broken = tables | {"orders": tables["orders"].withColumn("status", F.raise_error(F.lit("stop")))}
    with pytest.raises(Exception, match="stop"):
        build_store(spark, path, broken, replace=True)
    assert open_store(spark, path)["orders"].count() == 540
    assert [p.name for p in tmp_path.iterdir()] == ["s"]


def test_generator_is_deterministic(spark):
    once, again = (synthetic_tables(spark)["shipments"].repartition(n).orderBy("_ordinal").collect() for n in (2, 5))
    assert once == again
    assert synthetic_tables(spark, seed=1)["shipments"].orderBy("_ordinal").collect() != once


FLAG = {"missing_supplier": ("shipments", "missing_fields;unknown_supplier", 1), "missing_promised_date": ("shipments", "missing_fields", 1), "duplicate_shipment": ("shipments", "duplicate_shipment", 2), "impossible_delivery_date": ("shipments", "impossible_delivery_date", 1), "unknown_product": ("inventory_daily", "unknown_product", 1)}


@pytest.mark.parametrize("name", sorted(FLAG))
def test_fixture_flags(spark, name):
    table, flag, n = FLAG[name]
    tables = canonical(apply_fixture(name, synthetic_tables(spark)))
    assert tables[table].where(F.col("data_quality_flag") == flag).count() == n
    if table == "shipments":
        views = view_frames(tables)
        bad = views["shipment_view"].where("data_quality_flag <> 'ok'")
        assert bad.where("is_late IS NOT NULL").count() == 0
        lost = views["supplier_view"].agg(F.sum("missing_or_invalid_shipments")).first()[0]
        assert lost == (0 if name == "missing_supplier" else n)


def test_other_fixtures(spark):
    raw = synthetic_tables(spark)
    stale = view_frames(canonical(apply_fixture("stale_inventory", raw)))["risk_view"]
    assert stale.where("data_quality_flag = 'stale_inventory' AND inventory_age_days = 10").count() == 18
    before, after = (canonical(t)["demand_daily"].agg(F.sum("units")).first()[0] for t in (raw, apply_fixture("demand_spike", raw)))
    assert after > before
    burst = view_frames(canonical(apply_fixture("supplier_delay_burst", raw)))["supplier_view"].where("supplier_id = 'S1'").first()
    assert burst.recent_delay_events == 8
    with pytest.raises(ValueError):
        apply_fixture("nothing", raw)
    assert len(DATA_FIXTURES) == 8


def test_views_on_hand_made_rows(spark):
    d = date
    raw = {name: from_rows(spark, name, []) for name in TABLES} | {
        "suppliers": from_rows(spark, "suppliers", [("S1", "A", 1), ("S2", "B", 2)]),
        "products": from_rows(spark, "products", [("P1", "p", "S1", 1.0)]),
        "warehouses": from_rows(spark, "warehouses", [("W1", "w")]),
        "shipments": from_rows(spark, "shipments", [("a", "o", "S1", "W1", d(2026, 9, 1), d(2026, 9, 5), d(2026, 9, 7), 1.0, 0.1), ("b", "o", "S1", "W1", d(2026, 9, 1), d(2026, 9, 5), d(2026, 9, 5), 1.0, 0.1), ("c", "o", "S1", "W1", d(2026, 9, 1), d(2026, 9, 5), d(2026, 8, 5), 1.0, 0.1), ("d", "o", None, "W1", d(2026, 9, 1), None, None, 1.0, 0.1)]),
        "inventory_daily": from_rows(spark, "inventory_daily", [("i1", d(2026, 9, 30), "P1", "W1", 50, 70), ("i2", d(2026, 9, 30), "P1", "W1", 60, 70), ("i0", d(2026, 9, 1), "P1", "W1", 1, 70)]),
        "demand_daily": from_rows(spark, "demand_daily", [("x", d(2026, 9, 30), "P1", "W1", 0.0), ("y", d(2026, 9, 2), "P1", "W1", 9.0)]),
    }
    views = view_frames(canonical(raw))
    rows = {r.shipment_id: (r.data_quality_flag, r.is_late, r.delay_days) for r in views["shipment_view"].collect()}
    assert rows == {"a": ("ok", True, 2), "b": ("ok", False, 0), "c": ("impossible_delivery_date", None, None), "d": ("missing_fields;unknown_supplier", None, None)}
    s1, s2 = views["supplier_view"].orderBy("supplier_id").collect()
    assert (s1.shipment_count, s1.evaluable_shipments, s1.missing_or_invalid_shipments, s1.late_delivery_rate, s1.mean_delay_days) == (3, 2, 1, 0.5, 1.0)
    assert (s2.shipment_count, s2.evaluable_shipments, s2.late_delivery_rate, s2.recent_delay_events) == (0, 0, None, 0)
    risk = views["risk_view"].first()
    assert (risk.on_hand, risk.avg_daily_demand, risk.days_of_cover, risk.history_days) == (50, 0.0, None, 1)  # window excludes day 28 back; no division by zero


def test_profile(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿order_date,value\n2026-01-02,1\n2026-01-02,1\n01/03/2026,\n".encode())
    row = profile.profile_file(spark, str(path))[0].first()
    assert (row.rows, row.columns, row.missing_cells, row.duplicate_rows, row.date_column, row.first_date, row.last_date) == (3, 2, 1, 1, "order_date", "2026-01-02", "2026-01-03")
    two = tmp_path / "d.csv"
    two.write_text('ship_date,note,Promised_Date,some_timestamp\n2026-01-05,"a\nb",2026-02-01,x\n2026-01-02,c,,\n')
    row = profile.profile_file(spark, str(two), multiline=True)[0].first()
    assert (row.rows, [tuple(r) for r in row.date_ranges]) == (2, [("ship_date", "2026-01-02", "2026-01-05"), ("Promised_Date", "2026-02-01", "2026-02-01")])
    other = tmp_path / "n.csv"
    other.write_text("a,b\n,x\nn,x\nx,\n")
    assert profile.profile_file(spark, str(other))[0].first().duplicate_rows == 0
    assert profile.profile_file(spark, str(tmp_path / "t.txt")) == []


def test_files(spark, tmp_path):
    entries = [{"dataset_id": "a", "title": "A, b", "bytes": 5}, {"dataset_id": "b"}]
    files.write_manifest(files.manifest(spark, entries), str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m")).orderBy("dataset_id").collect()
    assert [(r.dataset_id, r.title, r.bytes) for r in back] == [("a", "A, b", "5"), ("b", None, None)]
    with pytest.raises(ValueError):
        files.manifest(spark, [{"strange": 1}])
    (tmp_path / "f").write_text("x")
    pinned = files.fingerprints(spark, [str(tmp_path / "f")]).select("path", "sha256").cache()
    assert files.drifted(spark, pinned).count() == 0
    (tmp_path / "f").write_text("y")
    assert files.drifted(spark, pinned).count() == 1
    cases = spark.range(141).withColumn("q", F.concat(F.lit("q"), "id"))
    split = files.exact_splits(cases, "q", {"train": 93, "dev": 24, "test": 24})
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 93, "dev": 24, "test": 24}
    files.write_jsonl(split, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 141
    shares = {r["split"]: r["count"] for r in files.splits(spark.range(10_000).withColumn("q", F.col("id")), "q", {"a": 3, "b": 1}).groupBy("split").count().collect()}
    assert abs(shares["a"] - 7500) < 200
    with pytest.raises(ValueError):
        files.write_report(str(tmp_path / "r"), {"x": float("nan")})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_filters_and_prune_columns(spark, store):
    open_store(spark, store)
    one = plan_of(spark.sql("SELECT shipment_id, is_late FROM shipment_view WHERE supplier_id = 'S1'"))
    assert "EqualTo(supplier_id,S1)" in one and "distance_km" not in one
    ranked = plan_of(spark.sql("SELECT product_id, on_hand FROM risk_view WHERE product_id = 'P1'"))
    assert "EqualTo(product_id,P1)" in ranked and "WindowGroupLimit" in ranked and "CartesianProduct" not in ranked
    recent = plan_of(spark.sql("SELECT product_id, avg_daily_demand FROM risk_view"))
    assert "GreaterThan(demand_date" in recent
