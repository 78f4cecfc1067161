"""Risk, forecasts, scenarios, evidence and recommendations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import forecast as f
from gristmill.functions import risk
from gristmill.functions import timeseries as ts
from gristmill.functions.evidence import evidence_id, forecast_from_result, recommend, verified
from gristmill.functions.retrieval import Retriever, tfidf_search, vector_search
from gristmill.functions.whatif import scaled, scenario


def result(rows, status="ok", truncated=False):
    return {"status": status, "rows": rows, "sql": "SELECT 1", "parameters": {}, "evidence_id": evidence_id("SELECT 1", {}, rows), "truncated": truncated}


@pytest.mark.parametrize("kind,brier", [("stockout", 0.068225), ("late_delivery", 0.179005), ("supplier_reliability", 0.060392)])
def test_brier(kind, brier):
    assert risk.fit(kind).brier == pytest.approx(brier, abs=1e-4)


@pytest.mark.parametrize(
    "kind,row,level",
    [
        ("stockout", {"days_of_cover": 5.0, "inventory_age_days": 0}, "high"),
        ("stockout", {"days_of_cover": 39.0, "inventory_age_days": 0}, "low"),
        ("stockout", {"days_of_cover": 39.0, "inventory_age_days": 4}, "unknown"),
        ("stockout", {"days_of_cover": None, "inventory_age_days": 0}, "unknown"),
        ("stockout", {"days_of_cover": math.inf, "inventory_age_days": 0}, "unknown"),
        ("stockout", {"days_of_cover": 39.0, "inventory_age_days": 0, "data_quality_flag": "missing_fields"}, "unknown"),
        ("late_delivery", {"distance_km": 500.0, "traffic_index": 0.9}, "high"),
        ("late_delivery", {"distance_km": 60.0, "traffic_index": 0.0}, "low"),
        ("supplier_reliability", {"late_delivery_rate": 0.6, "evaluable_shipments": 50}, "high"),
        ("supplier_reliability", {"late_delivery_rate": 0.05, "evaluable_shipments": 50}, "low"),
        ("supplier_reliability", {"late_delivery_rate": 0.05, "evaluable_shipments": 9}, "unknown"),
        ("supplier_reliability", {"late_delivery_rate": 0.05, "evaluable_shipments": 50, "recent_delay_events": 3}, "high"),
        ("supplier_reliability", {"late_delivery_rate": 0.05, "evaluable_shipments": 50, "missing_or_invalid_shipments": 1}, "unknown"),
    ],
)
def test_levels_of_rows_and_columns_agree(spark, kind, row, level):
    model = risk.fit(kind)
    one = risk.assess_row(model, row)
    assert one["risk_level"] == level and one["recommended_review"] == (level != "low")
    kinds = {float: "double", int: "bigint", str: "string", type(None): "double"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))
    got = risk.assess(df, model).first()
    assert (got.risk_level, got.missing_information, got.recommended_review, len(got.drivers)) == (level, one["missing_information"], one["recommended_review"], len(one["drivers"]))


def test_unknown_kind():
    with pytest.raises(ValueError):
        risk.simulated("weather")


PERIODIC = [10.0 + i % 7 for i in range(126)]


def test_forecast_shapes():
    made = f.forecast(PERIODIC)
    assert made["method"] == "quantile_boosted_trees"
    assert all(0 <= lo <= mid <= hi for lo, mid, hi in zip(made["lower"], made["point"], made["upper"]))
    assert np.abs(np.array(made["point"]) - made["baseline"]).max() < 0.5
    walk = f.walk_forward(PERIODIC)
    assert [x["test_start_index"] for x in walk["folds"]] == [84, 98, 112]
    assert walk["mean_baseline_mae"] == 0 and walk["mean_mae"] < 0.2
    assert f.walk_forward(PERIODIC[:90])["warning"]


def test_sparse_spikes_and_bad_series():
    assert f.forecast([1, 2])["lower"] == [None] * 14
    few = f.forecast([float(i % 5) for i in range(30)])
    assert few["method"] == "seasonal_naive" and all(lo <= p <= hi for lo, p, hi in zip(few["lower"], few["point"], few["upper"]))
    assert f.SPIKE_NOTE in f.forecast([10.0] * 100 + [50.0] * 7)["warnings"]
    assert f.naive([1, 2, 3], 5) == [1, 2, 3, 1, 2]
    for bad in ([], [-1.0], [float("nan")], [[1.0]]):
        with pytest.raises(ValueError):
            f.checked(bad)
    for horizon in (0, 91, 1.5, True):
        with pytest.raises(ValueError):
            f.forecast(PERIODIC, horizon)


def test_boosting_beats_naive_on_noise():
    rng = np.random.default_rng(3)
    y = np.maximum(0, 20 + 8 * (np.arange(200) % 7 >= 5) + rng.normal(0, 4, 200)).round()
    walk = f.walk_forward(y)
    assert walk["mean_mae"] < walk["mean_baseline_mae"]
    assert 0.3 < np.mean([x["interval_coverage"] for x in walk["folds"]]) <= 1


def test_series_operators_match_plain_code(spark):
    rng = np.random.default_rng(5)
    values = {k: rng.integers(0, 30, 120).astype(float) for k in range(3)}
    df = spark.createDataFrame([(k, t, float(y)) for k, ys in values.items() for t, y in enumerate(ys)], "k int, t int, y double")
    naive = {(r.k, r.step): r.point for r in ts.seasonal_naive(df, "k").collect()}
    assert naive == {(k, i + 1): v for k, ys in values.items() for i, v in enumerate(f.naive(ys))}
    lags = {(r.k, r.t): [r.lag_1, r.lag_7, r.lag_14, r.mean_7, r.mean_14, r.phase] for r in ts.lag_features(df, "k").collect()}
    assert all(np.allclose(lags[k, t], f.lag_row(ys, t)) for k, ys in values.items() for t in range(14, 120))
    assert {r.k: r.spike for r in ts.spikes(df, "k").collect()} == {k: bool(f.spiking(ys)) for k, ys in values.items()}
    assert {(r.k, r.origin) for r in ts.walk_forward_naive(df, "k").collect()} == {(k, o) for k in values for o in (84, 98)}
    walked = {(r.k, r.origin): r.mae for r in f.walk_forward_series(df, "k").collect()}
    assert walked[0, 84] == pytest.approx(f.fold(values[0], 84)["mae"])
    assert f.forecast_series(df.where("t < 20"), "k").where("method <> 'seasonal_naive' OR lower IS NOT NULL").count() == 0
    gap = df.where("NOT (k = 1 AND t = 5)").withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.col("t"))).withColumn("y", F.when(F.col("k") == 2, -F.col("y")).otherwise(F.col("y")))
    assert {r.k: r.reason for r in ts.invalid_series(gap, "k").collect()} == {1: "missing or duplicate day", 2: "invalid value"}


ROW = {"warehouse_id": "W1", "product_id": "P1", "on_hand": 100, "avg_daily_demand": 10.0, "days_of_cover": 10.0}


def test_scenarios(spark):
    made = scenario(ROW, 0.25)
    assert (made["scenario_daily_demand"], made["scenario_days_of_cover"]) == (12.5, 8.0)
    assert scenario(ROW | {"avg_daily_demand": 0.0})["scenario_days_of_cover"] is None
    for bad in (-0.91, 2.1, math.nan, math.inf):
        with pytest.raises(ValueError):
            scenario(ROW, bad)
    with pytest.raises(ValueError):
        scenario(ROW | {"on_hand": None})
    assert scaled(spark.createDataFrame([ROW]), 0.25).first().scenario_days_of_cover == 8.0


def test_recommendations():
    rows = [{"days_of_cover": 5.0, "inventory_age_days": 0, "data_quality_flag": "ok"}]
    high = risk.assess_row(risk.fit("stockout"), rows[0])
    assert "replenishment" in recommend(result(rows), high)["recommendation"]
    assert "Resolve" in recommend(result(rows, truncated=True), high)["recommendation"]
    assert recommend(result(rows))["simulated_action_only"] is True
    flagged = [rows[0] | {"data_quality_flag": "missing_fields"}] * 2
    assert recommend(result(flagged))["missing_information"] == ["missing_fields"]
    with pytest.raises(ValueError):
        recommend(result(rows), high | {"evidence_rows": [{"other": 1}]})
    with pytest.raises(ValueError):
        verified(result(rows) | {"rows": [rows[0] | {"days_of_cover": 6.0}]})
    for bad in (result(rows, status="empty"), result([])):
        with pytest.raises(ValueError):
            verified(bad)


def test_forecast_from_evidence():
    rows = [{"product_id": "P1", "warehouse_id": "W1", "demand_date": f"2026-01-{d:02d}", "units": 5.0} for d in range(1, 31)]
    made = forecast_from_result(result(rows))
    assert made["last_observed_date"] == "2026-01-30" and len(made["point"]) == 14
    assert recommend(result(rows), forecast=made)["sources"][-1] == "seasonal_naive"
    for bad in (rows[:3] + rows[4:], rows + rows[:1], rows[:2] + [rows[2] | {"product_id": "P2"}], rows[:2] + [rows[2] | {"data_quality_flag": "x"}]):
        with pytest.raises(ValueError):
            forecast_from_result(result(bad))
    with pytest.raises(ValueError):
        recommend(result(rows), forecast=made | {"evidence_id": "x"})


def test_batch_retrieval_agrees(spark):
    docs = Retriever().vectors.keys()
    from gristmill.functions.retrieval import view_documents

    table = spark.createDataFrame(list(view_documents().items()), "view string, text string")
    asked = spark.createDataFrame([(0, "stock coverage at the warehouse"), (1, "late delivery")], "q int, question string")
    got = {(r.q, r.view): r.score for r in tfidf_search(table, "view", "text", asked, "q", "question", 4).collect()}
    for q, text in ((0, "stock coverage at the warehouse"), (1, "late delivery")):
        want = Retriever().scores(text)
        assert all(got.get((q, v), 0.0) == pytest.approx(want[v]) for v in docs)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id int, v array<double>")
    best = vector_search(rows, "id", "v", spark.createDataFrame([(9, [1.0, 0.0])], "q int, a array<double>"), "q", "a", 2)
    assert [(r.id, r.score) for r in best.orderBy("rank").collect()] == [(4, 4.0), (3, 3.0)]


def test_searches_beyond_their_bounds_agree(spark, monkeypatch):
    """Queries over the broadcast bound go by blocks, and a common term is dealt to parts: neither changes a result."""
    from gristmill.functions import retrieval

    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], f"stock of item {i} and the common word") for i in range(60)], "id long, v array<double>, text string")
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("a"), F.col("text").alias("t"))
    read = lambda df: sorted(map(tuple, df.select("q", "rank", "id", F.round("score", 9)).collect()))
    both = lambda: (read(vector_search(rows, "id", "v", asked, "q", "a")), read(tfidf_search(rows, "id", "text", asked, "q", "t")))
    want = both()
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    monkeypatch.setattr(retrieval, "TERM_ROWS", 4)
    assert both() == want and len(want[0]) == len(want[1]) == 18


@pytest.mark.parametrize("blocks", [(512, 4096), (2, 7)])
def test_block_search_against_brute_force(spark, monkeypatch, blocks):
    """Every hundredth row asks all rows; ids past the first five get results too."""
    from gristmill.functions import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "ROW_BLOCK", blocks[1])
    x = np.random.default_rng(5).normal(size=(401, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 100 = 0").withColumnsRenamed({"vec_id": "query_id", "embedding": "asked"})
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.block_search(rows, "vec_id", "embedding", asked, "query_id", "asked").collect()}
    scores = np.round(x @ x.T, 9)
    assert got == {(q, k + 1): int(v) for q in range(0, 401, 100) for k, v in enumerate(np.lexsort((np.arange(401), -scores[q]))[:3])}


def test_hundredth_queries_ask_every_hundredth_row(spark):
    from conftest import SF

    from gristmill import queries as q

    for name, table, key in (("embedding_topk", "embeddings", "vec_id"), ("tfidf_topk", "benchmark", "item_id")):
        want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").where(f"{key} % 100 = 0").select(key).collect()}
        assert {r.query_id for r in q.queries()[name](spark, SF).collect()} == want


def test_whole_chain_links_across_blocks(spark):
    """The first id of a block links to the last of the one before, over gaps as well; only the first row has no link."""
    from gristmill.queries import whole_chain

    ids = [*range(0, 2500), *range(5990, 6010)]
    rows = spark.createDataFrame([(i, f"h{i}") for i in ids], "event_id long, event_hash string").repartition(3)
    got = {r.event_id: r.previous_hash for r in whole_chain(rows).collect()}
    assert got == {i: f"h{p}" if p is not None else "0" * 64 for i, p in zip(ids, [None, *ids])}
