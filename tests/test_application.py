"""Service, audit, console, command line, evaluation and streaming."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from gristmill import __main__ as cli
from gristmill import evaluate as ev
from gristmill import harness as hs
from gristmill.audit import GENESIS, AuditLog, broken_links, canonical, chained, current_actions, digest, verify_events
from gristmill.console import Console
from gristmill.operators.fixtures import QUERY_FIXTURES, apply_fixture
from gristmill.plans.grammar import request_plan
from gristmill.plans.planner import UnavailablePlanner
from gristmill.plans.query_plan import make_plan
from gristmill.service import ask
from gristmill.sources.store import build_store
from gristmill.sources.synthetic import synthetic_tables
from gristmill.streaming.delays import read_events, recent_delays, run_to


class Fixed:
    name, fallback_on_failure = "fixed", True

    def __init__(self, output):
        self.output = output

    def generate(self, question, retrieved):
        return self.output


@pytest.mark.parametrize("name", sorted(QUERY_FIXTURES))
def test_failing_questions(spark, store, name):
    question, status = QUERY_FIXTURES[name]
    assert ask(spark, question, timeout=60)["status"] == status


@pytest.mark.parametrize("question", ["Which suppliers had the highest late-delivery rate last month?", "Forecast demand for P1 at W3", "What happens if demand increases by 15% at Warehouse 3?", "Why is Supplier A considered high risk?"])
def test_answers(spark, store, question):
    record = ask(spark, question, timeout=60)
    assert (record["status"], record["json_validation"], record["plan_validation"], record["sql_validation"]) == ("ok", "passed", "passed", "passed")
    assert record["query_result"]["rows"] and not record["abstained"] and record["latency_ms"] > 0


def test_stale_rows_and_bad_input(spark, store):
    record = ask(spark, "Show shipments for Supplier A", timeout=60)
    assert record["status"] == "ok" and record["query_result"]["truncated"] is False
    assert ask(spark, "Forecast demand for P1 at W3", timeout=0)["status"] == "timeout"
    for bad in ("", None, "x" * 2001):
        assert ask(spark, bad)["status"] == "clarification"


def test_fallbacks(spark, store):
    question = "Why is Supplier B considered high risk?"
    for planner in (UnavailablePlanner("no model"), Fixed("{"), Fixed(make_plan()), Fixed(request_plan("Why is Supplier C considered high risk?"))):
        record = ask(spark, question, planner, timeout=60)
        assert (record["status"], record["fallback_used"], record["effective_planner"]) == ("ok", True, "deterministic_rules")
        assert record["failure_behavior"]
        assert ask(spark, question, planner, timeout=60, allow_fallback=False)["query_plan"] is None
    good = ask(spark, question, Fixed(json.dumps(request_plan(question))), timeout=60)
    assert (good["status"], good["fallback_used"]) == ("ok", False)


def chain(n):
    events, head = [], GENESIS
    for i in range(n):
        body = {"event_id": f"e{i}", "event_type": "query", "actor": "a", "timestamp": "t", "payload": {"i": i}, "previous_hash": head}
        head = digest(body)
        events.append(body | {"event_hash": head})
    return events


def test_chain():
    events = chain(5)
    assert verify_events(events) == {"event_count": 5, "head_hash": events[-1]["event_hash"]}
    assert verify_events([])["head_hash"] == GENESIS
    changes = [events[:2] + events[3:], events[::-1], [events[0], events[0]], [events[0] | {"actor": "b"}], [events[0] | {"extra": 1}], [{k: v for k, v in events[0].items() if k != "event_hash"}], ["x"]]
    for bad in changes:
        with pytest.raises(ValueError):
            verify_events(bad)
    with pytest.raises(ValueError):
        canonical({"x": float("nan")})


def test_distributed_chain_check(spark):
    rows = [(i, e["event_id"], e["event_type"], e["actor"], canonical({k: v for k, v in e.items() if k != "event_hash"}), e["previous_hash"], e["event_hash"]) for i, e in enumerate(chain(6))]
    schema = "seq long, event_id string, event_type string, actor string, payload string, previous_hash string, event_hash string"
    table = lambda r: spark.createDataFrame(r, schema)
    found = lambda r: {(x.seq, x.reason) for x in broken_links(table(r)).collect()}
    assert found(rows) == set()
    swap = lambda i, k, v: rows[:i] + [rows[i][:k] + (v,) + rows[i][k + 1 :]] + rows[i + 1 :]
    assert found(swap(2, 4, rows[2][4].replace('"i":2', '"i":3'))) == {(2, "hash differs")}
    assert found(swap(2, 3, "other")) == {(2, "metadata differs")}
    assert found(swap(2, 4, "{")) == {(2, "unreadable payload")}
    assert (3, "link differs") in found(rows[:2] + rows[3:])
    assert (5, "event_id repeats") in found(swap(5, 1, "e0"))


def test_many_logs(spark):
    """Logs of many owners are chained and checked by owner, in order, however rows arrive."""
    events = spark.createDataFrame([(i % 3, i, f"e{i}", "query", "a", "t", '{"i": 1}') for i in range(30)], "owner long, nr long, event_id string, event_type string, actor string, timestamp string, payload string").repartition(5)
    log = chained(events, "owner", ["nr"])
    assert broken_links(log, ("owner",)).count() == 0
    one = [r.event_id for r in log.where("owner = 1").orderBy("seq").collect()]
    assert one == [f"e{i}" for i in range(1, 30, 3)]
    bad = log.withColumn("payload", F.when(F.col("event_id") == "e4", F.lit("{}")).otherwise(F.col("payload"))).where("event_id <> 'e8'")
    assert {tuple(r) for r in broken_links(bad, ("owner",)).collect()} == {(1, 1, "metadata differs"), (2, 3, "link differs")}
    assert chained(events.where("false"), "owner", ["nr"]).count() == 0


def test_writers_wait(spark, tmp_path):
    """A writer waits for the lock, gives up after its patience, and a broken log takes no more events."""
    log = AuditLog(spark, str(tmp_path / "log"), patience=20.0)
    log.append("query", {"n": 1})
    lock = tmp_path / "log.lock"
    lock.touch()
    with pytest.raises(RuntimeError):
        AuditLog(spark, str(tmp_path / "log"), patience=0.2).append("query", {"n": 2})
    threading.Timer(1.0, lock.unlink).start()
    log.append("query", {"n": 3})
    assert [e["payload"]["n"] for e in log.replay()] == [1, 3]
    rows = log.table().withColumn("payload", F.replace("payload", F.lit('"n":3'), F.lit('"n":4'))).collect()
    spark.createDataFrame(rows, log.table().schema).write.mode("overwrite").parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        AuditLog(spark, str(tmp_path / "bad")).append("query", {"n": 5})


def test_gate(spark, store, tmp_path):
    console = Console(spark, store)
    console.audit = console.gate.log = AuditLog(spark, str(tmp_path / "log"))
    record = console.question("Show products likely to stock out within the next 14 days", 60)
    assert record["status"] in ("ok", "empty")
    record = console.question("Why is Supplier A considered high risk?", 60)
    assert record["risks"][0]["risk_type"] == "supplier_reliability"
    action = console.gate.propose(record["recommendations"][0])
    for bad in (("approve", "system"), ("approve", " "), ("maybe", "Kim"), ("edit", "Kim")):
        with pytest.raises(ValueError):
            console.gate.decide(action["action_id"], *bad)
    edited = console.gate.decide(action["action_id"], "edit", "Kim", "Call first")
    assert (edited["state"], edited["revision"]) == ("pending", 2)
    assert console.gate.decide(action["action_id"], "approve", "Kim")["state"] == "approved_simulation"
    with pytest.raises(ValueError):
        console.gate.decide(action["action_id"], "reject", "Kim")
    with pytest.raises(ValueError):
        console.gate.current("none")
    with pytest.raises(ValueError):
        console.gate.propose(record["recommendations"][0] | {"evidence_rows": [{"x": 1}]})
    with pytest.raises(ValueError):
        console.audit.append("query", {}, " ")
    kinds = [e["event_type"] for e in console.audit.replay()]
    assert kinds[-5:] == ["query", "analysis", "action_proposed", "action_edit", "action_approve"]
    assert console.audit.verify()["event_count"] == len(kinds)
    assert broken_links(console.audit.table()).count() == 0
    now = current_actions(console.audit.table()).first()
    assert (now.state, now.revision) == ("approved_simulation", 2)


def test_console_kinds(spark, store, tmp_path):
    console = Console(spark, store)
    console.audit = AuditLog(spark, str(tmp_path / "log"))
    assert console.question("Forecast demand for P1 at W3", 60)["forecast"]["history_days"] == 180
    what = console.question("What happens if demand increases by 15% at Warehouse 3?", 60)
    assert len(what["what_if"]) == len(what["query_result"]["rows"]) == 6
    assert "risks" not in console.question("Delete all orders", 60)
    assert [e["event_type"] for e in console.audit.replay()] == ["query", "analysis", "query", "analysis", "query"]


def test_incomplete_evidence(spark, store, tmp_path):
    path = str(tmp_path / "s")
    build_store(spark, path, apply_fixture("missing_promised_date", synthetic_tables(spark)))
    console = Console(spark, path)
    record = console.question("Show shipments missing promised delivery dates", 60)
    assert record["status"] == "missing_information" and len(record["query_result"]["rows"]) == 1
    Console(spark, store)  # the shared views again


def test_command_line(spark, store, tmp_path, capsys):
    path = str(tmp_path / "s")
    cli.main(["--store", path, "build"])
    cli.main(["--store", path, "ask", "Why is Supplier A considered high risk?", "--propose", "--backend", "model"])
    text = capsys.readouterr().out
    record = json.loads(text[text.index("{", text.index("}") + 1) :])
    cli.main(["--store", path, "decide", record["pending_action"]["action_id"], "reject", "--reviewer", "Kim"])
    cli.main(["--store", path, "replay"])
    assert '"rejected"' in capsys.readouterr().out
    Console(spark, store)


def test_diagnosis(spark):
    plan = request_plan("What happens if demand increases by 15% at Warehouse 3?")
    labels = lambda raw, want=plan: set(ev.diagnose(raw, want)["errors"])
    assert ev.diagnose(plan, plan)["whole_plan_exact"] and labels(plan) == set()
    assert labels("{") == {"formatting_failure", "contract_violation"}
    assert labels(plan | {"intent": "stockout"}) >= {"wrong_intent", "contract_violation"}
    assert "missing_entity_filter" in labels(plan | {"entities": dict.fromkeys(plan["entities"])})
    assert "wrong_entity_normalization" in labels(plan | {"entities": plan["entities"] | {"warehouse_id": "W1"}})
    assert labels(plan | {"entities": plan["entities"] | {"warehouse_id": "Warehouse 3"}}) == set()
    assert "missing_what_if_parameter" in labels(plan | {"scenario": None})
    assert "wrong_what_if_parameter" in labels(plan | {"scenario": {"demand_increase": 0.2}})
    assert "missing_evidence_requirement" in labels(plan | {"evidence_requirements": []})
    assert "incorrect_abstention" in labels(make_plan())
    assert "unsupported_request_incorrectly_accepted" in labels(plan, make_plan())
    total = ev.summarize([ev.diagnose(plan, plan), ev.diagnose("{", plan)])
    assert (total["cases"], total["whole_plan_exact"], total["error_taxonomy"]["formatting_failure"]) == (2, 1, 1)
    found = ev.diagnose_frame(spark.createDataFrame([("a", json.dumps(plan), json.dumps(plan)), ("b", "{", json.dumps(plan))], "id string, proposed string, expected string"))
    assert {r.error: r.cases for r in ev.error_counts(found).collect()} == {"formatting_failure": 1, "contract_violation": 1}


def test_instruction_corpus():
    """141 cases with labels, in splits that share no question; recoveries carry a wrong output and the request to mend it."""
    cases = ev.curated_cases()
    count = lambda key: {k: sum(c[key] == k for c in cases) for k in {c[key] for c in cases}}
    assert count("split") == ev.SPLITS and count("category") == ev.CURATED | {"pilot": ev.PILOT}
    rows = ev.instructions(cases)
    assert len(rows) == 141 and {len(r["messages"]) for r in rows if r["category"] == "recovery"} == {4}
    assert all(json.loads(r["messages"][-1]["content"]) == request_plan(c["question"]) for r, c in zip(rows, cases))
    assert all(ev.diagnose(c["previous_output"], c["target"])["errors"] for c in cases if "previous_output" in c)


def test_leakage_and_instructions(spark):
    df = spark.createDataFrame([("a", "Is it  late?"), ("b", "is it late"), ("a", "x")], "split string, q string")
    assert [r.question for r in ev.overlapping_splits(df, "split", "q").collect()] == ["is it late"]
    cases = ev.pilot_cases()
    assert len(ev.instructions(cases)) == len(cases) >= 15
    with pytest.raises(ValueError):
        ev.instructions(cases + cases[:1])
    same = ev.differences(df, df).first()
    assert (same.only_left, same.only_right, same.equal) == (0, 0, True)


def test_stream_equals_batch(spark, tmp_path):
    raw = apply_fixture("supplier_delay_burst", synthetic_tables(spark))["supplier_events"].drop("_ordinal")
    raw.write.parquet(str(tmp_path / "in"))
    stream = recent_delays(read_events(spark, str(tmp_path / "in"), raw.schema))
    run_to(stream, "delays", str(tmp_path / "cp"), "complete")
    at = spark.table("delays").where(F.col("window_end").cast("date") == F.lit("2026-10-01").cast("date")).collect()
    assert [(r.supplier_id, r.recent_delay_events) for r in at] == [("S1", 8)]


def test_behaviours_and_planner_comparison(spark, store, tmp_path):
    missing = str(tmp_path / "missing")
    build_store(spark, missing, apply_fixture("missing_promised_date", synthetic_tables(spark)))
    console = Console(spark, store)
    console.audit = AuditLog(spark, str(tmp_path / "log"))
    seen = hs.run_behaviours(spark, {"base": console}, {"base": store, "missing": missing}, repeats=1, timeout=60).cache()
    wrong = [(r.case, r.expected, r.status) for r in seen.where("status <> expected").collect()]
    assert [w for w in wrong if w[0] != "stockout"] == []  # whether anything runs low is up to the data
    rates = {r.metric: (r.numerator, r.denominator) for r in hs.metrics(seen).where("category = 'all'").collect()}
    assert rates["unsafe_refused"] == (2, 2) and rates["as_expected"][1] == 12
    assert console.audit.verify()["event_count"] == 12
    cases = hs.labelled(["Why is Supplier B considered high risk?", "Show shipments for Supplier A", "What is the weather?", "Delete all orders"])
    from gristmill.plans.planner import RulePlanner

    progress = tmp_path / "progress.jsonl"
    both = hs.compare_planners(spark, {"rules": RulePlanner(), "none": UnavailablePlanner("x")}, cases, progress=str(progress), timeout=60).cache()
    got = {(r.arm, r.metric): (r.numerator, r.denominator) for r in hs.metrics(both).where("category = 'all'").collect()}
    assert got["rules", "plan_exact"] == (4, 4) and got["none", "plan_exact"] == (0, 4)
    assert got["rules", "answer_is_gold"] == got["none", "answer_is_gold"] == (2, 2)
    assert got["none", "fallbacks"] == (4, 4) and got["rules", "negatives_abstained"] == (2, 2) == got["none", "negatives_abstained"]
    assert len(progress.read_text().splitlines()) == 8
    late = {r.arm: r for r in hs.latencies(both).collect()}
    assert late["rules"].calls == 4 and late["rules"].p95 is None and late["rules"].minimum <= late["rules"].median <= late["rules"].maximum
    with pytest.raises(ValueError):
        hs.compare_planners(spark, {"rules": RulePlanner()}, cases, repeats=21)
