"""The SQL-free query plan: intents, the contract that a plan must meet, and the compiler to trusted SQL."""

from __future__ import annotations

import copy
import json
import math
import re
from dataclasses import dataclass
from datetime import date, timedelta

from gristmill.catalog import AS_OF, ENTITIES


class PlanError(ValueError):
    """A plan outside the contract."""


@dataclass(frozen=True)
class Intent:
    """What an intent measures, shows and needs. sql None: the plan abstains."""

    metrics: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    view: str | None = None
    sql: str | None = None
    dated: bool = False
    scenario: bool = False
    horizon: range | None = None
    reported: str | None = None


# The contract of each intent.
INTENTS = {
    "supplier_delay": Intent(
        ("late_delivery_rate",), ("supplier_id",), ("supplier_id", "late_shipments", "evaluable_shipments", "late_delivery_rate"), (), "shipment_view",
        """SELECT supplier_id, supplier_name, count(is_late) AS evaluable_shipments, sum(CASE WHEN is_late THEN 1 ELSE 0 END) AS late_shipments,
 avg(CASE WHEN is_late THEN 1.0D WHEN NOT is_late THEN 0.0D END) AS late_delivery_rate FROM shipment_view
 WHERE promised_date >= :start_date AND promised_date < :end_date GROUP BY supplier_id, supplier_name
 HAVING count(is_late) > 0 ORDER BY late_delivery_rate DESC, supplier_id""", dated=True,
    ),
    "stockout": Intent(("days_of_cover",), ("product_id", "warehouse_id"), ("source_record_id", "on_hand", "avg_daily_demand", "days_of_cover"), (), "risk_view",
        "SELECT * FROM risk_view WHERE days_of_cover < :horizon ORDER BY days_of_cover, product_id, warehouse_id", horizon=range(1, 91)),
    "forecast": Intent(("units",), ("demand_date",), ("source_record_id", "demand_date", "units"), ("product_id", "warehouse_id"), "demand_view",
        "SELECT * FROM demand_view WHERE product_id = :product AND warehouse_id = :warehouse ORDER BY demand_date", horizon=range(14, 15)),
    "supplier_risk": Intent(("supplier_reliability",), ("supplier_id",), ("source_record_id", "late_delivery_rate", "evaluable_shipments"), ("supplier_id",), "supplier_view",
        "SELECT * FROM supplier_view WHERE supplier_id = :supplier"),
    "what_if": Intent(("scenario_days_of_cover",), ("product_id", "warehouse_id"), ("source_record_id", "on_hand", "avg_daily_demand"), ("warehouse_id",), "risk_view",
        "SELECT *, avg_daily_demand * (1 + :increase) AS scenario_daily_demand, days_of_cover / (1 + :increase) AS scenario_days_of_cover FROM risk_view WHERE warehouse_id = :warehouse", scenario=True),
    "shipments": Intent(("delay_days",), ("shipment_id",), ("source_record_id", "promised_date", "delivered_date"), ("supplier_id",), "shipment_view",
        "SELECT * FROM shipment_view WHERE supplier_id = :supplier"),
    "missing_dates": Intent(("missing_promised_date",), ("shipment_id",), ("source_record_id", "promised_date"), (), "shipment_view",
        "SELECT * FROM shipment_view WHERE promised_date IS NULL", reported="shipments"),
    "unsupported": Intent(),
    "unsafe": Intent(),
}
KEYS = ("intent", "entities", "time_range", "metrics", "group_by", "scenario", "horizon_days", "evidence_requirements", "abstain")
_LISTS = {"metrics": "metrics", "group_by": "group_by", "evidence_requirements": "evidence"}
_FENCE = re.compile(r"```(?:json)?[ \t]*\r?\n(.*?)\r?\n```", re.S)


def canonical_entity(kind: str, value: str | None) -> str | None:
    """The id behind a spelling; PlanError for an unknown one."""
    if value is None:
        return None
    found = ENTITIES[kind].get(value.strip().casefold())
    if found is None:
        raise PlanError(f"unknown {kind}: {value}")
    return found


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise PlanError("a JSON field occurs twice")
    return found


def parse_output(value):
    """A planner's output as plain data: JSON text of at most 12,000 characters, in at most one fence, or an object."""
    if isinstance(value, str):
        if len(value) > 12_000:
            raise PlanError("the plan exceeds 12,000 characters")
        text = value.strip()
        if text.startswith("```"):
            fenced = _FENCE.fullmatch(text)
            if not fenced:
                raise PlanError("one JSON object in one fence is expected")
            text = fenced[1]
        value = json.loads(text, object_pairs_hook=_once)
    json.dumps(value, allow_nan=False)
    return copy.deepcopy(value)


def make_plan(intent: str = "unsupported", **given) -> dict:
    """The empty plan of an intent, with the given fields."""
    spec = INTENTS[intent]
    plan = {
        "intent": intent, "entities": dict.fromkeys(ENTITIES), "time_range": None, "metrics": sorted(spec.metrics), "group_by": sorted(spec.group_by),
        "scenario": None, "horizon_days": None, "evidence_requirements": sorted(spec.evidence), "abstain": spec.sql is None,
    }
    return plan | given


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise PlanError(message)


def _exact(value, keys, what: str) -> dict:
    _need(isinstance(value, dict) and set(value) == set(keys), f"{what} needs exactly the fields {', '.join(keys)}")
    return value


def _day(value) -> date:
    _need(isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) is not None, "dates are YYYY-MM-DD")
    try:
        return date.fromisoformat(value)
    except ValueError as e:
        raise PlanError(str(e)) from e


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def validate(value, question: str | None = None, as_of: str = AS_OF) -> dict:
    """The plan in canonical form, or PlanError; with a question, it must equal the plan that the question has by itself."""
    plan = _exact(parse_output(value), KEYS, "a plan")
    intent = plan["intent"]
    _need(isinstance(intent, str) and intent in INTENTS, "unknown intent")
    spec = INTENTS[intent]
    for kind, name in _exact(plan["entities"], ENTITIES, "entities").items():
        _need(name is None or (isinstance(name, str) and len(name) <= 64), f"{kind} is a name or null")
        plan["entities"][kind] = canonical_entity(kind, name)
    _need({k for k, v in plan["entities"].items() if v is not None} == set(spec.entities), f"{intent} needs exactly the entities {', '.join(spec.entities) or 'none'}")
    for field, attribute in _LISTS.items():
        given = plan[field]
        _need(isinstance(given, list) and all(isinstance(x, str) for x in given) and len(set(given)) == len(given), f"{field} is a list of distinct names")
        _need(set(given) == set(getattr(spec, attribute)), f"{intent} needs exactly these {field}: {', '.join(getattr(spec, attribute))}")
        plan[field] = sorted(given)
    _need(isinstance(plan["abstain"], bool) and plan["abstain"] == (spec.sql is None), "a plan abstains exactly if it is unsafe or unsupported")
    _need((plan["time_range"] is not None) == spec.dated, f"{intent} {'needs' if spec.dated else 'takes no'} date range")
    if spec.dated:
        span = _exact(plan["time_range"], ("start", "end"), "a date range")
        start, end = _day(span["start"]), _day(span["end"])
        _need(start < end <= date.fromisoformat(as_of) + timedelta(days=1), "a date range is half-open, not empty and not in the future")
    _need((plan["scenario"] is not None) == spec.scenario, f"{intent} {'needs' if spec.scenario else 'takes no'} scenario")
    if spec.scenario:
        rise = _exact(plan["scenario"], ("demand_increase",), "a scenario")["demand_increase"]
        _need(_is_number(rise) and 0 <= rise <= 2, "demand_increase is a fraction from 0 to 2")
    days = plan["horizon_days"]
    if spec.horizon is None:
        _need(days is None, f"{intent} takes no horizon")
    else:
        _need(_is_number(days) and days == int(days) and int(days) in spec.horizon, f"{intent} needs a horizon of {spec.horizon.start} to {spec.horizon.stop - 1} days")
        plan["horizon_days"] = int(days)
    if question is not None:
        from gristmill.plans.grammar import request_plan

        _need(plan == request_plan(question, as_of), "the plan differs from what the question asks")
    return plan


@dataclass(frozen=True)
class CompiledPlan:
    intent: str
    view: str | None
    sql: str | None
    parameters: dict
    evidence_fields: list[str]
    needs_clarification: bool
    abstain: bool

    def as_dict(self) -> dict:
        return copy.deepcopy(self.__dict__)


def check_compiled(value) -> dict:
    """The seven-field contract of a compiled plan."""
    value = parse_output(value)
    _exact(value, tuple(CompiledPlan.__dataclass_fields__), "a compiled plan")
    _need(value["intent"] in INTENTS and value["intent"] != "missing_dates", "unknown intent")
    _need(isinstance(value["needs_clarification"], bool) and isinstance(value["abstain"], bool), "flags are booleans")
    silent = value["abstain"] or value["needs_clarification"]
    _need(silent or INTENTS[value["intent"]].sql is not None, "an unsafe or unsupported intent must abstain")
    parameters = value["parameters"]
    _need(isinstance(parameters, dict) and len(parameters) <= 10 and all(re.fullmatch(r"[a-z][a-z0-9_]*", k) for k in parameters), "parameters are at most ten named values")
    _need(all(v is None or isinstance(v, (str, bool)) or _is_number(v) for v in parameters.values()), "parameters are scalars")
    _need(isinstance(value["evidence_fields"], list) and len(value["evidence_fields"]) <= 30 and all(isinstance(x, str) for x in value["evidence_fields"]), "evidence fields are at most thirty names")
    if silent:
        _need(value["sql"] is None and not parameters, "a silent plan carries no SQL")
    else:
        _need(value["view"] in {s.view for s in INTENTS.values() if s.view} and isinstance(value["sql"], str) and 0 < len(value["sql"]) <= 12_000, "a plan needs a view and SQL")
    return value


def compile_plan(value, as_of: str = AS_OF) -> CompiledPlan:
    """Literal templates with bound parameters; nothing of the plan enters the SQL text."""
    plan = validate(value, as_of=as_of)
    intent, spec = plan["intent"], INTENTS[plan["intent"]]
    if spec.sql is None:
        return CompiledPlan(intent, None, None, {}, [], intent == "unsupported", True)
    span, scenario = plan["time_range"] or {}, plan["scenario"] or {}
    slots = {
        "start_date": span.get("start"), "end_date": span.get("end"), "horizon": plan["horizon_days"], "increase": scenario.get("demand_increase"),
        "product": plan["entities"]["product_id"], "warehouse": plan["entities"]["warehouse_id"], "supplier": plan["entities"]["supplier_id"],
    }
    named = set(re.findall(r":([a-z_]+)", spec.sql))
    return CompiledPlan(spec.reported or intent, spec.view, spec.sql, {k: slots[k] for k in slots if k in named}, plan["evidence_requirements"], False, False)
