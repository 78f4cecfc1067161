"""The application boundary: questions, analysis, proposals and the audit of all of them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gristmill.audit import ActionGate, AuditLog
from gristmill.functions import risk
from gristmill.functions.evidence import forecast_from_result, recommend
from gristmill.functions.whatif import scenario
from gristmill.plans.query_plan import check_compiled
from gristmill.service import ask
from gristmill.sources.store import open_store

RISK_OF = {"stockout": "stockout", "supplier_risk": "supplier_reliability", "shipments": "late_delivery"}
ANALYSIS = ("risks", "forecast", "what_if", "recommendations")


class Console:
    """One store, its audit log and its gate. Risk models are fitted when first needed."""

    def __init__(self, spark: SparkSession, store: str, planner=None, retriever=None):
        self.spark, self.planner, self.retriever = spark, planner, retriever
        open_store(spark, store)
        self.audit = AuditLog(spark, f"{store.rstrip('/')}/audit_log")
        self.gate = ActionGate(self.audit)
        self.models: dict[str, risk.Model] = {}

    def question(self, text, timeout: float = 30.0) -> dict:
        """The record of a question. Every question is audited, and the analysis of every answered one."""
        record = ask(self.spark, text, self.planner, self.retriever, timeout)
        self.audit.append("query", record)
        if record["status"] == "ok":
            try:
                record |= self.analysis(record)
            except (KeyError, TypeError, ValueError) as e:
                record.update(status="missing_information", abstained=True, failure_behavior=f"Analysis inputs are invalid or incomplete ({type(e).__name__}): {e}. No recommendation was made.")
            self.audit.append("analysis", record)
        return record

    def analysis(self, record: dict) -> dict:
        """Risks, forecast or scenarios of an answer, with recommendations; all of it or an error."""
        compiled, result = check_compiled(record["compiled_plan"]), record["query_result"]
        intent, rows = compiled["intent"], result["rows"]
        if intent in RISK_OF:
            model = self.models.setdefault(RISK_OF[intent], None) or risk.fit(RISK_OF[intent])
            self.models[RISK_OF[intent]] = model
            risks = [risk.assess_row(model, r) for r in rows]
            return {"risks": risks, "recommendations": [recommend(result, r) for r in risks]}
        if intent == "forecast":
            made = forecast_from_result(result)
            return {"forecast": made, "recommendations": [recommend(result, forecast=made)]}
        out: dict = {"recommendations": [recommend(result)]}
        if intent == "what_if":
            out["what_if"] = [scenario(r, compiled["parameters"]["increase"]) for r in rows]
        return out
