"""Guarded execution: a deadline, a row cap, and a content hash of what came back."""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict, dataclass
from decimal import Decimal

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from gristmill.catalog import DEADLINE_SECONDS, ROW_LIMIT
from gristmill.functions.evidence import evidence_id
from gristmill.plans.guard import SQLBlocked, guard, guarded_frame


@dataclass
class QueryResult:
    status: str
    rows: list
    sql: str
    parameters: dict
    elapsed_ms: float
    explanation: str
    evidence_id: str = ""
    truncated: bool = False

    def as_dict(self) -> dict:
        return asdict(self)


def frozen(rows: list) -> list[dict]:
    """Collected rows as JSON data: dates as text, decimals as numbers, NaN refused."""
    plain = lambda v: float(v) if isinstance(v, Decimal) else str(v)
    return json.loads(json.dumps([r.asDict() for r in rows], default=plain, allow_nan=False))


def execute(spark: SparkSession, sql: str, parameters: dict | None = None, timeout: float = DEADLINE_SECONDS, row_limit: int = ROW_LIMIT) -> QueryResult:
    """Runs a guarded statement as a tagged job in a thread of its own, and cancels the job at the deadline.

    SQLBlocked is raised before anything runs. A result of exactly the limit counts as truncated.
    """
    started = time.perf_counter()
    checked = guard(spark, sql, parameters, row_limit)
    elapsed = lambda: (time.perf_counter() - started) * 1000
    if timeout <= 0:
        return QueryResult("timeout", [], checked.sql, checked.parameters, elapsed(), "The deadline passed before execution.")
    tag, box, done = f"query-{uuid.uuid4().hex}", {}, threading.Event()

    def work() -> None:
        try:
            spark.sparkContext.addJobTag(tag)
            box["rows"] = frozen(guarded_frame(spark, sql, parameters, row_limit).collect())
        except Exception as e:
            box["error"] = e
        finally:
            done.set()

    InheritableThread(target=work, daemon=True).start()
    if not done.wait(timeout):
        spark.sparkContext.cancelJobsWithTag(tag)
        return QueryResult("timeout", [], checked.sql, checked.parameters, elapsed(), "The query passed its deadline and was cancelled.")
    if isinstance(box.get("error"), SQLBlocked):
        raise box["error"]
    if "error" in box:
        return QueryResult("error", [], checked.sql, checked.parameters, elapsed(), f"{type(box['error']).__name__}: {str(box['error'])[:500]}")
    rows = box["rows"]
    explanation = "Verified read-only result." if rows else "No matching records; nothing was inferred."
    return QueryResult("ok" if rows else "empty", rows, checked.sql, checked.parameters, elapsed(), explanation, evidence_id(checked.sql, checked.parameters, rows), len(rows) == checked.limit)
