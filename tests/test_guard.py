"""The SQL dialect: what passes, what is refused, and execution under it."""

import pytest

from gristmill.executor import execute
from gristmill.functions.evidence import evidence_id
from gristmill.plans.guard import SQLBlocked, colon_parameters, guard, guarded_frame

ACCEPTED = [
    ("SELECT * FROM risk_view", None),
    ("select supplier_id, count(*) AS n from shipment_view where delay_days between 1 and 3 and supplier_id in ('S1','S2') group by supplier_id having count(*) > 0 order by n desc", None),
    ("SELECT DISTINCT supplier_id FROM shipment_view", None),
    ("SELECT r.product_id, s.supplier_name FROM risk_view r LEFT JOIN supplier_view s ON r.supplier_id = s.supplier_id", None),
    ("SELECT count(DISTINCT supplier_id) AS c, round(avg(delay_days), 2) AS a, if(max(delay_days) > 1, 1, 0) AS b, try_cast('x' AS int) AS t FROM shipment_view", None),
    ("SELECT CASE WHEN is_late THEN 1 ELSE 0 END AS k FROM shipment_view WHERE shipment_id LIKE 'SH1%' AND promised_date IS NOT NULL", None),
    ("SELECT * FROM supplier_view WHERE supplier_id = $s", {"s": "S1"}),
]
REFUSED = """DELETE FROM shipment_view
DROP TABLE suppliers
INSERT INTO suppliers VALUES (1)
UPDATE suppliers SET supplier_id = 'x'
CREATE VIEW x AS SELECT 1
SET x = 1
EXPLAIN SELECT * FROM risk_view
EXECUTE IMMEDIATE 'SELECT 1'
SELECT 1
VALUES (1)
TABLE risk_view
SELECT * FROM suppliers
SELECT * FROM parquet.`/etc/x`
SELECT * FROM default.risk_view
SELECT * FROM range(5)
SELECT * FROM risk_view; SELECT * FROM risk_view
SELECT * FROM risk_view UNION SELECT * FROM risk_view
WITH a AS (SELECT * FROM risk_view) SELECT * FROM a
SELECT * FROM (SELECT * FROM risk_view)
SELECT (SELECT 1) FROM risk_view
SELECT * FROM risk_view WHERE EXISTS (SELECT 1 FROM risk_view)
SELECT * FROM risk_view WHERE product_id IN (SELECT product_id FROM risk_view)
SELECT * FROM risk_view, supplier_view
SELECT * FROM risk_view CROSS JOIN supplier_view
SELECT * FROM risk_view r JOIN supplier_view s ON r.supplier_id > s.supplier_id
SELECT * FROM risk_view r JOIN supplier_view s ON r.supplier_id = s.supplier_id AND 1 = 1
SELECT * FROM risk_view r JOIN supplier_view s USING (supplier_id)
SELECT * FROM risk_view r NATURAL JOIN supplier_view s
SELECT * FROM risk_view r JOIN shipment_view s ON r.warehouse_id = s.warehouse_id
SELECT upper(product_id) FROM risk_view
SELECT reflect('java.lang.System', 'exit', 1) FROM risk_view
SELECT transform(array(1), x -> x) FROM risk_view
SELECT TRANSFORM(product_id) USING 'cat' AS x FROM risk_view
SELECT * FROM risk_view LIMIT 5 OFFSET 2
SELECT * FROM risk_view LIMIT 1 + 1
SELECT * FROM risk_view TABLESAMPLE (5 ROWS)
SELECT * FROM risk_view LATERAL VIEW explode(array(1)) t AS x
FROM risk_view |> SELECT *
SELECT * FROM risk_view |> LIMIT 2
SELECT /*+ BROADCAST(risk_view) */ * FROM risk_view
SELECT sum(on_hand) OVER () FROM risk_view
SELECT product_id, count(*) AS c FROM risk_view GROUP BY ROLLUP(product_id)
SELECT * FROM supplier_view PIVOT (max(lead_time_days) FOR supplier_id IN ('S1'))
SELECT nope FROM risk_view
SELECT current_date FROM risk_view
SELECT current_user FROM risk_view
SELECT * FROM risk_view WHERE product_id = $p
SELECT product_id AS a, on_hand AS a FROM risk_view
not sql at all""".split("\n")


@pytest.mark.parametrize("sql,parameters", ACCEPTED)
def test_accepted(spark, store, sql, parameters):
    assert guarded_frame(spark, sql, parameters).count() > 0


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, store, sql):
    with pytest.raises(SQLBlocked):
        guarded_frame(spark, sql)


@pytest.mark.parametrize("sql,parameters,limit", [("", None, 200), (" ", None, 200), ("SELECT * FROM risk_view -- " + "x" * 12_000, None, 200), ("SELECT * FROM risk_view", {"extra": 1}, 200), ("SELECT * FROM risk_view", None, 0), ("SELECT * FROM risk_view", None, 201), (None, None, 5)])
def test_bounds(spark, store, sql, parameters, limit):
    with pytest.raises(SQLBlocked):
        guard(spark, sql, parameters, limit)


def test_limits(spark, store):
    assert guard(spark, "SELECT * FROM demand_view").limit == 200
    assert guard(spark, "SELECT * FROM demand_view LIMIT 9999").limit == 200
    assert guard(spark, "SELECT * FROM demand_view LIMIT 7").limit == 7
    full = execute(spark, "SELECT * FROM demand_view LIMIT 9999", timeout=60)
    assert (len(full.rows), full.truncated, full.status) == (200, True, "ok")


def test_placeholders_outside_quotes():
    assert colon_parameters("SELECT '$a', \"$b\", `$c` FROM t WHERE x = $d -- $e") == "SELECT '$a', \"$b\", `$c` FROM t WHERE x = :d -- $e"


def test_injection_stays_data(spark, store):
    found = execute(spark, "SELECT * FROM supplier_view WHERE supplier_id = $s", {"s": "S1' OR 1 = 1 --"}, timeout=60)
    assert (found.status, found.rows) == ("empty", [])


def test_evidence_and_deadline(spark, store):
    found = execute(spark, "SELECT * FROM supplier_view ORDER BY supplier_id", timeout=60)
    assert found.evidence_id == evidence_id(found.sql, found.parameters, found.rows)
    assert isinstance(found.rows[0]["record_timestamp"], str)
    assert execute(spark, "SELECT * FROM risk_view", timeout=0).status == "timeout"
    assert execute(spark, "SELECT * FROM risk_view", timeout=0.001).status == "timeout"


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT product_id, sum(on_hand) OVER (PARTITION BY product_id) AS s FROM risk_view",
        "SELECT product_id, sum(on_hand) OVER (ORDER BY product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM risk_view",
        "SELECT product_id, count(*) AS c FROM risk_view GROUP BY ROLLUP(product_id)",
        "SELECT product_id, warehouse_id, count(*) AS c FROM risk_view GROUP BY CUBE(product_id, warehouse_id)",
        "SELECT product_id, warehouse_id, count(*) AS c FROM risk_view GROUP BY GROUPING SETS ((product_id), (warehouse_id))",
    ],
)
def test_analytic_statements_only_on_request(spark, store, sql):
    with pytest.raises(SQLBlocked):
        guarded_frame(spark, sql)
    assert guarded_frame(spark, sql, analytic=True).count() > 0


def test_analytic_statements_stay_inside_the_dialect(spark, store):
    for sql in ("SELECT row_number() OVER (ORDER BY product_id) AS r FROM risk_view", "SELECT sum(on_hand) OVER (ORDER BY upper(product_id)) AS s FROM risk_view"):
        with pytest.raises(SQLBlocked):
            guarded_frame(spark, sql, analytic=True)
