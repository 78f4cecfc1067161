"""A fail-closed, read-only SQL dialect, checked on Catalyst's parsed plan.

The statement is parsed by Spark itself, and every plan node and expression must be on an allow list:
anything the parser knows and the list does not is refused. Only the four views may be read, joins are
single equalities in the join catalog, and results are capped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gristmill.catalog import JOINS, ROW_LIMIT, VIEWS

MAX_CHARS, MAX_TABLES = 12_000, 3
# The dialect's functions, plan nodes and expressions.
FUNCTIONS = {"sum", "avg", "count", "min", "max", "coalesce", "nullif", "cast", "try_cast", "if", "round", "abs", "between"}
NODES = {"Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Join", "SubqueryAlias", "UnresolvedRelation"}
ROOTS = {"Project", "Aggregate", "UnresolvedHaving"}
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "Alias", "UnresolvedFunction", "Literal", "Cast", "CaseWhen", "If", "Coalesce", "NullIf",
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Between", "In", "Like", "IsNull", "IsNotNull", "IsTrue", "IsFalse",
    "Add", "Subtract", "Multiply", "Divide", "Remainder", "UnaryMinus", "UnaryPositive", "SortOrder", "NamedParameter", "UnresolvedOrdinal",
}
#: Allowed only where the caller asks for analytic statements: aggregates over windows, and grouping sets.
ANALYTIC = {
    "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame", "UnboundedPreceding", "UnboundedFollowing", "CurrentRow",
    "Rollup", "Cube", "GroupingSets",
}
JOIN_KINDS = {"Inner", "LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti"}
_PAIRS = {frozenset(pair) for pair in JOINS}
#: Quoted text, quoted identifiers, comments, or a $name to rewrite.
_LEXEME = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$([A-Za-z_]\w*)", re.S)


class SQLBlocked(ValueError):
    """The statement is outside the dialect."""


@dataclass(frozen=True)
class GuardedSQL:
    sql: str
    parameters: dict
    limit: int


def colon_parameters(sql: str) -> str:
    """$name placeholders as Spark's :name, outside quotes and comments."""
    return _LEXEME.sub(lambda m: f":{m[1]}" if m[1] else m[0], sql)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self, expressions: set[str] = EXPRESSIONS):
        self.allowed = expressions
        self.tables: dict[str, str] = {}  # alias to view
        self.relations = 0
        self.parameters: set[str] = set()
        self.joins: list[tuple[list[str], list[str]]] = []
        self.limit: int | None = None
        self.columns: set[str] = set()
        self.aliases: set[str] = set()

    def statement(self, plan) -> None:
        """Limit, sort and distinct may stand above the root, in this order."""
        node = plan
        if _name(node) == "GlobalLimit":
            self.limit = self.row_count(node.limitExpr())
            node = node.child()
            if _name(node) == "LocalLimit":
                node = node.child()
        for wrapper in ("Sort", "Distinct"):
            if _name(node) == wrapper:
                self.expressions(node)
                node = node.child()
        if _name(node) not in ROOTS:
            raise SQLBlocked(f"a SELECT is required, not {_name(node)}")
        self.plan(node)

    @staticmethod
    def row_count(expr) -> int:
        text = expr.toString()
        if _name(expr) != "Literal" or not re.fullmatch(r"\d+", text):
            raise SQLBlocked("LIMIT must be a non-negative integer literal")
        return int(text)

    def plan(self, node) -> None:
        kind = _name(node)
        if kind not in NODES or kind in ("GlobalLimit", "LocalLimit", "Distinct"):
            raise SQLBlocked(f"{kind} is not allowed here")
        if kind == "UnresolvedRelation":
            self.relation(node, None)
            return
        if kind == "SubqueryAlias":
            if _name(node.child()) != "UnresolvedRelation":
                raise SQLBlocked("subqueries are not allowed")
            self.relation(node.child(), node.alias())
            return
        if kind == "Join":
            self.join(node)
        self.expressions(node)
        for child in _items(node.children()):
            if kind in ("Project", "Aggregate", "Filter", "Join") and _name(child) in ("Project", "Aggregate", "UnresolvedHaving", "Sort"):
                raise SQLBlocked("one SELECT is allowed")
            self.plan(child)

    def relation(self, node, alias: str | None) -> None:
        parts = _items(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in VIEWS:
            raise SQLBlocked(f"unknown table: {'.'.join(parts)}")
        self.relations += 1
        name = (alias or parts[0]).lower()
        if name in self.tables:
            raise SQLBlocked(f"{name} names two tables")
        self.tables[name] = parts[0].lower()

    def join(self, node) -> None:
        if _name(node.joinType()) not in JOIN_KINDS or node.condition().isEmpty():
            raise SQLBlocked("joins need ON with one equality of two columns")
        on = node.condition().get()
        sides = _items(on.children()) if _name(on) == "EqualTo" else []
        if len(sides) != 2 or any(_name(s) != "UnresolvedAttribute" for s in sides):
            raise SQLBlocked("joins need ON with one equality of two columns")
        self.joins.append(tuple(_items(s.nameParts()) for s in sides))

    def expressions(self, node) -> None:
        for expr in _items(node.expressions()):
            self.expression(expr)

    def expression(self, expr) -> None:
        kind = _name(expr)
        if kind not in self.allowed:
            raise SQLBlocked(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            parts = _items(expr.nameParts())
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise SQLBlocked(f"function {'.'.join(parts)} is not allowed")
        if kind == "UnresolvedAttribute":
            self.columns.add(_items(expr.nameParts())[-1].lower())
        if kind == "Alias":
            self.aliases.add(expr.name().lower())
        if kind == "NamedParameter":
            self.parameters.add(expr.name())
        for child in _items(expr.children()):
            self.expression(child)

    def check_columns(self) -> None:
        """Columns are the views' or the statement's own: a bare name like current_date would resolve to a function."""
        known = self.aliases.union(*(VIEWS[v] for v in self.tables.values()))
        if self.columns - known:
            raise SQLBlocked(f"unknown columns: {', '.join(sorted(self.columns - known))}")

    def check_joins(self) -> None:
        for sides in self.joins:
            full = set()
            for parts in sides:
                if len(parts) != 2 or parts[0].lower() not in self.tables:
                    raise SQLBlocked("join columns need their table's name or alias")
                full.add(f"{self.tables[parts[0].lower()]}.{parts[1].lower()}")
            if frozenset(full) not in _PAIRS:
                raise SQLBlocked(f"{' = '.join(sorted(full))} is not in the join catalog")


def guard(spark: SparkSession, sql: str, parameters: dict | None = None, row_limit: int = ROW_LIMIT, analytic: bool = False) -> GuardedSQL:
    """The statement with its parameters and effective limit, or SQLBlocked. analytic: windows and grouping sets pass too."""
    parameters = dict(parameters or {})
    if not isinstance(sql, str) or not sql.strip() or len(sql) > MAX_CHARS:
        raise SQLBlocked("SQL must be non-blank text of at most 12,000 characters")
    if not isinstance(row_limit, int) or isinstance(row_limit, bool) or not 1 <= row_limit <= ROW_LIMIT:
        raise SQLBlocked(f"the row limit must be 1 to {ROW_LIMIT}")
    try:
        text = colon_parameters(sql).strip().rstrip(";").rstrip()
        bare = _LEXEME.sub(" ", text).strip().lower()
        if not bare.startswith("select") or "|>" in bare:
            raise SQLBlocked("one SELECT statement is required")
        walk = _Walk(EXPRESSIONS | ANALYTIC if analytic else EXPRESSIONS)
        walk.statement(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
        if not 1 <= walk.relations <= MAX_TABLES:
            raise SQLBlocked(f"1 to {MAX_TABLES} tables are allowed")
        walk.check_columns()
        walk.check_joins()
        if walk.parameters != set(parameters):
            raise SQLBlocked("placeholders and parameters differ")
    except SQLBlocked:
        raise
    except Exception as e:  # a parser or bridge failure never lets a statement through
        raise SQLBlocked(f"SQL could not be checked: {type(e).__name__}") from e
    return GuardedSQL(text, parameters, row_limit if walk.limit is None else min(walk.limit, row_limit))


def guarded_frame(spark: SparkSession, sql: str, parameters: dict | None = None, row_limit: int = ROW_LIMIT, analytic: bool = False) -> DataFrame:
    """The capped result of a guarded statement. Unknown columns and doubled names are blocked too."""
    checked = guard(spark, sql, parameters, row_limit, analytic)
    try:
        df = spark.sql(checked.sql, args=checked.parameters or None)
    except Exception as e:
        raise SQLBlocked(f"SQL does not fit the views: {type(e).__name__}") from e
    if len(set(df.columns)) != len(df.columns):
        raise SQLBlocked("output columns need distinct names")
    return df.limit(checked.limit)
