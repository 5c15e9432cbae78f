"""Read-only SQL policy on Catalyst plans.

The parsed plan shows what a statement is and names; the analyzed plan shows which columns of which tables it reads. Node
classes are allow-listed, so a statement kind that nobody thought of is refused.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Plan nodes a query may have; functions that reach outside the data.
ALLOWED = frozenset("Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith OneRowRelation UnresolvedInlineTable UnresolvedHaving Offset Window LateralJoin Pivot Unpivot Generate WithWindowDefinition UnresolvedSetOperation".split())
DANGEROUS = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length read_files load_extension pg_read_file lo_import dblink version current_user session_user user".split())
#: Expressions that hold a plan; the predicate IN (...) itself holds a ListQuery.
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery".split())


class PolicyError(ValueError):
    """The first word of the message is the violated rule."""


@dataclass(frozen=True)
class Policy:
    tables: dict[str, frozenset[str] | None] = field(default_factory=dict)  # allowed columns; None: all
    functions: frozenset[str] = frozenset()
    max_tables: int | None = None
    max_joins: int | None = None
    max_limit: int | None = None
    require_limit: bool = False
    allow_cross_join: bool = False

    def check(self, known: dict[str, set[str]]) -> list[str]:
        """V-09: names the policy has and the catalogue lacks."""
        out = [f"unknown_table {t}" for t in self.tables if t not in known]
        out += [f"unknown_column {t}.{c}" for t, cs in self.tables.items() if t in known for c in sorted(cs or ()) if c not in known[t]]
        return out + (["limit_without_max"] if self.require_limit and self.max_limit is None else [])


def _each(seq) -> Iterator:  # noqa: ANN001
    for i in range(seq.size()):
        yield seq.apply(i)


def nodes(plan) -> Iterator:  # noqa: ANN001
    """All plan nodes, once each; a node's inner children are its CTEs and the plans of its subqueries."""
    yield plan
    for x in _each(plan.children()):
        yield from nodes(x)
    for x in _each(plan.innerChildren()):
        if hasattr(x, "children") and x.getClass().getName().startswith("org.apache.spark.sql.catalyst") and ".plans." in x.getClass().getName():
            yield from nodes(x)


def expressions(e) -> Iterator:  # noqa: ANN001
    yield e
    for x in _each(e.children()):
        yield from expressions(x)


def kind(node) -> str:  # noqa: ANN001
    return node.getClass().getSimpleName()


def judge(spark: SparkSession, sql: str, policy: Policy) -> list[str]:
    """Every violation of the statement, by rule name; none means it may run."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(sql)
    except Exception as e:  # the parser's refusal is the finding
        return [f"parse_error {str(e).splitlines()[0][:120]}"]
    found, every = [], list(nodes(plan))
    ctes = set()
    for n in every:
        k = kind(n)
        if k not in ALLOWED:
            found.append(f"forbidden_node {k}")
        if k == "UnresolvedWith":
            if n.allowRecursion():
                found.append("recursive_cte")
            ctes |= {pair._1() for pair in _each(n.cteRelations())}
    tables, joins, limits = [], 0, []
    for n in every:
        k = kind(n)
        if k == "UnresolvedRelation":
            parts = list(_each(n.multipartIdentifier()))
            if len(parts) > 1:
                found.append(f"table_scope {'.'.join(parts)}")
            elif parts[0] not in ctes:
                tables.append(parts[0])
                if policy.tables and parts[0] not in policy.tables:
                    found.append(f"table_scope {parts[0]}")
        elif k == "Join":
            joins += 1
            if not policy.allow_cross_join and (str(n.joinType()) == "Cross" or n.condition().isEmpty()) and "Using" not in str(n.joinType()) and "Natural" not in str(n.joinType()):
                found.append("cross_join")
        elif k == "GlobalLimit":
            limits.append(str(n.limitExpr()))
        for e in _each(n.expressions()):
            for x in expressions(e):
                if kind(x) == "UnresolvedFunction" and (name := list(_each(x.nameParts()))[-1].lower()) in DANGEROUS | policy.functions:
                    found.append(f"dangerous_function {name}")
    if policy.max_tables is not None and len(set(tables)) > policy.max_tables:
        found.append("max_tables")
    if policy.max_joins is not None and joins > policy.max_joins:
        found.append("max_joins")
    scalar = kind(plan) in ("Project", "Aggregate") and not any(kind(n) == "Aggregate" for n in every[1:]) and _only_aggregates(plan)
    if policy.require_limit and not limits and not scalar:
        found.append("unbounded_result")
    if policy.max_limit is not None:
        found += ["limit" for x in limits if not x.isdigit() or not 0 < int(x) <= policy.max_limit]
    if not found and policy.tables:
        found += columns_outside(spark, sql, policy)
    return found


def _only_aggregates(plan) -> bool:  # noqa: ANN001
    """Whether the root returns one row by construction: aggregate functions without grouping."""
    names = frozenset("count sum avg min max".split())
    es = list(_each(plan.expressions()))
    return bool(es) and all(any(kind(x) == "UnresolvedFunction" and list(_each(x.nameParts()))[-1].lower() in names for x in expressions(e)) for e in es) and not kind(plan) == "Aggregate"


def columns_read(spark: SparkSession, sql: str) -> dict[str, set[str]]:
    """V-06, V-14: by table, the columns that the optimized plan's scans still need."""
    analyzed = spark.sql(sql)._jdf.queryExecution().analyzed()
    leaves: dict[int, tuple[str, str]] = {}

    def alias(n) -> None:  # noqa: ANN001
        if kind(n) == "SubqueryAlias" and kind(n.child()) == "View":
            for a in _each(n.output()):
                leaves[a.exprId().id()] = (str(n.alias()), a.name())
        for x in _each(n.children()):
            alias(x)
        for e in _each(n.expressions()):
            for x in expressions(e):
                if kind(x) in SUBQUERIES:
                    alias(x.plan())

    alias(analyzed)
    out: dict[str, set[str]] = {}

    def uses(n, inside: bool) -> None:  # noqa: ANN001
        inside = inside or kind(n) == "View"
        if not inside:
            for e in _each(n.expressions()):
                for x in expressions(e):
                    if kind(x) == "AttributeReference" and x.exprId().id() in leaves:
                        t, c = leaves[x.exprId().id()]
                        out.setdefault(t, set()).add(c)
                    elif kind(x) in SUBQUERIES:
                        uses(x.plan(), False)
        for x in _each(n.children()):
            uses(x, inside)

    uses(analyzed, False)
    for a in _each(analyzed.output()):
        if a.exprId().id() in leaves:
            t, c = leaves[a.exprId().id()]
            out.setdefault(t, set()).add(c)
    return out


def columns_outside(spark: SparkSession, sql: str, policy: Policy) -> list[str]:
    return [f"column_scope {t}.{c}" for t, cs in sorted(columns_read(spark, sql).items()) for c in sorted(cs) if policy.tables.get(t) is not None and c not in policy.tables[t]]


def unknown_objects(spark: SparkSession, sql: str) -> list[str]:
    """Tables of a statement that don't exist; names of its CTEs are its own."""
    every = list(nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    ctes = {pair._1() for n in every if kind(n) == "UnresolvedWith" for pair in _each(n.cteRelations())}
    names = {".".join(_each(n.multipartIdentifier())) for n in every if kind(n) == "UnresolvedRelation"} - ctes
    return [f"unknown_object {n}" for n in sorted(names) if not spark.catalog.tableExists(n)]


def run(spark: SparkSession, sql: str, policy: Policy, bound: int = 10_000, deadline: float | None = None, capability=None) -> dict:  # noqa: ANN001
    """S-18, S-20: the backend's capability (see catalogue.Capability), the policy, the objects, then at most `bound` rows with truncation evidence; a deadline interrupts the statement's own jobs."""
    bound = min(bound, 10_000)
    if capability is not None:
        capability.require(sql)
    if found := judge(spark, sql, policy) or unknown_objects(spark, sql):
        raise PolicyError("; ".join(found))
    df = spark.sql(sql)
    tag = f"tessel-{threading.get_ident()}-{id(df)}"
    spark.addTag(tag)
    timer = threading.Timer(deadline, spark.interruptTag, (tag,)) if deadline else None
    try:
        if timer:
            timer.start()
        rows = df.limit(bound + 1).collect()
    finally:
        if timer:
            timer.cancel()
            timer.join()
        spark.removeTag(tag)
    return {"columns": df.columns, "rows": [list(r) for r in rows[:bound]], "row_count": min(len(rows), bound), "truncated": len(rows) > bound, "fetched_row_count": len(rows)}


def preview(spark: SparkSession, sql: str, policy: Policy, limit: int = 100) -> dict:
    """S-17: the policy sees the statement as written; only a missing limit is forgiven."""
    if found := [x for x in judge(spark, sql, policy) if x != "unbounded_result"]:
        raise PolicyError("; ".join(found))
    return run(spark, f"select * from ({sql.rstrip().rstrip(';')}) limit {min(limit, 100)}", Policy(), min(limit, 100))


def explain(spark: SparkSession, sql: str, policy: Policy) -> str:
    """S-19."""
    if found := judge(spark, sql, policy):
        raise PolicyError("; ".join(found))
    return spark.sql(sql)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def signature(spark: SparkSession, sql: str) -> str:
    """F-05: the canonical plan; equal for statements that differ only in names of aliases or in case."""
    import hashlib

    return hashlib.sha256(spark.sql(sql)._jdf.queryExecution().normalized().canonicalized().toString().encode()).hexdigest()


def visible(df: DataFrame, table: str, policy: Policy) -> list[tuple[str, str, bool]]:
    """S-12 to S-14: (name, logical type, nullable) of the columns that the policy shows."""
    from tessel.functions.scalars import logical_type

    own = policy.tables.get(table) if policy.tables else None
    if policy.tables and table not in policy.tables:
        raise PolicyError(f"table_scope {table}")
    return [(f.name, logical_type(f.dataType), f.nullable) for f in df.schema.fields if own is None or f.name in own]
