"""Checks of a SQL text against table metadata before it runs, on Spark's own parsed and analysed plans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.sqltext import plain

#: Verbs that no text may hold as a word.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "COMMENT", "MERGE")
#: Groups of built-in functions that no text may call: they run code, read the session or its files, or raise errors.
OUTSIDE = frozenset(("misc_funcs", "table_funcs"))
#: Beginnings of the names of system tables.
SYSTEM = ("pg_", "information_schema", "mysql.", "performance_schema")


@dataclass
class Findings:
    """What a check found. severity: ok, warning or block."""

    sql: str
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    lineage: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return not self.errors

    @property
    def severity(self) -> str:
        return "block" if self.errors else "warning" if self.warnings else "ok"


class Blocked(Exception):
    """A text that may not run; .findings says why."""

    def __init__(self, findings: Findings):
        super().__init__("; ".join(findings.errors))
        self.findings = findings


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _nodes(plan) -> list:
    """All nodes of a plan, those in CTEs and subqueries too."""
    found, stack = [], [plan]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [*_each(node.children()), *[x for x in _each(node.innerChildren().toSeq()) if "plans.logical" in x.getClass().getName()]]
        for e in _each(node.expressions()):
            inner = [e]
            while inner:
                x = inner.pop()
                if x.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery") and hasattr(x, "plan"):
                    if x.getClass().getSimpleName() != "InSubquery":
                        stack.append(x.plan())
                inner += _each(x.children())
    return found


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _relations(plan) -> list[str]:
    names = [".".join(_each(n.multipartIdentifier())) for n in _nodes(plan) if _kind(n) == "UnresolvedRelation"]
    return sorted(set(names))


def _functions(spark: SparkSession, plan, allowed: set[str]) -> list[str]:
    """Functions that a plan may not call: what is no built-in, those of the groups OUTSIDE, and table functions other than
    generators, which only spread given values. allowed: names that may be called all the same."""
    jvm = spark._jvm
    builtin, name = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin(), jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def group(parts: list[str]) -> str:
        info = builtin.lookupFunction(name(parts[-1])) if len(parts) == 1 else None
        return info.get().getGroup() if info is not None and info.isDefined() else "none"

    called = {}
    for e in _expressions(plan):
        if _kind(e) in ("UnresolvedFunction", "UnresolvedGenerator"):
            own = _each(e.nameParts()) if _kind(e) == "UnresolvedFunction" else e.name().unquotedString().split(".")
            called[".".join(own)] = group(own)
    wrong = {n for n, g in called.items() if g == "none" or g in OUTSIDE}
    for node in _nodes(plan):
        if "TableValuedFunction" in _kind(node):
            own = _each(node.name())
            if group(own) != "generator_funcs":
                wrong.add(".".join(own))
    return sorted(n for n in wrong if n.lower() not in {a.lower() for a in allowed})


def _own_names(plan) -> set[str]:
    """Names of common table expressions."""
    return {_each(n.cteRelations())[i]._1().lower() for n in _nodes(plan) if _kind(n) == "UnresolvedWith" for i in range(n.cteRelations().size())}


def _stars(plan) -> bool:
    def star(e) -> bool:
        if _kind(e) == "UnresolvedFunction":
            return False  # count(*) and its like
        return _kind(e) in ("UnresolvedStar", "ResolvedStar") or any(star(x) for x in _each(e.children()))

    return any(star(e) for n in _nodes(plan) if _kind(n) in ("Project", "Aggregate") for e in _each(n.expressions()))


def _expressions(plan):
    """All expressions of a plan and of those within it."""
    for node in _nodes(plan):
        stack = list(_each(node.expressions()))
        while stack:
            e = stack.pop()
            yield e
            stack += _each(e.children())


def _closed_ranges(plan, columns: set[str]) -> set[str]:
    """Those of the columns that a comparison bounds from above with the bound itself: c <= x, x >= c, c BETWEEN."""
    def named(e) -> set[str]:
        own = {_each(e.nameParts())[-1].lower()} if _kind(e) == "UnresolvedAttribute" else set()
        return own.union(*(named(x) for x in _each(e.children())))

    found, wanted = set(), {c.lower() for c in columns}
    for e in _expressions(plan):
        kind = _kind(e)
        between = kind == "Between" or kind == "UnresolvedFunction" and _each(e.nameParts())[-1].lower() == "between"
        if kind == "LessThanOrEqual" or between:
            found |= named(_each(e.children())[0]) & wanted
        elif kind == "GreaterThanOrEqual":
            found |= named(_each(e.children())[1]) & wanted
    return found


def lineage(df: DataFrame) -> dict[str, set[tuple[str, str]]]:
    """Each column of a result and the (table, column) pairs that it is made from, read from the analysed plan."""
    known: dict[int, set[tuple[str, str]]] = {}

    def walk(node, name: str | None) -> None:
        kind = _kind(node)
        if kind == "SubqueryAlias":
            name = name if name and _kind(node.child()) == "SubqueryAlias" else node.identifier().name()
        below = _each(node.children())
        for x in below:
            walk(x, name if kind in ("SubqueryAlias", "View") else None)
        if kind == "View" and name:
            for a in _each(node.output()):
                known[a.exprId().id()] = {(name, a.name())}
            return
        if not below:
            for a in _each(node.output()):
                known.setdefault(a.exprId().id(), {(name, a.name())} if name else set())
        for e in _each(node.expressions()):
            stack = [e]
            while stack:
                x = stack.pop()
                if _kind(x) == "Alias":
                    made = known.setdefault(x.exprId().id(), set())
                    for a in _each(x.child().references().toSeq()):
                        made |= known.get(a.exprId().id(), set())
                stack += _each(x.children())
        if kind in ("Union", "Intersect", "Except"):
            for k, a in enumerate(_each(node.output())):
                known[a.exprId().id()] = set().union(*(known.get(_each(x.output())[k].exprId().id(), set()) for x in below))
        if kind == "SubqueryAlias" and _kind(node.child()) in ("LogicalRelation", "LogicalRDD", "LocalRelation", "View"):
            for a in _each(node.output()):
                known[a.exprId().id()] = {(node.identifier().name(), a.name())}

    plan = df._jdf.queryExecution().analyzed()
    walk(plan, None)
    return {a.name(): known.get(a.exprId().id(), set()) for a in _each(plan.output())}


@dataclass(frozen=True)
class Ban:
    """A business rule: a question in which `question` is found may not read a table of `tables`, or not those alone."""

    question: str
    tables: frozenset[str]
    message: str
    alone: bool = False

    def broken(self, question: str, used: set[str]) -> bool:
        own = {t.lower() for t in self.tables}
        return bool(re.search(self.question, re.sub(r"\s+", "", question))) and (bool(used) and used <= own if self.alone else bool(used & own))


def check(spark: SparkSession, sql: str, tables: set[str] | None = None, candidates: set[str] | None = None, half_open: set[str] = frozenset(), wildcards: bool = False, question: str = "", bans: tuple[Ban, ...] = (), functions: set[str] = frozenset()) -> Findings:
    """Findings on a text. The text that was checked runs unchanged; findings hold its normal form.

    tables: names that may be read (default: the session's views). candidates: tables that the question was about; others
    give a warning. half_open: time columns whose ranges must end with <, so no <= and no BETWEEN. wildcards: whether * may
    stand for columns; count(*) always may. Multiplication is no wildcard here, as it is read from the parsed plan. tables
    may be given with their schemas: a name without one that two schemas have is ambiguous. bans: business rules that hold
    for the question. functions: names that may be called beside Spark's plain built-ins: none that runs code, reads the
    session or its files, none that a user has registered, and no table function that makes rows of its own.
    """
    text = plain(sql)
    found = Findings(text)
    words = {w.upper() for w in re.findall(r"[A-Za-z_]+", text)}
    found.errors += [f"forbidden operation: {w}" for w in FORBIDDEN if w in words]
    if not re.match(r"(?i)\(*\s*(select|with)\b", text):
        found.errors.append("only SELECT is allowed")
    if found.errors:
        return found
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        found.errors.append("more than one statement" if re.search(r";\s*\S", text) else f"syntax: {str(e).strip().splitlines()[0]}")
        return found
    own = _own_names(plan)
    names = [n for n in _relations(plan) if n.lower() not in own]
    known = {t.lower() for t in (tables if tables is not None else {t.name for t in spark.catalog.listTables()})}
    found.tables = sorted(names)
    by_name: dict[str, set[str]] = {}
    for t in known:
        by_name.setdefault(t.split(".")[-1], set()).add(t)
    for n in names:
        low = n.lower()
        full = {t for t in by_name.get(low.split(".")[-1], set()) if t == low or t.endswith("." + low) or "." not in t and low.endswith("." + t)}
        if low.startswith(SYSTEM):
            found.errors.append(f"system table: {n}")
        elif not full:
            found.errors.append(f"unknown table: {n}")
        elif len(full) > 1 and low not in known:
            found.errors.append(f"ambiguous table: {n}")
    found.errors += [f"function not allowed: {n}" for n in _functions(spark, plan, set(functions))]
    if not wildcards and _stars(plan):
        found.errors.append("* is not allowed")
    found.errors += [f"time range of {c} must be half-open" for c in sorted(_closed_ranges(plan, set(half_open)))]
    used = {n.lower().split(".")[-1] for n in names}
    found.errors += [b.message for b in bans if b.broken(question, used)]
    if found.errors:
        return found
    try:
        found.lineage = lineage(spark.sql(text))
    except AnalysisException as e:
        kind = e.getCondition() or ""
        what = "ambiguous column" if "AMBIGUOUS" in kind else "unknown column" if "UNRESOLVED_COLUMN" in kind or "MISSING" in kind else "unknown table" if "TABLE_OR_VIEW" in kind else "not valid"
        found.errors.append(f"{what}: {str(e).strip().splitlines()[0][:200]}")
        return found
    if candidates:
        other = [n for n in names if n.lower() not in {c.lower() for c in candidates}]
        found.warnings += [f"not among the candidate tables: {n}" for n in other]
    return found


def guarded_sql(spark: SparkSession, sql: str, **rules) -> DataFrame:
    """The result of a text that passes check(); raises Blocked otherwise. Nothing has run when it returns."""
    found = check(spark, sql, **rules)
    if not found.passed:
        raise Blocked(found)
    return spark.sql(sql)


def admissible(spark: SparkSession, sql: str, **rules) -> bool:
    """Whether a text may serve as an example: it passes and bounds its size by LIMIT or an aggregate."""
    found = check(spark, sql, **rules)
    if not found.passed:
        return False
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(found.sql)
    bounded = any(_kind(n) in ("GlobalLimit", "LocalLimit", "Aggregate") for n in _nodes(plan))
    return bounded or bool(re.search(r"(?i)\b(count|sum|avg|min|max|stddev|var_pop|var_samp)\s*\(", found.sql))
