"""Statements of a read-only session: refused, or run under a tag with a time of their own."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from . import guard

#: Names of parsed plans that are no queries though they aren't called commands: what they run changes something.
_CHANGES = ("Insert", "Update", "Delete", "Merge", "Create", "Replace", "Drop", "Alter", "Truncate", "Set", "Reset", "Add", "Cache", "Uncache", "Refresh", "Load", "Analyze", "Repair", "Call", "Comment", "Overwrite", "Append")


@dataclass
class Facts:
    """What is known of a statement that has run. state: ok, failed, timed_out, cancelled or blocked."""

    sql: str
    state: str
    seconds: float
    row_count: int = 0
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    message: str = ""
    tables: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return self.state == "ok"


def changes(spark: SparkSession, sql: str) -> bool:
    """Whether a text, as parsed, is a command or holds one, so that running it changes or sets something."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    return any(command.isInstance(n) or n.getClass().getSimpleName().startswith(_CHANGES) for n in guard._nodes(plan))


class ReadOnlySession:
    """A session whose statements only read. Each runs under a tag of its own; one that goes on for `seconds` is cancelled by
    that tag from another thread, and others go on."""

    def __init__(self, spark: SparkSession, seconds: float = 30, most_rows: int = 1000, **rules):
        self.spark, self.seconds, self.most_rows, self.rules = spark, seconds, most_rows, rules
        self.running: dict[str, str] = {}

    def query(self, sql: str) -> DataFrame:
        """A checked query, not yet run; Blocked if it is none or breaks a rule."""
        try:
            command = changes(self.spark, sql)
        except ParseException:
            command = False  # the guard says what is wrong
        if command:
            raise guard.Blocked(guard.Findings(sql, ["only queries may run"]))
        return guard.guarded_sql(self.spark, sql, **self.rules)

    def cancel(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def run(self, sql: str, tag: str | None = None, seconds: float | None = None) -> Facts:
        """Runs a text and says what came of it: facts that hold whatever a caller is told by others. At most `most_rows` rows
        come to the driver; row_count counts these."""
        context, began = self.spark.sparkContext, time.monotonic()
        tag = tag or f"sparkloom-{uuid.uuid4().hex}"
        late = threading.Event()

        def give_up() -> None:
            late.set()
            # a job may begin just after: until the statement ends its jobs are cancelled
            while tag in self.running:
                self.cancel(tag)
                time.sleep(0.05)

        timer = threading.Timer(seconds or self.seconds, give_up)
        timer.daemon = True
        self.running[tag] = sql
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)  # a task ends where it next looks
        timer.start()
        facts = Facts(sql, "ok", 0.0)
        try:
            df = self.query(sql)
            facts.columns, facts.tables = df.columns, guard.check(self.spark, sql, **self.rules).tables
            facts.rows = [tuple(r) for r in df.limit(self.most_rows).collect()]
            facts.row_count = len(facts.rows)
        except guard.Blocked as e:
            facts.state, facts.message = "blocked", str(e)
        except Exception as e:  # whatever a job can end with
            cancelled = "cancelled" in str(e) or "canceled" in str(e).lower()
            facts.state, facts.message = "timed_out" if late.is_set() else "cancelled" if cancelled else "failed", str(e).splitlines()[0][:300]
        finally:
            self.running.pop(tag, None)
            timer.cancel()
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)
            facts.seconds = time.monotonic() - began
        return facts
