"""Scores of table profiles, groups of alike tables, and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import register
from ..sources.store import ensure_checkpoint
from ..sources.tables import table
from .names import near_names

#: Roles of tables that grow in time.
TIME_ROLES = ("事实表", "日志表")
#: Marks of backups, as parts of a name in Chinese and as words of it in English.
BACKUP_PARTS, BACKUP_WORDS = ("历史", "备份", "临时", "旧"), ("old", "backup", "copy", "tmp", "bak")
#: Parts of names that tell what a table is for, or of what time its rows are.
ROLE_MARKS = ("info", "records", "standard", "threshold", "waterlevel", "setting", "year", "month", "day", "hour")
#: The least volume points of a plain time series of a business, and the least length of a group's name.
VOLUME_FLOOR, NAME_LENGTH = 12.0, 6
#: Parts that a structure's backups are dealt into, and as many that its other tables are, each to meet all of the other side.
MIRROR_PARTS = 4
#: Steps of row counts that a tenth takes, and tables whose duplicates a task makes: the names of more would not fit a
#: Parquet file's dictionary, where a pair takes few bytes.
STEPS, DUPLICATE_TABLES = 8, 2000
ACTIVE_SCORE, PENDING_SCORE, GROUP_CONFIDENCE, ACTIVE_CONFIDENCE = 80.0, 60.0, 0.55, 0.55


def bands(value: Column, steps: list[tuple[float, float]], other: float) -> Column:
    """The points of the first step that value reaches."""
    found = None
    for least, points in steps:
        found = (F if found is None else found).when(value >= least, F.lit(float(points)))
    return found.otherwise(float(other))


def volume_points(rows: Column) -> Column:
    return bands(rows, [(100_000, 15), (10_000, 13), (1_000, 10), (100, 7), (1, 4)], 0)


def coverage_points(days: Column) -> Column:
    return bands(days, [(365, 10), (90, 8), (30, 6), (7, 4)], 2)


def backup(name: Column) -> Column:
    """Whether a name is marked as a backup."""
    low = F.lower(name)
    return low.rlike("|".join(BACKUP_PARTS)) | low.rlike(f"(?<![a-z0-9])({'|'.join(BACKUP_WORDS)})(?![a-z0-9])")


def score(profiles: DataFrame) -> DataFrame:
    """profiles with score (0 to 100), confidence, critical and decision.

    Needs: table, role, queryable, rows, sampled, latest, days, primary_key, unique_key, duplicate_ratio (null: unknown),
    commented (whether the table is), comment_ratio, mostly_null (share of columns), failed, skipped, non_business.
    A table of no time role is scored as neutral where time would count. May have: strong (whether columns and name tell a
    time series of the business) and sharded (whether it is a part of a numbered family): a strong series with rows that is
    no shard, no backup, and was read without failure has VOLUME_FLOOR points of volume at least.
    """
    p = F.col
    timed, keyed = p("role").isin(*TIME_ROLES), p("primary_key") | p("unique_key")
    may = lambda c: F.coalesce(p(c), F.lit(False)) if c in profiles.columns else F.lit(False)
    floor = timed & may("strong") & (p("sampled") > 0) & (F.coalesce("rows", F.lit(1)) >= 1) & (p("non_business") < 0.6) & ~may("sharded") & ~backup(p("table")) & ~p("failed") & ~p("skipped")
    lifted = (lambda x: F.when(floor, F.greatest(x, F.lit(VOLUME_FLOOR))).otherwise(x)) if "strong" in profiles.columns else (lambda x: x)
    parts = [
        bands(p("queryable"), [(8, 25), (5, 20), (3, 14), (1, 8)], 0),
        F.when(~timed | p("latest").isNotNull(), 20.0).otherwise(5.0),
        lifted(F.when(p("rows").isNull(), F.when(p("sampled") > 0, F.when(timed, 4.0).otherwise(12.0)).otherwise(0.0)).when(~timed, F.when(p("rows") >= 1, 15.0).otherwise(0.0)).otherwise(volume_points(p("rows")))),
        F.when(~timed, 10.0).when(p("days").isNull(), 0.0).otherwise(coverage_points(p("days"))),
        F.when(p("primary_key"), 5.0).otherwise(0.0) + F.when(p("unique_key"), 2.0).otherwise(0.0) + F.when(p("duplicate_ratio").isNull(), 0.0).when(p("duplicate_ratio") == 0, 3.0).otherwise(1.0),
        F.when(p("commented"), 5.0).otherwise(0.0) + F.round(5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("comment_ratio", F.lit(0.0)))), 2),
        F.when(~timed | p("latest").isNotNull(), 5.0).otherwise(0.0),
        F.when(keyed, 5.0).otherwise(0.0),
    ]
    less = [
        bands(p("mostly_null"), [(0.6, 15), (0.4, 10), (0.2, 5)], 0),
        F.when(p("queryable") == 0, 30.0).when(timed & p("days").isNull(), 10.0).otherwise(0.0),
        F.when(backup(p("table")), 10.0).otherwise(0.0),
    ]
    doubts = [(p("skipped"), 0.35), (p("failed"), 0.30), (p("sampled") == 0, 0.25), (p("rows").isNull(), 0.10), (p("duplicate_ratio").isNull() & ~keyed, 0.15), (p("latest").isNull() & timed, 0.20)]
    points = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum(parts[1:], parts[0]) - sum(less[1:], less[0]))), 2)
    confidence = F.round(F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.when(c, w).otherwise(0.0) for c, w in doubts[1:]), F.when(doubts[0][0], doubts[0][1]).otherwise(0.0))), 2)
    critical = p("skipped") | p("failed") | (p("sampled") == 0) | (timed & p("latest").isNull()) | (timed & p("duplicate_ratio").isNull() & ~keyed)
    got = profiles.withColumns({"score": points, "confidence": confidence, "critical": critical})
    decision = (F.when(p("skipped") | p("failed"), "pending").when(p("non_business") >= 0.9, "standby").when((p("sampled") == 0) & (F.coalesce("rows", F.lit(0)) == 0), "standby")
                .when((p("score") >= ACTIVE_SCORE) & (p("confidence") >= ACTIVE_CONFIDENCE) & ~p("critical"), "active").when(p("score") >= PENDING_SCORE, "pending").otherwise("standby"))
    return got.withColumn("decision", decision)


def normal_name(name: Column) -> Column:
    """A name without marks, technical beginnings, version numbers and marks of backups at its end."""
    text = F.regexp_replace(F.lower(name), "[^0-9a-z一-鿿]", "")
    for pattern in ("^(t|tb|tbl|v)", r"v?\d+$", "(bak|backup|copy|old|tmp)$"):
        text = F.regexp_replace(text, pattern, "")
    return text


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normal names, .7 if one holds the other, .55 and .35 by edit distance, else 0."""
    return _likeness(normal_name(a), normal_name(b))


def _likeness(x: Column, y: Column) -> Column:
    """name_similarity of normal names."""
    both = (F.length(x) >= 4) & (F.length(y) >= 4)
    most = F.greatest(F.lit(2), F.floor(F.greatest(F.length(x), F.length(y)) / 4).cast("int"))
    d = F.call_function("levenshtein", x, y, most)  # -1 beyond that
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(both & (F.contains(x, y) | F.contains(y, x)), 0.7).when(d.between(0, 2), 0.55).when(d >= 0, 0.35).otherwise(0.0)


def _dealt(df: DataFrame, *keys: str, parts: int = 0) -> DataFrame:
    """df by keys in as many parts as a shuffle has: few bytes of a table make many rows, so parts aren't put together.

    Joins of what is made from a table are told to merge: by its file's size, Spark would send a million profiles through
    the driver to each task."""
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is made once a row: a generator's, as filters on others go below and make them for each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def similar_names(tables: DataFrame) -> DataFrame:
    """a, b, n: every pair of tables, a < b, whose name_similarity n is above 0. Needs: table.

    Names that are equal or few edits apart are sought in blocks of sorted names. Names that hold another are joined on the
    shorter name's rarest gram, of eight characters where it has as many, else of four.
    """
    named = tables.select("table", normal_name(F.col("table")).alias("x")).filter("x <> ''")
    held = _held(named.select("x").distinct().withColumn("l", F.length("x")).filter("l >= 4"))
    a, b = named.select(F.col("table").alias("a"), "x"), named.select(F.col("table").alias("b"), F.col("x").alias("y"))
    other = held.join(a.hint("merge"), "x").join(b.hint("merge"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.7).alias("n"))
    return near_names(named).unionByName(other)


def _held(names: DataFrame) -> DataFrame:
    """y, x: every name y that another one x holds. Needs: x, l (its length)."""
    found = None
    for k, shorter in ((4, "l < 8"), (8, "l >= 8")):
        grams = names.filter(f"l >= {k}").select("x", "l", F.explode(F.expr(f"array_distinct(transform(sequence(1, l - {k - 1}), i -> substring(x, i, {k})))")).alias("g"))
        counted = grams.groupBy("g").agg(F.count("*").alias("n"))
        rarest = grams.filter(shorter).join(counted.hint("merge"), "g").groupBy("x", "l").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
        some = rarest.select(F.col("x").alias("y"), F.col("l").alias("ly"), "g").join(grams.hint("merge"), "g").filter("ly < l AND contains(x, y)").select("y", "x")
        found = some if found is None else found.unionByName(some)
    return found


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all, 0 without any."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def _sharing(p: DataFrame, percent: int, *keys: str) -> DataFrame:
    """Rows of p, as a and b with their sets: every pair of equal keys whose columns have a jaccard of `percent` at least,
    among others, and some more than once.

    Of two such sets, each holds one of the other's columns among its size - percent * size + 1 rarest, so only these are
    joined. A set travels with them: most pairs that share a column are far apart, and end where they meet.
    """
    held = p.select("table", "_t", "_x", F.explode("columns").alias("c"))
    counted = held.groupBy("c").agg(F.count("*").alias("n"))
    sets = held.join(counted.hint("merge"), "c").groupBy("table", "_t", "_x").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("s"))
    sets = sets.withColumns({"size": F.size("s"), "columns": F.transform("s", lambda x: x["c"])})
    rare = sets.select("table", "_t", "_x", "columns", "size", F.explode(F.expr(f"slice(columns, 1, size - (size * {percent} + 99) div 100 + 1)")).alias("c"))
    rare = _dealt(rare, *keys, "c")
    other = rare.select(*[F.col(c).alias(f"{c}_") for c in rare.columns])
    same = [F.col(k) == F.col(f"{k}_") for k in (*keys, "c")]
    fits = F.least("size", "size_") * 100 >= F.greatest("size", "size_") * percent
    names = (("table", "a"), ("columns", "ca"), ("_t", "ta"), ("_x", "xa"), ("table_", "b"), ("columns_", "cb"), ("_t_", "tb"), ("_x_", "xb"))
    return rare.join(other.hint("merge"), [*same, F.col("table") < F.col("table_"), fits]).select(*[F.col(x).alias(y) for x, y in names])


def pairs(profiles: DataFrame, least: float = 0.0) -> DataFrame:
    """Strong edges between tables, with a jaccard of `least` at least: a, b, confidence, jaccard. Needs: table, columns
    (array), time_column.

    A strong edge needs a jaccard of .35, or one of .15 between equal normal names: candidates share a rare column, and
    are judged where they are joined. The more their sets must share, the fewer columns are joined.
    """
    named = profiles.select("table", "columns", "time_column").repartition(profiles.sparkSession.sparkContext.defaultParallelism)  # names are costly, files few
    p = named.select("table", F.array_distinct("columns").alias("columns"), F.coalesce(normal_name(F.col("time_column")), F.lit("")).alias("_t"), normal_name(F.col("table")).alias("_x")).filter(F.size("columns") > 0)
    shared = F.size(F.array_intersect("ca", "cb"))
    alike = F.try_divide(F.col("shared"), F.size("ca") + F.size("cb") - F.col("shared"))  # no column is twice in a set
    judged = lambda near: _once(near, "shared", shared).withColumn("jaccard", alike)
    near = judged(_sharing(p, max(35, int(100 * least) - 1))).filter("jaccard >= 0.35")  # jaccards are rounded, so one below
    if least <= 0.35:
        near = near.unionByName(judged(_sharing(p.filter("_x <> ''"), 15, "_x")).filter("jaccard >= 0.15 AND jaccard < 0.35"))
    time = F.when((F.col("ta") == "") | (F.col("tb") == ""), 0.0).when(F.col("ta") == F.col("tb"), 1.0).otherwise(0.3)
    scored = _once(near.select("a", "b", "xa", "xb", "jaccard", time.alias("t")), "n", _likeness(F.col("xa"), F.col("xb")))
    strong = ((F.col("n") == 1) & (F.col("jaccard") >= 0.15)) | ((F.col("n") >= 0.7) & (F.col("jaccard") >= 0.35)) | ((F.col("jaccard") >= 0.7) & (F.col("t") >= 0.3))
    confidence = F.round(F.least(F.lit(1.0), 0.4 * F.col("n") + 0.4 * F.col("jaccard") + 0.2 * F.col("t")), 3)
    return scored.filter(strong).select("a", "b", confidence.alias("confidence"), F.round("jaccard", 6).alias("jaccard")).filter((F.col("confidence") >= GROUP_CONFIDENCE) & (F.col("jaccard") >= least)).distinct()


def groups(edges: DataFrame) -> DataFrame:
    """table, root: the least name that edges lead to.

    Each round hooks every root to the least root that one of its tables has met, then lets it jump to where that one is
    hooked, so a chain of tables takes rounds by the logarithm of its length. Each round is cut from the last.
    """
    ensure_checkpoint(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.select(F.col("a").alias("table")).distinct().withColumn("root", F.col("table"))
    while True:
        met = both.join(label, F.col("b") == F.col("table")).groupBy("a").agg(F.min("root").alias("met"))
        seen = label.join(met, F.col("table") == F.col("a")).select("table", "root", F.least("root", "met").alias("met"))
        hook = seen.groupBy("root").agg(F.min("met").alias("to"))
        jump = hook.join(hook.select(F.col("root").alias("to"), F.col("to").alias("further")), "to", "left").select("root", F.coalesce("further", "to").alias("to"))
        new = label.join(jump, "root").select("table", F.col("to").alias("root"), (F.col("to") < F.col("root")).alias("moved")).checkpoint()
        label = new.select("table", "root")
        if not new.filter("moved").take(1):
            return label


def summaries(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, name, members, confidence, jaccard of each group: the least of its edges', and the beginning that all members'
    normal names have in common, or the root's normal name where that is shorter than NAME_LENGTH.

    What the least and the greatest name have in common, all have; so no group is gathered."""
    named = roots.withColumn("_x", normal_name(F.col("table")))
    ends = named.groupBy("root").agg(F.count("*").alias("members"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.min_by("_x", "table").alias("first"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low"))), lambda i: (F.substring(F.col("low"), F.lit(1), i) == F.substring(F.col("high"), F.lit(1), i)) & (i <= F.length("low"))))
    weakest = edges.join(roots.withColumnRenamed("table", "a"), "a").groupBy("root").agg(F.min("confidence").alias("confidence"), F.min("jaccard").alias("jaccard"))
    name = F.when(same >= NAME_LENGTH, F.substring(F.col("low"), F.lit(1), same)).otherwise(F.coalesce(F.nullif("first", F.lit("")), F.col("root")))
    return ends.select("root", name.alias("name"), "members").join(weakest, "root")


def shards(profiles: DataFrame) -> DataFrame:
    """Tables of a numbered family of two or more with one structure, beside a table without number: table, entry."""
    numbered = profiles.select("table", "fingerprint", F.regexp_extract("table", r"^(.+?)_(\d+)$", 1).alias("family")).filter("family <> ''")
    alike = numbered.groupBy("family", "fingerprint").agg(F.count("*").alias("n")).filter("n >= 2")
    entry = profiles.select(F.col("table").alias("entry"))
    return numbered.join(alike, ["family", "fingerprint"]).join(entry, F.col("entry") == F.col("family")).select("table", "entry")


def role_marks(name: Column) -> Column:
    """Which of ROLE_MARKS a name holds."""
    return F.filter(F.array(*map(F.lit, ROLE_MARKS)), lambda m: F.contains(F.lower(name), m))


def duplicates(profiles: DataFrame, *within: str, tables: int = 0) -> DataFrame:
    """Pairs with one structure and one sample (and equal columns `within`) whose row counts differ by a tenth at most: the
    better scored is kept. Names that both tell a role, and not the same one, make no pair. tables: about how many there are.

    Counts within a tenth are STEPS steps apart at most, so the table with fewer rows meets those of its step and of the next
    ones. Both come in order of marks and scores: what like tables are paired with is then the same, and takes few bytes.
    """
    step = F.when(F.col("rows") == 0, -100).when(F.col("rows") > 0, F.floor(F.ln("rows") / (0.11 / STEPS)).cast("int"))
    keys = ["fingerprint", "data_fingerprint", *within, "step"]
    marks = F.array_join(role_marks(F.col("table")), ",")
    p = profiles.filter("sampled > 0").select("table", "rows", "score", *keys[:-1], step.alias("own"), marks.alias("marks"))
    # an order that a join does not need is taken out unless it is numbered
    edge = (F.col("step") == F.col("own")) | (F.col("step") == F.col("own") + STEPS)  # between these, all counts are near
    dealt = lambda df, *order: _dealt(df, *keys, parts=tables // DUPLICATE_TABLES).sortWithinPartitions(*keys, *order, "marks", "score").withColumn("at", F.monotonically_increasing_id()).filter("at >= 0")
    low = dealt(p.withColumn("step", F.explode(F.sequence("own", F.col("own") + STEPS))).withColumn("edge", edge), "edge").alias("a")
    high = dealt(p.withColumnRenamed("own", "step")).hint("merge").alias("b")
    order = ((F.col("a.rows") < F.col("b.rows")) & (F.col("a.table") != F.col("b.table"))) | ((F.col("a.rows") == F.col("b.rows")) & (F.col("a.table") < F.col("b.table")))
    near = (F.col("b.rows") - F.col("a.rows") <= 0.1 * F.col("b.rows")) & ((F.col("a.marks") == "") | (F.col("b.marks") == "") | (F.col("a.marks") == F.col("b.marks")))
    both = low.join(high, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], near, order])
    better = lambda x, y: F.coalesce(F.col(f"{x}.score") >= F.col(f"{y}.score"), F.lit(False))
    first = F.when(F.col("a.table") < F.col("b.table"), better("a", "b")).otherwise(~better("b", "a"))  # of equal scores, the lesser name
    return both.select(F.when(first, F.col("a.table")).otherwise(F.col("b.table")).alias("kept"), F.when(first, F.col("b.table")).otherwise(F.col("a.table")).alias("dropped"))


def mirrors(profiles: DataFrame, edges: DataFrame, *within: str) -> DataFrame:
    """Backups of other tables (of equal columns `within`): those marked as such, with the structure of one that is not, or
    nine tenths of its columns. The pairs of one structure are many, so they are made once and not gathered again."""
    marks = profiles.select("table", "fingerprint", *within, backup(F.col("table")).alias("backup")).distinct()
    a, b = marks.filter("backup").alias("a"), marks.filter("NOT backup").alias("b")
    alike = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("fingerprint", *within)]
    # both sides are dealt out, and each part meets all of the other side. The few backups of a part are what is gone through
    # again and again, so pairs that are written repeat themselves soon, and take few bytes
    keys, parts, part = ("fingerprint", *within), F.sequence(F.lit(0), F.lit(MIRROR_PARTS - 1)), F.pmod(F.xxhash64("table"), F.lit(MIRROR_PARTS)).cast("int")
    left = _dealt(marks.filter("NOT backup").withColumn("part", part).withColumn("met", F.explode(parts)), *keys, "part", "met").alias("b")
    right = _dealt(marks.filter("backup").withColumn("met", part).withColumn("part", F.explode(parts)), *keys, "part", "met").hint("merge").alias("a")
    if within:  # groups are small
        left, right = b, a.hint("merge")
    same = left.join(right, [*alike, *([] if within else [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("part", "met")])]).select(F.col("a.table").alias("mirror"), F.col("b.table").alias("of"))
    near = edges.filter("jaccard >= 0.9")
    near = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().alias("e")
    close = near.join(a.hint("merge"), F.col("e.a") == F.col("a.table")).join(b.hint("merge"), F.col("e.b") == F.col("b.table"))
    close = close.filter(~F.coalesce(alike[0], F.lit(False)))
    for k in alike[1:]:
        close = close.filter(k)
    return same.unionByName(close.select(F.col("a.table").alias("mirror"), F.col("b.table").alias("of")))


def obsolete(profiles: DataFrame, days: int = 365) -> DataFrame:
    """Tables whose latest data is more than `days` older than that of a table of their group. Needs: table, root, latest."""
    newest = F.max("latest").over(Window.partitionBy("root"))
    return profiles.withColumn("_n", newest).filter(F.datediff("_n", "latest") > days).select("table", "root")


def merge_reviews(machine: DataFrame, kept: DataFrame) -> DataFrame:
    """Earlier reviews joined with a run's: state, and a decision that a person made is never overwritten."""
    m, k = machine.select("table", F.col("decision").alias("proposed")), kept.select("table", "decision", "by_person")
    both = m.join(k, "table", "full")
    state = F.when(F.col("proposed").isNull(), "missing").when(F.col("decision").isNull(), "new").otherwise("present")
    return both.select("table", state.alias("state"), "proposed", F.when(F.col("by_person"), F.col("decision")).otherwise(F.coalesce("proposed", "decision")).alias("effective"))


# --- bindings: profiles made from rows of part


def _profiles(s: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    suffix = F.when(k % 9 == 1, "_bak").when(k % 9 == 2, F.lit("_2")).when(k % 9 == 3, F.lit("_1")).otherwise(F.substring(F.lit("abcdefghi"), (k % 9 + 1).cast("int"), F.lit(1)))
    return table(s, d, "part").select(
        F.concat(F.lit("t_"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("_"), F.floor(k / 9).cast("string"), F.lit("x"), suffix).alias("table"), "p_partkey",
        F.when(k % 3 == 0, "事实表").when(k % 3 == 1, "业务表").otherwise("字典表").alias("role"), (size % 10).alias("queryable"),
        F.when(k % 11 != 0, F.floor(F.col("p_retailprice") * (k % 200))).cast("long").alias("rows"), F.when(k % 13 == 0, 0).otherwise(200).alias("sampled"),
        F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), -size * 20)).alias("latest"), F.when(k % 5 != 0, (size * 9).cast("double")).alias("days"), (k % 2 == 0).alias("primary_key"), (k % 4 == 1).alias("unique_key"),
        F.when(k % 6 == 0, 0.0).when(k % 6 == 1, 0.1).alias("duplicate_ratio"), (k % 3 != 1).alias("commented"), (size / 50).alias("comment_ratio"), (F.col("p_partkey") % 100 / 100).alias("mostly_null"),
        (k % 17 == 0).alias("failed"), (k % 19 == 0).alias("skipped"), F.when(k % 23 == 0, 0.95).otherwise(0.1).alias("non_business"),
        F.array_distinct(F.transform(F.sequence(F.lit(0), size % 7 + 2), lambda i: F.concat(F.lit("c"), (F.floor(k / 9) + i * i).cast("string")))).alias("columns"),
        F.when(k % 5 != 0, "update_time").alias("time_column"), F.concat("p_brand", (k % 2).cast("string")).alias("fingerprint"), F.col("p_brand").alias("data_fingerprint"))


_PROFILES = """WITH q AS (SELECT p_partkey AS k, * FROM part), p AS (
  SELECT concat('t_', replace(p_name, ' ', ''), '_', k // 9, 'x', CASE k % 9 WHEN 1 THEN '_bak' WHEN 2 THEN '_2' WHEN 3 THEN '_1' ELSE substr('abcdefghi', k % 9 + 1, 1) END) AS t, k, p_size % 10 AS queryable, p_size, p_brand, k % 3 = 0 AS timed,
    CASE WHEN k % 11 <> 0 THEN CAST(floor(p_retailprice * (k % 200)) AS BIGINT) END AS rows, CASE WHEN k % 13 = 0 THEN 0 ELSE 200 END AS sampled, k % 5 <> 0 AS fresh, p_size * 9 AS days, k % 2 = 0 AS pk, k % 4 = 1 AS uk,
    CASE k % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 END AS dup, k % 17 = 0 AS failed, k % 19 = 0 AS skipped, k % 23 = 0 AS nb FROM q
), s AS (SELECT *, round(greatest(0, least(100,
    CASE WHEN queryable >= 8 THEN 25 WHEN queryable >= 5 THEN 20 WHEN queryable >= 3 THEN 14 WHEN queryable >= 1 THEN 8 ELSE 0 END
    + CASE WHEN NOT timed OR fresh THEN 20 ELSE 5 END
    + CASE WHEN rows IS NULL THEN CASE WHEN sampled > 0 THEN CASE WHEN timed THEN 4 ELSE 12 END ELSE 0 END WHEN NOT timed THEN CASE WHEN rows >= 1 THEN 15 ELSE 0 END
        WHEN rows >= 100000 THEN 15 WHEN rows >= 10000 THEN 13 WHEN rows >= 1000 THEN 10 WHEN rows >= 100 THEN 7 WHEN rows >= 1 THEN 4 ELSE 0 END
    + CASE WHEN NOT timed THEN 10 WHEN NOT fresh THEN 0 WHEN days >= 365 THEN 10 WHEN days >= 90 THEN 8 WHEN days >= 30 THEN 6 WHEN days >= 7 THEN 4 ELSE 2 END
    + CASE WHEN pk THEN 5 ELSE 0 END + CASE WHEN uk THEN 2 ELSE 0 END + CASE WHEN dup IS NULL THEN 0 WHEN dup = 0 THEN 3 ELSE 1 END
    + CASE WHEN k % 3 <> 1 THEN 5 ELSE 0 END + round(5 * (p_size / 50)::DOUBLE, 2) + CASE WHEN NOT timed OR fresh THEN 5 ELSE 0 END + CASE WHEN pk OR uk THEN 5 ELSE 0 END
    - CASE WHEN k % 100 >= 60 THEN 15 WHEN k % 100 >= 40 THEN 10 WHEN k % 100 >= 20 THEN 5 ELSE 0 END
    - CASE WHEN queryable = 0 THEN 30 WHEN timed AND NOT fresh THEN 10 ELSE 0 END - CASE WHEN k % 9 = 1 THEN 10 ELSE 0 END)), 2)::DOUBLE AS score,
  round(greatest(0, 1 - CASE WHEN skipped THEN 0.35 ELSE 0 END - CASE WHEN failed THEN 0.3 ELSE 0 END - CASE WHEN sampled = 0 THEN 0.25 ELSE 0 END - CASE WHEN rows IS NULL THEN 0.1 ELSE 0 END
    - CASE WHEN dup IS NULL AND NOT (pk OR uk) THEN 0.15 ELSE 0 END - CASE WHEN NOT fresh AND timed THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence,
  skipped OR failed OR sampled = 0 OR (timed AND NOT fresh) OR (timed AND dup IS NULL AND NOT (pk OR uk)) AS critical FROM p)
"""
register("T1_score", lambda s, d: score(_profiles(s, d)).select("table", "score", "confidence", "critical"), _PROFILES + "SELECT t AS \"table\", score, confidence, critical FROM s")
register("T2_volume_bands", lambda s, d: _profiles(s, d).select("table", volume_points(F.coalesce("rows", F.lit(0))).alias("points")), _PROFILES + "SELECT t AS \"table\", CASE WHEN coalesce(rows, 0) >= 100000 THEN 15.0 WHEN rows >= 10000 THEN 13 WHEN rows >= 1000 THEN 10 WHEN rows >= 100 THEN 7 WHEN rows >= 1 THEN 4 ELSE 0 END::DOUBLE AS points FROM p")
register("T4_coverage_bands", lambda s, d: _profiles(s, d).filter("days IS NOT NULL").select("table", coverage_points(F.col("days")).alias("points")), _PROFILES + "SELECT t AS \"table\", CASE WHEN days >= 365 THEN 10.0 WHEN days >= 90 THEN 8 WHEN days >= 30 THEN 6 WHEN days >= 7 THEN 4 ELSE 2 END::DOUBLE AS points FROM p WHERE fresh")
register("T8_decision", lambda s, d: score(_profiles(s, d)).select("table", "decision"), _PROFILES + "SELECT t AS \"table\", CASE WHEN skipped OR failed THEN 'pending' WHEN nb THEN 'standby' WHEN sampled = 0 AND coalesce(rows, 0) = 0 THEN 'standby' WHEN score >= 80 AND confidence >= 0.55 AND NOT critical THEN 'active' WHEN score >= 60 THEN 'pending' ELSE 'standby' END AS decision FROM s")
_SIMILAR = """, n AS (SELECT t, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^0-9a-z]', '', 'g'), '^(t|tb|tbl|v)', ''), 'v?[0-9]+$', ''), '(bak|backup|copy|old|tmp)$', '') AS n FROM p)
, sim AS (SELECT a.t AS a, b.t AS b, a.k AS ka, b.k AS kb, CASE WHEN a.n = '' OR b.n = '' THEN 0.0 WHEN a.n = b.n THEN 1.0 WHEN length(a.n) >= 4 AND length(b.n) >= 4 AND (contains(a.n, b.n) OR contains(b.n, a.n)) THEN 0.7
  WHEN levenshtein(a.n, b.n) <= 2 THEN 0.55 WHEN levenshtein(a.n, b.n) <= greatest(length(a.n), length(b.n)) * 0.25 THEN 0.35 ELSE 0.0 END::DOUBLE AS n FROM n a JOIN n b ON a.t < b.t)
"""
register("T10_name_similarity", lambda s, d: similar_names(_profiles(s, d)), _PROFILES + _SIMILAR + "SELECT a, b, n FROM sim WHERE n > 0")
_EDGES = _PROFILES + _SIMILAR + """
, c AS (SELECT t, k, list_distinct(list_transform(range(0, p_size % 7 + 3), lambda i: k // 9 + i * i)) AS cols FROM p)
, e AS (SELECT s.a, s.b, s.n, len(list_intersect(x.cols, y.cols)) / len(list_distinct(list_concat(x.cols, y.cols))) AS j, CASE WHEN ka % 5 <> 0 AND kb % 5 <> 0 THEN 1.0 ELSE 0.0 END AS tm FROM sim s JOIN c x ON s.a = x.t JOIN c y ON s.b = y.t)
, strong AS (SELECT a, b, round(least(1.0::DOUBLE, 0.4::DOUBLE * n + 0.4::DOUBLE * j + 0.2::DOUBLE * tm), 3) AS confidence, round(j, 6) AS jaccard FROM e WHERE (n = 1 AND j >= 0.15) OR (n >= 0.7 AND j >= 0.35) OR (j >= 0.7 AND tm >= 0.3))
"""
register("T13_strong_edges", lambda s, d: pairs(_profiles(s, d)), _EDGES + "SELECT * FROM strong WHERE confidence >= 0.55")


def _grouped(s, d):
    return groups(pairs(_profiles(s, d)))


register("T14_components", _grouped, _EDGES.replace("WITH q AS", "WITH RECURSIVE q AS", 1) + """
, ed AS (SELECT a, b FROM strong WHERE confidence >= 0.55 UNION SELECT b, a FROM strong WHERE confidence >= 0.55), walk AS (SELECT a AS t, a AS r FROM ed UNION SELECT w.t, ed.b FROM walk w JOIN ed ON w.r = ed.a)
SELECT t AS "table", min(r) AS root FROM walk GROUP BY t""")
def _edges(s, d):
    """Edges that are made once, for what reads them again."""
    ensure_checkpoint(s)
    return pairs(_profiles(s, d)).checkpoint()


register("T15_group_summary", lambda s, d: (e := _edges(s, d)).join(groups(e).withColumnRenamed("table", "a"), "a").groupBy("root").agg(F.min("confidence").alias("confidence"), F.min("jaccard").alias("jaccard"), F.count("*").alias("edges")),
         _EDGES.replace("WITH q AS", "WITH RECURSIVE q AS", 1) + """
, ed AS (SELECT a, b FROM strong WHERE confidence >= 0.55 UNION SELECT b, a FROM strong WHERE confidence >= 0.55), walk AS (SELECT a AS t, a AS r FROM ed UNION SELECT w.t, ed.b FROM walk w JOIN ed ON w.r = ed.a), roots AS (SELECT t, min(r) AS root FROM walk GROUP BY t)
SELECT root, min(confidence) AS confidence, min(jaccard) AS jaccard, count(*) AS edges FROM strong JOIN roots ON a = t WHERE confidence >= 0.55 GROUP BY root""")


def _shard_rows(s, d):
    return table(s, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("_"), F.col("o_orderkey").cast("string"))).otherwise("")).alias("table"), F.col("o_orderstatus").alias("fingerprint")).distinct()


register("T16_shards", lambda s, d: shards(_shard_rows(s, d)).distinct(), """
WITH r AS (SELECT DISTINCT concat('f', o_custkey % 40, CASE WHEN o_orderkey % 3 > 0 THEN concat('_', o_orderkey) ELSE '' END) AS t, o_orderstatus AS fp FROM orders),
n AS (SELECT t, fp, regexp_extract(t, '^(.+?)_([0-9]+)$', 1) AS f FROM r), ok AS (SELECT f, fp FROM n WHERE f <> '' GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT DISTINCT n.t AS "table", n.f AS entry FROM n JOIN ok ON n.f = ok.f AND n.fp = ok.fp JOIN r e ON e.t = n.f""")
register("T17_duplicates", lambda s, d: duplicates(score(_profiles(s, d)), tables=table(s, d, "part").count()), _PROFILES + """
, b AS (SELECT *, concat(p_brand, k % 2) AS fp FROM s WHERE sampled > 0)
SELECT CASE WHEN x.score >= y.score THEN x.t ELSE y.t END AS kept, CASE WHEN x.score >= y.score THEN y.t ELSE x.t END AS dropped FROM b x JOIN b y ON x.fp = y.fp AND x.t < y.t WHERE abs(x.rows - y.rows) <= 0.1::DOUBLE * greatest(x.rows, y.rows)""")
register("T18_mirrors", lambda s, d: mirrors(_profiles(s, d), pairs(_profiles(s, d), 0.9)), _EDGES + """
, m AS (SELECT t, concat(p_brand, k % 2) AS fp, k % 9 = 1 AS bak FROM p), near AS (SELECT a, b FROM strong WHERE confidence >= 0.55 AND jaccard >= 0.9 UNION SELECT b, a FROM strong WHERE confidence >= 0.55 AND jaccard >= 0.9)
SELECT x.t AS mirror, y.t AS of FROM m x JOIN m y ON x.bak AND NOT y.bak AND x.fp = y.fp UNION SELECT a, b FROM near JOIN m x ON a = x.t AND x.bak JOIN m y ON b = y.t AND NOT y.bak""")
register("T19_obsolete", lambda s, d: obsolete(_profiles(s, d).withColumn("root", F.col("data_fingerprint"))), _PROFILES + """
, l AS (SELECT t, p_brand AS root, CASE WHEN fresh THEN DATE '2024-01-01' - p_size * 20 END AS latest FROM p)
SELECT t AS "table", root FROM (SELECT *, max(latest) OVER (PARTITION BY root) AS newest FROM l) WHERE newest - latest > 365""")
register("T22_review_merge", lambda s, d: merge_reviews(score(_profiles(s, d)).filter("p_partkey % 4 <> 0"), _profiles(s, d).filter("p_partkey % 3 <> 0").select("table", F.lit("active").alias("decision"), (F.col("p_partkey") % 2 == 0).alias("by_person"))), _PROFILES + """
, m AS (SELECT t, CASE WHEN skipped OR failed THEN 'pending' WHEN nb THEN 'standby' WHEN sampled = 0 AND coalesce(rows, 0) = 0 THEN 'standby' WHEN score >= 80 AND confidence >= 0.55 AND NOT critical THEN 'active' WHEN score >= 60 THEN 'pending' ELSE 'standby' END AS proposed FROM s WHERE k % 4 <> 0),
h AS (SELECT t, 'active' AS decision, k % 2 = 0 AS by_person FROM p WHERE k % 3 <> 0)
SELECT coalesce(m.t, h.t) AS "table", CASE WHEN proposed IS NULL THEN 'missing' WHEN decision IS NULL THEN 'new' ELSE 'present' END AS state, proposed, CASE WHEN by_person THEN decision ELSE coalesce(proposed, decision) END AS effective FROM m FULL JOIN h ON m.t = h.t""")
register("T23_decision_counts", lambda s, d: score(_profiles(s, d)).groupBy("decision").agg(F.count("*").alias("n")), _PROFILES + "SELECT CASE WHEN skipped OR failed THEN 'pending' WHEN nb THEN 'standby' WHEN sampled = 0 AND coalesce(rows, 0) = 0 THEN 'standby' WHEN score >= 80 AND confidence >= 0.55 AND NOT critical THEN 'active' WHEN score >= 60 THEN 'pending' ELSE 'standby' END AS decision, count(*) AS n FROM s GROUP BY 1")

_strong = lambda s, d: _profiles(s, d).withColumns({"strong": F.col("p_partkey") % 2 == 0, "sharded": F.col("p_partkey") % 7 == 0})
register("T3_volume_floor", lambda s, d: score(_strong(s, d)).join(score(_profiles(s, d)).select("table", F.col("score").alias("plain")), "table").select("table", F.round(F.col("score") - F.col("plain"), 2).alias("more")), _PROFILES + """
, v AS (SELECT *, CASE WHEN rows IS NULL THEN CASE WHEN sampled > 0 THEN 4 ELSE 0 END WHEN rows >= 100000 THEN 15 WHEN rows >= 10000 THEN 13 WHEN rows >= 1000 THEN 10 WHEN rows >= 100 THEN 7 WHEN rows >= 1 THEN 4 ELSE 0 END AS volume,
  timed AND k % 2 = 0 AND sampled > 0 AND coalesce(rows, 1) >= 1 AND NOT nb AND k % 7 <> 0 AND k % 9 <> 1 AND NOT failed AND NOT skipped AS lifted FROM s),
u AS (SELECT *, CASE WHEN queryable >= 8 THEN 25 WHEN queryable >= 5 THEN 20 WHEN queryable >= 3 THEN 14 WHEN queryable >= 1 THEN 8 ELSE 0 END + CASE WHEN fresh THEN 20 ELSE 5 END + CASE WHEN NOT fresh THEN 0 WHEN days >= 365 THEN 10 WHEN days >= 90 THEN 8 WHEN days >= 30 THEN 6 WHEN days >= 7 THEN 4 ELSE 2 END
  + CASE WHEN pk THEN 5 ELSE 0 END + CASE WHEN uk THEN 2 ELSE 0 END + CASE WHEN dup IS NULL THEN 0 WHEN dup = 0 THEN 3 ELSE 1 END + CASE WHEN k % 3 <> 1 THEN 5 ELSE 0 END + round(5 * (p_size / 50)::DOUBLE, 2) + CASE WHEN fresh THEN 5 ELSE 0 END + CASE WHEN pk OR uk THEN 5 ELSE 0 END
  - CASE WHEN k % 100 >= 60 THEN 15 WHEN k % 100 >= 40 THEN 10 WHEN k % 100 >= 20 THEN 5 ELSE 0 END - CASE WHEN queryable = 0 THEN 30 WHEN NOT fresh THEN 10 ELSE 0 END AS other FROM v)
SELECT t AS "table", CASE WHEN lifted THEN round(round(greatest(0, least(100, other + greatest(volume, 12))), 2) - score, 2) ELSE 0 END::DOUBLE AS more FROM u""")
register("T15_group_names", lambda s, d: summaries(e := _edges(s, d), groups(e)), _EDGES.replace("WITH q AS", "WITH RECURSIVE q AS", 1) + """
, ed AS (SELECT a, b FROM strong WHERE confidence >= 0.55 UNION SELECT b, a FROM strong WHERE confidence >= 0.55), walk AS (SELECT a AS t, a AS r FROM ed UNION SELECT w.t, ed.b FROM walk w JOIN ed ON w.r = ed.a), roots AS (SELECT t, min(r) AS root FROM walk GROUP BY t)
, m AS (SELECT root, list(n.n ORDER BY n.t) AS names, count(*) AS members FROM roots JOIN n USING (t) GROUP BY root)
, w AS (SELECT root, min(confidence) AS confidence, min(jaccard) AS jaccard FROM strong JOIN roots ON a = t WHERE confidence >= 0.55 GROUP BY root)
, l AS (SELECT *, len(list_filter(range(1, length(names[1]) + 1), lambda i: len(list_distinct(list_transform(names, lambda x: x[1:i]))) = 1)) AS same FROM m)
SELECT root, CASE WHEN same >= 6 THEN names[1][1:same] WHEN names[1] <> '' THEN names[1] ELSE root END AS name, members, confidence, jaccard FROM l JOIN w USING (root)""")
_marked = lambda s, d: _profiles(s, d).withColumn("table", F.concat("table", F.element_at(F.array(*map(F.lit, ("_day", "_hour", "", "_day", "_x"))), (F.col("p_partkey") % 5 + 1).cast("int"))))
register("T17_roles", lambda s, d: duplicates(score(_marked(s, d)), tables=table(s, d, "part").count()), _PROFILES + """
, b AS (SELECT *, concat(p_brand, k % 2) AS fp, t || ['_day', '_hour', '', '_day', '_x'][k % 5 + 1] AS name, [1, 2, 0, 1, 0][k % 5 + 1] AS mark, round(greatest(0, score), 2) AS sc FROM s WHERE sampled > 0)
SELECT CASE WHEN x.score >= y.score THEN x.name ELSE y.name END AS kept, CASE WHEN x.score >= y.score THEN y.name ELSE x.name END AS dropped FROM b x JOIN b y ON x.fp = y.fp AND x.name < y.name
WHERE abs(x.rows - y.rows) <= 0.1::DOUBLE * greatest(x.rows, y.rows) AND (x.mark = 0 OR y.mark = 0 OR x.mark = y.mark)""")
