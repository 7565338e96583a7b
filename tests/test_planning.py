"""Plans of many results in Spark against the driver's planner, one by one."""

import random
import re

from sparkloom.operators import planning
from sparkloom.plans import planner

KINDS = sorted({a for v in planner.VARIANTS for a in v.suits}) + ["empty"]


def test_plans_are_those_of_the_planner(spark):
    rnd, results, traits, want = random.Random(6), [], [], []
    numbers, flags = ("measures", "categories", "time_points", "entities", "completeness", "dimensions"), ("additive", "part_to_whole", "matrix", "grouped_samples")
    for i in range(400):
        own = {n: rnd.choice([0.0, 0.5, 1.0, 2.0, 3.0, 8.0, 12.0, 13.0, float("nan"), float("inf")]) for n in numbers if rnd.random() < 0.85} | {f: rnd.random() < 0.7 for f in flags if rnd.random() < 0.85}
        kind, wanted = rnd.choice(KINDS), rnd.choice([None, "pie", "area", "combo", "star"])
        results.append((i, kind, wanted))
        traits += [(i, n, None if isinstance(x, bool) else x, x if isinstance(x, bool) else None, None) for n, x in own.items()]
        found = planner.plans(kind, own, wanted)
        want += [(i, k + 1, v.chart, v.name, v.transform, round(x, 9), k == 0 and x >= planner.RECOMMENDED) for k, (x, v) in enumerate(found)]
        best = planner.choose(found)
        assert (best is not None) == any(w[0] == i and w[-1] for w in want[-len(found) :] if found)
    got = planning.core_plans(spark.createDataFrame(results, "result int, archetype string, wanted string"), spark.createDataFrame(traits, "result int, trait string, number double, flag boolean, text string"))
    assert sorted((*r[:5], round(r[5], 9), r[6]) for r in map(tuple, got.collect())) == sorted(want) and len(want) > 200


def test_texts_and_results_without_traits(spark):
    variants = (planner.Variant("bar", "named", {"a": 0.9}, {"unit": "m", "n": (None, 3)}), planner.Variant("pie", "free", {"a": 0.5}))
    results = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, "a", None)], "result int, archetype string, wanted string")
    traits = spark.createDataFrame([(1, "unit", None, None, "m"), (1, "n", 3.0, None, None), (2, "unit", None, None, "km"), (2, "n", 1.0, None, None), (1, "n", 3.0, None, None)], "result int, trait string, number double, flag boolean, text string")
    got = sorted(tuple(r)[:4] for r in planning.core_plans(results, traits, variants).collect())
    assert got == [(1, 1, "bar", "named"), (1, 2, "pie", "free"), (2, 1, "pie", "free"), (4, 1, "pie", "free")]
    assert planning.core_plans(results.limit(0), traits, variants).count() == 0


def test_a_result_is_one_row_between_its_traits_and_its_plans(spark):
    """Not one for each condition that it meets: that took a task's memory."""
    results = spark.createDataFrame([(1, "a", None)], "result int, archetype string, wanted string")
    traits = spark.createDataFrame([(1, "measures", 3.0, None, None)], "result int, trait string, number double, flag boolean, text string")
    plan = planning.core_plans(results, traits)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Aggregate \[([^\]]*)\]", plan) and all(re.fullmatch(r"result#\d+", keys) for keys in re.findall(r"Aggregate \[([^\]]*)\]", plan))


def test_more_conditions_than_a_word_holds(spark):
    """Each variant needs its own bound and one that all share; a result twice is ranked as one."""
    variants = tuple(planner.Variant("bar", f"v{i}", {"a": i / 1000}, {"n": (i, None), f"flag{i % 70}": True}) for i in range(150)) + (planner.Variant("pie", "none", {"a": 0.9}, {"other": False}),)
    results = spark.createDataFrame([(1, "a", None), (2, "a", "pie"), (2, "a", None), (3, "a", None)], "result int, archetype string, wanted string")
    traits = [(1, "n", 140.0, None, None)] + [(1, f"flag{i}", None, i % 2 == 0, None) for i in range(70)] + [(2, "other", None, False, None), (2, "other", None, True, None)]
    got = sorted(tuple(r)[:2] + (r["variant"],) for r in planning.core_plans(results, spark.createDataFrame(traits, "result int, trait string, number double, flag boolean, text string"), variants).collect())
    assert got == [(1, k + 1, f"v{i}") for k, i in enumerate(i for i in range(140, -1, -1) if i % 70 % 2 == 0)] + [(2, 1, "none"), (2, 2, "none")]
