"""From a result to what a chart is drawn from: fields by selectors, a plan, its transform, and a check of what came out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.transforms import STATS, TransformError, transform
from .planner import Variant, choose, plans


@dataclass(frozen=True)
class Shape:
    """The fields of a result by their part in it; kinds: measure to additive, non_additive or unknown."""

    columns: tuple[str, ...]
    measures: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    temporal: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    entity: str | None = None
    region: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)

    def of_kind(self, kind: str) -> tuple[str, ...]:
        return tuple(m for m in self.measures if self.kinds.get(m) == kind)


@dataclass(frozen=True)
class Preferred:
    """Fields that a model or a user asked for; those that aren't among a result's columns don't count."""

    x: str | None = None
    ys: tuple[str, ...] = ()
    series: str | None = None
    size: str | None = None
    value: str | None = None


def _at(values: tuple[str, ...], index: int) -> str | None:
    return values[index] if 0 <= index < len(values) else None


def scalar(source: str, shape: Shape, preferred: Preferred | None = None, index: int = 0, exclude: tuple[str, ...] = ()) -> str | None:
    """The one field that a selector names, or None: nothing is guessed."""
    p = preferred or Preferred()
    known = lambda name: name if name and name in shape.columns else None
    found = {
        "entity": shape.entity, "region": shape.region, "primary_dimension": _at(shape.dimensions, 0), "dimension": _at(shape.dimensions, index), "temporal": _at(shape.temporal, index), "measure": _at(shape.measures, index),
        "additive_measure": _at(shape.of_kind("additive"), index), "non_additive_measure": _at(shape.of_kind("non_additive"), index), "numeric": _at(tuple(f for f in shape.numeric if f not in exclude), 0),
        "preferred_x": known(p.x), "preferred_y": known(_at(p.ys, index)), "preferred_series": known(p.series), "preferred_size": known(p.size), "preferred_value": known(p.value),
    }
    if source not in found:
        raise ValueError(f"unknown selector: {source}")
    return found[source]


def several(source: str, shape: Shape, preferred: Preferred | None = None, after: int = -1, most: int | None = None) -> tuple[str, ...]:
    """The fields that a selector names, in order: those behind place `after`, `most` at most."""
    found = {
        "measures": shape.measures, "additive_measures": shape.of_kind("additive"), "non_additive_measures": shape.of_kind("non_additive"), "dimensions": shape.dimensions, "temporal": shape.temporal,
        "preferred_ys": tuple(y for y in (preferred or Preferred()).ys if y in shape.columns),
    }
    if source not in found:
        raise ValueError(f"unknown selector: {source}")
    rest = found[source][max(0, after + 1) :]
    return rest if most is None else rest[:most]


#: Where each chart's x, ys and further fields come from; the first selector that finds one counts.
FIELDS: dict[str, dict[str, tuple]] = {
    "bar": {"x": ("preferred_x", "entity", "region", "temporal", "primary_dimension"), "ys": ("preferred_ys", "measures")},
    "horizontal_bar": {"x": ("preferred_x", "entity", "region", "primary_dimension"), "ys": ("preferred_ys", "measures")},
    "line": {"x": ("temporal",), "ys": ("preferred_ys", "measures"), "series": ("preferred_series", "entity")},
    "area": {"x": ("temporal",), "ys": ("preferred_ys", "measures")},
    "pie": {"x": ("preferred_x", "entity", "region", "primary_dimension"), "ys": ("additive_measures",)},
    "donut": {"x": ("preferred_x", "entity", "region", "primary_dimension"), "ys": ("additive_measures",)},
    "scatter": {"x": ("preferred_x", "measure"), "ys": ("measures",)},
    "bubble": {"x": ("preferred_x", "measure"), "ys": ("measures",), "size": ("preferred_size", "numeric")},
    "radar": {"x": ("entity", "primary_dimension"), "ys": ("measures",)},
    "heatmap": {"x": ("primary_dimension",), "y": ("second_dimension",), "value": ("preferred_value", "measure")},
    "boxplot": {"x": ("primary_dimension",), "ys": ("non_additive_measures", "measures")},
    "gauge": {"value": ("preferred_value", "measure")},
    "combo": {"x": ("temporal", "primary_dimension"), "ys": ("measures",)},
}


def spec(variant: Variant, shape: Shape, preferred: Preferred | None = None) -> dict | None:
    """The fields of a variant's chart, or None if one that it needs isn't there. A series is no need."""
    out: dict[str, object] = {"type": variant.chart}
    for part, sources in FIELDS[variant.chart].items():
        if part == "ys":
            found = next((ys for s in sources if (ys := tuple(y for y in several(s, shape, preferred) if y != out.get("x")))), ())
        elif part == "y":
            found = scalar("dimension", shape, index=1)
        elif part == "size":
            taken = (out.get("x"), *out.get("ys", ())[:1])
            found = next((f for s in sources if (f := scalar(s, shape, preferred, exclude=taken)) and f not in taken), None)
        else:
            found = next((f for s in sources if (f := scalar(s, shape, preferred))), None)
        if not found and part != "series":
            return None
        out[part] = found
    if variant.chart == "line" and variant.name != "multi_series":
        out["series"] = None
    return out


@dataclass(frozen=True)
class Prepared:
    """What a chart is drawn from, or why there is none: no_default_plan, selected_plan_missing_spec, transform_failed_*, or
    renderer_rejected_plan if a field of the spec isn't among the columns."""

    rows: DataFrame | None
    spec: dict | None
    variant: Variant | None
    error: str | None = None


def prepare(df: DataFrame, archetype: str, traits: dict, shape: Shape, preferred: Preferred | None = None, user: str | None = None, model: str | None = None, dashboard: str | None = None) -> Prepared:
    """Plans, transforms and checks. The rows stay in Spark; nothing has run but what a transform needs to check itself."""
    variant = choose(plans(archetype, traits, wanted=user or model), user, model, dashboard)
    if variant is None:
        return Prepared(None, None, None, "no_default_plan")
    made = spec(variant, shape, preferred)
    if made is None:
        return Prepared(None, None, variant, "selected_plan_missing_spec")
    arguments = {"group_by_sum": lambda: {"x": made["x"], "ys": list(made["ys"])}, "boxplot_summary": lambda: {"x": made["x"], "y": made["ys"][0]}, "matrix_aggregate": lambda: {"x": made["x"], "y": made["y"], "value": made["value"]}}
    try:
        rows = transform(df, variant.transform, **arguments[variant.transform]()) if variant.transform != "none" else df
    except TransformError as e:
        return Prepared(None, made, variant, f"transform_failed_{e.code}")
    if variant.transform == "boxplot_summary":
        made = made | {"ys": STATS}
    named = [made.get("x"), made.get("y"), made.get("value"), made.get("series"), made.get("size"), *made.get("ys", ())]
    if any(n and n not in rows.columns for n in named):
        return Prepared(None, made, variant, "renderer_rejected_plan")
    return Prepared(rows, made, variant)


#: Categories of a pie that a small window still shows, and the points from which others are zoomed.
COMPACT_SLICES, COMPACT_POINTS = 6, 6


def compact(chart: str, categories: int) -> tuple[bool, bool]:
    """Whether a chart may be shown in a small window, and whether it is zoomed there."""
    return not (chart in ("pie", "donut") and categories > COMPACT_SLICES), chart not in ("pie", "donut", "gauge", "radar") and categories > COMPACT_POINTS


def availability(archetype: str, traits: dict, shape: Shape, preferred: Preferred | None = None) -> dict[str, dict]:
    """Each type of chart with its spec and the reason why it can't be drawn: traits that don't fit, or a missing field."""
    out = {}
    for chart in FIELDS:
        fits = plans(archetype, traits, types=frozenset({chart}))
        made = next((m for _, v in fits if (m := spec(v, shape, preferred))), None)
        out[chart] = {"supported": made is not None, "spec": made, "reason": "" if made else "missing_fields" if fits else "unsuitable_data"}
    return out
