"""Which chart types a result may be drawn as: rules over its traits. Small decisions on the driver; rows stay in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Variant:
    """A way to draw: its type, the archetypes it suits with a suitability each, traits it needs, and its transform."""

    chart: str
    name: str
    suits: dict[str, float]
    needs: dict[str, object] = field(default_factory=dict)
    transform: str = "none"


#: The variants, by preference where suitabilities are equal.
VARIANTS = (
    Variant("bar", "plain", {"categorical_series": 0.9, "temporal_series": 0.6}, {"measures": (1, None)}),
    Variant("bar", "grouped_sum", {"detail_rows": 0.6, "categorical_matrix": 0.5}, {"additive": True, "dimensions": (1, None)}, "group_by_sum"),
    Variant("horizontal_bar", "plain", {"categorical_series": 0.7}, {"categories": (8, None)}),
    Variant("line", "plain", {"temporal_series": 0.95}, {"time_points": (2, None)}),
    Variant("line", "multi_series", {"multi_series_temporal": 0.95}, {"completeness": (0.5, None)}),
    Variant("area", "plain", {"temporal_series": 0.7}, {"entities": (None, 1), "time_points": (2, None)}),
    Variant("pie", "plain", {"categorical_series": 0.6}, {"part_to_whole": True, "categories": (2, 12)}),
    Variant("donut", "plain", {"categorical_series": 0.55}, {"part_to_whole": True, "categories": (2, 12)}),
    Variant("scatter", "plain", {"numeric_relationship": 0.9, "detail_rows": 0.5}, {"measures": (2, None)}),
    Variant("bubble", "plain", {"numeric_relationship": 0.7}, {"measures": (3, None)}),
    Variant("radar", "plain", {"categorical_series": 0.4}, {"measures": (3, 8)}),
    Variant("heatmap", "matrix", {"categorical_matrix": 0.9}, {"matrix": True}, "matrix_aggregate"),
    Variant("boxplot", "summary", {"detail_rows": 0.8}, {"grouped_samples": True}, "boxplot_summary"),
    Variant("gauge", "plain", {"single_value": 0.7}, {"measures": (1, 1)}),
    Variant("combo", "plain", {"temporal_series": 0.5, "categorical_series": 0.45}, {"measures": (2, 2)}),
)
RECOMMENDED = 0.6


def matches(traits: dict, needs: dict) -> bool:
    """Whether traits meet needs: a flag, a text, or a range whose ends may be open. A trait that is missing meets none."""
    for name, need in needs.items():
        have = traits.get(name)
        if isinstance(need, tuple):
            if not isinstance(have, (int, float)) or isinstance(have, bool) or have != have or abs(have) == float("inf"):
                return False
            if need[0] is not None and have < need[0] or need[1] is not None and have > need[1]:
                return False
        elif have != need:
            return False
    return True


def plans(archetype: str, traits: dict, wanted: str | None = None, types: frozenset[str] | None = None) -> list[tuple[float, Variant]]:
    """Variants that fit, the most suitable first. A type that was asked for gains a little, within 0 to 1."""
    found = []
    for v in VARIANTS:
        if archetype in v.suits and (types is None or v.chart in types) and matches(traits, v.needs):
            found.append((min(1.0, max(0.0, v.suits[archetype] + (0.1 if v.chart == wanted else 0))), v))
    return sorted(found, key=lambda x: -x[0])


def choose(found: list[tuple[float, Variant]], user: str | None = None, model: str | None = None, dashboard: str | None = None) -> Variant | None:
    """The variant to draw: the user's type, else the model's, else the dashboard's, else the best if it is recommended."""
    for want in (user, model, dashboard):
        for _, v in found:
            if want and v.chart == want:
                return v
    return found[0][1] if found and found[0][0] >= RECOMMENDED else None
