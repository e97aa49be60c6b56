"""What may be asked of which series. Violations raise ValueError before any plan is built."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from tritempo.functions.catalogcols import normalize_category

#: offending ids that a message names
NAMED_IDS = 20


class Rule(NamedTuple):
    """Where a feature exists: its categories, and what a request that uses it must not have."""

    categories: frozenset[str]
    without: frozenset[str] = frozenset()


RULES = {
    "shape": Rule(frozenset({"curves"}), frozenset({"versioned"})),
    "aggregation": Rule(frozenset({"curves"})),
    "rank_over": Rule(frozenset({"curves", "surfaces"}), frozenset({"aggregation", "versioned", "archived"})),
}


def check_request(
    category: str,
    *,
    shape: bool = False,
    aggregation: bool = False,
    rank_over: bool = False,
    versioned: bool = False,
    archived: bool = False,
) -> None:
    """Checks a request of one category against ``RULES`` and names everything that is wrong with it."""
    flags = {"shape": shape, "aggregation": aggregation, "rank_over": rank_over, "versioned": versioned, "archived": archived}
    asked = {name for name, on in flags.items() if on}
    wrong = []
    for name in sorted(asked & RULES.keys()):
        rule = RULES[name]
        if category not in rule.categories:
            wrong.append(f"{name} is not available for {category}")
        wrong += [f"{name} does not go with {other}" for other in sorted(asked & rule.without)]
    if wrong:
        raise ValueError("; ".join(wrong))


def check_category(series: DataFrame, category: str) -> None:
    """Every series must be of the category; series whose category is unknown pass."""
    strays = series.filter(normalize_category("category") != category).select("series_id").distinct()
    count = strays.count()
    if count:
        lowest = [str(row.series_id) for row in strays.orderBy("series_id").limit(NAMED_IDS).collect()]
        more = f" and {count - len(lowest)} more" if count > len(lowest) else ""
        raise ValueError(f"{count} series are not {category}: {', '.join(lowest)}{more}")
