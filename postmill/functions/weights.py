"""Region, trust and role weights of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import row_text, strip
from postmill.values import AI_ROLES, PATH_LABELS, PATH_WEIGHT, PATHS, REGION_NAMES, REGION_WEIGHTS, ROLE_WEIGHTS, SOFTWARE_ROLES, TRUSTED_WEIGHT, words


def region(text: Column | None = None) -> Column:
    """The first of the regions, heaviest penalty first, that the posting names; neutral without one."""
    t = row_text() if text is None else text
    found = None
    for name in ("heavily_deweighted", "highly_preferred", "preferred", "deweighted"):
        hit = t.rlike(words(REGION_NAMES[name]))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.when(strip(t) == "", "neutral").otherwise(found.otherwise("neutral"))


def _weight(value: Column, weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in weights.items() for x in item]), value)


def region_weight(text: Column | None = None) -> Column:
    return _weight(region(text), REGION_WEIGHTS)


def trust_weight(trusted: Column) -> Column:
    return F.when(F.coalesce(trusted, F.lit(False)), TRUSTED_WEIGHT).otherwise(1.0)


def role_tier(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.when(strip(t) == "", "other").when(t.rlike(words(AI_ROLES)), "ai").when(t.rlike(words(SOFTWARE_ROLES)), "swe").otherwise("other")


def matches_paths(title: Column, paths: Column) -> Column:
    """Whether the title fits any of the user's career paths; unknown ones are ignored."""
    t = F.coalesce(title, F.lit(""))
    hits = F.lit(False)
    for name, patterns in PATHS.items():  # one literal pattern per path, compiled once
        hits = hits | (F.array_contains(paths, name) & t.rlike(words(patterns)))
    return F.coalesce(hits, F.lit(False))


def role_weight(title: Column, paths: Column | None = None) -> Column:
    tier = _weight(role_tier(title), ROLE_WEIGHTS)
    if paths is None:
        return tier
    return F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, F.when(matches_paths(title, paths), PATH_WEIGHT).otherwise(1.0)).otherwise(tier)


def combined_weight(title: Column, trusted: Column, paths: Column | None = None, text: Column | None = None) -> Column:
    return region_weight(text) * trust_weight(trusted) * role_weight(title, paths)


def path_labels(paths: Column) -> Column:
    known = F.create_map(*[F.lit(x) for item in PATH_LABELS.items() for x in item])
    return F.array_join(F.transform(paths, lambda p: F.coalesce(F.try_element_at(known, p), F.initcap(F.replace(p, F.lit("_"), F.lit(" "))))), ", ")


def known_paths(paths: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.array_distinct(paths), lambda p: p.isin(*PATHS)), 1, most)
