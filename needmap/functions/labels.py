"""Labels, lookups and weights."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PLACES, Places
from .text import clean, lookup_key, squeeze


def _lookup(table: Mapping, kind: str) -> Column:
    """A configuration table as a map constant. One node to analyse; the optimizer folds it to a literal."""
    return F.from_json(F.lit(json.dumps(table)), kind)


def canonical(value: Column, aliases: Mapping[str, str] = PLACES.states) -> Column:
    """Canonical label of a spelling, NULL when the spelling is unknown."""
    return F.try_element_at(_lookup(aliases, "map<string,string>"), lookup_key(value))


def canonical_or_self(value: Column, aliases: Mapping[str, str] = PLACES.states) -> Column:
    return F.coalesce(canonical(value, aliases), value)


def canonical_in_scope(scope: Column, value: Column, places: Places = PLACES) -> Column:
    """Canonical label of a name inside its scope (district in its state), else the squeezed input."""
    label = F.coalesce(canonical(scope, places.states), squeeze(scope))
    by_scope = _lookup(places.districts, "map<string,map<string,string>>")
    return F.coalesce(F.try_element_at(F.try_element_at(by_scope, label), lookup_key(value)), squeeze(value))


def normalize_category(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern hits the lower-cased text, else that text."""
    text = F.lower(clean(value))
    first_hit = [F.when(text.rlike(pattern), F.lit(label)) for pattern, label in rules]
    return F.coalesce(*first_hit, text)


def listing_sentence(name: Column, kind: Column, operator: Column, *place: Column) -> Column:
    """Fallback description: ``X is listed as a private hospital in city, state, pin.``"""
    kind_text = F.replace(kind, F.lit("_"), F.lit(" "))
    what = F.coalesce(
        F.concat(operator, F.lit(" "), kind_text), kind_text, F.concat(operator, F.lit(" health facility")),
        F.lit("health facility"),
    )
    where = F.concat(F.lit(" in "), clean(F.concat_ws(", ", *place)))
    return F.concat(name, F.lit(" is listed as a "), what, F.coalesce(where, F.lit("")), F.lit("."))


def quality_flags(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, piped."""
    return F.concat_ws("|", *[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def label_weight(value: Column, weights: Mapping, default) -> Column:
    """Number that goes with a label."""
    return F.coalesce(*[F.when(value == label, F.lit(weight)) for label, weight in weights.items()], F.lit(default))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def weighted_mean_present(terms: Sequence[tuple[Column, float]], neutral: float = 50.0) -> Column:
    """Mean over the terms that have a value, weights renormalised; ``neutral`` when none has."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x * F.lit(w), F.lit(0.0)) for x, w in terms])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in terms])
    return F.when(weight > 0, clamp(total / weight)).otherwise(F.lit(neutral))


def band(value: Column, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the highest threshold reached."""
    return F.coalesce(*[F.when(value >= F.lit(low), F.lit(label)) for low, label in bands], F.lit(default))


def rank_label(value: Column, order: Sequence[str] = ("strong", "partial", "weak")) -> Column:
    """Rank of a label, the first of ``order`` highest, 0 for any other."""
    return label_weight(value, {label: len(order) - i for i, label in enumerate(order)}, 0)


def optional_eq(column: Column, value: str, any_value: str = "all") -> Column | None:
    """Equality, or no predicate at all when the caller asks for everything."""
    return None if value == any_value else column == F.lit(value)


