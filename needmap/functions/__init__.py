"""Column -> Column building blocks, all on built-in Spark functions."""

from .keys import location_key, record_hash, row_signature, salted_key, stable_uuid, valid_uuid
from .labels import (
    band, canonical, canonical_in_scope, clamp, label_weight, listing_sentence, normalize_category, optional_eq,
    quality_flags, rank_label, weighted_mean_present,
)
from .text import (
    blank_to_null, clean, coalesce_blank, digits_key, first_of_list_text, first_quoted, fmt1, join_clean, json_name, lookup_key, name_key,
    name_tokens, no_shared_token, parse_double, pct, present, round1, squeeze, strict_double, strip, to_long,
    without_nul,
)

__all__ = [n for n in dir() if not n.startswith("_")]
