"""Text and number clean-up as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NAME_STOPWORDS

# (?U): \s covers the Unicode spaces as well, not just ASCII.
_OUTER_SPACE = r"(?U)^\s+|\s+$"
_ANY_SPACE = r"(?U)\s+"
# Runs of blanks and blanks other than the space: what must change to leave single spaces only. A text without them is not rebuilt.
_UNEVEN_BLANKS = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"


def blank_to_null(value: Column) -> Column:
    """Empty text becomes NULL.

    Names ``value`` once: filters are pushed through projections by substitution, so building
    blocks that repeat their input would grow exponentially when they are nested.
    """
    return F.try_element_at(F.array_remove(F.array(value), ""), F.lit(1))


def clean(value: Column) -> Column:
    """Collapse blanks and trim; blank, ``nan`` and ``null`` become NULL."""
    text = F.trim(F.regexp_replace(value.cast("string"), _UNEVEN_BLANKS, " "))
    return blank_to_null(F.regexp_replace(text, "(?i)^(?:nan|null)$", ""))


def squeeze(value: Column) -> Column:
    """Collapse blanks and trim, NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), _ANY_SPACE, " "))


def strip(value: Column) -> Column:
    """Drop outer blanks only, NULL becomes the empty string."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), _OUTER_SPACE, "")


def present(value: Column) -> Column:
    """True where there is text other than blanks."""
    return strip(value) != ""


def parse_double(value: Column) -> Column:
    """First signed decimal in the text, thousands commas dropped: ``"(18.0)"`` gives 18.0."""
    number = F.regexp_extract(F.replace(value.cast("string"), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return number.try_cast("double")


def strict_double(value: Column) -> Column:
    """The whole text as a number, thousands commas dropped; NULL when it is not one."""
    return F.replace(value.cast("string"), F.lit(","), F.lit("")).try_cast("double")


def to_long(value: Column) -> Column:
    """Served integer: truncated towards zero, 0 when absent or not a number."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0)).try_cast("long")


def digits_key(value: Column) -> Column:
    """Digits only, NULL when there are none."""
    return blank_to_null(F.regexp_replace(clean(value), r"[^0-9]", ""))


def name_key(value: Column) -> Column:
    """Join key of a name: lower case, every run of other characters one blank, NULL when empty."""
    return blank_to_null(lookup_key(clean(value)))


def lookup_key(value: Column) -> Column:
    """The same key for looking up a label; no label goes by a blank key, so there is no NULL to make."""
    return F.lower(F.trim(F.regexp_replace(value, r"[^A-Za-z0-9]+", " ")))


def json_name(value: Column) -> Column:
    """``$.name`` where the text is a JSON object, else the text."""
    return F.coalesce(F.get_json_object(value, "$.name"), value)


def first_of_list_text(value: Column) -> Column:
    """First element of a JSON list held as text; text that is not such a list stays as it is."""
    text = squeeze(value)
    items = F.from_json(text, "array<string>")
    return (
        F.when(~text.startswith("["), text)
        .when(items.isNull(), text)
        .otherwise(F.coalesce(F.try_element_at(items, F.lit(1)), F.lit("")))
    )


def first_quoted(value: Column) -> Column:
    """First double-quoted string in the text, NULL when there is none."""
    return blank_to_null(F.regexp_extract(value, '"([^"]+)"', 1))


def join_clean(separator: str, *values: Column) -> Column:
    """Cleaned parts joined; an absent part keeps its separator."""
    return F.concat_ws(separator, *[F.coalesce(clean(v), F.lit("")) for v in values])


def coalesce_blank(*values: Column) -> Column:
    """First trimmed value that is not blank; the last value is taken as it is."""
    *first, last = values
    return F.coalesce(*[blank_to_null(F.trim(v)) for v in first], last)


def without_nul(value: Column) -> Column:
    return F.replace(value, F.lit("\u0000"), F.lit(""))


def name_tokens(value: Column, stopwords: Iterable[str] = NAME_STOPWORDS) -> Column:
    """Distinct lower-case alphanumeric words longer than two characters, stop words dropped."""
    words = F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(stopwords)]))


def no_shared_token(name: Column, text: Column) -> Column:
    """True where the name has tokens and the text shares none of them."""
    tokens = name_tokens(name)
    return (F.size(tokens) > 0) & ~F.arrays_overlap(tokens, name_tokens(text))


def fmt1(value: Column) -> Column:
    """One-decimal text as C and Python print it: nearest on the exact binary value, ties to even.

    ``format_string`` and ``round`` work half up on the shortest decimal form, which differs on
    values such as 0.25 or 12.45.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0.0"))


def round1(value: Column) -> Column:
    """One-decimal number, rounded as :func:`fmt1` does."""
    return fmt1(value).cast("double")


def pct(value: Column) -> Column:
    """``12.3%``, or ``missing``."""
    return F.coalesce(F.concat(fmt1(value), F.lit("%")), F.lit("missing"))
