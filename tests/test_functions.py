import random

import pytest
from pyspark.sql import functions as F

from needmap import config as cfg
from needmap import functions as N


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


X = "x"


@pytest.mark.parametrize(
    "name, value, want",
    [
        ("clean", "  A   b ", "A b"), ("clean", "NaN", None), ("clean", "", None), ("clean", " null ", None), ("clean", None, None),
        ("parse_double", "(18.0)", 18.0), ("parse_double", "1,234.5", 1234.5), ("parse_double", "-", None), ("parse_double", "1e3", 1.0),
        ("strict_double", "1,234.5", 1234.5), ("strict_double", "(18.0)", None),
        ("digits_key", "560 001", "560001"), ("digits_key", "n/a", None),
        ("name_key", "Jammu & Kashmir", "jammu kashmir"), ("name_key", "--", None), ("name_key", None, None),
        ("canonical", "Orissa", "Odisha"), ("canonical", "U.P.", "Uttar Pradesh"), ("canonical", "Atlantis", None),
        ("first_of_list_text", '["a.org","b.org"]', "a.org"), ("first_of_list_text", "[]", ""),
        ("first_of_list_text", "[bad", "[bad"), ("first_of_list_text", " a.org ", "a.org"),
        ("json_name", '{"name": "A"}', "A"), ("json_name", "plain", "plain"),
        ("squeeze", "  a \t b", "a b"), ("strip", None, ""), ("pct", None, "missing"), ("to_long", "-2.9", -2), ("to_long", "x", 0),
    ],
)
def test_scalars(spark, name, value, want):
    assert one(spark, getattr(N, name)(F.col(X)), value) == want


@pytest.mark.parametrize("state, name, want", [("Karnataka", "Mysuru", "Mysore"), ("Kerala", "Mysuru", "Mysuru"), ("orissa", " Puri ", "Puri"), (None, None, "")])
def test_canonical_in_scope(spark, state, name, want):
    assert one(spark, N.canonical_in_scope(F.lit(state).cast("string"), F.col(X)), name) == want


@pytest.mark.parametrize(
    "value, want",
    [("Nursing Home", "hospital"), ("nursing_home", "nursing_home"), ("Laboratory", "clinic"), ("spa", "spa"), (None, None)],
)
def test_category(spark, value, want):
    assert one(spark, N.normalize_category(F.col(X), cfg.FACILITY_TYPE_RULES), value) == want


def test_one_decimal_is_the_c_rounding(spark):
    rng = random.Random(5)
    values = [0.25, 0.15, 12.45, 0.05, 99.95, 2.5, 0.35, 66.65, -0.04, -0.25, 100.0, 0.0]
    values += [round(rng.uniform(0, 100), 2) for _ in range(3000)] + [rng.uniform(-5, 100) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", N.fmt1(F.col("x")).alias("t"), N.round1(F.col("x")).alias("r")).collect()
    assert [r["t"] for r in rows] == [f"{v:.1f}" for v in values]
    assert [r["r"] for r in rows] == [float(f"{v:.1f}") for v in values]


def test_weighted_mean(spark):
    a, b = F.col("x"), F.lit(None).cast("double")
    assert one(spark, N.weighted_mean_present([(a, 0.5), (b, 0.5)]), 30.0, "double") == 30.0
    assert one(spark, N.weighted_mean_present([(b, 0.5)]), 30.0, "double") == 50.0
    assert one(spark, N.weighted_mean_present([(a, 1.0)]), 130.0, "double") == 100.0


def test_tokens(spark):
    assert sorted(one(spark, N.name_tokens(F.col(X)), "The Asha-24 Hospital of asha in up")) == ["asha"]
    assert one(spark, N.no_shared_token(F.col(X), F.lit("a city lab")), "Asha") is True
    assert one(spark, N.no_shared_token(F.col(X), F.lit("a city lab")), "of the") is False


def test_null_keys_are_spread(spark):
    rows = spark.range(2000).withColumn("k", F.lit(None).cast("string"))
    assert rows.select(N.salted_key(F.col("k"), F.col("id")).alias("s")).distinct().count() > 200
    assert one(spark, N.salted_key(F.col(X), F.col(X)), "753001") == "753001"


def test_clean_levels_all_blanks_and_leaves_even_text(spark):
    import re

    texts = ["a b", "a  b", "\ta\x0bb\n", "a\r\nb", " \t ", "x\u00a0 \u00a0y", "nan", " NULL\n", "a \f b\tc", "null x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.clean(F.col("t")).alias("c")).collect()
    level = lambda t: None if t is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")
    assert [r.c for r in rows] == [None if not level(t) or level(t).lower() in ("nan", "null") else level(t) for t in texts]
