"""Claims and district gaps end to end, and the inspection report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLAIM_FIELDS, GAP_FIELDS, NEEDS, PLACES, TAXONOMY, Need, Places, Taxonomy
from ..functions import blank_to_null, present, strip
from ..operators.enrich import infer_location
from ..operators.evidence import coverage, extract_claims
from ..operators.quality import gate, profile, report, top_counts
from ..operators.review import demo_candidates, of_type
from ..operators.rollup import samples_per_group
from ..operators.scoring import score_gaps
from ..session import cut_lineage
from ..sources.writers import write_table
from .records import records_from


def claims_and_gaps(
    records: DataFrame,
    taxonomy: Taxonomy = TAXONOMY,
    needs: Sequence[Need] = NEEDS,
    places: Places = PLACES,
    as_of: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(claims, gaps) of validated records, lazily."""
    located = infer_location(records, places)
    claims = extract_claims(located, taxonomy, as_of)
    return claims, score_gaps(located, claims, needs, places, as_of)


def run_all(
    source: DataFrame,
    claims_target: str,
    gaps_target: str,
    districts: DataFrame | None = None,
    needs: Sequence[Need] = NEEDS,
    taxonomy: Taxonomy = TAXONOMY,
    places: Places = PLACES,
    skip_validation: bool = False,
    as_of: Column | None = None,
) -> dict[str, int]:
    """Validate, locate, extract, score and write both tables.

    The records are stored once and checked as stored, the located ones once for claims and scores. The texts are searched once: the gaps
    are scored from the written claims.
    """
    records = records_from(source, districts, places)
    if not skip_validation:
        records = cut_lineage(records)
        gate(report(records))
    located = cut_lineage(infer_location(records, places))
    write_table(extract_claims(located, taxonomy, as_of).select(*CLAIM_FIELDS), claims_target)
    stored = _stored(source.sparkSession, claims_target)
    write_table(score_gaps(located, stored, needs, places, as_of).select(*GAP_FIELDS), gaps_target, ["care_need"])
    return {"claims": stored.count(), "gaps": _stored(source.sparkSession, gaps_target).count()}


def _stored(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if "/" in target else spark.table(target)


def inspect_records(
    records: DataFrame, need: Need = NEEDS[0], taxonomy: Taxonomy = TAXONOMY, places: Places = PLACES, samples: int = 3
) -> dict[str, object]:
    """Coverage report of a record table: small frames, one per section. Claims are extracted once."""
    located = infer_location(records, places)
    claims = cut_lineage(extract_claims(located, taxonomy))
    wanted = claims.where(F.col("capability").isin(*need.capabilities))
    districts = of_type(records, "district")
    return {
        "validation": report(records),
        "descriptions": profile(of_type(located, "facility"), ["description", "state", "city", "pincode", "district"], "description"),
        "source_districts": profile(of_type(records, "facility"), ["district"]),
        "coverage": coverage(claims, taxonomy).orderBy("position"),
        "by_state": top_counts(wanted, ["state"], 12),
        "by_location": top_counts(wanted, ["district_or_city", "state"], 12),
        "samples": samples_per_group(wanted, ["capability"], ["facility_id"], samples),
        "candidates_without_claims": demo_candidates(districts, wanted, max_claims=0),
        "candidates_with_claims": demo_candidates(districts, wanted, min_claims=1),
    }


def inspection(records: DataFrame, need: Need = NEEDS[0], taxonomy: Taxonomy = TAXONOMY, places: Places = PLACES, top: int = 12) -> DataFrame:
    """The figures of an inspection as one row set (section, item, value).

    ``records`` are rows by type, ``present`` facilities with a value in a field (``source_district`` before the location was inferred),
    ``text`` the median and the short descriptions, ``coverage`` facilities for each capability, ``state`` and ``place`` the ``top`` most
    frequent ones among the claims of ``need``. One aggregate over the records and one, with grouping sets, over the claims.
    """
    facility = F.coalesce(F.col("record_type") == "facility", F.lit(False))
    given = records.withColumn("_given", present(F.col("district")))
    located = cut_lineage(infer_location(given, places))
    size = F.when(facility, F.coalesce(F.length(strip(F.col("description"))), F.lit(0)))
    figures = {
        ("records", "rows"): F.count(F.lit(1)), ("records", "facility"): F.count_if(facility), ("records", "district"): F.count_if(F.col("record_type") == "district"),
        **{("present", c): F.count_if(facility & present(F.col(c))) for c in ("description", "state", "city", "pincode", "district")},
        ("present", "source_district"): F.count_if(facility & F.col("_given")),
        ("text", "median_length"): F.coalesce(F.percentile(size, 0.5), F.lit(0.0)), ("text", "short"): F.count_if((size > 0) & (size < 40)),
    }
    row = located.agg(*[value.cast("double").alias(f"f{k}") for k, value in enumerate(figures.values())])
    shown = row.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), F.col(f"f{k}").alias("value")) for k, (s, i) in enumerate(figures)])))

    named = lambda c: F.coalesce(blank_to_null(strip(F.col(c))), F.lit("Unknown")).alias(c)
    claims = extract_claims(located.drop("_given"), taxonomy).select("facility_id", "capability", named("state"), named("district_or_city"))
    by = {"coverage": ["capability"], "state": ["state"], "place": ["state", "district_or_city"]}
    keys = ["capability", "state", "district_or_city"]
    number = {section: sum((c not in columns) << (2 - k) for k, c in enumerate(keys)) for section, columns in by.items()}  # of its grouping set
    # The capability is a key of its own set only, so what is counted comes from a copy.
    sets = claims.withColumn("_wanted", F.col("capability").isin(*need.capabilities)).groupingSets([[F.col(c) for c in columns] for columns in by.values()], *keys)
    counted = cut_lineage(sets.agg(F.grouping_id().alias("_set"), F.countDistinct("facility_id").alias("facilities"), F.count_if("_wanted").alias("rows")))
    of = lambda section: counted.where(F.col("_set") == number[section])
    listed = located.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in taxonomy.keys])).alias("capability"))
    covered = listed.join(of("coverage").select("capability", "facilities"), "capability", "left")
    parts = [shown, covered.select(F.lit("coverage").alias("section"), F.col("capability").alias("item"), F.coalesce("facilities", F.lit(0)).cast("double").alias("value"))]
    for section, item in (("state", F.col("state")), ("place", F.concat_ws(", ", "district_or_city", "state"))):
        best = of(section).where("rows > 0").select(F.lit(section).alias("section"), item.alias("item"), F.col("rows").cast("double").alias("value"))
        parts.append(best.orderBy(F.desc("value"), "item").limit(top))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
