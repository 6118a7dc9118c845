"""Round trips through the sources and sinks, in a fresh folder of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from needmap.operators.columns import resolve, resolve_scalar
from needmap.sources.readers import best_table, first_available, read_csv, read_table
from needmap.session import shared_folder
from needmap.sources.writers import GAPS_SCHEMA, typed, write_csv, write_fixed, write_table

from .evidence_queries import GAPS, document_gaps
from .registry import Tables, query, with_ctes

C = F.col


def _folder(t: Tables) -> str:
    return shared_folder(t.spark, f"needmap-{uuid.uuid4().hex}")


@query("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, text, lang, source FROM documents")
def csv_round_trip(t):
    path = _folder(t) + "/documents"
    write_csv(t.documents.select("doc_id", "text", "lang", "source"), path)
    return read_csv(t.spark, path)


@query("csv_fixed_columns", "SELECT c_name, c_custkey::VARCHAR AS c_custkey FROM customer")
def csv_fixed_columns(t):
    path = _folder(t) + "/customer"
    write_fixed(t.customer, path, ["c_name", "c_custkey"])
    return read_csv(t.spark, path, ["c_name", "c_custkey"])


@query("csv_arrays", "SELECT vec_id::VARCHAR AS vec_id, len(embedding)::INT AS dimensions FROM embeddings")
def csv_arrays(t):
    path = _folder(t) + "/embeddings"
    write_csv(t.embeddings.select("vec_id", "embedding"), path)
    return read_csv(t.spark, path).select("vec_id", F.size(F.from_json("embedding", "array<double>")).alias("dimensions"))


@query("table_round_trip", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def table_round_trip(t):
    path = _folder(t) + "/lineitem"
    write_table(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), path, ["l_returnflag"])
    return read_table(t.spark, path)


@query("typed_gaps", with_ctes("""
SELECT district_id, care_need, planning_priority_score::DECIMAL(5,1)::DOUBLE AS planning_priority_score, relevant_claims::INT AS relevant_claims FROM gaps""", **GAPS))
def typed_gaps(t):
    rows = typed(document_gaps(t), GAPS_SCHEMA)
    return rows.select("district_id", "care_need", C("planning_priority_score").cast("double").alias("planning_priority_score"), "relevant_claims")


@query("first_available", "SELECT n_nationkey, n_name, 'directory' AS source FROM nation")
def available(t):
    return first_available(
        enriched=lambda: read_table(t.spark, f"{t.folder}/no_such_table.parquet"),
        directory=lambda: t.nation.select("n_nationkey", "n_name"),
    )


@query("resolve_columns", """
SELECT p_partkey, p_name AS name, p_brand AS brand, NULL::VARCHAR AS phone, NULL::VARCHAR AS tags FROM part""")
def resolve_columns(t):
    renamed = t.part.withColumnRenamed("p_name", "Facility-Name").withColumnRenamed("p_brand", "operator_TYPE")
    return renamed.select(
        "p_partkey", resolve(renamed, ["entity_name", "facility_name"]).alias("name"),
        resolve(renamed, ["operatorTypeId", "operatortype"]).alias("brand"),
        resolve_scalar(renamed, ["phone", "mobile"]).alias("phone"), resolve(renamed, ["tags"]).alias("tags"),
    )


@query("resolve_nested", """
SELECT vec_id, embedding[1]::DOUBLE AS first_value, len(embedding) AS joined_parts FROM embeddings""")
def resolve_nested(t):
    parts = F.size(F.split(resolve(t.embeddings, ["embedding"]), "; "))
    return t.embeddings.select(
        "vec_id", resolve_scalar(t.embeddings, ["Embedding"]).cast("float").cast("double").alias("first_value"), parts.cast("long").alias("joined_parts")
    )


@query("discover_tables", """
SELECT 'pincode' AS role, count(*) AS rows FROM orders UNION ALL SELECT 'facility', count(*) FROM customer UNION ALL
SELECT 'district', count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)""")
def discover(t):
    from . import sources as src

    named = {"child_u5_who_are_stunted_height_for_age_18_pct": "stunting_pct", "all_w15_49_who_are_anaemic_pct": "anaemia_pct"}
    frames = {"a": src.districts(t).withColumnsRenamed(named), "b": src.facilities(t), "c": src.directory(t)}
    schemas = {name: frame.columns for name, frame in frames.items()}
    found = [
        frames[best_table(schemas, role)].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(role).alias("role"), "rows")
        for role in ("facility", "pincode", "district")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])
