import threading

import pytest
from pyspark.sql import functions as F

from needmap.operators.quality import GateError
from needmap.plans import enriched as E
from needmap.plans import gaps as G
from needmap.plans import records as P
from needmap.sources import readers as rd
from needmap.sources import writers as wr


@pytest.fixture(scope="module")
def enriched(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("enriched") / "t")
    wr.write_table(E.enrich(*raw), path)
    return rd.read_table(spark, path)


def test_csv_quotes_breaks_and_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,text\r\n1,"two\nlines, ""quoted"""\r\n2,\r\n'.encode())
    rows = rd.read_csv(spark, str(path)).collect()
    assert rows[0].asDict() == {"id": "1", "text": 'two\nlines, "quoted"'} and rows[1]["text"] is None


def test_csv_round_trip_of_arrays(spark, enriched, tmp_path):
    wr.write_csv(enriched, str(tmp_path / "e"), parts=1)
    back = rd.read_csv(spark, str(tmp_path / "e"))
    assert back.where("pincode_key = '753001'").first()["pincode_office_names"] == '["BO","HO","SO"]'


def test_mirror(spark, enriched, tmp_path):
    df = enriched.withColumn("description", F.concat("description", F.lit("\u0000")))
    assert wr.mirror(df, str(tmp_path / "m")) == 4
    back = spark.read.parquet(str(tmp_path / "m"))
    assert len(back.columns) == 26 and back.where(F.col("description").contains("\u0000")).count() == 0


def test_discovery(spark, raw):
    spark.sql("CREATE DATABASE IF NOT EXISTS disc")
    for name, df in zip(("fac", "pin"), raw):
        df.write.mode("overwrite").saveAsTable(f"disc.{name}")
    raw[2].withColumnsRenamed({"child_u5_who_are_stunted_height_for_age_18_pct": "stunting_pct", "all_w15_49_who_are_anaemic_pct": "anaemia_pct"}).write.mode("overwrite").saveAsTable("disc.dist")
    assert rd.discover_tables(spark, "disc") == {"facility": "`disc`.`fac`", "pincode": "`disc`.`pin`", "district": "`disc`.`dist`"}
    assert rd.discover_tables(spark, "disc", district="pin")["district"] == "`disc`.`pin`"
    with pytest.raises(ValueError):
        rd.best_table({"a": ["x"]}, "facility")


def test_first_available(spark, raw):
    got = rd.first_available(table=lambda: spark.table("nowhere"), file=lambda: raw[1])
    assert got.first()["source"] == "file"
    with pytest.raises(ValueError):
        rd.first_available(table=lambda: spark.table("nowhere"))


def test_publish_is_a_dry_run_until_applied(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS pub")
    spark.range(3).write.mode("overwrite").saveAsTable("pub.live")
    new = spark.range(5)
    assert wr.publish_candidate(new, "pub.live")["rows"] == 5 and spark.table("pub.live").count() == 3

    def refuse(stored):
        raise GateError("no")

    with pytest.raises(GateError):
        wr.publish_candidate(new, "pub.live", refuse, apply=True)
    done = wr.publish_candidate(new, "pub.live", apply=True)
    assert spark.table("pub.live").count() == 5 and spark.table(done["backup"]).count() == 3
    # From here on the name is a view over versions, turned in one statement.
    again = wr.publish_candidate(spark.range(7).withColumn("more", F.lit(1)), "pub.live", apply=True)
    assert spark.table("pub.live").columns == ["id", "more"] and spark.table("pub.live").count() == 7
    assert again["backup"] == done["candidate"] and spark.table(again["backup"]).count() == 5
    assert wr.publish_candidate(new, "pub.live")["backup"] is None and spark.table("pub.live").count() == 7
    with pytest.raises(GateError):
        wr.publish_candidate(new, "pub.live", refuse, apply=True)
    assert wr.live_version(spark, "pub.live") == again["candidate"]
    named = wr.publish_candidate(new, "pub.live", apply=True, backup="pub.before")
    assert named["backup"] == "pub.before" and spark.table("pub.before").count() == 7 and spark.table("pub.live").count() == 5
    wr.restore_version(spark, "pub.live", again["candidate"])
    assert spark.table("pub.live").count() == 7


def test_a_reader_always_finds_the_published_name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS pub")
    wr.publish_candidate(spark.range(4), "pub.always", apply=True)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(spark.table("pub.always").count())
            except Exception as failure:
                seen.append(failure)

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(3):
        wr.publish_candidate(spark.range(4), "pub.always", apply=True)
    stop.set()
    reader.join()
    assert seen and set(seen) == {4}


def test_run_all(spark, enriched, tmp_path):
    claims, gaps = str(tmp_path / "claims"), str(tmp_path / "gaps")
    with pytest.raises(GateError):  # the ids of duplicates are not facility:<uuid>
        G.run_all(enriched, claims, gaps)
    got = G.run_all(enriched, claims, gaps, skip_validation=True)
    assert got["gaps"] == 2 * 3
    lazy_claims, lazy_gaps = G.claims_and_gaps(P.records_from(enriched))
    assert lazy_claims.count() == got["claims"]
    drop = "updated_at"
    assert sorted(map(str, lazy_gaps.drop(drop).collect())) == sorted(map(str, spark.read.parquet(gaps).select(*lazy_gaps.drop(drop).columns).collect()))
    loaded = wr.load_prepared(spark.read.parquet(claims), spark.read.parquet(gaps), str(tmp_path / "c2"), str(tmp_path / "g2"))
    assert loaded == got
    assert dict(spark.read.parquet(str(tmp_path / "g2")).dtypes)["risk_score"] == "decimal(5,1)"
    with pytest.raises(GateError):
        wr.load_prepared(spark.read.parquet(claims).withColumn("state", F.lit(None).cast("string")), lazy_gaps, str(tmp_path / "c3"), str(tmp_path / "g3"))


def test_inspection(enriched):
    found = G.inspect_records(P.records_from(enriched))
    assert found["descriptions"].first()["rows"] == 4
    assert {r["capability"]: r["facilities"] for r in found["coverage"].collect()}["nicu"] == 1
    assert found["samples"].count() > 0 and found["candidates_with_claims"].count() == 1


def test_export(spark, raw, tmp_path):
    valid, _ = P.rebuild_records(*raw)
    with pytest.raises(GateError):  # no such record type
        wr.export_snapshot(valid.withColumn("record_type", F.lit("odd")), str(tmp_path / "x"))
    assert wr.export_snapshot(valid.where("record_type <> 'facility'"), str(tmp_path / "y"))["errors"] == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for name, rows in (("a", 900), ("b", 1), ("c", 0), ("d", 333)):
        (folder / f"{name}.csv").write_text("id,text\n" + "".join(f"{k},value {k} of {name}\n" for k in range(rows)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rd.read_csv_lines(spark, str(folder), breaks=False)
        assert got.select("source_file", "source_line_number").distinct().count() == 1234
        split = [(r.source_file[-5], int(r.id), r.source_line_number) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(split) == sorted((name, k, k + 2) for name, rows in (("a", 900), ("b", 1), ("d", 333)) for k in range(rows))
    (tmp_path / "one.csv").write_text('\ufeffid,text\n1,"two\nlines"\n2,"a ""word"""\n')
    assert [(r.id, r.text, r.source_line_number) for r in rd.read_csv_lines(spark, str(tmp_path / "one.csv"), first=1).collect()] == [("1", "two\nlines", 1), ("2", 'a "word"', 2)]


def test_export_files_follow_each_other_in_order(spark, raw, tmp_path):
    rows = P.union_records(P.facility_records(raw[0]), P.pincode_records(raw[1]), P.district_records(raw[2]))
    wr.export_snapshot(rows.repartition(7), str(tmp_path / "out"), validate=False)
    seen = []
    for file in sorted((tmp_path / "out").glob("part-*.csv")):
        seen += [(r.record_type or "", r.record_id or "") for r in rd.read_csv(spark, str(file)).collect()]
    assert seen == sorted(seen) and len(seen) == rows.count()
