"""Readers, sinks, incremental runs and whole jobs on the small tables."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from areaflow.catalog import connectedness_queries as CQ
from areaflow.catalog import dwell_queries as DQ
from areaflow.catalog import geo_queries as GQ
from areaflow.catalog import mobility_queries as MQ
from areaflow.catalog import network_queries as NQ
from areaflow.catalog import panel_queries as PQ
from areaflow.catalog import views as V
from areaflow.functions.columns import category_rank
from areaflow.plans import jobs
from areaflow.sources import readers, sinks
from areaflow.streaming.incremental import aggregate_new_files


def test_day_from_the_file_name(spark, tmp_path):
    for d in ("2019-01-01", "2019-01-03", "2019-02-01"):
        spark.createDataFrame([(1, 2)], "a_id long, b_id long").toPandas().to_parquet(tmp_path / f"voice_{d}_parquet.gzip")
    spark.createDataFrame([(9,)], "x long").toPandas().to_parquet(tmp_path / "sms_2019-01-01.parquet")
    df = readers.read_daily(spark, str(tmp_path), ["a_id"], date(2019, 1, 1), date(2019, 1, 31), "voice_*")
    assert sorted(str(r.day) for r in df.collect()) == ["2019-01-01", "2019-01-03"] and df.columns == ["a_id", "day"]
    with pytest.raises(readers.MissingColumns):
        readers.read_daily(spark, str(tmp_path), ["cell"], date(2019, 1, 1), date(2019, 1, 2), "voice_*")


def test_corrupt_files_are_skipped_on_request(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "part-bad.parquet").write_bytes(b"not parquet")
    assert readers.read_dataset(spark, str(tmp_path / "d"), ["id"], skip_corrupt=True).count() == 5


@pytest.mark.parametrize("name", ["part-bad.parquet", "a bad+one%.parquet"])
def test_unread_files_are_named(spark, tmp_path, name):
    folder = str(tmp_path / "d")
    spark.range(5).repartition(2).write.parquet(folder)
    assert readers.unread_files(spark, folder).count() == 0
    (tmp_path / "d" / name).write_bytes(b"not parquet")
    (row,) = readers.unread_files(spark, folder).collect()
    assert row.file.endswith(f"/{name}") and row.bytes == 11
    # also where the damaged file is the first, from which columns would be taken
    assert readers.read_dataset(spark, folder, ["id"], skip_corrupt=True).count() == 5


def test_incremental_days_run_once(spark, tmp_path):
    out = str(tmp_path / "p")
    rows = spark.createDataFrame([(date(2024, 1, d), d % 2) for d in (1, 1, 2, 3)], "day date, k int")
    agg = lambda e: e.groupBy("day", "k").agg(F.count("*").alias("n"))
    assert len(sinks.incremental_daily(rows.filter("day < '2024-01-03'"), agg, out)) == 2
    before = {f for d in os.listdir(out) if d.startswith("day=") for f in os.listdir(f"{out}/{d}")}
    assert sinks.incremental_daily(rows, agg, out) == [date(2024, 1, 3)]
    assert sinks.incremental_daily(rows, agg, out) == []
    after = {f for d in os.listdir(out) if d.startswith("day=") for f in os.listdir(f"{out}/{d}")}
    assert before < after
    got = {r.k: r.n for r in sinks.merged(spark.read.parquet(out), ["k"], ["n"]).collect()}
    assert got == {1: 3, 0: 1}


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, check = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    agg = lambda e: e.groupBy("k").agg(F.count("*").alias("n"))
    spark.range(10).select((F.col("id") % 2).alias("k")).write.mode("append").parquet(src)
    assert aggregate_new_files(spark, src, agg, out, check) == 1
    assert aggregate_new_files(spark, src, agg, out, check) == 0
    spark.range(4).select((F.col("id") % 2).alias("k")).write.mode("append").parquet(src)
    assert aggregate_new_files(spark, src, agg, out, check) == 1
    got = {r.k: r.n for r in sinks.merged(spark.read.parquet(out), ["k"], ["n"]).collect()}
    assert got == {0: 7, 1: 7}


def test_private_tables_stay_back(spark, tmp_path):
    t = {"cohort": spark.range(1), "summary": spark.range(2)}
    assert sinks.write_tables(t, str(tmp_path), ["cohort"]) == ["summary"]
    assert not (tmp_path / "cohort").exists()
    assert sinks.write_tables(t, str(tmp_path), ["cohort"], release_private=True) == ["cohort", "summary"]


def check(tables, empty=()):
    for name, df in tables.items():
        n = df.count()
        assert n > 0 or name in empty, name


def test_jobs_run_end_to_end(spark, sf, tmp_path):
    s = V.S(spark, sf)
    cells = V.places(s).select(F.col("k").alias("cell_id"), "lon", "lat")
    tie = jobs.tie_network(jobs.TieInputs(MQ.voice(s), MQ.sms(s), MQ.cell_map(s), cells, GQ.polygons(s), MQ.population(s),
                                          MQ.income(s)), 1, (1, 2), (1, 2), 1)
    check(tie, ["area_metrics_kde"])
    areas = CQ.nation_dim(s).withColumn("area_id", F.lpad("area_id", 5, "0"))
    od = CQ.od_index(s).select(F.lpad("home_area", 5, "0").alias("home_area"), F.lpad("dest_area", 5, "0").alias("dest_area"), "weight")
    known = cells.join(MQ.cell_area(s), "cell_id").withColumn("area_km2", F.lit(100.0))
    comp = jobs.tie_comparison(tie["edges"], tie["users"], NQ.published_metrics(s), known, od, areas, (25.0, 30.0, -100.0, -95.0), 1, 0, 1000)
    check(comp)
    evac = jobs.evacuation(V.stays(s), V.EVENTS, V.place_area(s, "fine"), V.area_xy(s, "fine"), (30, 60), 30, 4, 10, 2000.0)
    check(evac, ["distance_kde"])
    names = sinks.write_tables(evac, str(tmp_path / "evac"), jobs.PRIVATE)
    assert "cohort" not in names and (tmp_path / "evac" / "threshold_summary").exists()
    income = MQ.income(s).withColumnRenamed("area_id", "home_area")
    check(jobs.gyration(V.stays(s), V.EVENTS, V.place_area(s, "fine"), V.area_xy(s, "fine"), evac["cohort"], PQ.intensity(s), income,
                        category_rank("int_bin", PQ.BINS), PQ.STORMS, 10), ["post_effect_by_bin"])
    check(jobs.displacement(V.stays(s), V.EVENTS, V.place_area(s, "fine"), DQ.coverage(s), 10))
    homes = s.table("events").select(F.col("user_id").cast("string").alias("pid"), F.lit("7").alias("home_place_id"))
    check(jobs.stay_quality(V.stays(s), homes, V.places(s), MQ.centres(s), MQ.population(s)),
          ["population_cells", "population_breaks"])
    panels = jobs.stay_quality(MQ.panel_stays(s), homes.withColumn("disaster", F.lit("Storm A")), V.places(s), MQ.centres(s),
                               MQ.population(s).withColumn("disaster", F.lit("Storm A")), ["disaster"])
    check(panels, ["population_cells", "population_breaks", "quality_counts"])
    assert panels["stay_distributions"].select("disaster", "quantity").distinct().count() == 6
    inc = s.table("customer").select(F.col("c_custkey").cast("string").alias("home_area"), F.col("c_acctbal").alias("median_income"))
    ec = s.table("orders").select(F.col("o_custkey").cast("string").alias("home_area"), F.log("o_totalprice").alias("ec"))
    check(jobs.connectedness(CQ.person(s), inc, ec, merge="first"))
    check(jobs.connectedness(CQ.movers(s), income, ec.withColumn("home_area", F.lpad(F.expr("home_area % 25"), 5, "0")), CQ.od_index(s)),
          ["ec_effect", "group_shares", "widest_event", "ec_income_sample"])
    check(jobs.recovery(PQ.recovery(s), PQ.OUTCOMES, PQ.METRICS, {"median_income_z": "Income", "ec_r_z": "EC (residual)"}, "ec"))


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("extra,income,code\n1,5.5,00501\n2,bad,00502\n")
    df = readers.read_typed_csv(spark, str(tmp_path), "code string, income double")
    assert [(r.code, r.income) for r in df.orderBy("code").collect()] == [("00501", 5.5), ("00502", None)]
    with pytest.raises(readers.MissingColumns):
        readers.read_typed_csv(spark, str(tmp_path), "zip string")
    assert readers.read_optional_csv(spark, str(tmp_path / "none.csv"), "zip string").columns == ["zip"]


def test_index_codes_are_padded_before_use(spark, tmp_path):
    (tmp_path / "s.csv").write_text("user_country,friend_country,user_region,friend_region,scaled_sci\nUS,US,501,10001,7\nUS,CA,501,1,7\n")
    assert [tuple(r) for r in readers.read_od_index(spark, str(tmp_path)).collect()] == [("00501", "10001", 7.0)]


def test_csv_shards_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,income\n00501,5.5\n00502,x\n")
    (tmp_path / "b b.csv").write_text('note,income,"code",note\nhi,7.5,00503,\n')
    (tmp_path / "c.csv").write_text("income,code\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("code,income\n00504,1.0\n")
    df = readers.read_typed_csv(spark, str(tmp_path), "code string, income double")
    assert sorted(map(tuple, df.collect()), key=str) == [("00501", 5.5), ("00502", None), ("00503", 7.5), ("00504", 1.0)]
    assert [len(files) for _, files in readers.header_groups(spark, str(tmp_path))] == [2, 1, 1]
    (tmp_path / "f.csv").write_text("code,salary\n00505,1.0\n")
    with pytest.raises(readers.MissingColumns, match="f.csv.*income"):
        readers.read_typed_csv(spark, str(tmp_path), "code string, income double")


def test_late_files_change_their_day(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    agg = lambda e: e.groupBy("day", "k").agg(F.count("*").alias("n"))

    def arrive(*rows):
        spark.createDataFrame([(date(2024, 1, d), k) for d, k in rows], "day date, k int").write.mode("append").partitionBy("day").parquet(src)

    totals = lambda: {(r.day.day, r.k): r.n for r in spark.read.parquet(out).collect()}
    arrive((1, 0), (1, 1), (2, 0))
    assert sinks.incremental_folder(spark, src, agg, out) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert sinks.incremental_folder(spark, src, agg, out) == []
    arrive((1, 0), (3, 5))
    assert sinks.incremental_folder(spark, src, agg, out) == [date(2024, 1, 1), date(2024, 1, 3)]
    assert totals() == {(1, 0): 2, (1, 1): 1, (2, 0): 1, (3, 5): 1}
    assert sinks.incremental_folder(spark, src, agg, out) == []


def test_ledger_of_dated_file_names(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put = lambda d, n: spark.range(n).toPandas().to_parquet(src / f"voice_2019-01-{d:02}.parquet")
    agg = lambda e: e.groupBy("day").agg(F.count("*").alias("n"))
    put(1, 2)
    put(2, 3)
    (src / "notes.txt").write_text("2019-01-09")
    assert len(sinks.incremental_folder(spark, str(src), agg, out, "voice_*")) == 2
    put(2, 9)  # replaced
    assert sinks.incremental_folder(spark, str(src), agg, out, "voice_*") == [date(2019, 1, 2)]
    assert {str(r.day): r.n for r in spark.read.parquet(out).collect()} == {"2019-01-01": 2, "2019-01-02": 9}


def test_result_tables_are_ordered_and_not_one_task(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_table(spark.range(5000).selectExpr("5000 - id AS k", "id * 0.5 AS v"), str(tmp_path / "long"), "parquet", True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(f for f in os.listdir(tmp_path / "long") if f.endswith(".parquet"))
    assert len(parts) > 1
    ordered = [r.k for f in parts for r in spark.read.parquet(str(tmp_path / "long" / f)).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 5000
    sinks.write_table(spark.range(50).repartition(7), str(tmp_path / "short"), "csv", True)
    assert len([f for f in os.listdir(tmp_path / "short") if f.endswith(".csv")]) == 1
