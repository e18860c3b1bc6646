"""Reader, sink and incremental queries: whole tables written to the shared folder and read back."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from areaflow.catalog.connectedness_queries import od_index
from areaflow.catalog.mobility_queries import contacts, sms, users, voice
from areaflow.catalog.views import R, S, published, query
from areaflow.functions.columns import night_anchor
from areaflow.operators.network import pair_counts
from areaflow.sources import readers, sinks
from areaflow.sources.staging import shared_dir
from areaflow.streaming.incremental import aggregate_new_files


def _folder(s: S, name: str) -> str:
    return f"{shared_dir(s.spark)}/areaflow/{name}-{uuid.uuid4().hex}"


_PAIRS = """
SELECT least(a_id, b_id) AS u, greatest(a_id, b_id) AS v, CAST(sum(CASE WHEN is_voice THEN 1 ELSE 0 END) AS BIGINT) AS n_voice,
       CAST(sum(CASE WHEN is_voice THEN 0 ELSE 1 END) AS BIGINT) AS n_sms FROM contacts WHERE a_id <> b_id {w} GROUP BY 1, 2"""


@query("incremental_daily", _PAIRS.format(w=""))
def incremental_daily(s: S):
    """Daily partial pair counts: a first run up to mid-month, a second run adds only the rest."""
    out = _folder(s, "pairs")
    events = contacts(s)

    def daily(e):
        return pair_counts(e.filter("is_voice"), e.filter("not is_voice"), ["day"])

    sinks.incremental_daily(events.filter(F.col("day") <= F.lit(date(2024, 1, 15))), daily, out)
    sinks.incremental_daily(events, daily, out)
    return sinks.merged(s.spark.read.parquet(out), ["u", "v"], ["n_voice", "n_sms"])


@query("incremental_late", _PAIRS.format(w=""))
def incremental_late(s: S):
    """Daily files, a third of them late: days done already are done again when the files arrive."""
    source, out = _folder(s, "contacts"), _folder(s, "pairs")
    late = F.col("b_id") % 3 == 0

    def daily(e):
        return pair_counts(e.filter("is_voice"), e.filter("not is_voice"), ["day"])

    for part in (~late, late):
        contacts(s).select("a_id", "b_id", "is_voice", "day").filter(part).write.mode("append").partitionBy("day").parquet(source)
        sinks.incremental_folder(s.spark, source, daily, out)
    return sinks.merged(s.spark.read.parquet(out), ["u", "v"], ["n_voice", "n_sms"])


@query("incremental_files", f"""
SELECT user_id, event_type, count(*) AS n, {R('sum(value)')} AS total FROM events GROUP BY 1, 2""")
def incremental_files(s: S):
    """New files as a stream; running it again finds nothing new."""
    out, check = _folder(s, "partials"), _folder(s, "progress")

    def totals(e):
        return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    for _ in range(2):
        aggregate_new_files(s.spark, s.path, totals, out, check, "events.parquet")
    return published(sinks.merged(s.spark.read.parquet(out), ["user_id", "event_type"], ["n", "total"]))


@query("read_daily", _PAIRS.format(w="AND day BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'"))
def read_daily(s: S):
    """Day-partitioned calls and messages, only needed columns and days; missing days tolerated."""
    calls, texts = _folder(s, "calls"), _folder(s, "texts")
    sinks.write_daily(voice(s), calls)
    sinks.write_daily(sms(s), texts)
    lo, hi = date(2024, 1, 10), date(2024, 2, 10)
    get = lambda p: readers.read_daily(s.spark, p, ["a_id", "b_id"], lo, hi)
    return pair_counts(get(calls), get(texts))


@query("read_typed_csv", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS code, c_acctbal AS income, c_mktsegment AS segment FROM customer""")
def read_typed_csv(s: S):
    """Codes written to CSV and read back with a declared schema keep their zeros."""
    out = _folder(s, "csv")
    codes = s.table("customer").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("code"),
                                       F.col("c_acctbal").alias("income"), F.col("c_mktsegment").alias("segment"))
    sinks.write_table(codes, out, "csv")
    back = readers.read_typed_csv(s.spark, out, "code string, income double, segment string")
    none = readers.read_optional_csv(s.spark, out + "-absent", back.schema)
    return readers.require_columns(back.unionByName(none), ["code", "income", "segment"])


@query("read_od_index", """
SELECT lpad(home_area, 5, '0') AS home_area, lpad(dest_area, 5, '0') AS dest_area, weight FROM od_index
WHERE CAST(home_area AS INTEGER) % 6 <> 5 AND CAST(dest_area AS INTEGER) % 6 <> 5""")
def read_od_index(s: S):
    """Sharded index files with unpadded codes and foreign rows."""
    out = _folder(s, "od")
    country = lambda c: F.when(F.col(c).cast("int") % 6 == 5, "CA").otherwise("US")
    shards = od_index(s).select(
        country("home_area").alias("user_country"), country("dest_area").alias("friend_country"),
        F.col("home_area").alias("user_region"), F.col("dest_area").alias("friend_region"), F.col("weight").alias("scaled_sci"))
    sinks.write_table(shards.repartition(4), out, "csv")
    return readers.read_od_index(s.spark, out)


@query("read_od_index_mixed", """
SELECT lpad(home_area, 5, '0') AS home_area, lpad(dest_area, 5, '0') AS dest_area, weight FROM od_index""")
def read_od_index_mixed(s: S):
    """Index shards whose columns stand in another order, some with a further column."""
    out = _folder(s, "od")
    shards = od_index(s).select(
        F.lit("US").alias("user_country"), F.lit("US").alias("friend_country"), F.col("home_area").alias("user_region"),
        F.col("dest_area").alias("friend_region"), F.col("weight").alias("scaled_sci"))
    other = F.col("user_region").cast("int") % 2 == 1
    sinks.write_table(shards.filter(~other), f"{out}/a", "csv")
    swapped = shards.filter(other).select("scaled_sci", "friend_region", F.lit("x").alias("note"), "user_region", "friend_country", "user_country")
    sinks.write_table(swapped, f"{out}/b", "csv")
    return readers.read_od_index(s.spark, [f"{out}/a", f"{out}/b"])


@query("read_dataset", f"""
SELECT CAST(CAST(CASE WHEN hour(ts) < 7 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS VARCHAR) AS night,
  count(*) AS n, {R('sum(value)')} AS total FROM events GROUP BY 1""")
def read_dataset(s: S):
    """A multi-file dataset, unreadable files skipped, only the needed columns scanned."""
    out = _folder(s, "events")
    sinks.write_table(s.table("events").repartition(4), out)
    e = readers.read_dataset(s.spark, out, ["ts", "value"], skip_corrupt=True)
    night = night_anchor("ts", F.hour("ts")).cast("string").alias("night")
    return published(e.groupBy(night).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("unread_files", "SELECT CAST(1 AS BIGINT) AS n_files, CAST(strlen(max(text)) + 1 AS BIGINT) AS bytes FROM documents")
def unread_files(s: S):
    """A dataset with a file among the others that is no Parquet: which file gives no rows."""
    out = _folder(s, "events")
    sinks.write_table(s.table("events").repartition(4), out)
    s.table("documents").agg(F.max("text").alias("value")).write.mode("append").text(out)
    return readers.unread_files(s.spark, out).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


@query("disclosure_switch", """
SELECT false AS released, 'areas' AS name, (SELECT count(DISTINCT area_id) FROM users) AS n
UNION ALL SELECT true, 'areas', (SELECT count(DISTINCT area_id) FROM users) UNION ALL SELECT true, 'persons', (SELECT count(*) FROM users)""")
def disclosure_switch(s: S):
    """What lies in the result folder with and without the release of tables about single persons."""
    persons = users(s)
    tables = {"persons": persons, "areas": persons.groupBy("area_id").agg(F.count("*").alias("n_users"))}
    found = None
    for released in (False, True):
        out = _folder(s, "results")
        for name in sinks.write_tables(tables, out, ["persons"], released, "parquet"):
            n = s.spark.read.parquet(f"{out}/{name}").agg(F.count("*").alias("n"))
            part = n.select(F.lit(released).alias("released"), F.lit(name).alias("name"), "n")
            found = part if found is None else found.unionByName(part)
    return found
