"""Queries of routes and models by settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import routes as R
from tallyforge.sources.bindings import table

_PROVIDERS = "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'frames' WHEN 1 THEN 'batches' ELSE 'other' || r_regionkey END AS provider, r_name AS name, concat('m', r_regionkey, '-now') AS default_model, r_regionkey IN (1, 3) AS batches FROM {region}"


def run_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, whose settings go through all combinations; regions as providers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("long")
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / by) % len(values) + 1).cast("int"))
    settings = c.select(k.alias("run"), pick(1, "frames", "batches").alias("provider"), pick(2, "same", "frames", "batches").alias("photo_provider"), pick(6, -1, 0, 8, 99).alias("photos_per_scan"), pick(24, 0, 6, 99, -3).alias("photos_per_request"), pick(7, 0, 3, 500).alias("page_limit"))
    regions = spark.sql(_PROVIDERS.format(region="{region}"), region=table(spark, sf_dir, "region"))
    providers = regions.select("provider", "name", "default_model", F.array(F.col("default_model"), F.concat(F.lit("m"), "r_regionkey", F.lit("-old"))).alias("menu"), "batches")
    account = lambda p, by: c.where(F.floor(k / by) % 3 < 2).select(k.alias("run"), F.lit(p).alias("provider"), F.concat(F.lit(f"m{p == 'batches':d}-"), pick(by + 1, "old", "gone", "now")).alias("model"), pick(by + 2, "key", "  ", "k").alias("key"))
    return R.run_plans(settings, account("frames", 96).unionByName(account("batches", 5)), providers)


QUERIES = {"run_plans": run_plans}


def _pick(by: int, *values: object) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(c_custkey // {by} % {len(values)} AS INTEGER) + 1]"


def _account(p: str, by: int) -> str:
    n = int(p == "batches")
    there = f"c_custkey // {by} % 3 < 2"
    model = _pick(by + 1, "old", "gone", "now")
    return f"CASE WHEN {there} AND {model} <> 'gone' THEN 'm{n}-' || {model} ELSE 'm{n}-now' END AS {p}_model, {there} AND {_pick(by + 2, 'key', '  ', 'k')} <> '  ' AS {p}_key"


ORACLE_SQL = {
    # the rules in the order in which settings are asked
    "run_plans": f"""
        WITH s AS (SELECT CAST(c_custkey AS BIGINT) AS run, {_pick(1, "frames", "batches")} AS provider, {_pick(2, "same", "frames", "batches")} AS photo, {_pick(6, -1, 0, 8, 99)} AS scan, {_pick(24, 0, 6, 99, -3)} AS request, {_pick(7, 0, 3, 500)} AS page_limit, {_account("frames", 96)}, {_account("batches", 5)} FROM customer),
        names AS (SELECT max(r_name) FILTER (r_regionkey = 0) AS frames_name, max(r_name) FILTER (r_regionkey = 1) AS batches_name FROM region),
        r AS (SELECT *, CASE photo WHEN 'same' THEN provider ELSE photo END AS reader, least(greatest(request, 0), 24) AS width, CASE scan WHEN -1 THEN -1 ELSE least(greatest(scan, 0), 32) END AS per_scan FROM s, names),
        b AS (SELECT *, width > 0 AND (reader = 'batches' OR reader <> provider) AS batching FROM r),
        p AS (SELECT *, batching AND reader <> provider AS split, CASE provider WHEN 'frames' THEN frames_key ELSE batches_key END AS k1, CASE reader WHEN 'frames' THEN frames_key ELSE batches_key END AS k2 FROM b),
        m AS (SELECT *, CASE WHEN NOT k1 THEN provider WHEN split AND NOT k2 THEN reader END AS missing FROM p)
        SELECT run, CASE WHEN batching THEN 'manifest' WHEN per_scan = -1 THEN 'whole gallery' ELSE 'thorough' END AS route, reader,
               CASE provider WHEN 'frames' THEN frames_model ELSE batches_model END AS model, CASE reader WHEN 'frames' THEN frames_model ELSE batches_model END AS reader_model, split,
               CASE WHEN batching THEN width END AS batch, per_scan, CASE WHEN page_limit > 0 THEN least(page_limit, 100) ELSE 100 END AS pages, missing,
               'a ' || CASE coalesce(missing, provider) WHEN 'frames' THEN frames_name ELSE batches_name END || ' key' || CASE WHEN split AND missing = reader THEN ' (the manifest half)' ELSE '' END AS key_phrase,
               CASE WHEN batching THEN 'photographs in batches of ' || width WHEN per_scan = -1 THEN 'the whole gallery in one request' WHEN per_scan = 0 THEN 'every photograph read one at a time' ELSE 'the first ' || per_scan || ' photograph(s) read one at a time' END AS summary,
               CASE WHEN split THEN ', manifest read on ' || CASE reader WHEN 'frames' THEN frames_name || ' ' || frames_model ELSE batches_name || ' ' || batches_model END ELSE '' END AS reading FROM m""",
}
