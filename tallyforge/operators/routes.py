"""Which way a run reads its photographs, by whom and on which model, from its settings and a table of providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The widest scan and request, the marker of a whole gallery in one request, pages of a walk at most.
MOST_PER_SCAN, MOST_PER_REQUEST, WHOLE_GALLERY, MOST_PAGES = 32, 24, -1, 100

#: Routes by ordered rules: the first whose conditions (column, value) all hold decides.
ROUTES = (
    ("manifest", (("batches", True),)),
    ("whole gallery", (("whole", True),)),
    ("thorough", ()),
)
#: Whether photographs are read in batches: a width is set, and the reader can batch or is not the appraiser.
BATCHES = (
    (False, (("width", 0),)),
    (True, (("reader_batches", True),)),
    (True, (("other_reader", True),)),
    (False, ()),
)
#: Whose key is missing: the appraiser's, which every route needs, else the reader's of a split run.
MISSING = (("appraiser", (("has_key", False),)), ("reader", (("split", True), ("reader_has_key", False))))


def first_match(rules: tuple, default: object = None) -> Column:
    """The outcome of the first rule whose conditions hold; a null column meets no condition."""
    out = F.lit(default)
    for outcome, conditions in reversed(rules):
        holds = reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in conditions), F.lit(True))
        out = F.when(holds, F.lit(outcome)).otherwise(out)
    return out


def chosen_model(stored: Column, menu: Column, default: Column) -> Column:
    """The stored model while the menu has it, else the default."""
    return F.when(F.coalesce(F.array_contains(menu, stored), F.lit(False)) & (stored != ""), stored).otherwise(default)


def run_plans(settings: DataFrame, accounts: DataFrame, providers: DataFrame) -> DataFrame:
    """(run, route, reader, model, reader_model, split, batch, per_scan, pages, missing, key_phrase, summary, reading) of each run.

    settings: run, provider, photo_provider (same, or a provider), photos_per_scan, photos_per_request, page_limit.
    accounts: run, provider, model, key. providers: provider, name, default_model, menu (array), batches; one row each.
    An account that is not there has neither model nor key. A provider that is not there is called by its id and has no model.
    """
    s = settings.withColumn("reader", F.when(F.col("photo_provider") == "same", F.col("provider")).otherwise(F.col("photo_provider")))
    known = accounts.groupBy("run", "provider").agg(F.max(F.struct("model", "key")).alias("a")).select("run", "provider", "a.*")
    named = known.join(providers, "provider").select("run", "provider", chosen_model(F.col("model"), F.col("menu"), F.col("default_model")).alias("model"), (F.trim(F.coalesce("key", F.lit(""))) != "").alias("key"))

    def of(role: str, prefix: str) -> DataFrame:
        p = providers.select(F.col("provider").alias(role), F.col("name").alias(f"{prefix}name"), F.col("default_model").alias(f"{prefix}default"), F.col("batches").alias(f"{prefix}batches"))
        mine = named.select("run", F.col("provider").alias(role), F.col("model").alias(f"{prefix}own"), F.col("key").alias(f"{prefix}key"))
        return s.select("run", role).join(p, role, "left").join(mine, ["run", role], "left").drop(role)

    both = s.join(of("provider", "a_"), "run").join(of("reader", "r_"), "run")
    told = both.select(
        "run", "provider", "reader", "page_limit",
        F.coalesce("a_name", "provider").alias("name"), F.coalesce("r_name", "reader").alias("reader_name"),
        F.coalesce("a_own", "a_default").alias("model"), F.coalesce("r_own", "r_default").alias("reader_model"),
        F.coalesce("a_key", F.lit(False)).alias("has_key"), F.coalesce("r_key", F.lit(False)).alias("reader_has_key"),
        F.coalesce("r_batches", F.lit(False)).alias("reader_batches"), (F.col("reader") != F.col("provider")).alias("other_reader"),
        F.greatest(F.lit(0), F.least("photos_per_request", F.lit(MOST_PER_REQUEST))).alias("width"),
        F.when(F.col("photos_per_scan") == WHOLE_GALLERY, WHOLE_GALLERY).otherwise(F.greatest(F.lit(0), F.least("photos_per_scan", F.lit(MOST_PER_SCAN)))).alias("per_scan"),
    )
    told = told.withColumn("whole", F.col("per_scan") == WHOLE_GALLERY).withColumn("batches", first_match(BATCHES))
    told = told.withColumn("split", F.col("batches") & F.col("other_reader")).withColumn("missing", first_match(MISSING)).withColumn("route", first_match(ROUTES))
    missing = F.when(F.col("missing") == "appraiser", F.col("provider")).when(F.col("missing") == "reader", F.col("reader"))
    lacking = F.coalesce(missing, "provider")
    half = F.when(F.col("split") & (lacking == F.col("reader")), " (the manifest half)").otherwise("")
    scan = F.when(F.col("whole"), "the whole gallery in one request").when(F.col("per_scan") == 0, "every photograph").otherwise(F.concat(F.lit("the first "), F.col("per_scan"), F.lit(" photograph(s)")))
    summary = F.when(F.col("batches"), F.concat(F.lit("photographs in batches of "), "width")).when(F.col("whole"), scan).otherwise(F.concat(scan, F.lit(" read one at a time")))
    reading = F.when(F.col("split"), F.concat(F.lit(", manifest read on "), "reader_name", F.lit(" "), "reader_model")).otherwise("")
    return told.select(
        "run", "route", "reader", "model", "reader_model", "split", F.when(F.col("batches"), F.col("width")).alias("batch"), "per_scan",
        F.when(F.col("page_limit") > 0, F.least("page_limit", F.lit(MOST_PAGES))).otherwise(MOST_PAGES).alias("pages"), missing.alias("missing"),
        F.concat(F.lit("a "), F.when(lacking == F.col("reader"), F.col("reader_name")).otherwise(F.col("name")), F.lit(" key"), half).alias("key_phrase"), summary.alias("summary"), reading.alias("reading"),
    )
