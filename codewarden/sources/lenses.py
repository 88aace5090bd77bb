"""Lens catalogues: validated rows from JSON files, merged with built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ids of the built-in lenses, required fields, prompt limit.
BUILTIN = ["security", "architecture", "quality", "hipaa", "soc2"]
REQUIRED = ["id", "name", "description", "systemPrompt"]
MAX_PROMPT = 10 * 1024


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(source, raw) of every JSON file in a folder."""
    return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw"))


def _string(name: str) -> Column:
    v = F.try_variant_get("_v", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))


def validate(rows: DataFrame) -> DataFrame:
    """Add the lens columns, ``valid`` and ``reason``; needs ``raw``."""
    d = rows.withColumn("_v", F.try_parse_json("raw"))
    areas = F.try_variant_get("_v", "$.focusAreas", "variant")
    is_list = F.coalesce(F.schema_of_variant(areas).startswith("ARRAY"), F.lit(False))
    items = F.when(is_list, F.try_variant_get(areas, "$", "array<variant>"))
    odd = F.exists(items, lambda x: ~F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    reason = F.when(~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "must be a JSON object")
    for f in REQUIRED:
        reason = reason.when(F.coalesce(_string(f), F.lit("")) == "", f'missing required string field: "{f}"')
    reason = (reason.when(~is_list, "focusAreas must be an array").when(odd, "focusAreas must hold strings")
              .when(F.length(_string("systemPrompt")) > MAX_PROMPT, f"system prompt exceeds {MAX_PROMPT} bytes"))
    return d.withColumns({
        "id": _string("id"), "name": _string("name"), "system_prompt": _string("systemPrompt"),
        "focus_areas": F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), "reason": reason,
    }).withColumn("valid", F.col("reason").isNull()).drop("_v")


def catalogue(builtin: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(id, name, system_prompt, origin, ord): all lenses, each id once.

    ``builtin`` and ``custom`` have (id, name, system_prompt, ord); built-ins come
    first, and of lenses with one id the first one counts.
    """
    columns = ["id", "name", "system_prompt", "ord"]
    rows = builtin.select(*columns).withColumn("origin", F.lit(0))
    if custom is not None:
        rows = rows.unionByName(custom.select(*columns).withColumn("origin", F.lit(1)))
    first = F.min_by(F.struct("name", "system_prompt", "origin", "ord"), F.struct("origin", "ord"))
    return rows.groupBy("id").agg(first.alias("l")).select("id", "l.*")


def resolve(requests: DataFrame, lenses: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, lens, name, system_prompt, ord) of the lenses that each run asks for.

    ``requests`` has (key, lens, ord); the lens ``all`` stands for the whole
    catalogue in its order.  An id that the catalogue lacks gives no row, see
    `unknown_ids`; an id asked for twice counts where it comes first.
    """
    known = lenses.select("id", "name", "system_prompt", F.struct("origin", F.col("ord").cast("long").alias("ord")).alias("_place"))
    place = F.struct(F.lit(0).alias("origin"), F.lit(0).cast("long").alias("ord"))
    named = requests.filter("lens <> 'all'").select(key, "ord", F.col("lens").alias("id")).join(known, "id").withColumn("_place", place)
    # The catalogue is small next to the runs: one row per run and lens, as many as there are prompts.
    every = requests.filter("lens = 'all'").select(key, "ord", F.lit(1).alias("_one")).join(known.withColumn("_one", F.lit(1)), "_one").drop("_one")
    first = F.min(F.struct(F.col("ord").cast("long").alias("ord"), "_place"))
    both = named.unionByName(every, allowMissingColumns=True).groupBy(key, "id", "name", "system_prompt").agg(first.alias("_at"))
    order = Window.partitionBy(key).orderBy("_at", "id")
    return both.select(key, F.col("id").alias("lens"), "name", "system_prompt", F.row_number().over(order).alias("ord"))


def unknown_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Requested lens ids that do not exist."""
    return wanted.select("id").distinct().join(known.select("id"), "id", "left_anti")
