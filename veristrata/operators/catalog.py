"""Building a catalogue of tables: seeds, metadata rows as they come from a service, records, what is left to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The metadata endpoints of a table (fixed values).
ENDPOINTS = ("TBL", "ITM", "PRD", "SOURCE", "NCD")


def catalog_lines(lines: DataFrame, schema: str, key: str, line: str = "value", order: str | None = None) -> DataFrame:
    """Rows of JSON lines by a schema: blank and malformed lines are skipped, and of one key the first line stays.

    ``order`` names the column that orders lines (a line number); without it any of them stays.
    """
    parsed = lines.where(F.trim(line) != "").withColumn("_r", F.from_json(F.col(line), f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    good = parsed.where(F.col("_r._corrupt_record").isNull() & F.col(f"_r.{key}").isNotNull())
    rows = good.groupBy(F.col(f"_r.{key}").alias("_k")).agg(F.min_by("_r", F.col(order) if order else F.lit(0)).alias("_r"))
    return rows.select("_r.*").drop("_corrupt_record")


def service_rows(payload: Column, schema: str) -> Column:
    """struct(status, rows) of a service's answer: a list of rows; error 30 is an empty list; another object is an error with its code."""
    rows = F.from_json(payload, f"array<struct<{schema}>>")
    code = F.get_json_object(payload, "$.err")
    is_list = F.ltrim(payload).startswith("[")
    status = F.when(is_list & rows.isNotNull(), "OK").when(code == "30", "EMPTY").when(code.isNotNull(), F.concat(F.lit("SERVICE_ERROR_"), code)).otherwise("MALFORMED")
    return F.struct(status.alias("status"), F.when(status == "OK", rows).when(status == "EMPTY", F.array().cast(f"array<struct<{schema}>>")).alias("rows"))


def canonical_seed(rows: DataFrame) -> DataFrame:
    """Seeds ``(table_key, org_id, tbl_id, tbl_name, error)``: a key is made where none is given, and one that is given must be ``org:tbl``."""
    org, tbl = (F.coalesce(F.trim(c), F.lit("")) for c in ("org_id", "tbl_id"))
    made, given = F.concat(org, F.lit(":"), tbl), F.coalesce(F.trim("table_key"), F.lit(""))
    error = F.when((org == "") | (tbl == ""), "SEED_ID_MISSING").when((given != "") & (given != made), "SEED_KEY_MISMATCH")
    return rows.select(F.when(given != "", given).otherwise(made).alias("table_key"), org.alias("org_id"), tbl.alias("tbl_id"), F.coalesce("tbl_name", F.lit("")).alias("tbl_name"), error.alias("error"))


def split_itm(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items ``(table_key, itm_id, itm_nm, unit_nm)`` and axis values ``(table_key, obj_id, obj_nm, obj_sn, value_id, value_name)``: rows of the axis ITEM are items."""
    known = rows.where((F.coalesce("OBJ_ID", F.lit("")) != "") & (F.coalesce("ITM_ID", F.lit("")) != ""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    items = known.where("OBJ_ID = 'ITEM'").select("table_key", F.col("ITM_ID").alias("itm_id"), blank("ITM_NM").alias("itm_nm"), blank("UNIT_NM").alias("unit_nm"))
    values = known.where("OBJ_ID <> 'ITEM'").select("table_key", F.col("OBJ_ID").alias("obj_id"), blank("OBJ_NM").alias("obj_nm"), F.col("OBJ_ID_SN").alias("obj_sn"), F.col("ITM_ID").alias("value_id"), blank("ITM_NM").alias("value_name"))
    return items, values


def profile_from_api(values: DataFrame) -> DataFrame:
    """Axis values with ``level``: axes of a table numbered from 1, by serial number and then id."""
    axes = values.groupBy("table_key", "obj_id").agg(F.min("obj_sn").alias("sn"))
    level = F.row_number().over(Window.partitionBy("table_key").orderBy(F.col("sn").asc_nulls_last(), "obj_id"))
    return values.join(axes.withColumn("level", level).drop("sn"), ["table_key", "obj_id"])


def catalog_record(seeds: DataFrame, items: DataFrame, values: DataFrame, periods: DataFrame, statuses: DataFrame) -> DataFrame:
    """One record a seed: sorted units and period types, latest period, search texts, what is missing, and enriched or partial.

    ``periods(table_key, PRD_SE, END_PRD_DE)``; ``statuses(table_key, endpoint, status)``, one row a
    fetched endpoint. Every part is summed up by key before it is joined.
    """
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    i = items.groupBy("table_key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set(named("unit_nm"))).alias("units"), F.array_sort(F.collect_list(F.struct("itm_id", "itm_nm"))).alias("items"))
    v = values.groupBy("table_key").agg(F.count_distinct("obj_id").alias("n_axes"), F.array_sort(F.collect_set(F.struct("obj_id", "obj_nm"))).alias("axes"))
    p = periods.groupBy("table_key").agg(F.array_sort(F.collect_set(named("PRD_SE"))).alias("period_types"), F.max(named("END_PRD_DE")).alias("latest_period"), F.count("*").alias("n_periods"))
    s = statuses.where(F.col("endpoint").isin(*ENDPOINTS)).groupBy("table_key").agg(F.count_if(F.col("status") == "OK").alias("n_ok"))
    out = seeds.join(i, "table_key", "left").join(v, "table_key", "left").join(p, "table_key", "left").join(s, "table_key", "left")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    missing = F.array_compact(F.array(F.when(F.col("tbl_name") == "", F.lit("table_name")), F.when(none("n_items"), F.lit("items")), F.when(none("n_axes"), F.lit("dimensions")), F.when(none("n_periods"), F.lit("periods"))))
    labels = F.concat(F.coalesce(F.transform("items", lambda x: x["itm_nm"]), F.array().cast("array<string>")), F.coalesce(F.transform("axes", lambda x: x["obj_nm"]), F.array().cast("array<string>")))
    whole = (F.coalesce("n_ok", F.lit(0)) == len(ENDPOINTS)) & (F.size(missing) == 0)
    return out.select(
        "table_key", "tbl_name", F.coalesce("units", F.array().cast("array<string>")).alias("units"), F.coalesce("period_types", F.array().cast("array<string>")).alias("period_types"), "latest_period",
        missing.alias("missing"), F.array_join(F.filter(labels, lambda x: x != ""), " ").alias("doc_item_index"), F.when(whole, "enriched").otherwise("partial").alias("meta_status"),
    )


def category_path(primary: Column, paths: Column) -> Column:
    """The primary path, else the first of several, its parts joined; empty without one."""
    some = lambda p: F.coalesce(F.size(p), F.lit(0)) > 0
    first = F.get(F.filter(paths, some), F.lit(0))
    return F.coalesce(F.when(some(primary), F.array_join(primary, " > ")), F.when(some(first), F.array_join(first, " > ")), F.lit(""))


def ncd_summary(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Rows, latest day and a hash of all days of each table; the hash does not depend on the order of rows."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce(day, F.lit("")))), "\n").cast("binary"), 256)
    return rows.groupBy(key).agg(F.count("*").alias("row_count"), F.max(F.nullif(F.col(day), F.lit(""))).alias("latest"), digest.alias("sha"))


def enrich_plan(seeds: DataFrame, records: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Every seed and endpoint with ``action``: REUSE a latest record that is OK (or, unless errors are tried again, any), else FETCH."""
    wanted = seeds.select("table_key", F.explode(F.array(*map(F.lit, ENDPOINTS))).alias("endpoint"))
    held = records.groupBy("table_key", "endpoint").agg(F.max_by("status", F.struct("retrieved_at", "seq")).alias("status"))
    out = wanted.join(held, ["table_key", "endpoint"], "left")
    usable = (F.col("status") == "OK") | (F.lit(not retry_errors) & F.col("status").isNotNull())
    return out.withColumn("action", F.when(usable, "REUSE").otherwise("FETCH"))
