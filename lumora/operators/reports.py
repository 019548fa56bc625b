"""Registries of numbers, the tables made of them, and a self-contained report."""

from __future__ import annotations

import base64
import html
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import improvement, signed_percent
from ..sources.formats import exists


def entries(section: str, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """section, key, value of each column of a table with one row."""
    names = [c for c, t in one_row.dtypes if t not in ("string", "boolean")]
    each = F.explode(F.array(*(F.struct(F.lit(prefix + c).alias("key"), F.col(c).cast("double").alias("value")) for c in names)))
    return one_row.select(each.alias("x")).select(F.lit(section).alias("section"), "x.key", "x.value")


def registry(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document of sections and their keys; null values are left out."""
    per = rows.where("value is not null").groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("numbers"))
    parts = F.array_sort(F.collect_list(F.struct("section", F.to_json("numbers").alias("j"))))  # a row a section; maps themselves have no order
    return per.agg(F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), x["section"], F.lit('":'), x["j"])), ","), F.lit("}")).alias("document"))


def improvements(rows: DataFrame, name: str, value: str, base: str) -> DataFrame:
    """name, value, improvement_pct against the row called base, is_best (the largest value, the first name on a tie)."""
    b = rows.where(F.col(name) == base).agg(F.max(value).alias("base__"))
    best = rows.agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))["n"].alias("best__"))
    j = rows.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(best))
    return j.select(name, F.round(value, 4).alias(value), F.round(F.coalesce(F.try_divide((F.col(value) - F.col("base__")) * 100, F.col("base__")), F.lit(0.0)), 6).alias("improvement_pct"), (F.col(name) == F.col("best__")).alias("is_best"))


def runs(listing: DataFrame, most: int | None = None) -> DataFrame:
    """run_id, created_at, position: the newest first, runs without a time last."""
    order = W.orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "run_id")
    out = listing.select("run_id", "created_at", F.row_number().over(order).alias("position"))
    return out if most is None else out.where(F.col("position") <= most)


def stages(parts: list[tuple[str, DataFrame]], label: str) -> DataFrame:
    """position, stage, n_sequences, n_classes of the steps by which a data set came about, in their order."""
    rows = [df.agg(F.count("*").alias("n_sequences"), F.countDistinct(label).alias("n_classes")).select(F.lit(i).cast("long").alias("position"), F.lit(name).alias("stage"), "n_sequences", "n_classes") for i, (name, df) in enumerate(parts, 1)]
    return registry(rows)


def ablation(rows: DataFrame, name: str, metrics: list[str], base: str) -> DataFrame:
    """name, the metrics to four places, and by how much the first of them is above that of the row called base, as text."""
    b = rows.where(F.col(name) == base).agg(F.max(metrics[0]).alias("base__"))  # one row
    return rows.crossJoin(F.broadcast(b)).select(name, *(F.round(m, 4).alias(m) for m in metrics), signed_percent(improvement(F.col(metrics[0]), F.col("base__"))).alias("improvement"))


def methods(rows: DataFrame, order: list[str]) -> DataFrame:
    """position, method, accuracy, macro_f1, log_loss (N/A where there is none, or 0): methods in the order given, then the others by name."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in order)), F.col("method")), F.lit(0))
    at = F.row_number().over(W.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), "method"))  # a row a method
    loss = F.when(F.coalesce(F.col("log_loss"), F.lit(0.0)) != 0, F.round("log_loss", 4).cast("string")).otherwise("N/A")
    return rows.select(at.alias("position"), "method", *(F.round(F.coalesce(m, F.lit(0.0)), 4).alias(m) for m in ("accuracy", "macro_f1")), loss.alias("log_loss"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new, which replace those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def merged(spark: SparkSession, paths: list[str], older: list[str] = ()) -> DataFrame:
    """section, key, value of all stored registries that are there; a section that none of them has comes from the older ones, the first that has it."""
    shape = "section string, key string, value double"
    read = lambda names: [spark.read.parquet(p).selectExpr("cast(section as string) section", "cast(key as string) key", "cast(value as double) value") for p in names if exists(spark, p)]
    out = reduce(DataFrame.unionByName, read(paths), spark.createDataFrame([], shape))
    for old in read(older):
        out = out.unionByName(old.join(out.select("section").distinct(), "section", "left_anti").select("section", "key", "value"))
    return out


def formatted(rows: DataFrame, formats: dict[str, str]) -> DataFrame:
    """rows with some columns as text in the given formats, as summary files have them."""
    return rows.select(*(F.format_string(formats[c], F.col(c)).alias(c) if c in formats else F.col(c) for c in rows.columns))


def run_name() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d_%H%M%S")


def run_id(at: Column) -> Column:
    """The name of a run that began at a time."""
    return F.date_format(at, "yyyy-MM-dd_HHmmss")


def run_day(run: Column) -> Column:
    """The day in a run's name; null if there is none."""
    return F.nullif(F.regexp_extract(run, r"^(\d{4}-\d{2}-\d{2})_\d{6}", 1), F.lit(""))


def run_init(spark: SparkSession, folder: str, run: str, note: str = "", force: bool = False) -> str:
    """A folder for a run; one that is there is an error unless forced, which clears it."""
    path = f"{folder}/runs/run_id={run}"
    if exists(spark, path) and not force:
        raise FileExistsError(path)
    spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").json(path)
    return path


def set_current(spark: SparkSession, folder: str, run: str) -> None:
    if not exists(spark, f"{folder}/runs/run_id={run}"):
        raise FileNotFoundError(f"{folder}/runs/run_id={run}")
    spark.createDataFrame([(run,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")


def run_listing(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, note, is_current, position of all runs, the newest first."""
    rows = spark.read.schema("note string, run_id string").option("basePath", f"{folder}/runs").json(f"{folder}/runs")
    now = spark.read.text(f"{folder}/current").agg(F.max("value").alias("now"))  # one row
    at = F.row_number().over(W.orderBy(F.desc("run_id")))  # a row a run
    return rows.crossJoin(F.broadcast(now)).select("run_id", "note", F.coalesce(F.col("run_id") == F.col("now"), F.lit(False)).alias("is_current"), at.alias("position"))


STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}.card{display:inline-block;padding:1em;margin:.5em;border:1px solid #ccc}"


def page(title: str, cards: dict[str, str], tables: dict[str, DataFrame], figures: dict[str, bytes] | None = None, checks: DataFrame | None = None, most: int = 1000) -> str:
    """A report as one HTML text; tables are small registry tables (more than most rows is an error)."""
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>"]
    out += [f"<div class='card'><b>{html.escape(v)}</b><br>{html.escape(k)}</div>" for k, v in cards.items()]
    for name, df in (({"Checks": checks} if checks is not None else {}) | tables).items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    for name, png in (figures or {}).items():
        out.append(f"<h2>{html.escape(name)}</h2><img alt='{html.escape(name)}' src='data:image/png;base64,{base64.b64encode(png).decode()}'>")
    return "".join(out) + "</body></html>"
