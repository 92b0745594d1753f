"""Settings files: sections of `key: value` lines, read as rows, with defaults for what they leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The settings of a simulation, with their defaults.
DEFAULTS = {
    "n_boids": 500, "world_size": 100.0, "boundary": "periodic", "max_speed": 2.0, "dt": 0.1, "perception_radius": 10.0, "alignment_weight": 1.0,
    "cohesion_weight": 1.0, "separation_weight": 1.5, "separation_radius": 2.0, "noise_std": 0.1,
}
_LINE = r"^(\s*)([A-Za-z_][A-Za-z0-9_]*):\s*([^#]*?)\s*(?:#.*)?$"


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Files of `key: value` lines under headings -> file, section, key, value (text; quotes are taken off). Comments, empty lines and
    lines of other forms are left out; a key before any heading has a null section. A file is read whole, as text."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    part = lambda n: F.regexp_extract("line", _LINE, n)
    rows = lines.where(F.col("line").rlike(_LINE)).select("file", "no", part(1).alias("indent"), part(2).alias("key"), F.regexp_replace(part(3), r"""^["'](.*)["']$""", "$1").alias("value"))
    heading = F.when((F.col("indent") == "") & (F.col("value") == ""), F.col("key"))
    w = Window.partitionBy("file").orderBy("no")
    rows = rows.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(heading.isNull())
    return rows.select("file", "section", "key", "value")


def resolved(rows: DataFrame, section: str, defaults: dict = DEFAULTS) -> DataFrame:
    """-> file and a typed column a setting: the file's last value, or the default. A key without a default is an error."""
    of = rows.where(F.col("section") == section)
    unknown = [r["key"] for r in of.where(~F.col("key").isin(list(defaults))).select("key").distinct().orderBy("key").limit(20).collect()]
    if unknown:
        raise TypeError(f"unknown settings in {section}: {', '.join(unknown)}")
    kind = {int: "bigint", float: "double", str: "string"}
    got = rows.select("file").distinct().join(of, "file", "left").groupBy("file").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))).alias("m"))
    return got.select("file", *[F.coalesce(F.try_element_at("m", F.lit(k)).cast(kind[type(v)]), F.lit(v)).alias(k) for k, v in defaults.items()])
