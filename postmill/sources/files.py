"""Tables and files that runs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reputation(spark: SparkSession, path: str) -> DataFrame:
    """list, pattern of a reputation file: an object of lists of texts; lower-cased, comments left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select(F.explode("m").alias("list", "json")).select("list", F.explode(F.from_json("json", "array<string>")).alias("pattern"))
    return rows.select("list", F.lower("pattern").alias("pattern"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """job_url, embedding, added_at of a history file in either shape: address to vector, or to an object with a time."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("job_url", "json"))
    old = F.from_json("json", "array<double>")
    new = F.from_json("json", "struct<embedding:array<double>,added_at:string>")
    shaped = F.when(F.col("json").startswith("["), F.struct(old.alias("embedding"), F.lit(None).cast("timestamp").alias("added_at"))).otherwise(F.struct(new["embedding"].alias("embedding"), new["added_at"].try_cast("timestamp").alias("added_at")))
    return m.select("job_url", shaped.alias("s")).select("job_url", "s.*")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name; missing ones are null. ord numbers go on from frame to frame where given."""
    out = None
    for n, df in enumerate(frames):
        df = df.withColumn("ord", F.struct(F.lit(n).alias("frame"), F.col("ord").alias("ord"))) if "ord" in df.columns else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
