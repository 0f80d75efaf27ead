"""Scans and sinks of sensor tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.functions.exprs import clean_nan

# Column names which are taken as the clock, in order of preference.
TIME_NAMES = ("hour", "timestamp", "datetime", "time", "date_hour")


# Text files keep microseconds.
CSV_OPTIONS = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; NaN in its float columns is NULL from here on."""
    return clean_nan(spark.read.parquet(f"{folder}/{name}.parquet"))


def read_csv(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Header CSV files under one declared schema; no inference pass over the data. NaN is NULL."""
    return clean_nan(spark.read.schema(schema).options(**CSV_OPTIONS).csv(list(paths) if not isinstance(paths, str) else paths))


def existing_paths(spark: SparkSession, paths) -> set[str]:
    """Those of the paths that exist; every parent folder is listed once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    by_parent: dict[str, dict[str, list[str]]] = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        by_parent.setdefault(str(path.getParent()), {}).setdefault(path.getName(), []).append(p)
    found: set[str] = set()
    for parent, names in by_parent.items():
        folder = jvm.org.apache.hadoop.fs.Path(parent)
        fs = folder.getFileSystem(conf)
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                found.update(names.get(status.getPath().getName(), ()))
    return found


def read_existing(spark: SparkSession, paths, schema: str, fmt: str = "csv", on_missing=None) -> DataFrame:
    """Union of the paths which exist, each row tagged ``source_path``; an error when none is left."""
    there = existing_paths(spark, paths)
    found = [p for p in paths if p in there]
    for p in paths:
        if p not in there and on_missing:
            on_missing(p)
    if not found:
        raise FileNotFoundError("none of the given paths exists")
    d = spark.read.schema(schema).format(fmt).options(**CSV_OPTIONS).load(found)
    return clean_nan(d.withColumn("source_path", F.col("_metadata.file_path")))


def find_time_column(columns) -> str | None:
    """Column that holds the clock: an exact known name first, else the first whose name has date or time in it."""
    lower = {c.lower(): c for c in reversed(list(columns))}
    exact = [lower[n] for n in TIME_NAMES if n in lower]
    partial = [c for c in columns if "date" in c.lower() or "time" in c.lower()]
    return next(iter(exact + partial), None)


def find_value_column(columns, keywords) -> str | None:
    """First column with a keyword in its name, preferring one which is a mean."""
    hits = [c for c in columns if any(k in c.lower() for k in keywords)]
    return next(iter([c for c in hits if "mean" in c.lower()] + hits), None)


def with_time(df: DataFrame, out: str = "time") -> DataFrame:
    """Rename the clock column and coerce it; unreadable values become NULL."""
    name = find_time_column(df.columns)
    if name is None:
        raise ValueError(f"no time column among {df.columns}")
    value = F.col(name) if dict(df.dtypes)[name].startswith("timestamp") else F.try_to_timestamp(F.col(name))
    return df.withColumn(name, value).withColumnRenamed(name, out)


def numeric_columns(df: DataFrame, prefixes=None) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    names = [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]
    return names if prefixes is None else [n for n in names if n.startswith(tuple(prefixes))]


def by_modality(columns, prefixes=("aud_", "vid_", "env_")) -> list[str]:
    """Stable regrouping of feature columns by modality prefix."""
    return [c for p in prefixes for c in columns if c.startswith(p)]


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def first_rejection(rules: dict) -> Column:
    """Name of the first rule that a row breaks; NULL for a good row."""
    return reduce(lambda tail, r: F.when(r[1], F.lit(r[0])).otherwise(tail), reversed(list(rules.items())), F.lit(None))


def split_rejects(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their ``reason``; two sinks over one scan definition."""
    tagged = df.withColumn("reason", first_rejection(rules))
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def reject_share(df: DataFrame, rules: dict, keys=(), warn_above: float = 0.05) -> DataFrame:
    bad = first_rejection(rules).isNotNull()
    d = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_rejected"))
    d = d.withColumn("share", F.col("n_rejected") / F.col("n_rows"))
    return d.withColumn("warn", F.col("share") > warn_above)


def parse_probe(doc: Column) -> Column:
    """Container metadata JSON -> (creation_time, duration, frame_rate, timecode, width) of the first video stream."""
    schema = (
        "format struct<duration:string,tags:struct<creation_time:string>>,"
        "streams array<struct<codec_type:string,avg_frame_rate:string,width:int,tags:struct<timecode:string>>>"
    )
    rec = F.from_json(doc, schema)
    video = F.get(F.filter(rec["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.struct(
        rec["format"]["tags"]["creation_time"].alias("creation_time"),
        rec["format"]["duration"].try_cast("double").alias("duration_s"),
        video["avg_frame_rate"].alias("avg_frame_rate"),
        video["tags"]["timecode"].alias("timecode"),
        video["width"].alias("width"),
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive file listing as a table; the file bytes are never read because ``content`` is pruned."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.select("path", "modificationTime", "length")


def media_files(paths: DataFrame, extensions, path: str = "path") -> DataFrame:
    """Distinct media paths; hidden ``._`` shadow copies and other extensions are left out."""
    ext = "|".join(e.lstrip(".") for e in extensions)
    p = F.col(path)
    keep = F.lower(p).rlike(rf"\.({ext})$") & ~p.rlike(r"(^|/)\._[^/]*$")
    return paths.filter(keep).select(path).distinct()
