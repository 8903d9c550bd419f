"""Feature tables, metadata, images, stain tables and caches as Spark tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.functions import names
from eigenloom.roles import require_columns
from eigenloom.session import path_exists

#: Columns that are identifiers, whatever they look like.
ID_COLUMNS = ("slide_id", "sample_id", "scanner_id", "tile_id", "image_id", "pair_id", "filename", "path")


def read_metadata(spark: SparkSession, path: str, required=("tile_id", "scanner_id")) -> DataFrame:
    """Metadata CSV: identifiers are strings, ``image_id`` and ``slide_id`` come from the tile id where absent."""
    df = require_columns(spark.read.csv(path, header=True, inferSchema=True), list(required))
    df = df.withColumns({c: F.col(c).cast("string") for c in ID_COLUMNS if c in df.columns})
    if "image_id" not in df.columns and "tile_id" in df.columns:
        df = df.withColumn("image_id", names.image_id("tile_id"))
    return df if "slide_id" in df.columns or "tile_id" not in df.columns else df.withColumn("slide_id", names.slide_id("tile_id"))


def read_features(spark: SparkSession, path: str, vector: str = "embedding", required=()) -> DataFrame:
    """A feature table in Parquet: keys, metadata and an array column."""
    return require_columns(spark.read.parquet(path), [vector, *required])


def write_features(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """Metadata as strings, vectors as floats."""
    kept = [F.col(c).cast("array<float>").alias(c) if c == vector else F.col(c) if c == "row_id" else F.col(c).cast("string").alias(c) for c in df.columns]
    df.select(*kept).write.mode("overwrite").parquet(path)


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """An NPZ of ``features`` and metadata keys, read on the driver: (row_id, metadata strings, embedding)."""
    with np.load(path, allow_pickle=False) as data:
        features = np.asarray(data["features"], np.float32)
        meta = {k: data[k].astype(str) for k in data.files if k != "features"}
    if any(len(v) != len(features) for v in meta.values()):
        raise ValueError("metadata and features differ in length")
    rows = [(i, *(str(v[i]) for v in meta.values()), x.tolist()) for i, x in enumerate(features)]
    return spark.createDataFrame(rows, ", ".join(["row_id long", *(f"`{k}` string" for k in meta), "embedding array<float>"]))


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], *, config: dict | None = None, force: bool = False) -> DataFrame:
    """The table at ``path``, computed and written where it is missing or forced.

    With ``config`` the table remembers what it was made with; a table made
    otherwise is an error, never silently made again.
    """
    side = f"{path}.config"
    if path_exists(spark, path) and not force:
        if config is not None:
            if not path_exists(spark, side):
                raise ValueError(f"{path} has no record of its configuration")
            check_config(json.loads(spark.read.json(side).toJSON().first())["config"], config)
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    if config is not None:
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").write.mode("overwrite").json(side)
    return spark.read.parquet(path)


def check_config(found: str, wanted: dict) -> None:
    """Field by field; lists in order."""
    have = json.loads(found)
    wanted = json.loads(json.dumps(wanted))
    if wrong := sorted(k for k in have.keys() | wanted.keys() if have.get(k) != wanted.get(k)):
        raise ValueError(f"made with another {', '.join(wrong)}")


def write_stain_table(df: DataFrame, path: str) -> None:
    """Stain rows by target, so that a target's rows are read alone."""
    require_columns(df, ["source_row_index", "target_index", "target_id"]).write.mode("overwrite").partitionBy("target_id").parquet(path)


def read_stain_table(spark: SparkSession, path: str, targets: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.withColumn("target_id", F.col("target_id").cast("string"))
    return df if targets is None else df.filter(F.col("target_id").isin(targets))


def read_stain_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, scanner_id, matrix) from Parquet; each key once."""
    df = require_columns(spark.read.parquet(path), ["slide_id", "scanner_id", "matrix"])
    if not df.groupBy("slide_id", "scanner_id").count().filter("count > 1").isEmpty():
        raise ValueError("a slide and scanner have two matrices")
    return df


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, filename, slide_id, sample_id, tile_id, scanner_id, image_id) of image files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    filename = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    parts = names.file_fields("path")
    return files.select("path", filename.alias("filename"), parts.alias("p"), stem.alias("tile_id")).select("path", "filename", "p.slide_id", "p.sample_id", "p.scanner_id", "tile_id", names.image_id("tile_id").alias("image_id"))


def image_contents(files: DataFrame, metadata: DataFrame, folder: str, extensions=("jpg", "png", "tif")) -> DataFrame:
    """Metadata rows with the content of their file: by ``path``, else ``filename``, else id and extension; none or two is an error."""
    spark = metadata.sparkSession
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    keyed = stored.withColumn("_file", F.substring_index("path", "/", -1)).drop("path")
    own = F.col("filename") if "filename" in metadata.columns else None
    wanted = [own] if own is not None else [F.concat("tile_id", F.lit(f".{e}")) for e in extensions]
    rows = metadata.withColumn("_file", F.explode(F.array(*wanted)))
    found = rows.join(keyed, "_file")
    counts = metadata.join(found.groupBy("tile_id").count(), "tile_id", "left").filter("count IS NULL OR count > 1")
    if not counts.isEmpty():
        raise FileNotFoundError(f"no single file for {[r.tile_id for r in counts.select('tile_id').limit(3).collect()]}")
    return found.drop("_file")


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table as one file set; Spark's commit makes it whole or absent."""
    flat = df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns])
    writer = flat.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)


def write_augmentation_deltas(df: DataFrame, path: str, config: dict) -> None:
    """(row_index, delta): several deltas a row."""
    require_columns(df, ["row_index", "delta"]).withColumn("config", F.lit(json.dumps(config, sort_keys=True))).write.mode("overwrite").parquet(path)
