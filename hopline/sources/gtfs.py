"""Feeds of timetable text files, laid out as ``<root>/source=<feed>/<table>.txt``, and the tables written from them."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.sources.schema import SORT_KEYS, TABLES, typed


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def feeds(spark: SparkSession, root: str, table: str, glob: str = "*") -> list[tuple[str, str]]:
    """(source, path) of the feeds that match ``glob`` (as ``it_*``) and have the table, by name."""
    fs, p = _fs(spark, f"{root}/source={glob}/{table}.txt")
    found = [str(s.getPath()) for s in fs.globStatus(p) or []]
    return sorted((path.rpartition("/source=")[2].split("/")[0], path) for path in found)


def headers(spark: SparkSession, root: str, table: str, glob: str = "*") -> dict[str, list[str]]:
    """Columns of each feed's file, in its own order."""
    out = {}
    for source, path in feeds(spark, root, table, glob):
        head = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        out[source] = [c.strip().lstrip("﻿") for c in head.columns]
    return out


def read_raw(spark: SparkSession, root: str, table: str, glob: str = "*") -> DataFrame:
    """All feeds of a table as text, bound by header name: other orders, extra and absent columns are fine. Adds ``source``.

    Feeds with equal headers are read together, so the plan has a scan for each distinct header rather than for each feed.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for _, path in feeds(spark, root, table, glob):
        head = spark.read.option("header", True).csv(path).columns
        by_header.setdefault(tuple(head), []).append(path)
    wanted = list(TABLES[table])
    if not by_header:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ["source", *wanted]]))
    parts = []
    for head, paths in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
        df = spark.read.schema(schema).option("header", True).option("basePath", root).csv(paths)
        names = {c.strip().lstrip("﻿").strip('"'): c for c in head}
        cols = [(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(c) for c in wanted]
        parts.append(df.select(F.col("source").cast("string").alias("source"), *cols))
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, root: str, table: str, glob: str = "*") -> DataFrame:
    """A typed table: text never null, numbers and dates with the defaults of ``schema.TABLES``, times as seconds of the service day."""
    return read_raw(spark, root, table, glob).select("source", *(typed(c, k) for c, k in TABLES[table].items()))


def read_inferred(spark: SparkSession, root: str, table: str, glob: str = "*") -> DataFrame:
    """Feeds with inferred types, for a first look; columns by name, absent ones null."""
    parts = [spark.read.option("header", True).option("inferSchema", True).csv(p).withColumn("source", F.lit(s)) for s, p in feeds(spark, root, table, glob)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def write_table(df: DataFrame, path: str, sort: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """A Parquet table, sorted within files by its access path, so that row-group statistics prune reads. ``ignore`` keeps what is there."""
    if sort:
        # sixteen ways within the first key, so that one large source is not one task
        df = df.repartition(F.col(sort[0]), F.xxhash64(*sort) % 16).sortWithinPartitions(*sort)
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_base_table(spark: SparkSession, root: str, table: str, out: str) -> DataFrame:
    return write_table(read_table(spark, root, table), f"{out}/{table}", SORT_KEYS[table])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def swap_in(df: DataFrame, path: str) -> DataFrame:
    """Replace a table while it may be read, also by ``df`` itself: write beside it, then rename. If the second rename fails, the old table is put back."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    fs, new = _fs(spark, beside)
    _, old = _fs(spark, path)
    _, gone = _fs(spark, f"{beside}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, gone):
        raise OSError(f"{path} could not be moved away")
    try:
        done = fs.rename(new, old)
    except Exception:
        done = False
    if not done:
        if had:
            fs.rename(gone, old)
        raise OSError(f"the new table could not be moved to {path}")
    if had:
        fs.delete(gone, True)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV files with a header, by a schema or with inferred types."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_text_table(df: DataFrame, path: str) -> None:
    """A feed's table as one text file of this very name, as feeds are published. One task; a feed's stops and the like, not its stop times."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    write_csv(df, beside, one_file=True)
    fs, folder = _fs(spark, beside)
    (part,) = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    fs.rename(part, _fs(spark, path)[1])
    fs.delete(folder, True)


def _ipc(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def write_arrow(df: DataFrame, path: str) -> None:
    """Arrow files, one for each Arrow batch of each task, in a Parquet table (n, file): Spark's own committed writer, nothing through the driver."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([_ipc(batch)], pa.binary())], ["n", "file"])

    df.mapInArrow(run, "n long, file binary").write.parquet(path)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType, single: bool = False) -> DataFrame:
    """Rows of the Arrow files that ``write_arrow`` wrote, or with ``single`` of whole Arrow files (``*.arrow``) in a folder."""
    files = spark.read.format("binaryFile").load(path).select(F.col("content").alias("file")) if single else spark.read.parquet(path).select("file")
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("file"):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_py()))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i).select(names)

    return files.mapInArrow(run, schema)


def write_map_layer(df: DataFrame, path: str, title: str, raw: bool = True, flip: bool = False, scale: str = "linear", **meta) -> None:
    """(index, value) as one CSV file for the map viewer, cells in hex, with a JSON file of how to show it."""
    write_csv(df.select(F.lower(F.hex("index")).alias("index"), "value").orderBy("index"), f"{path}/data", one_file=True)
    text = json.dumps({"title": title, "raw": raw, "flip": flip, "scale": scale, **meta}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def arrow_bytes(df: DataFrame) -> bytes:
    """A small result as an Arrow stream, as an HTTP handler would send it."""
    import pyarrow as pa

    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def cell_id(text):
    """A cell written in hex -> its id."""
    return F.conv(text, 16, 10).cast("long")
