"""Sources and sinks.  Paths go to Spark's readers and writers only, so any file system will do."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table; named columns reach the scan as its read schema."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: shuffled and sorted, never collected for a broadcast.

    The planner measures a Parquet side by its bytes on disk; repetitive columns take tens of times as much in the driver's memory.
    """
    return df.hint("merge")


def require(df: DataFrame, unique: str | None = None, pattern: tuple[str, str] | None = None) -> DataFrame:
    """One row with the numbers of repeated keys, null keys and keys of another format."""
    key = F.col(unique or pattern[0])
    wrong = F.count_if(~key.cast("string").rlike(pattern[1])) if pattern else F.lit(0)
    return df.agg((F.count("*") - F.count_distinct(key) - F.count_if(key.isNull())).alias("repeated"), F.count_if(key.isNull()).alias("missing"), wrong.alias("malformed"))


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> str:
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return path


def rewrite_if_large(spark: SparkSession, path: str, most: int = 100 << 20, codec: str = "zstd") -> bool:
    """Rewrite a Parquet table under a stronger codec where it has more than ``most`` bytes; whether it was."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getContentSummary(target).getLength() <= most:
        return False
    smaller = f"{path}-{uuid.uuid4().hex}"
    spark.read.parquet(path).write.option("compression", codec).parquet(smaller)
    system.delete(target, True)
    return system.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(smaller), target)


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """UTF-8, header, line feeds; as many files as partitions, or one for answers that a platform takes as one file."""
    df = df.coalesce(1) if single else df
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)
    return path


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; empty fields stay empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("emptyValue", "").option("nullValue", "\x00").csv(path)
    return df.na.fill("")


def write_json(df: DataFrame, path: str) -> str:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``write_json`` under a stated schema; lines that do not fit are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Schemes whose ends alone can be read by executors; files elsewhere are read whole for their footers.
DIRECT = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _parquet_files(spark: SparkSession, path: str) -> list[str]:
    """All Parquet files below a path; only their names reach the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, each = [], system.listFiles(target, True)
    while each.hasNext():
        name = each.next().getPath().toString()
        if name.endswith(".parquet") and not name.rpartition("/")[2].startswith(("_", ".")):
            found.append(name)
    return sorted(found)


FOOTER = "file string, row_group int, n_rows bigint, column string, compressed bigint, uncompressed bigint, n_values bigint, n_nulls bigint, codec string"


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per column chunk of every row group of a Parquet table, from the files' footers alone.

    Executors read the footers, each task those of its share of the files; no row of the table is read.
    """
    files = _parquet_files(spark, path)

    def rows_of(name: str, source) -> list[tuple]:
        import pyarrow.parquet as pq

        meta, out = pq.read_metadata(source), []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                chunk = group.column(c)
                nulls = chunk.statistics.null_count if chunk.is_stats_set and chunk.statistics.has_null_count else None
                out.append((name, g, group.num_rows, chunk.path_in_schema, chunk.total_compressed_size, chunk.total_uncompressed_size, chunk.num_values, nulls, chunk.compression))
        return out

    def by_name(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                scheme, _, rest = name.partition(":")
                system, at = fs.FileSystem.from_uri(f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else name)
                with system.open_input_file(at) as source:
                    yield _batch(pa, rows_of(name, source))

    def by_content(batches):
        import io

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _batch(pa, rows_of(name, io.BytesIO(content)))

    if all(name.partition(":")[0] in DIRECT for name in files):
        names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism * 4)))
        return names.mapInArrow(by_name, FOOTER)
    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(by_content, FOOTER)


def _batch(pa, rows: list[tuple]):
    names = [c.split()[0] for c in FOOTER.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def footer_profile(found: DataFrame) -> DataFrame:
    """Rows, row groups, files and bytes of a table, from its ``footers``."""
    groups = found.groupBy("file", "row_group").agg(F.max("n_rows").alias("n"), F.sum("compressed").alias("c"), F.sum("uncompressed").alias("u"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_distinct("file").alias("n_files"), F.sum("c").alias("compressed"), F.sum("u").alias("uncompressed"))


def column_profile(found: DataFrame, most: int = 6) -> DataFrame:
    """(column, values, nulls, compressed, uncompressed, place) of the largest columns of a table, from its ``footers``."""
    per = found.groupBy("column").agg(F.sum("n_values").alias("n_values"), F.sum("n_nulls").alias("n_nulls"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"))
    place = F.row_number().over(Window.orderBy(F.desc("uncompressed"), "column"))
    return per.withColumn("place", place).where(F.col("place") <= most)


def fingerprint(**inputs) -> str:
    """Name of a cached result: equal inputs and settings, equal name."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, name: str, make, **inputs) -> DataFrame:
    """The stored result for these inputs; made and committed where it is missing."""
    path = f"{folder}/{name}-{fingerprint(**inputs)}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder of ``spark.checkpoint.dir``, read back: later plans start from it.

    Several plans share what they have in common without computing it again, and a lost executor costs nothing.  The table goes
    when the driver's file system closes.  Where the setting is missing, a folder of the local machine serves local sessions; on
    a cluster that is an error, as other machines would not see it.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file:/tmp/checkpoints"
    path = f"{folder.rstrip('/')}/hayrake-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Remove the files of a stage table that no plan reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_INDEXES: dict[tuple, tuple[str, T.StructType]] = {}


def _state(spark: SparkSession, source: str) -> tuple:
    """What changes when a table's files do: its path, bytes, files and time of change."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = system.getContentSummary(target)
    return source, size.getLength(), size.getFileCount(), system.getFileStatus(target).getModificationTime()


def indexed(spark: SparkSession, source: str | list[str], name: str, make) -> DataFrame:
    """A stage table that is made once a session for source paths as they stand, and read again by every later query.

    The key holds the sources' bytes, files and times of change, so that a source that was written anew gets a new index.
    """
    sources = [source] if isinstance(source, str) else source
    key = (spark.sparkContext.applicationId, name, *(_state(spark, x) for x in sources))
    if key not in _INDEXES:
        made = staged(make(), f"index-{name}")
        _INDEXES[key] = made.inputFiles()[0].rpartition("/")[0] if made.inputFiles() else "", made.schema
        if not _INDEXES[key][0]:
            del _INDEXES[key]
            return made
    path, schema = _INDEXES[key]
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Remove this session's indexes from the shared folder; how many there were.  Later queries make new ones."""
    mine = [key for key in _INDEXES if key[0] == spark.sparkContext.applicationId]
    for key in mine:
        path, _ = _INDEXES.pop(key)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(mine)


def digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest: the sum of 60 bits of the SHA-256 of each row, columns in order of name, nulls as \\0."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
