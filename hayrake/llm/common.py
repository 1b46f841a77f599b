"""Shared plumbing: session settings, stage tables in the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import uuid
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "file:/tmp/checkpoints"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that bound the memory and disk of the operators here.

    Arrow batches hold at most 2,000 rows and about 16 MB, so that a Python worker never holds many long texts;
    shuffle files of a finished write are removed instead of waiting for the driver's collector.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of this machine where unset in a local session.

    On a cluster a missing setting is an error: each executor would write to its own disk.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/hayrake-{label}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> str:
    """Have a stage table removed when the driver's file system closes, whatever still reads it until then."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def store(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    A lost executor costs nothing then: the table is committed by Spark's own protocol.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stage table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts, most: int = 8 << 20):
    """Runs of rows of an Arrow string column of at most ``most`` bytes, or of one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    past, lo = np.cumsum(size), 0
    while lo < len(size):
        done = past[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(past, done + most, "right")))
        # a copy of its own: Arrow's text kernels can fail on arrays that start inside another one's buffers
        yield texts.take(pa.array(np.arange(lo, hi)))
        lo = hi


def coded_words(texts: list[str], cut: list[list[str]]):
    """Words of texts that single spaces separate, then those of ``cut``: (distinct words, code of each word, ends of the texts)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    more = pa.array([w for words in cut for w in words], pa.large_string())
    coded = pa.concat_arrays([rows.flatten(), more]).dictionary_encode()
    ends = np.concatenate([np.diff(rows.offsets.to_numpy()), [len(words) for words in cut]]).cumsum()
    return coded.dictionary, coded.indices.to_numpy(), ends.astype(np.int64)


class WordMemo:
    """Ids of words, bounded in words and characters, in Arrow and NumPy arrays.

    When it is full, at the start of a slice, the half of the words that occurred in the fewest slices goes; so frequent words
    stay known, and memory depends on the bounds and one slice only.
    """

    def __init__(self, words: int, chars: int):
        self.limit, self.most = words, chars
        self.reset()

    def reset(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.words = pa.array([], pa.large_string())
        self.flat, self.starts, self.hits = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def places(self, words, learn):
        """Where the ids of distinct words are; ``learn`` gives those of new ones, as a list for a list."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.words)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        out = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if not known.all():
            new = words.filter(pa.array(~known))
            ids = learn(new.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            out[~known] = len(self.words) + np.arange(len(ids))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes)])
            self.flat, self.words = np.concatenate([self.flat, flat]), pa.concat_arrays([self.words, new])
        return out

    def prune(self) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        chars = pc.sum(pc.binary_length(self.words)).as_py() or 0
        if len(self.words) <= self.limit and len(self.flat) <= 8 * self.limit and chars <= self.most:
            return
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: min(self.limit, len(self.hits)) // 2])
        flat, sizes = _gathered(self.flat, self.starts, kept)
        words, hits = self.words.take(pa.array(kept)), self.hits[kept] // 2
        self.reset()
        if len(flat) <= 4 * self.limit and (pc.sum(pc.binary_length(words)).as_py() or 0) <= self.most // 2:
            self.words, self.flat, self.starts, self.hits = words, flat, np.concatenate([[0], np.cumsum(sizes)]), hits

    def gather(self, at, ends) -> list:
        """Ids of the texts whose words are at ``at``, cut at ``ends``."""
        import numpy as np

        seen = np.zeros(len(self.words), np.int32)
        seen[at] = 1
        seen[: len(self.hits)] += self.hits
        self.hits = seen
        ids, sizes = _gathered(self.flat, self.starts, at)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _gathered(flat, starts, at):
    import numpy as np

    sizes = np.diff(starts).astype(np.int32)[at]
    shift = starts[:-1][at] - (np.cumsum(sizes, dtype=np.int64) - sizes)
    index = np.arange(int(sizes.sum(dtype=np.int64)))
    index += np.repeat(shift, sizes)
    return flat[index], sizes


_MEMOS: dict = {}


@lru_cache(maxsize=1)
def _libc():
    """The C library; Arrow allocates from it too, so that one limit holds for all large blocks of a worker."""
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


def claim(name: str, clear=lambda: None, block: int = 1 << 18) -> None:
    """Call at a task's start: empties the memos that other operators left in this Python worker, and gives the memory back.

    Blocks of ``block`` bytes and more return to the system as soon as they are freed; workers that process slices of text
    would else keep what their largest slice needed.  A larger one saves time and costs memory.
    """
    lib = _libc()
    others = [k for k in _MEMOS if k != name]
    for other in others:
        _MEMOS.pop(other)()
    _MEMOS[name] = clear
    with contextlib.suppress(AttributeError):
        lib.mallopt(-3, block)
        lib.mallopt(-1, 2 * block)
        if others:
            gc.collect()
            lib.malloc_trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def annotate(df: DataFrame, text: str, keep: list[str], fields: str, build) -> DataFrame:
    """Add columns that Python computes from one text column, batch by batch.

    ``build()`` runs once a task and returns a function from a list of UTF-8 byte strings (None for
    null) to a list of Arrow arrays, one for each of ``fields``.  The kept columns travel in the
    struct ``row``, so no name of theirs can clash with a new one.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    kept = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    slim = df.select(kept.alias("row"), F.col(quoted(text)).cast("string").cast("binary").alias("text"))
    out = df.sparkSession.createDataFrame([], fields).schema
    names = ["row", *out.names]

    def run(batches):
        work = build()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *work(b.column(1).to_pylist())], names=names)

    schema = type(out)([slim.schema["row"], *out.fields])
    return slim.mapInArrow(run, schema)
