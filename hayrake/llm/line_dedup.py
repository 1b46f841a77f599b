"""Line dedup: a suffix array over line numbers, by distributed prefix doubling, in DataFrame functions only.

The sequence is all non-blank lines of all documents in order of (doc_id, text).  A round of doubling ranks the
suffixes by their first 2^k lines: the rank of a pair (rank at i, rank at i + 2^(k-1)) is its place among the sorted
distinct pairs.  Suffixes whose prefix occurs once leave: their place is settled and they start no repeated run.  Suffixes of equal
rank form the intervals of the suffix array whose longest common prefix is at least 2^k lines.

A repeated run counts from MIN_WORDS words on.  Every line of such a run lies in a window of lines that just
reaches MIN_WORDS words, forwards from its first line or backwards from its last, and such a window has MIN_WORDS lines at most.
So doubling ends at that depth, and a window of n lines is named by its two overlapping
intervals of 2^k <= n lines.  Windows of one name are copies; the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, prepare, quoted, store, table

MIN_WORDS = 50
#: Lines of one document that a position can number; more raise an error.
_LINES = 26
_BLANKS = " \t\r\x0b\x0c"
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(_WORD))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    return docs.select(whole.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("hash"), text.alias("text"))


def _in_order(df: DataFrame, by: list[str], label: str) -> tuple[DataFrame, str]:
    """Distinct rows with ``place``: numbers that rise in the order of ``by``; stored, so that they stay."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return store(ordered.withColumn("place", F.monotonically_increasing_id()), label)


def _numbered(keyed: DataFrame) -> tuple[DataFrame, str]:
    """(doc_id, hash, doc): documents numbered without gaps; rows that repeat both are one document."""
    ids, path = _in_order(keyed.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "line-docs")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ids.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = ids.withColumn("part", part).join(starts, "part")
    return numbered.select("doc_id", "hash", (F.col("start") + row).alias("doc")), path


def _repeated(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups with more than one position, and their first."""
    return df.groupBy(*by).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last").select(*by)


def _ranked(df: DataFrame, by: list[str], name: str, label: str) -> tuple[DataFrame, list[str]]:
    """Add the rank of ``by`` among its sorted distinct values; null where it occurs once."""
    ranks, ranks_path = _in_order(_repeated(df.where(F.col(by[-1]).isNotNull()), by), by, f"{label}-ranks")
    joined, path = store(df.join(ranks.withColumnRenamed("place", name), by, "left"), label)
    return joined, [ranks_path, path]


def repeated_windows(keyed: DataFrame, min_words: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, hash, windows): later copies as (first, n), counted in non-blank lines."""
    docs, docs_path = _numbered(keyed)
    line = F.transform(_lines(F.col("text")), lambda x: F.struct(_words(x).alias("words"), F.unhex(F.md5(F.rtrim(x, F.lit(_BLANKS)).cast("binary"))).alias("line")))
    exploded = keyed.select("doc_id", "hash", F.posexplode(F.filter(line, lambda x: x["words"] > 0)).alias("i", "x"))
    same = [exploded["doc_id"].eqNullSafe(docs["doc_id"]), exploded["hash"] == docs["hash"]]
    pos = F.col("doc") * (1 << _LINES) + F.when(F.col("i") < (1 << _LINES), F.col("i")).otherwise(F.raise_error(F.lit("too many lines in a document")))
    lines, lines_path = store(exploded.join(docs, same).select("doc", "i", pos.alias("pos"), "x.line", "x.words"), "lines")
    active, paths = _ranked(lines, ["line"], "r0", "line-active")
    paths = [docs_path, lines_path, *paths]

    # islands of neighbouring lines that all occur elsewhere, with word counts up to each
    active = active.where("r0 is not null").repartition("doc").dropDuplicates(["doc", "i"]).drop("line")
    active = active.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("doc").orderBy("i")))
    inside = Window.partitionBy("doc", "island").orderBy("i")
    active = active.withColumn("upto", F.sum("words").over(inside)).withColumn("before", F.col("upto") - F.col("words"))
    ahead, behind = inside.rowsBetween(0, min_words - 1), inside.rowsBetween(1 - min_words, 0)
    needs = F.filter(F.collect_list("upto").over(ahead), lambda c: c < F.col("before") + min_words)
    short = F.filter(F.collect_list("before").over(behind), lambda c: c > F.col("upto") - min_words)
    fits = lambda n, there: F.when(F.size(n) < F.size(there), F.size(n) + 1)
    active = active.select(
        "doc", "island", "i", "pos", "r0",
        fits(needs, F.collect_list("upto").over(ahead)).alias("forth"),
        fits(short, F.collect_list("before").over(behind)).alias("back"),
    )
    active, path = store(active, "line-windows")
    paths.append(path)
    longest = active.agg(F.max(F.greatest("forth", "back"))).first()[0] or 0
    depth = 0
    while 2 << depth <= longest:
        step = Window.partitionBy("doc").orderBy("i").rangeBetween(1 << depth, 1 << depth)
        paired = active.withColumn("next", F.max(f"r{depth}").over(step))
        active, more = _ranked(paired.withColumn("next", F.when(F.col(f"r{depth}").isNotNull(), F.col("next"))), [f"r{depth}", "next"], f"r{depth + 1}", f"line-depth{depth + 1}")
        active = active.drop("next")
        paths += more
        depth += 1

    def window(size: str, frame, from_end: bool) -> DataFrame:
        """Windows of ``size`` lines with the names of their two overlapping intervals."""
        out = active
        for k in range(depth + 1):
            out = out.withColumn(f"n{k}", F.collect_list(F.coalesce(f"r{k}", F.lit(-1))).over(frame))
        n = F.col(size)
        at = (lambda k: F.size(f"n{k}") - n) if from_end else (lambda k: F.lit(0))
        a, b = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for k in range(depth + 1):
            fit = (n >= 1 << k) & (n < 2 << k)
            a = F.when(fit, F.get(f"n{k}", at(k))).otherwise(a)
            b = F.when(fit, F.get(f"n{k}", at(k) + n - (1 << k))).otherwise(b)
        shift = n - 1 if from_end else F.lit(0)
        found = out.where(n.isNotNull()).select("doc", (F.col("i") - shift).alias("i"), (F.col("pos") - shift).alias("pos"), n.alias("n"), a.alias("a"), b.alias("b"))
        return found.where("a >= 0 and b >= 0")

    windows = window("forth", ahead, False).unionByName(window("back", behind, True))
    windows, path = store(windows, "line-named")
    paths.append(path)
    firsts = windows.groupBy("n", "a", "b").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last").drop("last")
    # stored, so that Spark can split a name with many windows in the join
    firsts, path = store(firsts, "line-firsts")
    paths.append(path)
    later = windows.join(firsts, ["n", "a", "b"]).where("first + n <= pos")
    of_doc = later.groupBy("doc").agg(F.collect_set(F.struct(F.col("i").cast("int").alias("first"), "n")).alias("windows"))
    found, path = store(of_doc.join(docs, "doc").select("doc_id", "hash", "windows"), "line-copies")
    for old in paths:
        discard(keyed.sparkSession, old)
    return found, [path]


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where ``use`` reads it in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _without(lines: Column, windows: Column) -> Column:
    """Struct (n_removed, text) of lines from which windows of non-blank lines are taken."""
    number = lambda x: F.sequence(F.lit(0), F.size(x) - 1)

    def cut(s: Column) -> Column:
        full = F.filter(F.transform(s["lines"], lambda x, k: F.when(_words(x) > 0, k)), lambda k: k.isNotNull())
        covered = F.flatten(F.transform(s["windows"], lambda w: F.sequence(w["first"], w["first"] + w["n"] - 1)))
        gone = _let(F.struct(full.alias("full"), covered.alias("covered")), lambda t: F.transform(F.array_distinct(t["covered"]), lambda k: F.get(t["full"], k)))
        return _let(gone, lambda g: F.struct(F.size(g).alias("n_removed"), F.array_join(F.transform(F.array_except(number(s["lines"]), g), lambda k: F.get(s["lines"], k)), "\n").alias("text")))

    return _let(F.struct(lines.alias("lines"), windows.alias("windows")), cut)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (struct of all columns), n_lines, n_removed and the cleaned text of every row.

    A line goes when it lies in a run of lines with at least ``min_words`` words that also stands, without
    overlap, at an earlier place in the order of doc_id (nulls first), text hash and line.  Blank lines never go and
    do not interrupt a run; white space at a line's end does not count.  Rows that repeat doc_id and
    text are one document and get the same result.  Null texts have no lines and stay null.
    """
    prepare(docs.sparkSession)
    keyed = _keyed(docs)
    copies, _ = repeated_windows(keyed, min_words)
    copies = copies.select(F.col("doc_id").alias("c_id"), F.col("hash").alias("c_hash"), "windows").hint("merge")
    same = [F.col("doc_id").eqNullSafe(F.col("c_id")), F.col("hash") == F.col("c_hash")]
    joined = keyed.drop("text").join(copies, same, "left").select("row", F.col("row.text").cast("string").alias("text"), "windows")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("windows").isNotNull(), _without(lines, F.col("windows")))
    out = joined.select("row", "text", F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0).cast("bigint").alias("n_lines"), kept.alias("kept"))
    changed = F.col("kept").isNotNull()
    n_removed = F.when(changed, F.col("kept.n_removed")).otherwise(0).cast("bigint")
    return out.select("row", "n_lines", n_removed.alias("n_removed"), F.when(changed, F.col("kept.text")).otherwise(F.col("text")).alias("text"))


def keep_first_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without later copies of line runs, with the columns that came in.

    ``n_chars``, where it is a column, follows the text.  A document of which no word is left goes.
    """
    found = dedup_lines(docs, min_words).where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    columns = []
    for c in docs.columns:
        col = F.col("row." + quoted(c))
        if c == "text":
            col = F.col("text")
        elif c == "n_chars":
            col = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(col)
        columns.append(col.alias(c))
    return found.select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines and of removed lines of every document, and size and digest of what is kept.

    Null texts have no lines and keep nothing, empty ones one empty line; rows that repeat doc_id and text have equal results; the
    first copy in the order of doc_id, text hash and line stays; an empty table gives an empty result.
    """
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
