import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hayrake.operators import features, geography, relational
from hayrake.sources import tables


def test_footers_against_pyarrow(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).withColumn("s", F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), "id"))).repartition(3).write.parquet(path)
    pq.write_table(pa.table({"id": pa.array(range(10), pa.int64()), "s": ["y"] * 10}), f"{path}/more.parquet", row_group_size=4)
    got = tables.footers(spark, path)
    want = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                x = meta.row_group(g).column(c)
                want.append((f, g, meta.row_group(g).num_rows, x.path_in_schema, x.total_compressed_size, x.total_uncompressed_size, x.num_values, x.statistics.null_count, x.compression))
    rows = [(r.file.removeprefix("file:"), *r[1:]) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    one = tables.footer_profile(got).first()
    assert (one.n_rows, one.n_files, one.n_groups) == (5010, 4, 6)
    assert one.compressed == sum(w[4] for w in want) and one.uncompressed == sum(w[5] for w in want)
    top = tables.column_profile(got, 1).collect()
    assert [(r.column, r.n_values, r.n_nulls) for r in top] == [(max(("id", "s"), key=lambda c: sum(w[5] for w in want if w[3] == c)), 5010, sum(w[7] for w in want if w[3] == top[0].column))]


def test_footers_where_only_spark_reads(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(50).coalesce(1).write.parquet(path)
    direct = tables.footers(spark, path).drop("file").collect()
    monkeypatch.setattr(tables, "DIRECT", ())
    assert tables.footers(spark, path).drop("file").collect() == direct


def test_numbers_without_gaps(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, "x", i) for i in range(1000)] + [(None, "y", -1)], "a int, `b.c` string, _part int").repartition(6)
    got = relational.numbered(rows, [F.asc_nulls_last("a"), "_part"], start=1)
    assert got.columns == ["a", "b.c", "_part", "row_id"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    found = sorted(got.collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in found] == list(range(1, 1002))
    assert [r.a for r in found] == [*range(1000), None]
    # the only window without a key is over the sizes of the ranges
    assert plan.count("SinglePartition") <= 1 and "HashAggregate" in plan
    assert relational.numbered(rows.limit(0), ["a"]).count() == 0


def test_context_centres_fall_back(spark):
    places = spark.createDataFrame([(0,), (1,), (2,), (3,)], "location int")
    located = spark.createDataFrame([(0, 10.0, 10.0), (0, 12.0, 10.0), (5, 50.0, 20.0), (6, 52.0, 30.0)], "location int, lat double, lon double")
    moves = spark.createDataFrame([(0, 0, 3), (0, 5, 1), (1, 5, 1), (1, 6, 3), (2, 9, 4)], "search_location int, item_location int, n long")
    got = {r.search_location: r for r in geography.context_block(places, located, moves).collect()}
    assert [got[k].context_source for k in range(4)] == [0, 1, 2, 2]
    assert (got[0].context_lat, got[1].context_lat, got[1].context_lon, got[2].context_lat) == (11.0, 52.0, 30.0, None)
    assert got[0].context_spread_p50 == 0 and got[0].context_spread_p90 > 4000 and got[0].context_same_share == 0.75
    assert got[2].context_spread_p50 is None and got[2].context_peak_share == 1.0 and got[2].context_available == 0.0
    assert got[3].context_support == 0 and got[3].context_peak_share is None
    assert got[1].context_confidence == pytest.approx(4 / 24)


def test_weighted_quantiles(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 2.0, 1), ("a", 9.0, 7), ("a", None, 50)], "k string, v double, n long")
    r = geography.weighted_quantiles(rows, "k", "v", "n", low=0.1, mid=0.3, high=0.9).first()
    assert (r.low, r.mid, r.high) == (1.0, 2.0, 9.0)


def test_attributes(spark):
    texts = spark.createDataFrame([(1, "Вид услуги:  Ремонт   крыши; Тип: A; тип: b"), (2, "nothing; : x; y:"), (3, None), (4, "url: http://x:1; вид услуги: ремонт крыши")], "k int, t string")
    got = sorted(tuple(r) for r in features.attributes(texts, "k", "t").collect())
    assert got == [(1, "вид услуги", "ремонт крыши"), (1, "тип", "a"), (1, "тип", "b"), (4, "url", "http://x:1"), (4, "вид услуги", "ремонт крыши")]
    had = features.attributes(texts, "k", "t").withColumnRenamed("k", "i")
    pairs = spark.createDataFrame([(q, i) for q in range(1, 5) for i in range(1, 5)], "k int, i int")
    match = {(r.k, r.i): r.m for r in features.attribute_match(pairs, "k", "i", features.attributes(texts, "k", "t"), had, "вид услуги", "m").collect()}
    assert {k for k, v in match.items() if v == 1} == {(1, 1), (1, 4), (4, 1), (4, 4)} and match[1, 2] is None and len(match) == 16
    kinds = {(r.k, r.i): r.m for r in features.attribute_match(pairs, "k", "i", features.attributes(texts, "k", "t").where("value <> 'b'"), had.where("value <> 'a'"), "тип", "m").collect()}
    assert kinds[1, 1] == 0.0


def test_class_candidates_and_service_geography(spark):
    p = spark.createDataFrame([("t", "a", 0.6), ("t", "b", 0.3), ("t", "c", 0.1), ("u", "a", 1.0)], "q string, c string, p double")
    got = {(r.q, r.c): r for r in features.class_candidate_block(p, "q", "c", spark.createDataFrame([("a",), ("b",)], "c string")).collect()}
    assert got["t", "c"].probability is None and got["t", "c"].supported == 0.0
    assert (got["t", "b"].peak, round(got["t", "b"].margin, 9), got["u", "a"].margin) == (0.6, 0.3, 1.0)
    moves = spark.createDataFrame([("a", 1, 1)] * 3 + [("a", 1, 2)] + [("b", 1, 2)] * 4, "cls string, src int, dst int")
    rates, per = geography.service_geography(moves, "cls", "src", "dst", 2.0, 4)
    got = {(r.cls, r.dst): r.transition for r in rates.collect()}
    assert got["b", 1] == pytest.approx((0 + 2 * 3 / 8) / 6) and got["a", 1] == pytest.approx((3 + 2 * 3 / 8) / 6)
    assert sum(v for (c, _), v in got.items() if c == "a") == pytest.approx(1)
    assert {r.cls: (r.same, r.supported) for r in per.collect()} == {"a": (pytest.approx((3 + 2 * 3 / 8) / 6), 1.0), "b": (pytest.approx(2 * 3 / 8 / 6), 1.0)}


def test_indexes_follow_their_sources_and_can_be_forgotten(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path in (a, b):
        spark.range(3).write.parquet(path)
    made = []
    ask = lambda: tables.indexed(spark, [a, b], "n", lambda: made.append(1) or spark.range(len(made)))
    assert [ask().count() for _ in range(3)] == [1, 1, 1]
    spark.range(9).write.mode("append").parquet(b)
    assert ask().count() == 2 and len(made) == 2
    folders = {f.rpartition("/")[0].removeprefix("file:") for f in ask().inputFiles()}
    assert tables.forget(spark) >= 2 and tables.forget(spark) == 0
    assert not any((tmp_path / f).exists() for f in folders)
    assert ask().count() == 3


def test_footer_profile_counts_files(spark):
    from hayrake.plans import catalog

    row = catalog.queries()["footer_profile"](spark, "/root/testdata/sf0.001").first()
    assert row.n_files == 1 and row.n_rows == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
