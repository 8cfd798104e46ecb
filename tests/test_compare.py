"""Comparison of two tables, trees of recordings, bucketed tables."""

import math

from pyspark.sql import functions as F

from signalloom.operators import epoching, numbering, quality
from signalloom.plans import datasets as ds
from signalloom.plans.catalog import CATALOG
from signalloom.sources import recordings as rec


def test_classes_of_compared_values(spark):
    nan = math.nan
    left = [("a", 1.0), ("b", 1.0), ("c", None), ("d", nan), ("e", None), ("f", nan), ("g", 2.0), (None, 5.0), ("i", 0.0)]
    right = [("a", 1.0 + 1e-12), ("b", 1.1), ("c", None), ("d", nan), ("e", 1.0), ("f", 1.0), ("h", 2.0), (None, 5.0), ("i", 0.0)]
    schema = "k string, v double"
    got = quality.compare_tables(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "v")
    assert {r["k"]: r["class"] for r in got.collect()} == {
        "a": "equal", "b": "different", "c": "equal", "d": "equal", "e": "null", "f": "nan", "g": "only left",
        "h": "only right", None: "equal", "i": "equal",
    }


def test_compared_tables_are_dealt_to_the_tasks_asked_for(spark):
    rows = [("a", 1, 1.0), ("b", None, 1.0), (None, None, 2.0), ("c", 3, math.nan), ("c", 3, 1.0), ("d", 4, 0.0)]
    schema = "k string, n int, v double"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:-1] + [("e", 4, 0.0)], schema)
    plain = quality.compare_tables(left, right, ["k", "n"], "v")
    dealt = quality.compare_tables(left, right, ["k", "n"], "v", tasks=37)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect()))
    large = [spark.range(0, 5000, 1, 2).selectExpr("id AS k", "id % 3 AS n", "0D AS v").hint("merge") for _ in "ab"]
    plan = quality.compare_tables(*large, ["k", "n"], "v", tasks=37)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 == plan.count("37), REPARTITION_BY_NUM")


def test_tables_dealt_alike_are_compared_where_they_lie(spark):
    schema = "k string, b int, n int, v double"
    rows = [("a", 1, 1, 1.0), ("b", 2, None, 1.0), (None, 3, None, 2.0), ("c", 4, 3, math.nan), ("c", 4, 3, 1.0), ("d", 5, 4, 0.0)]
    rows += [(f"x{i}", i % 7, i, float(i)) for i in range(300)]
    other = [*rows[:-40], ("c", 4, 3, None), ("e", 5, 4, 0.0), ("e", 5, 4, 1.0), (None, None, 1, None), (None, 3, None, 2.5)]
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    plain = quality.compare_tables(left, right, ["k", "n"], "v")
    assert {r["class"] for r in plain.collect()} == {"equal", "different", "null", "nan", "only left", "only right"}
    for deal in (lambda df: df.repartition(9, "k", "b"), lambda df: df.repartition("k", "b"), lambda df: df):
        dealt = quality.compare_tables(deal(left), deal(right), ["k", "n"], "v", dealt=["k", "b"])
        assert dealt.columns == plain.columns
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect()))
    by_nine = [df.repartition(9, "k", "b") for df in (left, right)]
    plan = quality.compare_tables(*by_nine, ["k", "n"], "v", dealt=["k", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 == plan.count("9), REPARTITION_BY_NUM")


def test_compared_routes_move_samples_only(spark, tmp_path, monkeypatch):
    lines = spark.range(400).selectExpr(
        "id % 4 AS l_suppkey", "if(id % 8 < 4, 'A', 'N') AS l_returnflag", "'F' AS l_linestatus",
        "date_add(DATE'2020-01-01', cast(id div 8 AS int)) AS l_shipdate", "id AS l_orderkey", "1 AS l_linenumber",
        "id AS l_partkey", "900D + (id * 7919) % 1000 AS l_extendedprice",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(epoching.tasks_for, "__defaults__", (60,))
    counted, count = [], type(lines).count
    monkeypatch.setattr(type(lines), "count", lambda df: counted.append(df.columns) or count(df))
    compared = CATALOG["routes_compared"](spark, str(tmp_path))
    # Numbered samples are not counted: that would number them once more for each count.
    assert counted and not any("j" in columns for columns in counted)
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 == plan.count("7), REPARTITION_BY_NUM")
    # Of the features, only the counts of each class move.
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("EpochID" in line or "_key" in line for line in moves)
    assert sum("FeatureName" in line for line in moves) == 1 == sum("class#" in line for line in moves)
    # Six epochs in each of eight channels.
    assert [tuple(r) for r in compared.select("class", "n_rows").collect()] == [("equal", 48)] * 17


def test_lines_are_counted_as_samples(spark, tmp_path):
    lines = spark.range(90).select(
        *[F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias(c) for c in ds.LINE_KEYS],
        *[F.when(F.col("id") % 7 != 0, F.col("id") % 4).alias(c) for c in ds.LINE_ORDER], F.lit(None).cast("double").alias("l_extendedprice"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert ds.line_sample_count(spark, str(tmp_path)) == 90 == ds.line_samples(spark, str(tmp_path)).count()


def test_tree_of_recordings(spark, tmp_path):
    rows = [("A", j, float(j)) for j in range(5)]
    for subject, folder in (("01", "sub-01/eeg"), ("02", "deep/er/sub-02/eeg")):
        path = f"{tmp_path}/{folder}/sub-{subject}_task"
        spark.createDataFrame(rows, "Electrode string, j long, value double").coalesce(1).write.parquet(path)
    (tmp_path / "notes.txt").write_text("not a recording")
    found = rec.scan_tree(spark, str(tmp_path))
    assert {r["SubjectID"]: r["count"] for r in found.groupBy("SubjectID").count().collect()} == {"sub-01": 5, "sub-02": 5}
    asked = spark.createDataFrame([("sub-01",), ("sub-03",), ("sub-03",)], "SubjectID string")
    assert [tuple(r) for r in rec.missing_recordings(found, asked).collect()] == [("sub-03", "no file")]


def test_tree_of_many_recordings_has_few_folders(spark, tmp_path):
    rows = [(f"sub-{i}", f"E{e}", 0, float(i)) for i in range(300) for e in range(2)]
    rows += [("sub-long", "E0", j, 1.0) for j in range(900)] + [("sub-a_b/c", "E0", j, 1.0) for j in range(900)]
    df = spark.createDataFrame(rows, "SubjectID string, Electrode string, j long, value double")
    rec.write_tree(df, f"{tmp_path}/tree", folders=4)
    folders = sorted(p.name for p in (tmp_path / "tree").glob("folder=*"))
    assert len(folders) == 5 and folders[-1] == "folder=sub-long"
    assert len(list((tmp_path / "tree").rglob("*.parquet"))) <= 4 * 2 + 1
    found = rec.scan_tree(spark, f"{tmp_path}/tree")
    assert found.exceptAll(df).isEmpty() and df.exceptAll(found).isEmpty()


def test_shared_folders_of_subjects(spark, tmp_path):
    df = spark.range(900).selectExpr("concat('sub-', id % 300) AS SubjectID", "id AS x")
    path = f"{tmp_path}/shared"
    rec.write_by_subject(df, path, folders=8)
    assert len(list((tmp_path / "shared").rglob("*.parquet"))) == 8
    back = rec.read_by_subject(spark, path, folders=8)
    assert back.columns == ["x", "SubjectID"] or back.columns == ["SubjectID", "x"]
    assert sorted(map(tuple, back.select("SubjectID", "x").collect())) == sorted(map(tuple, df.collect()))
    some = rec.read_by_subject(spark, path, ["sub-1", "sub-33", "sub-none"], folders=8)
    assert sorted(r.x for r in some.collect()) == [1, 33, 301, 333, 601, 633]
    assert "SubjectFolder" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]


def test_bucketed_tables_are_grouped_without_exchange(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('sub-', id % 50) AS SubjectID", "id % 7 AS EpochBlock", "id AS value")
    back = rec.write_bucketed(df, "bucketed_test", f"{tmp_path}/bucketed", 16)
    grouped = back.groupBy("SubjectID", "EpochBlock").agg({"value": "sum"})
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and grouped.count() == 350
    assert len(list((tmp_path / "bucketed").glob("*.parquet"))) <= 16
    one = back.where("SubjectID = 'sub-3' AND EpochBlock = 3")
    assert "EqualTo(SubjectID,sub-3)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == df.where("SubjectID = 'sub-3' AND EpochBlock = 3").count() > 0
    spark.sql("DROP TABLE bucketed_test")


def test_numbered_rows_are_dealt_to_the_tasks_asked_for(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, NULL, id % 5) AS k", "(id * 7919) % 4001 AS v")
    plain = numbering.number_rows(df, ["k"], ["v"], "n", splits=16)
    dealt = numbering.number_rows(df, ["k"], ["v"], "n", splits=16, tasks=23)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, dealt.collect()))
    assert "23), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
