"""Numbering, rejection, packing, scaling, components, sources and user functions."""

import json
import math
import re

import numpy as np
import pandas as pd
import pytest
import signals as sg
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Row
from pyspark.sql import functions as F

from signalloom.functions import spectral
from signalloom.operators import annotations as ann
from signalloom.operators import epoching, numbering, pca, quality, scaling, udf
from signalloom.operators.channel_stats import any_length_stats
from signalloom.params import Band, JobParams, load_params, params_from_mapping
from signalloom.plans import datasets as ds
from signalloom.plans import features as ft
from signalloom.schemas import (
    ANNOTATION_SCHEMA,
    FEATURE_SCHEMA,
    RECORDING_SCHEMA,
    SAMPLE_SCHEMA,
    conform,
)
from signalloom.sources import participants, recordings
from signalloom.sources import recordings as rec
from signalloom.sources.scratch import scratch_path
from signalloom.streaming.arrivals import read_arriving_epochs, write_arriving_features

PARAMS = JobParams(sfreq=10.0, window_length=1.0, step_size=0.33, n_fft=8)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- numbering ---------------------------------------------------------------------


@pytest.mark.parametrize("splits", [1, 40, 100_000])
@pytest.mark.parametrize("days", [1, 40])
def test_numbering_is_the_same_however_keys_are_split(spark, splits, days):
    rng = np.random.default_rng(0)
    day = rng.integers(0, days, size=3000)
    keys = np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 50, size=3000).astype(str))
    rows = [(str(k), int(d), int(i)) for i, (k, d) in enumerate(zip(keys, day, strict=True))]
    rows += [(None, None, 5000), (None, 3, 5001), (None, None, 5002)]
    df = spark.createDataFrame(rows, "k string, day int, id int")
    out = numbering.number_rows(df, ["k"], ["day", "id"], "n", splits=splits)
    got = {(r.k, r.id): r.n for r in out.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        ordered = sorted((-1 if d is None else d, i) for kk, d, i in rows if kk == k)
        want |= {(k, i): n for n, (_, i) in enumerate(ordered)}
    assert got == want


def test_one_date_of_one_key_is_split(spark):
    df = spark.range(20_000).selectExpr("'k' AS k", "7 AS day", "id")
    points = numbering.split_points(df, ["k"], ["day", "id"], 50)
    sizes = numbering.with_bucket(df, ["k"], ["day", "id"], points, 50).groupBy("_bucket").count().collect()
    assert 25 < len(sizes) < 100 and max(r["count"] for r in sizes) < 4000
    out = numbering.number_rows(df, ["k"], ["day", "id"], "n", splits=50)
    assert out.where("n <> id").count() == 0


def test_rows_that_repeat_are_numbered_once_each(spark):
    df = spark.range(3000).selectExpr("'k' AS k", "1 AS day")
    out = [r.n for r in numbering.number_rows(df, ["k"], ["day"], "n").collect()]
    assert sorted(out) == list(range(3000))


def test_plans_are_built_without_a_job(spark):
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup()
    numbering.number_rows(spark.range(10).selectExpr("id % 2 AS k", "id"), ["k"], ["id"], "n")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == seen


def test_running_totals(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 99, 500), strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    amounts = {"total": ("sum", "v"), "mark": ("bit_xor", "xxhash64(i, v)")}
    for splits in (1, 60):
        out = numbering.running(df, ["k"], ["i"], amounts, splits=splits).orderBy("i").collect()
        marks = {r.i: r.m for r in df.selectExpr("i", "xxhash64(i, v) AS m").collect()}
        total, mark = [0] * 3, [0] * 3
        for r in out:
            total[r.k] += r.v
            mark[r.k] ^= marks[r.i]
            assert (r.total, r.mark) == (total[r.k], mark[r.k])


# --- epochs and annotations --------------------------------------------------------


def test_grid_matches_arange(spark):
    lengths = {"a": 200, "b": 11, "c": 10, "d": 12, "e": 1}
    table = spark.createDataFrame(list(lengths.items()), "SubjectID string, n_samples long")
    got = {}
    for r in epoching.epoch_grid(table, PARAMS).collect():
        got.setdefault(r.SubjectID, {})[r.i] = r.start
    for s, n in lengths.items():
        assert got.get(s, {}) == dict(enumerate(sg.starts(n, PARAMS))), s


@pytest.mark.parametrize("bucket", [3, 4096])
def test_rejection_matches_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(ann, "GRID_BUCKET", bucket)
    monkeypatch.setattr(epoching, "GRID_BUCKET", bucket)
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([("a", 900), ("b", 400), ("c", 50)], "SubjectID string, n_samples long")
    notes = [
        ("a" if rng.random() < 0.7 else "b", float(o), float(d), t)
        for o, d, t in zip(
            np.round(rng.uniform(-5, 95, 25), 1),
            rng.choice([0.0, 0.1, 1.0, 7.0], 25),
            rng.choice(["boundary", "Bad x", "ok", "xboundaryx", "not bad"], 25),
            strict=True,
        )
    ]
    # Touching an epoch's edge is not an overlap.
    notes.append(("c", 1.0, 0.6, "BAD"))
    df = spark.createDataFrame(
        notes, "SubjectID string, onset double, duration double, description string"
    )
    kept = ft.kept_epochs(table, PARAMS, df).collect()
    want = []
    for s, n in (("a", 900), ("b", 400), ("c", 50)):
        number = 0
        for i, start in enumerate(sg.starts(n, PARAMS)):
            lo, hi = start / 10, (start + PARAMS.n_times - 1) / 10
            if not any(
                s == ns and ("boundary" in t or t.lower().startswith("bad"))
                and o < hi and o + d > lo
                for ns, o, d, t in notes
            ):
                want.append((s, i, start, f"ep-{number}"))
                number += 1
    assert sorted((r.SubjectID, r.i, r.start, r.EpochID) for r in kept) == sorted(want)
    assert 0 < len(want) < 400


def test_pack_trim_unpack(spark):
    epochs = sg.epochs_df(
        spark, {("s", "ep-0", "B"): [4, 5, 6], ("s", "ep-0", "A"): [1, 2], ("s", "ep-1", "A"): [7]}
    )
    packed = epoching.pack(epochs)
    first = packed.where("EpochID = 'ep-0'").first()
    assert first.ChannelNames == ["A", "B"] and first.EEG == [[1.0, 2.0], [4.0, 5.0, 6.0]]
    trimmed = epoching.trim_packed(packed)
    assert trimmed.where("EpochID = 'ep-0'").first().EEG == [[1.0, 2.0], [4.0, 5.0]]
    back = {(r.EpochID, r.Electrode): r.signal for r in epoching.unpack(packed).collect()}
    assert back[("ep-0", "B")] == [4.0, 5.0, 6.0] and len(back) == 3


def test_detrend_of_one_sample_and_null(spark):
    epochs = sg.epochs_df(spark, {("s", "e", "A"): [5.0], ("s", "f", "A"): [1.0, 3.0, 5.0]})
    got = {r.EpochID: r.signal for r in epoching.detrend(epochs).collect()}
    assert got["e"] == [0.0]
    assert got["f"] == pytest.approx([0, 0, 0])


def test_quality_and_rejected_subjects(spark):
    epochs = sg.epochs_df(spark, {("s", "e", "A"): [1.0, float("nan"), 3.0]})
    r = quality.signal_quality(epochs).first()
    assert (r.n_times, r.n_nan, r.n_missing, r.min_value) == (3, 1, 0, 1.0)
    table = spark.createDataFrame([("a", 200), ("b", 3)], "SubjectID string, n_samples long")
    lost = quality.rejected_subjects(table, ft.kept_epochs(table, PARAMS)).collect()
    assert [r.SubjectID for r in lost] == ["b"]
    with pytest.raises(ValueError):
        quality.require_rows(table.where("false"), "epochs")


# --- plans -------------------------------------------------------------------------


@pytest.mark.parametrize("step", [0.33, 0.9])
def test_samples_are_shuffled_once(spark, step):
    params = PARAMS.replace(step_size=step)
    samples = sg.samples_df(spark, {("s", "A"): range(50)})
    table = spark.createDataFrame([("s", 50)], "SubjectID string, n_samples long")
    plan = plan_of(ft.features_long(samples, table, params))
    assert plan.count("REPARTITION_BY_COL") == 1
    # The other exchange is that of the block grid, a few rows per recording.
    assert plan.count("Exchange hashpartitioning") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    notes = spark.createDataFrame(
        [("s", 1.0, 0.5, "BAD")],
        "SubjectID string, onset double, duration double, description string",
    )
    plan = plan_of(ft.features_long(samples, table, params, notes))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Features meet the kept epochs of their block where they are, and move nowhere else.
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moves and not any("start#" in line or "Electrode#" in line for line in moves)


def test_tasks_grow_with_the_samples(spark, monkeypatch):
    params = JobParams(sfreq=64.0, window_length=0.5, step_size=0.05, n_fft=32)
    samples = sg.samples_df(spark, {(f"s{i}", c): range(40 + i) for i in range(4) for c in "AB"})
    table = spark.createDataFrame([(f"s{i}", 40 + i) for i in range(4)], "SubjectID string, n_samples long")
    few = sorted(ft.features_long(samples, table, params).collect(), key=repr)
    monkeypatch.setattr(epoching, "TASK_SAMPLES", 20)
    monkeypatch.setattr(epoching.tasks_for, "__defaults__", (20,))
    for step in (0.05, 0.3):
        # 332 samples, in panes and in slices.
        plan = plan_of(ft.features_long(samples, table, params.replace(step_size=step)))
        assert plan.count("17), REPARTITION_BY_NUM") == 1
    many = sorted(ft.features_long(samples, table, params).collect(), key=repr)
    assert [r[:5] for r in many] == [r[:5] for r in few]
    long = epoching.epoch_samples(samples, table, params)
    tasks = epoching.long_tasks(samples, params)
    assert tasks == -(-math.ceil(332 * 33 / 3.2) // 160)
    dealt = epoching.detrend_long(long, tasks)
    assert f"{tasks}), REPARTITION_BY_NUM" in plan_of(dealt)
    assert sorted(dealt.collect()) == sorted(epoching.detrend_long(long).collect())


# --- scaling -----------------------------------------------------------------------

IDS = "SubjectID string, EpochID string, label int"


@pytest.fixture
def wide(spark):
    rng = np.random.default_rng(3)
    rows = [
        (f"s{i % 3}", f"ep-{i}", i % 2, float(rng.normal(5, 2)), 2.0, float(i)) for i in range(30)
    ]
    rows.append(("single", "ep-30", 0, 1.5, 2.0, 3.0))
    return spark.createDataFrame(rows, IDS + ", `a.x` double, const double, c double")


COLS = ["a.x", "const", "c"]


def test_min_max(spark, wide):
    train, test = scaling.min_max_normalize(wide.where("c < 20"), wide, COLS, -1.0, 1.0)
    got = train.toPandas()
    assert got["a.x"].min() == -1 and got["a.x"].max() == 1
    assert (got["const"] == -1).all()
    assert test.toPandas()["c"].max() > 1
    with pytest.raises(Exception, match="no training value"):
        scaling.min_max_normalize(wide.where("false"), wide, COLS)[1].collect()


def test_z_score_and_its_long_form(spark, wide):
    train, test = scaling.normalize_by_column(wide, wide, COLS)
    got = train.toPandas().set_index("EpochID").sort_index()
    assert got["c"].mean() == pytest.approx(0, abs=1e-6)
    assert got["c"].std() == pytest.approx(1, rel=1e-6)
    assert (got["const"] == 0).all()
    long = scaling.melt(wide, scaling.IDS, COLS)
    back = scaling.unmelt(
        scaling.normalize_melted(long, long), scaling.IDS, COLS, "norm_value"
    ).toPandas().set_index("EpochID").sort_index()
    for c in COLS:
        assert back[c].to_numpy() == pytest.approx(got[c].to_numpy(), abs=1e-9)


def test_per_subject_scalers(spark, wide):
    z = scaling.normalize_by_column_per_subject_wide(wide, COLS).toPandas()
    m = scaling.min_max_by_column_per_subject_wide(wide, COLS).toPandas()
    assert list(z.columns) == list(m.columns) == wide.columns
    several = z[z.SubjectID != "single"].groupby("SubjectID")["c"]
    assert several.mean().to_numpy() == pytest.approx(0, abs=1e-9)
    assert several.std().to_numpy() == pytest.approx(1)
    assert m["c"].min() == 0 and m["c"].max() == 1
    single = z[z.SubjectID == "single"].iloc[0], m[m.SubjectID == "single"].iloc[0]
    assert all(row[c] == 0 for row in single for c in COLS)


def test_rows_without_subject_get_null(spark):
    df = spark.createDataFrame([(None, "e", 1, 2.0), ("a", "f", 1, 3.0)], IDS + ", c double")
    got = {r.EpochID: r.c for r in scaling.normalize_by_column_per_subject_wide(df, ["c"]).collect()}
    assert got == {"e": None, "f": 0.0}


def test_power_keys_missing_from_training_vanish(spark):
    schema = IDS + ", Electrode string, WaveBand string, Power double"
    train = spark.createDataFrame([("a", "e", 0, "A", "x", 1.0), ("a", "f", 0, "A", "x", 3.0)], schema)
    test = spark.createDataFrame([("b", "e", 0, "A", "x", 2.0), ("b", "e", 0, "B", "x", 9.0)], schema)
    left, right = scaling.normalize_power(train, test)
    assert sorted(r.Power for r in left.collect()) == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert [r.Power for r in right.collect()] == [0.0]


# --- components --------------------------------------------------------------------


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ np.diag([10, 5, 0.1, 0.1])
    rows = [(f"s{i % 4}", f"ep-{i}", 1, *map(float, v)) for i, v in enumerate(x)]
    cols = ["w", "x", "y", "z"]
    df = spark.createDataFrame(rows, IDS + ", " + ", ".join(f"{c} double" for c in cols))
    fitted = pca.fit_pca_model(df, cols)
    assert fitted.k == 2 and sum(fitted.explained[:2]) >= 0.95
    scores = pca.apply_pca_model(df, fitted)
    assert scores.columns == ["SubjectID", "EpochID", "label", "features"]
    got = np.array([r.a for r in scores.select(vector_to_array("features").alias("a")).collect()])
    vectors = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.abs(got) == pytest.approx(np.abs(x @ vectors), abs=1e-8)
    scaled = pca.min_max_normalize_post_pca_by_subject(scores, fitted.k)
    assert scaled.columns == scores.columns
    pdf = scaled.select("SubjectID", vector_to_array("features").alias("a")).toPandas()
    for _, part in pdf.groupby("SubjectID"):
        a = np.stack(part.a)
        assert a.min(axis=0) == pytest.approx([0, 0]) and a.max(axis=0) == pytest.approx([1, 1])
    with pytest.raises(ValueError):
        pca.components_needed([0.5, 0.2], 0.95)


def test_constant_component_scales_to_zero(spark):
    df = spark.createDataFrame([("a", [2.0, 1.0]), ("a", [2.0, 5.0])], "SubjectID string, v array<double>")
    df = df.select("SubjectID", array_to_vector("v").alias("features"))
    out = pca.min_max_normalize_post_pca_by_subject(df, 2)
    got = out.select(vector_to_array("features").alias("a")).collect()
    assert sorted(r.a for r in got) == [[0.0, 0.0], [0.0, 1.0]]


def test_pivot_discovers_keys_and_fills_cells(spark):
    df = spark.createDataFrame(
        [("a", "e", None, "F3", "Alpha", 1.0), ("a", "f", 2, "F3", None, 4.0)],
        IDS + ", Electrode string, WaveBand string, Power double",
    )
    wide, cols = pca.prepare_features_for_pca(df)
    assert cols == ["F3", "F3_Alpha"]
    got = {r.EpochID: (r.label, r["F3"], r["F3_Alpha"]) for r in wide.collect()}
    assert got == {"e": (None, 0.0, 1.0), "f": (2, 4.0, 0.0)}
    with pytest.raises(ValueError):
        pca.distinct_keys(df, "EpochID", limit=1)


# --- sources, sinks and hooks ------------------------------------------------------


def test_participants_by_column_name(spark, tmp_path):
    path = tmp_path / "participants.tsv"
    path.write_text(
        "participant_id\tGender\tGroup\nsub-001\tF\tA\nsub-002\tM\tB\nsub-003\tF\tC\nsub-003\tF\tC\n"
        "sub-004\tM\t\n"
    )
    got = participants.read_subjects(spark, JobParams(), str(path)).collect()
    assert sorted(map(tuple, got)) == [("sub-001", "A"), ("sub-003", "C"), ("sub-003", "C")]
    assert participants.participants_path(JobParams(data_path="/d")) == "/d/ds004504/participants.tsv"


def test_recording_paths(spark):
    p = JobParams(data_path="/d")
    want = "/d/ds004504/derivatives/sub-01/eeg/sub-01_task-eyesclosed_eeg.set"
    assert recordings.recording_path(p, "sub-01") == recordings.recording_path(p, "01") == want
    assert "derivatives" not in recordings.recording_path(p.replace(derivatives=False), "01")
    row = spark.range(1).select(recordings.subject_from_path(F.lit(want)).alias("s")).first()
    assert row.s == "01"


def test_subject_directories_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(f"sub-{i}", i) for i in range(5)], "SubjectID string, x int")
    path = str(tmp_path / "out")
    recordings.write_by_subject(df, path)
    back = recordings.read_by_subject(spark, path, ["sub-1", "sub-3"])
    assert sorted((r.SubjectID, r.x) for r in back.collect()) == [("sub-1", 1), ("sub-3", 3)]
    assert "SubjectID" in plan_of(back).split("PartitionFilters: ")[1].split("]")[0]


def test_parameter_files(tmp_path):
    raw = {"windowLength": 3, "stepSize": 0.3, "method": "welch", "freqBands": {"Low": [1, 5]}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(raw))
    p = load_params(str(path))
    assert (p.window_length, p.step_size, p.bands[0].name, p.fmax) == (3, 0.3, "Low", 5.0)
    with pytest.raises(FileNotFoundError):
        load_params(str(tmp_path / "none.json"))


def test_user_functions(spark):
    epochs = sg.epochs_df(spark, {("s", "e", "A"): [1.0, 3.0], ("s", "e", "B"): [5.0, 7.0]})

    def mean_of_epoch(pdf):
        return pd.DataFrame({"EpochID": [pdf.EpochID.iloc[0]], "m": [np.mean(list(pdf.signal))]})

    assert udf.apply_epoch_features(epochs, mean_of_epoch, "EpochID string, m double").collect() == [
        Row(EpochID="e", m=4.0)
    ]
    nothing = udf.apply_epoch_features(epochs, lambda pdf: pd.DataFrame(), "EpochID string")
    assert nothing.count() == 0
    packed = udf.map_packed_epochs(
        epoching.pack(epochs),
        lambda pdf: pd.DataFrame({"n": [len(e) for e in pdf.EEG]}),
        "n long",
    )
    assert [r.n for r in packed.collect()] == [2]


def test_arriving_epochs(spark, tmp_path):
    params = JobParams(sfreq=64.0, window_length=63 / 64, n_fft=64, detrend=False)
    rng = np.random.default_rng(5)
    epochs = sg.epochs_df(spark, {("s", f"ep-{i}", "A"): rng.normal(size=64) for i in range(3)})
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    epochs.write.parquet(source)
    for _ in range(2):
        write_arriving_features(read_arriving_epochs(spark, source), params, out, state).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    want = ft.epochs_features_long(epochs, params)
    assert got.count() == 3 * 17
    key = ["EpochID", "WaveBand", "FeatureName"]
    a = got.orderBy(*key).toPandas().FeatureValue.to_numpy()
    b = want.orderBy(*key).toPandas().FeatureValue.to_numpy()
    assert a == pytest.approx(b)


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = (scratch_path(spark, "epochs") for _ in range(2))
    assert first.startswith(f"{shared}/epochs-") and first != second


def test_one_recording_spreads_over_blocks(spark):
    """A recording that outweighs all others is many groups, none above the block size."""
    params = PARAMS.replace(block_samples=100)
    samples = sg.samples_df(spark, {("big", "A"): range(5000), ("small", "A"): range(40)})
    groups = epoching.assign_blocks(samples, params).groupBy("SubjectID", "EpochBlock").count()
    sizes = {(r.SubjectID, r.EpochBlock): r["count"] for r in groups.collect()}
    assert max(sizes.values()) <= params.block_samples
    assert sum(s == "big" for s, _ in sizes) > 50
    assert sum(sizes.values()) < 1.2 * 5040


def test_whole_job_from_written_tables(spark, tmp_path):
    """The readers' tables, and everything a job yields."""
    params = JobParams(sfreq=10.0, window_length=1.0, step_size=0.5, n_fft=8, bands=(Band("all", 0.5, 5.0),))
    rows = [("s1", "A", j, float(j % 7)) for j in range(60) if j not in (30, 31)] + [("s2", "A", j, 1.0) for j in range(5)]
    spark.createDataFrame(rows, SAMPLE_SCHEMA).write.parquet(f"{tmp_path}/samples")
    samples = rec.read_samples(spark, f"{tmp_path}/samples")
    assert samples.columns == SAMPLE_SCHEMA.names
    described = rec.describe_recordings(samples, params)
    conform(described, RECORDING_SCHEMA).write.parquet(f"{tmp_path}/recordings")
    recordings = rec.read_recordings(spark, f"{tmp_path}/recordings")
    spark.createDataFrame([("s1", 0.0, 0.2, "bad start")], ANNOTATION_SCHEMA).write.parquet(f"{tmp_path}/notes")
    notes = rec.read_annotations(spark, f"{tmp_path}/notes")
    job = ft.feature_job(samples, recordings, params, notes)
    assert job.features.schema.names == FEATURE_SCHEMA.names
    got = {r.EpochID for r in job.features.select("EpochID").distinct().collect()}
    left = {(r.SubjectID, r.EpochID): r.reason for r in job.rejected_epochs.collect()}
    meta = job.metadata.where("SubjectID = 's1'").first()
    assert got and set(left.values()) == {"incomplete"}
    assert len(got) + len(left) == meta.NumEpochs
    assert [r.SubjectID for r in job.rejected_subjects.collect()] == ["s2"]
    with pytest.raises(ValueError):
        ft.feature_job(samples, recordings.where("SubjectID = 's2'"), params)
    with pytest.raises(ValueError):
        conform(samples.drop("j"), SAMPLE_SCHEMA)


@pytest.mark.parametrize("step", [0.5, 0.1])
def test_a_job_shuffles_its_samples_once(spark, step):
    params = JobParams(sfreq=10.0, window_length=1.0, step_size=step, n_fft=8, bands=(Band("all", 0.5, 5.0),))
    rng = np.random.default_rng(2)
    signals = {("s1", "A"): rng.normal(size=90), ("s1", "B"): {j: v for j, v in enumerate(rng.normal(size=90)) if not 30 <= j < 60}}
    samples = sg.samples_df(spark, signals | {("s1", "C"): [None if j == 40 else float(j % 7) for j in range(90)]})
    described = rec.describe_recordings(samples, params)
    outcomes = ft.job_outcomes(samples, described, params)
    exchanged = [line for line in plan_of(outcomes).splitlines() if re.search(r"EpochBlock.*REPARTITION_BY_COL", line)]
    assert len(exchanged) == 1
    job = ft.feature_job(samples, described, params)
    left = {(r.EpochID, r.Electrode): r.reason for r in job.rejected_epochs.collect()}
    whole = {(r.EpochID, r.Electrode) for r in job.features.select("EpochID", "Electrode").distinct().collect()}
    kept = job.metadata.first().NumEpochs
    assert len(left) + len(whole) == 3 * kept and not whole & set(left)
    want = {"incomplete", "missing sample"} if step == 0.5 else {"incomplete"}
    assert {r for r in left.values()} == want
    assert job.counts == {"features": len(whole) * 8, "metadata": 1, "rejected_epochs": len(left), "rejected_subjects": 0}
    plain = ft.features_long(samples, described, params)
    assert sorted(map(str, plain.collect())) == sorted(map(str, job.features.collect()))


def test_uneven_epochs_and_reasons(spark):
    params = JobParams(sfreq=64.0, window_length=63 / 64, n_fft=64, detrend=False)
    wave = lambda n: [float(k % 5) for k in range(n)]
    rows = [
        ("s", "whole", "A", wave(64)), ("s", "cut", "A", wave(100)), ("s", "cut", "B", wave(70)),
        ("s", "short", "A", wave(20)), ("s", "tiny", "A", wave(1)), ("s", "none", "A", []),
        ("s", "null", "A", None), ("s", "part", "A", wave(64)), ("s", "part", "B", []),
        ("s", "hole", "A", [1.0, None, *wave(62)]),
    ]
    epochs = spark.createDataFrame(rows, "SubjectID string, EpochID string, Electrode string, signal array<double>")
    got = {(r.EpochID, r.Electrode) for r in ft.epochs_features_long(epochs, params).collect()}
    left = {(r.EpochID, r.Electrode): r.reason for r in quality.rejected_signals(epochs, params).collect()}
    assert left == {
        ("tiny", "A"): "too short", ("none", "A"): "no sample", ("null", "A"): "no sample",
        ("part", "B"): "no sample", ("hole", "A"): "missing sample",
    }
    assert got | set(left) == {(r[1], r[2]) for r in rows} and not got & set(left)
    one = ft.epochs_features_long(epochs.where("EpochID = 'cut' AND Electrode = 'B'"), params)
    both = ft.epochs_features_long(epochs.where("EpochID = 'cut'"), params).where("Electrode = 'B'")
    assert sorted(map(str, one.collect())) == sorted(map(str, both.collect()))


@pytest.mark.parametrize("change", [{}, {"n_overlap": 3}, {"n_fft": 48, "n_overlap": 11}, {"n_fft": 7}])
def test_spectra_of_all_lengths_match_numpy(spark, change):
    params = JobParams(sfreq=64.0, window_length=63 / 64, detrend=False).replace(**change)
    rng = np.random.default_rng(5)
    signals = {("s", f"ep-{n}", "A"): rng.normal(size=n) for n in [1, 2, 3, 4, *range(5, 300, 7)]}
    epochs = sg.epochs_df(spark, signals)
    stats = any_length_stats(epochs, spectral.AnyLength.of(params))
    got = {r.EpochID: r for r in stats.collect()}
    seen = 0
    for (_, epoch, _), x in signals.items():
        n = min(params.n_fft or 256, len(x))
        if not spectral.has_bins(params, len(x)):
            assert epoch not in got
            continue
        freqs, psd = sg.welch(x, 64.0, n, n - params.n_overlap, params.fmin, params.fmax)
        row = got[epoch]
        assert [k * 64.0 / row.segment for k in row.ks] == list(freqs)
        assert row.psd == pytest.approx(psd, rel=1e-9, abs=1e-12) and row.n == len(x)
        assert row.Std == pytest.approx(x.std())
        seen += 1
    assert seen > 30


def test_a_table_too_large_to_broadcast_is_cut_to_the_lengths_that_occur(spark, monkeypatch):
    params = JobParams(sfreq=64.0, window_length=63 / 64, detrend=False)
    rng = np.random.default_rng(6)
    epochs = sg.epochs_df(spark, {("s", f"ep-{n}", "A"): rng.normal(size=n) for n in (30, 40, 300)})
    want = {r.EpochID: r.psd for r in any_length_stats(epochs, spectral.AnyLength.of(params)).collect()}
    monkeypatch.setattr(spectral, "MAX_WAVE_TABLE_BYTES", 10)
    got = {r.EpochID: r.psd for r in any_length_stats(epochs, spectral.AnyLength.of(params)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_epochs_of_many_lengths_are_one_plan(spark):
    epochs = ds.uneven_epochs(spark, "/root/testdata/sf0.001")
    plan = ft.epochs_features_long(epochs, ds.UNEVEN_PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and len(re.findall(r"\bExchange ", plan)) == 1


def test_duplicates_and_unknown_parameters(spark):
    subjects = spark.createDataFrame([("a",), ("b",), ("a",)], "SubjectID string")
    assert [tuple(r) for r in quality.duplicate_subjects(subjects).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        params_from_mapping({"sfreq": 100.0, "window": 2})
    assert params_from_mapping({"nFft": 64, "nOverlap": 8}).n_overlap == 8


def test_statistics_by_key_shuffle_no_row(spark):
    """Without size estimates to broadcast by, the long table still stays where it is."""
    long = spark.range(100).selectExpr(
        "cast(id AS string) AS SubjectID", "'e' AS EpochID", "1 AS label", "cast(id % 3 AS string) AS Electrode",
        "'b' AS WaveBand", "cast(id AS double) AS Power",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        train, test = scaling.normalize_power(long, long)
        plan = test._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    outside = plan.split("Subqueries")[0].split("Subquery ")[0]
    assert "Join" not in plan and "hashpartitioning(Electrode" not in outside.split("Range (0, 100")[-1]
