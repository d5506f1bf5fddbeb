import os
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomset.session import scratch_path
from fathomset.streaming import scoring as T
from fathomset.streaming import submissions as U

START = datetime(2024, 1, 1)


def row(sub, sample, minute, vector=None, end=False, declared=None):
    return (sub, sample, START + timedelta(minutes=minute), end, declared, vector)


def streamed(spark, files, schema):
    """A file stream that takes one file per trigger, in order."""
    path = scratch_path(spark, "arriving")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def model(spark):
    coef = spark.createDataFrame([("a", "f0", 1.0), ("a", "f1", -0.5), ("b", "f0", -1.0), ("b", "f1", 0.25)], "candidate string, feature_id string, w double")
    return coef, spark.createDataFrame([("a", 0.1), ("b", 0.0)], "candidate string, b double")


def run(spark, model, files, name, gap="30 minutes"):
    feature = lambda i: F.concat(F.lit("f"), i.cast("string"))
    scores, late = U.score_submissions(streamed(spark, files, U.ARRIVING), *model, feature, gap, name)
    got = {}
    for r in scores.where("candidate = 'a'").collect():
        assert (r.submission_id, r.sample_id) not in got
        got[r.submission_id, r.sample_id] = r.p
    return got, sorted(r.sample_id for r in late.collect() if r.sample_id)


def expected(rows):
    x = np.array(rows)
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    gap = 2 * z[:, 0] - 0.75 * z[:, 1] + 0.1
    return 1 / (1 + np.exp(-gap))


def test_a_split_submission_scores_like_a_whole_one(spark, model):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 2)).tolist()
    rows = [row("s", f"v{i}", i, v) for i, v in enumerate(x)]
    end = row("s", None, 9, end=True, declared=9)
    whole, _ = run(spark, model, [[*rows, end]], "whole")
    # rows repeat, and the marker comes before the last of them
    split, late = run(spark, model, [rows[:4], [rows[2], end, *rows[4:7]], [], [rows[7], rows[8], rows[0]]], "split")
    assert len(whole) == 9 and whole == split and late == []
    assert np.allclose([whole["s", f"v{i}"] for i in range(9)], expected(x), atol=1e-9)


def test_closing_by_time_late_rows_and_a_second_set(spark, model):
    a = [row("a", "a0", 0, [1.0, 2.0]), row("a", "a1", 1, [3.0, 1.0]), row("a", "a2", 2, [2.0, 7.0])]
    b = [row("b", "b0", 40, [0.0, 1.0]), row("b", "b1", 41, [1.0, 0.0])]
    files = [a[:2], [a[2]],                      # still open: the watermark is 30 minutes behind
             b,                                  # 41 - 30 minutes is past all of a
             [row("a", "a9", 3, [9.0, 9.0])],    # older than the watermark
             [row("b", None, 42, end=True)],     # no number declared: closed at once
             [row("b", "b9", 43, [5.0, 5.0])],   # its submission was closed by the marker
             [row("a", "a0", 200, [4.0, 4.0]), row("a", "a5", 201, [5.0, 4.0]), row("a", None, 201, end=True, declared=2)]]
    box, late = run(spark, model, files[:-1], "time")
    assert sorted(box) == [("a", "a0"), ("a", "a1"), ("a", "a2"), ("b", "b0"), ("b", "b1")] and late == ["a9", "b9"]
    assert np.allclose([box["a", f"a{i}"] for i in range(3)], expected([[1, 2], [3, 1], [2, 7]]), atol=1e-9)
    # long after, the same name is a new set
    again, _ = run(spark, model, [[*a, row("a", None, 3, end=True)], [row("z", "z0", 100, [1.0, 1.0])], files[-1][1:2], [files[-1][2], row("a", "a6", 200, [4.0, 4.0])]], "again")
    assert sorted(again) == [("a", "a0"), ("a", "a1"), ("a", "a2"), ("a", "a5"), ("a", "a6"), ("z", "z0")]


def test_open_submissions_wait(spark, model):
    got, late = run(spark, model, [[row("a", "a0", 0, [1.0, 2.0]), row(None, "n0", 1, [1.0, 1.0])], [row(None, None, 2, end=True)]], "open")
    assert list(got) == [("", "n0")] and late == []


def test_monitor_drops_closed_windows(spark):
    schema = "ts timestamp, class string, covered double, flagged double"
    files = [[(START + timedelta(days=d, hours=h), "c", float(h % 2), 0.0) for h in range(0, 24, 3)] for d in range(6)]
    files.append([(START, "c", 1.0, 1.0)])  # five days late
    progress = []
    got = T.by_batch(T.coverage_windows(streamed(spark, files, schema), "1 day", "2 hours"), "windows", progress).orderBy("window_start").collect()
    assert [(r.n, r.coverage, r.flag_rate) for r in got] == [(8, 0.5, 0.0)] * 5 and got[0].window_start == START
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) <= 2 and held[-1] == 1
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1


def test_labels_meet_once_and_a_hot_user_spreads(spark):
    p = [[(1, START + timedelta(hours=h), float(h)) for h in range(0, 48, 2)]]
    labels = [[(1, START + timedelta(hours=h, minutes=30), float(h)) for h in range(0, 48, 3)]]
    left = streamed(spark, p, "user_id long, ts timestamp, value double")
    right = streamed(spark, labels, "label_user_id long, label_ts timestamp, label_value double")
    joined = T.join_late_labels(left, right, ["user_id"], "6 HOURS", "1 hour")
    got = sorted((r.value, r.label_value) for r in T.run_to_files(joined, "late").collect())
    assert got == sorted((float(a), float(b)) for a in range(0, 48, 2) for b in range(0, 48, 3) if a <= b + 0.5 <= a + 6)
    assert "_bucket" in joined._jdf.queryExecution().analyzed().toString().split("Join Inner")[1].split("\n")[0]


def test_a_table_in_part_files_is_streamed_whole(spark):
    folder = scratch_path(spark, "given")
    spark.range(10).repartition(3).write.parquet(f"{folder}/parts.parquet")
    part = next(f for f in os.listdir(f"{folder}/parts.parquet") if f.endswith(".parquet"))
    n_one = spark.read.parquet(f"{folder}/parts.parquet/{part}").count()
    shutil.copy(f"{folder}/parts.parquet/{part}", f"{folder}/one.parquet")
    assert T.run_to_files(T.parquet_stream(spark, folder, "parts"), "parts").count() == 10
    assert T.run_to_files(T.parquet_stream(spark, folder, "one"), "one").count() == n_one


def test_files_arrive_in_the_order_of_time(spark, model):
    rows = [row("s", f"v{i}", 60 * i, [float(i), float(i * i % 7)]) for i in range(12)] + [row("s", None, 660, end=True, declared=12)]
    folder = U.arrive_in_order(spark.createDataFrame(rows, U.ARRIVING), "ts", 3)
    stream = spark.readStream.schema(U.ARRIVING).option("maxFilesPerTrigger", 1).parquet(folder)
    scores, late = U.score_submissions(stream, *model, lambda i: F.concat(F.lit("f"), i.cast("string")), "1 hour", "ordered")
    assert scores.where("candidate = 'a'").count() == 12 and late.count() == 0
    parts = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.stat(f"{folder}/{f}").st_mtime_ns)
    seen = [spark.read.parquet(f"{folder}/{f}").agg(F.min("ts"), F.max("ts")).first() for f in parts]
    assert len(seen) == 3 and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_monitor_holds_open_windows(spark):
    schema = "ts timestamp, class string, covered double, flagged double"
    files = [[(START + timedelta(days=d, hours=h), "c", float(h % 2), 0.0) for h in range(0, 24, 3)] for d in range(3)]
    files.append([(START + timedelta(days=2, hours=23), "c", 1.0, 1.0), (START, "c", 1.0, 1.0)])  # the last window grows; two days late
    w = T.coverage_windows(streamed(spark, files, schema), "1 day", "2 hours")
    got = T.latest_by_batch(w, ["window_start", "class"], "open-windows").orderBy("window_start").collect()
    assert [(r.n, r.coverage) for r in got] == [(8, 0.5), (8, 0.5), (9, 5 / 9)]
