"""Draws stay inside each key, and paired draws pick the same people in both frames."""

import pandas as pd
from pyspark.sql import functions as F

from fathomset.operators import resample as R


def test_every_key_draws_its_own_individuals(spark):
    rows = [("few", i, 1.0) for i in range(2)] + [("many", i, float(i)) for i in range(60)] + [(None, i, 2.0) for i in range(3)]
    per = spark.createDataFrame(rows, "k string, group_id long, v double")
    w = R.draw_weights(per, 40, 5, keys=["k"]).toPandas()
    sums = w.groupby(["k", "draw"], dropna=False)["w"].sum().unstack("draw")
    assert sums.shape[1] == 40 and (sums.loc["few"] == 2).all() and (sums.loc["many"] == 60).all()
    ci = R.bootstrap_mean(per, ["k"], "v", 40, 5).toPandas()
    assert sorted(ci["n_groups"]) == [2, 3, 60]


def test_paired_draws_stay_the_same_people(spark):
    first = spark.createDataFrame(pd.DataFrame({"group_id": range(40), "v": [float(i) for i in range(40)]}))
    second = first.where("group_id <> 17").withColumn("v", F.col("v") - 5)
    got = R.bootstrap_difference(first, second, "v", 60, 9, paired=True).first()
    # the same people with a shift of 5: only individual 17 moves the difference
    assert abs(got["difference"] - 5) < 0.2 and got["hi"] - got["lo"] < 1.6
    apart = R.bootstrap_difference(first, second, "v", 60, 9, paired=False).first()
    assert apart["hi"] - apart["lo"] > 3 * (got["hi"] - got["lo"])


def test_flags_from_bit_masks_are_the_permuted_ones(spark):
    rows = spark.range(9000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 9 == 0, "small").otherwise("large").alias("part"),
                                    (F.col("id") % 7 < 2).alias("pos"), (F.col("id") * 0.5).alias("r"))
    total = [F.count(F.lit(1)).alias("n"), F.count_if("pos").alias("p"), F.sum(F.when(F.col("pos"), F.col("r"))).alias("s")]
    at_once = R.permuted_flags(rows, ["part"], "pos", 3, 72, carry=["r"]).groupBy("perm").agg(*total)
    by_join = R.permuted(rows, ["part"], ["pos"], 3, 72, carry=["r"])
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, by_join.groupBy("perm").agg(*total).collect()))
    # every label of a stratum is dealt once, and what is carried stays with its row
    assert {tuple(r) for r in by_join.groupBy("perm", "part").agg(F.count_if("pos")).collect()} == {
        (i, part, n) for i in (1, 2, 3) for part, n in ((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count_if("pos").alias("n")).collect())}
    assert by_join.where("r <> sample_id * 0.5").count() == 0
