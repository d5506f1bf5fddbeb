import numpy as np
from pyspark.sql import functions as F

from fathomset.llm import near as N
from fathomset.llm.bagminhash import band_values
from fathomset.llm.paragraphs import minhashes


def template(variants: int, pairs: int):
    """Sets of one template: 160 common hashes and 30 of their own; a true pair shares 12 of those, no others reach 0.8."""
    rng = np.random.default_rng(4)
    hashes = lambda n: rng.integers(1, 1 << 62, n)
    common, sets = hashes(160), []
    for k in range(variants):
        own = hashes(30)
        if variants - k <= pairs:
            own[:12] = sets[variants - k - 1][160:172]
        sets.append(np.concatenate([common, own]))
    return sets


def test_true_pairs_of_one_template_are_all_found(spark):
    sets = template(1000, 80)
    rows = 4
    bands = N.bands_for(0.8, rows, 1e-4)
    values = band_values(minhashes(np.concatenate(sets).astype(np.uint64), np.arange(0, 190 * len(sets) + 1, 190), bands * rows), rows)
    keys = np.random.default_rng(5).integers(1, 1 << 62, len(sets)).tolist()
    parent = dict(zip(keys, keys, strict=True))
    table = np.stack([np.isin(np.unique(np.concatenate(sets)), s) for s in sets]).astype(np.float32)
    shared = table @ table.T
    links = [(i, j) for i, j in zip(*np.nonzero(shared / (380 - shared) >= 0.8), strict=True) if i < j]
    met = [(i, j) for i, j in links if (values[i] == values[j]).any()]
    assert len(links) == 80 and len(met) >= 78  # bands miss few
    for i, j in met:
        parent[keys[i]] = parent[keys[j]] = min(keys[i], keys[j])
    units = spark.createDataFrame([(k, 190, v.tolist()) for k, v in zip(keys, values, strict=True)], "key long, size long, bands array<long>")
    held = spark.createDataFrame([(k, s.tolist()) for k, s in zip(keys, sets, strict=True)], "key long, hashes array<long>")
    got = N.classes(units, lambda wanted: held.join(wanted, "key", "left_semi"))
    assert {k: r for k, r in got.where(F.col("key") != F.col("root")).collect()} == {k: r for k, r in parent.items() if k != r}


def test_units_meet_few_leaders_however_large_a_bucket_is(spark, monkeypatch):
    """A class of 300 near copies around one centre, in buckets with 300 strangers of its template."""
    rng = np.random.default_rng(9)
    hashes = lambda n: rng.integers(1, 1 << 62, n)
    centre, sets = hashes(200), []
    for k in range(600):
        own = centre.copy()
        own[rng.choice(200, 10 if k < 300 else 45, replace=False)] = hashes(10 if k < 300 else 45)
        sets.append(own)
    bands = N.bands_for(0.8, 4, 1e-4)
    values = band_values(minhashes(np.concatenate(sets).astype(np.uint64), np.arange(0, 200 * len(sets) + 1, 200), bands * 4), 4)
    units = spark.createDataFrame([(k, 200, v.tolist()) for k, v in enumerate(values)], "key long, size long, bands array<long>")
    held = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sets)], "key long, hashes array<long>")
    compared, plain = [], N.settle

    def spy(table):
        out = plain(table)
        if "leader" in out.columns:
            compared.append(out.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return out
    monkeypatch.setattr(N, "settle", spy)
    got = dict(N.classes(units, lambda wanted: held.join(wanted, "key", "left_semi")).collect())
    assert compared and max(compared) <= 3
    assert len({got[k] for k in range(300)}) == 1
