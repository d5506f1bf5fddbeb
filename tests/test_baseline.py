from pyspark.ml.feature import Imputer

from fathomset.models import pipelines as P
from fathomset.plans import modelling as M


def test_sets_of_columns_share_the_preparation_of_a_fold(spark, monkeypatch):
    rows = [(f"g{i % 40}", float(i % 3 == 0), float(i * 7 % 24) if i % 11 else None, float(i * i % 31), float(i % 3 == 0) + i * 5 % 7) for i in range(400)]
    data = spark.createDataFrame(rows, "group_id string, label double, a double, b double, c double")
    sets = {"one": ["a", "b"], "two": ["c"], "all": ["a", "b", "c"]}
    want = {(r["fold"], name, r["auroc"]) for name, cols in sets.items() for r in M._grouped_auroc(data, lambda n, c=cols: P.covariate_pipeline(c, [], n)).collect()}
    fits, fit = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    got = {(r["fold"], r["features"], r["auroc"]) for r in M._grouped_aurocs(data, sets).collect()}
    assert got == want and len(got) == 15
    assert len(fits) == 5
