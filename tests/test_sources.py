"""Text tables: both orientations, blanks, short rows, summary rows, duplicate ids."""

import math

import pytest
from pyspark.sql import functions as F

from fathomset.functions import text as T
from fathomset.sources import submissions as U
from fathomset.sources import wide


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("uploads")
    (d / "down.csv").write_text("# note\ngene,s1,s2\nG1,10,\nG2,NA,5\nG3.4,90,95\n__no_feature,7,7\ntissue,Liver,Kidney\nG4,1\n")
    (d / "across.tsv").write_text("sample\tg1\tG2\tG3\tlabel\nx\t10\t20\t70\tLung\n")
    return str(d)


def test_submissions(spark, folder):
    panel = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "feature_id string")
    rows = U.long_rows(U.read_cells(spark, folder, panel))
    side = {r["file"].rsplit("/", 1)[1]: r["orientation"] for r in rows.select("file", "orientation").distinct().collect()}
    assert side == {"down.csv": "genes_x_samples", "across.tsv": "samples_x_genes"}
    lib = {r["sample_id"]: r for r in U.sample_libraries(rows).collect()}
    assert lib["s1"]["library"] == 101 and lib["s2"]["library"] == 100 and lib["x"]["library"] == 100
    assert lib["s2"]["n_missing"] == 2 and lib["s2"]["n_short"] == 1  # a blank and the cell past a short row, never 0
    labels = {r["sample_id"]: r["label"] for r in U.claimed_labels(rows).collect()}
    assert labels == {"s1": "Liver", "s2": "Kidney", "x": "Lung"}
    v = {(r["sample_id"], r["feature_id"]): r["value"] for r in U.panel_values(rows, panel, U.sample_libraries(rows)).collect()}
    assert v[("s1", "G2")] is None and v[("x", "G3")] == pytest.approx(19.417, abs=1e-3)


def test_wide_tables_keep_duplicates(spark, tmp_path):
    (tmp_path / "RNA__LIVER.csv").write_text("feature,feature_ID,tissue,assay,v1,v2\n,a,L,R,1,x\n,a,L,R,2,3\n")
    (tmp_path / "RNA__LUNG.csv").write_text("feature,feature_ID,tissue,assay,v9\n,b,L,R,4\n")
    assert {(r["assay"], r["class"]) for r in wide.list_tables(spark, str(tmp_path)).collect()} == {("RNA", "LIVER"), ("RNA", "LUNG")}
    got = {(r["class"], r["feature_id"], r["sample_id"]): r["value"] for r in wide.read_sample_tables(spark, str(tmp_path)).collect()}
    assert got == {("LIVER", "a", "v1"): 1.0, ("LIVER", "a", "v2"): None, ("LIVER", "a__dup1", "v1"): 2.0,
                   ("LIVER", "a__dup1", "v2"): 3.0, ("LUNG", "b", "v9"): 4.0}


def test_cells(spark):
    df = spark.createDataFrame([("05Mar2018", "13:30", "c7"), ("03/05/2018", "1:15:36", "H12"), ("2018-03-05", "x", "Z1"), ("Mar 2018", "9:00", "")],
                               "d string, t string, w string")
    row, col = T.well_position("w")
    got = df.select(T.any_date("d").cast("string").alias("d"), T.clock_hours("t").alias("h"), row.alias("r"), col.alias("c")).collect()
    assert [r["d"] for r in got] == ["2018-03-05", "2018-03-05", "2018-03-05", "2018-03-01"]
    assert [r["h"] for r in got][:2] == [13.5, 1.26] and got[2]["h"] is None
    assert [(r["r"], r["c"]) for r in got] == [(3, 7), (8, 12), (None, None), (None, None)]


def test_tables_in_many_parts(spark, tmp_path):
    rows = [(t, f"G{i:03d}", s, float(i)) for t in ("LIVER", "MIDDLE_EAST") for i in range(40) for s in ("v1", "v2")]
    long = spark.createDataFrame(rows, "table string, feature_id string, sample_id string, value double")
    for t in ("LIVER", "MIDDLE_EAST"):
        wide.write_wide(long.where(f"table = '{t}'"), str(tmp_path / "csv" / f"RNA__{t}.csv"), ["v1", "v2"], 4)
    files = wide.list_tables(spark, str(tmp_path / "csv"))
    assert files.count() >= 6 and {r["class"] for r in files.collect()} == {"LIVER", "MIDDLE_EAST"}
    got = wide.read_sample_tables(spark, str(tmp_path / "csv")).select("class", "feature_id", "sample_id", "value")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    wide.write_gct(long, str(tmp_path / "gct"), ["v1", "v2"], 5)
    assert len(list((tmp_path / "gct").glob("table=*/part-*"))) >= 5
    back = wide.read_gct(spark, str(tmp_path / "gct"), spark.createDataFrame([("v2",)], "sample_id string"))
    assert sorted((r["table"].rsplit("=", 1)[1], r["feature_id"], r["sample_id"], r["value"]) for r in back.collect()) == sorted(r for r in rows if r[2] == "v2")


def test_duplicates_across_parts(spark, tmp_path):
    d = tmp_path / "RNA__LIVER.csv"
    d.mkdir()
    for i, v in enumerate((1, 2)):
        (d / f"part-{i}.csv").write_text(f"feature,feature_ID,tissue,assay,v1\n,a,L,R,{v}\n")
    got = {r["feature_id"]: r["value"] for r in wide.read_sample_tables(spark, str(tmp_path)).collect()}
    assert got == {"a": 1.0, "a__dup1": 2.0}


def test_format_of_each_upload(spark, tmp_path):
    many = [f"E{i}" for i in range(1, 300)]
    (tmp_path / "counts.csv").write_text("gene,s1,s2\n" + "\n".join(f"{g},{i},{2.5 if i == 7 else i}" for i, g in enumerate(many)) + "\nE1.2,999,999\n__no_feature,3,3\nE299,-4,NA\n")
    (tmp_path / "logs.tsv").write_text("sample\tSymA\tE2\tE3\tE2.1\ttissue\nx\t3.5\t\t21.5\t8\tLung\ny\t-0.2\t4.5\t1.25\t9\tLung\n")
    panel = spark.createDataFrame([("E1", "SymA"), ("E2", "SymB"), ("E3", None), ("E999", "SymZ")], "feature_id string, symbol string")
    rows = U.long_rows(U.read_cells(spark, str(tmp_path), panel)).withColumn("file", F.regexp_extract("file", "([a-z]+)\\.[a-z]+$", 1))
    formats = U.file_formats(rows)
    assert {r["file"]: r["format"] for r in formats.collect()} == {"counts": "counts", "logs": "log2cpm"}
    values = U.panel_values(rows, panel, U.sample_libraries(rows), formats)
    v = {(r["sample_id"], r["feature_id"]): r["value"] for r in values.collect()}
    assert v["x", "E1"] == 3.5 and v["y", "E1"] == -0.2 and v["x", "E3"] == 21.5   # found by symbol, taken as given
    assert v["x", "E2"] is None and v["y", "E2"] == 4.5                             # the first of two columns, a blank too
    assert v["s1", "E1"] == 0.0 and v["s1", "E3"] == pytest.approx(math.log2(2e6 / (sum(range(299)) + 999 - 4) + 1))
    q = {r["file"]: r.asDict() for r in U.quality_report(rows, values, 4, formats).collect()}
    c, logs = q["counts"], q["logs"]
    assert (c["n_negative"], c["n_fractional"], c["n_missing"], c["n_summary_rows"], c["few_features"], c["outside_log_range"], c["n_panel_missing"]) == (1, 1, 1, 1, True, 0, 1)
    assert (logs["n_negative"], logs["n_fractional"], logs["n_missing"], logs["few_features"], logs["outside_log_range"], logs["n_panel_missing"]) == (0, 0, 0, False, 1, 1)


def test_forced_scaling(spark):
    from fathomset.operators.claims import choose_scaling
    rows = [(b, f"{b}{i}", "class", [f"c{i % k}"], f"c{i % k}") for b, n, k in (("big", 9, 3), ("small", 4, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "batch string, sample_id string, claim_kind string, claimed array<string>, call string")
    assert {r["batch"]: r["mode"] for r in choose_scaling(df, ["batch"]).collect()} == {"big": "within", "small": "reference"}
    got = {r["batch"]: (r["mode"], r["auto"], r["caveat"]) for r in choose_scaling(df, ["batch"], "within").collect()}
    assert got == {"big": ("within", "within", False), "small": ("within", "reference", True)}


def test_scaling_of_a_set_and_of_its_parts(spark):
    from fathomset.operators.claims import choose_scaling
    rows = [("b", f"s{i}", "class" if i < 9 else "none", [f"c{i % 3}"] if i < 9 else [], f"c{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "batch string, sample_id string, claim_kind string, claimed array<string>, call string")
    got = {r["claim_kind"]: (r["n_samples"], r["n_classes"], r["mode"]) for r in choose_scaling(df, ["batch"], parts=["claim_kind"]).collect()}
    assert got == {None: (12, 3, "within"), "class": (9, 3, "within"), "none": (3, 3, "reference")}
