"""Wide text tables (features × samples or the reverse) to long rows, many files in one distributed scan.

Every file may have its own header.  Lines keep their file and position, the header line of each file
is found with a map-side limited rank, and cells come from splitting each line against its own header;
no file is ever gathered as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import number_cell, unquote
from ..operators.matrices import mark_duplicates
from ..session import checked_broadcast

# fixed values: the leading columns of a sample table and the naming of its files
LEADING = ["feature", "feature_ID", "tissue", "assay"]
TABLE_NAME = r"([A-Z]+)__([A-Z]+(?:_[A-Z]+)*)\.csv(/|$)"
TABLE_PATH = r"^(.*?[A-Z]+__[A-Z]+(?:_[A-Z]+)*\.csv)(?:/|$)"
FOLDER = r"^(.*)/[^/]*$"


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue ``assay, class, path`` of the ``<ASSAY>__<CLASS>.csv`` tables under a folder (contents unread)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
             .load(folder).select("path", "length"))
    return files.select(F.regexp_extract("path", TABLE_NAME, 1).alias("assay"),
                        F.regexp_extract("path", TABLE_NAME, 2).alias("class"), "path", "length").where("assay <> ''")


def numbered_lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Text lines with their file and an order within it (block offset, then position in the block)."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
           .select(F.regexp_replace("value", "\r", "").alias("line"), F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")))
    return raw.where(F.trim("line") != "")


def separator(header: str | Column) -> Column:
    h = F.col(header) if isinstance(header, str) else header
    return (F.when(h.contains("\t"), "\t").when(h.contains(";") & ~h.contains(","), ";").otherwise(","))


def split_table(lines: DataFrame, skip: int = 0, table: Column | None = None) -> DataFrame:
    """``file, table, block, seq, header, cells``: body lines beside their header, after ``skip`` preamble lines.

    A table is one file; with ``table`` it is all files that share that value, the header is in the first of them by name,
    and the order of its rows is file, block, position.
    """
    named = lines.withColumn("table", F.col("file") if table is None else table)
    start = named.where("block = 0")
    if table is not None:
        start = start.join(checked_broadcast(start.groupBy("table").agg(F.min("file").alias("file"))), ["table", "file"], "left_semi")
    over = W.partitionBy("table").orderBy("seq")
    top = start.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= skip + 1)
    head = (top.where(F.col("_n") == skip + 1)
            .select("table", F.col("file").alias("_first"), F.col("seq").alias("_h"), F.col("line").alias("_header"), separator("line").alias("_sep")))
    behind = (F.col("file") != F.col("_first")) | (F.col("block") > 0) | (F.col("seq") > F.col("_h"))
    body = named.join(checked_broadcast(head), "table").where(behind)
    cut = lambda c: F.transform(F.split(F.col(c), F.col("_sep"), F.lit(-1)), unquote)
    return body.select("file", "table", "block", "seq", cut("_header").alias("header"), cut("line").alias("cells"))


def read_sample_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All sample tables of a folder as long rows; non-numeric cells are NULL, repeated ids get ``__dupN``.

    A table is a file, or a folder of that name with part files that each have the header; its rows are in the order of
    file, block and position.
    """
    t = split_table(numbered_lines(spark, folder, "*.csv").where(~F.col("line").startswith("#")))
    t = (t.withColumn("assay", F.regexp_extract("file", TABLE_NAME, 1)).withColumn("class", F.regexp_extract("file", TABLE_NAME, 2))
         .withColumn("feature_id", F.element_at("cells", F.array_position("header", "feature_ID").cast("int")))
         .withColumn("table", F.regexp_extract("file", TABLE_PATH, 1)))
    order = W.partitionBy("table").orderBy("file")  # a row per file
    files = t.select("table", "file").distinct().withColumn("_no", F.row_number().over(order)).drop("table")
    t = t.join(checked_broadcast(files), "file").withColumn("ordinal", F.struct("_no", "block", "seq"))
    t = mark_duplicates(t, "feature_id", "ordinal", ["table"])
    cells = t.select("assay", "class", "feature_id", F.explode(F.arrays_zip(
        F.col("header").alias("name"), F.col("cells").alias("cell"))).alias("_c"))
    return cells.where(~F.col("_c.name").isin(LEADING)).select(
        "assay", "class", "feature_id", F.col("_c.name").alias("sample_id"), number_cell("_c.cell").alias("value"))


def read_gct(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """GCT-like tables: two preamble lines, wanted sample columns only, id version stripped.

    A table is a folder of part files, the first of which begins with the preamble and the header; ``table`` is its path.
    """
    t = split_table(numbered_lines(spark, folder, "*.txt"), skip=2, table=F.regexp_extract("file", FOLDER, 1))
    cells = t.select("table", F.split(F.col("cells")[0], r"\.").getItem(0).alias("feature_id"),
                     F.explode(F.arrays_zip(F.col("header").alias("name"), F.col("cells").alias("cell"))).alias("_c"))
    return (cells.select("table", "feature_id", F.col("_c.name").alias("sample_id"), number_cell("_c.cell").alias("value"))
            .join(checked_broadcast(wanted.select("sample_id")), "sample_id", "left_semi"))


def read_per_sample_files(spark: SparkSession, folder: str, name_pattern: str, names: list[str]) -> DataFrame:
    """Many two-column files, one sample each; metadata comes from the path."""
    raw = (spark.read.option("recursiveFileLookup", True).option("sep", "\t").schema("feature_id string, cell string")
           .csv(folder).select("*", F.col("_metadata.file_path").alias("_p")))
    meta = [F.regexp_extract("_p", name_pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return raw.select(*meta, "feature_id", number_cell("cell").alias("value"))


def write_wide(long: DataFrame, path: str, samples: list[str], parts: int | None = None) -> None:
    """One wide CSV table (features × the given sample columns) with the leading columns of a sample table.

    It is a folder of part files by range of the feature, each with the header.
    """
    wide = long.groupBy("feature_id").pivot("sample_id", samples).agg(F.first("value")).withColumnRenamed("feature_id", "feature_ID")
    ranged = wide.repartitionByRange(parts, "feature_ID") if parts else wide.repartitionByRange("feature_ID")
    (ranged.sortWithinPartitions("feature_ID").select(F.lit(None).cast("string").alias("feature"), "feature_ID", F.lit("x").alias("tissue"), F.lit("x").alias("assay"), *samples)
     .write.mode("overwrite").option("header", True).csv(path))


def write_gct(long: DataFrame, path: str, samples: list[str], parts: int | None = None) -> None:
    """GCT-like tables, one for each ``table``: a folder of part files by range of the line, the first with preamble and header."""
    wide = long.groupBy("table", "feature_id").pivot("sample_id", samples).agg(F.first("value"))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in samples]
    body = wide.select("table", F.lit(3).alias("o"), F.concat_ws("\t", F.concat("feature_id", F.lit(".7")), F.lit("d"), *shown).alias("line"))
    lead = [F.lit("#1.2"), F.concat_ws("\t", F.count(F.lit(1)), F.lit(len(samples))), F.lit("\t".join(["Name", "Description", *samples]))]
    head = wide.groupBy("table").agg(F.array(*[F.struct(F.lit(i).alias("o"), x.cast("string").alias("line")) for i, x in enumerate(lead)]).alias("h")).select("table", F.inline("h"))
    lines = head.unionByName(body)
    keys = ["table", "o", "line"]
    ranged = lines.repartitionByRange(parts, *keys) if parts else lines.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select("table", "line").write.mode("overwrite").partitionBy("table").text(path)
