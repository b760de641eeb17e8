"""Matrix Market text: coordinate and array files, read and written as DataFrames.

Entries are parsed in parallel from the text source; only the header and the size line are
read on the driver. Indexes are 1-based in files. The symmetry in the header is reported
but not expanded; duplicates are summed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.operators.matrix import Matrix

#: Words of the header line.
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")


@dataclass
class Header:
    symmetry: str
    is_complex: bool
    is_dense: bool


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of the split they were read in, and their order within it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _data(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).withColumn("line", F.trim("value")).where((F.col("line") != "") & ~F.col("line").startswith("%")).drop("value")


def header(spark: SparkSession, path: str) -> Header:
    line = _lines(spark, path).where(F.col("value").startswith("%%MatrixMarket")).first()
    words = line["value"].lower().split() if line else []
    if len(words) < 5 or words[1] != "matrix":
        raise ValueError(f"{path} has no Matrix Market header")
    return Header(words[4] if words[4] in SYMMETRIES else "general", words[3] == "complex", words[2] == "array")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Data lines in file order with their number, the size line being 0: splits are counted first, lines ranked within their split."""
    df = _data(spark, path)
    counts = df.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row per split
    start = counts.select("file", "block", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return df.withColumn("k", inner).join(F.broadcast(start), ["file", "block"]).select((F.col("k") + F.col("before")).cast("long").alias("n"), F.split("line", r"\s+").alias("w"))


def load_sparse(spark: SparkSession, path: str, check: bool = True) -> Matrix:
    """A coordinate file, or a folder of its parts in order of name; with check, fails where an index is out of range or the count differs."""
    header(spark, path)
    data = _data(spark, path)
    # the size line is the first data line of the first file: its first split holds it
    size = data.where("block = 0").agg(F.min_by(F.struct("line", "file", "at"), F.struct("file", "at")).alias("m")).first()["m"]
    if size is None:
        raise ValueError(f"{path} has no size line")
    rows, cols, count = (int(x) for x in size["line"].split())
    w = F.split("line", r"\s+")
    value = F.when(F.size(w) > 2, w[2].cast("double")).otherwise(F.lit(1.0))
    rest = data.where(~((F.col("file") == size["file"]) & (F.col("block") == 0) & (F.col("at") == size["at"])))
    entries = rest.select((w[0].cast("long") - 1).alias("i"), (w[1].cast("long") - 1).alias("j"), value.alias("v"))
    if check:
        bad, n = entries.agg(F.count_if((F.col("i") < 0) | (F.col("i") >= rows) | (F.col("j") < 0) | (F.col("j") >= cols)), F.count("*")).first()
        if bad or n != count:
            raise ValueError(f"{path}: {bad} entries out of range, {n} of {count} entries")
    return Matrix.from_triplets(entries, rows, cols)


def load_dense(spark: SparkSession, path: str) -> Matrix:
    """An array file: values in column-major order."""
    numbered = _numbered(spark, path)
    size = numbered.where("n = 0").first()["w"]
    rows, cols = int(size[0]), int(size[1]) if len(size) > 1 else 1
    at = F.col("n") - 1
    df = numbered.where("n > 0").select((at % rows).alias("i"), F.floor(at / rows).cast("long").alias("j"), F.col("w")[0].cast("double").alias("v"))
    return Matrix(df, rows, cols)


load_vector = load_dense


def load_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every .mtx file in a folder, for going through problems in parallel."""
    return spark.read.option("pathGlobFilter", "*.mtx").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def _save(head: list[str], body: DataFrame, path: str, single: bool) -> None:
    """Lines in order of (a, b) after the head, as part files in order of name, or (in one task) as one."""
    first = body.sparkSession.createDataFrame([(-1, k, x) for k, x in enumerate(head)], "a long, b long, line string")
    lines = first.unionByName(body)
    lines = lines.coalesce(1).sortWithinPartitions("a", "b") if single else lines.orderBy("a", "b")
    lines.select("line").write.mode("overwrite").text(path)


def save_sparse(m: Matrix, path: str, symmetry: str = "general", single: bool = False) -> None:
    """A folder of coordinate text, sorted over all its parts; single gives one file, written by one task."""
    body = m.df.select(F.col("j").alias("a"), F.col("i").alias("b"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string")).alias("line"))
    _save([f"%%MatrixMarket matrix coordinate real {symmetry}", f"{m.rows} {m.cols} {m.df.count()}"], body, path, single)


def save_dense(m: Matrix, path: str, single: bool = False) -> None:
    body = m.to_dense().df.select(F.col("j").alias("a"), F.col("i").alias("b"), F.col("v").cast("string").alias("line"))
    _save(["%%MatrixMarket matrix array real general", f"{m.rows} {m.cols}"], body, path, single)


save_vector = save_dense


def save_binary(m: Matrix, path: str) -> None:
    """Triplets and extents as Parquet."""
    m.df.select("i", "j", "v", F.lit(m.rows).alias("_rows"), F.lit(m.cols).alias("_cols")).write.mode("overwrite").parquet(path)


def load_binary(spark: SparkSession, path: str, rows: int, cols: int) -> Matrix:
    return Matrix(spark.read.parquet(path).select("i", "j", "v"), rows, cols)


def load_problems(spark: SparkSession, path: str) -> list[tuple[str, str, str | None, str | None]]:
    """(name, matrix, right side, reference solution) of a folder's problems: NAME.mtx with NAME_b.mtx and NAME_x.mtx where they are there; SPD matrices are called NAME_SPD.mtx."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mtx").load(path).select("path").collect()  # a row per file, no content
    named = {r["path"].rsplit("/", 1)[1][: -len(".mtx")]: r["path"] for r in files}
    out = []
    for name, at in sorted(named.items()):
        if not name.endswith(("_b", "_x")):
            stem = name.removesuffix("_SPD")
            out.append((name, at, named.get(f"{stem}_b"), named.get(f"{stem}_x")))
    return out


def format_rows(m: Matrix, digits: int = 6, separator: str = " ", row_prefix: str = "", row_suffix: str = "", width: int = 0) -> DataFrame:
    """Printed rows (i, line) of a dense matrix; cells are padded on the left to a width."""
    cell = lambda x: F.lpad(F.format_number(x, digits), width, " ") if width else F.format_number(x, digits)
    return m.to_arrays().select("i", F.concat(F.lit(row_prefix), F.array_join(F.transform("row", cell), separator), F.lit(row_suffix)).alias("line"))
