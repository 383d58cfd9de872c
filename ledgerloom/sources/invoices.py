"""Invoice lookup tables and invoice directories."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab

LOOKUP_SCHEMA = (
    "vendor_invoice_no string, invoice_key string, gnl_ref string, pdf_file string, pages string, gl_refs string, "
    "gl_entityids string, found_in_gl string"
)


def read_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """The lookup CSV with `csv_row`, its reading order; a missing file is an empty table."""
    try:
        header = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        header = spark.createDataFrame([], LOOKUP_SCHEMA)
    names = [part.split()[0] for part in LOOKUP_SCHEMA.split(", ")]
    kept = [F.col(n) if n in header.columns else F.lit("").alias(n) for n in names]
    return header.select(*kept, F.monotonically_increasing_id().alias("csv_row"))


def list_invoice_files(spark: SparkSession, directory: str) -> DataFrame:
    """`*.pdf` directly inside `directory`: path, stem, size. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(directory)
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return files.select("path", name.alias("stem"), F.col("length").alias("size_bytes"))


def read_invoice_files(
    spark: SparkSession, directory: str, max_bytes: int | None = vocab.INVOICE_MAX_BYTES
) -> DataFrame:
    """As `list_invoice_files`, with leading bytes and hash; files over `max_bytes` (None: no limit) are listed but not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(directory)
    large = files.where(F.lit(False) if max_bytes is None else F.col("length") > max_bytes)
    small = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("stem")
    size = F.col("length").alias("size_bytes")
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("head")
    opened = small.select("path", name, size, head, F.sha2("content", 256).alias("sha256"))
    unopened = large.select("path", name, size, F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("sha256"))
    return opened.unionByName(unopened)
