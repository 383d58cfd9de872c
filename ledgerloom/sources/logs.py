"""The stored deal profile. (The decision log is read in `operators.log`.)"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "struct<name:string,aliases:array<string>,matter_numbers:array<string>,invoice_numbers:array<string>,"
    "properties:array<string>,entityids:array<string>,advisors_seen:array<string>,"
    "evidence:array<struct<ref:string,quote:string>>,supporting_row_idxs:array<bigint>,supporting_rows:bigint,"
    "quarters:array<string>>"
)
PROFILE = f"quarters array<string>, period_range string, source_acctnum string, entries array<{ENTRY}>"


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of a profile document. Missing means empty; a document that does not parse is an error."""
    reader = spark.read.schema(PROFILE).option("mode", "FAILFAST").option("multiLine", True)
    try:
        profile = reader.json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        profile = spark.createDataFrame([], PROFILE)
    return profile.select("quarters", "period_range", "source_acctnum", F.explode("entries").alias("entry"))
