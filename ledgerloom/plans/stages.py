"""Tables of a job that a later attempt goes on from."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

#: Gets a table's name and how to build it; gives the written table.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def scratch_tables(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Tables in the scratch folder, built anew for each job."""
    return materialize(build(), name)


class Stages:
    """Tables of one run below `path`. A table whose write was committed is read; any other is built and written.

    A job that failed is started again with the same arguments and does only what is not there yet. `arguments` are
    stored beside the tables; an attempt with other ones is refused, because it would mix two runs. Inputs are not
    compared: a run over changed inputs takes a new path.
    """

    def __init__(self, spark: SparkSession, path: str, arguments: dict) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        said = json.dumps(arguments, sort_keys=True)
        stored = self._stored_arguments()
        if stored is None:
            spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/arguments")
        elif stored != said:
            raise ValueError(f"{self.path} holds a run with the arguments {stored}, not {said}")

    def _stored_arguments(self) -> str | None:
        if not self._committed("arguments"):
            return None
        return self.spark.read.text(f"{self.path}/arguments").head()[0]

    def _committed(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table `name`; the schema is that of the written files."""
        place = f"{self.path}/{name}"
        if not self._committed(name):
            build().write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)

    def once(self, name: str, act: Callable[[], None]) -> None:
        """Runs `act` unless an earlier attempt finished it; one that was cut off runs again, so it must bear that."""
        if not self._committed(name):
            act()
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/{name}")
