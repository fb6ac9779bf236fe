"""A table that is saved again and again, each time whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.operators import jobs


class SavedState:
    """Versions of a table below one folder, on any store.

    A version is Parquet below ``versions/<n>``, and counts once the file ``commits/<n>``
    is there; that file is created only after the data is complete, and only if nobody else has.
    So whoever is killed on the way leaves the version before as it was.  The last ``retain``
    versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, retain: int = 3):
        self.spark, self.path, self.retain = spark, path.rstrip("/"), max(1, retain)
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *names: str):
        path = self._paths.Path("/".join([self.path, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The versions that are complete, oldest first."""
        fs, folder = self._at("commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def load(self, version: int | None = None) -> DataFrame | None:
        """A complete version (the last one); None where there is none."""
        there = self.versions()
        version = there[-1] if version is None and there else version
        return self.spark.read.parquet(f"{self.path}/versions/{version}") if version in there else None

    def save(self, table: DataFrame, version: int | None = None) -> int:
        """Write ``table`` as the next version, or as ``version`` unless that is complete already."""
        there = self.versions()
        version = (there[-1] + 1 if there else 0) if version is None else version
        if version not in there:
            table.write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
            fs, mark = self._at("commits", str(version))
            fs.create(mark, False).close()
            for old in self.versions()[: -self.retain]:
                for kind in ("commits", "versions"):
                    fs, path = self._at(kind, str(old))
                    fs.delete(path, True)
        return version

    def sink(self, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: the last row of each key so far, as one version a batch; a batch that comes again changes nothing."""

        def add(rows: DataFrame, batch: int) -> None:
            earlier = self.load(max([v for v in self.versions() if v < batch], default=None))
            every = rows if earlier is None else earlier.unionByName(rows)
            self.save(jobs.latest(every, keys, order).select(*rows.columns), batch)

        return add
