"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from condensa.functions.ship import ship

#: While a table is written: its shuffle files go with it, and batches for Python stay small, as their rows can be wide.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
_LOCAL: list[str] = []
_MADE: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and the master is local, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="condensa-"))
        atexit.register(__import__("shutil").rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Writes intermediate tables as Parquet, which survives lost executors, and removes them.

    What a lazy result still reads is left until the session's program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/condensa/{name}-{uuid.uuid4().hex}"
        _MADE[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
        """The table, written and read again; the shuffle files that made it go at once.

        hashes: most of it are hashes, for which dictionaries are not worth trying.
        """
        conf = self.spark.conf
        old = {k: conf.get(k, None) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            conf.set(k, v)
        try:
            df.write.option("parquet.enable.dictionary", str(not hashes).lower()).mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in old.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.path(name))


@atexit.register
def _clean() -> None:
    for path, spark in _MADE.items():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return
