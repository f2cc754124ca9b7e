"""Lineage cuts in the shared folder.

Iterative operators write the table of each round to the folder named by
``spark.checkpoint.dir`` (reachable by every executor) and read it back, so a lost
executor never costs more than one round.  Only when the setting is absent, as in
tests on one machine, a temporary folder is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_ROOTS: list[str] = []


def _sweep() -> None:
    """At the end of the driver, delete what its runs left in a folder of the file system."""
    for root in _ROOTS:
        path = root.removeprefix("file://").removeprefix("file:")
        if "://" not in path:
            shutil.rmtree(path, ignore_errors=True)


atexit.register(_sweep)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; makes a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="lumenveil-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return _LOCAL["dir"]


class Workspace:
    """Tables written by one run of an operator; superseded ones can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append(self.root)

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as a plain scan."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lumenveil_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "_lumenveil_path", None)
        if path is None:
            return
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
