"""Tables that one job writes and the next reads, in the folder the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` (read from the session; a local
master with none set gets a scratch folder, see ``tabml.session``). Nothing is kept on one machine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabml.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, as the session names it (scheme included)."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Written tables of one operator run, by path, so that those no longer read can be removed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_path(spark, name), 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of the files: a lost executor costs a reread, never a rerun."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables whose readers are done (their results are written elsewhere)."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
