"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of Parquet tables below ``spark.checkpoint.dir``.

    Where that is unset a session on one machine, as in tests, takes a folder of its own; a cluster has to name one.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp()}"
        self.spark, self.path, self.count = spark, f"{base}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, tidy: bool = False) -> DataFrame:
        """Writes ``df`` and reads it again; ``tidy``: what was shuffled for it need not wait for the driver's next collection of garbage."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        if tidy:
            del df
            gc.collect()
            self.spark._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Writes ``df`` as a table of buckets by ``key``, so that joins by it don't shuffle it again."""
        self.count += 1
        name = f"wayfold_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{self.path}/{self.count}").saveAsTable(name)
        self.tables = [*getattr(self, "tables", []), name]
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.table(name)

    def forget(self) -> None:
        """Drops the bucketed tables from the catalog."""
        for name in getattr(self, "tables", []):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
