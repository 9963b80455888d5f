"""Tables an operator writes on its way, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowward.session import scratch_path


#: Shuffle files go when the table is written, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one run of an operator; ``drop`` removes those that are used up.

    The tables that the operator's result reads have to stay; they go with the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name

    def cut(self, df: DataFrame, **options: str) -> DataFrame:
        """Write ``df`` once, with ``options`` of the writer, and go on from the written table."""
        path = scratch_path(self.spark, self.name)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove written tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)
