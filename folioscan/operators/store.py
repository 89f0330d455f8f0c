"""The model on disk: one Parquet table for each kind of element, partitioned by a hash of document_id so that one document is one folder of each."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, document_id):
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def path(self, name: str) -> str:
        if ".." in name or name.startswith(("/", "\\")):
            raise ValueError(f"not a table name: {name}")
        return f"{self.folder}/{name}"

    def save(self, name: str, rows: DataFrame) -> None:
        """Adds rows; the rows of the same documents that are there are replaced. Only folders that hold such documents are rewritten."""
        new = rows.withColumn("bucket", self._bucket(F.col("document_id")))
        known = self._schema(name)
        old = self.spark.read.schema(known).parquet(self.path(name)) if known else None
        if old is not None:
            ids = new.select("document_id", "bucket").distinct()
            touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most `buckets` numbers
            kept = old.where(F.col("bucket").isin(touched)).join(ids, ["document_id", "bucket"], "left_anti")
            new = kept.select(new.columns).unionByName(new)
            new = new.checkpoint() if self.spark.sparkContext.getCheckpointDir() else new.cache()
        if known is None:
            self.spark.createDataFrame([(new.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schemas/{name}")
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))

    def _schema(self, name: str) -> StructType | None:
        """The kept schema of a table, so that empty tables can be read; None before the first save."""
        try:
            return StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schemas/{name}").first()[0]))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _read(self, name: str) -> DataFrame:
        known = self._schema(name)
        if known is None:
            raise ValueError(f"no table {name} in {self.folder}")
        return self.spark.read.schema(known).parquet(self.path(name))

    def load(self, name: str, document_id: str | None = None) -> DataFrame:
        """All rows, or those of one document: one folder is read."""
        rows = self._read(name)
        if document_id is not None:
            bucket = self.spark.range(1).select(self._bucket(F.lit(document_id))).first()[0]
            rows = rows.where((F.col("bucket") == bucket) & (F.col("document_id") == document_id))
        return rows.drop("bucket")

    def has(self, name: str) -> bool:
        return self._schema(name) is not None

    def ids(self, name: str = "documents") -> DataFrame:
        return self._read(name).select("document_id").distinct()

    def delete(self, name: str, document_id: str) -> bool:
        """Whether the document was there; its folder is rewritten without it."""
        rows = self._read(name)
        bucket = self.spark.range(1).select(self._bucket(F.lit(document_id))).first()[0]
        mine = rows.where(F.col("bucket") == bucket)
        if mine.where(F.col("document_id") == document_id).isEmpty():
            return False
        rest = mine.where(F.col("document_id") != document_id)
        rest = rest.checkpoint() if self.spark.sparkContext.getCheckpointDir() else rest.cache()
        if rest.isEmpty():  # an overwrite with nothing would leave the folder as it is
            self._drop(f"{self.path(name)}/bucket={bucket}")
            return True
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))
        return True

    def _drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
