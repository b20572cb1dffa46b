"""Tables with a primary key, filled in batches that may be sent again.

A batch has an id and is written whole to a folder of its own, which a repeated
run overwrites; a line in the table's list of commits makes its rows visible.
So a batch sent twice adds its rows once, and one that was killed adds none.
Rows whose key the table has already, or that repeat a key of their own batch,
are rejected before anything is written and kept with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

COMMIT_SCHEMA = "batch_id string, n_rows long, n_rejected long"


class KeyedTable:
    """A Parquet table at ``location`` (a shared folder) with columns
    ``schema`` and the primary key ``key``."""

    def __init__(self, spark: SparkSession, location: str, schema: StructType, key: str):
        if key not in schema.fieldNames():
            raise ValueError(f"there is no column {key}")
        self.spark, self.location, self.schema, self.key = spark, location, schema, key

    def _stored(self, part: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.location}/{part}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """One row per committed batch."""
        return self._stored("commits", COMMIT_SCHEMA).dropDuplicates(["batch_id"])

    def _batches(self, part: str, schema: StructType) -> DataFrame:
        # a folder whose batch is not on the list is not read by anybody
        return self._stored(part, schema.add("batch_id", "string")).join(self.commits().select("batch_id"), "batch_id", "left_semi")

    def rows(self) -> DataFrame:
        return self._batches("rows", StructType(list(self.schema))).select(*self._columns())

    def rejects(self) -> DataFrame:
        """Rejected rows of committed batches with ``reason`` and ``batch_id``."""
        return self._batches("rejects", StructType(list(self.schema)).add("reason", "string")).select(*self._columns(), "reason", "batch_id")

    def _columns(self) -> list:
        return [F.col(f"`{c}`") for c in self.schema.fieldNames()]

    def insert(self, df: DataFrame, batch_id: str) -> bool:
        """Insert ``df`` as batch ``batch_id``; False if it is committed already.

        Of rows that share a key the first in column order is taken; a null key
        is rejected.  Existing keys are met by a join on the key, which Spark
        broadcasts or shuffles by their sizes.  Two batches that run at the same
        time do not see each other: one writer at a time."""
        if not batch_id or any(c in batch_id for c in "/=%"):
            raise ValueError(f"{batch_id!r} does not name a folder")
        if not self.commits().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        cols = self._columns()
        batch = df.select(*cols)
        have = self.rows().select(F.col(f"`{self.key}`").alias("_had")).withColumn("_known", F.lit(True))
        first = F.row_number().over(Window.partitionBy(F.col(f"`{self.key}`")).orderBy(*cols))
        judged = batch.withColumn("_no", first).join(have, F.col(f"`{self.key}`") == F.col("_had"), "left")
        reason = (F.when(F.col(f"`{self.key}`").isNull(), F.lit("no key")).when(F.col("_known"), F.lit("key exists"))
                  .when(F.col("_no") > 1, F.lit("key repeated in the batch")))
        staged = f"{self.location}/staged/batch_id={batch_id}"
        judged.select(*cols, reason.alias("reason")).write.mode("overwrite").parquet(staged)
        judged = self.spark.read.schema(StructType(list(self.schema)).add("reason", "string")).parquet(staged)
        for part, some in (("rows", judged.where("reason IS NULL").select(*cols)), ("rejects", judged.where("reason IS NOT NULL"))):
            some.write.mode("overwrite").parquet(f"{self.location}/{part}/batch_id={batch_id}")
        self._commit(judged, batch_id)
        return True

    def _commit(self, judged: DataFrame, batch_id: str) -> None:
        line = judged.agg(F.lit(batch_id).alias("batch_id"), F.count_if(F.col("reason").isNull()).alias("n_rows"),
                          F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))
        line.coalesce(1).write.mode("append").parquet(f"{self.location}/commits")
