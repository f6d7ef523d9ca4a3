"""What a streamed pipeline keeps between its micro-batches, as Parquet beside the query's checkpoint.

Rows of windows that the watermark hasn't closed, and the last totals of series
and keys. Every micro-batch reads the newest committed version before its own
number and writes its own, so a repeated micro-batch starts from the same state.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "pipeline_state"


@dataclass(frozen=True)
class Slot:
    """One table of totals by key: what the micro-batch before has put, and what the next one gets."""

    held: Held
    name: str

    def get(self) -> DataFrame | None:
        return self.held.get(self.name)

    def put(self, totals: DataFrame) -> None:
        self.held.put(self.name, totals)


class Held:
    """The state of one micro-batch; name keeps the states of several stages apart.

    last: no more rows come, so every open window is closed, and the watermark moves to the end of the last one.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, batch_id: int | None, lateness_seconds: float, last: bool = False):
        self.spark, self.root, self.lateness, self.last = spark, f"{checkpoint.rstrip('/')}/{FOLDER}", lateness_seconds, last
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []
        before = [v for v in found if (batch_id is None or v < f"{batch_id:012d}") and self._exists(f"{v}/commit/_SUCCESS")]
        self.before = before[-1] if before else None
        self.version = f"{batch_id:012d}" if batch_id is not None else f"{self.before or '000000000000'}.closed"
        self._old = [v for v in before if v != self.before]
        self._meta = json.loads(spark.read.text(f"{self.root}/{self.before}/commit").first()[0]) if self.before else {}
        self._now: dict[str, dict] = {k: dict(v) for k, v in self._meta.items()}

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"))

    def get(self, name: str) -> DataFrame | None:
        """The table that the micro-batch before has put."""
        at = f"{self.before}/{name.replace('/', '_')}"
        return self.spark.read.parquet(f"{self.root}/{at}") if self.before and self._exists(at) else None

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.version}/{name.replace('/', '_')}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def closed(self, name: str, rows: DataFrame, seconds: Column, window: int) -> DataFrame:
        """The rows of the windows that close now, from this and earlier micro-batches; each row comes out once.

        Rows of windows that were closed before are late: they are left out and counted. Rows without time come out at once.
        """
        past = self._meta.get(name, {}).get("watermark")
        at = F.floor(seconds).cast("long")
        new = rows.withColumn("__end", at - F.pmod(at, F.lit(window)) + window)
        late = F.lit(False) if past is None else F.coalesce(F.col("__end") <= past, F.lit(False))
        kept = self.get(name)
        # The watermark follows the rows' own times; __at is null for rows that are kept already.
        both = new.withColumns({"__late": late, "__at": at})
        if kept is not None:
            both = both.unionByName(kept.where(F.col("__end") > past if past is not None else "__end IS NOT NULL").withColumns({"__late": F.lit(False), "__at": F.lit(None).cast("long")}))
        both = self.put(name, both)
        r = both.agg(F.max("__at").alias("at"), F.max(F.when(~F.col("__late"), F.col("__end"))).alias("end"), F.count_if("__late").alias("late")).first()
        reached = [x for x in (past, r["end"] if self.last else None, None if r["at"] is None else r["at"] - self.lateness) if x is not None]
        mark = max(reached) if reached else None
        self._now[name] = {"watermark": mark, "late": self._meta.get(name, {}).get("late", 0) + r["late"]}
        done = F.col("__end").isNull() if mark is None else F.col("__end").isNull() | (F.col("__end") <= mark)
        return both.where(~F.col("__late") & done).drop("__end", "__late", "__at")

    def late_rows(self) -> dict[str, int]:
        """Rows left out so far because their window was closed, by stage and input."""
        return {k: v["late"] for k, v in self._now.items()}

    def commit(self) -> None:
        """Makes this version the one the next micro-batch starts from; the version before stays for a repetition."""
        self.spark.createDataFrame([(json.dumps(self._now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{self.version}/commit")
        for v in self._old:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{v}"), True)
