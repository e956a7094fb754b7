"""A stored search index that grows: vectors by k-means cell, a log of appends, compaction.

Layout under the index folder: ``centres`` (fitted once), ``rows/batch=<name>/cell=<n>/`` and ``log``. A batch is
part of the index once the log names it, so a failed append leaves nothing that readers
see; an append that is run again with the same name changes nothing. Compaction writes the live
batches anew as one and logs that it replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.operators import cluster, retrieve

_LOG = "batch string, replaces array<string>, rows bigint"


@dataclass(frozen=True)
class SearchIndex:
    """Rows of ``key``, ``vector`` and any other columns, in cells."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    key: str
    vector: str

    @classmethod
    def create(
        cls, corpus: DataFrame, path: str, cells: int, key: str, vector: str = "embedding", seed: int = 42,
        batch: str = "first",
    ) -> SearchIndex:
        """Fit the cells on a bounded sample of ``corpus``, store them, and append all its rows."""
        held = corpus.where(F.col(vector).isNotNull())
        centres = cluster.fit_centres(retrieve.fitting_rows(held, key, seed), cells, seed, 1, vector)
        if centres is None:
            raise ValueError("an index needs vectors to fit its cells on")
        spark = corpus.sparkSession
        rows = [(i, [float(x) for x in c], key, vector) for i, c in enumerate(centres)]
        named = spark.createDataFrame(rows, "cell int, centre array<double>, key string, vector string")
        named.coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path, centres, key, vector)
        index.append(corpus, batch)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        found = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
        return cls(spark, path, np.array([r["centre"] for r in found]), found[0]["key"], found[0]["vector"])

    def _logged(self) -> list:
        """One row per append; compaction keeps it short."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()
        except Exception as problem:
            if "PATH_NOT_FOUND" in str(problem):
                return []
            raise

    def live(self) -> list[str]:
        """Names of the batches that make up the index."""
        log = self._logged()
        replaced = {b for r in log for b in r["replaces"]}
        return sorted({r["batch"] for r in log} - replaced)

    def _commit(self, batch: str, replaces: Sequence[str]) -> None:
        rows = self.spark.read.parquet(f"{self.path}/rows/batch={batch}").count()
        entry = self.spark.createDataFrame([(batch, list(replaces), rows)], _LOG)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame, batch: str) -> None:
        # Rows of a cell go to some files, not one: no task gets a whole cell.
        dealt = rows.repartition("cell", F.pmod(F.xxhash64(self.key), F.lit(16)))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows/batch={batch}")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add rows under a batch name; nothing happens if the log has that name already."""
        log = self._logged()
        if batch in {r["batch"] for r in log}:
            return
        held = rows.where(F.col(self.vector).isNotNull())
        cell = F.get(cluster.nearest(self.centres)(F.col(self.vector)), F.lit(0))
        self._write(held.withColumn("cell", cell), batch)
        self._commit(batch, [])

    def compact(self, batch: str) -> None:
        """Write the live batches as one. Readers that listed the old ones keep reading them."""
        old = self.live()
        if len(old) < 2 or batch in old:
            return
        self._write(self.rows().drop("batch"), batch)
        self._commit(batch, old)

    def rows(self) -> DataFrame:
        """All rows of the live batches, with ``batch`` and ``cell`` as partition columns."""
        folders = [f"{self.path}/rows/batch={b}" for b in self.live()]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)

    def search(
        self, queries: DataFrame, k: int = 3, probes: int | None = None, query_id: str = "query_id",
        vector: str = "embedding",
    ) -> DataFrame:
        """The k best rows of the ``probes`` nearest cells per query (all cells: exact), as ``retrieve.knn``.

        Only the cells that some query probes are scanned: they are a filter on the partition column.
        """
        asked = queries.where(F.col(vector).isNotNull()).select(
            F.col(query_id).alias("_qid"), retrieve.numbers(queries, vector).alias("_vec")
        )
        if (probes or len(self.centres)) >= len(self.centres):
            # Every query meets every cell: one part, where a query travels once per slice, not per cell.
            everything = self.cells(range(len(self.centres))).withColumn("_part", F.lit(0))
            return retrieve.search_cells(asked.withColumn("_part", F.lit(0)), everything, k, query_id, self.key)
        near = asked.withColumn("_part", F.explode(cluster.nearest(self.centres, probes)("_vec")))
        wanted = sorted(r["_part"] for r in near.select("_part").distinct().collect())
        return retrieve.search_cells(near, self.cells(wanted), k, query_id, self.key)

    def cells(self, wanted: Sequence[int]) -> DataFrame:
        """(_cid, _vec, _part) of some cells, read through a partition filter."""
        found = self.rows().where(F.col("cell").isin(list(wanted)))
        return found.select(
            F.col(self.key).alias("_cid"), retrieve.numbers(found, self.vector).alias("_vec"), F.col("cell").alias("_part")
        )
