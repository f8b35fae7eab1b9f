"""The sample store: Parquet partitioned by level and bin.

Rows of a plain deposit count at once. Rows of a deposit that may be tried again carry its name and count only if the
ledger names that attempt: one small file per writer and epoch, created after all rows are in place and never
replaced. Rows of an attempt that died before that stay unseen and go with the next compaction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tempera.functions.counter_rng import with_uniforms
from tempera.operators.binning import assign_bins
from tempera.operators.ranking import global_rank
from tempera.plans.staging import create_file, delete_path, materialize, path_exists, staging_root
from tempera.schema import STORED

FILE, ROW = "_file", "_row"
WRITTEN = StructType([*STORED, StructField("deposit", StringType())])


class SampleStore:
    """Files are sized in bytes by the rebalancing target of the session, or hold ``capacity`` samples if that is given."""

    def __init__(self, spark: SparkSession, path: str, capacity: int | None = None):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity

    @classmethod
    def in_shared_folder(cls, spark: SparkSession, run_id: str, capacity: int | None = None) -> SampleStore:
        """A store among the staged tables, so it goes with them when they are released."""
        return cls(spark, f"{staging_root(spark)}/tempera/{spark.sparkContext.applicationId}/store-{run_id}", capacity)

    def _write(self, df: DataFrame, mode: str, placed: bool = False, deposit: str | None = None) -> None:
        # Rebalancing gathers each bin into few files yet splits a bin that is too large for one task.
        rows = df.select("id", "data", "weight", "level", "bin", F.lit(deposit).cast("string").alias("deposit"))
        rows = rows if placed else rows.hint("rebalance", "level", "bin")
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("level", "bin")
        if self.capacity:
            writer = writer.option("maxRecordsPerFile", self.capacity)
        writer.parquet(self.path)

    def deposit(self, samples: DataFrame) -> None:
        """Append samples that already carry (level, bin)."""
        self._write(samples, "append")

    def deposit_by_energy(self, samples: DataFrame, bounds: DataFrame) -> None:
        self.deposit(assign_bins(samples, bounds))

    def deposit_in_order(self, samples: DataFrame, *order: str) -> None:
        """Append samples so that those of a bin lie in ``order``, by file name and row; ``order`` ends in a unique key."""
        self._write(samples.orderBy("level", "bin", *order), "append", placed=True)

    def _ledger_entry(self, writer: str, epoch: int) -> str:
        return f"{self.path}.ledger/{writer}/{int(epoch)}"

    def is_committed(self, writer: str, epoch: int) -> bool:
        return path_exists(self.spark, self._ledger_entry(writer, epoch))

    def write_attempt(self, samples: DataFrame, writer: str, epoch: int) -> str:
        """Write one attempt at an epoch; its samples stay unseen until it is committed."""
        attempt = f"{writer}/{int(epoch)}/{uuid.uuid4().hex}"
        self._write(samples, "append", deposit=attempt)
        return attempt

    def commit_attempt(self, writer: str, epoch: int, attempt: str) -> bool:
        """Make an attempt count, unless another one at the same epoch does already."""
        return create_file(self.spark, self._ledger_entry(writer, epoch), attempt)

    def deposit_once(self, samples: DataFrame, writer: str, epoch: int) -> None:
        """Append the samples of a writer's epoch exactly once, however often and wherever the epoch is delivered or breaks off."""
        if not self.is_committed(writer, epoch):
            self.commit_attempt(writer, epoch, self.write_attempt(samples, writer, epoch))

    def _seen(self, *placed: str) -> DataFrame:
        """Samples that count; ``placed`` may ask for FILE and ROW, the place of each."""
        where = {FILE: F.col("_metadata.file_path").alias(FILE), ROW: F.col("_metadata.row_index").alias(ROW)}
        rows = self.spark.read.schema(WRITTEN).parquet(self.path)
        rows = rows.select("*", *[where[p] for p in placed])
        if not path_exists(self.spark, f"{self.path}.ledger"):
            return rows.where("deposit IS NULL").drop("deposit")
        ledger = self.spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(f"{self.path}.ledger")
        counted = ledger.select(F.col("value").alias("_counted"))
        return rows.join(counted, F.col("deposit") == F.col("_counted"), "left").where("deposit IS NULL OR _counted IS NOT NULL").drop("deposit", "_counted")

    def scan(self, level: int | None = None, bin: int | None = None) -> DataFrame:
        """All samples, of one level, or of one bin; the filters prune partitions."""
        df = self._seen()
        if level is not None:
            df = df.where(F.col("level") == level)
        return df if bin is None else df.where(F.col("bin") == bin)

    def draw_pool(self, capacity: int, seed: int) -> DataFrame:
        """``capacity`` uniform picks with replacement from every (level, bin): pick and the samples.

        A pick is a row number of its bin, counted through the bin's files in order of their names. One scan, of no column
        but the deposit, counts rows per file; sums of these counts turn every pick into a file and a row in it; the second scan reads
        the samples that stand there. Nothing is sorted or ranked, and what the second scan is joined with are bins x capacity places.
        """
        order = Window.partitionBy("level", "bin").orderBy(FILE)
        whole = Window.partitionBy("level", "bin")
        files = self._seen(FILE).groupBy("level", "bin", FILE).agg(F.count(F.lit(1)).alias("_size"))
        files = files.withColumns({
            "_end": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_size").over(whole),
        })
        files = materialize(files, "pool-files")
        sizes = files.groupBy("level", "bin").agg(F.max("_n").alias("_n"))
        picks = sizes.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(capacity - 1))))
        key = F.shiftleft(F.col("level").cast("long"), 32).bitwiseOR(F.col("bin").cast("long"))
        picks = with_uniforms(picks, key, {"_u": F.col("pick")}, seed)
        picks = picks.select("level", "bin", "pick", F.floor(F.col("_u") * F.col("_n")).alias("_at"))
        begin = F.col("_end") - F.col("_size")
        held = picks.join(files, ["level", "bin"]).where((F.col("_at") >= begin) & (F.col("_at") < F.col("_end")))
        places = materialize(held.select("pick", F.col(FILE).alias("_in"), (F.col("_at") - begin).alias("_nth")), "pool-places")
        rows = self._seen(FILE, ROW)
        return rows.join(places, (F.col(FILE) == F.col("_in")) & (F.col(ROW) == F.col("_nth"))).select("pick", *STORED.names)

    def counts(self) -> DataFrame:
        return self.scan().groupBy("level", "bin").agg(F.count(F.lit(1)).alias("n"))

    def number_of_bins(self, level: int) -> int:
        return self.scan(level).select("bin").distinct().count()

    def is_empty(self, level: int) -> bool:
        return self.scan(level).isEmpty()

    def files(self) -> DataFrame:
        """Records per data file, and whether the file is filled to capacity."""
        per_file = self._seen(FILE).select("level", "bin", F.col(FILE).alias("file"))
        return per_file.groupBy("level", "bin", "file").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "full", F.col("n") >= self.capacity if self.capacity else F.lit(False)
        )

    def compact(self, level: int) -> None:
        """Rewrite a level into few files: of ``capacity`` samples if that is given, by bytes otherwise.

        With a capacity, samples are cut into slices of exactly ``capacity`` by their rank inside
        the bin, so a bin holding most of the level is still rewritten by many
        tasks and leaves one partial file at most.
        """
        if not self.capacity:
            self._write(materialize(self.scan(level), "store-compact"), "overwrite")
            return
        ranked = global_rank(self.scan(level).select("level", "bin", "id", "data", "weight"), ["bin"], ["id"])
        sliced = ranked.withColumn("_slice", F.floor(F.col("rn") / self.capacity))
        # Ranks come from a written copy, so the files being replaced are no longer read.
        self._write(sliced.repartition("bin", "_slice"), "overwrite", placed=True)

    def rebin(self, level: int, bounds_df: DataFrame) -> None:
        """Move a level's samples into the bins of new bounds."""
        staged = materialize(assign_bins(self.scan(level).drop("bin"), bounds_df), "store-rebin")
        before = {r["bin"] for r in self.scan(level).select("bin").distinct().collect()}
        after = {r["bin"] for r in staged.select("bin").distinct().collect()}
        # New bins take the place of old ones first; a bin that no longer exists goes once all samples are in place.
        self._write(staged, "overwrite")
        for gone in sorted(before - after):
            delete_path(self.spark, f"{self.path}/level={int(level)}/bin={int(gone)}")

    def drop_level(self, level: int) -> None:
        """Delete a level's samples."""
        delete_path(self.spark, f"{self.path}/level={int(level)}")

    def save_table(self, name: str, df: DataFrame) -> None:
        """A small table of the run (bounds, proposal blocks) kept beside the samples."""
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}.tables/{name}")

    def load_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}.tables/{name}")
