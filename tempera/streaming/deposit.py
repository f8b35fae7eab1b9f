"""Continuous deposits: new sample files are binned by energy and appended to the store."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tempera.operators.binning import assign_bins
from tempera.operators.store import SampleStore


def writer_name(checkpoint: str) -> str:
    return sha256(checkpoint.encode()).hexdigest()[:16]


def stream_deposits(samples: DataFrame, bounds: DataFrame, store: SampleStore, checkpoint: str) -> StreamingQuery:
    """``samples`` is a streaming frame (level, id, data, weight); runs over what is available.

    An epoch that breaks off before its commit, or is delivered again after it, counts once: the checkpoint
    names the writer, and the store's ledger the attempt that counts.
    """
    writer = writer_name(checkpoint)

    def append(batch: DataFrame, epoch: int) -> None:
        store.deposit_once(assign_bins(batch, bounds), writer, epoch)

    return (
        samples.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
