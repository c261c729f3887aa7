"""Listings that arrive as a stream, taken up batch by batch exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftspark.operators.incremental import Manifest, settled_listing


def ingest_stream(listings: DataFrame, manifest: Manifest, process: Callable[[DataFrame], DataFrame], checkpoint: str, recorded: str | None = None) -> StreamingQuery:
    """Process all listings that are there and stop (``availableNow``).

    Each micro-batch is processed and committed under its batch number; a batch that is
    replayed after a failure finds its commit and changes nothing. A batch's files are laid
    over the manifest: a path is pending again only with another checksum. Rows with a null
    path or checksum count as not seen and leave the manifest as it is. If a batch has
    several checksums of a path, the one with the latest ``recorded`` holds, without that
    column the greatest.
    """

    def take(batch: DataFrame, number: int) -> None:
        if number in manifest.batches():
            return
        time = F.col(recorded) if recorded else F.lit(0)
        rest = tuple(c for c in batch.columns if c not in (manifest.path, manifest.checksum))
        settled = settled_listing(batch.withColumn("_at", time), [], manifest.path, manifest.checksum, "_at", rest)
        manifest.commit(number, settled, process(manifest.pending(settled)), whole=False)

    return listings.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
