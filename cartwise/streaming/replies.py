"""Streaming form of the resumable reply job (M1 with B1).

Reply files dropped into a folder are picked up by a file stream; each
micro-batch is parsed and appended to the price table, skipping keys that
are already stored.  ``trigger(availableNow=True)`` processes what is there
and stops, so the same code serves scheduled batch runs; the stream's
checkpoint (in the shared checkpoint folder) records which files were done,
and a restarted run continues after the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwise.operators.enrich import parse_price_replies
from cartwise.session import ensure_checkpoint_dir, materialize
from cartwise.sources import schemas
from cartwise.sources.done_store import DoneStore
from cartwise.sources.sinks import append_table


def ingest_price_replies(spark: SparkSession, reply_dir: str, members: DataFrame, out_path: str,
                         checkpoint: str | None = None, fmt: str = "json", store: DoneStore | None = None):
    """Run the reply stream until the folder is drained; returns the finished query.

    With ``store``, micro-batches are committed to it by their number instead
    of being appended to ``out_path``: a replayed one stores nothing, and only
    the buckets of its products are read.
    """
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark)}/cartwise-streams/price-replies"
    stream = spark.readStream.schema(schemas.REPLIES).format(fmt).load(reply_dir)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        parsed = parse_price_replies(batch.where("kind = 'price'").select("batch_id", "reply"), members)
        parsed = parsed.where("price is not null")
        if store is not None:
            store.append(f"replies-{epoch_id}", materialize(parsed, "replies"))
        else:
            append_table(parsed, out_path, key="product_id")

    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
