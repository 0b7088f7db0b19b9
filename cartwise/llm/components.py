"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, label): label is the smallest id reachable from id.

    Minimum labels flow over the links, each round hooks the label's own node
    to the smallest label seen by any of its members and then jumps one
    pointer, so long chains shrink by more than half a round.  Every round is
    written to the checkpoint folder; the driver only sees a count.  A node
    with very many links is combined map-side by the ``min`` aggregates; the
    joins back are equi-joins that adaptive execution can split.
    Null ids and self links are ignored; an empty table gives an empty result.
    """
    both = links.where("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        near = labels.join(seen, "id").select("id", "label", F.least("label", "seen").alias("near"))
        hook = near.groupBy(F.col("label").alias("id")).agg(F.min("near").alias("hook"))
        new = near.join(hook, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("label")
        )
        new = materialize(new, "labels")
        up = new.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = materialize(
            new.join(up, "label").select("id", "old", F.least("label", "up").alias("label")), "labels"
        )
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").limit(1).count() == 0:
            return labels
