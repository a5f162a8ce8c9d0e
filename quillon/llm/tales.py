"""Rows of the ``tales`` table, and one row of each tale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.checkpoints import checkpointed

#: Above this number of repeated rows their list (8 bytes each) is joined by a shuffle and not broadcast.
BROADCAST_ROWS = 2_000_000


def one_row_per_tale(tales: DataFrame, *columns: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``tale_id`` and ``columns`` of the row with the least ``doc_seq`` of each tale.

    Only the keys are shuffled, to list the rows to leave out; the texts stay where they are
    read.  The list is broadcast if it has at most ``broadcast_rows`` rows.  Rows without
    ``tale_id`` or ``doc_seq`` belong to no tale and are left out.
    """
    keys = tales.select("doc_seq", "tale_id").where("doc_seq IS NOT NULL AND tale_id IS NOT NULL")
    first = keys.groupBy("tale_id").agg(F.min("doc_seq").alias("doc_seq")).select("doc_seq")
    later = checkpointed(keys.select("doc_seq").join(first.hint("shuffle_hash"), "doc_seq", "left_anti"))
    rows = tales.where("doc_seq IS NOT NULL AND tale_id IS NOT NULL").select(*dict.fromkeys(["doc_seq", "tale_id", *columns]))
    if later.count() <= broadcast_rows:
        later = F.broadcast(later)
    return rows.join(later, "doc_seq", "left_anti").select(*dict.fromkeys(["tale_id", *columns]))
