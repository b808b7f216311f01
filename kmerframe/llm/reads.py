"""The reads as the operators of this package take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import fanned


def once(reads: DataFrame, key: str = "seq_id", text: str = "sequence") -> DataFrame:
    """One row (key, text) for each key whose text is not null.

    Repeated rows count once; if a key has several texts the smallest is taken, so that the result
    does not depend on the order of rows. Rows without a key are left out. The minimum is combined
    before the shuffle, so a key that is repeated very often costs one row per task.
    """
    rows = reads.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.min(text).alias(text))
    return fanned(rows, reads, key)
