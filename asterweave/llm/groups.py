"""Records linked pairwise, consolidated into groups.

Groups of records within a tolerance of each other, and of records that matched,
take the smallest identifier of all that are linked directly or through others:
minimum labels are propagated with pointer jumping, each round written to shared
storage. The search for neighbours is the core's, which merging uses too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterweave.operators.components import component_labels
from asterweave.operators.groups import tolerance_groups

__all__ = ["matched_groups", "tolerance_groups"]


def matched_groups(pairs: DataFrame, a: str = "row_id_a", b: str = "row_id_b", key: str = "row_id") -> DataFrame:
    """(key, group_id) of every record in a pair: the smallest record linked to it by pairs, directly or through others.

    Pairs may be repeated, and given in either order; one with a null end, or of
    a record with itself, links nothing. Records without a pair are in no group.
    Other columns are ignored; no pairs give no groups.
    """
    labels = component_labels(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")))
    return labels.select(F.col("node").alias(key), F.col("label").alias("group_id"))
