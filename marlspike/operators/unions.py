"""Unions of branches that may be partitioned alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def stacked(*parts: DataFrame) -> DataFrame:
    """All rows of ``parts``, by name.

    Spark 4.1 joins the partitions of branches that are hash-partitioned alike one by one, and fails where adaptive execution
    has since changed the number of one branch's; so that shortcut is switched off for the session.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, parts)
