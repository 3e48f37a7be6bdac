"""Exact ranks by range-partitioned sorting with partition offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import materialize, with_package


def exact_ranks(df: DataFrame, groups: list[str], value: str, counted: str | None = None) -> DataFrame:
    """Distinct ``(groups, value)`` with exact positions of each value in its group.

    Result: groups, value, ``n`` (rows with the value), ``below`` (rows of the group
    with a smaller value) and ``total`` (rows of the group). Ties share one row; null
    values and null groups are left out; an empty input gives no rows. With ``counted``
    (a boolean column) only rows where it holds are counted: every value keeps its row
    and gets its place among the counted ones.

    Rows are first counted per distinct value (map-side), then range-partitioned and
    sorted by (groups, value). Each partition adds up its own running counts and
    reports one total per group; the totals of earlier partitions are the offsets. A
    hot group is thus spread over as many partitions as it needs, and nothing larger
    than partitions x groups is ever brought together.
    """
    keys = [*groups, value]
    counts = df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0).groupBy(*keys).agg((F.count(F.lit(1)) if counted is None else F.count_if(counted)).alias("n"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields)

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: dict[tuple, int] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            before = pdf.groupby(groups, sort=False)["n"].cumsum() - pdf["n"]
            ids = list(map(tuple, pdf[groups].to_numpy()))
            pdf = pdf.assign(part_below=before.to_numpy() + np.array([carried.get(k, 0) for k in ids], dtype="int64"))
            for k, n in pdf.groupby(groups, sort=False)["n"].sum().items():
                k = k if isinstance(k, tuple) else (k,)
                carried[k] = carried.get(k, 0) + int(n)
            yield pdf

    with_package(df.sparkSession)
    by = [F.col(k) for k in keys]
    local = (
        counts.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("part", F.spark_partition_id())
        .mapInPandas(running, f"{fields}, part int, part_below long")
    )
    # Range bounds are sampled anew whenever the plan runs again, so the partitions are fixed by writing them.
    local = materialize(local, "ranks")
    totals = local.groupBy(*groups, "part").agg(F.sum("n").alias("part_n"))
    # One row per partition and group; running sums over the partitions of a group give the offsets.
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("offset"), F.sum("part_n").over(whole).alias("total"))
    return local.join(offsets, [*groups, "part"]).select(*keys, "n", (F.col("part_below") + F.col("offset")).alias("below"), "total")
