"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouping by vertex (a minimum, combined before the shuffle) and a join back;
no neighbourhood is ever collected. The number of steps is logarithmic in the longest path.

Defined cases: repeated edges and loops change nothing (a node that has only a loop is not returned); edges with a NULL
end are dropped; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import drop_folder, new_folder


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``u``, ``v``, both long): root is the smallest node reachable."""
    spark = edges.sparkSession

    def settle(df: DataFrame) -> tuple[DataFrame, tuple, str]:
        path = new_folder(spark, "edges")
        df.write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return out, tuple(mark), path

    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now, mark, path = settle(edges.where("u <> v").select(high, low).distinct())
    for _ in range(most_steps):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, new_mark, new_path = settle(small)
        drop_folder(spark, path)
        now, path, done, mark = after, new_path, new_mark == mark, new_mark
        if done:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_steps} steps")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
