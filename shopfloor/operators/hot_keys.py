"""Joins that spread every key of the big side, so a hot key needs no look before.

A sort-merge join sends every row of a key to one task; when one key holds a third of the big
side, that task does a third of the work. AQE can split such a partition only for a join whose
two sides come straight from a shuffle, which a side that was just grouped by the key does not.

``salted_join`` joins on (key, salt): the salt of a big row is a hash of its other columns, each small row is
there once for every salt. Both sides are read once and shuffled once, no key is counted first;
a key is spread over ``salts`` partitions from the start, and since both sides now come straight
from a shuffle, AQE splits what is still too large. The price is the small side times ``salts``, so
it should be an aggregate or a dimension. Where that side is small enough to be broadcast, Spark
drops the shuffles and the salt costs nothing but its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8


def checked_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing the query when a key occurs twice (keys that are NULL join nothing and may repeat)."""
    n = F.count("*").over(Window.partitionBy(key))
    message = F.concat(F.lit(f"more than one row for {key} "), F.col(key).cast("string"))
    wrong = F.raise_error(message).cast(df.schema[key].dataType)
    return df.withColumn("_n", n).withColumn(key, F.when(F.col(key).isNull() | (F.col("_n") == 1), F.col(key)).otherwise(wrong)).drop("_n")


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = SALTS, unique: bool = True) -> DataFrame:
    """``big.join(small, key, how)`` for ``how`` of inner, left, left_semi or left_anti; columns as of that join.

    ``unique`` states that ``small`` has one row a key, which is checked; a semi or anti join needs no such promise.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    if unique and how in ("inner", "left"):
        small = checked_unique(small, key)
    spread = [F.col(c) for c in big.columns if c != key and big.schema[c].dataType.typeName() not in ("map", "variant")]
    number = F.xxhash64(*spread) if spread else F.monotonically_increasing_id()
    # Never NULL, so the join puts no filter below and a plan that both sides share stays the same.
    salted = big.withColumn("_salt", F.coalesce(F.pmod(number, F.lit(salts)).cast("int"), F.lit(0)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
