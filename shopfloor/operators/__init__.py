"""Reusable DataFrame operators, each written so a key holding a third of all rows stays safe.

membership    present / absent (semi and anti joins against distinct keys)
extremes      rows at the max / min (scalar subquery, ties kept), bounded top-k and n-th of a small n
keep_first    one row per key, the first by a total order (leading value by hash aggregate, then the ties)
positions     global positions, running totals and the n-th row without a single-task window over rows
ranking       grades from dense-rank cut-offs, rank / dense rank over distinct values
cooccurrence  pairs of members sharing a group, in factorised (linear) form
many_to_many  one side of a many-to-many join summarised per key instead of expanded
hot_keys      joins that spread every key over several tasks, for an aggregate or dimension on the other side
"""
