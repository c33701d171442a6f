"""Column-level helpers (built-in Spark expressions only).

dates  dd-MMM-yy parsing, day parity, signed day differences
money  exact DECIMAL sums returned as DOUBLE
words  whole amounts in English words (and the same spelling as SQL text)
"""
