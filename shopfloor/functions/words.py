"""Whole amounts in English words, as a native Spark expression.

Convention (British English, short scale): ``0`` → ``zero``; hyphenated tens
(``twenty-one``); ``and`` after hundreds (``one hundred and one``); scale
groups joined by ``, `` (``six thousand, two hundred and fifty-one``), except
that a final group below one hundred is joined by `` and ``
(``one thousand and one``); negative amounts get ``minus``; the fraction is
truncated toward zero; NULL stays NULL.

The integer is written as a zero-padded digit string and cut into 3-digit
groups; one ``transform`` over the groups spells each of them from the two short
word lists. Everything is a built-in expression: no Python worker, no per-row
pickling, and a few kilobytes of plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words and short-scale group names.
UNITS = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
         "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion"]

_DIGITS = 3 * len(SCALES)  # 21 digits cover every BIGINT


def spell_below_thousand(g: int) -> str:
    """Words for 0..999 ('' for 0), by rule from UNITS/TENS."""
    h, r = divmod(g, 100)
    parts = []
    if h:
        parts.append(f"{UNITS[h]} hundred")
    if 0 < r < 20:
        parts.append(UNITS[r])
    elif r >= 20:
        parts.append(TENS[r // 10] + (f"-{UNITS[r % 10]}" if r % 10 else ""))
    return " and ".join(parts)


BELOW_THOUSAND = [spell_below_thousand(g) for g in range(1000)]


def spell_integer(n: int | None) -> str | None:
    """Reference spelling in plain Python (used by tests as the brute-force check)."""
    if n is None:
        return None
    if n == 0:
        return "zero"
    sign, a = ("minus ", -n) if n < 0 else ("", n)
    groups = []
    i = 0
    while a:
        a, g = divmod(a, 1000)
        groups.append((i, g))
        i += 1
    high = [f"{BELOW_THOUSAND[g]} {SCALES[i]}" for i, g in reversed(groups) if g and i > 0]
    g0 = groups[0][1]
    if g0 and high and g0 < 100:
        return sign + ", ".join(high) + " and " + BELOW_THOUSAND[g0]
    return sign + ", ".join(high + ([BELOW_THOUSAND[g0]] if g0 else []))


def _pick(words: list[str], at: Column) -> Column:
    return F.element_at(F.split(F.lit("|".join(words)), "[|]"), at + 1)


def _below_thousand(g: Column) -> Column:
    """Words for 0..999 ('' for 0)."""
    rest = g % 100
    tens = F.concat_ws("-", _pick(TENS, F.floor(rest / 10).cast("int")), F.when(rest % 10 > 0, _pick(UNITS, rest % 10)))
    small = F.when((rest > 0) & (rest < 20), _pick(UNITS, rest)).when(rest >= 20, tens)
    return F.concat_ws(" and ", F.when(g >= 100, F.concat(_pick(UNITS, F.floor(g / 100).cast("int")), F.lit(" hundred"))), small)


def amount_in_words(amount: Column | str) -> Column:
    """English words for the integer part of ``amount`` (a column or its name)."""
    n = (F.col(amount) if isinstance(amount, str) else amount).cast("bigint")  # truncates toward zero
    last = len(SCALES) - 1
    digits = F.lpad(F.regexp_replace(n.cast("string"), "^-", ""), _DIGITS, "0")
    groups = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.substr(digits, i * 3 + 1, F.lit(3)).cast("int"))
    spelled = F.transform(groups, _below_thousand)  # highest group first; bound once below

    def joined(words: Column) -> Column:
        high = F.concat_ws(", ", *(F.when(words[k] != "", F.concat(words[k], F.lit(" " + SCALES[last - k]))) for k in range(last)))
        below_hundred = ~F.contains(words[last], F.lit("hundred"))
        return F.when(words[last] == "", high).when(high == "", words[last]) \
            .otherwise(F.concat(high, F.when(below_hundred, " and ").otherwise(", "), words[last]))

    body = F.transform(F.array(spelled), joined)[0]
    return F.when(n == 0, F.lit("zero")).when(n < 0, F.concat(F.lit("minus "), body)).when(n > 0, body)
