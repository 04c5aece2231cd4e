"""English spellings of numbers as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import ONES, TENS
from .text import as_column

_BELOW_HUNDRED = ONES + [tens + (f"-{ONES[k]}" if k else "") for tens in TENS for k in range(10)]


def _small(n: Column) -> Column:
    """Words of 1 to 999; null for 0, so that it drops out of a longer number."""
    word = lambda k: F.get(F.array(*map(F.lit, _BELOW_HUNDRED)), k.cast("int"))
    hundreds = F.when(n >= 100, F.concat(word((n - n % 100) / 100), F.lit(" hundred")))
    return F.when(n > 0, F.concat_ws(" ", hundreds, F.when(n % 100 > 0, word(n % 100))))


def words(number: Column | str) -> Column:
    """Words of a whole number from 0 to under 10^12, null beyond; millions are the largest unit, and there may be thousands of them."""
    n = as_column(number).cast("long")
    group = lambda power: ((n - n % 10**power) / 10**power).cast("long") % 1000
    unit = lambda part, name: F.when(part.isNotNull(), F.concat(part, F.lit(f" {name}")))
    millions = F.nullif(F.concat_ws(" ", unit(_small(group(9)), "thousand"), _small(group(6))), F.lit(""))
    text = F.concat_ws(" ", unit(millions, "million"), unit(_small(group(3)), "thousand"), _small(group(0)))
    return F.when(n == 0, ONES[0]).when((n > 0) & (n < 10**12), text)


def decimal_words(number: Column | str) -> Column:
    """Words of a decimal number from 0 on: the whole part, then digit by digit, without zeros at the end."""
    text = as_column(number).cast("string")
    tail = F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))
    digits = F.transform(F.split(tail, ""), lambda d: F.get(F.array(*map(F.lit, ONES)), d.cast("int")))
    part = F.when(F.contains(text, F.lit(".")) & (tail != ""), F.concat(F.lit(" point "), F.array_join(digits, " "))).otherwise("")
    return F.concat(words(F.substring_index(text, ".", 1)), part)


def ordinal(number: Column | str) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th don't go by their last digit."""
    n = as_column(number).cast("long")
    ending = F.when((n % 100).between(11, 13), "th").otherwise(F.coalesce(F.get(F.array(*(F.lit(x) for x in ("th", "st", "nd", "rd"))), (n % 10).cast("int")), F.lit("th")))
    return F.concat(n.cast("string"), ending)
