"""Chinese numerals as column expressions; the four readers differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "零一二三四五六七八九"
# Characters that stand for a digit besides the plain ones.
ALSO = {"〇": 0, "○": 0, "两": 2}


def digit(c: Column) -> Column:
    """0 to 9 for a single numeral character, else NULL."""
    place = F.instr(F.lit(DIGITS), c)
    out = F.when((F.length(c) == 1) & (place > 0), place - 1)
    for char, value in ALSO.items():
        out = F.when(c == char, value).otherwise(out)
    return out


def chinese_integer(n: Column) -> Column:
    """0..9999 in Chinese; NULL outside. A zero stands for each run of skipped places, and ten is 十, not 一十."""
    d = [F.floor(n / 10**k).cast("int") % 10 for k in (3, 2, 1, 0)]
    name = lambda x: F.substring(F.lit(DIGITS), x + 1, F.lit(1))
    out = F.lit("")
    for i, unit in enumerate("千百十"):
        any_before = F.lit(False) if i == 0 else n >= 10 ** (4 - i)
        gap = any_before & (d[i - 1] == 0) if i else F.lit(False)
        own = F.when((F.lit(unit == "十")) & (d[i] == 1) & ~any_before, F.lit(unit)).otherwise(F.concat(name(d[i]), F.lit(unit)))
        out = F.concat(out, F.when(d[i] > 0, F.concat(F.when(gap, DIGITS[0]).otherwise(""), own)).otherwise(""))
    last = F.when(d[3] > 0, F.concat(F.when((n >= 100) & (d[2] == 0), DIGITS[0]).otherwise(""), name(d[3]))).otherwise("")
    whole = F.when(n < 10, name(n.cast("int"))).otherwise(F.concat(out, last))
    return F.when((n >= 0) & (n <= 9999), whole)


def _units(text: Column, units: dict[str, int]) -> Column:
    """Fold over characters: a digit is remembered, a unit adds (digit or 1) times its value; NULL on other characters or without a unit."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(False).alias("unit"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        value = F.lit(None).cast("int")
        for u, v in units.items():
            value = F.when(c == u, v).otherwise(value)
        d = digit(c)
        return F.struct(
            F.when(value.isNotNull(), a["total"] + F.when(a["now"] == 0, 1).otherwise(a["now"]) * value).otherwise(a["total"]).alias("total"),
            F.when(d.isNotNull(), d).when(value.isNotNull(), 0).otherwise(a["now"]).alias("now"),
            (a["unit"] | value.isNotNull()).alias("unit"),
            (a["ok"] & (d.isNotNull() | value.isNotNull())).alias("ok"),
        )

    end = F.aggregate(chars, zero, step)
    return F.when(end["ok"] & end["unit"], end["total"] + end["now"])


def date_number(text: Column) -> Column:
    """Variant for dates and attachments: digits, one numeral, or numerals with 十百千; anything else NULL."""
    t = F.trim(text)
    units = _units(t, {"十": 10, "百": 100, "千": 1000})
    return F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int")).when(F.length(t) == 1, F.coalesce(digit(t), units)).otherwise(units)


def token_number(text: Column) -> Column:
    """Variant for heading tokens: with 十 only the characters right beside it count, so 一百二十 reads 10."""
    place = F.instr(text, "十")
    left, right = F.substring_index(text, "十", 1), F.substring(text, place + 1, F.length(text))
    tens = F.when(left == "", 1).otherwise(F.coalesce(digit(left), F.lit(1)))
    ones = F.when(right == "", 0).otherwise(F.coalesce(digit(right), F.lit(0)))
    total = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("t"), F.lit(0).alias("n"), F.lit(True).alias("ok")),
        lambda a, c: F.struct(
            F.when(_unit(c).isNotNull(), a["t"] + F.when(a["n"] == 0, 1).otherwise(a["n"]) * _unit(c)).otherwise(a["t"]).alias("t"),
            F.when(digit(c).isNotNull(), digit(c)).when(_unit(c).isNotNull(), 0).otherwise(a["n"]).alias("n"),
            (a["ok"] & (digit(c).isNotNull() | _unit(c).isNotNull())).alias("ok"),
        ),
    )
    return F.when(F.length(text) == 1, F.when(text == "十", 10).otherwise(digit(text))).when(place > 0, tens * 10 + ones).otherwise(F.when(total["ok"] & (total["t"] > 0), total["t"] + total["n"]))


def _unit(c: Column) -> Column:
    return F.when(c == "百", 100).when(c == "千", 1000).when(c == "万", 10000)


def _around_ten(text: Column) -> Column:
    """NULL without 十; a missing or unknown left side is 1, a missing or unknown right side 0."""
    at = F.instr(text, "十")
    left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    return F.when(at > 0, F.coalesce(digit(left), F.lit(1)) * 10 + F.coalesce(digit(right), F.lit(0)))


def ordinal_number(text: Column) -> Column:
    """Variant for context ordinals: numerals are decimal places (一二 is 12), 十 multiplies; 百 is unknown and so is zero."""
    chars = F.filter(F.split(F.trim(text), ""), lambda c: c != "")
    known = F.forall(chars, lambda c: digit(c).isNotNull())
    place = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: a * 10 + digit(c))
    value = F.coalesce(_around_ten(F.trim(text)).cast("bigint"), F.when(known, place))
    return F.when(value != 0, value)


def attachment_number(text: Column, fallback: Column) -> Column:
    """Variant for attachment ordinals: digits, one numeral, or a form with 十; else the fallback."""
    return F.coalesce(F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int")), _around_ten(text), F.when(F.length(text) == 1, digit(text)), fallback)
