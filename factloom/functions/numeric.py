"""Numeric expressions: cell parsing, features, buckets, probabilities, id sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import bind, strip

N_BUCKETS = 2048


def key6(x: Column) -> Column:
    """The comparison key of a number: six decimals."""
    return F.round(x, 6)


_DIGITS = r"\d++(?:_\d++)*+"
#: A number cell; group 1 is the number without the white space around it. Possessive, so that no text is gone over twice.
NUMBER_CELL = rf"(?i)^\s*+([+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?+)?+|\.{_DIGITS})(?:e[+-]?{_DIGITS})?+|infinity|inf|nan))\s*+$"


def parse_cell(raw: Column) -> Column:
    """A struct (kind, num, is_int, str) of a raw string: null, then integer, then float, then text.

    Digits may be grouped by underscores. An integer beyond 64 bits keeps its digits in ``str``.
    """
    # Stands in what is computed of every row, so the pattern is matched once a row.
    found = F.regexp_extract(raw, NUMBER_CELL, 1)
    none = raw.isNull() | raw.isin("N/A", "")
    plain = F.replace(found, F.lit("_"), F.lit(""))
    real = found != ""
    whole = real
    for other in ".eEnN":  # of 1.5, 1e5, inf and nan
        whole = whole & ~found.contains(other)
    # Compared as digits, since a cast that fails takes as long as a hundred that don't.
    digits, negative = F.ltrim(plain, F.lit("+-0")), plain.startswith("-")
    most = F.when(negative, str(2**63)).otherwise(str(2**63 - 1))
    beyond = (F.length(digits) > 19) | ((F.length(digits) == 19) & (digits > most))
    return F.struct(
        F.when(real, 1).when(none, 0).otherwise(2).alias("kind"),
        F.when(real, plain.try_cast("double")).alias("num"),
        F.coalesce(whole, F.lit(False)).alias("is_int"),
        F.when(~real & ~none, raw).when(whole & (F.length(found) > 18) & beyond, F.concat(F.when(negative, "-").otherwise(""), digits)).alias("str"),
    )


def _with_power(raw: Column) -> Column:
    """What ``real_text`` makes of a float below 0.001 or from 10^16, as the engine writes it."""

    def shown(parts: Column) -> Column:
        sign, digits, exponent = F.when(raw.startswith("-"), "-").otherwise(""), F.translate(parts[0], "-.", ""), parts[1].try_cast("int")
        small = F.concat(sign, F.lit("0.000"), digits)
        power = F.abs(exponent).cast("string")
        power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
        fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        scientific = F.concat(sign, F.substr(digits, F.lit(1), F.lit(1)), fraction, F.when(exponent < 0, "e-").otherwise("e+"), power)
        return F.when(exponent == -4, small).otherwise(scientific)

    return bind(F.split(F.replace(raw, F.lit(".0E"), F.lit("E")), "E"), shown)


def real_text(num: Column) -> Column:
    """A float as written: without an exponent from 0.0001 up to 10^16, else with one of two digits or more."""
    size = F.abs(num)
    # The engine writes these without an exponent, larger ones with one; a decimal of 12 places holds all digits of those below 10^16.
    plain = (size >= 0.001) & (size < 1e7) | (num == 0)
    large = F.when(num == F.floor(num), F.concat(num.cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.rtrim(num.cast("decimal(28,12)").cast("string"), F.lit("0")))
    special = F.when(F.isnan(num), "nan").when(num == float("inf"), "inf").when(num == float("-inf"), "-inf")
    return F.when(plain, num.cast("string")).when((size >= 1e7) & (size < 1e16), large).when(num.isNotNull(), F.coalesce(special, bind(num.cast("string"), _with_power)))


def number_text(num: Column, is_int: Column, digits: Column | None = None) -> Column:
    """A number as written: integers without a point. digits: of an integer beyond 64 bits."""
    whole = num.cast("bigint").cast("string")
    return F.when(is_int, whole if digits is None else F.coalesce(digits, whole)).otherwise(real_text(num))


def numeric_features(v: Column, mean: Column, std: Column) -> Column:
    """[z clamped to ±10 (0 without spread), log1p of the magnitude, sign, is a whole number]."""
    z = F.when(std > 0, F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (v - mean) / std))).otherwise(F.lit(0.0))
    return F.array(z, F.log1p(F.abs(v)), F.signum(v), (v == F.floor(v)).cast("double"))


def string_bucket(s: Column) -> Column:
    """A stable bucket of a string: 32 bits of its MD5, modulo the number of buckets."""
    digest = F.md5(F.lower(strip(s)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % N_BUCKETS).cast("int")


def seq_logprob(logprobs: Column, ids: Column, eos: Column) -> Column:
    """Mean of the log probabilities up to and with the first end token; null if there is none at all."""
    at = F.array_position(ids, eos).cast("int")
    used = F.when(at > 0, F.slice(logprobs, F.lit(1), at)).otherwise(logprobs)
    return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(used))


def find_subsequence(ids: Column, part: Column) -> Column:
    """0-based place of the first occurrence of ``part`` in ``ids``, or -1."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - F.size(part), F.lit(0))), lambda i: F.slice(ids, i + 1, F.size(part)) == part)
    return F.coalesce(F.get(starts, F.lit(0)), F.lit(-1))


def split_ids(ids: Column, part: Column) -> Column:
    """A struct (before, after) around the first occurrence of ``part``; fails where there is none."""
    at = find_subsequence(ids, part)
    found = F.when(at >= 0, at).otherwise(F.raise_error(F.lit("the placeholder does not occur in the prompt")).cast("int"))
    rest = F.size(ids) - found - F.size(part)
    return F.struct(F.slice(ids, F.lit(1), found).alias("before"), F.slice(ids, found + F.size(part) + 1, rest).alias("after"))


def fixed(x: Column, digits: int) -> Column:
    """``digits`` decimals of a float below 2^52 / 10^digits, rounded as its exact binary value has it, ties to even.

    The product with 10^digits is taken in two exact parts: those of the float's upper and lower bits.
    """
    scale = float(10**digits)
    v = F.abs(x)

    def rounded(parts: Column) -> Column:
        high, low = parts["high"] * scale, parts["low"] * scale
        guess = F.floor(high + low)
        rest = (high - guess) + low
        whole = F.when(rest < 0, guess - 1).when(rest >= 1, guess + 1).otherwise(guess)
        # Taken from the half before the lower bits come in, so that these aren't lost.
        beyond = ((high - whole) - 0.5) + low
        return (whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)).cast("bigint")

    def shown(n: Column) -> Column:
        places = F.lpad((n % int(scale)).cast("string"), digits, "0")
        sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
        return F.concat(sign, F.floor(n / int(scale)).cast("string"), F.lit("."), places)

    upper = v * 134217729.0 - (v * 134217729.0 - v)
    return bind(F.struct(upper.alias("high"), (v - upper).alias("low")), lambda p: bind(rounded(p), shown))


def percent(x: Column) -> Column:
    """A rate as percent with one decimal; a dash for null or no number."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.concat(fixed(100 * x, 1), F.lit("%"))).otherwise("–")


def fixed3(x: Column) -> Column:
    """Three decimals; a dash for null or no number."""
    return F.when(x.isNotNull() & ~F.isnan(x), fixed(x, 3)).otherwise("–")
