"""Text expressions: tokens, sentences, claim units, numbers, n-grams, names. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
NUMBER = r"\d{1,3}(?:,\d{3})+|\d+\.\d+|\.\d+|\d+"
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\s\x1c-\x1f\x85\p{Z}"
TOKEN = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CHARS}]"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"
UNIT_BREAK = r";\s+|,\s+while\s+|,\s+and\s+(?=[A-Z])"
CLAUSE_BREAK = r";|,?\s+while\s+|,?\s+but\s+|,\s+and\s+|,\s+(?=[A-Z])"
NAME_SUFFIXES = ("jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "v")
ENTITY_STOPWORDS = ("the", "and", "for", "out", "city", "new")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def quoted(text: Column) -> Column:
    """A pattern that matches ``text`` literally."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(alias: Column) -> Column:
    """A pattern of ``alias`` not touching other word characters."""
    return F.concat(F.lit(f"(?<![{WORD_CHARS}])"), quoted(alias), F.lit(f"(?![{WORD_CHARS}])"))


def numbers(text: Column) -> Column:
    """The numbers of a text in order, without signs or thousands separators."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda m: F.replace(m, F.lit(","), F.lit("")).cast("double"))


def tokens(text: Column) -> Column:
    """Lower-cased words and single punctuation marks, by Unicode classes."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """The runs of ``n`` items, joined by the unit separator."""
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, F.lit(n)), "\x1f"))
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), SENTENCE_BREAK), strip), lambda s: s != "")


def claim_units(text: Column) -> Column:
    """Clauses of sentences with at least three words of two letters or more."""
    pieces = F.flatten(F.transform(sentences(text), lambda s: F.split(s, UNIT_BREAK)))
    trimmed = F.transform(pieces, lambda c: F.regexp_replace(c, "^[ ,]+|[ ,]+$", ""))
    return F.filter(trimmed, lambda c: (c != "") & (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 3))


def clauses(sentence: Column) -> Column:
    return F.split(sentence, CLAUSE_BREAK)


def entity_tokens(name: Column) -> Column:
    """Lower-cased alphanumeric runs of three characters or more that aren't stop words."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(runs, lambda t: (F.length(t) >= 3) & ~t.isin(*ENTITY_STOPWORDS))


def surname(name: Column) -> Column:
    """The last token that isn't a generational suffix, else the whole name; lower case."""
    plain = F.filter(F.split(strip(name), r"\s+"), lambda t: (t != "") & ~F.lower(t).isin(*NAME_SUFFIXES))
    return F.lower(F.when(F.size(plain) > 0, F.element_at(plain, -1)).otherwise(name))


def extract_final(text: Column, marker: Column) -> Column:
    """What follows the last ``marker:``, in any case and with decoration; the whole text if there is none."""
    found = F.concat(F.lit("(?is)^.*"), quoted(F.regexp_replace(marker, ":+$", "")), F.lit(r"[*_\s]*:[*_\s]*"))
    return strip(F.when(marker.isNull(), text).otherwise(F.regexp_replace(text, found, F.lit(""))))


def word_positions(text: Column, alias: Column) -> Column:
    """0-based starts of all whole-word matches of ``alias``."""

    def starts(parts: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(parts, F.lit(1), k + 1), F.lit(0), lambda a, p: a + F.length(p)) + k * F.length(alias)
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), before)).otherwise(F.array().cast("array<int>"))

    return bind(F.split(text, whole_word(alias), -1), starts)


#: Tokens per machine word of the bit-parallel recurrence; a sum of two words and a carry stays below 64 bits.
LCS_BITS = 60
_FULL = (1 << LCS_BITS) - 1


def lcs_length(value: Column, text: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, by the bit-parallel recurrence.

    A bit per token of ``value`` stands for a step of the table's row: 0 where the length grows. A token c of the text
    turns the row V into (V + (V & M)) | (V & ~M), M being where ``value`` has c; tokens that it hasn't change nothing. Beyond
    ``LCS_BITS`` tokens the row takes several words, and the sum's carry runs through them.
    """
    one = F.lit(1).cast("bigint")

    def where(tokens: Column, c: Column) -> Column:
        bits = F.transform(tokens, lambda x, i: F.when(x == c, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    def kept(v: Column, total: Column, m: Column) -> Column:
        return total.bitwiseAND(F.lit(_FULL)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))

    def one_word(said: Column) -> Column:
        row = F.aggregate(said, F.lit(_FULL), lambda v, c: bind(where(value, c), lambda m: kept(v, v + v.bitwiseAND(m), m)))
        return LCS_BITS - F.bit_count(row)

    def many_words(said: Column) -> Column:
        words = F.ceil(F.size(value) / LCS_BITS).cast("int")

        def step(row: Column, c: Column) -> Column:
            def word(acc: Column, w: Column) -> Column:
                v, m = F.get(row, w), where(F.slice(value, w * LCS_BITS + 1, F.lit(LCS_BITS)), c)
                total = v + v.bitwiseAND(m) + acc["carry"]
                return F.struct(F.shiftright(total, LCS_BITS).alias("carry"), F.concat(acc["row"], F.array(kept(v, total, m))).alias("row"))

            begin = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("row"))
            return F.aggregate(F.sequence(F.lit(0), words - 1), begin, word, lambda acc: acc["row"])

        row = F.aggregate(said, F.array_repeat(F.lit(_FULL), words), step)
        return F.aggregate(row, F.lit(0), lambda a, v: a + LCS_BITS - F.bit_count(v))

    said = F.filter(text, lambda c: F.array_contains(value, c))
    found = F.when(F.size(value) <= LCS_BITS, bind(said, one_word)).otherwise(bind(said, many_words))
    return F.when(F.size(value) == 0, F.lit(0)).when(F.size(value) == 1, F.array_contains(text, F.get(value, F.lit(0))).cast("int")).otherwise(found)
