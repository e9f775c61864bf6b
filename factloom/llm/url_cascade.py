"""URL verdicts from longest-match rules and, for the rest, a cascade of Bloom filters over the known hosts.

Everything here is DataFrame and SQL expressions. Level 1 of the cascade encodes the listed hosts; level 2 the
hosts of the corpus that level 1 takes wrongly for listed; level 3 the listed hosts that level 2 takes wrongly for
those; and so on until a level errs on no host of the corpus. As every host that is asked about took part in the
building, membership is exact, and a query reads only the filters: no join.

Each filter is an array of 64-bit words built by a partial ``bit_or`` and handed to expressions as an uncorrelated
scalar subquery. Filters are bounded: a list that needs more than ``MOST_FILTER_BYTES`` is joined by shuffle instead.

Defined results: a null url and one without ``://`` have an empty host and path, fit no rule and are not listed
(verdict allow); ties between fitting rules of one length go to block; an empty table gives an empty result; an
empty list allows all; repeated pages are judged alike; other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage

#: (verdict, host, path), as the contract of the query states them.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Names by which the query's list of hosts is made from the corpus.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BITS_PER_KEY, HASHES = 8, 5
MOST_FILTER_BYTES = 16 << 20
MOST_LEVELS = 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null; for rules so few that a CASE holds them."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    found = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _bit(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits))


def _filter_view(keys: DataFrame, key: str, n: int, level: int) -> tuple[str, int]:
    """A staged one-row view with the filter of ``keys`` as an array of words, and its number of bits."""
    words = max(1, math.ceil(n * BITS_PER_KEY / 64))
    bits = words * 64
    at = F.explode(F.array(*[_bit(F.col(key), level * HASHES + k, bits) for k in range(HASHES)])).alias("bit")
    rows = keys.select(at).select(
        F.floor(F.col("bit") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("v")
    ).groupBy("w").agg(F.bit_or("v").alias("v"))
    pairs = rows.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("p"))
    gap = lambda x, i: x["w"] - F.coalesce(F.get(F.col("p"), i - 1)["w"], F.lit(-1)) - 1
    filled = F.flatten(F.transform(F.col("p"), lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(x, i)), F.array(x["v"]))))
    name = f"cascade_{uuid.uuid4().hex}"
    stage(pairs.select(filled.alias("f")), "cascade").createOrReplaceTempView(name)
    return name, bits


def _might_hold(key: str, view: str, bits: int, level: int) -> str:
    """SQL: the filter holds all bits of the key; a word beyond the array is zero."""
    array = f"(SELECT f FROM {view})"
    one = []
    for k in range(HASHES):
        at = f"pmod(xxhash64({level * HASHES + k}, {key}), {bits}L)"
        one.append(f"(shiftright(coalesce(get({array}, cast({at} div 64 as int)), 0L), cast({at} % 64 as int)) & 1L) = 1L")
    return "(" + " AND ".join(one) + ")"


class Cascade:
    """Exact membership of the hosts of a corpus in a list. ``expression(key)`` is SQL; None: the list is too large."""

    def __init__(self, universe: DataFrame, listed: DataFrame, key: str = "host") -> None:
        """universe: every key that will be asked about; listed: keys of which those in the universe count."""
        universe = stage(universe.select(key).filter(F.col(key).isNotNull()).distinct(), "universe")
        right = stage(universe.join(listed.select(key).distinct(), key, "left_semi"), "listed")
        wrong = universe.join(right, key, "left_anti")
        self.key, self.levels, self.fits, self.listed = key, [], True, right
        n = right.count()
        if n * BITS_PER_KEY / 8 > MOST_FILTER_BYTES:
            self.fits = False
            return
        encoded, others = right, stage(wrong, "others")
        while n:
            if len(self.levels) >= MOST_LEVELS:
                raise RuntimeError("the cascade does not end")
            view, bits = _filter_view(encoded, key, n, len(self.levels))
            self.levels.append((view, bits))
            passed = stage(others.filter(F.expr(_might_hold(key, view, bits, len(self.levels) - 1))), "passed")
            encoded, others, n = passed, encoded, passed.count()

    def expression(self, key: str) -> str:
        """SQL: is this key listed?"""
        found = "true" if len(self.levels) % 2 else "false"
        for level in reversed(range(len(self.levels))):
            view, bits = self.levels[level]
            found = f"CASE WHEN {_might_hold(key, view, bits, level)} THEN {found} ELSE {'true' if level % 2 else 'false'} END"
        return f"({found})"


def judge_urls(pages: DataFrame, listed: DataFrame, id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Per row: id, host, path, the rule that fits and the verdict, of the rule or else of the cascade.

    listed: a DataFrame with a column ``host``.
    """
    split = pages.select(F.col(id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    cascade = Cascade(split.select("host"), listed)
    out = split.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if cascade.fits:
        out = out.withColumn("in_list", F.expr(cascade.expression("host")))
    else:
        marked = cascade.listed.select(F.col("host").alias("l_host"))
        out = out.join(marked, F.col("host") == F.col("l_host"), "left").withColumn("in_list", F.col("l_host").isNotNull())
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("in_list"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(id, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def named_hosts(pages: DataFrame, url: str = "url", names=LISTED_NAMES) -> DataFrame:
    """The hosts of the corpus that have one of the names as a label."""
    host = host_of(F.col(url))
    parts = F.split(host, r"\.")
    return pages.select(host.alias("host")).filter(F.arrays_overlap(parts, F.array(*map(F.lit, names)))).distinct()
