"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Everything here is DataFrame expressions. A text is measured once, into a staged table; KLL sketches of four
ratios and of the sizes that they are shares of are built per (lang, source) with partial aggregation, merged per language
and over all, and read at the quartiles. No distance is given in advance: a document's fence stands beyond the median by
``REACH`` times the narrower half of the quartile range, wider by the root for a text smaller than the median one (a mean
over fewer words strays farther), and by what ``EVENTS`` symbols or repeated lines make in it or in the median text,
whichever is smaller, so that a group whose texts hold none has a width too. Junk on one side moves neither the median nor
the other side's quartile far, so a share of it well below a half can't push the fence beyond itself.

Medians, halves and sizes of a group are blended with those of its language, and a language's with those of all rows:
``PRIOR`` rows count for the larger group, whatever the group's size. A source may be laxer than its language up to a stated
distance from the language's median, so one that is junk throughout is judged by its language.

Defined results: a null text has no words and fails the base rule; null ``lang`` or ``source`` is a group like any
other; equal rows are judged alike; where no row passes the base rule (an empty table, too) there is nothing to learn and the
base rule alone decides; texts are measured whole whatever their length; other columns pass through untouched, those named
like a measure included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage

MIN_WORDS = 50
#: Rows of the larger group that a group's own fences are blended with.
PRIOR = 100
#: Entries of a sketch; up to about this many values it is exact.
SKETCH_K = 4096
#: Halves of the quartile range from median to fence; nine are six standard deviations of a normal spread.
REACH = 9.0
#: So few symbols or repeated lines tell nothing: with none in n trials, the rate is below 3 / n in 95 of 100 cases.
EVENTS = 3.0
#: Ratio, the size that it is a share (or mean) of, what one event adds in units of one through that size (a line found
#: twice counts twice among repeated words), how far a source's fence may lie from its language's median where that is
#: more than the language's own fence, and whether low values are fenced too.
RATIOS = {
    "symbol_ratio": ("word_chars", 1, 0.2, False),
    "dup_line_ratio": ("n_lines", 1, 1.0, False),
    "repeat_ratio": ("n_lines", 2, 0.6, False),
    "word_length": ("n_words", 0, 6.0, True),
}
SIZES = ("word_chars", "n_lines", "n_words")
#: Thresholds for so many groups at most are broadcast.
BROADCAST_GROUPS = 100_000
_SPACE = r"[\x20\x09-\x0D]"
_PREFIX = "_q_"


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are 64-bit hashes; sorting (hash, position) pairs brings equal ones together. The positions of the
    repeated ones, sorted, cover three words each less what they share with the one before.
    """

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        return F.transform(
            F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"])),
            lambda p: p["i"],
        )

    def of_windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = _bind(F.array_sort(pairs), lambda s: _bind(F.array_sort(repeated(s)), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_bind(hashes, of_windows))

    return of_words(words)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def whole(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return _bind(words_of(text), whole)


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` beside measures, ratios and the base verdict, staged in the shared folder.

    Columns it adds begin with ``_q_``; those of ``docs`` are carried in one struct ``_q_row``, so names can't clash.
    """
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]) if keep != [] else F.lit(None).cast("int")
    out = docs.select(row.alias("_q_row"), docs[lang].alias("_q_lang"), docs[source].alias("_q_source"), measures(docs[text]).alias("m"))
    n, c = F.col("m.n_words"), F.col("m.word_chars")
    out = out.select(
        "_q_row", "_q_lang", "_q_source",
        n.alias("_q_n_words"), c.alias("_q_word_chars"), F.col("m.n_symbols").alias("_q_n_symbols"),
        F.col("m.lines.n").cast("long").alias("_q_n_lines"), F.col("m.lines.d").cast("long").alias("_q_n_dup_lines"), F.col("m.n_repeat_words").alias("_q_n_repeat_words"),
        F.try_divide(F.col("m.n_symbols"), c).alias("_q_symbol_ratio"),
        F.try_divide(F.col("m.lines.d"), F.col("m.lines.n")).alias("_q_dup_line_ratio"),
        F.try_divide(F.col("m.n_repeat_words"), n).alias("_q_repeat_ratio"),
        F.try_divide(c, n).alias("_q_word_length"),
        ((n < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > 50 * n)).alias("_q_base_failed"),
    )
    return stage(out, "quality", "zstd")


def spreads(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): ``own`` and ``larger`` with the median and the narrower half of each ratio's quartile
    range and the median of each size; ``own`` is blended with ``larger``, which is the language blended with all rows.

    Only rows that pass the base rule are learned from, so that junk doesn't widen the fences; both are null where none does.
    """
    names = [*RATIOS, *SIZES]
    by_group = measured.filter("NOT _q_base_failed").groupBy("_q_lang", "_q_source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(f"_q_{r}").cast("double"), F.lit(SKETCH_K)).alias(r) for r in names]
    )
    by_group = stage(by_group, "sketches")
    # Grouped by a constant rather than by nothing: without rows there is then no sketch to read.
    merged = lambda *keys: by_group.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in names])

    def read(df: DataFrame, tag: str, *keys: str) -> DataFrame:
        at = lambda r, rank: F.kll_sketch_get_quantile_double(F.col(r), F.lit(rank))
        found = [at(r, 0.5).alias(f"mid_{r}") for r in names]
        found += [F.least(at(r, 0.75) - at(r, 0.5), at(r, 0.5) - at(r, 0.25)).alias(f"half_{r}") for r in RATIOS]
        return df.select(*[F.col(k).alias(f"{tag}{k}") for k in keys], F.struct(F.col("n").alias("n"), *found).alias(tag))

    def blended(group: str, larger: str) -> Column:
        n, each = F.col(f"{group}.n"), []
        for f in [f"mid_{r}" for r in names] + [f"half_{r}" for r in RATIOS]:
            own, prior_value = F.col(f"{group}.{f}"), F.col(f"{larger}.{f}")
            if f.startswith("half_"):  # the larger group's rows lie as far from the group's median as the medians do
                mid = f.replace("half_", "mid_")
                prior_value = F.greatest(prior_value, F.coalesce(F.abs(F.col(f"{group}.{mid}") - F.col(f"{larger}.{mid}")), F.lit(0.0)))
            each.append(F.coalesce((n * own + prior * prior_value) / (n + prior), prior_value).alias(f))
        return F.struct(*each)

    groups = measured.select("_q_lang", "_q_source").distinct()
    own, lang, every = read(by_group, "own", "_q_lang", "_q_source"), read(merged("_q_lang"), "lang", "_q_lang"), read(merged(F.lit(True)), "every")
    out = groups.join(own, F.col("_q_lang").eqNullSafe(F.col("own_q_lang")) & F.col("_q_source").eqNullSafe(F.col("own_q_source")), "left")
    out = out.join(lang, F.col("_q_lang").eqNullSafe(F.col("lang_q_lang")), "left").join(F.broadcast(every), F.lit(True), "left")
    out = out.withColumn("larger", blended("lang", "every")).withColumn("mixed", blended("own", "larger"))
    return out.select(F.col("_q_lang").alias("f_lang"), F.col("_q_source").alias("f_source"), F.col("mixed").alias("own"), "larger")


def width(ratio: str, group: str) -> Column:
    """How far a row's fence stands from the median of ``group``, a struct of ``spreads`` beside the measured row."""
    size, weight, _, _ = RATIOS[ratio]
    mid, mine = F.col(f"{group}.mid_{size}"), F.greatest(F.col(f"_q_{size}"), F.lit(1)).cast("double")
    stretch = F.greatest(F.lit(1.0), F.sqrt(mid / mine))
    return REACH * F.col(f"{group}.half_{ratio}") * stretch + EVENTS * weight / F.least(mid, mine)


def judge(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``measured`` with ``_q_kept``: false where the base rule fails or a ratio lies outside its fences."""
    limits = stage(spreads(measured, prior), "fences")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = measured.join(limits, F.col("_q_lang").eqNullSafe(F.col("f_lang")) & F.col("_q_source").eqNullSafe(F.col("f_source")), "left")
    bad = F.col("_q_base_failed")
    for r, (_, _, laxest, both) in RATIOS.items():
        v, own, larger = F.coalesce(F.col(f"_q_{r}"), F.lit(0.0)), width(r, "own"), width(r, "larger")
        high = F.least(F.col(f"own.mid_{r}") + own, F.col(f"larger.mid_{r}") + F.greatest(larger, F.lit(laxest)))
        bad = bad | F.coalesce(v > high, F.lit(False))
        if both:
            low = F.greatest(F.col(f"own.mid_{r}") - own, F.col(f"larger.mid_{r}") - F.greatest(larger, F.lit(laxest)))
            bad = bad | F.coalesce(v < low, F.lit(False))
    return out.withColumn("_q_kept", ~bad).drop("own", "larger", "f_lang", "f_source")


def apply_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    return judge(measure(docs, **columns)).filter("_q_kept").select("_q_row.*")


def quality_report(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, measures, base verdict and final verdict."""
    judged = judge(measure(docs, keep=[id]))
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col(f"_q_row.{id}").alias(id), *[F.col(f"_q_{c}").alias(c) for c in named])
