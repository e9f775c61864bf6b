"""Overlap with references: BLEU from summable counts, and PARENT, which also looks at the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import bind, lcs_length, ngrams, tokens

MAX_N = 4
SMOOTHING = 1e-5
MATCH = [f"bleu_match_{n}" for n in range(1, MAX_N + 1)]
TOTAL = [f"bleu_total_{n}" for n in range(1, MAX_N + 1)]


def _gram_counts(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, gram, count) of an array column ``toks``."""
    tagged = lambda n: F.transform(ngrams(F.col("toks"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    each = F.flatten(F.array(*map(tagged, range(1, MAX_N + 1))))
    return df.select(*keys, F.explode(each).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count(F.lit(1)).alias("count"))


def bleu_items(pairs: DataFrame) -> DataFrame:
    """(id, output, references ARRAY<STRING>) to clipped matches, totals and lengths; empty references don't count."""
    hyp = pairs.select("id", tokens(F.coalesce("output", F.lit(""))).alias("toks"))
    refs = pairs.select("id", F.posexplode(F.filter("references", lambda r: r != "")).alias("ref", "text")).select("id", "ref", tokens(F.col("text")).alias("toks"))
    most = _gram_counts(refs, "id", "ref").groupBy("id", "n", "gram").agg(F.max("count").alias("most"))
    matched = _gram_counts(hyp, "id").join(most, ["id", "n", "gram"]).groupBy("id").agg(*[F.sum(F.when(F.col("n") == n, F.least("count", "most")).otherwise(0)).alias(MATCH[n - 1]) for n in range(1, MAX_N + 1)])
    size = hyp.select("id", F.size("toks").cast("long").alias("bleu_hyp_len"))
    near = refs.join(size, "id").select("id", F.struct(F.abs(F.size("toks") - F.col("bleu_hyp_len")).alias("far"), F.size("toks").cast("long").alias("len")).alias("d")).groupBy("id").agg(F.min("d")["len"].alias("bleu_ref_len"))
    out = size.join(matched, "id", "left").join(near, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    totals = [F.greatest(F.lit(0), F.col("bleu_hyp_len") - n + 1).cast("long").alias(TOTAL[n - 1]) for n in range(1, MAX_N + 1)]
    return out.select("id", *map(zero, MATCH), *totals, "bleu_hyp_len", zero("bleu_ref_len"))


def bleu_score(matches, totals, hyp_len, ref_len):
    """0 to 100 from summed counts; 0 where an order has no match or nothing to match."""
    dead = hyp_len == 0
    logs = F.lit(0.0)
    for m, t in zip(matches, totals, strict=True):
        dead = dead | (t == 0) | (m == 0)
        logs = logs + F.ln(F.try_divide(m, t)) / MAX_N
    penalty = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(ref_len, hyp_len)))
    return F.when(dead, F.lit(0.0)).otherwise(100.0 * penalty * F.exp(logs))


def bleu_run(items: DataFrame, *by: str) -> DataFrame:
    """Corpus BLEU (two decimals) and brevity penalty (four) from the sums over items."""
    sums = items.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*MATCH, *TOTAL, "bleu_hyp_len", "bleu_ref_len")])
    col = lambda names: [F.col(c) for c in names]
    score = bleu_score(col(MATCH), col(TOTAL), F.col("bleu_hyp_len"), F.col("bleu_ref_len"))
    penalty = F.when(F.col("bleu_hyp_len") > F.col("bleu_ref_len"), 1.0).otherwise(F.exp(1 - F.col("bleu_ref_len") / F.greatest(F.lit(1), "bleu_hyp_len")))
    return sums.select(*by, F.round(score, 2).alias("bleu"), F.round(penalty, 4).alias("brevity_penalty"), F.col("bleu_hyp_len").alias("hyp_len"), F.col("bleu_ref_len").alias("ref_len"))


def table_entries(cells: DataFrame) -> DataFrame:
    """(ex_id, attr ARRAY, value ARRAY): tokenised entries of non-null cells; several rows put the entity before the attribute."""
    attr = F.when(F.col("n_sec_rows") == 1, F.col("col_name")).otherwise(F.concat_ws(" ", "entity", "col_name"))
    return cells.filter("text IS NOT NULL").select("ex_id", tokens(attr).alias("attr"), tokens(F.col("text")).alias("value"))


def cooccurrence_ratios(counts: DataFrame) -> DataFrame:
    """(b, x, p): how often x stands with b, as a share of b, from (key, count) of tokens and of pairs ``b|||x``."""
    pair = F.instr("key", "|||")
    pairs = counts.filter(pair > 0).select(F.substring_index("key", "|||", 1).alias("b"), F.expr("substring(key, instr(key, '|||') + 3)").alias("x"), F.col("count").alias("n"))
    alone = counts.filter(pair == 0).select(F.col("key").alias("b"), F.col("count").alias("of"))
    return pairs.join(alone, "b").select("b", "x", (F.col("n") / F.col("of")).alias("p"))


def cooccurrence_entailment(grams: DataFrame, cells: DataFrame, ratios: DataFrame) -> DataFrame:
    """(id, gram, probability): how likely the table entails each n-gram (id, gram ARRAY) by the lexical entailment model.

    A token of the table counts 1, any other the best of its ratios to the table's tokens (0 without one); an n-gram the
    geometric mean. The table's tokens are those of its values and each attribute's, joined by underscores.
    """
    entries = table_entries(cells)
    held = entries.select(F.col("ex_id").alias("id"), F.explode(F.concat("value", F.array(F.array_join("attr", "_")))).alias("b")).distinct()
    each = grams.select("id", "gram").distinct().select("id", "gram", F.explode("gram").alias("x"))
    best = held.join(ratios, "b").groupBy("id", "x").agg(F.max("p").alias("p"))
    inside = held.withColumnRenamed("b", "x").withColumn("inside", F.lit(1.0))
    p = F.coalesce("inside", "p", F.lit(0.0))
    scored = each.join(inside, ["id", "x"], "left").join(best, ["id", "x"], "left").groupBy("id", "gram").agg(F.product(p).alias("all"))
    return scored.select("id", "gram", F.pow("all", 1.0 / F.size("gram")).alias("probability"))


def parent_items(pairs: DataFrame, cells: DataFrame, table_weight: float | None = 0.5) -> DataFrame:
    """Per id: precision, recall and F of the reference with the best F (the first of equal ones).

    table_weight: the exponent of table recall; None takes one minus how much of the table the reference mentions.
    """
    entries = table_entries(cells)
    lexicon = entries.select("ex_id", F.explode("value").alias("tok")).groupBy("ex_id").agg(F.collect_set("tok").alias("lexicon")).withColumnRenamed("ex_id", "id")
    hyp = pairs.select("id", tokens(F.col("output")).alias("toks"))
    refs = pairs.select("id", F.posexplode("references").alias("ref", "text")).select("id", "ref", tokens(F.col("text")).alias("toks"))
    h = _gram_counts(hyp, "id").join(refs.select("id", "ref"), "id")
    grams = h.withColumnRenamed("count", "ch").join(_gram_counts(refs, "id", "ref").withColumnRenamed("count", "cr"), ["id", "ref", "n", "gram"], "full").na.fill(0, ["ch", "cr"])
    parts = F.split("gram", "\x1f")
    grams = grams.join(lexicon, "id", "left").withColumn("w", F.size(F.filter(parts, lambda t: F.array_contains("lexicon", t))) / F.size(parts))
    share = F.least(F.lit(1.0), F.try_divide("cr", "ch"))
    sums = grams.groupBy("id", "ref", "n").agg(
        F.sum(F.when(F.col("ch") > 0, F.col("ch") * (share + (1 - share) * F.col("w"))).otherwise(0.0)).alias("pn"), F.sum("ch").alias("pd"),
        F.sum(F.col("cr") * F.col("w") * F.when(F.col("cr") > 0, F.least(F.lit(1.0), F.col("ch") / F.greatest("cr", F.lit(1)))).otherwise(0.0)).alias("rn"), F.sum(F.col("cr") * F.col("w")).alias("rd"),
    )
    per = refs.select("id", "ref", F.explode(F.array(*map(F.lit, range(1, MAX_N + 1)))).alias("n")).join(sums, ["id", "ref", "n"], "left")
    p = F.when(F.coalesce("pd", F.lit(0)) == 0, 0.0).otherwise(F.col("pn") / F.col("pd"))
    r = F.when(F.coalesce("rd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("rn") / F.col("rd"))
    smooth = lambda x: F.when((F.col("n") > 1) & (x == 0), SMOOTHING).otherwise(x)
    per = per.select("id", "ref", "n", smooth(p).alias("p"), smooth(r).alias("r"))
    mean = lambda x, none: F.when(F.min(x) == 0, none).otherwise(F.exp(F.sum(F.ln(F.when(F.col(x) > 0, F.col(x)))) / MAX_N))
    means = per.groupBy("id", "ref").agg(mean("p", 0.0).alias("precision"), mean("r", SMOOTHING).alias("ref_recall"))

    def mentioned(texts: DataFrame, *keys: str) -> DataFrame:
        lcs = F.transform("values", lambda v: F.when(F.size(v) > 0, lcs_length(v, F.col("toks")) / F.size(v)).otherwise(F.lit(0.0)))
        # Distinct values once; each weighs by how many entries have it.
        values = entries.groupBy(F.col("ex_id").alias("id"), "value").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.collect_list("value").alias("values"), F.collect_list("k").alias("ks"))
        weighed = bind(lcs, lambda x: F.aggregate(F.zip_with(x, F.col("ks"), lambda a, k: a * k), F.lit(0.0), lambda a, y: a + y))
        total = F.aggregate("ks", F.lit(0).cast("long"), lambda a, k: a + k)
        return texts.join(values, "id").select(*keys, (weighed / total).alias("mention"))

    out = means.join(mentioned(hyp, "id"), "id").withColumn("mention", F.when(F.col("mention") == 0, SMOOTHING).otherwise(F.col("mention")))
    lw = F.lit(table_weight)
    if table_weight is None:
        out = out.join(mentioned(refs, "id", "ref").withColumnRenamed("mention", "ref_mention"), ["id", "ref"])
        lw = 1 - F.col("ref_mention")
    recall = F.exp((1 - lw) * F.ln("ref_recall") + lw * F.ln("mention"))
    out = out.withColumn("recall", recall).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("f1"), "ref"))
    return out.withColumn("k", best).filter("k = 1").select("id", "ref", "precision", "recall", "f1")


def parent_run(items: DataFrame, *by: str) -> DataFrame:
    """Plain means over items; null for none."""
    return items.groupBy(*by).agg(F.avg("precision").alias("parent_precision"), F.avg("recall").alias("parent_recall"), F.avg("f1").alias("parent_f1"))
