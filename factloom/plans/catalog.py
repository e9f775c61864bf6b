"""The registered queries over the driver tables; their DuckDB SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import numeric as V
from factloom.functions import text as T
from factloom.operators import align, claims, dataset, facts, features, numbers, overlap, prompts, relations, report, runs, serialise, stats, table_functions
from factloom.plans import oracles, text_oracles
from factloom.sources import games as G
from factloom.sources import loaders
from factloom.sources.staging import shared_folder, staged

Query = Callable[[SparkSession, str], DataFrame]
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | text_oracles.SQL
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table(spark, sf_dir, "documents")


@query
def cells_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All game tables as cells."""
    return G.game_cells(spark, sf_dir).drop("is_int", "str")


@query
def game_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated texts that the checks run on."""
    return G.game_texts(spark, sf_dir).select("id", "e", "output", "reference")


@query
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over all documents."""
    found = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.numbers(F.col("text"))).alias("pos", "number"))
    return found.withColumn("pos", F.col("pos") + 1)


@query
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 over all documents."""
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.bind(s, lambda x: F.struct(F.size(x).cast("long").alias("n_sentences"), F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.length(y)).alias("n_chars"))).alias("s")).select("doc_id", "s.*")


@query
def doc_tokens_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent tokens per language."""
    counts = _docs(spark, sf_dir).select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
    return counts.withColumn("k", rank).filter("k <= 20").drop("k")


@query
def claim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 over all documents."""
    units = _docs(spark, sf_dir).select("doc_id", F.explode(T.claim_units(F.col("text"))).alias("u"))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.length("u")).alias("n_chars"))


@query
def claim_rows_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12, X6: the claim units of all documents by the table function, from SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT d.doc_id, c.pos, length(c.unit) AS n_chars, md5(c.unit) AS digest FROM {docs} d, LATERAL claim_rows(d.text) c", docs=_docs(spark, sf_dir))


@query
def game_team_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of every game."""
    return facts.team_facts(G.game_cells(spark, sf_dir))


@query
def game_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders per city and game."""
    found = facts.leaders(facts.player_rows(G.game_cells(spark, sf_dir)))
    return found.withColumn("players", F.array_join("players", ","))


@query
def game_topk_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next two scorers of each city after its leaders."""
    return facts.next_scorers(facts.player_rows(G.game_cells(spark, sf_dir)))


@query
def surname_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player aliases."""
    return facts.player_aliases(facts.player_rows(G.game_cells(spark, sf_dir)))


@query
def derived_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, J8."""
    return numbers.derived_numbers(G.game_cells(spark, sf_dir))


def _number_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = G.games(spark, sf_dir)
    return numbers.score_items(games.texts, games.cells)


@query
def number_support_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: number support of each text."""
    items = _number_items(spark, sf_dir).withColumn("n_unsupported", F.size("unsupported").cast("long")).drop("unsupported")
    return items.withColumn("support_rate", F.round("support_rate", 9)).withColumn("exact_rate", F.round("exact_rate", 9))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def number_support_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: number support of the run."""
    return _rounded(numbers.score_run(_number_items(spark, sf_dir)))


@query
def part_number_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on single-row tables."""
    items = numbers.score_items(G.part_texts(spark, sf_dir), G.part_cells(spark, sf_dir))
    n = F.size("unsupported")
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(n == 0).alias("fully_supported"), F.sum(n).alias("n_unsupported"))


def _claims_of(texts: DataFrame, cells: DataFrame) -> DataFrame:
    return relations.claims(texts, facts.context(cells, texts.select(F.col("id").alias("ex_id"), F.col("output").alias("text"))))


def _claims(games: G.Games) -> DataFrame:
    return _claims_of(games.texts, games.cells)


@query
def winner_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: the first sentence of each text claims a winner."""
    return _claims(G.games(spark, sf_dir)).filter("type = 'winner' AND pos = 0").select("id", "claimed", "expected", "correct")


@query
def relation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3: all relational claims."""
    return _claims(G.games(spark, sf_dir))


@query
def turned_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V3: claims of passive defeats, losses, two players in one clause; none of a pooled count."""
    texts = staged(G.turned_texts(staged(G.players(spark, sf_dir), "players")), "texts")
    return _claims_of(texts, G.staged_cells(spark, sf_dir))


@query
def premise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the fact line of every table row."""
    return claims.row_facts(G.game_cells(spark, sf_dir)).select("ex_id", "sec_idx", "row_idx", "fact")


@query
def result_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the result line of every decided game."""
    return claims.result_facts(G.game_cells(spark, sf_dir)).select("ex_id", "fact")


def _pairs(texts: DataFrame) -> DataFrame:
    return texts.select("id", "output", F.array("reference").alias("references"))


@query
def bleu_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return overlap.bleu_items(_pairs(staged(G.game_texts(spark, sf_dir), "texts")))


@query
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return overlap.bleu_run(overlap.bleu_items(_pairs(staged(G.game_texts(spark, sf_dir), "texts"))))


@query
def parent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, V6: PARENT of each text."""
    games = G.games(spark, sf_dir)
    return _rounded(overlap.parent_items(_pairs(games.texts), games.cells))


@query
def parent_two_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PARENT of each text with two references, of which the one with the better F counts."""
    games = G.games(spark, sf_dir)
    second = F.when(F.col("e") % 2 == 0, F.regexp_replace("output", "points|rebounds", "scores")).otherwise(F.concat("reference", F.lit(" Nothing else happened.")))
    pairs = games.texts.select("id", "output", F.array("reference", second).alias("references"))
    return _rounded(overlap.parent_items(pairs, games.cells))


@query
def cooccurrence_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each game's table entails the word pairs of its text, by how often table tokens and words stand together."""
    games = G.games(spark, sf_dir)
    entries = overlap.table_entries(games.cells)
    held = entries.select(F.col("ex_id").alias("id"), F.explode(F.concat("value", F.array(F.array_join("attr", "_")))).alias("b")).distinct()
    words = games.texts.select("id", F.explode(F.array_distinct(T.tokens(F.col("reference")))).alias("x"))
    alone = held.groupBy(F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    pairs = held.join(words, "id").groupBy(F.concat_ws("|||", "b", "x").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    grams = games.texts.select("id", F.explode(T.ngrams(T.tokens(F.col("output")), 2)).alias("gram")).select("id", F.split("gram", "\x1f").alias("gram"))
    found = overlap.cooccurrence_entailment(grams, games.cells, overlap.cooccurrence_ratios(staged(alone.union(pairs), "counts")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.avg("probability"), 6).alias("mean_probability"), F.count_if(F.col("probability") >= 0.999999).alias("n_certain"))


@query
def md_serialise_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16 on single-row tables."""
    return serialise.to_markdown(G.part_cells(spark, sf_dir))


@query
def md_serialise_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16 on two sections."""
    return serialise.to_markdown(G.staged_cells(spark, sf_dir))


@query
def factsheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: sheets of all games; one-team games get labelled lines."""
    return serialise.to_factsheet(G.staged_cells(spark, sf_dir))


@query
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages of every part's table."""
    found = prompts.messages(serialise.to_markdown(G.part_cells(spark, sf_dir)), "e2e/strict_v1").select("ex_id", F.posexplode("messages").alias("pos", "m"))
    return found.select("ex_id", "pos", "m.role", F.length("m.content").alias("n_chars"), F.md5(F.col("m.content").cast("binary")).alias("digest"))


@query
def extract_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text after the last marker."""
    raw = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("- a: 1\n**Summary:** draft\nSUMMARY: "), "text").alias("raw"))
    return raw.select("doc_id", F.length(T.extract_final(F.col("raw"), F.lit("SUMMARY:"))).alias("n_chars"))


@query
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return _rounded(features.column_stats(G.game_cells(spark, sf_dir)), 6)


@query
def column_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return features.column_vocab(G.game_cells(spark, sf_dir).unionByName(G.part_cells(spark, sf_dir)))


@query
def featurised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every cell of every game."""
    cells = G.staged_cells(spark, sf_dir)
    found = features.featurise(cells, features.column_vocab(cells), features.column_stats(cells))
    return found.select("ex_id", "r", "c", "col_id", "kind", "str_bucket", "is_key", *[F.round(F.get("num_feats", F.lit(i)), 6).alias(f"f{i}") for i in range(4)])


@query
def string_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14."""
    return G.table(spark, sf_dir, "part").select("p_partkey", V.string_bucket(F.col("p_name")).alias("bucket"))


@query
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13."""
    rows = G.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    f = V.numeric_features(F.col("c_acctbal"), F.lit(4500.0), F.lit(3000.0))
    return rows.select("c_custkey", *[F.round(F.get(f, F.lit(i)), 6).alias(f"f{i}") for i in range(4)])


def _references(games: G.Games) -> DataFrame:
    return games.texts.select(F.col("id").alias("ex_id"), F.col("output").alias("reference"))


@query
def align_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: which numeric cells of a game its text mentions."""
    games = G.games(spark, sf_dir)
    texts, cells = _references(games), games.cells
    return align.alignment_labels(cells, texts).join(cells.filter("kind = 1").select("ex_id", "sec_idx", "row_idx", "col_idx"), ["ex_id", "sec_idx", "row_idx", "col_idx"])


@query
def align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: all cells."""
    games = G.games(spark, sf_dir)
    return align.alignment_labels(games.cells, _references(games))


@query
def filter_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: texts without the sentences that hold an error."""
    games = G.games(spark, sf_dir)
    return align.filter_references(games.cells, _references(games))


@query
def seq_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of log probabilities up to an end token."""
    rows = G.table(spark, sf_dir, "embeddings")
    ids = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("vec_id") % 64, 2).otherwise(5))
    return rows.select("vec_id", F.round(V.seq_logprob(F.transform("embedding", lambda x: x.cast("double")), ids, F.lit(2)), 6).alias("seq_logprob"))


@query
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games whose text isn't generated yet."""
    texts = G.game_texts(spark, sf_dir)
    return runs.todo(texts.select("id"), texts.filter("yr % 2 = 0").select("id"))


@query
def relations_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A6."""
    games = G.games(spark, sf_dir)
    return _rounded(relations.score_run(relations.score_items(games.texts, _claims(games))))


@query
def wrong_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 by claim type."""
    return relations.wrong_by_type(_claims(G.games(spark, sf_dir)))


@query
def positional_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    games = G.games(spark, sf_dir)
    return _rounded(relations.positional_bias(games.texts, _claims(games), facts.team_facts(games.cells)))


@query
def nli_stub_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim units with premises, labelled by the stand-in scorer."""
    games = G.games(spark, sf_dir)
    closing = F.when(F.col("e") % 2 == 0, " In the end the team that had won was glad.").otherwise(" Nobody there had lost the will to play on.")
    texts = games.texts.withColumn("output", F.concat("output", closing))
    scored = claims.score_with_stub(claims.premises(claims.units(texts), games.cells))
    return _rounded(claims.score_run(claims.score_items(texts, scored)))


@query
def premise_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the premise of every claim unit."""
    games = G.games(spark, sf_dir)
    found = claims.premises(claims.units(games.texts), games.cells)
    return found.select("id", "pos", F.length("unit").alias("unit_chars"), F.length("premise").alias("premise_chars"))


#: Replicates of a bootstrap, and items of a rolling window.
REPLICATES, WINDOW = 10_000, 75
TWO_RUN_METRICS = (
    stats.Metric("num_unsupported", "ratio", ("num_n_unsupported", "num_n_numbers"), False),
    stats.Metric("num_derived", "ratio", ("n_derived", "num_n_numbers"), False),
    stats.Metric("exact_mean", "mean", ("n_exact",), True, False),
    stats.Metric("unsupported_items", "positive", ("num_n_unsupported",), False),
)


def _two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metrics of run A (all texts) and run B (without errors for odd pairs), numbered in the order of ids."""
    texts, cells = G.games(spark, sf_dir)[::-1]
    better = F.when(F.col("pair") % 2 == 1, F.col("reference")).otherwise(F.col("output"))
    a = texts.select("id", F.lit("A").alias("run"), "output")
    both = a.unionByName(texts.select("id", F.lit("B").alias("run"), better.alias("output")))
    keyed = both.select(F.concat_ws("\x1f", "id", "run").alias("key"), "id", "run", "output")
    games = cells.join(keyed.select(F.col("id").alias("ex_id"), "key"), "ex_id").withColumn("ex_id", F.col("key")).drop("key")
    scored = numbers.score_items(keyed.select(F.col("key").alias("id"), "output"), games).withColumnRenamed("id", "key")
    out = keyed.select("key", "id", "run").join(scored, "key")
    out = out.select("id", "run", F.col("n_numbers").alias("num_n_numbers"), (F.col("n_numbers") - F.col("n_supported")).alias("num_n_unsupported"), "n_derived", "n_exact")
    out = staged(out, "items")
    return staged(stats.numbered(out.join(stats.common_ids(out), "id")), "items")


@query
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point values of both runs."""
    return _rounded(stats.points(_two_runs(spark, sf_dir), TWO_RUN_METRICS))


@query
def bootstrap_lcg_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of both runs from 10,000 replicates with weights that SQL can repeat."""
    items = _two_runs(spark, sf_dir)
    return _rounded(stats.bootstrap_ci(items, stats.lcg_weights(spark, _n_items(items), REPLICATES), TWO_RUN_METRICS))


def _n_items(items: DataFrame) -> int:
    return items.agg(F.max("item")).first()[0] + 1


@query
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the runs, paired by item."""
    items = _two_runs(spark, sf_dir)
    return _rounded(stats.paired_diff(items, stats.lcg_weights(spark, _n_items(items), REPLICATES), TWO_RUN_METRICS, "A", "B"))


@query
def bootstrap_counter_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of both runs from 10,000 replicates whose weights each item derives for itself."""
    return _rounded(stats.bootstrap_ci(_two_runs(spark, sf_dir), stats.Draws(REPLICATES), TWO_RUN_METRICS))


@query
def paired_counter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the runs, paired by item, with the same weights."""
    return _rounded(stats.paired_diff(_two_runs(spark, sf_dir), stats.Draws(REPLICATES), TWO_RUN_METRICS, "A", "B"))


@query
def fold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the runs in three folds."""
    items = _two_runs(spark, sf_dir)
    values = stats.fold_points(items, {i: i % 3 for i in range(_n_items(items))}, TWO_RUN_METRICS)
    return _rounded(stats.ranks(values, TWO_RUN_METRICS, ("fold",)))


@query
def fold_rank_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the runs in three folds, or five from 400 items on, of the items in a permuted order."""
    items = _two_runs(spark, sf_dir)
    values = stats.fold_points(items, stats.hashed_folds(items, stats.n_folds(_n_items(items))), TWO_RUN_METRICS)
    return _rounded(stats.ranks(values, TWO_RUN_METRICS, ("fold",)))


@query
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate over the last 75 items."""
    return _rounded(stats.rolling_rate(_two_runs(spark, sf_dir), "num_n_unsupported", "num_n_numbers", WINDOW))


@query
def selection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with the fewest unsupported numbers."""
    values = stats.points(_two_runs(spark, sf_dir), TWO_RUN_METRICS)
    return _rounded(stats.select_best(values, TWO_RUN_METRICS, ("num_unsupported", "num_derived", "exact_mean")))


@query
def sample_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred parts by position."""
    parts = G.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_name")
    return loaders.sample(parts, 100, None)


@query
def box_score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw box scores, with blocks of none given as missing, read into cells."""
    return loaders.rotowire_cells(G.raw_games(spark, sf_dir)).drop("is_int", "str")


@query
def meaning_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaning representations of all parts read into cells."""
    attribute = lambda name, c: F.concat(F.lit(f"{name}["), F.col(c), F.lit("]"))
    parts = G.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.concat_ws(", ", attribute("name", "p_name"), attribute("brand name", "p_brand"), attribute("size", "p_size")).alias("mr"))
    return loaders.e2e_cells(parts.select("id", loaders.parse_mr(F.col("mr")).alias("pairs"))).drop("is_int", "str")


def _as_arrays(batches):
    """Lines of JSON objects as one array per partition."""
    import pyarrow as pa

    held = None
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            lines[0] = ("[" if held is None else ",") + lines[0]
            lines[1:] = ["," + line for line in lines[1:]]
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
    if held is not None:
        lines = held.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([*lines[:-1], lines[-1] + "]"])], names=["value"])


@query
def box_score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw box scores written as files of JSON arrays, read again by byte ranges into cells."""
    folder = shared_folder(spark, "box-scores")
    games = G.raw_games(spark, sf_dir).orderBy("id")
    game = F.to_json(F.struct("game.*", F.split(F.concat(F.lit('A "game" of } '), "id", F.lit(" \\ .")), " ").alias("summary")))
    games.select(game.alias("value")).mapInArrow(_as_arrays, "value string").write.text(folder)
    examples = loaders.load_rotowire(spark, folder, "test")
    cells = loaders.rotowire_cells(examples).drop("is_int", "str")
    said = examples.select(F.col("id").alias("ex_id"), F.col("references")[0].alias("reference"))
    return cells.join(said, "ex_id")


@query
def meaning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as quoted CSV with quotes and line feeds inside, read again by byte ranges, one row per meaning."""
    folder = shared_folder(spark, "meanings")
    name = F.concat(F.lit("name["), F.regexp_replace("p_name", " .*", ""), F.lit("], brand name["), "p_brand", F.lit("]"))
    said = F.concat(F.lit('It is "'), "p_type", F.lit('",\nsize '), F.col("p_size").cast("string"), F.lit("."))
    parts = G.table(spark, sf_dir, "part").orderBy("p_partkey").select(name.alias("MR"), F.when(F.col("p_partkey") % 4 > 0, said).alias("Ref"))
    parts.write.csv(folder, header=True, quote='"', escape='"')
    examples = loaders.load_e2e(spark, folder, "dev")
    values = F.array_join(F.transform("pairs", lambda p: p["value"]), "|").alias("attributes")
    return examples.select("id", "pos", values, F.size("references").cast("long").alias("n_references"), F.array_join("references", "|").alias("said"))


@query
def cell_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, strings and gaps among raw strings made from events."""
    e = G.table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    raw = F.array(n, F.concat(F.lit(" -"), n, F.lit(" ")), F.concat(F.lit("1_0"), n), F.concat(n, F.lit("d")), F.concat(n, F.lit(".50")), F.concat(n, F.lit(",000")), F.concat(F.lit("."), n, F.lit("e2")), F.col("event_type"), F.lit("N/A"), F.concat(F.lit("9000000000000000000"), n))
    cells = e.select("event_id", F.posexplode(raw).alias("pos", "raw")).withColumn("c", V.parse_cell(F.col("raw")))
    return cells.select("event_id", "pos", "c.kind", "c.num", "c.is_int", V.number_text(F.when(F.col("pos") < 9, F.col("c.num")), F.col("c.is_int"), F.col("c.str")).alias("text"))


@query
def report_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on both runs: its chart frame with intervals."""
    items = _two_runs(spark, sf_dir).select("run", "id", "num_n_numbers", "num_n_unsupported")
    found = report.battery(items, ["A", "B"], n_boot=REPLICATES, weights=stats.lcg_weights(spark, items.select("id").distinct().count(), REPLICATES))
    return _rounded(report.panels(found), 6)


@query
def report_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on both runs over relational claims, numbers, BLEU, PARENT and log probabilities, with intervals."""
    games = G.games(spark, sf_dir)
    better = F.when(F.col("pair") % 2 == 1, F.col("reference")).otherwise(F.col("output"))
    items = None
    for run, output in (("A", F.col("output")), ("B", better)):
        texts = staged(games.texts.withColumn("output", output), "texts")
        parent = _rounded(overlap.parent_items(_pairs(texts), games.cells))
        found = numbers.score_items(texts, games.cells)
        rel = relations.score_items(texts, _claims_of(texts, games.cells))
        records = report.item_records(texts, found, rel, parent=parent, bleu=overlap.bleu_items(_pairs(texts)))
        flat = report.flatten(staged(records, "records"), texts.withColumn("seq_logprob", -(F.length("output") % 97) / 97)).withColumn("run", F.lit(run))
        items = flat if items is None else items.unionByName(flat)
    return _rounded(report.panels(report.battery(items, ["A", "B"], n_boot=REPLICATES, weights=stats.Draws(REPLICATES))), 6)


@query
def relations_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: relational claims of each text."""
    games = G.games(spark, sf_dir)
    return relations.score_items(games.texts, _claims(games)).drop("wrong")


@query
def item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all texts as flat columns; numbers derive from columns of any length."""
    games = G.games(spark, sf_dir)
    found = staged(numbers.score_items(games.texts, games.cells, long_columns=True), "numbers")
    rel = staged(relations.score_items(games.texts, _claims(games)), "relations")
    records = report.item_records(games.texts, found, rel, bleu=overlap.bleu_items(_pairs(games.texts)))
    return report.flatten(staged(records, "records"))


@query
def positional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with a wrong winner claim by side, the teams that wrong claims name, and the difference with its bounds."""
    games = G.games(spark, sf_dir)
    return _rounded(relations.positional_report(games.texts, _claims(games), facts.team_facts(games.cells), n_boot=REPLICATES))


@query
def matched_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of even years matched to the examples of pairs below six."""
    texts = G.game_texts(spark, sf_dir)
    kept, missing = runs.match_outputs(texts.filter("yr % 2 = 0").select("id", "output"), texts.filter("pair < 6").select("id"))
    return kept.select("id", F.length("output").alias("n_chars"), F.lit(missing).cast("long").alias("missing"))


@query
def uncertainty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log probability; every fifth text has none."""
    rows = G.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 > 0, F.get("embedding", F.lit(0)).cast("double")).alias("seq_logprob"))
    return _rounded(runs.uncertainty(rows), 6)


@query
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and means as shown, dashes for gaps."""
    x = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") / 64)
    return G.table(spark, sf_dir, "part").select("p_partkey", V.percent(x).alias("rate"), V.fixed3(x).alias("mean"))


@query
def id_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id sequences around the first occurrence of a part."""
    k = F.col("vec_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: (i * (k % 7 + 1)) % 11)
    part = F.slice(ids, F.pmod(k, F.lit(9)).cast("int") + 3, F.lit(2))
    found = G.table(spark, sf_dir, "embeddings").select("vec_id", V.find_subsequence(ids, part).alias("at"), V.split_ids(ids, part).alias("s"))
    return found.select("vec_id", "at", F.size("s.before").alias("n_before"), F.size("s.after").alias("n_after"), F.array_join(F.col("s.after"), ",").alias("after"))


@query
def collated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows padded per batch of ten."""
    k = F.col("vec_id")
    ids = lambda base, n: F.transform(F.sequence(F.lit(1), n), lambda i: (i + base).cast("int"))
    rows = G.table(spark, sf_dir, "embeddings").select("vec_id", F.floor(k / 10).alias("batch"), ids(F.lit(100), k % 4 + 1).alias("prefix"), ids(F.lit(200), k % 3 + 1).alias("suffix"), ids(F.lit(300), k % 6 + 1).alias("ref"), ids(F.lit(400), k % 5 + 1).alias("table_ids"))
    out = features.collate(rows, 3, 0)
    return out.select("vec_id", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "labels", "attention", "soft_pos")])


@query
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of all games with their texts as references, filtered, cut at thirty ids and packed; an id per token."""
    games = G.games(spark, sf_dir)
    examples = games.texts.select(F.col("id").alias("ex_id"), F.array("output").alias("references"))
    ids = lambda text: F.transform(T.tokens(text), lambda t: F.length(t) + 10)
    prompt = dataset.split_prompt([1, 5, 9, 9, 7], [9, 9])
    rows = dataset.pack(staged(dataset.training_rows(examples, games.cells, ids, prompt, 2, "augmentation", True, 1, 30), "rows"), 4000)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("ex_id", "ref", F.size("ref_ids").alias("n_ref_ids"), total("ref_ids").alias("ref_sum"), F.size("table_ids").alias("n_table_ids"), F.size("aux_labels").alias("n_cells"), total("aux_labels").alias("n_mentioned"), "block", "batch")


@query
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents read and written again as one nested record each."""
    e = G.table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", "p.k", F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("p.k").alias("n")).alias("inner"))).alias("record"))
