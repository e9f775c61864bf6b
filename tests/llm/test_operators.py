"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_expand, decontaminate, elias_fano, html_extract, jaccard_join, ngram_lm, piece_lattice, quality_rules, token_counts, token_files, unitmap, url_cascade
from factloom.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCS = "doc_id long, text string, lang string, source string, n_words string"


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def corpus() -> list[tuple]:
    base = text(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base), (1, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "one two"), (6, "One, two!"), (7, text(2, 20_000)), (8, text(3, 90) + "\n\n" + text(3, 90)),
        (9, "don't  stop\tit's\n\n  we'll 'sabc émile ﬁ ① 漢字 \U0001f600 <|endoftext|> x" + "y" * 3000), (None, text(4, 60)), (10, "\n \t "), (11, text(5, 30) + " " + base),
    ]
    return [(i, t, "en", "s", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    folder, index = token_files.write_tokens(docs, path)
    got = [tuple(r) for r in token_files.read_tokens(folder, index).orderBy("start").collect()]
    want, at = [], 0
    for i, t, *_ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    shard = index.agg({"shard": "max"}).first()[0]
    opened = token_files.Shard(token_files.shard_uri(folder, shard))
    n = index.filter(f"shard = {shard}").agg({"n_tokens": "sum"}).first()[0]
    last = -(-n // token_files.SEQUENCE) - 1
    assert np.unpackbits(opened.mask(last), bitorder="little").sum() == n - last * token_files.SEQUENCE
    assert (opened.sequence(0)[: min(n, 2048)] == opened.read(0, min(n, 2048))).all()


@pytest.mark.parametrize("t", ["", " ", "  a", "a  ", "a\n\nb", "'s", "''s", "x's's", "don't'll", " 's", "\n's", "1'd2", "a'", "ab'reb", "é'S", "  a b", "a\x1cb"])
def test_split_points_follow_the_library(t):
    from tokenizers import Tokenizer

    points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    starts = token_files.split_points(points, np.array([0, len(points)])) if t else []
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).pre_tokenizer
    assert list(starts) == [a for _, (a, _) in library.pre_tokenize_str(t)]


def brute_links(texts):
    tr = str.maketrans(UPPER, UPPER.lower())
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(tr)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in words]
    return [{j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)} for i, a in enumerate(sets)]


def test_shards_are_opened_in_place_and_once_for_several_chunks(spark, monkeypatch):
    texts = spark.createDataFrame([(text(i, 60),) for i in range(60)], "text string")
    model = ngram_lm.train(texts, shard_tokens=200)
    level = model.levels[0]
    rng = np.random.default_rng(3)
    asked = []
    for _ in range(5):
        pairs = sorted(set(zip(rng.integers(0, model.distinct, 400).tolist(), rng.integers(0, model.distinct, 400).tolist(), strict=True)))
        asked.append((np.array([c for c, _ in pairs]), np.array([w for _, w in pairs], np.uint64)))
    alone = [ngram_lm.look_up_children(level, [a])[0] for a in asked]
    opened, real = [], ngram_lm._open
    monkeypatch.setattr(ngram_lm, "_open", lambda uri: opened.append(uri) or real(uri))
    together = ngram_lm.look_up_children(level, asked)
    assert len(opened) == len(set(opened)) > 5
    assert any((nodes >= 0).any() for nodes, _, _ in together)
    for one, other in zip(alone, together, strict=True):
        assert all((x == y).all() for x, y in zip(one, other, strict=True))
    arrays = elias_fano.load(level.uri(0))
    shard = elias_fano.EliasFano.load(arrays, "children")
    assert np.shares_memory(shard.starts, arrays["children.starts"])


def test_jaccard_join(docs):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_links) for r in jaccard_join.join_report(docs).collect())
    links = brute_links([t for _, t, *_ in corpus()])
    want = sorted((i is not None, i or 0, len(x)) for (i, *_), x in zip(corpus(), links, strict=True))
    assert got == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 7, 8, 9, 10, 11]


def test_a_node_of_many_edges_brings_one_into_the_steps(spark, monkeypatch):
    sizes, stage = {}, jaccard_join.stage

    def counted(df, label, **options):
        out = stage(df, label, **options)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    # 300 nodes that meet in 20 groups each, and a pair apart.
    edges = [(100 + i, 1 + (i + k) % 40) for i in range(300) for k in range(20)] + [(9000, 8000)]
    got = jaccard_join.minimum_labels(spark.createDataFrame(edges, "a long, b long"), "a", "b", 1000)
    want = {n: 8000 if n >= 8000 else 1 for e in edges for n in e}
    assert {r.node: r.label for r in got.collect()} == want
    assert sizes["edges"] <= 2 * (300 + 2 * 40 * 20) and sizes["edges"] < len(edges)


def test_large_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = text(9, 100).split()
    rows = []
    for i in range(23):
        w = list(base)
        w[3 * i + 10] = f"new{i}"
        rows.append((i, " ".join(w), "en", "s", ""))
    df = spark.createDataFrame(rows, DOCS)
    want = [len(x) for x in brute_links([r[1] for r in rows])]
    for most in (jaccard_join.MOST_COMPONENT, 2):  # by component, then by bucket
        monkeypatch.setattr(jaccard_join, "MOST_COMPONENT", most)
        got = {r.doc_id: r for r in jaccard_join.join_report(df).collect()}
        assert [got[i].n_links for i in range(23)] == want
        assert {r.class_id for r in got.values()} == {0}


@pytest.mark.parametrize("threshold", [(4, 5), (3, 5), (2, 5)])
def test_links_at_other_thresholds(spark, threshold):
    """Copies changed ever more: at each threshold just the pairs at or over it link, those on its border included."""
    base = [f"w{i}" for i in range(64)]
    texts = [" ".join(w if (i % (60 // k)) or k == 1 else f"x{k}{i}" for i, w in enumerate(base)) for k in range(1, 9)]
    texts += [" ".join(f"w{i}" for i in range(a, a + 24)) for a in (100, 102, 105, 110)]  # 20 five-word windows, 2, 5 and 10 of them moved
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    num, den = threshold
    want = {i: sum(j != i and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    df = spark.createDataFrame([(i, t, "en", "s", "") for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.n_links for r in jaccard_join.join_report(df, threshold=threshold).collect()} == want
    assert sum(want.values()) >= 2


PIECES = "piece_bpe_32k.model"
#: Each operator over an empty table, by name.
ON_NOTHING = {
    "op1": lambda none, bench: token_files.read_tokens(*token_files.write_tokens(none, tokenizer_path("byte_bpe_50k.json"))),
    "op2": lambda none, bench: jaccard_join.join_report(none),
    "op2 one of each": lambda none, bench: jaccard_join.keep_one(none),
    "op3": lambda none, bench: piece_lattice.encode(none, tokenizer_path(PIECES)),
    "op3 both ways": lambda none, bench: piece_lattice.encode_decode(none, tokenizer_path(PIECES)),
    "op4": lambda none, bench: html_extract.extract_pages(none.sparkSession.createDataFrame([], "page_id long, url string, html string")),
    "op5": lambda none, bench: ngram_lm.train_and_score(none),
    "op6": lambda none, bench: decontaminate.find_matches(none, bench),
    "op6 removing": lambda none, bench: decontaminate.remove_contaminated(none, bench),
    "op7": lambda none, bench: token_counts.count_tokens(none, tokenizer_path(PIECES)),
    "op8": lambda none, bench: url_cascade.judge_urls(none.sparkSession.createDataFrame([], "page_id long, url string"), none.sparkSession.createDataFrame([], "host string")),
    "op9": lambda none, bench: quality_rules.quality_report(none),
    "op9 applied": lambda none, bench: quality_rules.apply_rules(none),
    "op10": lambda none, bench: chat_expand.digests(chat_expand.expand(none.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string"))),
}


@pytest.mark.parametrize("name", ON_NOTHING)
def test_empty_tables(spark, name):
    bench = spark.createDataFrame([(1, text(1, 30))], "item_id long, text string")
    assert ON_NOTHING[name](spark.createDataFrame([], DOCS), bench).count() == 0


def test_decontamination(spark, docs):
    items = [(1, text(1, 40)), (1, text(1, 40)), (2, "one two"), (3, None), (None, text(4, 60)), (4, "nowhere " * 20), (5, "CHANGED")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tr = str.maketrans(UPPER, UPPER.lower())
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(tr))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[a : a + 13])].add("" if i is None else str(i))
    want = []
    for i, t, *_ in corpus():
        w = cut(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    hit[a : a + n] = [True] * n
                    found |= windows[key]
        n = sum(hit)
        want.append((i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    report = decontaminate.contamination_report(docs, bench)
    assert rows_of(report.drop("longest")) == sorted(want, key=repr)
    assert report.filter("doc_id = 0").first().longest == 40
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontaminate.find_matches(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_suffix_array_and_the_place_of_the_longest_match(spark):
    rng = np.random.default_rng(3)
    words, rows = rng.integers(1, 4, 300).astype(np.uint64), np.array([0, 0, 120, 121, 300])
    shard = decontaminate.Shard(words, rows)
    ends = np.repeat(rows[1:], np.diff(rows))
    cut = lambda p: words[p : min(p + 13, ends[p])].tolist()
    in_order = [cut(p) for p in shard.array.tolist()]
    assert in_order == sorted(in_order) and sorted(shard.array.tolist()) == list(range(300))
    item = text(31, 60).split()
    told = [*text(32, 20).split(), *item[5:40], *text(33, 9).split(), *item[10:30]]
    docs = spark.createDataFrame([(1, " ".join(told)), (2, " ".join(item[:13])), (3, " ".join(item[:12]))], "doc_id long, text string")
    found = {r.doc_id: r.matches for r in decontaminate.find_matches(docs, spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")).collect()}
    assert [tuple(m) for m in found[1]] == [("a", 20, 5, 35)] and [tuple(m) for m in found[2]] == [("a", 0, 0, 13)] and found[3] == []


def test_pieces_equal_the_library_and_decode(docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.ids, r.text) for r in piece_lattice.encode_decode(docs, path).collect()), key=repr)
    want = sorted(((i is not None, i or 0, library.encode(t or ""), t or "") for i, t, *_ in corpus()), key=repr)
    assert got == want
    separate = piece_lattice.decode(piece_lattice.encode(docs, path), path)
    assert sorted((r.text for r in separate.collect())) == sorted(t or "" for _, t, *_ in corpus())


def test_long_units(spark):
    """Stretches without a place to cut take a time that grows with their length, and give the library's ids."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), unitmap.load_pieces(path)
    rng = np.random.default_rng(11)
    signs = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/é漢"))
    blob = "".join(rng.choice(signs, 30_000))
    rows = [(1, blob), (2, "a" * 5000), (3, f"before {blob[:2000]} after"), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.text) for r in piece_lattice.encode_decode(docs, path).collect()}
    assert got == {i: (library.encode(t), t) for i, t in rows}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert counts[4] == token_counts.TrieWalk(vocabulary)("▁short") and counts[1] > 5000
    for unit in ("▁abcabcaba" * 7, blob[:400]):
        assert len(piece_lattice.best_path(unit, vocabulary)) == token_counts.TrieWalk(vocabulary)(unit)


def test_viterbi_fold_against_brute_force(spark):
    pieces = ["a", "b", "ab", "ba", "aba", "c", "bc", "abc"]
    scores = [-3.0, -3.0, -4.0, -4.5, -6.0, -2.0, -5.5, -6.0]
    vocabulary = unitmap.Pieces(pieces, list(range(300, 308)), scores, 3, [])
    units = ["a", "abab", "ababc", "xab", "aé", "abcabcaba"]
    unknown = min(scores) - piece_lattice.UNKNOWN_PENALTY

    def best(u: str) -> tuple[float, int]:
        if not u:
            return 0.0, 0
        options = [(best(u[len(p) :]), s, 1) for p, s in zip(pieces, scores, strict=True) if u.startswith(p)]
        if u[0] not in pieces:
            options.append((best(u[1:]), unknown, len(u[0].encode())))
        return max(((x + s, y - n) for (x, y), s, n in options), default=(-math.inf, 0))

    df = spark.createDataFrame([(u,) for u in units], "unit string").repartition("unit")
    got = {r.unit: list(r.ids) for r in piece_lattice.unit_ids(df, vocabulary, "unigram").collect()}
    trie = token_counts.TrieWalk(vocabulary)
    for u in sorted(units):
        assert len(got[u]) == -best(u)[1] == trie(u), u
        assert b"".join(bytes([i - 3]) if i < 300 else pieces[i - 300].encode() for i in got[u]).decode() == u
    assert trie.steps < sum(map(len, units))


def test_token_counts(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    vocabulary = unitmap.load_pieces(path)
    scores, unknown = dict(zip(vocabulary.pieces, vocabulary.scores, strict=True)), min(vocabulary.scores) - 10
    want = []
    for i, t, *_ in corpus():
        s = "▁" + t.replace(" ", "▁") if t else ""
        best = [(0.0, 0)]
        for e in range(1, len(s) + 1):
            options = [(best[a][0] + scores[s[a:e]], best[a][1] - 1) for a in range(max(0, e - 16), e) if s[a:e] in scores]
            if s[e - 1] not in scores:
                options.append((best[e - 1][0] + unknown, best[e - 1][1] - len(s[e - 1].encode())))
            best.append(max(options))
        want.append((i, -best[-1][1]))
    assert rows_of(token_counts.count_tokens(docs, path).select("doc_id", "n_tokens")) == sorted(want, key=repr)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values in ([], [0], [7, 7, 7], rng.integers(0, 1 << 63, 5000), rng.integers(0, 60, 300), [3, 2**64 - 1]):
        v = np.sort(np.array(values, np.uint64))
        seq = elias_fano.EliasFano.load({f"x.{k}": a for k, a in elias_fano.EliasFano.encode(v).items()}, "x")
        assert (seq.get(np.arange(len(v))) == v).all()
        probe = np.unique(np.concatenate([v, v + np.uint64(1), np.array([0, 5, 2**63], np.uint64)]))
        assert (seq.successor(probe) == np.searchsorted(v, probe)).all()


def test_language_model(docs):
    got = {(r.doc_id, r.n_tokens): r for r in ngram_lm.train_and_score(docs).collect()}
    tr = str.maketrans(UPPER, UPPER.lower())
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(tr)), None]) for i, t, *_ in corpus()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in words if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words:
        r = got[i, len(ws)]
        assert r.train_tokens == n and r.held_out == out(i) and r.n_known == sum(c[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    seen = got[7, 20_001]
    assert seen.score > seen.base_score


def test_language_model_interpolates_all_ngrams(spark):
    rows = [(i, t) for i, t, *_ in corpus()] + [(20 + i, text(60 + i, 40)) for i in range(12)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tr = str.maketrans(UPPER, UPPER.lower())
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(tr)), None]) for i, t in rows]
    grams, types = collections.Counter(), collections.Counter()
    for i, ws in docs:
        padded = [None, *ws]
        for k in range(1, len(padded)) if not out(i) else ():
            grams.update(tuple(padded[a : k + 1]) for a in range(max(0, k - 2), k + 1))
    for g in grams:
        types[g[:-1]] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(g: tuple) -> float:
        if len(g) == 1:
            return (grams[g] + 1) / (n + v + 1)
        c, d = g[:-1], ngram_lm.DISCOUNT
        return max(grams[g] - d, 0) / grams[c] + d * types[c] / grams[c] * p(g[1:]) if types[c] else p(g[1:])

    assert any(c == 1 and len(g) == 2 for g, c in grams.items()) and any(c == 1 and len(g) == 3 for g, c in grams.items())
    table = spark.createDataFrame(rows, "doc_id long, text string")
    # 300 splits frequent contexts over shards; with words of 56 bits, contexts and words don't fit 64 bits together.
    assert sum(len(g) == 2 for g in grams).bit_length() + 56 > 64
    for shard_tokens, word_bits in ((ngram_lm.SHARD_TOKENS, 0), (300, 0), (ngram_lm.SHARD_TOKENS, 56)):
        got = {(r.doc_id, r.n_tokens): r.score for r in ngram_lm.train_and_score(table, shard_tokens=shard_tokens, word_bits=word_bits).collect()}
        for i, ws in docs:
            padded = [None, *ws]
            want = sum(math.log10(p(tuple(padded[max(0, k - 2) : k + 1]))) for k in range(1, len(padded)))
            assert math.isclose(got[i, len(ws)], want, abs_tol=2.5e-4 * len(ws)), i  # probabilities are kept in log bins


def test_language_model_of_other_texts(spark):
    texts = spark.createDataFrame([(text(70 + i, 200),) for i in range(20)], "body string")
    model = ngram_lm.train(texts, "body", shard_tokens=200)
    assert any(len(x.split) for x in model.levels) and model.total == 20 * 201
    own = spark.createDataFrame([(1, text(70, 200)), (2, text(90, 200)), (3, "unseen words only"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(own, model).collect()}
    assert got[1].score > max(got[2].score, got[1].base_score) and got[3].n_known == 1 and got[4].n_tokens == 1
    assert all(r.score < 0 for r in got.values())


def test_longer_contexts_help_on_held_out_documents(spark):
    """Texts in which each word follows from the one before nine times out of ten."""
    rng = np.random.default_rng(17)
    names = [a + b for a in WORDS for b in WORDS[:5]]
    after = rng.permutation(len(names))
    rows = []
    for i in range(150):
        w = [int(rng.integers(len(names)))]
        for _ in range(80):
            w.append(int(after[w[-1]]) if rng.random() < 0.9 else int(rng.integers(len(names))))
        rows.append((i, " ".join(names[k] for k in w)))
    scored = ngram_lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for held in (True, False):
        mine = [r for r in scored if r.held_out == held]
        assert mine and sum(r.score for r in mine) > 0.6 * sum(r.base_score for r in mine)
    per_token = lambda held: sum(r.score for r in scored if r.held_out == held) / sum(r.n_tokens for r in scored if r.held_out == held)
    assert per_token(False) > per_token(True) > -1.2


def test_quality_rules(spark, docs):
    got = rows_of(quality_rules.quality_report(docs).drop("kept"))
    want = []
    for i, t, *_ in corpus():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        inside = [False] * len(w)
        for a in range(len(w) - 2):
            if c[tuple(w[a : a + 3])] > 1:
                inside[a : a + 3] = [True] * 3
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = sum(inside)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got == sorted(want, key=repr)
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns
    plain = [(i, text(i, 80 + i), "en" if i % 3 else None, "s", "") for i in range(60)]
    junk = [(100, " ".join(w + "$$$" for w in text(100, 80).split()), "en", "s", "")]
    left = {r.doc_id for r in quality_rules.apply_rules(spark.createDataFrame(plain + junk, DOCS)).collect()}
    failed = {r.doc_id for r in quality_rules.quality_report(spark.createDataFrame(plain + junk, DOCS)).filter("base_failed").collect()}
    assert left == set(range(60)) - failed and 100 not in failed


def symbols(seed: int, n: int, share: float) -> str:
    """Words of which a share ends in three signs."""
    rng = np.random.default_rng(seed)
    return " ".join(w + "$$$" * (rng.random() < share) for w in rng.choice([a + b for a in WORDS for b in WORDS], n))


@pytest.mark.parametrize(("size", "junk"), [(400, 0.05), (400, 0.15), (400, 0.3), (400, 0.9), (40, 0.15)])
def test_junk_does_not_move_its_own_fence(spark, size, junk):
    """One source has the given share of junk, whose symbol ratio is up to 0.35; another of its language is clean."""
    bad = int(size * junk)
    rows = [(i, symbols(i, 90, 0.2 + 0.8 * i / bad if i < bad else 0.0), "en", "dirty", "") for i in range(size)]
    rows += [(1000 + i, symbols(1000 + i, 90, 0.0), "en", "clean", "") for i in range(500)]
    report = quality_rules.quality_report(spark.createDataFrame(rows, DOCS)).filter("NOT base_failed").collect()
    ratio = {r.doc_id: r.n_symbols / r.word_chars for r in report}
    dropped = {r.doc_id for r in report if not r.kept}
    assert not any(ratio[i] == 0 for i in dropped)
    assert dropped >= {i for i, x in ratio.items() if x > 0.2} and (junk > 0.5 or dropped >= {i for i, x in ratio.items() if x > 0.11})


def test_a_source_is_judged_by_its_own_style(spark):
    styles = {"plain": 0.0, "code": 0.4}
    rows = [(k * 1000 + i, symbols(k * 1000 + i, 90, share), "en", name, "") for k, (name, share) in enumerate(styles.items()) for i in range(500 - 300 * k)]
    rows += [(5000, symbols(5000, 90, 0.4), "en", "plain", ""), (5001, symbols(5001, 90, 0.4), None, None, "")]
    report = {r.doc_id: r for r in quality_rules.quality_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(r.kept for i, r in report.items() if i < 5000 and not r.base_failed) and not report[5000].kept
    assert 0.1 < report[5000].n_symbols / report[5000].word_chars < 0.2


def test_sketches_beyond_their_exact_size(spark):
    """Quartiles of more values than a sketch holds: within 1% of the rank."""
    columns = [*quality_rules.RATIOS, *quality_rules.SIZES]
    values = spark.range(60_000).select(*[F.lit(x).alias(f"_q_{x}") for x in ("lang", "source")], F.lit(False).alias("_q_base_failed"), *[F.sqrt(F.col("id") / 60_000).alias(f"_q_{r}") for r in columns])
    own = quality_rules.spreads(values.repartition(7)).first().own
    low, mid, high = (q**0.5 for q in (0.25, 0.5, 0.75))
    for r in columns:
        assert abs(own[f"mid_{r}"] - mid) < 0.01
    for r in quality_rules.RATIOS:
        assert abs(own[f"half_{r}"] - min(high - mid, mid - low)) < 0.02


def test_widths_follow_the_group_and_the_text(spark):
    """Two sources of one language: where lines repeat in every text, more of it is usual; few events tell nothing in a short text."""
    def lined(seed: int, lines: int, repeated: int) -> str:
        rng = np.random.default_rng(seed)
        made = [" ".join(rng.choice([a + b for a in WORDS for b in WORDS], 12)) for _ in range(lines)]
        return "\n".join(made + [made[k] for k in range(repeated)])

    rows = [(i, lined(i, 60, 0), "en", "books", "") for i in range(300)] + [(1000 + i, lined(i, 60, 2 + i % 9), "en", "lyrics", "") for i in range(300)]
    rows += [(5000, lined(7, 60, 16), "en", "books", ""), (5003, lined(7, 60, 16), "en", "lyrics", ""), (5001, lined(8, 60, 2), "en", "books", ""), (5002, lined(9, 4, 1), "en", "books", "")]
    report = {r.doc_id: r.kept for r in quality_rules.quality_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(report[i] for i in report if i < 5000)
    assert (report[5000], report[5001], report[5002], report[5003]) == (False, True, True, True)


@pytest.mark.parametrize("kind", ["local", "parquet", "failing"])
def test_quality_rules_with_nothing_to_learn_from(spark, tmp_path, kind):
    rows = [(i, f"three short words{i % 4}", "en", f"s{i % 2}", "") for i in range(20)] if kind == "failing" else []
    df = spark.createDataFrame(rows, DOCS)
    if kind == "parquet":
        df.write.parquet(str(tmp_path / "none"))
        df = spark.read.parquet(str(tmp_path / "none"))
    report = quality_rules.quality_report(df)
    assert [(r.base_failed, r.kept) for r in report.collect()] == [(True, False)] * len(rows)
    kept = quality_rules.apply_rules(df)
    assert kept.columns == df.columns and kept.count() == 0


def plain_pages(n_hosts: int = 12, n_pages: int = 25) -> list[tuple[int, str, str, list[str]]]:
    """(page_id, url, html, blocks): hosts of plain divs, without article, main or telling names. Beside the article each page
    holds two columns of paragraphs about other pages, which on a third of the pages are longer than the article."""
    rng = np.random.default_rng(23)
    names = [a + b for a in ("al", "be", "co", "du") for b in ("ro", "ni", "sa")]
    rows = []
    for h in range(n_hosts):
        body, one, two = rng.permutation(names)[:3]
        for k in range(n_pages):
            short = k % 3 == 0
            blocks = [f"Title {h} {k} " + text(1000 * h + k, 4)] + [text(5000 + 100 * h + 7 * k + j, 14) for j in range(2 if short else 9)]
            other = [[text(9000 + 37 * h + 11 * k + j + 500 * c, 16) for j in range(4)] for c in range(2)]
            ps = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
            article = f'<div class="{body}"><h1>{blocks[0]}</h1>{ps(blocks[1:])}</div>'
            html = f'<html><body><div class="{one}">{ps(other[0])}</div><div class="page">{article}</div><div class="{two}">{ps(other[1])}</div></body></html>'
            rows.append((h * n_pages + k, f"https://h{h}.example.net/{k}", html, blocks))
    return rows


def block_scores(rows, texts: dict[int, str]) -> tuple[float, float]:
    """Precision and recall of blocks."""
    right = got = want = 0
    for i, _, _, blocks in rows:
        found = texts[i].split("\n") if texts[i] else []
        right, got, want = right + len(set(found) & set(blocks)), got + len(found), want + len(blocks)
    return right / got, right / want


def test_votes_find_articles_that_single_pages_miss(spark):
    rows = plain_pages()
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)
    voted = block_scores(rows, {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()})
    alone = block_scores(rows, {i: html_extract.extract(page, []) for i, _, page, _ in rows})
    print(f"blocks with votes: precision {voted[0]:.3f}, recall {voted[1]:.3f}; without: {alone[0]:.3f}, {alone[1]:.3f}")
    assert min(voted) > 0.99 and min(alone) < 0.9


@pytest.mark.parametrize("most", [url_cascade.MOST_FILTER_BYTES, 1000])
def test_a_long_list_takes_several_levels(spark, monkeypatch, most):
    """100,000 hosts of which a list of 33,334 and as many absent ones holds a third; the same by filters and, beyond their bound, by join."""
    monkeypatch.setattr(url_cascade, "MOST_FILTER_BYTES", most)
    name = lambda n: F.concat(F.lit("h"), n.cast("string"), F.lit(".example.net"))
    pages = spark.range(100_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://"), name(F.col("id")), F.lit("/x")).alias("url"))
    listed = spark.range(0, 100_000, 3).select(name(F.col("id")).alias("host")).union(spark.range(200_000, 233_334).select(name(F.col("id")).alias("host")))
    cascade = url_cascade.Cascade(pages.select(url_cascade.host_of(F.col("url")).alias("host")), listed)
    assert (cascade.fits and len(cascade.levels) >= 3) if most > 1000 else not cascade.fits
    judged = url_cascade.judge_urls(pages, listed, rules=())
    assert judged.count() == 100_000 and judged.filter((F.col("verdict") == "block") != (F.col("page_id") % 3 == 0)).isEmpty()


def test_url_cascade_is_exact(spark):
    hosts = [f"h{i}.example.net" for i in range(700)]
    urls = [(i, f"http://{h.upper()}/a?b#c") for i, h in enumerate(hosts)] + [(900, None), (901, "nothing"), (902, "http://x.org/es/1"), (903, "https://example.org/es/"), (904, "http://a.example.org/en/12?q"), (905, "://com/fr/"), (906, "http://b.com#/de/"), (907, "http://b.com/de/")]
    pages = spark.createDataFrame(urls + urls[:5], "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in hosts[::7]] + [("unseen.example",)] * 2, "host string")
    got = url_cascade.judge_urls(pages, listed).collect()
    assert len(got) == len(urls) + 5
    verdict = {r.page_id: (r.rule, r.verdict) for r in got}
    assert all(verdict[i] == (None, "block" if i % 7 == 0 else "allow") for i in range(700))
    assert [verdict[i] for i in range(900, 908)] == [(None, "allow"), (None, "allow"), ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), (None, "allow"), ("com/de/", "block")]
    assert {r.host for r in got if r.page_id in (900, 901)} == {""}
    assert all(r.verdict == "allow" for r in url_cascade.judge_urls(pages.limit(20), listed.limit(0)).collect())


def test_html_extraction(spark):
    page = lambda body, extra="": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='x'>menu</a></nav><div class='ad box'>buy</div>{body}<div class='comments'><p>I think so</p></div>{extra}<footer>&copy; x</footer></body></html>"
    rows = [
        (1, "http://h/1", page("<div class='post a1'><h1>A  &amp;\n B</h1><p>first <b>bold</b> text<br>goes on<p>second one that is long enough</div>")),
        (2, "http://h/2", page("<div class='post a2'><p>x</p></div><div class='side'><p>a much longer sidebar text that would win alone</p></div>")),
        (3, "http://h/3", page("<div class='post a3'><p>third page of the host with a long paragraph</p><!-- no --><script>var t='</p>';</script></div>")),
        (4, None, None), (5, "http://g/", ""), (6, "http://g/2", "plain &lt;text&gt; without markup"), (7, "http://g/3", "<p>cut off &am"), (1, "http://h/1", "<article>again</article>"),
    ]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    texts = dict((i, t) for i, t, _ in got if t != "again")
    assert all(n == len(t) for _, t, n in got) and len(got) == len(rows)
    assert texts == {1: "A & B\nfirst bold text goes on\nsecond one that is long enough", 2: "x", 3: "third page of the host with a long paragraph", 4: "", 5: "", 6: "plain <text> without markup", 7: "cut off &am"}


def extracted(page: str, paths: list[str] | None = None) -> list[str]:
    return html_extract.extract(f"<html><body>{page}</body></html>", paths or []).split("\n")


def test_blocks_beside_the_best_container_stay():
    long = "a long body of the article " * 20
    body, want = f"<div class=content><p>{long}</p></div>", long.strip()
    assert extracted(f"<article><h1>Title</h1><p>lead</p>{body}</article>") == ["Title", "lead", want]
    assert extracted(f"<article><h1>Title</h1><p>lead</p>{body}</article>", ["html>body>article>div.content"]) == ["Title", "lead", want]
    assert extracted(f"<article><div class=intro><p>first</p></div>{body}</article><div class=side>more</div>") == ["first", want]
    assert extracted(f"<div class=wrap><div class=intro><h1>T</h1>first</div>{body}</div><div class=side>more</div>") == ["T", "first", want]
    assert extracted(f"<main><div class=rest><p>end</p></div>{body}</main><div class=side>more</div>") == ["end", want]
    assert extracted(f"<h1>Title</h1><p>lead</p>{body}") == ["Title", "lead", want]
    assert extracted(f"{body}<div class=side><p>more</p></div>") == [want]
    assert extracted(f"<div class=wrap>{body}<ul><li><a href=x>elsewhere</a></li></ul></div>") == [want]


def test_content_is_not_dropped_by_name():
    page = (
        "<article><h1>Title</h1><h2 id='related-work'>Related work</h2><p class='notice'>seen</p><section id='market-share'><p>shares</p></section>"
        "<section id='comments'><p>on form</p></section><div class='share-price'>12</div><div id='related-work'>older</div><ul><li id='form'>item</li></ul>"
        "<figure><figcaption>caption</figcaption></figure><p>so <math><mi>x</mi></math> is <svg><text>drawn</text></svg> <object>fallback</object></p>"
        "<div id='comments'>reply</div><div class='related-posts'>others</div><div class='site-footer2'>end</div></article>"
    )
    assert extracted(page) == ["Title", "Related work", "seen", "shares", "on form", "12", "older", "item", "caption", "so x is drawn fallback"]


def test_an_article_keeps_its_own_header():
    page = "<header><p>site</p></header><div class='page-header'>logo</div><article><header><h1>Title</h1><p>lead</p></header><div class='entry-header'>by line</div><p>body of it</p><footer>tags</footer></article>"
    assert extracted(page) == ["Title", "lead", "by line", "body of it"]


def test_a_stray_vote_for_an_ancestor_does_not_count(spark):
    side = "<div class=side><p>unmarked sidebar</p></div>"
    rows = [(i, "http://h/", f"<html><body><div class=post><p>{text(i, 30)}</p></div>{side}</body></html>") for i in range(20)]
    rows.append((20, "http://h/", f"<html><body>{text(20, 30)}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_extract.host_paths(pages).first().paths == ["html>body>div.post", "html>body"]
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got == {i: text(i, 30) for i in range(21)}


def test_pages_that_are_deep_long_tied_or_have_other_columns(spark):
    import tracemalloc

    deep = "<div>" * 8000 + "".join(f"<p>word {k}</p></div>" for k in range(8000))
    tracemalloc.start()
    assert html_extract.extract(deep, ["div>div"]).count("\n") == 7999
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    long = "".join(f"<p>paragraph {k} of the page</p>" for k in range(30_000))
    assert extracted(f"<article>{long}</article>")[-1] == "paragraph 29999 of the page"
    assert extracted("<div class=a><p>one two</p></div><div class=b><p>two one</p></div>") == ["one two"]
    rows = [(1, "http://h/", "<article><p>body</p></article>", "x", "y", 3)] * 2 + [(2, "http://h/", None, None, "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths string, n_chars int")
    assert rows_of(html_extract.extract_pages(pages)) == [(1, "http://h/", "body", 4)] * 2 + [(2, "http://h/", "", 0)]


def test_text_of_the_generated_pages(spark):
    """Every generated page is an article of a heading and paragraphs among menus, adverts and comments."""
    import html
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(f"{folder}/pages.parquet"):
        pytest.skip("no generated pages here")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.findall(r"(?s)<article>(.*?)</article>", r.html or "")
        parts = re.split(r"</?(?:h1|p)>", inner[0]) if inner else []
        flat = [" ".join(html.unescape(re.sub(r"(?s)<!--.*?-->|<br>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in parts]
        if inner and not any("<" in re.sub(r"<!--.*?-->|</?b>|<br>", "", x) for x in parts):
            assert got[r.page_id] == "\n".join(x for x in flat if x), r.page_id


def test_chat_expansion(spark):
    bad = "</s>[INST] ok [/INST] \\ \\<s> <<SYS>>"
    turns = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 1, "assistant", bad), (1, 2, "user", None), (1, 3, "assistant", "é" * 5000), (2, 0, "system", "only"), (None, 0, None, "x"), (3, None, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat_expand.expand(df)
    got = {r.conv_id: r for r in chat_expand.digests(out).collect()}
    for conv in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == conv]
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
    context, target = chat_expand.render(out, 1, 1)
    assert chat_expand.unescape(target) == bad and context.startswith("<s>user[INST]") and "</s>[INST] ok" not in context
    assert got[1].n_examples == 3


def test_chat_examples_hold_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(chat_expand, "EXAMPLE_CHARS", 50)
    turns = [(c, k, "assistant" if k % 2 else "user", f"{c} <s> {k}" if k != 3 else None) for c in (1, 2, None) for k in range(7)] + [(3, 0, "user", "alone")]
    out = chat_expand.expand(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    want = []
    for c in (1, 2, None):
        stream = ""
        for _, k, role, t in (t for t in turns if t[0] == c):
            segment, a, b = chat_expand.format_turn(role, t or "")
            if role == "assistant":
                want.append((c, k, stream + segment[:a], segment[a:b]))
            stream += segment
    assert rows_of(chat_expand.examples(out)) == sorted(want, key=repr)
    assert chat_expand.examples(out.limit(0)).count() == 0


def test_other_columns_with_clashing_names(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x", True, "h", "p", "r", "v", "f")] * 2, "page_id long, url string, in_list boolean, host string, path string, r string, verdict string, f string")
    assert rows_of(url_cascade.judge_urls(urls, spark.createDataFrame([("a.org", 3)], "host string, r int"))) == [(1, "a.org", "/x", "org/", "allow")] * 2
    turns = spark.createDataFrame([(1, 0, "user", "q", "s", 9, "t", 5), (1, 1, "assistant", "a", None, None, "t", 5)], "conv_id long, turn long, role string, text string, segment string, ordinal long, target string, stream_from long")
    assert rows_of(chat_expand.examples(chat_expand.expand(turns))) == [(1, 1, "<s>user[INST]q[/INST]</s><s>assistant[INST]", "a")]
    docs = spark.createDataFrame([(1, text(1, 80), "en", "s", 1, "a", "b")], "doc_id long, text string, lang string, source string, id int, fp string, matches string")
    assert ngram_lm.train_and_score(docs).count() == decontaminate.find_matches(docs, spark.createDataFrame([(1, "none of it")], "item_id long, text string")).count() == 1
    assert jaccard_join.keep_one(docs).columns == docs.columns and jaccard_join.keep_one(docs).count() == 1
    path = tokenizer_path("byte_bpe_50k.json")
    assert token_files.read_tokens(*token_files.write_tokens(docs, path)).count() == piece_lattice.encode(docs, tokenizer_path("piece_bpe_32k.model")).count() == 1


def test_rows_of_one_id_are_dealt_out_in_order(spark):
    """Many rows of one id lie in several shards, still in the order of their texts."""
    rows = [(7, f"{k:03d} " + text(k, 30)) for k in range(300)] + [(7, None), (1, "first"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder, index = token_files.write_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.filter("doc_id = 7").select("shard").distinct().count() > 1
    got = token_files.read_tokens(folder, index).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1] + [7] * 301 + [9] and got[1].n_tokens == 1
    again = token_files.read_tokens(*token_files.write_tokens(docs.repartition(2), tokenizer_path("byte_bpe_50k.json"))).orderBy("start").collect()
    assert got == again
