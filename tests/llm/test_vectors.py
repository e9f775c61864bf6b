"""The operators on embeddings against brute force: nulls, wrong lengths, repeated rows, ties, hot groups, empty tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hard_negatives, pivot_dedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, id string"
ODD = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0] * 3]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def near(rng, v: np.ndarray, cosine: float) -> np.ndarray:
    """A unit vector at the given cosine to the unit vector ``v``."""
    z = rng.normal(size=v.shape)
    return cosine * v + np.sqrt(1 - cosine**2) * unit(z - (z @ v) * v)


def table(spark, rows, parts: int = 3):
    """rows: (id, vector, label); further columns clash with names that the operators use."""
    plain = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], label, "clash", "clash") for i, v, label in rows]
    return spark.createDataFrame(plain, SCHEMA).repartition(parts)


def mixed(seed: int, n: int, width: int = 8) -> list[tuple]:
    """Random rows, repeated ones, null ids and labels, and every odd vector."""
    rng = np.random.default_rng(seed)
    rows = [(i, unit(rng.normal(size=width)), int(rng.integers(3))) for i in range(n)]
    rows += [rows[1], rows[1], (None, rows[2][1], 1), (n, rows[3][1], None), (n + 1, rows[3][1], 0)]
    return rows + [(n + 10 + k, v, k % 3) for k, v in enumerate(ODD)]


def good(v, width: int = 8) -> bool:
    return v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)


def as_floats(v) -> np.ndarray:
    return np.array(v, np.float32).astype(np.float64)


@pytest.mark.parametrize("block", [4096, 7])
def test_whitening(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = mixed(1, 60)
    kept = [(i, as_floats(v)) for i, v, _ in rows if good(v)]
    x = np.floor(64 * np.stack([v for _, v in kept])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    want = (centred @ vectors / np.sqrt(e))[:, ::-1]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    for c in range(1, 9):
        mine = sorted(((r.vec_id is not None, r.vec_id or 0, int(r.deviation), r.whitened) for r in got if r.component == c))
        theirs = sorted((i is not None, i or 0, int(d), w) for (i, _), d, w in zip(kept, ((n * x - sums) ** 2).sum(axis=1), want[:, c - 1], strict=True))
        assert [m[:3] for m in mine] == [t[:3] for t in theirs]
        a, b = np.array([m[3] for m in mine]), np.array([t[3] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert {r.component: r.explained for r in got} == pytest.approx({c + 1: e[::-1][c] / e.sum() for c in range(8)}, rel=1e-9)
    (error,) = {r.identity_error for r in got}
    assert error < 1e-12


def test_whitening_without_variance(spark):
    same = table(spark, [(i, [0.5, -0.25, 0.125], 0) for i in range(5)])
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(0, None, None, None)}
    line = whitening.whiten(table(spark, [(i, [i / 64, 1.0, 2 * i / 64], 0) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    assert {r.component: round(r.explained, 12) for r in line} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert whitening.whiten(table(spark, [(1, None, 0), (2, [], 1)])).count() == whitening.whiten(table(spark, [])).count() == 0


def test_whitening_of_numbers_beyond_64_bits(spark):
    """n * x - S and its squares as Python's integers."""
    values = [3.0e13, -2.5e13, 1.0, 7.0e12]
    rows = [(i, [v, -v, 2 * v], 0) for i, v in enumerate(values)]
    x = [[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(table(spark, rows)).collect()} == want


def test_jacobi_keeps_small_values(spark):
    """Singular values over twelve orders of magnitude, equal ones and zeros."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    sizes = np.array([1e6, 1e3, 1e3, 1.0, 1e-2, 1e-4, 1e-6, 0, 0])
    lengths, v = whitening.jacobi(np.diag(sizes) @ q)
    assert lengths == pytest.approx(sizes, rel=1e-9, abs=1e-9) and np.abs(v.T @ v - np.eye(9)).max() < 1e-13


def brute_negatives(rows, modulus: int) -> list[tuple]:
    kept = [(i, label, [int(np.floor(256 * c)) for c in as_floats(v)]) for i, v, label in rows if good(v) and i is not None and label is not None]
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % modulus:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for b, (j, other, w) in enumerate(kept) if b != a)
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [(s, j) for s, j, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, positive, rank + 1, j, -p, -s) for rank, (s, j) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize(("rows", "anchors"), [(16_384, 256), (20, 3)])
def test_hard_negatives(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    made = mixed(3, 150)
    made += [(1000 + i, made[7][1], i % 2) for i in range(9)]  # ties: equal vectors of both labels
    df = table(spark, made)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 7 == 0, F.col("label")).collect())
    assert got == brute_negatives(made, 7) and len(got) > 100


def test_scores_are_exact_beyond_double_precision():
    rng = np.random.default_rng(4)
    most = hard_negatives.most_component(4)
    a, b = (rng.integers(-most, most, (5, 4)) for _ in range(2))
    assert (hard_negatives.scores(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])).all()
    assert 100 * 4 * most * most < 1 << 62


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 2)], [(0, [1.0, 0.0], 1), (50, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 0)]):
        assert hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def brute_links(rows, width: int, threshold: float = 0.9) -> dict[int, tuple]:
    usable = [good(v, width) and any(v) for _, v, _ in rows]
    v = np.stack([as_floats(v) if u else np.ones(width) for (_, v, _), u in zip(rows, usable, strict=True)])
    yes = pivot_dedup.cosines(v, v) >= threshold
    u = np.array(usable)
    yes &= u[:, None] & u[None, :]
    np.fill_diagonal(yes, False)
    ids = np.array([i if i is not None else 1 << 60 for i, *_ in rows])
    low = ids.copy()
    while True:
        step = np.minimum(low, np.where(yes, low[None, :], 1 << 60).min(axis=1))
        if (step == low).all():
            return yes.sum(axis=1), low
        low = step


def check_links(spark, rows, width: int) -> list:
    links, low = brute_links(rows, width)
    got = pivot_dedup.link(table(spark, rows)).collect()
    name = lambda i: None if i == 1 << 60 else int(i)
    want = sorted(((i is None, i or 0, int(n), name(c), i == name(c)) for (i, *_), n, c in zip(rows, links, low, strict=True)), key=repr)
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got), key=repr) == want
    return got


def test_links_of_mixed_rows(spark):
    rng = np.random.default_rng(5)
    rows = mixed(6, 60)
    rows += [(300 + i, near(rng, rows[4][1], 0.97), 0) for i in range(20)]
    rows += [(400, 100.0 * as_floats(rows[5][1]), 0), (401, 1e-30 * as_floats(rows[5][1]), 0), (None, -as_floats(rows[6][1]), 0)]
    check_links(spark, rows, 8)
    assert pivot_dedup.link(table(spark, [])).count() == 0
    assert [(r.n_links, r.component_id, r.kept) for r in pivot_dedup.link(table(spark, [(3, None, 0), (None, [0.0], 0)])).orderBy("vec_id").collect()] == [(0, None, True), (0, 3, True)]


def test_a_cosine_of_exactly_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [9.0, np.sqrt(19.0), 0.0], 0), (3, [0.0, 0.0, 2.0], 0)]
    rows[1] = (2, [4.5, 2.0, 0.8660254], 0)
    check_links(spark, [*rows, (4, [9.0, 3.0, 3.0], 0), (5, [9.0, 3.0, 3.1], 0)], 3)


@pytest.mark.parametrize(("long", "block", "rounds"), [(64, 512, 4), (3, 4, 0), (64, 8, 1), (2, 512, 4)])
def test_crowds_of_near_copies_lose_no_link(spark, monkeypatch, long, block, rounds):
    """A third of all rows in one crowd, wider ones beside it; the same links with short and long lists, with and without balls."""
    for name, value in (("LONG", long), ("BLOCK", block), ("ROUNDS", rounds)):
        monkeypatch.setattr(pivot_dedup, name, value)
    rng = np.random.default_rng(7)
    centre, wide = unit(rng.normal(size=16)), unit(rng.normal(size=16))
    rows = [(i, near(rng, centre, 0.985), 0) for i in range(80)] + [(200 + i, near(rng, wide, 0.95), 0) for i in range(40)]
    rows += [(400 + i, unit(rng.normal(size=16)), 0) for i in range(120)]
    got = check_links(spark, rows, 16)
    assert {r.n_links for r in got if r.vec_id < 80} == {79}


def test_recall_near_the_threshold(spark):
    """Planted pairs at cosines of 0.9 to 0.92 among unrelated rows: found, each once, and nothing else."""
    rng = np.random.default_rng(8)
    base = unit(rng.normal(size=(3000, 64)))
    rows = [(2 * i, v, 0) for i, v in enumerate(base)] + [(2 * i + 1, near(rng, base[i], 0.901 + 0.019 * rng.random()), 0) for i in range(1000)]
    got = {r.vec_id: r for r in pivot_dedup.link(table(spark, rows)).collect()}
    found = sum(got[2 * i].n_links for i in range(1000))
    assert 0.93 * 1000 <= found <= 1000 and sum(r.n_links for r in got.values()) == 2 * found
    assert all(r.component_id in (i, i - i % 2) for i, r in got.items())
