"""Codebooks and codes against plain Lloyd rounds in Python integers, and what the bounds leave out."""

import math
import random

import numpy as np
import pytest

from planwright.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code int, error string, v string"


def plain(rows, rounds=vc.ROUNDS):
    """(vec_id, label, code, error) by comparing every part with every entry."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(np.float32(x)) for x in vector):
            kept.append((vec_id, [math.floor(4096 * float(np.float32(x))) for x in vector], label))
    fit = sorted((r for r in kept if r[1] and len(r[1]) % 8 == 0 and max(map(abs, r[1])) < 1 << 62), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(fit[0][1]) if fit else 0
    fit = [r for r in fit if len(r[1]) == dim]
    w = dim // 8
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in fit[:16]] for p in range(8)] if fit else []
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds if fit else 0):
        new = []
        for p in range(8):
            at = [near(v, p)[1] for _, v, _ in fit]
            new.append([[sum(cut(fit[i][1], p)[x] for i in own) // len(own) for x in range(w)] if (own := [i for i, a in enumerate(at) if a == k]) else e for k, e in enumerate(books[p])])
        books = new
    out = [(i, label, "".join(f"{near(v, p)[1]:02x}" for p in range(8)), sum(near(v, p)[0] for p in range(8))) for i, v, label in fit]
    out = [(*r[:3], r[3] if r[3] < 1 << 63 else None) for r in out]
    return out + [(i, label, None, None) for i, v, label in kept if not any(v is f[1] for f in fit)], books


def compressed(spark, rows, rounds=vc.ROUNDS):
    data = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)
    out, books = vc.compress(data, rounds)
    return out, books


def same(spark, rows, rounds=vc.ROUNDS):
    out, books = compressed(spark, rows, rounds)
    want, want_books = plain(rows, rounds)
    assert books == want_books
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def clustered(seed, n, dim=16, step=None):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(20)]
    rows = []
    for k in range(n):
        v = [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)]
        rows.append((k, [round(x / step) * step for x in v] if step else v, rnd.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize("step", [None, 0.5])  # on a grid nearly all distances tie
def test_against_plain_rounds(spark, step):
    rows = clustered(1, 400, step=step)
    rows += [(900, None, 1), (901, [0.1] * 15 + [None], 1), (902, [0.1] * 15 + [float("nan")], 1), (903, [0.1] * 15 + [float("-inf")], 2), (904, [0.1] * 8, 2), (905, [], 2), (906, [0.2] * 7, 3),
             (None, [0.3] * 16, None), (None, [0.2] * 16, None), rows[0], rows[0]]
    same(spark, rows)


def test_large_components_stay_exact(spark):
    rows = clustered(2, 60) + [(100 + k, [float(10 ** (k % 9)) * (-1) ** k] * 16, 1) for k in range(30)] + [(200, [3e30] * 16, 1)]
    same(spark, rows)


def test_few_vectors_and_none(spark):
    same(spark, clustered(3, 5))
    same(spark, [(1, [0.5] * 8, None)])
    same(spark, [(1, [0.5] * 7, None)])
    for rows in ([], [(1, None, 2)]):
        out, books = compressed(spark, rows)
        assert out.collect() == [] and books == []


def test_label_errors(spark):
    rows = [(k, [float(k)] * 8, k % 2 or None) for k in range(40)]
    out, _ = compressed(spark, rows, 1)
    got = vc.with_label_errors(out).collect()
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got) and len(got) == 40


def test_bounds_leave_most_distances_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (16, 8))
    vectors = centres[rng.integers(0, 16, 4000)] + rng.integers(-200, 200, (4000, 8))
    before = (centres + rng.integers(-30, 30, centres.shape)).tolist()
    groups = vc.grouped(before)
    at, upper, lower, all_of_them = vc.Part(before, None, groups).first(vectors)
    now = vc.Part(centres.tolist(), before, groups)
    again, upper, lower, few = now.again(vectors, at, upper, lower)
    full = vc.exact(vectors, centres)
    assert (again == full.argmin(1)).all() and few * 10 < all_of_them
    own = full[np.arange(len(vectors)), again]
    assert (upper >= np.sqrt(own)).all()
    for g in range(max(groups) + 1):
        others = np.where((np.array(groups) == g)[None] & (np.arange(16)[None] != again[:, None]), np.sqrt(full), np.inf).min(1)
        assert (lower[:, g] <= others).all()
