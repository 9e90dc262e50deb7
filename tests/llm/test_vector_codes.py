from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from paylens.llm import vector_codes as V
from paylens.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, near string, low string, error string, code string, sums string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(3)


def brute(rows, rounds=6, parts=8, entries=16):
    """Plain integer rounds over all entries; {(vec_id, code, error)} and codebooks."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[int(np.floor(float(np.float32(c)) * 4096)) for c in v] for _, v in kept]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p])) for p, x in enumerate(v)] for v in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    return sorted((r[0] is None, r[0], bytes(e for _, e in f), sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)), books


def check(spark, rows, **more):
    got, books = V.compress(table(spark, rows), **more)
    want, want_books = brute(rows, more.get("rounds", 6))
    assert books == want_books
    assert sorted((r["vec_id"] is None, r["vec_id"], bytes(r["code"]), r["error"]) for r in got.collect()) == want


def clustered(rng, n, dim=32, spread=0.02):
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(12)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(2)
    rows = clustered(rng, 400)
    rows += [(1000 + i, [float(rng.choice([-1, 0, 1])) for _ in range(32)], 1) for i in range(60)]  # many ties
    rows += [(5, None, 1), (6, [None] * 32, 1), (7, [float("nan")] * 32, 2), (8, [float("inf")] * 32, None), (-4, rows[0][1], 3), (None, rows[1][1], 3)]
    rows += [rows[3], rows[3], (2000, [0.5] * 16, 1), (2001, [], 1)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 5, 17])
def test_few_rows_give_small_codebooks(spark, n):
    check(spark, clustered(random.Random(n), n, dim=8))


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.choice([1.0, 3e4, -4e4, 5e4]) * rng.random())) for _ in range(8)], 0) for i in range(50)]
    check(spark, rows)


def test_bounds_never_lose_a_nearer_entry():
    """Random drifts, ties and list sizes: the part's entry is always the one of the full search."""
    rng = np.random.default_rng(4)
    skipped = 0
    for trial in range(30):
        k, d = int(rng.integers(1, 17)), int(rng.integers(1, 6))
        x = rng.integers(-20, 20, (200, d))
        book = rng.integers(-20, 20, (k, d))
        b = int(min(k, rng.integers(2, 6)))
        near, low, _ = V._nearest(x, book, b)
        for _ in range(6):
            new = book + rng.integers(-2, 3, book.shape) * (rng.random((k, 1)) < 0.5)
            b = max(min(2, k), b - int(rng.integers(0, 2)))
            near, low, square, depth = V.Part(new, book).assign(x, near, low, b)
            full = V._squares(x, new)
            assert (near[:, 0] == full.argmin(axis=1)).all() and (square == full.min(axis=1)).all()
            listed = np.take_along_axis(full, near.astype(int), axis=1)
            assert (low[:, :-1].astype(float) ** 2 * (low[:, :-1] > 0) <= listed[:, 1:]).all()
            skipped += (depth < k).sum()
            book = new
    assert skipped > 5000


def test_list_size_shrinks_to_what_is_needed():
    assert V._enough({1: 990, 2: 5, 16: 5}, 4, 2) == 2
    assert V._enough({1: 500, 3: 495, 16: 5}, 4, 2) == 3
    assert V._enough({1: 500, 16: 500}, 4, 2) == 4


def test_registered_query(spark, tmp_path):
    rows = clustered(random.Random(9), 120, dim=16)
    table(spark, rows).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    got = QUERIES["op13_drake_hamerly"](spark, str(tmp_path / "a")).collect()
    want, books = brute(rows)
    labels = {i: lab for i, _, lab in rows}
    by_label: dict = {}
    for _, i, _, e in want:
        by_label[labels[i]] = by_label.get(labels[i], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert sorted(map(tuple, got)) == [(i, code.hex(), e, by_label[labels[i]], digest) for _, i, code, e in want]
    table(spark, rows).where("vec_id < 0").write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    none = QUERIES["op13_drake_hamerly"](spark, str(tmp_path / "b"))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
