from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, part string,"
    " node string, tie string, n string, a string, text_hash string, w_key string, run string, tid string, first string"
)


def make(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, l, s, -1, *["x"] * 12) for i, t, l, s in rows], SCHEMA).repartition(3)


def words(rng, n, letters="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, ties."""
    rng = random.Random(5)
    base = words(rng, 120)
    parts = base.split(" ")
    near = [" ".join([*parts[:i], "changed", *parts[i + 1 :]]) for i in (3, 60, 117)]
    far = " ".join([*parts[:40], *words(rng, 80).split(" ")])
    passage = words(rng, 30)
    texts = [
        None, "", " \t\n", "one", "a b c d", "a b c d e", "A B C D E", "a  b\tc\nd e ", base, base, base.upper(), *near, far,
        "\n".join(words(rng, 12) for _ in range(6)), "é" * 60, "ééé " * 30, "日本語 テスト 🙂 " * 8, "x" * 3000,
        words(rng, 9000), words(rng, 40) + " " + passage, passage + " " + words(rng, 25), words(rng, 10) + passage, "<|endoftext|> it's <|",
    ]
    rows = [(100 - 3 * i, t, ["en", "fr", None][i % 3], ["s1", "s10", "zz", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, None, None), (None, "only here " * 20, "en", "s1"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return make(spark, edge_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [(1, "x", "en", "s")]).filter("doc_id = 2")
