"""One text of 3 MB, its copy, and near copies of it, through the operators on documents."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from paylens.llm import content_sort_dedup, hamming_join, hilbert_shards, mixing, quality, suffix_levels
from tests.llm.conftest import make, words

WORDS = 460_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    long = words(rng, WORDS).split(" ")
    edited, half = list(long), [*long[: WORDS // 2], *words(rng, WORDS // 2).split(" ")]
    for i in range(0, WORDS, 200):
        edited[i] = "edit"
    texts = [" ".join(long), " ".join(long), "\n ".join(long), " ".join(edited), " ".join(half), "x" * 3_000_000, "short text", None]
    return [(10 * i + 1, t, "en", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_shards(docs, rows):
    got = by_id(hilbert_shards.hilbert_shards(docs, shards=3))
    for i, t, *_ in rows:
        data = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(data) + 8, zlib.crc32(data))


def test_exact_groups(docs):
    got = {i: (r["keep_id"], r["group_size"]) for i, r in by_id(content_sort_dedup.exact_groups(docs)).items()}
    # the copy with longer blanks has the most code points
    assert got == {1: (21, 3), 11: (21, 3), 21: (21, 3), 31: (31, 1), 41: (41, 1), 51: (51, 1), 61: (61, 1), 71: (71, 1)}


def test_near_components(docs):
    got = {i: r["component_id"] for i, r in by_id(hamming_join.near_components(docs)).items()}
    # five shingles of 200 are other ones in 31; half of all in 41
    assert got == {1: 1, 11: 1, 21: 1, 31: 1, 41: 41, 51: 51, 61: 61, 71: 71}


def test_repeated_spans(docs, rows):
    got = by_id(suffix_levels.repeated_spans(docs))
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    same = 0
    while texts[41][same] == texts[1][same]:
        same += 1
    assert (got[11]["n_removed"], got[11]["n_spans"]) == (len(texts[11]), 1)
    assert got[41]["removed"] == [0, same]
    assert got[41]["kept_sha256"] == hashlib.sha256(texts[41][same:]).hexdigest()
    assert got[51]["n_removed"] == got[61]["n_removed"] == got[71]["n_removed"] == got[1]["n_removed"] == 0


def test_mixing_and_quality(spark, docs):
    got = by_id(mixing.mix(docs))
    assert [got[i]["size"] for i in (1, 11, 21, 31, 41, 51, 61, 71)] == [WORDS] * 5 + [1, 2, 0]
    labels = spark.createDataFrame([(1, 1, 0), (51, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = by_id(quality.classify(docs, labels))
    assert len(found) == 8 and found[1]["own_quality"] > found[51]["own_quality"]


def test_tokens(spark, docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from paylens.llm import bpe_codec, token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    few = docs.where("doc_id in (1, 51, 61)")
    ids, counts = by_id(bpe_codec.encode(few, path)), by_id(token_counts.token_counts(few, path))
    for i, t, *_ in rows:
        if i in ids:
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert counts[i]["n_tokens"] == len(want)
