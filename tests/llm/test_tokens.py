from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from paylens.llm import bpe, bpe_codec, token_counts, transducer  # noqa: E402
from tests.llm.conftest import edge_rows, make  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "b", " ", "\n", "\x85", "\x1c", "\x1f", "\xa0", "é", "é", "Σ", "İ", "ß", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|",
       "1", "½", "日", "🙂", "‍", "\x00", "﻿", " ", "　", "K", "ﬁ", "Ⅷ", "-", "...", "᠎", "𐐀", "ᾈ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(9)
    return [*edge_rows(), *((1000 + i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))), "en", "s") for i in range(1500))]


def test_ids_and_decoded_text_equal_the_librarys(spark, library, odd_rows, empty):
    got = bpe_codec.encode(make(spark, odd_rows), PATH, lexicon_words=200, with_ids=True, with_text=True).collect()
    assert len(got) == len(odd_rows)
    want = {}
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.setdefault(i, []).append(
            (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text)
        )
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"], r["decoded"]) in want[r["doc_id"]]
    assert bpe_codec.encode(empty, PATH).count() == 0


def test_counts_equal_the_librarys(spark, library, odd_rows, empty):
    got = token_counts.token_counts(make(spark, odd_rows), PATH, limit=20, table_words=50).collect()
    want = {}
    for i, t, *_ in odd_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.setdefault(i, []).append((len((t or "").encode()), n, n > 20))
    assert all((r["n_bytes"], r["n_tokens"], r["over_limit"]) in want[r["doc_id"]] for r in got) and len(got) == len(odd_rows)
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [b"lower", b"lowest", b"newer", b"newest", b"wider", b"widest", b"a", b"ab", "é".encode()]
    path = tmp_path / "lexicon"
    path.write_bytes(transducer.compile_lexicon((w, list(w)) for w in words))
    lexicon = transducer.Lexicon(str(path))
    for w in words:
        assert np.frombuffer(lexicon.ids(w), "<u4").tolist() == list(w)
    assert all(lexicon.ids(w) is None for w in (b"", b"low", b"lowes", b"abc", b"x", b"newerx"))
    # shared endings: 'er' and 'est' are stored once, so states are far fewer than letters
    assert len(lexicon.finals) <= 18
    with pytest.raises(ValueError):
        transducer.compile_lexicon([(b"a", [1]), (b"a", [2])])


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_CHUNKS", 10)
    enc = bpe_codec.Encoder(bpe.load(PATH), None)
    for i in range(100):
        enc.encode(f"word{i} other{i}")
    assert len(enc) <= 10


def test_frequent_words_come_from_all_rows(spark):
    rows = [(i, "common rare%d" % i, "en", "s") for i in range(300)]
    assert bpe.frequent_words(make(spark, rows), PATH, top=2, per_task=1000)[0] in ("common", "rare")
