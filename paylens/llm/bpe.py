"""Exact BPE over words, from a tokenizer file.

Reads files of the kind "BPE with word ends": NFC, white space collapsed, lower
case, split into words by a pattern, bytes written as printable characters, merges
by rank with an end-of-word mark, special strings cut out first. The path is a
parameter; every worker process reads the file once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.workspace import ship_package

# ---- fixed values: Unicode white space, without the separators 1C to 1F that str.split() also cuts at ----
SPACE_CODES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = re.compile("[" + "".join(map(chr, SPACE_CODES)) + "]+")
SHORT_WORD, NO_RANK = 48, 1 << 60
OTHER_SEPARATORS = re.compile("[\x1c-\x1f]")


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1,
    else the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


class WordBPE:
    """Words of a text, and ids of a word by exact merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a BPE file with word ends")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for table in (self.vocab, self.special):
            for t, i in table.items():
                self.tokens[i] = t
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_re = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        # inside a chunk there is no white space, so "not a space" need not be said
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_re = regex.compile(pattern.replace(r"[^\s", "[^"))
        self.shown = printable_bytes()

    def parts(self, text: str) -> Iterator[str | int]:
        """Chunks between white space, in lower case, and ids of special strings, in order."""
        pieces = self.special_re.split(text) if self.special_re and "<|" in text else [text]
        for piece in pieces:
            if piece in self.special:
                yield self.special[piece]
            else:
                yield from self.chunks(piece)

    def has_special(self, text: str) -> bool:
        return "<|" in text and self.special_re is not None and self.special_re.search(text) is not None

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space of a text without special strings, normalised."""
        if not text.isascii():
            # one character at a time: a sigma at a word's end stays an ordinary one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if OTHER_SEPARATORS.search(text):
            return [c for c in SPACES.split(text) if c]
        return text.split()

    def words(self, chunk: str) -> list[str]:
        return self.word_re.findall(chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest-ranked pair, leftmost first, until none is left."""
        parts = list(word) if word.isascii() and word.isprintable() else [self.shown[b] for b in word.encode("utf-8")]
        parts[-1] += self.end
        merged = self._merge_short(parts) if len(parts) <= SHORT_WORD else self._merge_long(parts)
        whole = self.vocab
        return [whole[p] for p in merged if p in whole]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """By a list of ranks: each step is a scan of a few numbers."""
        rank = self.ranks.get
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """By a heap of pairs, for words of any length."""
        n = len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            h = before[i]
            if h >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: token strings with a blank between each two."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def frequent_words(docs: DataFrame, path: str, top: int, per_task: int, text: str = "text") -> list[str]:
    """The ``top`` words that occur most in all texts, most frequent first.

    Each task counts its texts' chunks and hands on its ``per_task`` most frequent
    words, so what is shuffled and collected is bounded. Counts below a task's cut
    are not added up: the list only decides what is looked up fast, never a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = load(path), Counter()
        for batch in batches:
            for value in batch.column(0):
                body = value.as_py() or ""
                seen.update(bpe.chunks(body) if not bpe.has_special(body) else (c for c in bpe.parts(body) if type(c) is str))
                if len(seen) > 16 * per_task:
                    seen = Counter(dict(seen.most_common(4 * per_task)))
        words = Counter()
        for chunk, n in seen.items():
            for w in bpe.words(chunk):
                words[w] += n
        best = words.most_common(per_task)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())}
        )

    ship_package(docs.sparkSession)
    counted = docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(top).collect()]
