"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the corpus's most frequent words and their token
counts, broadcast once: one block of words and one byte per count. Tier two is a
cache in each worker, filled by exact merging. Words are never shuffled to be
counted; the scan that finds the frequent ones hands on a bounded list per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paylens.llm import bpe

TABLE_WORDS = 32_768
WORDS_PER_TASK = 8_192
CACHE_CHUNKS = 1_000_000
LIMIT = 2048

_OPEN: dict[tuple, "Counts"] = {}


def compact_table(words: list[str], vocabulary: str) -> tuple[bytes, bytes]:
    """(words, one per line; a byte per word). Words of over 255 tokens stay out."""
    model = bpe.load(vocabulary)
    sized = [(w, n) for w in words if (n := len(model.merge(w))) <= 255]
    return "\n".join(w for w, _ in sized).encode("utf-8"), bytes(n for _, n in sized)


class Counts(dict):
    """Chunk between white space -> number of tokens. Holds CACHE_CHUNKS chunks at most."""

    def __init__(self, model: bpe.WordBPE, table: tuple[bytes, bytes]):
        super().__init__()
        self.model = model
        words, sizes = table
        self.table = dict(zip(words.decode("utf-8").split("\n"), sizes, strict=True)) if sizes else {}

    def word(self, word: str) -> int:
        n = self.table.get(word)
        return len(self.model.merge(word)) if n is None else n

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        words = [chunk] if chunk.isascii() and chunk.isalpha() else self.model.words(chunk)
        # a word is a chunk of its own, so both share the cache
        n = self.word(chunk) if words == [chunk] else sum(map(self.__getitem__, words))
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if self.model.has_special(text):
            return sum(1 if type(p) is int else self[p] for p in self.model.parts(text))
        return sum(map(self.__getitem__, self.model.chunks(text)))


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    limit: int = LIMIT,
    table_words: int = TABLE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library without added special tokens; a
    special string in a text is one token. Null text counts as empty: 0 bytes, 0
    tokens. Repeated rows and null ids pass through. A very long text is counted whole in
    one task, whose memory follows its length. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = bpe.frequent_words(docs, vocabulary, table_words, WORDS_PER_TASK, text)
    shared = spark.sparkContext.broadcast(compact_table(words, vocabulary))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, shared.value)
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Counts(bpe.load(vocabulary), shared.value)
        counts = _OPEN[key]
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                body = value.as_py() or ""
                sizes.append(len(body) if body.isascii() else len(body.encode("utf-8")))
                tokens.append(counts.count(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
