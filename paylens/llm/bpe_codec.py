"""BPE encoding and decoding with a transducer lexicon.

The most frequent words of the corpus are encoded once on the driver and compiled
into a minimal acyclic transducer, which every executor gets as a file and
memory-maps. A worker looks words up there and merges the others exactly; a
bounded cache keeps what it has met. No row is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from paylens.llm import bpe
from paylens.llm.transducer import Lexicon, compile_lexicon
from paylens.llm.workspace import Workspace, ship_package

LEXICON_WORDS = 50_000
WORDS_PER_TASK = 20_000
CACHE_CHUNKS = 250_000

_OPEN: dict[tuple, "Encoder"] = {}


class Encoder(dict):
    """Chunk between white space -> its ids as bytes. Holds CACHE_CHUNKS chunks at
    most; a full cache starts anew."""

    def __init__(self, model: bpe.WordBPE, lexicon: Lexicon | None):
        super().__init__()
        self.model, self.lexicon = model, lexicon

    def word(self, word: str) -> bytes:
        found = self.lexicon.ids(word.encode("utf-8")) if self.lexicon else None
        if found is None:
            ids = self.model.merge(word)
            found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        words = [chunk] if chunk.isascii() and chunk.isalpha() else self.model.words(chunk)
        # a word is a chunk of its own, so both share the cache
        out = self.word(chunk) if words == [chunk] else b"".join(map(self.__getitem__, words))
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.model.has_special(text):
            return b"".join(struct.pack("<I", p) if type(p) is int else self[p] for p in self.model.parts(text))
        return b"".join(map(self.__getitem__, self.model.chunks(text)))


def encoder(vocabulary: str, lexicon_file: str | None) -> Encoder:
    """This process's encoder."""
    key = (vocabulary, lexicon_file)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Encoder(bpe.load(vocabulary), Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)
    return _OPEN[key]


def ship_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compile the words' lexicon and add it to the files that executors fetch; its name there."""
    model = bpe.load(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}.madt"
    data = compile_lexicon((w.encode("utf-8"), model.merge(w)) for w in words)
    spark.sparkContext.addFile(Workspace(spark, "lexicon").file(name, data))
    return name


def encode(
    docs: DataFrame,
    vocabulary: str,
    lexicon_words: int = LEXICON_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and on
    request ``ids`` (array of ints) and ``decoded``.

    Ids are those of the tokenizers library without added special tokens; special
    strings in a text become their ids. Ids are then decoded, with no token left
    out. Null text counts as empty (no tokens, the empty decoded text). Repeated
    rows are encoded each; any id type and null ids pass through. A very long text is
    encoded whole in one task, whose memory follows its length; a very long word is merged
    in n log n steps and not cached. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    words = bpe.frequent_words(docs, vocabulary, lexicon_words, WORDS_PER_TASK, text) if lexicon_words else []
    lexicon_file = ship_lexicon(spark, words, vocabulary) if words else None
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, lexicon_file)
        for batch in batches:
            counts, ids_sha, decoded_sha, all_ids, all_text = [], [], [], [], []
            for value in batch.column(1):
                raw = enc.encode(value.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                decoded = enc.model.decode(ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                if with_text:
                    all_text.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(all_text, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
