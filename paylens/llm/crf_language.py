"""Language of every word by a linear-chain conditional random field.

A text is a chain of words; the labels are languages. A word's score for a language is
the sum of learned weights of its hashed character n-grams (two to four signs; those
that touch the word's edge are its affixes) and of its entry in a lexicon of frequent
short words, times a learned weight. Learned transitions say how readily one language
follows another, so one odd word does not change the label and a switched passage does.
Forward-backward gives each word's probabilities over the whole text; a document's
language is the one with the greatest mean over its letters.

Training: the lexicon counts every short word of all labelled documents; the weights are
fitted on a bounded sample of them, as sequences that join passages of several documents,
so that switches occur. Prediction sees nothing but the text. It runs over arrays of
characters, not words: no cache grows with the vocabulary. Long texts are cut into lanes
of 64 words whose transfer matrices are computed together and then chained, which is the
same forward-backward over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.workspace import ship_package

#: Bounds: documents fitted on, passages and words of each, longest word of a passage.
SAMPLE_ROWS, PASSAGES, PASSAGE_WORDS, PASSAGE_LETTERS = 4000, 6, 12, 40
#: Labels: the languages with the most labelled documents.
LANGUAGES = 200
LEXICON_WORDS, LEXICON_LETTERS = 16_384, 6
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
EPOCHS, BATCH, JOINED, RATE = 4, 64, 4, 0.5
#: Characters worked on at once, words of a lane.
SLICE, LANE = 1 << 17, 64
UNKNOWN = "und"

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# ---- words and their features -----------------------------------------------------------
@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


@dataclass
class Words:
    """The words of a slice: signs with 0 between words, where words start, how long they are."""

    signs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    at: np.ndarray  # the word of each sign


def split_words(text: str) -> Words:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.zeros(len(codes) + 4, np.uint64)
    mask = np.zeros(len(codes) + 4, bool)
    mask[1:-3] = _letters()[codes]
    signs[1:-3] = np.where(mask[1:-3], codes + np.uint32(1), 0)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    starts = np.flatnonzero(first)
    return Words(signs, starts, np.flatnonzero(last) - starts + 1, np.cumsum(first) - 1)


def grams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (bucket, word) of all n-grams inside a word or touching its edges."""
    signs, known = words.signs, words.signs > 0
    for n in ORDERS:
        m = len(signs) - n + 1
        inner = known[:m] | known[1 : 1 + m] if n == 2 else known[1 : 1 + m].copy()
        for i in range(2, n - 1):
            inner &= known[i : i + m]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + signs[at + i]) * _MIX[i]
            h ^= h >> np.uint64(29)
        word = words.at[at + 1] if n > 2 else np.where(known[at], words.at[at], words.at[at + 1])
        yield (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), word


def short_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of the words that a lexicon may hold."""
    short = np.flatnonzero(words.lengths <= LEXICON_LETTERS)
    h = np.full(len(short), 7, np.uint64)
    for i in range(LEXICON_LETTERS):
        sign = np.where(words.lengths[short] > i, words.signs[np.minimum(words.starts[short] + i, len(words.signs) - 1)], 0)
        h = (h ^ sign) * _MIX[0]
        h ^= h >> np.uint64(31)
    return h.astype(np.int64), short


def slices(text: str) -> Iterator[str]:
    """A lower-case text in parts of about ``SLICE`` characters, cut between words (a run of
    more letters than that counts as several words)."""
    text = text.lower()
    start = 0
    while len(text) - start > SLICE:
        end = start + SLICE
        cut = end
        while cut > start and text[cut - 1].isalpha() and text[cut].isalpha():
            cut -= 1
        cut = cut if cut > start else end
        yield text[start:cut]
        start = cut
    yield text[start:]


# ---- the model ---------------------------------------------------------------------------
@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    lexicon: np.ndarray  # sorted hashes
    usage: np.ndarray  # (words, languages): centred log shares
    trust: float  # learned weight of the lexicon
    moves: np.ndarray  # (languages, languages): log potential of one after the other

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages): the sum of each word's features."""
        n, out = len(words.starts), np.zeros((len(words.starts), len(self.languages)))
        for bucket, word in grams(words):
            total = np.cumsum(self.weights[bucket], axis=0, dtype=np.float64)
            ends = np.cumsum(np.bincount(word, minlength=n))
            upto = np.vstack([np.zeros((1, total.shape[1])), total])[ends]
            out += np.diff(upto, axis=0, prepend=0)
        if len(self.lexicon):
            h, short = short_words(words)
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            found = self.lexicon[at] == h
            out[short[found]] += self.trust * self.usage[at[found]]
        return out.astype(np.float32)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (words, languages), and the forward vectors, by forward-backward over
    chains of the given lengths (each one at least), in lanes of ``LANE`` words."""
    k = scores.shape[1]
    lanes = -(-lengths // LANE)
    ends = np.cumsum(lengths)
    first_lane = np.cumsum(lanes) - lanes
    total = int(lanes.sum())
    chain = np.repeat(np.arange(len(lengths)), lanes)
    rank = np.arange(total) - first_lane[chain]
    begin = (ends - lengths)[chain] + rank * LANE
    size = np.minimum(LANE, ends[chain] - begin)
    step = np.exp(moves - moves.max()).astype(np.float32)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    at = np.minimum(begin[:, None] + np.arange(LANE), len(scores) - 1)

    def normal(v: np.ndarray) -> np.ndarray:
        flat = v.reshape(len(v), -1)
        return v / np.maximum(flat.max(axis=1), 1e-30).reshape((-1,) + (1,) * (v.ndim - 1))

    several = np.flatnonzero(lanes[chain] > 1)
    carry = np.zeros((total, k, k), np.float32)
    if len(several):  # transfer matrices of the lanes of long chains
        matrix = np.broadcast_to(np.eye(k, dtype=np.float32), (len(several), k, k)).copy()
        for t in range(LANE):
            on = size[several] > t
            moved = (matrix.reshape(-1, k) @ step).reshape(matrix.shape)
            if t == 0:
                moved = np.where((rank[several] == 0)[:, None, None], matrix, moved)
            new = normal(moved * emit[at[several, t]][:, None, :])
            matrix = np.where(on[:, None, None], new, matrix)
        carry[several] = matrix
    ahead, behind = np.ones((total, k), np.float32), np.ones((total, k), np.float32)
    for r in range(1, int(lanes.max(initial=1))):
        into = np.flatnonzero(rank == r)
        ahead[into] = normal(np.einsum("ni,nij->nj", ahead[into - 1], carry[into - 1]))
    for r in range(int(lanes.max(initial=1)) - 1, 0, -1):
        into = np.flatnonzero(rank == r)
        behind[into - 1] = normal(np.einsum("nij,nj->ni", carry[into], behind[into]))

    alphas = np.empty((LANE, total, k), np.float32)
    alpha = ahead
    for t in range(LANE):
        moved = alpha @ step
        if t == 0:
            moved = np.where((rank == 0)[:, None], alpha, moved)
        alpha = np.where((size > t)[:, None], normal(moved * emit[at[:, t]]), alpha)
        alphas[t] = alpha
    out, front = np.empty_like(emit), np.empty_like(emit)
    beta = behind
    for t in range(LANE - 1, -1, -1):
        on = size > t
        both = alphas[t] * beta
        both /= np.maximum(both.sum(axis=1, keepdims=True), 1e-30)
        out[at[on, t]] = both[on]
        front[at[on, t]] = alphas[t][on]
        if t:
            beta = np.where(on[:, None], normal((emit[at[:, t]] * beta) @ step.T), beta)
    return out, front


# ---- fitting ------------------------------------------------------------------------------
def passages(text: str, letters: int = PASSAGE_LETTERS) -> list[str]:
    """Runs of words spread evenly over a whole text; words of more letters are left out."""
    words = [w for part in slices(text) for w in "".join(c if c.isalpha() else " " for c in part).split() if len(w) <= letters]
    if len(words) <= PASSAGES * PASSAGE_WORDS:
        return [" ".join(words[i : i + PASSAGE_WORDS]) for i in range(0, len(words), PASSAGE_WORDS)]
    gap = (len(words) - PASSAGE_WORDS) / (PASSAGES - 1)
    return [" ".join(words[int(i * gap) : int(i * gap) + PASSAGE_WORDS]) for i in range(PASSAGES)]


def fit(sample: list[tuple[str, list[str]]], languages: list[str], lexicon: dict[int, list[int]], seed: int = 11) -> Model:
    """A model from (language, passages) of documents and the words' counts by language."""
    k = len(languages)
    hashes = np.array(sorted(lexicon), np.int64)
    counts = np.array([lexicon[int(h)] for h in hashes], np.float64).reshape(len(hashes), k)
    shares = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(hashes))))
    usage = np.clip(shares - shares.mean(axis=1, keepdims=True), -4, 4).astype(np.float32)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), hashes, usage, 0.1, np.zeros((k, k), np.float32))
    rng = np.random.default_rng(seed)
    pool = [(languages.index(lang), p) for lang, own in sample for p in own if p]
    if not pool:
        return model
    seen_w, seen_m, seen_t = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(pool))
        for start in range(0, len(order), BATCH * JOINED):
            chosen = [pool[i] for i in order[start : start + BATCH * JOINED]]
            words = split_words("\n".join(p for _, p in chosen))
            per = np.array([len(p.split()) for _, p in chosen])
            label = np.repeat([lang for lang, _ in chosen], per)
            lengths = np.array([per[i : i + JOINED].sum() for i in range(0, len(per), JOINED)])
            n = len(label)
            got, front = marginals(model.scores(words), lengths, model.moves)
            off = got.copy()
            off[np.arange(n), label] -= 1
            gradient = np.zeros(model.weights.shape)
            for bucket, word in grams(words):
                for j in range(k):
                    gradient[:, j] += np.bincount(bucket, off[word, j], BUCKETS)
            h, short = short_words(words)
            slope = 0.0
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                known = hashes[at] == h
                slope = float((off[short[known]] * usage[at[known]]).sum())
            # pairs of neighbours: expected, less those that are there
            inside = np.ones(n, bool)
            inside[np.cumsum(lengths) - lengths] = False
            here = np.flatnonzero(inside)
            pair = front[here - 1][:, :, None] * np.exp(model.moves)
            pair *= (got[here] / np.maximum(pair.sum(axis=1), 1e-30))[:, None, :]
            turn = pair.sum(axis=0, dtype=np.float64)
            np.add.at(turn, (label[here - 1], label[here]), -1)
            gradient, turn, slope = gradient / BATCH + 1e-4 * model.weights, turn / BATCH, slope / BATCH
            seen_w += gradient**2
            seen_m += turn**2
            seen_t += slope**2
            model.weights -= (RATE * gradient / np.sqrt(seen_w)).astype(np.float32)
            model.moves = np.clip(model.moves - RATE * turn / np.sqrt(seen_m), -8, 8).astype(np.float32)
            model.trust = float(np.clip(model.trust - 0.1 * slope / np.sqrt(seen_t), 0, 3))
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n): short words, summed in each task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        words, back = np.unique(np.concatenate([w for w, _ in held[lang]]), return_inverse=True)
        return words, np.bincount(back, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

    def made() -> Iterator[pa.RecordBatch]:
        for lang in held:
            words, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words), pa.array(n)], ["lang", "word", "n"])

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).extend(slices(text))
        for lang, parts in texts.items():
            for group in _groups(parts):
                words, n = np.unique(short_words(split_words("\n".join(group)))[0], return_counts=True)
                held.setdefault(lang, []).append((words, n))
                size += len(words)
        if size > 1_000_000:
            held = {lang: [merged(lang)] for lang in held}
            size = sum(len(w) for own in held.values() for w, _ in own)
            if size > 500_000:
                yield from made()
                held, size = {}, 0
    yield from made()


def _groups(parts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for part in parts:
        group.append(part)
        size += len(part)
        if size >= SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([passages(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), found], ["lang", "h", "passages"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from all rows with a text and a language; None if there is none.

    The lexicon counts all rows. The weights are fitted on at most ``sample_rows`` rows,
    equally many of each language, drawn by a hash of id and text (rows equal in both
    count once), and of each at most ``PASSAGES`` runs of ``PASSAGE_WORDS`` words, so the
    driver holds a few megabytes. The ``LANGUAGES`` commonest languages are learned.
    """
    ship_package(labelled.sparkSession)
    rows = labelled.select(
        labelled[doc_id].cast("string").alias("id"), labelled[lang].cast("string").alias("lang"), labelled[text].cast("string").alias("text")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    common = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()
    if not common:
        return None
    sizes = {r["lang"]: r["count"] for r in common}
    languages = sorted(sizes)
    rows = rows.where(F.col("lang").isin(languages))
    words = rows.select("lang", "text").mapInArrow(_count_words, "lang string, word bigint, n bigint")
    table = words.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)], F.sum("n").alias("n"))
    top = table.orderBy(F.col("n").desc(), "word").limit(LEXICON_WORDS).collect()
    lexicon = {r["word"]: [r[f"n{i}"] for i in range(len(languages))] for r in top}
    quota = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for x, n in sizes.items() for v in (x, min(1.0, 1.3 * quota / n))])
    drawn = (
        rows.withColumn("h", F.xxhash64("id", "text"))
        .where((F.col("h").cast("double") / 2.0**64 + 0.5) <= share[F.col("lang")])
        .dropDuplicates(["lang", "h"])
        .mapInArrow(_cut_passages, "lang string, h bigint, passages array<string>")
        .collect()
    )
    sample, taken = [], dict.fromkeys(languages, 0)
    for r in sorted(drawn, key=lambda r: (r["h"], r["lang"])):
        if taken[r["lang"]] < quota:
            taken[r["lang"]] += 1
            sample.append((r["lang"], r["passages"]))
    return fit(sample, languages, lexicon)


# ---- prediction ---------------------------------------------------------------------------
@dataclass
class Reading:
    """One text's labels: share of each language, and the words where it changes."""

    shares: np.ndarray | None
    spans: list[tuple[int, str]]


def read(model: Model, texts: list[str], spans: bool = False) -> list[Reading]:
    """Whole texts -> shares of the languages; with ``spans`` also (words, language) runs."""
    parts = [(i, part) for i, text in enumerate(texts) for part in slices(text)]
    scores: list[list[np.ndarray]] = [[] for _ in texts]
    sizes: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, str]] = []

    def flush() -> None:
        words = split_words("\n".join(p for _, p in group))
        found = model.scores(words)
        borders = np.cumsum([len(p) + 1 for _, p in group]) + 1
        cuts = np.searchsorted(words.starts, borders)
        for (i, _), a, b in zip(group, [0, *cuts[:-1]], cuts, strict=True):
            scores[i].append(found[a:b])
            sizes[i].append(words.lengths[a:b])
        group.clear()

    held = 0
    for at, item in enumerate(parts):
        group.append(item)
        held += len(item[1])
        if held >= SLICE or at == len(parts) - 1:
            flush()
            held = 0
    lengths = np.array([sum(map(len, s)) for s in scores], np.int64)
    full = np.flatnonzero(lengths)
    out = [Reading(None, []) for _ in texts]
    if not len(full):
        return out
    found, _ = marginals(np.concatenate([x for i in full for x in scores[i]]), lengths[full], model.moves)
    letters = np.concatenate([x for i in full for x in sizes[i]])
    ends = np.cumsum(lengths[full])
    for i, a, b in zip(full, ends - lengths[full], ends, strict=True):
        weight = letters[a:b, None]
        out[i].shares = (found[a:b] * weight).sum(axis=0, dtype=np.float64) / weight.sum()
        if spans:
            best = found[a:b].argmax(axis=1)
            cut = np.flatnonzero(np.diff(best, prepend=-1))
            out[i].spans = [(int(n), model.languages[best[c]]) for c, n in zip(cut, np.diff(cut, append=len(best)), strict=True)]
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[Column, ...] = (), spans: bool = False) -> DataFrame:
    """The columns ``keep`` and lang_pred, score; with ``spans`` also the runs of words of
    one language, in order, as array<struct<words,lang>>.

    ``score`` is the mean probability of lang_pred over the letters of the whole text.
    Null texts and texts without a letter, and all texts if there is no model, are
    ``und`` with score 0 and no spans. Equal texts have equal results. Texts of any
    length are read whole, in slices; a very long one needs about four bytes a language
    and word. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, docs[text].cast("string").alias("_text"))
    kept = rows.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}{', ' if kept else ''}lang_pred string, score double" + (", spans array<struct<words:bigint,lang:string>>" if spans else "")
    span_type = pa.list_(pa.struct([("words", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            start = 0
            sizes = np.array([len(t.as_py() or "") for t in whole.column(whole.num_columns - 1)]) if whole.num_rows else []
            while start < whole.num_rows:
                upto = int(np.searchsorted(np.cumsum(sizes[start:]), 8 * SLICE)) + 1
                batch = whole.slice(start, upto)
                start += upto
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                found = read(m, texts, spans) if m else [Reading(None, []) for _ in texts]
                langs = [UNKNOWN if r.shares is None else m.languages[int(r.shares.argmax())] for r in found]
                scores = [0.0 if r.shares is None else float(min(1.0, r.shares.max())) for r in found]
                columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                if spans:
                    columns.append(pa.array([[{"words": n, "lang": x} for n, x in r.spans] for r in found], span_type))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", *["spans"] * spans])

    return rows.mapInArrow(run, schema)
