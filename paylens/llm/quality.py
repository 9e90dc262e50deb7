"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log odds of two logistic models, for quality and
for toxicity, over its distinct words (hashed) and coarse features of its shape.
They are fitted on a bounded sample of labelled rows.

Evidence is then pooled by site. The expected number of good documents of every
host and of every path within a host are plain sums over all documents. A host's
rate is shrunk toward the global rate, a path's toward its host's: with few
documents it stays there, with many it becomes the site's own. How strongly is
estimated from how much hosts and paths differ (method of moments). A document's
log odds are its own evidence with the global rate replaced by its path's, from
which the document itself is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.workspace import Workspace, ship_package

SAMPLE_ROWS = 16_000
SAMPLE_FEATURES = 4096
WORD_BITS = 18
SHAPE_BINS = 12
ROUNDS, RATE, RIDGE = 200, 0.05, 1e-4
SMOOTH = 2.0
LETTERS = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"(?<!\S)[^\W\d_a-z]{2,}")
ODD_TOKEN = re.compile(r"(?<!\S)\S*[!#$%&*+/<=>@\\^_`{|}~]\S*")
# ---- fixed values: characters seldom found in prose ----
ODD = str.maketrans("", "", "!#$%&*+/<=>@\\^_`{|}~0123456789")
SHAPES = 7
SIZE = (1 << WORD_BITS) + SHAPES * SHAPE_BINS + 1

_HASHED: dict[str, int] = {}


def _word(word: str) -> int:
    found = _HASHED.get(word)
    if found is None:
        if len(_HASHED) > 100_000:
            _HASHED.clear()
        found = _HASHED[word] = zlib.crc32(word.encode("utf-8")) >> (32 - WORD_BITS)
    return found


def _share(part: float, whole: float) -> int:
    """Bin of a share: 0 for none, then by powers of two."""
    if part <= 0 or whole <= 0:
        return 0
    return max(1, SHAPE_BINS - 1 + int(np.ceil(np.log2(min(1.0, part / whole)))))


def features(text: str) -> np.ndarray:
    """Numbers of the features a text has: its words, one bin for each shape, the constant."""
    words = LETTERS.findall(text.lower())
    tokens = text.split()
    n = len(tokens)
    odd = len(text) - len(text.translate(ODD))
    capitals = len(CAPITALS.findall(text))
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    distinct = len(set(tokens))
    shapes = [
        _share(odd, len(text)),
        _share(len(ODD_TOKEN.findall(text)), n),
        _share(capitals, n),
        _share(repeats, n),
        _share(n - distinct, n) if n >= 20 else 0,
        min(SHAPE_BINS - 1, len(text).bit_length() // 2),
        min(SHAPE_BINS - 1, (len(text) // n) if n else 0),
    ]
    base = 1 << WORD_BITS
    fixed = [base + i * SHAPE_BINS + b for i, b in enumerate(shapes)]
    return np.array([*set(map(_word, set(words))), *fixed, SIZE - 1], np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of one logistic model per column of ``labels`` (0, 1).

    A feature's scale is how much more often than expected it is seen in one class, as
    a log ratio smoothed by ``SMOOTH`` sightings; for words, the first unit of it is
    taken as chance and dropped. The model learns one factor per feature on that
    scale, by full-batch gradient steps with Adam's scaling and a ridge.
    """
    sizes = np.array([len(r) for r in rows])
    flat, owner_of = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    seen = np.bincount(flat, minlength=SIZE)
    out = np.zeros((labels.shape[1], SIZE))
    for k in range(labels.shape[1]):
        y = labels[:, k]
        ones, share = np.bincount(flat, y[owner_of], SIZE), y.mean()
        more = lambda c, e: np.log((c + SMOOTH) / (e + SMOOTH))
        scale = more(ones, seen * share) - more(seen - ones, seen * (1 - share))
        words = scale[: 1 << WORD_BITS]
        words[:] = np.sign(words) * np.maximum(0, np.abs(words) - 1)
        scale[SIZE - 1] = 1
        used = np.flatnonzero(scale[flat])
        owner, cols = owner_of[used], flat[used]
        # only features with a scale take part from here on
        kept, cols = np.unique(cols, return_inverse=True)
        value = scale[kept][cols]
        w, m, v = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))  # the constant starts at the labels' log odds
        for t in range(1, rounds + 1):
            z = np.bincount(owner, value * w[cols], len(y))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = np.bincount(cols, value * (p - y)[owner], len(kept)) / len(y) + RIDGE * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        out[k, kept] = w * scale[kept]
    return out.astype(np.float32)


def bounded(found: np.ndarray, most: int) -> np.ndarray:
    """The features a model is fitted on: all, or of very many words ``most`` spread evenly
    over their numbers (which are hashes), and all shapes."""
    words, rest = found[: -SHAPES - 1], found[-SHAPES - 1 :]
    if len(words) <= most:
        return found
    words = np.sort(words)
    return np.concatenate([words[np.arange(most) * len(words) // most], rest])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> list:
    """(id, features, quality, toxic) of at most ``rows`` labelled documents, chosen by a
    hash of their id among those that ``docs`` has. Of several rows of an id the one
    with the smallest hash of its text counts. The chosen ids, ``rows`` at most, are
    broadcast; what the driver collects is bounded by ``rows`` times ``SAMPLE_FEATURES``
    numbers, however long the texts are. Scoring reads all features of every text."""
    ship_package(docs.sparkSession)
    complete = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    complete = complete.select(
        F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    ).dropDuplicates(["l_id"])
    found = docs.select(docs[doc_id].alias("d_id"), docs[text].alias("text"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("hash"))
    there = found.groupBy("d_id").agg(F.min("hash").alias("l_hash"))
    few = complete.join(there, F.col("d_id") == F.col("l_id")).drop("d_id").orderBy(F.xxhash64("l_id"), "l_id").limit(rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bounded(features(v.as_py() or ""), SAMPLE_FEATURES).tobytes() for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("l_id"), pa.array(found, pa.binary()), batch.column("quality"), batch.column("toxic")],
                ["l_id", "features", "quality", "toxic"],
            )

    joined = found.join(F.broadcast(few), (F.col("d_id") == F.col("l_id")) & (F.col("hash") == F.col("l_hash")))
    sample = joined.select("l_id", "text", "quality", "toxic").mapInArrow(extract, "l_id bigint, features binary, quality int, toxic int")
    # equal rows have equal features
    sample = sample.dropDuplicates(["l_id"])
    return sorted((r["l_id"], bytes(r["features"]), r["quality"], r["toxic"]) for r in sample.collect())


def train(sample: list) -> np.ndarray:
    """Weights of the quality and the toxicity model; zeros without a sample."""
    if not sample:
        return np.zeros((2, SIZE), np.float32)
    return fit([np.frombuffer(f, np.int32) for _, f, _, _ in sample], np.array([[q, t] for _, _, q, t in sample], float))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, quality, toxic (probabilities after pooling), own_quality,
    own_toxic (before), host_quality, path_quality, host_toxic, path_toxic (shrunk rates), kept,
    text_hash, host, path. Rows equal in id, text, host and path have equal scores.

    ``kept``: more likely good than not, and more likely not toxic than toxic.
    ``host`` and ``path`` default to the columns source and lang. Null hosts and
    paths are a site of their own. Null text counts as empty; a document without
    words is not kept. Repeated rows each count in their site's rate. Labels with a
    null or for unknown ids are not used; of several labels of an id one is, and of
    several rows of a labelled id one is fitted on. Without labels all scores are 0.5 and
    nothing is kept. Very long texts are scored by all their features. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "quality")
    weights = train(labelled_sample(docs, labels, sample_rows, doc_id, text))
    model = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            own = [[], [], []]
            for value in batch.column("text"):
                found = features(value.as_py() or "")
                for k in range(2):
                    own[k].append(float(w[k][found].sum(dtype=np.float64)))
                own[2].append(len(found) > SHAPES + 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(own[0], pa.float64()), pa.array(own[1], pa.float64()), pa.array(own[2], pa.bool_())],
                ["doc_id", "host", "path", "text_hash", "e_quality", "e_toxic", "has_words"],
            )

    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    read = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"),
        F.concat(F.lit("="), host.cast("string")).alias("host"),
        F.concat(F.lit("="), path.cast("string")).alias("path"),
        docs[text].alias("text"),
    ).select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = read.mapInArrow(score, "doc_id bigint, host string, path string, text_hash bigint, e_quality double, e_toxic double, has_words boolean")
    for name in ("quality", "toxic"):
        rows = rows.withColumn(f"p_{name}", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(f"e_{name}"))))))
    rows = ws.table(rows, "own")
    paths = ws.table(
        rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_quality").alias("quality"), F.sum("p_toxic").alias("toxic")),
        "paths",
    )
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in ("n", "quality", "toxic")])
    sites = paths.join(hosts, "host")
    whole, strength_host, strength_path = _strengths(paths, hosts)
    placed = rows.join(sites, ["host", "path"])
    out = placed
    for name in ("quality", "toxic"):
        p = F.col(f"p_{name}")
        # the document itself is left out of its site's sums
        host_rate = (F.col(f"h_{name}") - p + strength_host[name] * whole[name]) / (F.col("h_n") - 1 + strength_host[name])
        out = out.withColumn(f"host_{name}", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), host_rate)))
        path_rate = (F.col(name) - p + strength_path[name] * F.col(f"host_{name}")) / (F.col("n") - 1 + strength_path[name])
        out = out.withColumn(f"path_{name}", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path_rate)))
        site = F.log(F.col(f"path_{name}") / (1 - F.col(f"path_{name}")))
        usual = float(np.log(whole[name] / (1 - whole[name])))
        out = out.withColumn(f"final_{name}", F.col(f"e_{name}") - F.lit(usual) + site)
    odds = lambda c: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(c)))))
    return out.select(
        "doc_id",
        odds("final_quality").alias("quality"),
        odds("final_toxic").alias("toxic"),
        F.col("p_quality").alias("own_quality"),
        F.col("p_toxic").alias("own_toxic"),
        "host_quality",
        "path_quality",
        "host_toxic",
        "path_toxic",
        (F.col("has_words") & (F.col("final_quality") > 0) & (F.col("final_toxic") < 0)).alias("kept"),
        "text_hash",
        F.when(F.col("host") != "", F.substring("host", 2, 1 << 30)).alias("host"),
        F.when(F.col("path") != "", F.substring("path", 2, 1 << 30)).alias("path"),
    )


def _strengths(paths: DataFrame, hosts: DataFrame) -> tuple[dict, dict, dict]:
    """Global rates, and how many documents a prior is worth at either level: from the
    variance of rates between sites beyond what sampling explains. One row is collected."""
    names = ("quality", "toxic")
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    n = total["n"] or 0
    whole = {c: (total[c] + 0.5) / (n + 1) if n else 0.5 for c in names}
    host_stats = hosts.agg(
        *[F.sum(F.col("h_n") * (F.col(f"h_{c}") / F.col("h_n") - whole[c]) ** 2).alias(c) for c in names],
        F.count("*").alias("sites"), F.sum(F.col("h_n") * F.col("h_n")).alias("sq"),
    ).first()
    both = paths.join(hosts, "host")
    path_stats = both.agg(
        *[F.sum(F.col("n") * (F.col(c) / F.col("n") - F.col(f"h_{c}") / F.col("h_n")) ** 2).alias(c) for c in names],
        F.count("*").alias("sites"), F.sum(F.col("n") * F.col("n")).alias("sq"),
    ).first()

    def strength(spread: float | None, sites: int, sq: float | None, rate: float) -> float:
        noise = rate * (1 - rate)
        if not n or sites < 2 or not noise:
            return 1e4
        between = (spread - (sites - 1) * noise) / max(1.0, n - sq / n)
        return float(min(1e4, max(2.0, noise / between - 1))) if between > 0 else 1e4

    return (
        whole,
        {c: strength(host_stats[c], host_stats["sites"], host_stats["sq"], whole[c]) for c in names},
        {c: strength(path_stats[c], path_stats["sites"], path_stats["sq"], whole[c]) for c in names},
    )
