"""Near-duplicate detection: MinHash signatures joined by multi-index Hamming search.

A document's signature holds ``POSITIONS`` MinHash values of ``b`` bits. The
distance of two signatures is the number of positions that differ. Signatures are
cut into chunks; with fewer differing positions than ``ERRORS + 1`` per chunk, some
chunk has at most ``ERRORS`` of them (pigeonhole). So each chunk is indexed under
every choice of ``ERRORS`` positions left out, and every pair within the distance
meets under one key at least. Chunks of 5 positions allow 23 of 60 to differ, chunks
of 4 allow 29; a pair at the threshold (0.85, or 0.8 for the smaller chunks) differs
in more with a probability of about one in a million.

Only components are asked for, so no group's pairs are listed:

* documents with equal sets are one node;
* a shingle that no other candidate has cannot be shared; a node with more than 15%
  of such shingles has no link at all;
* under each key all nodes are compared in full with one of them, the leader;
* a key whose nodes are in one component by then is settled. The nodes of the others
  meet once more, by an exact prefix join: in an order of all shingles by their number
  of owners, the rarest first, two sets with a link share one of their first shingles
  (a set of n lacks at most n - percent of n of them). Nodes of different components
  that share such a shingle, and have enough shingles left after it, are compared in
  full unless parity sketches rule the link out: a bit is the parity of the number of
  shingles hashed to it, so each differing bit takes a differing shingle. Nodes of one
  component are never paired.

No bound, cap or sample decides a link; links are confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.components import components
from paylens.llm.shingles import mix, shingle_sets
from paylens.llm.workspace import Workspace, ship_package

POSITIONS, ERRORS = 60, 1
WORDS = 5
PARITY_WORDS = 16
SEED = 20240607

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS values of 16 bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * FACTORS + SHIFTS).min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def chunk_size(percent: int) -> int:
    """Positions per chunk that keep pairs of this similarity within the distance."""
    if not 80 <= percent <= 100:
        raise ValueError("the index is laid out for 80 percent or more")
    return 5 if percent >= 85 else 4


def distance(size: int) -> int:
    """Differing positions up to which every pair meets, for chunks of ``size``."""
    return (POSITIONS // size) * (ERRORS + 1) - 1


def chunk_keys(signatures: np.ndarray, size: int) -> np.ndarray:
    """Per signature the 64-bit keys of every chunk with ERRORS positions left out."""
    wide = signatures.astype(np.uint64)
    out = []
    for chunk in range(0, POSITIONS, size):
        for left in combinations(range(size), size - ERRORS):
            key = np.full(len(wide), chunk * 100 + sum(1 << i for i in left), np.uint64)
            for i in left:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, chunk + i])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64) if out else np.zeros((len(wide), 0), np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, sigs = [], [], []
        for s in shingle_sets(batch.column("text"), WORDS):
            sizes.append(len(s))
            halves = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64)], "<u8")
            prints.append(halves.tobytes() + len(s).to_bytes(8, "little"))
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
            ["doc_id", "text_hash", "n", "print", "sig"],
        )


def _keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, POSITIONS)
            keys = chunk_keys(sigs, size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "keys"])

    return run


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY_WORDS numbers of 64 bits: the parity of the shingles hashed to each bit."""
    bits = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), WORDS))
        at = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
        sketches = np.stack([parity(s) for s in sets], axis=1) if sets else np.zeros((PARITY_WORDS, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), lists, *map(pa.array, sketches)], ["node", "shingles", *(f"p{i}" for i in range(PARITY_WORDS))]
        )


def near_components(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash, chosen.

    Linked are documents whose sets of 5-word shingles have
    100 * |intersection| >= percent * |union|; ``component_id`` is the smallest id
    reachable. ``percent`` must be 80 or more.

    Null text counts as empty; a text without words has an empty set and is linked
    with nothing: its component is its own id. Repeated rows are linked as any equal
    texts, and all rows that bear the component's id are kept. Null ids take part;
    they are never a component's id unless all its ids are null. ``chosen`` are the
    rows of one (doc_id, text_hash) of each component: its smallest id, nulls last,
    and of that the smallest hash; rows equal in both are all chosen. The set of a very
    long text is whole: eight bytes a distinct shingle in one row. An empty table gives an
    empty result. Other columns are ignored.
    """
    chunk_size(percent)
    spark = docs.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "near")
    base = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    sigs = ws.table(
        base.mapInArrow(_signatures, "doc_id bigint, text_hash bigint, n bigint, print binary, sig binary"), "sigs"
    )
    nodes = ws.table(
        sigs.filter("n > 0")
        .groupBy("print")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"),
            F.first("sig").alias("sig"),
            F.first("n").alias("n"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "print", "sig", "n", "row.doc_id", "row.text_hash"),
        "nodes",
    )
    links = _links(base, nodes, percent, ws)
    labels = components(links, ws, "final")
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    ids = named.groupBy("component").agg(first.alias("first"))
    of_print = named.join(ids, "component").select(
        "print", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash")
    )
    out = sigs.select("doc_id", "text_hash", "n", "print").join(of_print, "print", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
        ((F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("component_hash")))).alias("chosen"),
    )


def _links(base: DataFrame, nodes: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    keyed = nodes.select("node", "sig").mapInArrow(_keys(chunk_size(percent)), "node bigint, keys array<bigint>").select(
        "node", F.explode("keys").alias("key")
    )
    meets = ws.table(_shared(keyed), "meets")
    wanted = meets.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    same_row = base["doc_id"].eqNullSafe(F.col("w_id")) & (base["text_hash"] == F.col("w_hash"))
    texts = base.join(
        wanted.select("node", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")), same_row
    ).select("node", "text")
    sets = ws.table(
        texts.mapInArrow(_sets, "node bigint, shingles array<bigint>, " + ", ".join(f"p{i} bigint" for i in range(PARITY_WORDS)))
        .dropDuplicates(["node"])
        .withColumn("n", F.size("shingles").cast("bigint")),
        "sets",
    )
    # shingles with one owner; 32 bits will do, as a clash only lowers the count
    alone = (
        sets.select("node", F.explode("shingles").alias("s"))
        .select("node", F.expr("s & 4294967295L").alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("owners"), F.min("node").alias("node"))
        .filter("owners = 1")
        .groupBy("node")
        .agg(F.count("*").alias("alone"))
    )
    able = ws.table(
        sets.select("node", "n")
        .join(alone, "node", "left")
        .withColumn("alone", F.coalesce("alone", F.lit(0)))
        .filter(F.expr(f"100 * (n - alone) >= {percent} * n")),
        "able",
    )
    live = ws.table(_shared(meets.join(able.select("node"), "node")).join(able, "node"), "live")
    leaders = live.groupBy("key").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "node")).alias("best"))
    led = ws.table(live.join(leaders.select("key", F.col("best.node").alias("leader")), "key"), "led")
    star = ws.table(
        _compared(led.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), sets),
        "star",
    )
    near = F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")
    first = star.filter(near).select("a", "b")
    labels = components(first, ws, "star")
    marked = led.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = marked.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
    unsettled = ws.table(marked.join(open_keys, "key", "left_semi").select("node", "component").distinct(), "open")
    pairs = _prefix_pairs(unsettled, sets, percent, ws)
    second = _compared(pairs, sets).filter(near).select("a", "b")
    return ws.table(first.union(second), "links")


def _prefix_pairs(unsettled: DataFrame, sets: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """(a, b): every pair of nodes (node, component) with a link between different
    components, and others that neither places nor sketches rule out.

    Each set is read from its rarest shingle on; ``left`` is the number of shingles from
    one to the end. Shingles that no other node has come first and meet nothing. A linked
    pair's first common shingle leaves at least the size of the intersection in both sets.
    """
    grams = unsettled.join(sets.select("node", "n", "shingles"), "node").select("node", "component", "n", F.explode("shingles").alias("s"))
    owners = grams.groupBy("s").agg(F.count("*").alias("owners")).filter("owners > 1")
    commonest_first = W.partitionBy("node").orderBy(F.desc("owners"), F.desc("s"))
    prefix = ws.table(
        grams.join(owners, "s")
        .withColumn("left", F.row_number().over(commonest_first).cast("bigint"))
        .filter(f"100 * left >= {percent} * n")
        .select("s", "node", "component", "n", "left"),
        "prefix",
    )
    groups = prefix.groupBy("s", "component").agg(F.max("left").alias("left"), F.min("n").alias("n"))
    others = groups.select(F.col("s").alias("o_s"), F.col("component").alias("other"), F.col("left").alias("o_left"), F.col("n").alias("o_n"))
    enough = f"(100 + {percent}) * least(left, o_left) >= {percent} * (n + o_n)"
    meeting = groups.join(others, F.expr("s = o_s AND component < other")).filter(enough).select("s", "component", "other")
    low = prefix.select("s", "component", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    high = prefix.select("s", F.col("component").alias("other"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    met = (
        meeting.join(low, ["s", "component"])
        .join(high, ["s", "other"])
        .filter(f"(100 + {percent}) * least(left_a, left_b) >= {percent} * (n_a + n_b)")
        .select("a", "b", "n_a", "n_b")
        .distinct()
    )
    sketch = [f"p{i}" for i in range(PARITY_WORDS)]
    unlike = " + ".join(f"bit_count(a_{p} ^ b_{p})" for p in sketch)
    of_a = sets.select(F.col("node").alias("a"), *[F.col(p).alias(f"a_{p}") for p in sketch])
    of_b = sets.select(F.col("node").alias("b"), *[F.col(p).alias(f"b_{p}") for p in sketch])
    # both differences are at most what a link allows
    like = met.join(of_a, "a").join(of_b, "b").filter(f"(100 + {percent}) * ({unlike}) <= (100 - {percent}) * (n_a + n_b)")
    return like.select("a", "b")


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, node) of the keys that two nodes or more have."""
    other = keyed.select(F.col("key").alias("o_key"), F.col("node").alias("o_node"))
    return keyed.join(other, (F.col("key") == F.col("o_key")) & (F.col("node") != F.col("o_node")), "left_semi").select("key", "node")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common) by whole sets."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    return (
        pairs.join(b, "b")
        .join(a, "a")
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("bigint").alias("common"))
    )
