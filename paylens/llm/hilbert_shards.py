"""Sharding along a Hilbert curve.

Each document gets a cell in a grid over several metadata dimensions (source,
language, size, id). Documents are sorted by their cell's index on the Hilbert
curve and the sorted order is cut into equal runs, so a shard covers a compact
region in every dimension and a reader filtering on any of them can skip most
shards by their min/max.

Only built-in functions: the text is read once, for its size and checksum; from
there on rows are a few numbers wide. Ranks come from a range partitioning, a
count per range and a row number within each range, never from one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.workspace import Workspace, partitions

TEXT_KEY_BYTES = 6


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` bits per coordinate
    (Skilling's transpose form, folded bit by bit over an array)."""
    n = len(coords)
    x = F.array(*[c.cast("bigint") for c in coords])
    high = [1 << b for b in range(bits - 1, 0, -1)]
    turns = F.array(*[F.struct(F.lit(q).cast("bigint").alias("q"), F.lit(i).alias("i")) for q in high for i in range(n)])

    def turn(acc, s):
        low = s["q"] - 1
        first, here = F.get(acc, F.lit(0)), F.get(acc, s["i"])
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.when(
            here.bitwiseAND(s["q"]) != 0,
            F.transform(acc, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)),
        ).otherwise(F.transform(acc, lambda v, k: F.when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    if high:
        x = F.aggregate(turns, x, turn)
    gray = F.aggregate(
        x,
        F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, v: F.struct(
            acc["last"].bitwiseXOR(v).alias("last"), F.array_append(acc["out"], acc["last"].bitwiseXOR(v)).alias("out")
        ),
    )["out"]
    flip = F.aggregate(
        F.array(*[F.lit(q).cast("bigint") for q in high]) if high else F.array().cast("array<bigint>"),
        F.struct(F.element_at(gray, -1).alias("last"), F.lit(0).cast("bigint").alias("t")),
        lambda acc, q: F.struct(
            acc["last"].alias("last"),
            F.when(acc["last"].bitwiseAND(q) != 0, acc["t"].bitwiseXOR(q - 1)).otherwise(acc["t"]).alias("t"),
        ),
    )["t"]
    final = F.struct(gray.alias("x"), flip.alias("t"))
    order = F.array(
        *[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)]
    )
    return F.aggregate(
        order,
        F.struct(final.alias("p"), F.lit(0).cast("bigint").alias("h")),
        lambda acc, s: F.struct(
            acc["p"].alias("p"),
            (
                acc["h"] * 2
                + F.when(F.get(acc["p"]["x"], s["i"]).bitwiseXOR(acc["p"]["t"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0)
            ).alias("h"),
        ),
        lambda acc: acc["h"],
    )


def _text_number(col: Column, skip_hex: int) -> Column:
    """The bytes after the corpus-wide common prefix as a number that sorts like the text."""
    tail = F.substring(F.hex(col.cast("binary")), skip_hex + 1, 2 * TEXT_KEY_BYTES)
    return F.conv(F.rpad(tail, 2 * TEXT_KEY_BYTES, "0"), 16, 10).cast("double")


def _cell(value: Column, low: float, high: float, cells: int) -> Column:
    """Equal-width cell of ``value`` in [low, high]; nulls are in the last cell."""
    cell = F.floor((value - F.lit(low)) / F.lit(high - low + 1.0) * cells).cast("int")
    return F.coalesce(F.least(F.lit(cells - 1), F.greatest(F.lit(0), cell)), F.lit(cells - 1))


def _text_bounds(low: str | None, high: str | None) -> tuple[int, float, float]:
    """Hex digits shared by all values, and the numbers of the least and greatest."""
    if low is None:
        return 0, 0.0, 0.0
    a, b = low.encode().hex(), high.encode().hex()
    skip = 0
    while skip + 2 <= min(len(a), len(b)) and a[skip : skip + 2] == b[skip : skip + 2]:
        skip += 2
    number = lambda h: float(int(h[skip : skip + 2 * TEXT_KEY_BYTES].ljust(2 * TEXT_KEY_BYTES, "0"), 16))
    return skip, number(a), number(b)


def with_curve_index(df: DataFrame, texts: list[str], numbers: list[str], sizes: list[str], bits: int = 4) -> DataFrame:
    """Add ``curve_index``: the Hilbert index over the given dimensions.

    ``texts`` are cut into equal steps of the bytes after their common prefix,
    ``numbers`` into equal steps between least and greatest, ``sizes`` by powers
    of two from 8 upwards. Nulls are in a dimension's last cell. The only thing
    collected is one row of minima and maxima.
    """
    cells = 1 << bits
    wanted = [f(c).alias(f"{n}_{c}") for c in [*texts, *numbers] for n, f in (("lo", F.min), ("hi", F.max))]
    bound = df.agg(*wanted).first().asDict() if wanted else {}
    coords = []
    for c in texts:
        skip, low, high = _text_bounds(bound[f"lo_{c}"], bound[f"hi_{c}"])
        coords.append(_cell(_text_number(F.col(c), skip), low, high, cells))
    for c in numbers:
        low, high = float(bound[f"lo_{c}"] or 0), float(bound[f"hi_{c}"] or 0)
        coords.append(_cell(F.col(c).cast("double"), low, high, cells))
    for c in sizes:
        octave = F.length(F.bin(F.greatest(F.col(c), F.lit(8)))) - 4
        coords.append(F.coalesce(F.least(octave, F.lit(cells - 1)), F.lit(cells - 1)))
    return df.withColumn("curve_index", hilbert_index(coords, bits))


def hilbert_shards(
    docs: DataFrame,
    shards: int = 24,
    law: str = "rows",
    bits: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index.

    ``law='rows'``: shard sizes differ by one row at most. ``law='bytes'``: the
    middle of each document in the running sum of sizes decides, so shards differ
    by about one document. ``slot`` counts from 0 within each shard, in curve order.

    Null text has size 8 and crc32 0 (as the empty text); a null id, source or
    language is in its dimension's last cell. Ties in (curve_index, doc_id, size,
    crc32) take any order, drawn once and written down; rows equal in all of these
    are interchangeable in the result. Of a text of any length only size and checksum move
    on. An empty table gives an empty result. Other columns are ignored, whatever their
    names.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    ws = Workspace(spark, "hilbert")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = ws.table(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.col(lang).alias("lang"),
            (F.octet_length(body) + 8).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.rand(7).alias("tie"),
        ),
        "narrow",
    )
    order = ["curve_index", "doc_id", "size", "text_crc32", "tie"]
    ranged = ws.table(
        with_curve_index(narrow, ["source", "lang"], ["doc_id"], ["size"], bits)
        .drop("source", "lang")
        .repartitionByRange(partitions(spark), *order)
        .withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    # one row per range: where it starts in the whole order
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part")
        .agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        .select(
            "part",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        )
    )
    total = ranged.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    n, size_sum = total["n"], total["b"]
    inside = W.partitionBy("part").orderBy(*order)
    placed = ranged.join(starts, "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "curve_index",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("pos"),
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    if law == "rows":
        shard = F.expr(f"pos * {shards} div {max(n, 1)}").cast("int")
        slot = F.col("pos") - F.expr(f"(shard * bigint({n}) + {shards - 1}) div {shards}")
        out = placed.withColumn("shard", shard).withColumn("slot", slot)
    else:
        middle = F.expr(f"cast(floor((start + size / 2) / {max(size_sum, 1)}D * {shards}) as int)")
        out = placed.withColumn("shard", F.least(F.lit(shards - 1), middle))
        firsts = out.groupBy("shard").agg(F.min("pos").alias("first"))
        out = out.join(firsts, "shard").withColumn("slot", F.col("pos") - F.col("first"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )
