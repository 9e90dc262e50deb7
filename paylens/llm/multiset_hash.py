"""Homomorphic multiset hash of a document's paragraphs.

Each paragraph (a non-empty line, or a sentence of it: a line is also cut after a full
stop, exclamation or question mark before a blank) is hashed to a wide vector; a
document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo a
power of two. The order of paragraphs does not matter, and adding or removing paragraphs
adds or subtracts their vectors without reading the rest.

The vector has ``WIDE`` lanes of 56 bits, in which every paragraph has a value, and
``SPOTS`` lanes of 16 bits, in which a paragraph has a value in one lane only; they make
fingerprints of different multisets differ.

What two documents share is told by sparse lanes: a paragraph falls into level k with
a probability of 2^-(k+1), and there into one of ``SPARSE`` lanes, which hold a count
and a sum of values. They are added and subtracted like the rest of the fingerprint, and
some level always has few differing lanes, however long the documents are.

Built-in functions only; everything but the neighbour's text is local to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.ranges import number_cuts, range_bucket
from paylens.llm.workspace import partitions

SENTENCE_END = "([.!?]) "
WIDE, WIDE_HEX = 4, 14
SPOTS, SPOT_HEX = 32, 4
LEVELS, SPARSE, SPARSE_BITS = 24, 256, 40


def _number(hexes: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(hexes, start, length), 16, 10).cast("bigint")


def _modulus(lane: Column) -> Column:
    return F.when(lane < WIDE, F.lit((1 << 4 * WIDE_HEX) - 1)).otherwise(F.lit((1 << 4 * SPOT_HEX) - 1))


def paragraph_values(text: Column) -> Column:
    """Per paragraph: its values in the wide lanes, its spot and its value there."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1\n"), "\n"), lambda p: p != "")
    digests = F.transform(lines, lambda p: F.sha2(p.cast("binary"), 256))
    return F.transform(
        digests,
        lambda h: F.struct(
            F.array(*[_number(h, 1 + i * WIDE_HEX, WIDE_HEX) for i in range(WIDE)]).alias("wide"),
            (_number(h, 57, 2) % SPOTS).alias("spot"),
            _number(h, 59, SPOT_HEX).alias("value"),
        ),
    )


def fingerprint_vector(values: Column) -> Column:
    """Sum of the paragraphs' vectors: an array of WIDE + SPOTS numbers."""
    mask, low = (1 << 4 * WIDE_HEX) - 1, (1 << 4 * SPOT_HEX) - 1
    zero = F.lit(0).cast("bigint")
    wide = [
        F.aggregate(values, zero, (lambda i: lambda a, v: (a + F.get(v["wide"], F.lit(i))).bitwiseAND(F.lit(mask)))(i))
        for i in range(WIDE)
    ]
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(SPOTS - 1)),
        lambda s: F.aggregate(
            values, zero, lambda a, v: F.when(v["spot"] == s, (a + v["value"]).bitwiseAND(F.lit(low))).otherwise(a)
        ),
    )
    return F.concat(F.array(*wide), spots)


def add(left: Column, right: Column) -> Column:
    """Fingerprint of both documents' paragraphs together."""
    return F.transform(F.zip_with(left, right, lambda a, b: a + b), lambda v, i: v.bitwiseAND(_modulus(i)))


def remove(left: Column, right: Column) -> Column:
    """Fingerprint of ``left`` without the paragraphs of ``right``."""
    return F.transform(F.zip_with(left, right, lambda a, b: a - b), lambda v, i: v.bitwiseAND(_modulus(i)))


def to_text(vector: Column) -> Column:
    """Fixed-width hexadecimal digits of all lanes."""
    digits = F.transform(
        vector, lambda v, i: F.lpad(F.lower(F.hex(v)), F.when(i < WIDE, WIDE_HEX).otherwise(SPOT_HEX), F.lit("0"))
    )
    return F.array_join(digits, "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _summed(entries: Column) -> Column:
    """Entries (lane, count, value, total) added up lane by lane, in order of lanes."""
    zero = F.lit(0).cast("bigint")

    def by_lane(e):
        new = F.filter(
            F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(e, i)["lane"] != F.get(e, F.greatest(i - 1, F.lit(0)))["lane"])
        )
        return _bound(F.concat(new, F.array(F.size(e))), lambda ends: _runs(e, ends))

    def _runs(e, ends):
        def run(start, j):
            total = lambda c: lambda part: F.aggregate(part, zero, lambda a, x: a + x[c])
            return _bound(
                F.slice(e, start + 1, F.get(ends, j + 1) - start),
                lambda part: F.struct(
                    F.get(part, F.lit(0))["lane"].alias("lane"),
                    total("count")(part).alias("count"),
                    total("value")(part).bitwiseAND(F.lit((1 << SPARSE_BITS) - 1)).alias("value"),
                    total("total")(part).alias("total"),
                ),
            )

        return F.transform(F.slice(ends, 1, F.size(ends) - 1), run)

    return F.when(F.size(entries) > 0, _bound(F.array_sort(entries), by_lane)).otherwise(F.filter(entries, lambda e: F.lit(False)))


def sparse_lanes(values: Column) -> Column:
    """The lanes that the paragraphs of ``paragraph_values`` fall into: (lane, count, value, total)."""

    def entry(v):
        at, spot, value = (F.get(v["wide"], F.lit(i)) for i in range(3))
        # zeros at the end of LEVELS - 1 bits of the hash
        level = F.bit_count((at.bitwiseOR(F.lit(1 << LEVELS - 1))).bitwiseAND(-at.bitwiseOR(F.lit(1 << LEVELS - 1))) - 1)
        one = F.lit(1).cast("bigint")
        return F.struct(
            (level * SPARSE + spot.bitwiseAND(F.lit(SPARSE - 1))).cast("int").alias("lane"),
            one.alias("count"),
            value.bitwiseAND(F.lit((1 << SPARSE_BITS) - 1)).alias("value"),
            one.alias("total"),
        )

    return _summed(F.transform(values, entry))


def _turned(lanes: Column) -> Column:
    return F.transform(lanes, lambda e: F.struct(e["lane"].alias("lane"), (-e["count"]).alias("count"), (-e["value"]).alias("value"), e["total"].alias("total")))


def shared(left: Column, right: Column) -> Column:
    """Share of common paragraphs (with their counts: the smaller over the greater) of
    two documents, from their sparse lanes.

    The paragraphs of both are counted exactly. Those that differ are counted lane by
    lane (by the counts, or two where only the values differ) from the first level on
    after which a quarter of the lanes differs at most. Levels before it have as many
    as that one's share of all hashes makes likely, or as their counts differ by at
    least. With up to some 100 differing paragraphs the result is nearly exact; with
    any number more its standard error is a few hundredths. 1 for two empty documents.
    """
    zero = F.lit(0).cast("bigint")

    def differs(e):
        return F.when(e["count"] != 0, F.abs(e["count"])).otherwise(F.when(e["value"] != 0, F.lit(2)).otherwise(F.lit(0))).cast("bigint")

    def of_levels(lanes):
        return F.transform(
            F.sequence(F.lit(0), F.lit(LEVELS - 1)),
            lambda k: _bound(
                F.filter(lanes, lambda e: (e["lane"] >= k * SPARSE) & (e["lane"] < (k + 1) * SPARSE) & (differs(e) > 0)),
                lambda part: F.struct(
                    F.size(part).alias("lanes"), F.aggregate(part, zero, lambda a, e: a + differs(e)).alias("differ")
                ),
            ),
        )

    def estimate(lanes, levels):
        full = F.array_max(F.transform(levels, lambda x, k: F.when(x["lanes"] > SPARSE // 4, k + 1).otherwise(F.lit(0))))
        first = F.least(full, F.lit(LEVELS - 1))

        def differing(k):
            sparse = F.aggregate(F.slice(levels, k + 1, LEVELS), zero, lambda a, x: a + x["differ"])
            return _bound(
                sparse,
                lambda seen: F.aggregate(
                    F.transform(F.slice(levels, 1, k), lambda x, j: F.greatest(x["differ"].cast("double"), seen * F.pow(F.lit(2.0), k - j - 1))),
                    seen.cast("double"),
                    lambda a, x: a + x,
                ),
            )

        total = F.aggregate(lanes, zero, lambda a, e: a + e["total"])
        return _bound(
            F.struct(total.alias("all"), _bound(first, differing).alias("differ")),
            lambda x: F.when(x["all"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), x["all"] - x["differ"]) / (x["all"] + x["differ"])),
        )

    return _bound(_summed(F.concat(left, _turned(right))), lambda lanes: _bound(of_levels(lanes), lambda levels: estimate(lanes, levels)))


def with_next_in_order(docs: DataFrame, doc_id: str, carry: list[str], tie: str, compute: dict[str, Column]) -> DataFrame:
    """Each row with ``next_<c>`` of the row after it in descending ``doc_id`` (nulls
    last, ties by ``tie``); the first row comes after the last.

    Ids are cut into ranges (percentiles), null ids into ranges of the tie, one per
    partition; inside a range the next row is a ``lead``. Each range also gets a copy of the row that follows it.
    The driver holds one id per range. ``compute`` columns are added after the
    shuffle, so that they are not part of it.
    """
    n = partitions(docs.sparkSession)
    cuts = number_cuts(docs, doc_id, n)
    known = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    # null ids come last, in ranges of their ties, which are hashes
    nulls = max(1, n // 3)
    nth = F.least(F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * nulls), F.lit(nulls - 1))
    bucket = F.when(F.col(doc_id).isNull(), nulls - 1 - nth).otherwise(range_bucket(F.col(doc_id), known, len(cuts)) + nulls).cast("int")
    own = docs.withColumn("_bucket", bucket).withColumn("_copy", F.lit(False))
    tops = own.groupBy("_bucket").agg(F.max(doc_id).alias("top")).orderBy(F.desc("_bucket")).collect()
    if not tops:
        follows = own
    else:
        # range -> the range before it, whose last row needs this one's first
        reader = {row["_bucket"]: tops[i - 1]["_bucket"] for i, row in enumerate(tops)}
        firsts = F.col(doc_id).isin([r["top"] for r in tops if r["top"] is not None])
        if any(r["top"] is None for r in tops):
            firsts = firsts | F.col(doc_id).isNull()
        to = F.create_map(*[F.lit(x) for pair in reader.items() for x in pair])
        rest = [c for c in docs.columns]
        copies = (
            own.filter(F.coalesce(firsts, F.lit(False)))
            .groupBy("_bucket")
            .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(tie)).alias("row"))
            .select("row.*", F.element_at(to, F.col("_bucket")).alias("_bucket"), F.lit(True).alias("_copy"))
        )
        follows = own.unionByName(copies)
    order = W.partitionBy("_bucket").orderBy("_copy", F.col(doc_id).desc_nulls_last(), tie)
    spread = follows.repartitionById(n + nulls, F.col("_bucket"))
    for name, value in compute.items():
        spread = spread.withColumn(name, value)
    for c in carry:
        spread = spread.withColumn(f"next_{c}", F.lead(c).over(order))
    return spread.filter(~F.col("_copy")).drop("_bucket", "_copy")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) characters replaced by the
    first as many (or all) of the next document in descending id. ``near_*`` is the
    likeness to the edited text's and the next document's fingerprint: the share of
    common paragraphs that their sparse lanes tell (``shared``).

    Null text counts as empty; a text without a non-empty line has the zero
    fingerprint. Very long texts are hashed whole. Null ids come last; rows of equal id are ordered by a hash of
    their text. A single row is its own next. An empty table gives an empty result.
    Other columns are ignored.
    """
    base = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    paired = with_next_in_order(
        base,
        "doc_id",
        ["text", "lanes"],
        "tie",
        {"vals": paragraph_values(F.col("text")), "vector": fingerprint_vector(F.col("vals")), "lanes": sparse_lanes(F.col("vals"))},
    )
    n = F.length("text")
    swap = F.floor(n / 3).cast("int")
    edited = paired.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "vector",
        "lanes",
        "next_lanes",
        F.concat(F.substring(F.col("text"), F.lit(1), n - swap), F.substring(F.col("next_text"), F.lit(1), swap)).alias("edited"),
    )
    hashed = (
        edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .withColumn("edited_vals", paragraph_values(F.col("edited")))
        .withColumn("edited_vector", fingerprint_vector(F.col("edited_vals")))
        .withColumn("edited_lanes", sparse_lanes(F.col("edited_vals")))
    )
    return hashed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_text(F.col("vector")).alias("fingerprint"),
        to_text(F.col("edited_vector")).alias("edited_fingerprint"),
        shared(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        shared(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
