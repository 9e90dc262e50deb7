"""Compression of vectors to short codes by product quantisation with adaptive bounds.

Components become integers, vectors are cut into parts, and each part position gets a
codebook by rounds of assignment and averaging. All sums, means and comparisons that
decide are integer arithmetic, so the result does not depend on how rows are dealt out.

Most parts keep their entry from one round to the next. Each part keeps its ``b``
closest entries, with lower bounds of their distances in ascending order, and one outer
lower bound for all other entries. After a round the bounds sink by the distances that
the entries have moved. With the exact distance to its entry as the upper bound, a part
is settled if all bounds lie above it; else its listed entries are compared in integers,
and all entries only if the outer bound does not hold either. Bounds are rounded down
and must be greater, not equal, so ties and rounding always go to the integer test.
``b`` starts at a quarter of the entries and shrinks to what nearly all parts needed, an
eighth at least.

State is a table in the shared folder, one for each round; the driver sees one sum and
count for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.workspace import Workspace, ship_package

SCALE = 4096
#: Components up to this size are compared in 64-bit integers, larger ones in Python's.
NARROW = 1 << 27
WIDEST = 1 << 62
#: Share of the parts whose listed entries should be enough.
ENOUGH = 0.99
#: Numbers in one array of differences.
CELLS = 1 << 21

_SUMS = pa.list_(pa.decimal128(38, 0))


def _roots_below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the square roots, as 32-bit floats."""
    roots = np.sqrt(squares.astype(np.float64)) * (1 - 1e-12)
    return np.maximum(np.nextafter(roots.astype(np.float32), np.float32(-1)), np.float32(0))


def _roots_above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, d) and entries (m, d) or (n, m, d): (n, m)."""
    gap = x[:, None, :] - entries
    return (gap * gap).sum(axis=2)


def _nearest(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, square): the b closest entries, ties by index; bounds of all but the
    first and of the rest; the distance to the first."""
    squares = _squares(x, book)
    order = np.argsort(squares, axis=1, kind="stable")
    ranked = np.take_along_axis(squares, order, axis=1)
    low = np.full((len(x), b), np.inf, np.float32)
    beyond = ranked[:, 1 : b + 1]
    low[:, : beyond.shape[1]] = _roots_below(beyond)
    return order[:, :b].astype(np.uint8), low, ranked[:, 0]


class Part:
    """Assignment of one part position, from round to round."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book = book
        drift = np.zeros(len(book)) if before is None else _roots_above(((book - before) ** 2).sum(axis=1))
        # drift and bounds are subtracted in 64 bits, then rounded down again
        self.drift, self.most = drift, float(drift.max(initial=0.0))

    def assign(self, x: np.ndarray, near: np.ndarray, low: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(near, low, square, depth): ``depth`` is the number of entries that had to be
        looked at, all of them if the outer bound did not hold."""
        sunk = low.astype(np.float64)
        sunk[:, :-1] -= self.drift[near[:, 1:]]
        sunk[:, -1] -= self.most
        low = np.nextafter(sunk.astype(np.float32), np.float32(-np.inf))
        order = np.argsort(low[:, :-1], axis=1, kind="stable")
        low[:, :-1] = np.take_along_axis(low[:, :-1], order, axis=1)
        near = near.copy()
        near[:, 1:] = np.take_along_axis(near[:, 1:], order, axis=1)
        gap = x - self.book[near[:, 0]]
        square = (gap * gap).sum(axis=1)
        upper = _roots_above(square)
        open_ = low <= upper[:, None]
        depth = 1 + open_[:, :-1].sum(axis=1)
        outside = open_[:, -1]
        depth[outside] = len(self.book)

        some = np.flatnonzero((depth > 1) & ~outside)
        if len(some):
            listed = np.sort(near[some], axis=1)
            squares = _squares(x[some], self.book[listed])
            order = np.argsort(squares, axis=1, kind="stable")
            ranked = np.take_along_axis(squares, order, axis=1)
            near[some] = np.take_along_axis(listed, order, axis=1)
            low[some, :-1] = _roots_below(ranked[:, 1:])
            square[some] = ranked[:, 0]
        every = np.flatnonzero(outside)
        if len(every):
            near[every], low[every], square[every] = _nearest(x[every], self.book, near.shape[1])
        if b < near.shape[1]:
            outer = low[:, b - 1 :].min(axis=1)
            near, low = near[:, :b], low[:, :b].copy()
            low[:, -1] = outer
        return near, low, square, depth


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, Python's where squares could overflow."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    most = np.abs(scaled).max(initial=0.0)
    if most >= WIDEST:
        raise ValueError("a component does not fit a long integer")
    return _exact(scaled.astype(np.int64))


def _exact(values: np.ndarray) -> np.ndarray:
    return values.astype(object) if values.size and np.abs(values).max() > NARROW else values


def _list_rows(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class Round:
    """What the tasks of one round run: rows in, rows with new entries and bounds out,
    and one row of sums and counts for each task."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None, b: int, id_type: str, label_type: str):
        self.books, self.before, self.b = books, before, b
        self.schema = (
            f"vec_id {id_type}, label {label_type}, v array<bigint>, near binary, low binary, error bigint, sums array<decimal(38,0)>, depths array<bigint>"
        )

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _exact(self.books)
        parts, k, width = books.shape
        sums = np.zeros((parts, k, width + 1), object)
        depths = np.zeros(k + 1, np.int64)
        work = [Part(books[p], None if self.before is None else self.before[p]) for p in range(parts)]
        names = ["vec_id", "label", "v", "near", "low", "error", "sums", "depths"]
        kinds = None
        rows_at_once = max(1, CELLS // max(1, k * width))
        for whole in batches:
            kinds = (whole.schema.field("vec_id").type, whole.schema.field("label").type)
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                n = batch.num_rows
                first = self.before is None
                x = _integers(_list_rows(batch.column("v"), n)) if first else _exact(_list_rows(batch.column("v"), n))
                x = x.astype(object) if books.dtype == object else x
                cut = x.reshape(n, parts, width)
                if not first:
                    old = len(batch.column("near")[0].as_py()) // parts
                    near_in = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(n, parts, old)
                    low_in = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float32).reshape(n, parts, old)
                near = np.empty((n, parts, self.b), np.uint8)
                low = np.empty((n, parts, self.b), np.float32)
                error = np.zeros(n, x.dtype)
                for p, part in enumerate(work):
                    if first:
                        near[:, p], low[:, p], square = _nearest(cut[:, p], part.book, self.b)
                        depths[k] += n
                    else:
                        near[:, p], low[:, p], square, depth = part.assign(cut[:, p], near_in[:, p], low_in[:, p], self.b)
                        depths += np.bincount(depth, minlength=k + 1)
                    error += square
                    chosen = near[:, p, 0]
                    for e in np.unique(chosen):
                        own = cut[chosen == e, p]
                        sums[p, e, :width] += own.sum(axis=0)
                        sums[p, e, width] += len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("label"), pa.array(list(x.astype(np.int64)), pa.list_(pa.int64())),
                        pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary()),
                        pa.array([int(e) for e in error], pa.int64()), pa.nulls(n, _SUMS), pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    names,
                )
        if kinds:
            flat = [Decimal(int(s)) for s in sums.ravel()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                    pa.nulls(1, pa.int64()), pa.array([flat], _SUMS), pa.array([depths.tolist()], pa.list_(pa.int64())),
                ],
                names,
            )


def _totals(table: DataFrame, column: str) -> dict[int, int]:
    """Sums by place over the tasks' rows: a few numbers for each entry."""
    found = (
        table.where(F.col(column).isNotNull())
        .select(F.posexplode(column).alias("place", "n"))
        .groupBy("place")
        .agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        .collect()
    )
    return {r["place"]: int(r["n"]) for r in found}


def _averaged(books: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Each entry's floor of sum / count; entries without parts stay."""
    parts, k, width = books.shape
    new = books.copy()
    for p in range(parts):
        for e in range(k):
            at = (p * k + e) * (width + 1)
            if n := sums.get(at + width, 0):
                new[p, e] = [sums[at + j] // n for j in range(width)]
    return new


def _enough(depths: dict[int, int], b: int, least: int) -> int:
    """The smallest list that held what nearly all parts needed."""
    total, seen = sum(depths.values()), 0
    for size in range(1, b):
        seen += depths.get(size, 0)
        if seen >= ENOUGH * total:
            return max(size, least)
    return b


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, list[list[list[int]]]]:
    """((vec_id, label, code, error), codebooks): ``code`` holds a byte for each part, its
    entry; ``error`` is the sum of the squared distances; ``codebooks[part][entry]`` are
    integer components.

    Rows are left out if the vector is null, holds a null, NaN or infinite component, or
    has another length than that of the smallest vec_id; a length that is no multiple of
    ``parts`` is an error. Codebooks start with the first ``entries`` rows by vec_id (null
    last; equal ids by vector); fewer rows give smaller codebooks, none an empty result.
    Repeated rows and ids count as often as they are there. Components are exact below
    2^62 / 4096; errors must fit a long integer. Very long vectors are handled in
    slices of fewer rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "codes")
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(F.col("v").isNotNull() & ~odd)
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*by_id).limit(1).select(F.size("v").alias("n")).collect()
    length = first[0]["n"] if first else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == length)
    starts = [r["v"] for r in kept.orderBy(*by_id).limit(entries).select("v").collect()]
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    if not starts:
        return rows.limit(0).select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")), [[] for _ in range(parts)]
    books = _integers(np.array(starts, np.float64)).astype(object).reshape(len(starts), parts, length // parts).transpose(1, 0, 2)
    k = len(starts)
    b, least = max(1, entries // 4, 2), max(1, entries // 8, 2)
    b, least = min(b, k), min(least, k)

    step = Round(books.astype(np.int64), None, b, id_type, label_type)
    table = ws.table(kept.mapInArrow(step, step.schema), "round-0")
    for r in range(1, rounds + 1):
        new = _averaged(books, _totals(table, "sums"))
        if r > 1:
            b = _enough(_totals(table, "depths"), b, least)
        step = Round(new.astype(np.int64), books.astype(np.int64), b, id_type, label_type)
        state = table.where("v IS NOT NULL").select("vec_id", "label", "v", "near", "low")
        table = ws.table(state.mapInArrow(step, step.schema), f"round-{r}")
        ws.drop(f"round-{r - 1}")
        books = new
    code = F.expr(f"unhex(concat_ws('', transform(sequence(0, {parts - 1}), p -> hex(substring(near, p * {b} + 1, 1)))))")
    done = table.where("v IS NOT NULL").select("vec_id", "label", code.alias("code"), "error")
    return done, [[[int(c) for c in e] for e in book] for book in books]


def codebooks_sha256(codebooks: list[list[list[int]]]) -> str:
    """Lowercase hex SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()
