"""Repair of the turn structure of conversations.

Rows are keyed and sorted by Spark: equal rows of a conversation become one row with a
count, the first turn of each (role, text) comes from an aggregate, and a range
partitioning by (conversation, turn, role, text) puts conversations in order, a large
one over as many partitions as it fills. A task streams through its rows. A
conversation that lies inside a partition and is short is solved at once
(``hirschberg.row_crossings``). Longer ones are cut into blocks of bounded size; a block
is one *step* of the same method: 4 x 4 costs. The steps of a conversation meet in one
small group (some hundred bytes for thousands of rows), the states at the blocks'
borders are found there, and each block is then repaired alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm import hirschberg as H
from paylens.llm.workspace import Workspace, ship_package

BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
#: White space of the contracts, for Spark's trim.
BLANKS = " \t\n\x0b\x0c\r"

_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = "piece bigint, whole boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired array<struct<role:string,text:string>>"
_BLOCK = (
    "part int, seq int, codes binary, copies array<bigint>, step array<bigint>, first_turn bigint, last_turn bigint, low bigint, high bigint,"
    " turns bigint, first_initial string, last_initial string"
)


# ---- the rows of a conversation, in order ----------------------------------------------
def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows (conv, turn, role, text) in order, with their number (copies), if an
    earlier turn has the same role and text (seen), and the last character that is not
    white space (last)."""
    blank = F.lit(" ")
    rows = conversations.select(
        conversations[conv].alias("conv"),
        conversations[turn].cast("bigint").alias("turn"),
        F.coalesce(conversations[role].cast("string"), blank).alias("role"),
        F.coalesce(conversations[text].cast("string"), blank).alias("text"),
    )
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("sha", F.sha2("text", 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = counted.groupBy(F.col("conv").alias("f_conv"), F.col("role").alias("f_role"), F.col("sha").alias("f_sha")).agg(F.min(when).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("sha") == F.col("f_sha"))
    return (
        counted.join(first, same)
        .select(
            "conv", "turn", "role", "text", "copies", (F.col("first") < when).alias("seen"),
            F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("last"),
        )
        .repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
        .sortWithinPartitions("conv", "turn", "role", "text")
    )


class _Block:
    """Rows of one conversation that follow each other, in one task."""

    def __init__(self, conv: object):
        self.conv = conv
        self.codes, self.copies, self.rows = bytearray(), [], []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.first_turn = self.last_turn = self.low = self.high = None
        self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool, last: str) -> None:
        fault = H.REMOVE if last == "" or seen else H.PLAIN if last in ".!?" else H.TRUNCATED
        self.blank += copies if last == "" else 0
        self.duplicate += 0 if last == "" else copies if seen else copies - 1
        self.truncated += fault == H.TRUNCATED
        self.cost += H.DELETE * (copies - 1)
        initial = role[:1]
        if self.codes:
            self.illegal += self.last_initial + initial not in H.LEGAL_PAIRS
        else:
            self.first_initial, self.first_turn = initial, turn
        self.illegal += copies - 1
        if turn is not None:
            self.turns += not self.codes or turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last_initial, self.last_turn = initial, turn
        self.codes.append(H.row_code(initial, fault))
        self.copies.append(copies)
        self.rows.append((role, text))
        self.size += len(text) + len(role) + 16

    @property
    def full(self) -> bool:
        return len(self.codes) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def _render(codes: bytes, copies: list[int], rows: list[tuple[str, str]], entry: int, states: list[int], last: bool) -> tuple[int, str, list]:
    """(cost, audit, repaired rows) of rows along the states after them; copies beyond
    the first of a row are deleted (their cost is counted with the rows)."""
    cost, audit, out = 0, [], []
    for code, n, (role, text), state in zip(codes, copies, rows, states, strict=True):
        price, piece = H.PIECES[code][entry, state]
        cost += price
        for letter in piece:
            if letter == "D":
                continue
            if letter == "K":
                entry = state
                out.append((role, text))
            else:
                entry = H.AFTER_INSERT[entry]
                out.append((H.ROLE_OF[entry], "" if letter == "I" else text))
        audit.append(piece if n == 1 else piece + "D" * (n - 1))
    if last:
        price, piece = H.FINISH[entry]
        cost += price
        audit.append(piece)
        for _ in piece:
            entry = H.AFTER_INSERT[entry]
            out.append((H.ROLE_OF[entry], ""))
    return cost, "".join(audit), out


def _structs(rows: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([None if r is None else [{"role": a, "text": b} for a, b in r] for r in rows], _ROWS)


def _as_batch(rows: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv": conv_type, "whole": pa.bool_(), "audit": pa.string(), "part": pa.int32(), "seq": pa.int32(), "codes": pa.binary(),
             "copies": pa.list_(pa.int64()), "step": pa.list_(pa.int64()), "first_initial": pa.string(), "last_initial": pa.string()}
    names = ["conv", "piece", "whole", *_COUNTS, "audit", "repaired", "part", "seq", "codes", "copies", "step", "first_turn", "last_turn", "low", "high",
             "turns", "first_initial", "last_initial"]
    columns = [_structs([r.get(n) for r in rows]) if n == "repaired" else pa.array([r.get(n) for r in rows], kinds.get(n, pa.int64())) for n in names]
    return pa.RecordBatch.from_arrays(columns, names)


def _solved(b: _Block) -> dict:
    cost, audit, repaired = _render(bytes(b.codes), b.copies, b.rows, H.START, H.row_crossings(bytes(b.codes)), True)
    return {"conv": b.conv, "piece": 0, "whole": True, "gaps": b.gaps(), "blank": b.blank, "duplicate": b.duplicate, "truncated": b.truncated,
            "illegal": b.illegal, "cost": b.cost + cost, "audit": audit, "repaired": repaired}


def _open(b: _Block, part: int, seq: int) -> dict:
    step = [x for way in H.block_step(bytes(b.codes)) for x in way]
    same = {n: getattr(b, n) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "first_turn", "last_turn", "low", "high", "turns", "first_initial", "last_initial")}
    return {"conv": b.conv, "whole": False, "part": part, "seq": seq, "codes": bytes(b.codes), "copies": b.copies, "step": step, "repaired": b.rows, **same}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows -> solved conversations, and blocks of those that are long or reach
    an end of the partition."""
    part, seq, block, alone = TaskContext.get().partitionId(), 0, None, False
    conv_type, out, held = None, [], 0

    def closed(b: _Block, whole: bool) -> dict:
        nonlocal seq
        seq += 1
        return _solved(b) if whole else _open(b, part, seq)

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "copies", "seen", "last")]
        for conv, *row in zip(*columns, strict=True):
            changed = block is not None and conv != block.conv
            if changed or (block is not None and block.full):
                # the first conversation of a partition may have begun before it
                out.append(closed(block, alone and changed))
                held += block.size
                alone = changed
                block = None
            if block is None:
                block = _Block(conv)
            block.add(*row)
            if held >= BLOCK_BYTES or len(out) >= BLOCK_ROWS:
                yield _as_batch(out, conv_type)
                out, held = [], 0
    if block is not None:
        out.append(closed(block, False))
    if out:
        yield _as_batch(out, conv_type)


# ---- conversations of several blocks -----------------------------------------------------
_BORDERS = "b_part int, b_seq int, b_piece bigint, entry int, exit int, b_last boolean, b_gaps bigint, b_illegal bigint"


def _borders(blocks: pa.Table) -> pa.Table:
    """The blocks of one conversation -> states at their borders, pairs over borders."""
    rows = blocks.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    steps = [[tuple(r["step"][i : i + 4]) for i in range(0, len(r["step"]), 4)] for r in rows]
    states = H.crossings(steps, H.START, H.END)
    entries = [H.START, *states[:-1]]
    known = [r for r in rows if r["turns"]]
    turns = sum(r["turns"] for r in rows) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
    pairs = [0, *(a["last_initial"] + b["first_initial"] not in H.LEGAL_PAIRS for a, b in zip(rows, rows[1:], strict=False))]
    n = len(rows)
    return pa.table(
        {
            "b_part": pa.array([r["part"] for r in rows], pa.int32()), "b_seq": pa.array([r["seq"] for r in rows], pa.int32()),
            "b_piece": pa.array(range(n), pa.int64()), "entry": pa.array(entries, pa.int32()), "exit": pa.array(states, pa.int32()),
            "b_last": pa.array([i == n - 1 for i in range(n)], pa.bool_()), "b_gaps": pa.array([gaps] + [0] * (n - 1), pa.int64()),
            "b_illegal": pa.array([int(p) for p in pairs], pa.int64()),
        }
    )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block with the states at its ends -> its piece of the repaired conversation."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            rows = [(x["role"], x["text"]) for x in r["repaired"]]
            end = H.END if r["b_last"] else [0 if s == r["exit"] else H.NONE for s in range(4)]
            states = H.row_crossings(r["codes"], r["entry"], end)
            cost, audit, repaired = _render(r["codes"], r["copies"], rows, r["entry"], states, r["b_last"])
            made = r | {"piece": r["b_piece"], "gaps": r["b_gaps"], "illegal": r["illegal"] + r["b_illegal"], "cost": r["cost"] + cost, "audit": audit, "repaired": repaired}
            names = ["conv", "piece", "whole", *_COUNTS, "audit", "repaired"]
            yield _as_batch([made], batch.schema.field("conv").type).select(names)


def repair(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Repaired conversations: (conv, piece, whole, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired). A conversation is one row (``whole``), a long one
    several: its counts are the sums over the pieces, its audit and its repaired rows
    (role, text) those of the pieces in order.

    Rows are taken by turn (null first), then role and text. Null roles and texts are
    one space; a null conversation is one like any other; an empty role fits no pattern
    and is recast or deleted. Equal rows, however many, are one row with a count. Very
    long texts make a block of their own. An empty table gives an empty result. Other
    columns are ignored. Turns are long integers and lie less than 2^63 apart. The borders of a
    conversation's blocks meet in one group: 300 bytes for 4096 rows, and an audit of
    2^31 rows is the longest that a string holds.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "conversations")
    rows = _ordered(conversations, conv, turn, role, text)
    conv_type = rows.schema["conv"].dataType.simpleString()
    blocks = ws.table(rows.mapInArrow(_blocks, f"conv {conv_type}, {_PIECE}, {_BLOCK}"), "blocks")
    names = ["conv", "piece", "whole", *_COUNTS, "audit", "repaired"]
    cut = blocks.where("NOT whole")
    narrow = cut.select("conv", "part", "seq", "step", "first_turn", "last_turn", "low", "high", "turns", "first_initial", "last_initial")
    borders = narrow.groupBy("conv").applyInArrow(_borders, _BORDERS)
    known = cut.join(borders, (F.col("part") == F.col("b_part")) & (F.col("seq") == F.col("b_seq")))
    return blocks.where("whole").select(*names).union(known.mapInArrow(_repaired, f"conv {conv_type}, {_PIECE}"))


# ---- digests ----------------------------------------------------------------------------
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> one row for each conversation; texts pass through the hash."""
    names = ["conv", *_COUNTS, "audit", "repaired_sha256"]
    state: list = []
    conv_type = None

    def made() -> pa.RecordBatch:
        conv, sums, audits, digest, _ = state
        values = [conv, *sums, "".join(audits), digest.hexdigest()]
        types = [conv_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if state and state[0] != r["conv"]:
                yield made()
                state = []
            state = state or [r["conv"], [0] * len(_COUNTS), [], hashlib.sha256(), False]
            state[1] = [a + r[c] for a, c in zip(state[1], _COUNTS, strict=True)]
            state[2].append(r["audit"])
            for x in r["repaired"]:
                state[3].update((("\n" if state[4] else "") + x["role"] + ":" + x["text"]).encode("utf-8"))
                state[4] = True
    if state:
        yield made()


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: counts, audit and the SHA-256 of its
    repaired rows ``role:text``, joined by line feeds. A SHA-256 takes its bytes in
    order, so the pieces of one long conversation pass one task, as a stream."""
    conv_type = pieces.schema["conv"].dataType.simpleString()
    whole = pieces.where("whole").select(
        "conv", *_COUNTS, "audit",
        F.sha2(F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"), 256).alias("repaired_sha256"),
    )
    schema = f"conv {conv_type}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    cut = pieces.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "piece")
    return whole.union(cut.mapInArrow(_joined, schema))


# ---- the contract's damage ---------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults planted by crc32 of
    ``conv_id:turn`` modulo 20 (nulls are one space): 0 drops the row, 1 empties its
    text, 2 takes out its ends of sentences, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    drawn = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_fault")
    ).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return drawn.select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
