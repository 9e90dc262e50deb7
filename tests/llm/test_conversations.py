from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from paylens.llm import conversation_repair as C
from paylens.llm import hirschberg as H

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, piece string, copies string, sha string, first string, part string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit of every row, all ways kept by state."""
    ways = {"": (0, "", ())}  # role initials so far, reduced to the last -> best
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, said) in list(out.items()):
                to = after[state]
                new = (cost + 3, audit + "I", (*said, (names[to], "")))
                out[to] = min(out.get(to, new), new)
        return out

    for role, text, fault in rows:
        found = {}
        for state, (cost, audit, said) in inserted(ways).items():
            more = 3 if fault == "truncated" else 0
            options = [(state, (cost + 4, audit + "D", said))]
            if fault in ("", "truncated"):
                x = role[:1]
                if (x == "s" and state == "") or (x in ("u", "a") and after[state] == x):
                    options.append((x, (cost + more, audit + "K", (*said, (role, text)))))
                to = after[state]
                options.append((to, (cost + more + 3, audit + "R", (*said, (names[to], text)))))
            for to, way in options:
                found[to] = min(found.get(to, way), way)
        ways = found
    ends = inserted(ways)
    return min(ends[s] for s in ("", "a") if s in ends)


def expected(rows):
    """Brute force over the rows of one conversation, in order of turn."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, judged = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        judged.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, said = cheapest([(r, x, f) for (_, r, x), f in zip(rows, judged, strict=True)])
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
    return (gaps, *(judged.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def random_rows(rng, convs, longest):
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "u"]
    texts = ["Yes.", "no", "", None, " \t", "Why? ", "a.\n", "é!", "x" * 40, "again."]
    rows = []
    for conv in [None, *range(convs)]:
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 1, None, 2 * t])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice(["", "."])))
    return rows


def check(spark, rows):
    got = {r["conv"]: tuple(r[c] for c in (*COUNTS, "audit", "repaired_sha256")) for r in C.digests(C.repair(table(spark, rows))).collect()}
    assert got == {conv: expected(own) for conv, own in grouped(rows).items()}
    return got


def test_audits_of_all_short_conversations():
    """Every sequence of up to four rows of every kind: the divide and conquer against all edits."""
    kinds = [(i, f) for i in "sua?" for f in (H.PLAIN, H.TRUNCATED, H.REMOVE)]
    names = {H.PLAIN: "", H.TRUNCATED: "truncated", H.REMOVE: "blank"}
    roles = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    for n in range(5):
        for kind in itertools.product(kinds, repeat=n):
            codes = bytes(H.row_code(i, f) for i, f in kind)
            rows = [(roles[i], str(j)) for j, (i, _) in enumerate(kind)]
            got = C._render(codes, [1] * n, rows, H.START, H.row_crossings(codes), True)
            want = cheapest([(*r, names[f]) for r, (_, f) in zip(rows, kind, strict=True)])
            assert (got[0], got[1], tuple(got[2])) == want
            assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in got[2]))


def test_blocks_are_steps_of_the_same_method():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randint(1, 40)))
        cuts = sorted(rng.sample(range(len(codes) + 1), min(3, len(codes))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True) if a < b]
        borders = H.crossings([H.block_step(p) for p in parts], H.START, H.END)
        whole, at = H.row_crossings(codes), 0
        for p, state in zip(parts, borders, strict=True):
            at += len(p)
            assert whole[at - 1] == state


def test_conversations_equal_brute_force(spark):
    rows = random_rows(random.Random(1), 150, 9)
    rows += [(700, t, "user", "same words.") for t in range(30)] + [(701, 5, "assistant", "again.")] * 40 + [(702, None, None, None)] * 3
    rows += [(703, 0, "user", "y" * 3_000_000), (703, 1, "assistant", "z" * 2_000_000 + "."), (-1, 3, "system", "only.")]
    check(spark, rows)


def test_long_conversations_are_solved_in_blocks(spark, monkeypatch):
    """A hot conversation fills several partitions, its rows many blocks."""
    rng = random.Random(8)
    rows = random_rows(rng, 20, 5)
    rows += [(900, t, rng.choice(["user", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", "", "?"])) for t in range(6000)]
    rows += [(901, rng.choice([None, t // 2]), rng.choice(["user", "assistant"]), rng.choice(["a.", "b"]) + str(t % 50) + ".") for t in range(2500)]
    check(spark, rows)
    pieces = C.repair(table(spark, rows)).where("conv = 900").groupBy("whole").count().collect()
    assert [r["whole"] for r in pieces] == [False] and pieces[0]["count"] > 1


def test_damage_follows_the_key(spark):
    rows = random_rows(random.Random(4), 60, 8)
    got = sorted(map(repr, map(tuple, C.damage(table(spark, rows)).collect())))
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert got == sorted(map(repr, want))


def test_empty_table_and_dropped_conversations(spark, tmp_path):
    from paylens.llm.queries import QUERIES

    table(spark, [(1, 1, "user", "x")]).where("conv_id = 2").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op12_hirschberg"](spark, str(tmp_path / "none")).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 == 9)
    rows = [(5, gone, "user", "x."), (6, kept, "system", "y.")]
    table(spark, rows).write.parquet(str(tmp_path / "some" / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_hirschberg"](spark, str(tmp_path / "some")).collect()}
    assert got == {c: (0, 0, 0, 0, 0, n, a, hashlib.sha256(b"").hexdigest()) for c, n, a in ((5, 0, ""), (6, 4, "D"))}


@pytest.mark.parametrize("key", ["op12_hirschberg"])
def test_registered(key):
    from paylens.llm.queries import ORACLE, QUERIES

    assert key in QUERIES and key in ORACLE
