from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paylens.llm import content_sort_dedup, hilbert_shards, mixing, multiset_hash
from tests.llm.conftest import edge_rows, make


def test_hilbert_index_visits_each_cell_once_and_moves_one_step(spark):
    cells = spark.range(4**3).select(*[(F.floor(F.col("id") / 4**i) % 4).cast("int").alias(c) for i, c in enumerate("xyz")])
    got = cells.select("x", "y", "z", hilbert_shards.hilbert_index([F.col(c) for c in "xyz"], 2).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(64))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(edge, law):
    got = hilbert_shards.hilbert_shards(edge, shards=5, law=law).collect()
    rows = edge_rows()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append((r["slot"], r["curve_index"], r["size"]))
    for s in shards.values():
        assert sorted(x[0] for x in s) == list(range(len(s)))
        assert [x[1] for x in sorted(s)] == sorted(x[1] for x in s)
    ends = [(min(x[1] for x in shards[s]), max(x[1] for x in shards[s])) for s in sorted(shards)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    if law == "rows":
        counts = [len(shards[s]) for s in range(5)]
        assert max(counts) - min(counts) <= 1
    else:
        sizes = [sum(x[2] for x in shards.get(s, [])) for s in range(5)]
        longest = max(len((t or "").encode()) + 8 for _, t, *_ in rows)
        assert max(sizes) - min(sizes) <= 2 * longest


def test_shards_of_fewer_rows_than_shards_and_none(spark, empty):
    assert hilbert_shards.hilbert_shards(empty).count() == 0
    got = hilbert_shards.hilbert_shards(make(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")])).collect()
    assert len({r["shard"] for r in got}) == 2 and {r["slot"] for r in got} == {0}


def paragraphs(text):
    return [p for p in re.sub("([.!?]) ", r"\1\n", text or "").split("\n") if p]


def vector(text):
    lanes = [0] * (multiset_hash.WIDE + multiset_hash.SPOTS)
    for p in paragraphs(text):
        h = hashlib.sha256(p.encode()).hexdigest()
        for i in range(4):
            lanes[i] = (lanes[i] + int(h[14 * i : 14 * i + 14], 16)) % 2**56
        lanes[4 + int(h[56:58], 16) % 32] = (lanes[4 + int(h[56:58], 16) % 32] + int(h[58:62], 16)) % 2**16
    return lanes


def shown(lanes):
    return "".join(f"{v:0{14 if i < 4 else 4}x}" for i, v in enumerate(lanes))


def test_fingerprints_equal_brute_force(spark, empty):
    rows = [r for r in edge_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in multiset_hash.fingerprints(make(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = r[1] or "", after[1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g["fingerprint"] == shown(vector(text)) and g["edited_fingerprint"] == shown(vector(edited))
        assert 0 <= g["near_edited"] <= 1 and (g["near_next"] == 1) == (vector(text) == vector(other))
    assert multiset_hash.fingerprints(empty).count() == 0


def test_fingerprints_with_null_and_repeated_ids(edge):
    got = multiset_hash.fingerprints(edge).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, shown(vector(t))) for i, t, *_ in edge_rows())


def test_fingerprints_add_and_remove_paragraphs(spark):
    v = lambda t: multiset_hash.fingerprint_vector(multiset_hash.paragraph_values(F.lit(t)))
    one, two, both, turned = v("a\nb\na"), v("c\n\nd"), v("a\nb\na\nc\nd"), v("d\na\nc\nb\na\n")
    row = spark.range(1).select(
        (multiset_hash.add(one, two) == both).alias("sum"), (multiset_hash.remove(both, two) == one).alias("rest"),
        (both == turned).alias("order"), (v("a\nb") == one).alias("count"),
    ).first()
    assert row.asDict() == {"sum": True, "rest": True, "order": True, "count": False}


@pytest.mark.parametrize("n", [10, 100, 1000, 10_000])
def test_shared_paragraphs_at_every_length(spark, n):
    rows = []
    for i in range(3):
        # the last third of a text's characters is swapped for the next text's first ones
        rows.append((30 - i, "\n".join(f"line {j:06d} of text {i} of {n}" for j in range(n)) + f"\n{'again' * 4}" * (n // 5), "en", "s"))
    got = {r["doc_id"]: r for r in multiset_hash.fingerprints(make(spark, rows)).collect()}
    bag = lambda t: Counter(paragraphs(t))
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(r[1]) // 3
        for name, other in (("edited", r[1][: len(r[1]) - k] + after[1][:k]), ("next", after[1])):
            a, b = bag(r[1]), bag(other)
            true = (a & b).total() / (a | b).total()
            assert abs(got[r[0]][f"near_{name}"] - true) < 0.12, (n, name, true, got[r[0]])
            if n <= 100:
                assert abs(got[r[0]][f"near_{name}"] - true) < 0.06


def test_texts_of_one_line_share_their_sentences(spark):
    one = " ".join(f"Sentence number {i} of a text on one line." for i in range(30))
    got = {r["doc_id"]: r for r in multiset_hash.fingerprints(make(spark, [(2, one, "en", "s"), (1, one[:700] + " Another end.", "en", "s")])).collect()}
    edited = one[: len(one) - len(one) // 3] + one[: len(one) // 3]
    a, b = Counter(paragraphs(one)), Counter(paragraphs(edited))
    assert abs(got[2]["near_edited"] - (a & b).total() / (a | b).total()) < 0.05 and 0.3 < got[2]["near_next"] < 0.8


def test_null_ids_are_spread_and_still_in_order(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "partitions", lambda spark: 12)
    rows = [(None, f"Text {i}. Common end.", "en", "s") for i in range(200)] + [(i, f"Known {i}.", "en", "s") for i in range(50)]
    got = multiset_hash.with_next_in_order(
        make(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h")), "doc_id", ["text"], "h", {"_part": F.spark_partition_id()}
    ).collect()
    order = sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    assert [r["next_text"] for r in order] == [r["text"] for r in [*order[1:], order[0]]]
    assert max(Counter(r["_part"] for r in got if r["doc_id"] is None).values()) < 100


def test_sparse_lanes_of_few_differences_are_exact(spark):
    many = [f"paragraph {i}" for i in range(3000)]
    of = lambda lines: multiset_hash.sparse_lanes(multiset_hash.paragraph_values(F.lit("\n".join(lines))))
    row = spark.range(1).select(
        multiset_hash.shared(of(many), of(many[::-1])).alias("same"),
        multiset_hash.shared(of(many), of(many[:-10])).alias("fewer"),
        multiset_hash.shared(of(many), of([*many, *["heavy"] * 3000])).alias("heavy"),
        multiset_hash.shared(of([]), of([])).alias("none"),
        multiset_hash.shared(of([]), of(["x"])).alias("one"),
        multiset_hash.shared(of(["x"] * 4), of(["x"] * 3)).alias("count"),
    ).first()
    assert row["same"] == 1 and row["fewer"] == pytest.approx(2990 / 3000) and row["heavy"] == pytest.approx(0.5)
    assert (row["none"], row["one"], row["count"]) == (1.0, 0.0, 0.75)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(edge, empty):
    rows = edge_rows()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i))
    got = content_sort_dedup.exact_groups(edge).collect()
    assert len(got) == len(rows)
    shas = {hashlib.sha256(k.encode()).hexdigest(): min(v) + (len(v),) for k, v in groups.items()}
    for r in got:
        *_, keep, size = shas[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (keep, size)
    # one row of each group stays, repeated rows included
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(list(shas))
    assert content_sort_dedup.exact_groups(empty).count() == 0


def test_a_group_over_many_ranges_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(content_sort_dedup, "partitions", lambda spark: 13)
    rows = [(i, "same text " * 3, "en", "s") for i in range(400)] + [(1000 + i, f"other {i % 7}", "en", "s") for i in range(70)]
    got = content_sort_dedup.exact_groups(make(spark, rows)).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in got) == Counter(
        {(0, 400): 400, **{(1000 + i, 10): 10 for i in range(7)}}
    )


def test_copies_without_ids_fill_many_ranges(spark, monkeypatch):
    """A third of all rows are one text without an id: no range holds them all, one stays."""
    monkeypatch.setattr(content_sort_dedup, "partitions", lambda spark: 16)
    plans, table = [], content_sort_dedup.Workspace.table
    monkeypatch.setattr(content_sort_dedup.Workspace, "table", lambda ws, df, name: (plans.append(out := table(ws, df, name)), out)[1])
    rows = [(None if i % 3 == 0 else i, "same text " * 3 if i % 3 == 0 else f"text {i}", "en", "s") for i in range(6000)]
    got = content_sort_dedup.exact_groups(make(spark, rows)).collect()
    assert Counter((r["group_size"], r["kept"]) for r in got) == Counter({(2000, True): 1, (2000, False): 1999, (1, True): 4000})
    sizes = sorted(r["count"] for r in plans[0].groupBy("part").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_mix_meets_targets(spark, edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    total = sum(sizes.values())
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # water filling by hand
    target, free, left = {}, set(order), 1.5 * total
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    for s, v in by.items():
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s] for r in v)
        assert abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v)
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["passes"] for r in v)
    again = mixing.mix(edge.repartition(7)).collect()
    assert Counter((r["doc_id"], r["text_hash"], r["taken"]) for r in got) == Counter((r["doc_id"], r["text_hash"], r["taken"]) for r in again)
    assert mixing.mix(empty).count() == 0


def test_null_ids_of_one_size_and_quality_are_drawn_alike_in_every_run(spark):
    rows = [(None, f"word {chr(97 + i)}x", "en", "s") for i in range(26)] + [(7, f"word y{chr(97 + i)}", "en", "s") for i in range(10)]
    runs = [
        Counter((r["doc_id"], r["text_hash"], r["taken"]) for r in mixing.mix(make(spark, order).repartition(n), share=0.5).collect())
        for order, n in ((rows, 1), (rows[::-1], 5), (rows[9:] + rows[:9], 3))
    ]
    assert runs[0] == runs[1] == runs[2]
    taken = [n for i, _, n in runs[0].elements() if i is None]
    assert 0 < sum(n > 0 for n in taken) < 26


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "word " * 10, "en" if i % 2 else "fr", "s") for i in range(2000)] + [(5000 + i, "word " * 10, "en", "t") for i in range(2000)]
    got = mixing.mix(make(spark, rows), weights=(1, 1), share=0.5, quality=F.when(F.col("lang") == "en", 0.9).otherwise(0.1)).collect()
    drawn = Counter(r["doc_id"] % 2 for r in got if r["source"] == "s" and r["passes"])
    assert drawn[1] > 3 * drawn[0] > 0
