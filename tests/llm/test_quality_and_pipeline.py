from __future__ import annotations

import importlib.util
import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from paylens.llm import mixing, quality
from paylens.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import edge_rows, make

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality bigint, toxic bigint, text string, n bigint")


def test_held_out_accuracy(spark):
    docs, known = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    held = known.filter("doc_id % 4 = 0")
    got = quality.classify(docs, known.filter("doc_id % 4 <> 0")).join(held.withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id")
    row = got.agg(
        F.avg(((F.col("quality") > 0.5) == (F.col("q") == 1)).cast("int")).alias("quality"),
        F.avg(((F.col("toxic") > 0.5) == (F.col("t") == 1)).cast("int")).alias("toxic"),
        F.avg(F.when((F.col("q") == 1) & (F.col("t") == 0), F.col("kept").cast("int"))).alias("clean_kept"),
        F.avg(F.when(F.col("t") == 1, F.col("kept").cast("int"))).alias("toxic_kept"),
    ).first()
    assert row["quality"] > 0.97 and row["toxic"] > 0.95 and row["clean_kept"] > 0.98 and row["toxic_kept"] < 0.3


def test_sparse_sites_shrink_to_the_whole(spark):
    rows = [(i, "good words here" if i % 4 else "|| ## $$ %% bad", "en", "big") for i in range(400)]
    rows += [(1000, "|| ## $$ %% bad", "en", "small"), (1001, "good words here", "en", "small")]
    docs = make(spark, rows)
    known = labels(spark, [(i, int(i % 4 > 0), 0, "x", 0) for i in range(300)])
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    assert got[1]["kept"] and not got[4]["kept"] and not got[1000]["kept"] and got[1001]["kept"]
    assert abs(got[1001]["path_quality"] - got[1]["path_quality"]) < 0.1


MANY_WORDS = " ".join("".join(chr(97 + j // 26**k % 26) for k in range(4)) for j in range(30_000))


def _pooled(rows, name):
    """Host and path rates and pooled log odds of each row, by hand."""
    p = [r[f"own_{name}"] for r in rows]
    n, whole = len(p), (sum(p) + 0.5) / (len(p) + 1)
    groups = [defaultdict(list), defaultdict(list)]
    for r, x in zip(rows, p, strict=True):
        groups[0][r["host"]].append(x)
        groups[1][r["host"], r["path"]].append(x)

    def strength(sites, centre):
        noise = whole * (1 - whole)
        spread = sum(len(v) * (sum(v) / len(v) - centre(k)) ** 2 for k, v in sites.items())
        between = (spread - (len(sites) - 1) * noise) / max(1.0, n - sum(len(v) ** 2 for v in sites.values()) / n)
        if len(sites) < 2 or between <= 0:
            return 1e4
        return min(1e4, max(2.0, noise / between - 1))

    mean = lambda v: sum(v) / len(v)
    a = strength(groups[0], lambda k: whole)
    b = strength(groups[1], lambda k: mean(groups[0][k[0]]))
    clip = lambda x: min(1 - 1e-6, max(1e-6, x))
    out = []
    for r, x in zip(rows, p, strict=True):
        host, path = groups[0][r["host"]], groups[1][r["host"], r["path"]]
        h = clip((sum(host) - x + a * whole) / (len(host) - 1 + a))
        s = clip((sum(path) - x + b * h) / (len(path) - 1 + b))
        own = math.log(x / (1 - x))
        out.append((h, s, own - math.log(whole / (1 - whole)) + math.log(s / (1 - s))))
    return out


def test_rates_and_decisions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        site = rng.choice(["a", "a", "b", "c", None])
        good = rng.random() < {"a": 0.9, "b": 0.3}.get(site, 0.6)
        text = " ".join(rng.choice(["good", "fine", "words", "here"] if good else ["||", "$$", "bad", "%%"]) for _ in range(rng.randint(1, 30)))
        rows.append((i if i % 50 else None, text, rng.choice(["en", "fr", None]), site))
    rows.append((700, MANY_WORDS, "en", "rare"))  # a very long text
    known = labels(spark, [(i, int("good" in r[1] or "fine" in r[1]), int("bad" in r[1]), "x", 0) for i, r in enumerate(rows[:300]) if r[0] is not None])
    got = quality.classify(make(spark, rows), known).collect()
    assert len(got) == len(rows)
    by_hand = {name: _pooled(got, name) for name in ("quality", "toxic")}
    for i, r in enumerate(got):
        for name in ("quality", "toxic"):
            host, path, odds = by_hand[name][i]
            assert r[f"host_{name}"] == pytest.approx(host, abs=1e-6) and r[f"path_{name}"] == pytest.approx(path, abs=1e-6)
            assert r[name] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds)))), abs=1e-5)
        assert r["kept"] == (r["quality"] > 0.5 and r["toxic"] < 0.5) or not r["kept"]
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_features_fitted_on_are_bounded():
    long = quality.features(MANY_WORDS)
    few = quality.bounded(long, 100)
    assert len(few) == 100 + quality.SHAPES + 1 and set(few) <= set(long) and quality.bounded(few, 100) is few


def test_edges(spark, edge, empty):
    none = labels(spark, [(None, 1, 0, "x", 0), (100, None, 0, "x", 0)])
    some = labels(spark, [(76, 1, 0, "x", 0), (76, 1, 0, "x", 0), (100, 0, 0, "x", 0), (97, 0, 1, None, None), (9999, 1, 1, "x", 0)])
    for known in (none, some):
        got = quality.classify(edge, known).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in edge_rows())
        assert all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in got)
        assert not any(r["kept"] for r in got if r["doc_id"] in (100, 97, 94))
        assert quality.classify(empty, known).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs, known = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.labelled_sample(docs.repartition(n), known, rows=25) for n in (1, 5))
    assert len(a) == 25 and a == b


def test_sample_is_of_documents_that_exist_one_row_each(spark):
    docs = make(spark, [(i, f"text {i % 3} {j}", "en", "s") for i in range(30) for j in range(1 + 9 * (i == 4))] + [(4, "text 1 0", "en", "s")])
    known = labels(spark, [(i, i % 2, 0, "x", 0) for i in range(2000)])
    got = quality.labelled_sample(docs, known, rows=30)
    assert [r[0] for r in got] == list(range(30)) and [r[2] for r in got] == [i % 2 for i in range(30)]
    assert len(quality.labelled_sample(docs, known, rows=12)) == 12


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = next(k for k in ("page_id", "doc_id", "conv_id", "vec_id") if k in columns)
    got, want = (x[columns].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in columns:
        a, b = (x[c].astype(object).where(x[c].notna(), None).tolist() for x in (got, want))
        assert a == b, c


@pytest.fixture(scope="module")
def pipeline():
    path = os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_pipeline_stages_keep_columns_and_take_effect(spark, pipeline):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert out.columns == columns, name
        after = out.count()
        assert 0 < after <= before or name == "mixing"
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs, before = out, after
    tokens = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert tokens.count() == before and tokens.filter("n_tokens <> size(ids)").count() == 0
    assert pipeline.run(spark, SMALL).count() == before


def _bag(rows):
    return Counter(map(repr, map(tuple, rows)))


def test_no_row_is_lost_or_made_up(spark, pipeline):
    """Rows equal in id and text but not in other columns: each survivor is one of the input,
    as often as it is there, whatever the partitioning."""
    rows = [(None, None, "en", "a"), (None, "", "fr", "b"), (None, None, "de", "c")]  # without words: all stay
    rows += [(1, "one two three four five six", "en", "s"), (1, "one two three four five six", "fr", "s")]
    rows += [(1, "one two three four five six", "fr", "t"), (None, "null id text here it is", "en", "s"), (None, "null id text here it is", "fr", "s")]
    docs, have = make(spark, rows), _bag(make(spark, rows).collect())

    near = pipeline.near_stage(spark, docs, "").collect()
    assert not _bag(near) - have
    assert sorted((r["lang"], r["source"]) for r in near if not r["text"]) == [("de", "c"), ("en", "a"), ("fr", "b")]
    assert Counter(r["doc_id"] for r in near if r["text"]) == {1: 1, None: 1}

    exact = pipeline.exact_stage(spark, docs, "").collect()
    assert not _bag(exact) - have
    assert Counter((r["text"] or "")[:3] for r in exact) == {"": 1, "one": 1, "nul": 1}

    mixed = pipeline.mixing_stage(spark, docs, "").collect()
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["text_hash"], r["source"]] += r["passes"]
    hashes = {r[0]: r[1] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    got = Counter((r["doc_id"], hashes[r["text"]], r["source"]) for r in mixed)
    assert got == +want
    assert all(n <= 2 * have[k] for k, n in _bag(mixed).items())  # a row comes twice at most
    for stage in (pipeline.near_stage, pipeline.exact_stage, pipeline.mixing_stage):
        assert _bag(stage(spark, docs.repartition(5), "").collect()) == _bag(stage(spark, docs.coalesce(1), "").collect())


def test_quality_stage_keeps_the_rows_that_the_classifier_keeps(spark, pipeline, edge, tmp_path):
    known = labels(spark, [(76, 1, 0, "x", 0), (100, 0, 0, "x", 0), (73, 1, 0, "x", 0), (70, 1, 0, "x", 0)])
    known.write.parquet(f"{tmp_path}/labels.parquet")
    kept = Counter((r["doc_id"], r["text_hash"], r["host"], r["path"]) for r in quality.classify(edge, known).where("kept").collect())
    out = pipeline.quality_stage(spark, edge, str(tmp_path)).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "source", "lang").collect()
    assert Counter(map(tuple, out)) == kept and kept


def test_one_near_duplicate_stays_whatever_its_ids(spark, pipeline):
    base = [f"w{i}" for i in range(100)]
    near = lambda tag: [" ".join([f"{tag}{w}" for w in base] + [f"end{i}"]) for i in range(4)]
    rows = [(None, t, "en", "s") for t in near("a")]
    rows += [(5, t, "en", "s") for t in near("b")] + [(5, near("b")[0], "en", "s")] * 2
    rows += [(i, t, "en", "s") for i, t in zip((None, 8, 7, 8), near("c"), strict=True)]
    rows += [(None, "", "en", "s"), (None, " ", "en", "s"), (None, "lone text", "en", "s")]
    out = pipeline.near_stage(spark, make(spark, rows), "").collect()
    kept = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in out)
    assert kept == Counter({(None, "a"): 1, (5, "b"): 1, (7, "c"): 1, (None, ""): 1, (None, " "): 1, (None, "l"): 1})


def test_pipeline_on_edges(spark, pipeline, edge, empty, tmp_path):
    known = labels(spark, [(76, 1, 0, "x", 0), (100, 0, 0, "x", 0), (73, 1, 1, "x", 0)])
    known.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        out = stage(spark, edge, str(tmp_path))
        if name != "tokens":
            assert out.columns == edge.columns
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        have = Counter(r[0] for r in edge_rows())
        assert all(n <= (2 if name == "mixing" else 1) * have[i] for i, n in ids.items()), name
        if name == "exact dedup":
            assert ids[73] == 1 and 76 not in ids
