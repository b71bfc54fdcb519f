"""Ordered scans and sequential grouping where one key fills several parts."""

import random
import time
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicelake.operators import domains as dom
from splicelake.operators import exons as ex
from splicelake.operators import lists, ordered, search, types
from splicelake.operators.grouping import certain_start, fold, group_opens, next_starts
from splicelake.operators.ordered import PART, in_parts, running, running_by_key


@contextmanager
def settings(spark, **given):
    wanted = {k.replace("__", "."): v for k, v in given.items()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def parts(spark):
    """Small tables keep all their parts."""
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        yield


@pytest.mark.parametrize("kind", ["sum", "max", "min"])
@pytest.mark.parametrize("frame", ["before", "through", "after"])
def test_running_over_cut_keys(spark, parts, kind, frame):
    rnd = random.Random(3)
    data = [(k, i, rnd.randint(-50, 50)) for k in ("a", "hot", None) for i in range(40 if k != "hot" else 200)]
    df = spark.createDataFrame(data, "k string, i int, v long")
    got = {(r.k, r.i): r.out for r in running(df, ["k"], ["i"], {"out": (kind, "v", frame)}).collect()}
    assert len(got) == len(data)
    fn = {"sum": sum, "max": max, "min": min}[kind]
    for k, i, _ in data:
        seen = [v for kk, ii, v in data if kk == k and {"before": ii < i, "through": ii <= i, "after": ii > i}[frame]]
        assert got[(k, i)] == (fn(seen) if seen else (0 if kind == "sum" else None))


def test_running_with_two_keys_and_no_rows(spark, parts):
    df = spark.range(300).selectExpr("id % 2 AS a", "CAST(NULL AS STRING) AS b", "id AS i", "1L AS one")
    got = running(df, ["a", "b"], ["i"], {"n": ("sum", "one", "through")})
    assert {(r.i, r.n) for r in got.collect()} == {(i, i // 2 + 1) for i in range(300)}
    assert running(df.limit(0), ["a"], ["i"], {"n": ("sum", "one", "through")}).count() == 0


def test_a_gene_with_a_third_of_the_rows_within_one_megabase_is_cut(spark, parts):
    """30,000 exons, 10,000 of them in one gene of 900,000 bases."""
    exons = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7L ELSE 100 + id % 2000 END AS gene_key",
        "(id * 7919) % 900000 AS genomic_start_tx", "(id * 7919) % 900000 + 50 + id % 90 AS genomic_end_tx",
    )
    laid = in_parts(exons, ["gene_key"], ["genomic_start_tx", "genomic_end_tx"]).rows
    sizes = {r[PART]: r["n"] for r in laid.filter("gene_key = 7").groupBy(PART).agg(F.count("*").alias("n")).collect()}
    assert len(sizes) >= 3 and max(sizes.values()) < 8_000
    order = ["genomic_start_tx", "genomic_end_tx"]
    got = running(exons.withColumn("one", F.lit(1).cast("long")), ["gene_key"], order, {"n": ("sum", "one", "through"), "far": ("max", "genomic_end_tx", "before")})
    hot = [tuple(r) for r in got.filter("gene_key = 7").orderBy(*order).select("genomic_end_tx", "n", "far").collect()]
    most = None
    for k, (end, n, far) in enumerate(hot):
        assert (n, far) == (k + 1, most)
        most = end if most is None else max(most, end)
    assert ex.first_long_gap(exons, 5_000).filter("gene_key = 7").count() == 0


def test_input_is_read_once(spark, parts, tmp_path, monkeypatch):
    """The written layout is the only reader of the input; everything later reads the layout."""
    path = str(tmp_path / "input")
    spark.range(1000).selectExpr("id % 3 AS k", "id AS i", "id % 10 AS v").write.parquet(path)
    plans = []
    keep = ordered.staged
    monkeypatch.setattr(ordered, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    out = running(spark.read.parquet(path), ["k"], ["i"], {"s": ("sum", "v", "through")})
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    assert out.inputFiles() and not [f for f in out.inputFiles() if path in f]


@pytest.mark.parametrize("frame", ["before", "through", "after"])
def test_running_by_key_equals_running(spark, parts, frame):
    """Ordinary keys are scanned whole, one hot and one null key in ranges."""
    rnd = random.Random(5)
    data = [(k, i, rnd.randint(-9, 9)) for k, n in (("a", 5), ("hot", 300), (None, 90), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i int, v long")
    sizes = df.groupBy("k").agg(F.count("*").alias("n_rows"))
    asked = {"s": ("sum", "v", frame), "m": ("max", "v", frame)}
    want = sorted(map(str, running(df, ["k"], ["i"], asked).collect()))
    for hot_rows in (1_000, 50, 0):
        assert sorted(map(str, running_by_key(df, ["k"], ["i"], asked, sizes, hot_rows).collect())) == want


def test_coding_coordinates_of_counted_exons_take_the_shuffle_of_their_join_only(spark, parts, monkeypatch):
    exons = spark.range(400).selectExpr(
        "id % 90 AS tx_key", "CAST(floor(id / 90) + 1 AS INT) AS order_in_transcript", "id * 100 AS genomic_start_tx", "id * 100 + 50 + id % 7 AS genomic_end_tx"
    )
    spans = exons.groupBy("tx_key").agg(F.min("genomic_start_tx").alias("tx_start"), F.max("genomic_end_tx").alias("tx_end"))
    transcripts = spans.selectExpr("*", "tx_start + 20 AS cds_start", "CASE WHEN tx_key % 4 = 0 THEN NULL ELSE tx_end - 20 END AS cds_end")
    want = sorted(map(tuple, ex.exons_to_cds(exons, transcripts).collect()))
    written = []
    keep = ordered.staged
    monkeypatch.setattr(ordered, "staged", lambda df: written.append(1) or keep(df))
    sizes = exons.groupBy("tx_key").agg(F.count("*").alias("n_rows"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        got = ex.exons_to_cds(exons, transcripts, sizes=sizes)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, got.collect())) == want
        final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not written and "Window" in plan and final.count("Exchange hashpartitioning") == 2


def test_ranks_of_hot_keys(spark, parts):
    rows = spark.range(4000).selectExpr(
        "IF(id % 3 = 0, 1L, id) AS gene_key", "id AS tx_key", "CAST(IF(id % 5 = 0, 1, 0) AS INT) AS canonical", "IF(id % 7 = 0, NULL, 3000L) AS protein_nt"
    )
    got = [tuple(r) for r in search.rank_transcripts(rows).filter("gene_key = 1").select("tx_key", "display_rank").collect()]
    keyed = sorted((r for r in rows.collect() if r.gene_key == 1), key=lambda r: (r.canonical == 0, -(r.protein_nt or 0), r.tx_key))
    assert sorted(got) == sorted((r.tx_key, k + 1) for k, r in enumerate(keyed))


def test_type_numbers_follow_text_order(spark, parts):
    heads = spark.range(3000).selectExpr("concat('pfam00000', id) AS node", "concat('pfam00000', id) AS component")
    got = {r.ext_id: r.type_id for r in types.number_types(heads).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 3001))


# --- sequential grouping --------------------------------------------------------------------------


def brute(spans):
    opens, lo, hi = [], None, None
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        inside = lo is not None and ((lo <= s and e <= hi) or (s <= lo and e >= hi))
        half = lo is not None and max(hi, e) > lo and (min(hi, e) - s) / (max(hi, e) - lo) >= 0.5
        if inside or half:
            hi = max(hi, e)
        else:
            opens.append((s, e))
            lo, hi = s, e
    return opens


SHAPES = {
    "dense": lambda rnd, n: {(s, s + rnd.randint(4, 40)) for s in range(n)},
    "sliding": lambda rnd, n: {(s, s + 60) for s in range(n)},
    "nested": lambda rnd, n: {(0, 4 * n)} | {(s, s + rnd.randint(1, 9)) for s in range(n)},
    "halves": lambda rnd, n: {(s * 3, s * 3 + 6 + s % 4) for s in range(n)},
    "growing": lambda rnd, n: {(s, s + s // 2 + 3) for s in range(n)},
    "sparse": lambda rnd, n: {(s * 20, s * 20 + rnd.randint(15, 45)) for s in range(n)},
    "same starts": lambda rnd, n: {(s // 6 * 9, s // 6 * 9 + rnd.randint(1, 70)) for s in range(n)},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_next_starts_and_certain_starts(shape):
    rnd = random.Random(shape)
    for size in (1, 2, 40, 150):
        spans = sorted(SHAPES[shape](rnd, size), key=lambda x: (x[0], -x[1]))
        s, e = (np.array(v, np.int64) for v in zip(*spans))
        following = next_starts(s, e).tolist()
        for b in range(len(spans)):
            opens, _ = fold(s[b:].tolist(), e[b:].tolist(), None)
            assert following[b] == next((b + k for k, o in enumerate(opens) if o and k), len(spans))
        for cut in {1, 2, len(spans) // 3, len(spans) // 2} - {0}:
            if cut >= len(spans):
                continue
            far, last = np.maximum.accumulate(e), np.maximum.accumulate(s)
            c = certain_start(s[cut:], e[cut:], last[cut - 1 : -1], far[cut - 1 : -1])
            if c is not None:
                for b in range(cut):
                    state = fold(s[b:cut].tolist(), e[b:cut].tolist(), None)[1]
                    assert fold(s[cut:].tolist(), e[cut:].tolist(), state)[0][c] == 1


@pytest.mark.parametrize("shape", SHAPES)
def test_close_groups_of_a_hot_transcript_over_many_parts(spark, parts, shape):
    rnd = random.Random(shape)
    hot = SHAPES[shape](rnd, 900)
    few = {(k, s, s + rnd.randint(0, 40)) for k in range(2, 30) for s in [rnd.randint(1, 90) for _ in range(9)]}
    df = spark.createDataFrame(sorted({(1, *x) for x in hot} | few), "tx_key long, aa_start long, aa_end long")
    got = dom.close_groups(df).groupBy("tx_key", "group_at").agg(F.min(F.struct("aa_start", F.col("aa_end") * -1)).alias("f"), F.countDistinct("island").alias("n"))
    found: dict = {}
    for r in got.orderBy("tx_key", "group_at").collect():
        assert r.n == 1
        found.setdefault(r.tx_key, []).append((r.group_at, r.f[0], -r.f[1]))
    for k in range(1, 30):
        spans = hot if k == 1 else {(s, e) for t, s, e in few if t == k}
        assert found[k] == [(i + 1, *x) for i, x in enumerate(brute(spans))]


def test_groups_are_marked_batch_by_batch(spark, parts):
    """A part passes through Python in batches, with the open group handed on; it is never one pandas group."""
    rnd = random.Random(8)
    spans = {k: {(s, s + rnd.randint(1, 60)) for s in rnd.sample(range(4000), n)} for k, n in ((1, 700), (2, 3), (3, 90), (4, 1))}
    df = spark.createDataFrame([(k, *x) for k, v in spans.items() for x in v], "tx_key long, aa_start long, aa_end long")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        got = dom.close_groups(df).groupBy("tx_key", "group_at").agg(F.min(F.struct("aa_start", F.col("aa_end") * -1)).alias("f")).collect()
    assert sorted((r.tx_key, r.group_at, r.f[0], -r.f[1]) for r in got) == [(k, i + 1, *x) for k, v in spans.items() for i, x in enumerate(brute(v))]
    laid = in_parts(df.withColumn("_neg_end", -F.col("aa_end")), ["tx_key"], ["aa_start", "_neg_end"])
    seen = ordered.scan(laid, {"_prev_end": ("max", "aa_end", "before"), "_prev_start": ("max", "aa_start", "before")})
    plan = group_opens(laid.rewritten(seen))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_a_chain_of_200_000_spans_is_grouped_in_several_tasks(spark, parts):
    df = spark.range(200_000).selectExpr("1L AS tx_key", "id * 3 AS aa_start", "id * 3 + 4 + id * id % 23 AS aa_end")
    assert in_parts(df, ["tx_key"], ["aa_start"]).rows.select(PART).distinct().count() == 8
    began = time.time()
    out = dom.close_groups(df).agg(F.max("group_at"), F.count("*")).first()
    assert time.time() - began < 60
    spans = [(i * 3, i * 3 + 4 + i * i % 23) for i in range(200_000)]
    assert tuple(out) == (len(brute(spans)), 200_000)


def test_small_transcripts_are_ranked_without_a_layout(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.randint(1, 9), a := rng.randint(1, 30), a + rng.randint(0, 20), f"x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "tx_key long, type_id long, aa_start long, aa_end long, ext_id string")
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] - r[3], r[2], r[1], r[4]))
        want += [(*r, n) for n, r in enumerate(mine, 1)]
    for hot in (100, 1000):  # transcript 2 is hot, then none
        assert sorted(map(tuple, dom.rank_domains(df, hot).collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(ordered, "in_parts", None)
    assert dom.rank_domains(df).count() == 300


def test_items_of_small_groups_are_numbered_without_a_layout(spark, monkeypatch):
    monkeypatch.setattr(ordered, "in_parts", None)
    df = spark.sql("SELECT * FROM VALUES ('a', NULL, 'y'), ('a', NULL, 'x'), (NULL, 'b', 'z'), ('a', NULL, 'x'), ('a', 'b', NULL) AS t(k, l, v)")
    got = lists.item_rows(df, ["k", "l"], F.col("v"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("a", None, 1, "x"), ("a", None, 2, "x"), ("a", None, 3, "y"), (None, "b", 1, "z")]
    assert lists.item_rows(df, ["k"], F.col("v"), unique=True).count() == 3
