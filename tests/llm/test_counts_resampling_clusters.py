"""Token counts, resampling and centroid clustering against plain Python on small awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from splicelake.llm import token_counts
from splicelake.llm.centroids import assign, centroid_clusters, cluster_vectors, half_gaps, loosening, squared_distances
from splicelake.llm.queries import tokenizer_path
from splicelake.llm.resampling import features_of, histogram, radix_ranks, resample, words_of
from splicelake.llm.token_counts import count_tokens, read_cache, tokenizer_version

LONG = " ".join(f"word{k % 97}x{k % 31}" for k in range(60_000))
PIECES = tokenizer_path("piece_bpe_32k.model")


# --- token counts ---------------------------------------------------------------------------------

TEXTS = [
    (5, "a  b\nc"), (3, "a b c"), (3, "a b c"), (9, None), (7, ""), (8, " "), (1, LONG), (None, "no id"), (6, "é" * 300),
    (10, "</s> <s> <unk>"), (11, "a▁b"), (12, "a b"), (13, "\x00tab\t"), (14, "日本語のテキスト"), (None, "no id"),
]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(docs_of, tmp_path, name):
    path = tokenizer_path(name)
    count = token_counts.load_counter(path)
    rows = count_tokens(docs_of(TEXTS), path, str(tmp_path / "cache"), limit=100).collect()
    want = sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(TEXTS, count([t or "" for _, t in TEXTS]))), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want


def test_only_distinct_misses_are_encoded(docs_of, spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    keys = lambda docs: docs.selectExpr(f"unhex(sha2(replace(coalesce(text, ''), '{token_counts.BLANK_MARK}', ' '), 256)) AS digest")
    first = docs_of(TEXTS)
    distinct = len({(t or "").replace(token_counts.BLANK_MARK, " ") for _, t in TEXTS})
    assert token_counts.fill_cache(first, keys(first), PIECES, cache) == distinct
    assert token_counts.fill_cache(first, keys(first), PIECES, cache) == 0
    more = docs_of([*TEXTS, (20, "new text"), (21, "new text")])
    monkeypatch.setattr(token_counts, "FEW_DIGESTS", 0)  # without the broadcast
    assert token_counts.fill_cache(more, keys(more), PIECES, cache) == 1
    name = tokenizer_version(PIECES)
    assert read_cache(spark, cache, name).count() == distinct + 1
    assert read_cache(spark, cache, tokenizer_version(tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_counts_come_from_the_cache(docs_of, spark, tmp_path):
    """A stored count is taken as it is, and a digest stored twice still gives one row per document."""
    cache, name = str(tmp_path / "cache"), tokenizer_version(PIECES)
    digest = hashlib.sha256(b"a b c").digest()
    for _ in range(2):
        spark.createDataFrame([(bytearray(digest), 77, name)], token_counts.CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    rows = count_tokens(docs_of([(1, "a b c"), (2, "b")]), PIECES, cache).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == [(1, 77), (2, 1)]


def test_token_counts_of_nothing(docs_of, tmp_path):
    assert count_tokens(docs_of([]), PIECES, str(tmp_path / "cache")).collect() == []


# --- resampling -----------------------------------------------------------------------------------


def plain_resample(docs, target, longest, buckets, percent, least, seed):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in runs]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault((r[0], r[4]), []).append(k + 1)
    return [(r[0], r[2], r[3], r[4]) for r in rows], sorted(k for v in ranks.values() for k in v), ranks


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(docs_of, spark, longest):
    rng = random.Random(5)
    some = ["Alpha", "beta", "GAMMA-7", "délta", "É", "x\x00y", "_", "été_9", "日本", "\U0001f600"]
    docs = [(i, " ".join(rng.choices(some, k=rng.randrange(0, 60)))) for i in range(-40, 160)]
    docs += [(7, docs[47][1]), (None, "one two three " * 9), (None, None), (1 << 62, LONG), (-(1 << 62), ""), (400, None)]
    target = ["alpha beta alpha", None, "", "délta été"]
    rows = resample(docs_of(docs), spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score long"),
                    longest=longest, buckets=97, percent=30, least_words=20).collect()
    want, places, ranks = plain_resample(docs, target, longest, 97, 30, 20, 2024)
    assert sorted((tuple(r)[:4] for r in rows), key=repr) == sorted(want, key=repr)
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == places
    for r in rows:
        if r["rank"] is not None:
            assert r["rank"] in ranks[r["doc_id"], r["score"]]


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(300))) + " MiXed9words é_\U0001f600A"
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    assert features_of([b"a", b"b", b"c"], 2) == [b"a", b"b", b"c", b"a b", b"b c"] and features_of([b"a"], 3) == [b"a"]


@pytest.mark.parametrize("part", [1 << 20, 16])
def test_radix_ranks(spark, monkeypatch, part):
    monkeypatch.setattr("splicelake.llm.resampling.PART", part)
    rng = random.Random(1)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(150)] + [0, -1, None, None, 5, 5]
    rows = [(rng.randrange(-3, 3), i) for i in ids] + [(-7000, 1), (None, 3)]
    got = radix_ranks(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(rows)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=key)


def test_resampling_nothing(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs_of([]), none).collect() == []
    assert histogram(none, 1, 10) == [0] * 10
    assert [r["rank"] for r in resample(docs_of([(1, "a " * 30)]), none, percent=100).collect()] == [1]


# --- centroid clustering --------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in set(at):
                mine = [v for (_, v), a in zip(kept, at) if a == c]
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    distance = [far(v, centroids[a]) for (_, v), a in zip(kept, at)]
    per = {c: sum(d for d, a in zip(distance, at) if a == c) for c in set(at)}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, a, d, per[a], sum(distance), sha(centroids[a])) for (i, _), a, d in zip(kept, at, distance)]


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int")


def blobs(n, dims, centres, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, dims))
    return [(i, [float(x) for x in (middle[i % centres] + rng.normal(0, spread, dims)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("dims, k, spread", [(2, 5, 0.5), (8, 7, 0.2)])
def test_clusters(spark, dims, k, spread):
    rows = blobs(600, dims, k, spread, dims)
    rows += [(700, [0.25] * dims), (700, [0.25] * dims), (None, [1.0] * dims), (701, None), (702, [1.0] * (dims - 1)), (703, [float("nan")] + [0.0] * (dims - 1)),
             (704, [float("inf")] * dims), (705, [None] + [0.0] * (dims - 1)), (706, [])]
    got = centroid_clusters(vectors_of(spark, rows).repartition(4), k=k, rounds=4, dims=dims).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_clusters(rows, k, 4, dims, 256, 2), key=repr)


def test_clusters_with_ties_and_empty_ones(spark):
    grid = [(i, [float(i % 4) / 256, float(i // 4 % 4) / 256]) for i in range(64)]  # sixteen points, four times each
    got = centroid_clusters(vectors_of(spark, grid), k=20, rounds=3, dims=2).collect()
    assert sorted(map(tuple, got)) == sorted(plain_clusters(grid, 20, 3, 2, 256, 2))


def test_clusters_of_huge_components(spark):
    rows = [(i, [float((-1) ** i * 10 ** (i % 7) * 1000), float(i)]) for i in range(40)]
    got = centroid_clusters(vectors_of(spark, rows, "double"), k=4, rounds=3, dims=2).collect()
    most = (1 << 63) - 1
    want = [(i, c, min(d, most), min(p, most), min(w, most), s) for i, c, d, p, w, s in plain_clusters(rows, 4, 3, 2, 256, 2)]
    assert sorted(map(tuple, got)) == sorted(want)
    held = centroid_clusters(vectors_of(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "double"), k=1, rounds=0, dims=2).collect()
    assert max(r["distance"] for r in held) == (1 << 63) - 1


def test_few_or_no_vectors(spark):
    assert centroid_clusters(vectors_of(spark, []), dims=2).collect() == []
    assert centroid_clusters(vectors_of(spark, [(1, [1.0])]), dims=2).columns[0] == "vec_id"
    one = centroid_clusters(vectors_of(spark, [(1, [1.0, 2.0])]), dims=2).collect()
    assert [(r["cluster"], r["distance"]) for r in one] == [(0, 0)]


def test_bounds_spare_scans(spark):
    _, _, scans = cluster_vectors(vectors_of(spark, blobs(2000, 16, 8, 0.05, 3)), k=8, rounds=5, dims=16)
    assert scans[0] == 2000 and sum(scans[1:]) < 0.7 * 2000 * 5


def test_loosening_is_a_bound_and_below_the_drift():
    rng = np.random.default_rng(11)
    tighter = total = 0
    for _ in range(300):
        old = rng.integers(-300, 300, (5, 3))
        new = old + rng.integers(-60, 60, (5, 3)) * rng.integers(0, 2, (5, 1))
        radius = rng.uniform(1, 120, 5)
        given = loosening(old, new, radius)
        for i in range(5):
            x = rng.normal(0, 1, (400, 3))
            x = old[i] + radius[i] * x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0, 1, (400, 1)) ** 0.2
            for j in set(range(5)) - {i}:
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert nearer.max() <= given[i] + 1e-6
            drift = max(np.linalg.norm(new[j] - old[j]) for j in range(5) if j != i)
            assert given[i] <= drift + 1e-6
            tighter, total = tighter + (given[i] < 0.9 * drift), total + 1
    assert tighter > total / 4


def test_assign_keeps_exact_results_for_any_bounds():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-99, 99, (500, 4)), rng.integers(-99, 99, (6, 4))
    first = assign(x, c, None, None, np.zeros(6), half_gaps(c))
    moved = c + rng.integers(-5, 6, c.shape)
    radius = np.array([math.sqrt(max([int(d) for d in first[1][first[0] == k]] or [0])) for k in range(6)])
    cluster, distance, lower, _ = assign(x, moved, first[0], first[2], loosening(c, moved, radius), half_gaps(moved))
    whole = squared_distances(x, moved)
    assert (cluster == whole.argmin(1)).all() and [int(d) for d in distance] == whole.min(1).tolist()
    others = np.where(np.arange(6)[None, :] == cluster[:, None], np.inf, np.sqrt(whole))
    assert (lower <= others.min(1) + 1e-9).all()


def test_tokenizer_versions_differ():
    names = {tokenizer_version(tokenizer_path(n)) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")}
    assert len(names) == 3
