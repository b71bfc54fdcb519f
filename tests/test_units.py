"""Hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from splicelake.functions import coords, ids, text
from splicelake.operators import domains as dom
from splicelake.operators import exons as ex
from splicelake.operators import joins
from splicelake.operators import search as se
from splicelake.operators import similarity as sim
from splicelake.operators import stats
from splicelake.operators import types as ty
from splicelake.operators.lists import group_text, item_rows, text_pieces
from splicelake.operators.ordered import interval_join, running


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def one_transcript(spark):
    exons = spark.createDataFrame(
        [(1, 1, 1, 100, 200), (1, 1, 2, 300, 400), (1, 1, 3, 500, 600), (1, 1, 4, 700, 800)],
        "tx_key long, gene_key long, order_in_transcript int, genomic_start_tx long, genomic_end_tx long",
    )
    tx = spark.createDataFrame([(1, 100, 800, 150, 520)], "tx_key long, tx_start long, tx_end long, cds_start long, cds_end long")
    return exons, tx


def test_exons_to_cds(one_transcript):
    cds = ex.exons_to_cds(*one_transcript)
    assert rows(cds, "order_in_transcript", "abs_start_cds", "abs_end_cds", "coding_rank") == [
        (1, 1, 50, 1), (2, 51, 150, 2), (3, 151, 170, 3), (4, 0, 0, 0)
    ]


def test_exons_to_cds_without_coding_span_uses_the_extent(spark, one_transcript):
    exons, _ = one_transcript
    tx = spark.createDataFrame([(1, 100, 800, None, None)], "tx_key long, tx_start long, tx_end long, cds_start long, cds_end long")
    assert rows(ex.exons_to_cds(exons, tx), "abs_start_cds", "abs_end_cds") == [(1, 100), (101, 200), (201, 300), (301, 400)]


def test_domain_relation_and_pieces(spark, one_transcript):
    cds = ex.exons_to_cds(*one_transcript)
    d = spark.createDataFrame(
        [(1, 1, 1, 10), (1, 2, 10, 55), (1, 3, 60, 90)], "tx_key long, type_id long, aa_start long, aa_end long"
    )
    rel = dom.domain_exon_relation(d, cds)
    # 1-30 inside exon 1; 28-165 over exons 1-3; 178-270 starts past the coding end.
    assert rows(rel, "type_id", "first_exon", "relation") == [(1, 1, "complete_exon"), (2, 1, "splice_junction")]
    assert rows(dom.unplaced_domains(d, cds), "type_id") == [(3,)]
    pieces = dom.splice_in_domains(d, cds)
    assert rows(pieces, "exon_order", "included_len", "included_abs", "exon_num_in_domain") == [
        (1, -23, 23, 1), (2, 100, 100, 2), (3, 15, 15, 3)
    ]


def test_pieces_with_utr_exons_counted(spark):
    cds = spark.createDataFrame(
        [(1, 1, 1, 30, 1), (1, 2, 0, 0, 0), (1, 3, 31, 60, 2)],
        "tx_key long, order_in_transcript int, abs_start_cds long, abs_end_cds long, coding_rank long",
    )
    d = spark.createDataFrame([(1, 7, 5, 15), (1, 8, 5, 40)], "tx_key long, type_id long, aa_start long, aa_end long")
    got = rows(dom.splice_in_domains(d, cds, count_utr_exons=True), "type_id", "exon_order", "included_len", "exon_num_in_domain")
    assert got == [(7, 1, -18, 1), (7, 2, 1, 2), (7, 3, 15, 3), (8, 1, -18, 1), (8, 2, 1, 2), (8, 3, 30, 3)]


def brute_close_groups(spans):
    order = sorted(spans, key=lambda s: (s[0], -s[1]))
    groups, lo, hi = [], None, None
    for s, e in order:
        joins_ = lo is not None and (
            (lo <= s and e <= hi) or (s <= lo and hi <= e)
            or (max(hi, e) > min(lo, s) and (min(hi, e) - max(lo, s)) / (max(hi, e) - min(lo, s)) >= 0.5)
        )
        if joins_:
            groups[-1].append((s, e))
            lo, hi = min(lo, s), max(hi, e)
        else:
            groups.append([(s, e)])
            lo, hi = s, e
    return sorted(sorted(g) for g in groups)


def test_close_groups_against_brute_force(spark):
    rnd = random.Random(5)
    spans = {(k, s, s + rnd.randint(0, 40)) for k in range(30) for s in [rnd.randint(1, 90) for _ in range(15)]}
    df = spark.createDataFrame(sorted(spans), "tx_key long, aa_start long, aa_end long")
    got = {}
    for r in dom.close_groups(df).collect():
        got.setdefault((r.tx_key, r.island, r.group_at), []).append((r.aa_start, r.aa_end))
    for k in range(30):
        want = brute_close_groups([(s, e) for t, s, e in spans if t == k])
        assert sorted(sorted(v) for key, v in got.items() if key[0] == k) == want


def test_islands_and_flags_for_one_hot_key_over_many_chunks(spark):
    """One transcript holds every row and spans many chunks; copies abound."""
    rnd = random.Random(7)
    spans = [(1, s, s + rnd.randint(0, 900)) for s in [rnd.randint(1, 60_000) for _ in range(400)]]
    spans += spans[:50]
    df = spark.createDataFrame(spans, "tx_key long, aa_start long, aa_end long")
    order = sorted(spans, key=lambda s: (s[1], -s[2]))
    island, hi, want = 0, -1, {}
    for _, s, e in order:
        if s > hi:
            island += 1
        hi = max(hi, e)
        want[(s, e)] = island
    got = {(r.aa_start, r.aa_end): r.island for r in dom.overlap_islands(df).collect()}
    assert got == want
    flags = {(r.aa_start, r.aa_end): r.overlap for r in dom.overlap_flags(df).collect()}
    for (_, s, e) in set(spans):
        hits = sum(1 for _, a, b in spans if a <= e and b >= s)
        assert flags[(s, e)] == (hits > 1)


@pytest.mark.parametrize("kind", ["sum", "max", "min"])
@pytest.mark.parametrize("frame", ["before", "through", "after"])
def test_running_equals_brute_force(spark, kind, frame):
    rnd = random.Random(3)
    data = [(k, i, rnd.randint(-50, 50)) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i int, v long")
    got = {(r.k, r.i): r.out for r in running(df, ["k"], ["i"], {"out": (kind, "v", frame)}).collect()}
    fn = {"sum": sum, "max": max, "min": min}[kind]
    for k, i, _ in data:
        seen = [v for kk, ii, v in data if kk == k and {"before": ii < i, "through": ii <= i, "after": ii > i}[frame]]
        assert got[(k, i)] == (fn(seen) if seen else (0 if kind == "sum" else None))


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(11)
    make = lambda n: [(rnd.randint(1, 2), s, s + rnd.randint(0, 70)) for s in [rnd.randint(0, 300) for _ in range(n)]]
    a, b = make(60), make(60)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "l int, k int, ls long, le long")
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "r int, k int, rs long, re long")
    got = rows(interval_join(left, right, ["k"], ("ls", "le"), ("rs", "re"), 16), "l", "r")
    want = sorted(
        (i, j) for i, (k1, s1, e1) in enumerate(a) for j, (k2, s2, e2) in enumerate(b) if k1 == k2 and s1 <= e2 and e1 >= s2
    )
    assert got == want


def test_group_text_keeps_order_in_groups_of_any_size(spark):
    df = spark.range(30_000).selectExpr("'a' AS k", "CAST(id AS STRING) AS v", "-id AS s").union(spark.sql("SELECT 'b', 'x', 1L"))
    got = {r.k: r.txt for r in group_text(df, ["k"], F.col("v"), ",", "txt", sort_by=[F.col("s")]).collect()}
    assert got == {"a": ",".join(str(i) for i in reversed(range(30_000))), "b": "x"}


def test_item_rows_of_a_hot_group_and_their_pieces(spark):
    """A group of a third of the rows lies in several parts; nulls are left out, ties stay, a null key is a group."""
    rows = [("hot", k % 50, f"v{k % 700:03}") for k in range(3000)] + [(f"k{k % 900}", k % 7, f"v{k % 11}") for k in range(6000)]
    rows += [(None, 1, "b"), (None, 0, "z"), (None, None, "n"), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, s int, v string")
    for unique in (False, True):
        want = {}
        for k, s, v in set(rows) if unique else rows:
            if v is not None:
                want.setdefault(k, []).append((s is not None, s or 0, v))
        want = {k: [v for *_, v in sorted(x)] for k, x in want.items()}
        items = item_rows(df, ["k"], F.col("v"), sort_by=[F.col("s")], unique=unique)
        got = {}
        for r in items.collect():
            got.setdefault(r["k"], []).append((r["position"], r["item"]))
        assert {k: [v for _, v in sorted(x)] for k, x in got.items()} == want
        assert all([p for p, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())
    pieces = text_pieces(items, ["k"], ",", 100).filter("k = 'hot'").orderBy("piece").collect()
    assert max(len(r["text"].split(",")) for r in pieces) == 100 and ",".join(r["text"] for r in pieces) == ",".join(want["hot"])
    assert item_rows(df.limit(0), ["k"], F.col("v")).count() == 0


def test_gene_document_loses_no_transcript(spark):
    genes = spark.createDataFrame(
        [(k, f"g{k}", None, f"S{k}", None, "1", "+", "H_sapiens") for k in (1, 2)],
        "gene_key long, gene_geneid_id string, gene_ensembl_id string, gene_symbol string, synonyms string, chromosome string, strand string, specie string",
    )
    tx = spark.createDataFrame(
        [(1, 10), (1, 11), (1, 12)], "gene_key long, tx_key long"
    ).selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in se.TRANSCRIPT_ID_COLUMNS], "1L AS tx_start", "9L AS tx_end", "0 AS canonical")
    cds = spark.range(1, 6001).selectExpr(
        "1L AS gene_key", "10L AS tx_key", "CAST(id AS INT) AS order_in_transcript", "id * 10 AS genomic_start_tx", "id * 10 + 5 AS genomic_end_tx", "1 AS abs_start_cds", "2 AS abs_end_cds"
    )
    proteins = spark.sql("SELECT t AS tx_key, 'p' AS protein_refseq_id, 'e' AS protein_ensembl_id, 'd' AS description, 5 AS length FROM VALUES (10L), (11L) v(t)")
    domains = spark.sql("SELECT 11L AS tx_key, 1 AS aa_start, 2 AS aa_end, 3 AS type_id, 'x' AS ext_id, 'n' AS name")
    docs = {(r.gene_key, r.tx_key): r for r in se.gene_document(genes, tx, cds, proteins, domains).collect()}
    assert set(docs) == {(1, 10), (1, 11), (1, 12), (2, None)}
    assert [e.order_in_transcript for e in docs[1, 10].exons] == list(range(1, 6001))
    assert docs[1, 11].exons == [] and docs[1, 11].protein.length == 5 and len(docs[1, 11].domains) == 1
    assert docs[1, 12].protein is None and docs[1, 12].exons == [] == docs[1, 12].domains


def test_components_over_a_long_chain_and_a_hub(spark):
    chain = [(f"n{i:03d}", f"h{i:03d}") for i in range(40)] + [(f"n{i + 1:03d}", f"h{i:03d}") for i in range(39)]
    hub = [(f"z{i:03d}", "hub") for i in range(200)]
    got = dict(rows(ty.resolve_domain_types(spark.createDataFrame(chain + hub, "node string, hub string")), "node", "component"))
    assert {got[n] for n, _ in chain} == {"n000"}
    assert {got[n] for n, _ in hub} == {"z000"}


def brute_gene_similarity(txs, weights=(1, 1, 1)):
    def cell(a, b):
        (s1, e1, c1, d1), (s2, e2, c2, d2) = a, b
        joint = max(e1, e2) - min(s1, s2)
        A = max(0, min(e1, e2) - max(s1, s2)) / joint if joint else 0
        B = 1 if c1 == c2 and c1 != 0 else 0
        common = sum(min(d1.count(x), d2.count(x)) for x in set(d1))
        C = common / (len(d1) + len(d2) - common) if common else 0
        return 1 if A == 1 else (A * weights[0] + B * weights[1] + C * weights[2]) / sum(weights)

    def pair(t, u):
        m = [[cell(a, b) for b in u] for a in t]
        return 100 * (sum(max(r) for r in m) + sum(max(c) for c in zip(*m))) / (len(t) + len(u))

    scores = [pair(txs[i], txs[j]) for i in range(len(txs)) for j in range(i)]
    return sum(scores) / len(scores) if scores else None


@pytest.mark.parametrize("weights", [(1, 1, 1), (3, 1, 2)])
def test_gene_similarity_against_all_pairs(spark, weights):
    rnd = random.Random(2)
    exon_rows, type_rows, genes = [], [], {}
    for g in range(6):
        for k in range(1 if g == 0 else rnd.randint(2, 6)):
            tx = g * 100 + k
            built = []
            for o in range(1, rnd.randint(2, 6)):
                s = rnd.choice([0, 100, 250, 400, 900, 2500])
                e, clen = s + rnd.choice([60, 90, 200]), rnd.choice([0, 29, 59, 89])
                held = [rnd.randint(1, 3) for _ in range(rnd.randint(0, 3))]
                built.append((s, e, clen, held))
                exon_rows.append((g, tx, o, s, e, clen, len(held)))
                type_rows += [(tx, o, d, held.count(d)) for d in set(held)]
            genes.setdefault(g, []).append(built)
    exons = spark.createDataFrame(exon_rows, "gene_key long, tx_key long, order_in_transcript int, s long, e long, coding_len long, n_complete long")
    types = spark.createDataFrame(type_rows, "tx_key long, order_in_transcript int, type_id long, n_type long")
    got = {r.gene_key: r.similarity for r in sim.gene_similarity(exons.select("gene_key", "tx_key").distinct(), exons, types, weights).collect()}
    for g, txs in genes.items():
        want = brute_gene_similarity(txs, weights)
        assert got[g] == (None if want is None else pytest.approx(want))


def test_exon_length_match_with_space_against_greedy_scan(spark):
    rnd = random.Random(4)
    g = [(1, "AB"), (2, "ab"), (3, "Ab"), (4, "CD"), (5, "cd"), (6, "solo")]
    exons = [(k, s, s + rnd.randint(20, 200)) for k, _ in g for s in rnd.sample(range(0, 5000, 250), 9)]
    genes = spark.createDataFrame(g, "gene_key long, gene_symbol string")
    u = spark.createDataFrame(exons, "gene_key long, genomic_start_tx long, genomic_end_tx long")
    for space in (0, 3, 15):
        got = {r.symbol: r.matched for r in sim.exon_length_match(genes, u, space).collect()}
        for symbol, (a, b) in {"AB": (1, 2), "CD": (4, 5)}.items():
            free = [e - s for k, s, e in sorted(exons) if k == b]
            hits = 0
            for k, s, e in sorted(exons):
                at = next((i for i, m in enumerate(free) if k == a and abs(m - (e - s)) <= space), None)
                if at is not None:
                    free.pop(at)
                    hits += 1
            assert got[symbol] == hits
        assert "SOLO" not in got


def test_dedupe_transcripts(spark):
    df = spark.createDataFrame(
        [(1, "R1", "E1"), (2, "R1", "E2"), (3, "R1", None), (4, None, "E2"), (5, "R2", "E1"), (6, "R1", "E1")],
        "ord long, transcript_refseq_id string, transcript_ensembl_id string",
    )
    got = joins.dedupe_transcripts(df, "ord").select("ord", "transcript_refseq_id", "transcript_ensembl_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, "R1", "E1"), (2, None, "E2"), (5, "R2", None)]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("a; b", "b; c"), (None, "x"), ("Kinase domain", "kinase"), ("kin", "The KIN box"), (None, None)], "a string, b string"
    )
    a, b = F.col("a"), F.col("b")
    got = df.select(text.merge_string_set(a, b), text.merge_note(a, b), text.merge_description(a, b)).collect()
    assert [tuple(r) for r in got] == [
        ("a; b; c", "a; b; b; c", "a; b; b; c"),
        ("x", "x", "x"),
        ("Kinase domain; kinase", "Kinase domain", "Kinase domain; kinase"),
        ("The KIN box; kin", "The KIN box", "kin; The KIN box"),
        (None, None, None),
    ]


def test_ids(spark):
    df = spark.createDataFrame([("NM_1.12", "TIGR001", None), ("mito-5", "PRK77", None), ("plain", None, "cd1")], "t string, x string, c string")
    got = [tuple(r) for r in df.select(ids.strip_version(F.col("t")), ids.version_of(F.col("t"))).collect()]
    assert got == [("NM_1", "12"), ("mito-5", "mito"), ("plain", None)]
    good, bad = ids.normalize_ext_id(df, "x", "c")
    assert {(r.x, r.ext_norm, r.ext_source) for r in good.collect()} == {("TIGR001", "tigr001", "tigrfams"), (None, None, None)}
    assert [r.x for r in bad.collect()] == ["PRK77"]


def test_coordinates(spark):
    df = spark.createDataFrame([(5, 10, "n"), (5, None, "n")], "s long, e long, n string")
    span = coords.aa_to_nuc(F.col("s"), F.col("e"), F.col("n"))
    got = [tuple(r) for r in df.select(span["nuc_start"], span["nuc_end"], span["name"]).collect()]
    assert got == [(13, 30, "n"), (0, 0, "Error_n")]


def test_first_long_gap(spark):
    df = spark.createDataFrame(
        [(1, 0, 100), (1, 50, 3_000_000), (1, 4_500_000, 4_500_100), (1, 9_000_000, 9_000_010), (2, 0, 10), (2, 900_000, 900_010)],
        "gene_key long, genomic_start_tx long, genomic_end_tx long",
    )
    assert rows(ex.first_long_gap(df), "gene_key", "gap_start", "gap_length") == [(1, 3_000_000, 1_500_000)]


def test_quality_checks_hold_on_the_data(spark):
    from splicelake.plans.derived import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    spans = stats.check_spans(t.transcripts).first()
    assert spans.short_tx == 0 and spans.cds_past_end == 0
    assert stats.small_exons(t.exons).first().size_0_or_less == 0
    pieces = dom.splice_in_domains(t.domains, t.cds)
    broken = pieces.groupBy("tx_key", "type_id", "aa_start", "aa_end", "ext_id", "total_length").agg(F.sum("included_abs").alias("n"))
    assert broken.filter("n <> total_length").count() == 0


def test_same_exons(spark):
    from splicelake.operators.reconcile import same_exons

    exons = spark.createDataFrame(
        [(1, 1, 0, 9), (1, 2, 20, 29), (2, 1, 0, 9), (2, 2, 20, 29), (3, 1, 20, 29), (3, 2, 0, 9), (4, 1, 0, 9)],
        "tx_key long, order_in_transcript int, genomic_start_tx long, genomic_end_tx long",
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 1)], "a_tx long, b_tx long")
    assert rows(same_exons(pairs, exons), "a_tx", "b_tx", "same_exons") == [(1, 2, True), (1, 3, False), (1, 4, False), (4, 1, False)]


def test_gene_similarity_of_a_hot_gene_with_exons_of_no_length(spark):
    """One gene holds most rows, most exons share a type, and some exons have equal start and end."""
    rnd = random.Random(9)
    exon_rows, type_rows, genes = [], [], {}
    for g, n in ((1, 60), (2, 3), (3, 2)):
        for k in range(n):
            built = []
            for o in range(1, 6):
                s = rnd.choice([0, 40, 100, 900])
                e, clen = s + rnd.choice([0, 60, 90]), rnd.choice([0, 29, 59])
                held = [7] * rnd.randint(0, 2) + [rnd.randint(1, 3) for _ in range(rnd.randint(0, 1))]
                built.append((s, e, clen, held))
                exon_rows.append((g, g * 1000 + k, o, s, e, clen, len(held)))
                type_rows += [(g * 1000 + k, o, d, held.count(d)) for d in set(held)]
            genes.setdefault(g, []).append(built)
    exons = spark.createDataFrame(exon_rows, "gene_key long, tx_key long, order_in_transcript int, s long, e long, coding_len long, n_complete long")
    types = spark.createDataFrame(type_rows, "tx_key long, order_in_transcript int, type_id long, n_type long")
    got = {r.gene_key: r.similarity for r in sim.gene_similarity(exons.select("gene_key", "tx_key").distinct(), exons, types, (2, 1, 1)).collect()}
    for g, txs in genes.items():
        assert got[g] == pytest.approx(brute_gene_similarity(txs, (2, 1, 1)))


@pytest.mark.parametrize("paired", [0, 20, 1000])
def test_gene_similarity_keeps_pairs_of_exons_inside_tasks(spark, paired):
    """Genes under the limit shuffle their exons only; genes on both sides of it give the same scores."""
    rnd = random.Random(11)
    exon_rows, type_rows, genes = [], [], {}
    for g, n in ((1, 14), (2, 3), (3, 2), (4, 9), (5, 1)):
        for k in range(n):
            built = []
            for o in range(1, 5):
                s = rnd.choice([0, 40, 100, 900, 5000])
                e, clen = s + rnd.choice([0, 60, 90, 3000]), rnd.choice([0, 29, 59])
                held = [rnd.randint(1, 4) for _ in range(rnd.randint(0, 3))]
                built.append((s, e, clen, held))
                exon_rows.append((g, g * 1000 + k, o, s, e, clen, len(held)))
                type_rows += [(g * 1000 + k, o, d, held.count(d)) for d in set(held)]
            genes.setdefault(g, []).append(built)
    exons = spark.createDataFrame(exon_rows, "gene_key long, tx_key long, order_in_transcript int, s long, e long, coding_len long, n_complete long")
    types = spark.createDataFrame(type_rows, "tx_key long, order_in_transcript int, type_id long, n_type long")
    scored = sim.gene_similarity(exons.select("gene_key", "tx_key").distinct(), exons, types, (2, 1, 3), paired_exons=paired)
    got = {r.gene_key: r.similarity for r in scored.collect()}
    for g, txs in genes.items():
        want = brute_gene_similarity(txs, (2, 1, 3))
        assert got[g] == (None if want is None else pytest.approx(want))
    if paired == 1000:
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert not any("shape" in line.split("hashpartitioning", 1)[1].split("ENSURE")[0] for line in plan.splitlines() if "hashpartitioning" in line)


def test_gene_similarity_of_exons_without_spans_or_lengths(spark):
    """Missing starts, ends and lengths count alike whether a gene is dealt whole or spread over bins."""
    rnd = random.Random(12)
    exon_rows, type_rows = [], []
    for g in range(8):
        for k in range(rnd.randint(2, 5)):
            for o in range(1, 5):
                s = rnd.choice([None, 0, 40, 100])
                e = rnd.choice([None, 60, 130])
                held = [rnd.randint(1, 3) for _ in range(rnd.randint(0, 2))]
                exon_rows.append((g if g else None, g * 100 + k if k else None, o, s, e, rnd.choice([None, 0, 29]), len(held)))
                type_rows += [(g * 100 + k, o, d, held.count(d)) for d in set(held)]
    exons = spark.createDataFrame(exon_rows, "gene_key long, tx_key long, order_in_transcript int, s long, e long, coding_len long, n_complete long")
    types = spark.createDataFrame(type_rows, "tx_key long, order_in_transcript int, type_id long, n_type long")
    whole, spread = (
        {r.gene_key: r.similarity for r in sim.gene_similarity(exons.select("gene_key", "tx_key").distinct(), exons, types, (2, 1, 3), paired_exons=n).collect()}
        for n in (1000, 0)
    )
    assert whole.keys() == spread.keys()
    for g in whole:
        assert whole[g] == (None if spread[g] is None else pytest.approx(spread[g]))


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from splicelake.session import shared_dir

    def session(master, warehouse):
        settings = {"spark.sql.warehouse.dir": warehouse}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, *rest: settings.get(key, *rest)))

    assert shared_dir(session("local[4]", "file:/tmp/w")) == "file:/tmp/w/_shared"
    assert shared_dir(session("yarn", "hdfs://nn/w/")) == "hdfs://nn/w/_shared"
    for warehouse in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(RuntimeError):
            shared_dir(session("spark://host:7077", warehouse))
