"""Corpus operators against plain Python on small awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from splicelake.llm import lines, packing, secrets
from splicelake.llm.common import stage, summed_vectors, tables_of
from splicelake.llm.chat import escaped, format_tree, parse, parts_of, read_back, unescaped
from splicelake.llm.exact_dedup import distinct_documents, exact_dedup
from splicelake.llm.fingerprint import fingerprint_with_edits
from splicelake.llm.jaccard import near_groups, tree_overlaps
from splicelake.llm.lines import edit_distance_within, line_dedup
from splicelake.llm.mixing import mix
from splicelake.llm.quality import apply_quality, fit_quality, threshold_step
from splicelake.llm.queries import QUERIES, tokenizer_path
from splicelake.llm.repeats import remove_repeats

LONG = " ".join(f"word{k % 97}x{k % 31}" for k in range(4000))
ROWS = [
    (5, "a  b\nc", "s2"), (3, "a b c", "s1"), (9, None, "s1"), (7, "", None), (8, " ", "s1"), (1, LONG, "s2"),
    (2, LONG + " end", "s3"), (4, LONG, "s2"), (4, LONG, "s2"), (None, "lonely words without id", "s1"), (6, "é" * 300, None),
]


def test_exact_dedup(docs_of):
    rows = exact_dedup(docs_of(ROWS)).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in rows) == len(groups)
    assert distinct_documents(docs_of(ROWS)).count() == len(groups)


def test_exact_dedup_across_parts(docs_of):
    rows = exact_dedup(docs_of([(i, "same text") for i in range(400)]).repartition(7)).collect()
    assert {r["keep_id"] for r in rows} == {0} and {r["group_size"] for r in rows} == {400}
    assert [r["doc_id"] for r in rows if r["kept"]] == [0]


def test_fingerprints(docs_of):
    rows = sorted(fingerprint_with_edits(docs_of(ROWS)).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[4]["fingerprint"] != by[2]["fingerprint"]
    assert by[7]["fingerprint"] == by[9]["fingerprint"]
    n = len(LONG) // 4
    assert by[1]["edited_sha256"] == hashlib.sha256((LONG[:-n] + (LONG + " end")[:n]).encode()).hexdigest()
    assert by[9]["n_chars"] == 0 and by[1]["near_next"] > 0.95 and 0 <= by[3]["near_edited"] <= 1
    a, b = (fingerprint_with_edits(docs_of([(1, t)])).first() for t in ("p one\np two\np three", "p three\np one\np two"))
    assert a["fingerprint"] == b["fingerprint"] and a["near_next"] == 1.0


def test_line_dedup_matches_brute_force(docs_of):
    rng = np.random.default_rng(2)
    base = ["the quick brown fox jumps over it", "a line of about forty characters here", "short"]
    rows = []
    for i in range(40):
        said = list(base[i % 3])
        for _ in range(int(rng.integers(0, 4))):
            said[int(rng.integers(len(said)))] = "#"
        rows.append((i, "".join(said) + "\n" + base[(i + 1) % 3]))
    rows.append((40, None))
    got = {r["doc_id"]: r["dropped"] for r in line_dedup(docs_of(rows), least=lines.MIN_CHARS).collect()}
    said = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    root = {p: p for p in range(len(said))}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in range(len(said)):
        for q in range(p):
            if min(len(said[p][2]), len(said[q][2])) >= lines.MIN_CHARS and edit_distance_within(said[p][2], said[q][2], 2):
                a, b = sorted((find(p), find(q)))
                root[b] = a
    want = defaultdict(list)
    for p, (i, k, _) in enumerate(said):
        if find(p) != p:
            want[i].append(str(k))
    assert got == {i: ",".join(want[i]) for i, _ in rows}


def test_line_dedup_query_takes_short_lines_too(docs_of, spark, tmp_path):
    rng = np.random.default_rng(8)
    base = ["All rights reserved.", "Menu", "contact us", "a line of about thirty letters", "exactly 12 ch", "x", ""]
    rows = []
    for i in range(60):
        said = list(base[i % 7])
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(said) + 1))
            said[at : at + int(rng.integers(0, 2))] = "#" * int(rng.integers(0, 2))
        rows.append((i, "".join(said) + "\n" + base[(i + 1) % 7] + "\n" + base[(i + 3) % 7]))
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["dropped"] for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    said = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]
    root = list(range(len(said)))

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for p in range(len(said)):
        for q in range(p):
            x, y = said[p][2], said[q][2]
            n = min(len(x), len(y))
            if n and (x == y or n >= 12 and distance(x, y) <= (1 if n < 24 else 2)):
                a, b = sorted((find(p), find(q)))
                root[b] = a
    want = defaultdict(list)
    for p, (i, k, _) in enumerate(said):
        if find(p) != p:
            want[i].append(str(k))
    assert got == {i: ",".join(want[i]) for i, _ in rows}


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|x", "a<\\\\|b<|", "plain"])
def test_escape_round_trip(text):
    assert unescaped(escaped(text)) == text and "<|" not in escaped(text)
    assert parse("".join("".join(parts_of(r, text)) for r in ("user", "a\n\\n<|"))) == [("user", text), ("a\n\\n<|", text)]


def test_chat_tree_shares_beginnings(spark):
    rows = [(c, t, r, x) for c, tail in ((1, "x"), (2, "y"), (3, "x")) for t, r, x in ((0, "user", "hello"), (1, "assistant", tail))]
    rows += [(4, 0, None, None), (None, 0, "assistant", "né<|"), (5, 1, "user", "b"), (5, 1, "assistant", "a")]
    path = tokenizer_path("byte_bpe_50k.json")
    nodes, ways = format_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path)
    told = nodes.collect()
    assert len(told) == 7
    spots = sorted((r["start"], r["stop"]) for r in told)
    assert spots[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spots, spots[1:]))
    by = {bytes(r["node"]): r for r in told}
    for r in told:
        above = sum(s["stop"] - s["start"] for s in r["attend"])
        assert r["position"] == above and (r["parent"] is None) == (above == 0)
        if r["parent"]:
            p = by[bytes(r["parent"])]
            assert any(s["start"] <= p["start"] and p["stop"] <= s["stop"] for s in r["attend"])
    back = {r["conv_id"]: r for r in read_back(nodes, ways, path).collect()}
    assert back[None]["loss_chars"] == 4 and back[1]["turns_sha256"] == back[3]["turns_sha256"] != back[2]["turns_sha256"]
    assert back[5]["turns_sha256"] == hashlib.sha256(b"assistant\na\nuser\nb\n").hexdigest()


def test_chat_tree_on_very_long_conversations(spark):
    """20,000 turns, another way off halfway, and a repeated row, in time and memory that grow with the turns."""
    n = 20_000
    a = [(1, k, ("user", "assistant")[k % 2], f"t{k}", "x") for k in range(n)]
    b = [(2, k, r, x if k < n // 2 else x + "b", "y") for _, k, r, x, _ in a[: n // 2 + 40]]
    rows = [*a, *b, (3, 0, "user", "t0", "z"), (3, 0, "user", "t0", "z")]
    path = tokenizer_path("byte_bpe_50k.json")
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").repartition(8)
    nodes, ways = format_tree(table, path)
    told = nodes.select("node", "parent", "start", "stop", "position", "attend").collect()
    assert len(told) == n + 40 + 1
    by = {bytes(r["node"]): r for r in told}
    chain = {None: []}
    for r in sorted(told, key=lambda r: (r["position"], r["start"])):  # parents before children
        above = chain[r["parent"] and bytes(r["parent"])]
        assert [(s["start"], s["stop"]) for s in r["attend"]] == above and r["position"] == sum(y - x for x, y in above)
        spans = above[:-1] + [(above[-1][0], r["stop"])] if above and above[-1][1] == r["start"] else [*above, (r["start"], r["stop"])]
        chain[bytes(r["node"])] = spans
    assert len(by) == len(told)
    back = {r["conv_id"]: r for r in read_back(nodes, ways, path).collect()}
    for conv in (1, 2, 3):
        said = "".join(f"{r}\n{x}\n" for c, _, r, x, _ in rows if c == conv)
        assert back[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_tree_on_an_empty_table(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    nodes, ways = format_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path)
    assert nodes.count() == ways.count() == 0 and read_back(nodes, ways, path).count() == 0


def test_secrets(docs_of):
    key = "9f" * 20
    rows = [(1, f'token = "{key}" and AKIA{"A1" * 10}'), (2, None), (3, "plain prose only"), (4, "see mail7.example.com now"), (5, "é" + key)]
    docs = docs_of(rows)
    model = secrets.train(*[np.array(x) if k else np.stack(x) for k, x in enumerate(secrets._made_up(1200, 1))])
    got = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 1)
    assert got[1]["spans"].split(",")[:2] == ["assign:0:49", "hex:9:49"] and got[5]["spans"] == "hex:1:41"
    assert got[2]["spans"] == got[3]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    views, labels = secrets._made_up(1000, 99)
    chance, labels = model.chances(np.stack(views)), np.array(labels)
    assert (chance[labels == 1] >= model.threshold).mean() > 0.93 and (chance[labels == 0] >= model.threshold).mean() < 0.1


def _plain_base(text):
    """The fixed patterns by hand, character by character."""
    words = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    low = "".join(c.lower() if c < "\x80" else c for c in text)
    alnum = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    run = lambda i, allowed: next((j for j in range(i, len(text)) if text[j] not in allowed), len(text))
    found, at = [], 0
    while at < len(text):
        stop = None
        for w in words:
            if low.startswith(w, at):
                i = at + len(w)
                i += text[i : i + 1] in ("'", '"')
                i = run(i, " ")
                if text[i : i + 1] in (":", "=") and text[i : i + 1]:
                    i = run(i + 1, " ")
                    i += text[i : i + 1] in ("'", '"')
                    end = run(i, alnum | set("+/_.=-"))
                    if end > i:
                        stop = (i, end)
        if stop:
            if stop[1] - stop[0] >= 6:
                found.append((at, "assign", stop[1]))
            at = stop[1]
        else:
            at += 1
    for kind, head, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), allowed) if text.startswith(head, at) else at
            if end > at + len(head):
                found += [(at, kind, end)] * (end - at >= least)
                at = end
            else:
                at += 1
    return sorted(found)


def test_base_spans_match_a_plain_scan():
    rng = np.random.default_rng(3)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "api__key", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "ff09", "é", "\n", "x", "abc.def", "tok", "ſecret", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(bits, int(rng.integers(1, 14))))
        assert sorted(secrets.base_spans(text)) == _plain_base(text), text


def test_candidates_judged_in_slices_and_touching_spans(docs_of, monkeypatch):
    """Slices and bisection change nothing; a token of 200,000 characters, empty tables, null ids and repeated rows are taken."""
    model = secrets.train(*[np.array(x) if k else np.stack(x) for k, x in enumerate(secrets._made_up(1200, 1))])
    rng = np.random.default_rng(5)
    signs = list("abcXYZ019/.=-_ ") + ["token=", " pwd: ", "AKIA", "deadbeef0123456789abcdef"]
    texts = ["".join(rng.choice(signs, 400)) for _ in range(12)] + ["a1" * 100_000]
    base = [secrets.base_spans(t) for t in texts]
    want = {}
    for k, t in enumerate(texts):
        keyed = secrets.keyed_spans(t)
        for s, e in secrets.candidates(t, keyed):
            near = [(a, z) for a, _, z in base[k] if a < e and s < z]
            assert sorted(secrets.Spans(base[k]).touching(s, e)) == sorted(near)
            if not near:
                want[k, s, e] = model.chances(np.stack([secrets.view(t, x, y, x in keyed) for x, y in secrets.places(t, s, e, keyed)])).max()
    for size in (7, 4096):
        monkeypatch.setattr(secrets, "SLICE", size)
        got = dict(secrets.judged(model, secrets._asked(texts[: 12 if size == 7 else 13], base)))
        assert all(abs(got[c] - want[c]) < 1e-5 for c in got) and set(got) == {c for c in want if c[0] < (12 if size == 7 else 13)}
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (4, "")]
    found = secrets.scan(docs_of(rows), model).collect()
    assert len(found) == 4 and len({r["spans"] for r in found if r["doc_id"] == 1}) == 1
    assert secrets.scan(docs_of(rows).limit(0), model).count() == 0


def test_secrets_behind_long_beginnings_and_short_ones_after_a_word(docs_of):
    key, mixed = "Zk4vQ8xT2mB7nR1wY6cJ9pLd", "qT7xKp2ZrW9v"
    keys = [
        f"hooks.host.example/services/T00000000/B00000000/{key}", "service_of_the_northern_branch_office_and_more_" + key,
        "alpha.beta.gamma.delta.epsilon.zeta.eta.theta.iota2=" + key, "a/long/way/to/the/place/where/nothing/else/is/kept/v2/" + key,
    ]
    rows = [(k, f"see {t} there") for k, t in enumerate(keys)]
    rows += [(10, f"the pwd: {mixed} was set"), (11, "pwd: kTqZwPxRvBnM today"), (12, "Authorization: Bearer " + mixed)]
    rows += [(20, "the key: remember this"), (21, "a/long/way/to/the/place/where/nothing/else/is/kept/page2.html")]
    views, labels = secrets._made_up(6000, 40)
    model = secrets.train(np.stack(views), np.array(labels))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(rows), model).collect()}
    assert [got[k] for k in range(4)] == [f"model:4:{4 + len(t)}" for t in keys]
    assert got[10] == "model:9:21" and got[11] == "model:5:17" and got[12] == "model:22:34"
    assert got[20] == got[21] == ""


def test_mixing(docs_of):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), ("a", "b", "c", None)[0 if i % 3 else i % 4]) for i in range(600)] + [(600, None, "z")]
    out = mix(docs_of(rows)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mix(docs_of(rows)).collect()), key=repr)
    size, taken, target, most = Counter(), Counter(), {}, Counter()
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left = {s: 1 + k % 3 for k, s in enumerate(order)}, float(sum(size.values()))
    want, free = {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        cut = [s for s in free if level * weight[s] > 3 * size[s]]
        want |= {s: 3.0 * size[s] for s in cut} or {s: level * weight[s] for s in free}
        left -= sum(3 * size[s] for s in cut)
        free = free - set(cut) if cut else set()
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= most[s]


def test_packing(docs_of):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = ROWS + [(20, "It's <|endoftext|> ǅ İ n° 12½ don't\tÉcole é ﬁ"), (21, "x y z")]
    out = packing.pack(packing.token_pieces(docs_of(rows), path, length=512), capacity=512).collect()
    texts = defaultdict(list)
    for i, x, *_ in rows:
        texts[i].append(x or "")
    seen = defaultdict(list)
    for r in out:
        ids = t.encode(texts[r["doc_id"]][0], add_special_tokens=False).ids + [1]
        part = ids[r["start"] : r["start"] + 512]
        assert list(r["ids"]) == part and r["length"] == len(part) and r["start"] == 512 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seen.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 512


def test_full_pieces_meet_no_packing_group(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 100 = 0, 3L, 8L) AS length")
    packed = packing.pack(pieces.repartition(5), capacity=8, group=10)
    rows = packed.collect()
    full = [r for r in rows if r["length"] == 8]
    assert len(rows) == 3000 and len(full) == 2970 and {r["offset"] for r in full} == {0}
    assert len({r["sequence_id"] for r in full}) == 2970 and not {r["sequence_id"] for r in full} & {r["sequence_id"] for r in rows if r["length"] < 8}
    assert {r["doc_id"] for r in rows if r["sequence_id"] < 0} == {r["doc_id"] for r in full}


def test_best_fit_takes_the_tightest_bin():
    lengths = np.array([6, 5, 4, 3, 2, 2])
    bins, offsets = packing.best_fit_decreasing(lengths, 10)
    assert bins.tolist() == [0, 1, 0, 1, 1, 2] and offsets.tolist() == [0, 0, 6, 5, 8, 0]


def test_near_groups(docs_of):
    words = [f"w{k}" for k in range(120)]
    rows = [(10, " ".join(words)), (4, " ".join(words[:115])), (12, " ".join(words[4:])), (30, "x y"), (31, "X  y"), (32, None), (33, "  "), (None, " ".join(words) + " more")]
    rows += [(100 + i, " ".join(f"v{i}_{k}" for k in range(40))) for i in range(20)] + [(4, " ".join(words[:115]))]
    got = near_groups(docs_of(rows)).collect()
    sets = []
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    comp = {k: {k} for k in range(len(rows))}
    for k in comp:
        todo = [k]
        while todo:
            at = todo.pop()
            new = {j for j in range(len(rows)) if j not in comp[k] and linked(sets[at], sets[j])}
            comp[k] |= new
            todo += new
    want = sorted(((rows[k][0], len(sets[k]), min((rows[j][0] for j in comp[k] if rows[j][0] is not None), default=None)) for k in comp), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def test_tree_overlaps_equals_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))).astype(np.int64) for _ in range(80)]
    for probe in sets[:20]:
        want = {k: len(np.intersect1d(probe, s)) for k, s in enumerate(sets)}
        want = {k: n for k, n in want.items() if 100 * n >= 60 * (len(probe) + len(sets[k]) - n)}
        assert tree_overlaps(probe, sets, 60) == want


def test_repeats_match_brute_force(docs_of):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdé"), 5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(40)) + passage[: 150 + 40 * i] + word()) for i in range(6)]
    rows += [(10, "ab" * 300), (11, None), (12, "short"), (13, passage), (13, passage), (None, "z" * 199)]
    raw = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(d[k : k + 200] for _, d in raw for k in range(len(d) - 199))
    want = []
    for i, d in raw:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 199):
            if starts[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        want.append((i, len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in remove_repeats(docs_of(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = apply_quality(docs, fit_quality(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = scored.select("quality", "quality_keep").collect()
    keep = Counter((r["quality"], r["quality_keep"]) for r in rows)
    assert keep[1, True] >= 0.99 * (keep[1, True] + keep[1, False])
    assert keep[0, False] >= 0.9 * (keep[0, True] + keep[0, False])


def test_quality_threshold_is_not_set_by_one_odd_document():
    good, bad = np.zeros(200), np.zeros(200)
    bad[20:80], good[120:180] = 50.0, 100.0
    assert threshold_step(good, bad, 0.001) == 120
    good[5] = 1.0  # alone in its bin, below all poor documents
    assert threshold_step(good, bad, 0.001) == 120
    good[5], good[60:80] = 0.0, 60.0  # mostly good from here: poor ones among them stay
    assert threshold_step(good, bad, 0.5) == 60
    assert threshold_step(good, bad, 0.0) == 60 and threshold_step(good, np.zeros(200), 0.001) == 60


def test_quality_on_nothing_and_nulls(docs_of):
    model = fit_quality(docs_of([]))
    assert apply_quality(docs_of([]), model).count() == 0
    assert all(r["quality_keep"] for r in apply_quality(docs_of([(1, None), (2, ""), (3, " ")]), model).collect())


def test_pipeline_matches_plain_python(docs_of, spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    prose = [" ".join("the of and river house walks slowly under green old tree because people there".split()[k] for k in rng.integers(0, 14, 60)) for _ in range(12)]
    rows = [(i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(prose)]
    rows += [(20, prose[0], "a"), (21, prose[1].replace(" ", "  "), "b"), (2, prose[2], None), (22, prose[3] + " again", "a"), (23, None, "a"), (24, "", "b"), (None, prose[4] + " more", "b")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        tables[name] = docs.collect()
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    kept = [key(r) for r in tables["quality classifier"]]
    given = docs_of(rows)
    want = [key(r) for r in apply_quality(given, fit_quality(given)).filter("quality_keep").collect()]
    assert Counter(kept) == Counter(want) and len(kept) >= 10
    ids = lambda r: (r[0] is None, r[0] or 0)
    firsts = {}
    for r in kept:
        firsts[clean(r[1])] = min(firsts.get(clean(r[1]), r), r, key=ids)
    exact = [key(r) for r in tables["exact dedup"]]
    assert Counter(r[0] for r in exact) == Counter(r[0] for r in firsts.values()) and {clean(r[1]) for r in exact} == set(firsts)
    sets = []
    for r in exact:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(exact)))
    for _ in exact:
        for p, a in enumerate(sets):
            for q, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[p] = group[q] = min(group[p], group[q])
    near = [min((r for r, g in zip(exact, group) if g == h), key=ids) for h in set(group)]
    assert Counter(key(r) for r in tables["n-gram Jaccard join"]) == Counter(near) and len(near) < len(exact)
    takes = mix(spark.read.parquet(str(tmp_path / "n-gram_Jaccard_join"))).collect()
    copies = Counter()
    for r in takes:
        copies[r["doc_id"]] += r["copies"]
    mixed = [key(r) for r in tables["mixing sources"]]
    assert Counter(mixed) == Counter({r: copies[r[0]] for r in near if copies[r[0]]})
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, _ in mixed:
        ids_of = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, k, 4096 * k, len(ids_of[4096 * k : 4096 * (k + 1)])) for k in range(-(-len(ids_of) // 4096)))
    place = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"])
    assert Counter(map(place, tables["best-fit packing"])) == want
    assert Counter(map(place, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("run", [exact_dedup, fingerprint_with_edits, line_dedup, mix, near_groups, remove_repeats])
def test_empty_tables(docs_of, run):
    assert run(docs_of([])).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    signs = " \n\t\r'stdmrelv09aZé<|>endoftext́İßẞàÀ漢²\x1c\xa0—ñ.,!"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["", "a<|endoftext|>b c", "<|startoftext|> x <|endoftext|>", "É's " * 5, "x" * 30_000, "漢" * 5000, "né" * 3000 + "\n" + LONG]
    for name in ("word_bpe_49k", "byte_bpe_50k"):
        path = tokenizer_path().replace("word_bpe_49k", name)
        encoder, library = packing.WordEncoder(path, remembered=50), Tokenizer.from_file(path)
        assert encoder.by_parts == (name == "word_bpe_49k")
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            got = [list(np.frombuffer(b, "<u4")) for b in encoder.encode(some)]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_line_dedup_keeps_one_of_repeated_rows(docs_of):
    menu = "Menu\n\nAll rights reserved."
    got = line_dedup(docs_of([(None, "a\nb"), (None, "a\nb"), (3, menu), (3, menu), (4, menu)])).collect()
    assert sorted((str(r["doc_id"]), r["n_dropped"], r["dropped"]) for r in got) == [
        ("3", 0, ""), ("3", 2, "0,2"), ("4", 2, "0,2"), ("None", 0, ""), ("None", 2, "0,1"),
    ]


def test_summed_vectors(spark):
    rows = [(k, np.array([k, i, 4_000_000_000], "<u4").tobytes()) for i in range(40) for k in (1, 5)]
    df = spark.createDataFrame(rows, "k int, v binary").repartition(20)
    got = summed_vectors(df, "<u4", "<i8", (7, 3))
    assert {k: v.tolist() for k, v in got.items()} == {k: [40 * k, 780, 160_000_000_000] for k in (1, 5)}
    assert summed_vectors(df.limit(0), "<u4", "<i8") == {}


def test_stages_called_before_any_is_read(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"{LONG} {i % 3}", "s") for i in range(9)])
    first = corpus_pipeline.exact(spark, docs, str(tmp_path))
    second = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert first.count() == 3 and second.count() == 1
    with tables_of([]) as outer:
        with tables_of([]) as inner:
            stage(docs)
    assert outer == inner and len(inner) == 1
