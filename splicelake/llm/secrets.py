"""Secret scan: fixed patterns and a character convolutional network over every candidate.

Candidates are tokens of at least ``MIN_TOKEN`` characters with a letter and a digit, and after a word that
speaks for a secret (``CONTEXT``) all tokens of at least ``MIN_KEYED``. The network sees a candidate with the
characters around it, a long one in overlapping views over its whole length and its parts between / . = - once
more; the largest score counts, and the span is the whole candidate's. It is trained on labelled findings: candidates
of a bounded sample of documents, labelled by the fixed patterns, and made-up keys and
harmless tokens of many shapes. Scores are calibrated on held-out findings, and the threshold is
the largest that keeps ``RECALL`` of the held-out secrets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import short_batches, text_of

KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]*")

#: Before a token, these speak for a secret whatever its length and characters.
CONTEXT = re.compile(
    r"""(?:(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|credentials?|auth(?:orization)?|key|login)["']?\x20*[:=]\x20*["']?(?:(?:bearer|basic)\x20+)?|bearer\x20+)([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)
PARTS = re.compile(r"[^/.=-]+")

#: Least characters of a token, and of one after ``CONTEXT`` (as for the fixed pattern).
MIN_TOKEN, MIN_KEYED = 16, 6
#: The network's view: characters before the candidate, of it, and after it.
BEFORE, INSIDE, AFTER = 16, 40, 4
#: From one view of a long candidate to the next.
STEP = 20
VIEW = BEFORE + INSIDE + AFTER
#: Views judged at a time.
SLICE = 4096
FILTERS, WIDTH = 16, 5
#: Bounds of the training set: documents sampled, findings of either label kept, made-up ones added.
TRAIN_DOCUMENTS, TRAIN_FINDINGS, MADE_UP = 20_000, 1_500, 6_000
RECALL = 0.98

# Character classes of the network: digits, hex letters, other letters by case, each sign, space, beyond ASCII, padding.
_CLASS = {**{c: 1 for c in "0123456789"}, **{c: 2 for c in "abcdef"}, **{c: 3 for c in "ABCDEF"}}
_CLASS |= {c: 4 for c in "ghijklmnopqrstuvwxyz"} | {c: 5 for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: 6 for c in " \t\n"}
_CLASS |= {c: 7 + k for k, c in enumerate("+/_=.-:\"'")}
KEYED = 18  # in place of the three characters before a token after CONTEXT
SYMBOLS = 19  # 0 padding, 16 other ASCII, 17 beyond ASCII


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def keyed_spans(text: str) -> dict[int, int]:
    """Start and end of the tokens after a word that speaks for a secret."""
    return {m.start(1): m.end(1) for m in CONTEXT.finditer(text) if m.end(1) - m.start(1) >= MIN_KEYED}


def candidates(text: str, keyed: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit and a letter and at least ``MIN_TOKEN`` characters, and the keyed ones outside these."""
    at, taken = 0, []
    while m := DIGIT.search(text, at):
        start = m.start()
        while start > at and TOKEN.fullmatch(text[start - 1]) and text[start - 1]:
            start -= 1
        end = at = TOKEN.match(text, m.start()).end()
        if end - start >= MIN_TOKEN and not text[start:end].isdigit():
            taken.append((start, end))
            yield start, end
    inside = 0
    for start, end in sorted(keyed.items()):
        while inside < len(taken) and taken[inside][1] <= start:
            inside += 1
        if inside == len(taken) or end <= taken[inside][0]:
            yield start, end


def places(text: str, start: int, end: int, keyed: dict[int, int]) -> list[tuple[int, int]]:
    """What the network judges of a candidate: views over its whole length, its long parts, and keyed tokens in it."""
    whole = [(start, end)] + [(p.start(), p.end()) for p in PARTS.finditer(text, start, end) if p.end() - p.start() >= MIN_TOKEN]
    whole += [(at, keyed[at]) for at in range(start + 1, end) if at in keyed] if keyed else []
    out = []
    for s, e in whole:
        last = max(s, e - INSIDE)
        out += [(at, min(at + INSIDE, e)) for at in (*range(s, last, STEP), last)]
    return list(dict.fromkeys(out))


def view(text: str, start: int, end: int, keyed: bool = False) -> np.ndarray:
    """The classes of the characters that the network sees of at most ``INSIDE`` characters and around them."""
    shown = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    shown += text[end : end + AFTER].ljust(AFTER, "\0")
    out = np.array([0 if c == "\0" else _CLASS.get(c, 16 if c < "\x80" else 17) for c in shown], np.int64)
    if keyed:
        out[BEFORE - 3 : BEFORE] = KEYED
    return out


@dataclass
class SecretModel:
    filters: np.ndarray  # (WIDTH * SYMBOLS) x FILTERS
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def hidden(self, views: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one_hot = np.eye(SYMBOLS, dtype=np.float32)[views]
        columns = np.concatenate([one_hot[:, k : VIEW - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)
        active = np.maximum(columns @ self.filters + self.filter_bias, 0)
        where = active.argmax(1)
        return columns, where, np.take_along_axis(active, where[:, None], 1)[:, 0]

    def logits(self, views: np.ndarray) -> np.ndarray:
        out = [self.hidden(views[i : i + 512])[2] @ self.weights + self.bias for i in range(0, len(views), 512)]
        return np.concatenate(out) if out else np.empty(0)

    def chances(self, views: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(views) + self.shift, -30, 30)))


def _made_up(n: int, seed: int) -> tuple[list[np.ndarray], list[int]]:
    """Views of keys of many shapes in contexts of many kinds, some behind long names and paths or short, and of harmless tokens."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: pick("aeiou", 1) + pick(lower, int(rng.integers(2, 7)))
    views, labels, turn = [], [], 0
    names = lambda sign: sign.join(word() for _ in range(int(rng.integers(3, 16))))
    contexts = ("pwd", "pass", "password", "passphrase", "secret", "token", "auth", "key", "login")
    while len(views) < n:
        size, secret, kind = int(rng.integers(20, 64)), turn % 2, int(rng.integers(6))
        turn += 1
        if secret:
            shapes = (
                pick(hexa, size), pick(hexa, size).upper(), pick(lower + upper + digits, size), pick(lower + upper + digits + "+/", size) + "=" * int(rng.integers(0, 3)),
                pick(upper + digits, size), "sk_live_" + pick(lower + upper + digits, size), "ghp_" + pick(lower + upper + digits, 36), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
            )
            lead = ("", "key ", "Bearer ", "auth: ", "api = \"", word() + " ", word() + "=", "'", "(")
        else:
            shapes = (
                f"mail{pick(digits, 1)}.{word()}.com", f"{word()}-{word()}-{pick(digits, 4)}.html", ".".join(word() for _ in range(3)) + pick(digits, 2),
                f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}", f"{word()}_{word()}_{word()}{pick(digits, 1)}", f"www.{word()}{pick(digits, 2)}.org/{word()}/{word()}",
                f"{word()}{word()}{word()}{word()}{pick(digits, 2)}", f"{word()}/{word()}/{word()}{pick(digits, 3)}.txt", f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 3)}-{word()}.{pick(digits, 4)}",
            )
            lead = ("", word() + " ", word() + ", ", "see ", "https:", "(", word() + "@", word() + ".")
        token = shapes[int(rng.integers(len(shapes)))]
        before, prefix = f"{word()} {word()} " + lead[int(rng.integers(len(lead)))], ""
        if kind == 0:  # after a word that speaks for a secret, and short
            k = int(rng.integers(6, 16))
            short = (pick(lower + upper + digits, k), word() + pick(digits, int(rng.integers(1, 5))), pick(lower + upper, k), pick(digits, k))
            token = short[int(rng.integers(4))] if secret else (word(), word() + word(), word() + "-" + word(), word() + "." + word())[int(rng.integers(4))]
            before = f"{word()} {contexts[int(rng.integers(len(contexts)))]}" + str(rng.choice([": ", "=", " = ", ":", ' = "']))
            if len(token) < MIN_KEYED:
                token += pick(digits, MIN_KEYED) if secret else word() + "able"
        elif kind == 1:  # behind a long name or path
            prefix = (f"{names('.')}/{word()}/T{pick(digits, 8)}/B{pick(digits, 8)}/", names("_") + "_", names("/") + "/", names(".") + ".", names("-") + "=")[int(rng.integers(5))]
        start, key = len(before), len(before) + len(prefix)
        end = key + len(token)
        text = before + prefix + token + str(rng.choice(["", " ", ".", '"', "\n"])) + word()
        keyed = keyed_spans(text)
        for s, e in places(text, start, end, keyed):
            shared = e - max(s, key)
            if not secret or shared <= 0 or shared >= min(MIN_TOKEN, end - key):  # neither one nor the other: left out
                views.append(view(text, s, e, s in keyed))
                labels.append(int(secret and shared > 0))
    return views, labels


def train(views: np.ndarray, labels: np.ndarray, rounds: int = 6, seed: int = 4) -> SecretModel:
    """Fit by Adam, calibrate on the held-out fifth, and set the threshold that keeps ``RECALL`` of its secrets."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(views))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    m = SecretModel((rng.normal(size=(WIDTH * SYMBOLS, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.normal(size=FILTERS) * 0.3).astype(np.float32), 0.0)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.filters, m.filter_bias, m.weights, np.zeros(1))]
    step = 0
    for _ in range(rounds):
        for at in range(0, len(used), 128):
            rows = used[at : at + 128] if at else rng.permutation(used)[:128]
            columns, where, top = m.hidden(views[rows])
            p = 1 / (1 + np.exp(-np.clip(top @ m.weights + m.bias, -30, 30)))
            error = (p - labels[rows]) / len(rows)
            back = np.where(top > 0, error[:, None] * m.weights, 0).astype(np.float32)
            picked = columns[np.arange(len(rows))[:, None], where]  # rows x filters x inputs
            grads = (np.einsum("rfi,rf->if", picked, back), back.sum(0), top.T @ error, np.array([error.sum()]))
            step += 1
            for k, g in enumerate(grads):
                s = state[k]
                s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
                change = 0.01 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    m.filters = m.filters - change.astype(np.float32)
                elif k == 1:
                    m.filter_bias = m.filter_bias - change.astype(np.float32)
                elif k == 2:
                    m.weights = m.weights - change.astype(np.float32)
                else:
                    m.bias -= float(change[0])
    raw, y = m.logits(views[held]), labels[held].astype(float)
    for _ in range(300):  # calibration: a line through the logits, damped
        p = 1 / (1 + np.exp(-np.clip(m.scale * raw + m.shift, -30, 30)))
        m.scale -= 0.05 * float(((p - y) * raw).mean() + 0.01 * (m.scale - 1))
        m.shift -= 0.05 * float((p - y).mean())
    secrets = np.sort(m.chances(views[held][y == 1]))
    m.threshold = float(secrets[int((1 - RECALL) * len(secrets))]) if len(secrets) else 0.5
    return m


class Spans:
    """Findings by start; those that touch a range are found by bisection."""

    def __init__(self, found: list[tuple[int, str, int]]):
        self.spans = sorted((a, z) for a, _, z in found)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(accumulate((z for _, z in self.spans), max))

    def touching(self, start: int, end: int) -> list[tuple[int, int]]:
        return [(a, z) for a, z in self.spans[bisect_right(self.reach, start) : bisect_left(self.starts, end)] if z > start]


def _asked(texts: list[str], per_text: list[list[tuple[int, str, int]]]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """The views of every candidate that touches no finding, one after the other."""
    for k, text in enumerate(texts):
        keyed, spans = keyed_spans(text), Spans(per_text[k])
        for s, e in candidates(text, keyed):
            if not spans.touching(s, e):
                for x, y in places(text, s, e, keyed):
                    yield (k, s, e), view(text, x, y, x in keyed).astype(np.int8)


def judged(model: SecretModel, asked: Iterator[tuple[tuple[int, int, int], np.ndarray]]) -> Iterator[tuple[tuple[int, int, int], float]]:
    """Each candidate with its largest chance. A candidate's views follow one another; ``SLICE`` views are held at a time."""
    last, best = None, 0.0
    while held := list(islice(asked, SLICE)):
        for name, p in zip((n for n, _ in held), model.chances(np.stack([v for _, v in held])).tolist()):
            if name != last:
                if last is not None:
                    yield last, best
                last, best = name, p
            best = max(best, p)
    if last is not None:
        yield last, best


def fit_secrets(docs: DataFrame) -> SecretModel:
    """Train on at most ``TRAIN_FINDINGS`` findings of either label from about ``TRAIN_DOCUMENTS`` documents."""
    short_batches(docs.sparkSession)
    rows = docs.count()
    sampled = docs.filter(F.pmod(F.xxhash64(F.lit(4), text_of()), F.lit(max(1, rows // TRAIN_DOCUMENTS))) == 0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views, labels = [], []
            for text in b.column(0).to_pylist():
                base, keyed = base_spans(text), keyed_spans(text)
                spans = Spans(base)
                for start, end in candidates(text, keyed):
                    near = spans.touching(start, end)
                    for s, e in places(text, start, end, keyed):
                        shared = max((min(e, z) - max(s, a) for a, z in near), default=0)
                        # The patterns say nothing about a view with less of a finding, nor about other keyed tokens.
                        if shared >= min(MIN_TOKEN, e - s) or shared <= 0 and s not in keyed:
                            views.append(view(text, s, e, s in keyed).astype(np.int8).tobytes())
                            labels.append(shared > 0)
            yield pa.RecordBatch.from_arrays([pa.array(views, pa.binary()), pa.array(labels, pa.bool_())], names=["view", "secret"])

    found = sampled.select(text_of()).mapInArrow(look, "view binary, secret boolean").distinct()
    views, labels = _made_up(MADE_UP, 40)
    for secret in (True, False):
        for r in found.filter(F.col("secret") == secret).orderBy(F.xxhash64("view")).limit(TRAIN_FINDINGS).collect():
            views.append(np.frombuffer(r["view"], np.int8).astype(np.int64))
            labels.append(int(secret))
    return train(np.stack(views), np.array(labels))


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then kind. The
    spans of the fixed patterns always stay; the network adds candidates of at least its threshold that
    touch none of them. Null text: empty, no spans. Ids are handed through, repeated rows are
    scanned alike; an empty table gives an empty result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("_text").to_pylist()
            per_text = [base_spans(t) for t in texts]
            all_spans = [list(x) for x in per_text]
            for (k, s, e), p in judged(m, _asked(texts, per_text)):
                if p >= m.threshold:
                    all_spans[k].append((s, "model", e))
            said = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))
            count = lambda kind: pa.array([sum(x[1] == kind for x in spans) for spans in all_spans], pa.int64())
            arrays = [
                b.column("doc_id"), count("assign"), count("access"), count("hex"),
                pa.array([hashlib.sha256(said(x).encode()).hexdigest() for x in per_text], pa.string()),
                pa.array([said(x) for x in all_spans], pa.string()), count("model"),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(look, schema)
