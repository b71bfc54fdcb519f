"""Conversations as a prefix tree: shared first turns are emitted once, depth-first.

A node is a distinct beginning of a conversation. Conversations are sorted by the nodes on their
way, which is depth-first order: a node is emitted with the first conversation that reaches it. Parts are
cut by the first ``SPLITTER_DEPTH`` nodes and then by a hash of the last, so where conversations share more and fill
several parts the order below is not depth-first; ancestors still come first, and intervals are right but more. Each
node has its tokens, its place in the output, the position of its first token (the tokens
of its ancestors), and the intervals of the output that its tokens may attend to besides their
own node: its ancestors, neighbouring ones joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import short_batches, stage, text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Nodes of a conversation that take part in the sampled splitters.
SPLITTER_DEPTH = 16
#: Intervals handed back by a worker at once.
WAY_ROWS = 10_000
_ATTEND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def escaped(text: str) -> str:
    """No control string can occur in the result: a bar after "<" gets a backslash between."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and behind the text of a formatted turn; the text part alone may be learned."""
    return f"{OPEN}{escaped_role(role)}\n", escaped(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, text = piece.partition("\n")
        turns.append((unescaped_role(role), unescaped(text[: -len(CLOSE)])))
    return turns


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation and name each beginning by a hash of all its turns."""
    last, order, node = object(), 0, b""
    for b in batches:
        rows = []
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv != last:
                last, order, node = conv, 0, b""
            parent, order = node, order + 1
            digest = hashlib.sha256(parent)
            for x in (role, text):
                raw = x.encode()
                digest.update(len(raw).to_bytes(8, "big") + raw)
            node = digest.digest()[:16]
            rows.append((conv, order, node, parent or None, role, text))
        cols = zip(*rows) if rows else [[]] * 6
        kinds = (b.schema.field("conv_id").type, pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string())
        names = ("conv_id", "depth", "node", "parent", "role", "text")
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def _tokenised(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for b in batches:
            pieces = [p for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist()) for p in parts_of(r, t)]
            ids = [e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
            heads, bodies, tails = ids[::3], ids[1::3], ids[2::3]
            arrays = [
                *(b.column(c) for c in ("node", "parent", "depth", "role")),
                pa.array([h + x + t for h, x, t in zip(heads, bodies, tails)], pa.list_(pa.int32())),
                pa.array([len(h) for h in heads], pa.int32()),
                pa.array([len(h) + len(x) for h, x in zip(heads, bodies)], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "parent", "depth", "role", "tokens", "text_from", "text_to"])

    return encode


def _attended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One walk down each way: the intervals before every node that the way emits, neighbouring ones joined."""
    for b in batches:
        for way in b.column("way"):
            spans: list[tuple[int, int]] = []
            nodes, attend, held = [], [], 0
            _, *fields = way.values.flatten()
            for node, start, stop, own in zip(*(f.to_pylist() for f in fields)):
                if own:
                    nodes.append(node)
                    attend.append([{"start": x, "stop": y} for x, y in spans])
                    held += len(spans) + 1
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], stop)
                else:
                    spans.append((start, stop))
                if held >= WAY_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(attend, _ATTEND)], names=["node", "attend"])
                    nodes, attend, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(attend, _ATTEND)], names=["node", "attend"])


def format_tree(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes and each conversation's way through them.

    ``turns``: ``conv_id, turn, role, text``; turns are ordered by number, then role and text; null
    role or text: empty; a null ``conv_id`` is one conversation. Equal conversations share
    all nodes. Empty input gives two empty tables; other columns are ignored.

    Nodes: ``node, parent, role, start, stop`` (place in the output), ``position`` (of the first
    token), ``attend`` (intervals of the ancestors), ``tokens``, ``loss_from, loss_to`` (token range
    under the loss mask, relative to ``start``; empty unless the role is assistant).
    Ways: ``conv_id, leaf, path`` (nodes from the root). One conversation is one row; work and memory grow in
    proportion to its turns (and to the intervals its turns have).
    """
    short_batches(turns.sparkSession)
    clean = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    chained, _ = stage(ordered.mapInArrow(_chain, f"conv_id {conv_type}, depth int, node binary, parent binary, role string, text string"))
    step = F.struct("depth", "node")
    ways = chained.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["node"]).alias("path"))
    ways, _ = stage(ways.select("conv_id", F.element_at("path", -1).alias("leaf"), "path"))

    # Depth-first: distinct ways in order; a stored part and the row in it are a way's rank.
    leaves = ways.groupBy("leaf").agg(F.first("path").alias("path"))
    order = [F.slice("path", 1, SPLITTER_DEPTH), F.col("leaf")]
    placed = leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed, _ = stage(placed)
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    reached = ranked.select("part", "nth", F.posexplode("path").alias("depth", "node"))
    first = reached.groupBy("node", "depth").agg(F.min(F.struct("part", "nth")).alias("at"))
    texts = chained.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "role", "text")])
    tokenised, _ = stage(
        texts.mapInArrow(_tokenised(tokenizer), "node binary, parent binary, depth int, role string, tokens array<int>, text_from int, text_to int")
    )
    sized = first.join(tokenised.select("node", F.size("tokens").cast("long").alias("n")), "node")
    sized = sized.select("node", "n", F.col("at.part").alias("part"), F.col("at.nth").alias("nth"), "depth")
    sized, _ = stage(sized)
    totals = sized.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("base"))  # one row per stored part
    along = Window.partitionBy("part").orderBy("nth", "depth").rowsBetween(Window.unboundedPreceding, 0)
    spots = sized.withColumn("end", F.sum("n").over(along)).join(offsets, "part")
    spots = spots.select("node", F.struct("part", "nth").alias("at"), (F.col("base") + F.col("end") - F.col("n")).alias("start"), (F.col("base") + F.col("end")).alias("stop"))
    spots, _ = stage(spots)

    # What a node attends to: the places of the nodes before it on the way that emits it.
    own = F.col("at") == F.struct("part", "nth")
    step = F.struct("depth", "node", "start", "stop", own.alias("own"))
    steps = reached.join(spots, "node").groupBy("part", "nth").agg(F.sort_array(F.collect_list(step)).alias("way"))
    attends = steps.select("way").mapInArrow(_attended, "node binary, attend array<struct<start:bigint,stop:bigint>>")
    spots = spots.drop("at")
    position = F.aggregate("attend", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    learned = F.col("role") == LEARNED
    nodes = tokenised.join(spots, "node").join(attends, "node").select(
        "node", "parent", "role", "start", "stop", position.alias("position"), "attend", "tokens",
        F.when(learned, F.col("text_from")).otherwise(0).alias("loss_from"),
        F.when(learned, F.col("text_to")).otherwise(0).alias("loss_to"),
    )
    return nodes, ways


def read_back(nodes: DataFrame, ways: DataFrame, tokenizer: str) -> DataFrame:
    """Decode every conversation from the emitted tokens and summarise it.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        text = lambda ids: t.decode(list(ids), skip_special_tokens=False)
        out = []
        for leaf, turns in zip(pdf["leaf"], pdf["turns"]):
            turns = sorted(turns, key=lambda r: r["position"])
            formatted = "".join(text(r["tokens"]) for r in turns)
            learned = "".join(unescaped(text(r["tokens"][r["loss_from"] : r["loss_to"]])) for r in turns)
            said = parse(formatted)
            whole = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
            out.append((leaf, len(said), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
        return pd.DataFrame(out, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    steps = ways.groupBy("leaf").agg(F.first("path").alias("path")).select("leaf", F.explode("path").alias("node"))
    turn = F.struct("position", "tokens", "loss_from", "loss_to")
    whole = steps.join(nodes, "node").groupBy("leaf").agg(F.collect_list(turn).alias("turns"))
    schema = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    decoded = whole.mapInPandas(lambda it: map(decode, it), schema)
    return ways.select("conv_id", "leaf").join(decoded, "leaf").drop("leaf")
