"""Tokenise documents and pack them into fixed-length sequences by best-fit decreasing."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import short_batches, stage, text_of

#: Pieces per packing task; a constant, so the number of tasks grows with the corpus.
GROUP = 20_000
#: Words, and parts of words, whose ids a Python worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 400_000
#: Characters of the longest word or part that is remembered.
LONGEST_REMEMBERED = 64


class PartIds(dict):
    """Ids of the parts that a model has split already; unknown parts are split, and short ones remembered."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, part: str) -> bytes:
        ids = self.split(part)
        if len(part) <= LONGEST_REMEMBERED:
            self[part] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts; ids are bytes, 4 to a token, little-endian.

    A tokenizer file whose normaliser and pre-tokenizer are ``NORMALIZER`` and ``PRE_TOKENIZER`` treats each part that
    its pattern finds alone and drops white space. There, words of plain letters are cut
    into parts here, and each distinct part is split by the model once and remembered; every other word goes through the
    library. With any other file whole texts go through the library.
    """

    # What the tokenizer file states, and the letters whose lower case and composition all libraries agree on.
    NORMALIZER = {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    }
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
    LETTERS = "àâäçéèêëîïíñóôöùûüúáß"
    UPPER = "ÀÂÄÇÉÈÊËÎÏÍÑÓÔÖÙÛÜÚÁ"
    PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^ a-z{LETTERS}0-9]+")
    ODD = rf"[^ !-~{UPPER}{LETTERS}]"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.by_parts = spec["normalizer"] == self.NORMALIZER and spec["pre_tokenizer"] == self.PRE_TOKENIZER and not spec["model"].get("dropout")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_parts = self.by_parts and not any(re.search(r"\s", s) for s in self.specials)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in self.LETTERS})
        self.odd = re.compile(self.ODD)
        self.odd_or_special = re.compile("|".join([self.ODD, *map(re.escape, self.specials)]))
        self.model = self.tokenizer.model
        self.parts = PartIds(self._split)
        self.words: dict[str, bytes] = {}
        self.remembered = remembered

    def _split(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.spell))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _stretches(self, text: str) -> list[tuple[bool, str]]:
        """The text, spaces for line ends, as (is odd, stretch): odd words stand alone, stretches between them are plain."""
        odd = self.odd_or_special if any(s in text for s in self.specials) else self.odd
        out, at = [], 0
        while hit := odd.search(text, at):
            start = max(text.rfind(" ", at, hit.start()) + 1, at)
            end = text.find(" ", hit.start())
            end = len(text) if end < 0 else end
            if start > at:
                out.append((False, text[at:start]))
            out.append((True, text[start:end]))
            at = end
        if at < len(text):
            out.append((False, text[at:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return self._library(texts)
        cut = [self._stretches(t.replace("\n", " ")) for t in texts]
        odd = {w for stretches in cut for is_odd, w in stretches if is_odd}
        new = list(odd.difference(self.words))
        self.words.update(zip(new, self._library(new)))
        out = [b"".join(self.words[w] if is_odd else self._plain(w) for is_odd, w in stretches) for stretches in cut]
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del self.words[w]
        for memory in (self.words, self.parts):
            if len(memory) > self.remembered:
                memory.clear()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """The worker's own encoder, kept for its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on wish, ``ids`` (array of int) of every piece.

    A document's tokens are its ids and then ``end_id``; only a longer document is cut, every
    ``length`` tokens. A null or empty text is the end token alone. Repeated rows
    give repeated pieces.
    """
    fields = "doc_id long, row int, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for n, (doc, ids) in enumerate(zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("_text").to_pylist()))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, n, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            names = [f.split()[0] for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).mapInArrow(cut, fields).drop("row")


class OpenBins:
    """Open sequences by room left; ``tightest(n)`` finds the smallest room of at least ``n`` in logarithmic time.

    A segment tree over the capacities 0..capacity counts the open bins of each room.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_id: int) -> None:
        self.bins.setdefault(room, []).append(bin_id)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the bin with the least room that holds ``need``: (room, bin)."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length; longest first, each into the tightest open bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.tightest(n)
        if found is None:
            found, used = (capacity, used), used + 1
        room, b = found
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            tree.add(room - n, b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Pieces shorter than ``capacity`` are dealt at random (by a hash of their row number) into groups of about
    ``group``, and every group is packed by its own task; take a smaller group if the
    pieces carry their ids. A full piece is a sequence of its own and meets no group: its id is
    -1 minus its row number, where those of the groups are 0 and more. A group leaves one or two sequences with more room
    than the rest, so the loss is about one sequence in several thousand.
    """
    kept, _ = stage(pieces)
    groups = max(1, -(-kept.filter(F.col("length") < capacity).count() // group))
    # The staged files fix every row's number, so a repeated task deals as the first one did.
    numbered = kept.withColumn("_n", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") >= capacity).select(*kept.columns, F.lit(0).cast("long").alias("offset"), (-1 - F.col("_n")).alias("sequence_id"))
    dealt = numbered.filter(F.col("length") < capacity).withColumn("_g", F.pmod(F.xxhash64("_n"), F.lit(groups))).drop("_n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", _g long, _bin long, offset long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in ("doc_id", "piece", "start") if c in pdf], kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.assign(_bin=bins, offset=offsets)

    packed = dealt.groupBy("_g").applyInPandas(fill, schema)
    return packed.withColumn("sequence_id", F.col("_bin") * F.lit(groups) + F.col("_g")).drop("_g", "_bin").unionByName(full)
