"""Token counts behind a cache of digests: a text is encoded once for each tokenizer version, ever.

The cache is a folder of Parquet files, one subfolder per tokenizer version, with a row for
each digest of a normalised text: ``digest binary, n_tokens long``. A run joins the digests of its
texts to it, encodes each missing text once, appends the new rows and reads all counts from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm.common import bounded_batches, discard, stage, text_of

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Up to so many missing digests (32 bytes each) are broadcast to keep the other texts out of the shuffle.
FEW_DIGESTS = 100_000
#: What a tokenizer treats as a blank besides the blank itself (U+2581, sentencepiece's own mark).
BLANK_MARK = "▁"


def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by the library the file belongs to, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path)
    words.no_truncation()
    words.no_padding()
    return lambda texts: [len(e.ids) for e in words.encode_batch(texts, add_special_tokens=False)]


_COUNTERS: dict[tuple[str, str], Callable[[list[str]], list[int]]] = {}


def _counter(path: str, name: str) -> Callable[[list[str]], list[int]]:
    """The worker's own counter, kept for its next tasks."""
    if (path, name) not in _COUNTERS:
        _COUNTERS[path, name] = load_counter(path)
    return _COUNTERS[path, name]


def blank_mark_is_blank(path: str) -> bool:
    """Whether the tokenizer takes U+2581 for a blank everywhere, so that texts which differ in that alone count alike."""
    if not path.endswith(".model"):
        return False
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    probes = ["a b", " a", "a ", "a  b", "  ", "a\n b", " ", "a, b c.  d"]
    return all(pieces.encode(p) == pieces.encode(p.replace(" ", BLANK_MARK)) for p in probes)


def tokenizer_version(path: str) -> str:
    """Digest of the file, its library's version and the settings that counts depend on."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    said = f"{library} {version(library)} no begin, end or added special tokens; blank mark {blank_mark_is_blank(path)}\n"
    return hashlib.sha256(said.encode() + Path(path).read_bytes()).hexdigest()


def normalised(text: str | Column, same_blank: bool) -> Column:
    """The text whose digest is the cache's key: null is empty, and U+2581 a blank where the tokenizer says so."""
    return F.replace(text_of(text), F.lit(BLANK_MARK), F.lit(" ")) if same_blank else text_of(text)


def read_cache(spark: SparkSession, cache: str, name: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version; runs that overlapped may have stored a digest twice."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == name)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, digests: DataFrame, tokenizer: str, cache: str, text: str = "text") -> int:
    """Encode the texts of ``docs`` whose digest is in ``digests`` but not in the cache, each once; how many these were.

    Texts are brought together by digest with a map-side combine, so copies meet before the shuffle.
    If only few digests miss, they are broadcast (their number is counted first) and no other text is moved.
    A run that fails half-way leaves nothing: Spark commits the appended files at the end.
    """
    spark = docs.sparkSession
    name = tokenizer_version(tokenizer)
    missing, path = stage(digests.select("digest").distinct().join(read_cache(spark, cache, name), "digest", "left_anti"))
    n = missing.count()
    if n:
        content = normalised(text, blank_mark_is_blank(tokenizer))
        texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("_text"))
        if n <= FEW_DIGESTS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        wanted = texts.groupBy("digest").agg(F.first("_text").alias("_text"))
        if n > FEW_DIGESTS:
            wanted = wanted.join(missing, "digest", "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = _counter(tokenizer, name)
            for b in batches:
                numbers = pa.array(count(b.column("_text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("digest"), numbers], names=["digest", "n_tokens"])

        with bounded_batches(spark):
            counted = wanted.mapInArrow(encode, "digest binary, n_tokens long")
            counted.withColumn("tokenizer", F.lit(name)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    discard(spark, path)
    return n


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row of ``docs``, through the cache at ``cache``.

    ``n_bytes`` is the text's size in UTF-8, ``over_limit`` says whether it has more than ``limit``
    tokens. A null text is empty (0 bytes, no tokens); a null id is kept; repeated rows give repeated
    rows and are encoded once; no other column is read, so their names cannot clash. An empty table
    gives no rows and leaves the cache as it was. Texts are never cut.
    """
    spark = docs.sparkSession
    same_blank = blank_mark_is_blank(tokenizer)
    keys, _ = stage(
        docs.select(
            F.col(id_col),
            F.octet_length(text_of(text)).cast("long").alias("n_bytes"),
            F.unhex(F.sha2(normalised(text, same_blank), 256)).alias("digest"),
        )
    )
    fill_cache(docs, keys, tokenizer, cache, text)
    counts = read_cache(spark, cache, tokenizer_version(tokenizer))
    # Every digest has its row now; a left join would keep a document without one and show the fault as null.
    found = keys.join(counts, "digest", "left")
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
