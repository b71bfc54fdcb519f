"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm.centroids import centroid_clusters
from splicelake.llm.chat import format_tree, read_back
from splicelake.llm.common import table
from splicelake.llm.exact_dedup import exact_dedup
from splicelake.llm.fingerprint import fingerprint_with_edits
from splicelake.llm.jaccard import near_groups
from splicelake.llm.lines import line_dedup
from splicelake.llm.mixing import mix
from splicelake.llm.packing import pack, token_pieces
from splicelake.llm.quality import apply_quality, fit_quality
from splicelake.llm.repeats import remove_repeats
from splicelake.llm.resampling import resample
from splicelake.llm.secrets import fit_secrets, scan
from splicelake.llm.token_counts import count_tokens
from splicelake.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_register("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive fingerprints of every document, its edited text and its successor."""
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


@_register("op5_mix_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 1:2:3 mix of the sources takes of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_register("op6_pack_sequences")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 4096 tokens."""
    packed = pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_register(
    "op7_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@_register(
    "op9_repeated_bytes",
    """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(generate_series(0, octet_length(raw) - 200)) AS i, h FROM d WHERE octet_length(raw) >= 200
), k AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM w
), r AS (
  SELECT doc_id, i FROM k WHERE s IN (SELECT s FROM k GROUP BY s HAVING count(*) >= 2)
), opened AS (
  SELECT doc_id, i, i > lag(i + 200) OVER (PARTITION BY doc_id ORDER BY i) AS fresh FROM r
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN fresh IS NULL OR fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs
), per AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail,
         string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN per.doc_id IS NULL THEN h ELSE head || substr(h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that occur elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@_register(
    "op8_ngram_jaccard",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d
), n AS (SELECT doc_id, len(s) AS n FROM g
), t AS (SELECT doc_id, unnest(s) AS x FROM g
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), r AS (
  SELECT doc_id AS a, doc_id AS root FROM d
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles overlap by 85 percent."""
    return near_groups(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@_register("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior, score and decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_quality(docs, fit_quality(docs)).drop("text")


@_register(
    "op3_chat_tree",
    r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
         + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_start|>' || '<|im_end|>') + 2 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the template's own marks, through the prefix tree and back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    path = tokenizer_path("byte_bpe_50k.json")
    nodes, ways = format_tree(turns.unionByName(more), path)
    return read_back(nodes, ways, path)


@_register("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by patterns and by the network."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit_secrets(docs))


@_register("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of every document that repeat an earlier line, give or take an edit for 12 characters, two at most."""
    return line_dedup(table(spark, sf_dir, "documents"), least=1)


@_register(
    "op11_resample",
    r"""
WITH tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
         lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark
), e AS (SELECT doc_id, unnest(w) AS x FROM d
), hashed AS (
  SELECT x, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(x))),
         lambda i: CAST('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
         lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS BIGINT) + 1])) AS c
  FROM (SELECT x FROM e UNION SELECT x FROM b), tbl
), k AS (SELECT x, xor(c, 4294967295) % 10000 AS bucket FROM hashed
), s AS (SELECT bucket, count(*) AS n FROM e JOIN k USING (x) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (x) GROUP BY bucket
), a AS (SELECT (SELECT count(*) FROM e) AS s_all, (SELECT count(*) FROM b) AS t_all
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), a
), sums AS (SELECT doc_id, sum(gain) AS total FROM e JOIN k USING (x) JOIN gains USING (bucket) GROUP BY doc_id
), weighed AS (
  SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN sums USING (doc_id)
), scored AS (
  SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight,
         CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= (SELECT count(*) FROM ranked) * 10 // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark texts, with every document's weight and score."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least_words=20, seed=2024)


@_register("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document through a digest cache of its own, empty at the start."""
    cache = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/llm/token_cache_{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), cache)


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Every round spelled out."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v AS c FROM v ORDER BY cluster LIMIT {k}
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(distance := d, cluster := cluster)) AS best FROM (
    SELECT r, cluster, CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{n}
  ) GROUP BY r
)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (
  SELECT best.cluster AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{n} JOIN v USING (r), (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY ALL
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.cluster, coalesce(any_value(moved), any_value(c)) AS c FROM c{n} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM m{n} GROUP BY cluster
  ) USING (cluster) GROUP BY c{n}.cluster
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
       CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON best.cluster = c{rounds}.cluster"""
    )


@_register("op13_centroid_clusters", _clusters_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds from 40 drawn centroids."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2)
