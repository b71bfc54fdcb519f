"""Exon, transcript and gene similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators import similarity as sim
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query

MATRIX_SQL = """matrix AS (SELECT p.a_tx, p.b_tx, a.ord AS a_exon, b.ord AS b_exon,
         CASE WHEN greatest(a.e, b.e) > least(a.s, b.s) THEN greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / CAST(greatest(a.e, b.e) - least(a.s, b.s) AS DOUBLE) ELSE 0.0 END AS ja,
         CASE WHEN a.clen = b.clen AND a.clen <> 0 THEN 1.0e0 ELSE 0.0e0 END AS jb, a.held AS ha, b.held AS hb
         FROM pairs p JOIN exon_feats a ON a.tx_key = p.a_tx JOIN exon_feats b ON b.tx_key = p.b_tx),
       shared AS (SELECT p.a_tx, p.b_tx, x.ord AS a_exon, y.ord AS b_exon, CAST(sum(least(x.n, y.n)) AS BIGINT) AS common FROM pairs p
         JOIN exon_types x ON x.tx_key = p.a_tx JOIN exon_types y ON y.tx_key = p.b_tx AND y.type_id = x.type_id GROUP BY ALL),
       cells AS (SELECT m.a_tx, m.b_tx, m.a_exon, m.b_exon, CASE WHEN ja = 1 THEN 1.0e0 ELSE (ja * 1.0e0 + jb * 1.0e0 +
         (CASE WHEN common > 0 THEN CAST(common AS DOUBLE) / CAST(ha + hb - common AS DOUBLE) ELSE 0.0e0 END) * 1.0e0) / 3.0e0 END AS score
         FROM matrix m LEFT JOIN shared s ON s.a_tx = m.a_tx AND s.b_tx = m.b_tx AND s.a_exon = m.a_exon AND s.b_exon = m.b_exon)"""
TOTALS_SQL = """tops AS (SELECT a_tx, b_tx, max(score) AS best FROM cells GROUP BY a_tx, b_tx, a_exon
         UNION ALL SELECT a_tx, b_tx, max(score) FROM cells GROUP BY a_tx, b_tx, b_exon),
       totals AS (SELECT a_tx, b_tx, sum(best) * 100 / count(*) AS similarity FROM tops GROUP BY a_tx, b_tx)"""
NEIGHBOURS = "pairs AS (SELECT a_tx, b_tx FROM tx_next WHERE b_tx IS NOT NULL)"
ALL_PAIRS = "pairs AS (SELECT a.tx_key AS a_tx, b.tx_key AS b_tx FROM transcripts a JOIN transcripts b ON a.gene_key = b.gene_key AND a.tx_key > b.tx_key)"


def _inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    exons, types = sim.exon_features(t.cds, t.domains)
    return sim.transcript_neighbours(t.transcripts), exons, types


@query(
    "exon_similarity",
    f"WITH {NEIGHBOURS}, {MATRIX_SQL} SELECT a_tx AS pair_key, a_exon, b_exon, round(score, 9) AS score FROM cells WHERE score > 0",
)
def exon_similarity(t: Tables) -> DataFrame:
    """Every transcript against the next one of its gene; zero cells are left out."""
    cells = sim.exon_similarity(*_inputs(t))
    return cells.select("pair_key", "a_exon", "b_exon", F.round("score", 9).alias("score"))


@query(
    "transcript_similarity",
    f"WITH {NEIGHBOURS}, {MATRIX_SQL}, {TOTALS_SQL} SELECT a_tx AS pair_key, a_tx, b_tx, round(similarity, 9) AS similarity FROM totals",
)
def transcript_similarity(t: Tables) -> DataFrame:
    return sim.transcript_similarity(*_inputs(t)).withColumn("similarity", F.round("similarity", 9))


@query(
    "gene_similarity",
    f"""WITH {ALL_PAIRS}, {MATRIX_SQL}, {TOTALS_SQL} SELECT t.gene_key, count(DISTINCT t.tx_key) AS n_transcripts, round(avg(x.similarity), 7) AS similarity
       FROM transcripts t LEFT JOIN totals x ON x.a_tx = t.tx_key GROUP BY t.gene_key""",
)
def gene_similarity(t: Tables) -> DataFrame:
    exons, types = sim.exon_features(t.cds, t.domains)
    return sim.gene_similarity(t.transcripts, exons, types).withColumn("similarity", F.round("similarity", 7))


@query(
    "gene_similarity_by_species",
    f"""WITH {ALL_PAIRS}, {MATRIX_SQL}, {TOTALS_SQL}, g AS (SELECT t.gene_key, round(avg(x.similarity), 7) AS similarity
         FROM transcripts t LEFT JOIN totals x ON x.a_tx = t.tx_key GROUP BY t.gene_key)
       SELECT upper(gene_symbol) AS symbol, specie, g.gene_key, similarity FROM g JOIN genes ON genes.gene_key = g.gene_key""",
)
def gene_similarity_by_species(t: Tables) -> DataFrame:
    exons, types = sim.exon_features(t.cds, t.domains)
    score = sim.gene_similarity(t.transcripts, exons, types).withColumn("similarity", F.round("similarity", 7))
    return sim.gene_similarity_by_species(score, t.genes)


@query(
    "transcript_diff",
    f"""WITH {NEIGHBOURS}, ty AS (SELECT DISTINCT tx_key, type_id FROM domains), cn AS (SELECT a_tx, count(*) AS c FROM pairs JOIN ty x ON x.tx_key = a_tx JOIN ty y ON y.tx_key = b_tx AND x.type_id = y.type_id GROUP BY 1),
       nt AS (SELECT tx_key, count(*) AS n FROM ty GROUP BY 1)
       SELECT p.a_tx AS pair_key, p.a_tx, p.b_tx, abs(a.tx_start - b.tx_start) AS tx_start_diff, abs(a.tx_end - b.tx_end) AS tx_end_diff,
         abs(a.cds_start - b.cds_start) AS cds_start_diff, abs(a.cds_end - b.cds_end) AS cds_end_diff,
         CASE WHEN coalesce(na.n, 0) + coalesce(nb.n, 0) > 0 THEN coalesce(c, 0) / CAST(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(c, 0) AS DOUBLE) END AS domain_similarity
       FROM pairs p JOIN transcripts a ON a.tx_key = p.a_tx JOIN transcripts b ON b.tx_key = p.b_tx LEFT JOIN nt na ON na.tx_key = p.a_tx LEFT JOIN nt nb ON nb.tx_key = p.b_tx
       LEFT JOIN cn ON cn.a_tx = p.a_tx""",
)
def transcript_diff(t: Tables) -> DataFrame:
    return sim.attribute_differences(sim.transcript_neighbours(t.transcripts), t.transcripts, t.domains)


@query(
    "exon_length_match",
    """WITH k AS (SELECT upper(gene_symbol) AS symbol, gene_key, row_number() OVER (PARTITION BY upper(gene_symbol) ORDER BY gene_key) AS rn FROM genes),
       two AS (SELECT a.symbol, a.gene_key AS g1, b.gene_key AS g2 FROM k a JOIN k b ON a.symbol = b.symbol AND a.rn = 1 AND b.rn = 2),
       u AS (SELECT gene_key, genomic_end_tx - genomic_start_tx AS len, count(*) AS n FROM (SELECT DISTINCT gene_key, genomic_start_tx, genomic_end_tx FROM exons) GROUP BY ALL),
       n AS (SELECT gene_key, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1),
       m AS (SELECT symbol, CAST(sum(least(a.n, b.n)) AS BIGINT) AS matched FROM two JOIN u a ON a.gene_key = g1 JOIN u b ON b.gene_key = g2 AND a.len = b.len GROUP BY 1)
       SELECT two.symbol, coalesce(matched, 0) AS matched, coalesce(x.n, 0) + coalesce(y.n, 0) AS n_exons, coalesce(matched, 0) * 2 / CAST(coalesce(x.n, 0) + coalesce(y.n, 0) AS DOUBLE) AS score
       FROM two LEFT JOIN n x ON x.gene_key = g1 LEFT JOIN n y ON y.gene_key = g2 LEFT JOIN m ON m.symbol = two.symbol WHERE x.n IS NOT NULL OR y.n IS NOT NULL""",
)
def exon_length_match(t: Tables) -> DataFrame:
    unique = t.exons.select("gene_key", "genomic_start_tx", "genomic_end_tx").distinct()
    return sim.exon_length_match(t.genes, unique)


@query(
    "exon_length_match_within",
    """WITH RECURSIVE k AS (SELECT upper(gene_symbol) AS symbol, gene_key, row_number() OVER (PARTITION BY upper(gene_symbol) ORDER BY gene_key) AS rn FROM genes),
       two AS (SELECT a.symbol, a.gene_key AS g1, b.gene_key AS g2 FROM k a JOIN k b ON a.symbol = b.symbol AND a.rn = 1 AND b.rn = 2),
       l AS (SELECT gene_key, list(len ORDER BY pos, len) AS lens FROM (SELECT DISTINCT gene_key, genomic_start_tx AS pos, genomic_end_tx - genomic_start_tx AS len FROM exons) GROUP BY 1),
       scan AS (SELECT symbol, 1 AS i, x.lens AS mine, y.lens AS free, CAST(0 AS BIGINT) AS hits FROM two JOIN l x ON x.gene_key = g1 JOIN l y ON y.gene_key = g2
         UNION ALL SELECT symbol, i + 1, mine, CASE WHEN p > 0 THEN list_slice(free, 1, p - 1) || list_slice(free, p + 1, len(free)) ELSE free END, hits + CASE WHEN p > 0 THEN 1 ELSE 0 END
         FROM (SELECT *, coalesce(list_position(list_transform(free, lambda m: abs(m - mine[i]) <= 30), true), 0) AS p FROM scan WHERE i <= len(mine))),
       m AS (SELECT symbol, max(hits) AS matched FROM scan GROUP BY 1)
       SELECT two.symbol, coalesce(matched, 0) AS matched, CAST(coalesce(len(x.lens), 0) + coalesce(len(y.lens), 0) AS BIGINT) AS n_exons,
         coalesce(matched, 0) * 2 / CAST(coalesce(len(x.lens), 0) + coalesce(len(y.lens), 0) AS DOUBLE) AS score
       FROM two LEFT JOIN l x ON x.gene_key = g1 LEFT JOIN l y ON y.gene_key = g2 LEFT JOIN m ON m.symbol = two.symbol WHERE x.lens IS NOT NULL OR y.lens IS NOT NULL""",
)
def exon_length_match_within(t: Tables) -> DataFrame:
    """Lengths may differ by 30 bases; greedy in genomic order."""
    unique = t.exons.select("gene_key", "genomic_start_tx", "genomic_end_tx").distinct()
    return sim.exon_length_match(t.genes, unique, space=30)
