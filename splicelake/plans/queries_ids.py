"""Queries on identifiers: crosswalk, reconciliation, de-duplication, mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators import crosswalk as xw
from splicelake.operators import idmapping as im
from splicelake.operators import joins
from splicelake.operators import reconcile as rc
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query


def _crosswalk(t: Tables) -> DataFrame:
    return xw.clean_crosswalk(t.crosswalk_raw)


@query(
    "id_crosswalk",
    """SELECT 'gene' AS kind, id, other FROM gmap UNION ALL SELECT 'transcript', id, other FROM tmap UNION ALL SELECT 'protein', id, other FROM pmap""",
)
def id_crosswalk(t: Tables) -> DataFrame:
    rows = _crosswalk(t)
    maps = {"gene": xw.gene_map(rows), "transcript": xw.transcript_map(rows), "protein": xw.protein_map(rows)}
    parts = [m.select(F.lit(kind).alias("kind"), "id", "other") for kind, m in maps.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "crosswalk_lookup",
    """SELECT tx_key, t.other AS other_transcript, g.other AS other_gene, p.other AS other_protein FROM transcripts x
       LEFT JOIN tmap t ON t.id = x.transcript_refseq_id LEFT JOIN gmap g ON g.id = x.gene_geneid_id LEFT JOIN pmap p ON p.id = x.protein_ensembl_id""",
)
def crosswalk_lookup(t: Tables) -> DataFrame:
    rows = _crosswalk(t)
    x = xw.look_up(t.transcripts, "transcript_refseq_id", xw.transcript_map(rows), "other_transcript")
    x = xw.look_up(x, "gene_geneid_id", xw.gene_map(rows), "other_gene")
    x = xw.look_up(x, "protein_ensembl_id", xw.protein_map(rows), "other_protein")
    return x.select("tx_key", "other_transcript", "other_gene", "other_protein")


CASCADE = """CASE WHEN s1.id IS NOT NULL THEN s1.other WHEN s2.id IS NOT NULL THEN s2.other
       WHEN s3.id IS NOT NULL THEN (SELECT other FROM pmap WHERE pmap.id = s3.other)
       WHEN s4.id IS NOT NULL THEN (SELECT other FROM tmap WHERE tmap.id = s4.other) END"""


@query(
    "lookup_cascade",
    f"""SELECT ids.id, {CASCADE} AS answer FROM (SELECT transcript_refseq_id AS id FROM transcripts UNION SELECT transcript_ensembl_id FROM transcripts
         UNION SELECT protein_refseq_id FROM transcripts UNION SELECT protein_ensembl_id FROM transcripts) ids
       LEFT JOIN t2p s1 ON s1.id = ids.id LEFT JOIN p2t s2 ON s2.id = ids.id LEFT JOIN tmap t ON t.id = ids.id LEFT JOIN t2p s3 ON s3.id = t.other
       LEFT JOIN pmap p ON p.id = ids.id LEFT JOIN p2t s4 ON s4.id = p.other WHERE ids.id IS NOT NULL""",
)
def lookup_cascade(t: Tables) -> DataFrame:
    columns = ["transcript_refseq_id", "transcript_ensembl_id", "protein_refseq_id", "protein_ensembl_id"]
    ids = t.transcripts.select(F.explode(F.array(*columns)).alias("id")).filter("id IS NOT NULL").distinct()
    return xw.transcript_protein_lookup(ids, "id", xw.crosswalk_facts(_crosswalk(t)), "answer")


@query(
    "gene_of_transcript",
    """SELECT tx_key, asked, coalesce(a.other, c.other) AS gene FROM (SELECT tx_key, concat(split_part(transcript_ensembl_id, '.', 1), '.',
         CAST(tx_key % 2 + 1 AS VARCHAR)) AS asked FROM transcripts WHERE transcript_ensembl_id IS NOT NULL) x
       LEFT JOIN t2g a ON a.id = asked LEFT JOIN idnov b ON b.id = split_part(asked, '.', 1) LEFT JOIN t2g c ON c.id = b.other""",
)
def gene_of_transcript(t: Tables) -> DataFrame:
    """Half of the ids ask for a version the crosswalk does not have."""
    asked = t.transcripts.filter("transcript_ensembl_id IS NOT NULL").select(
        "tx_key",
        F.concat_ws(
            ".", F.substring_index("transcript_ensembl_id", ".", 1), (F.col("tx_key") % 2 + 1).cast("string")
        ).alias("asked"),
    )
    return xw.gene_of_transcript(asked, "asked", xw.crosswalk_facts(_crosswalk(t)), "gene")


BROKEN = {
    "transcript_refseq_id": "CASE WHEN tx_key % 7 = 3 THEN NULL ELSE transcript_refseq_id END",
    "transcript_ensembl_id": "transcript_ensembl_id",
    "gene_geneid_id": "CASE WHEN tx_key % 3 = 0 THEN NULL ELSE gene_geneid_id END",
    "gene_ensembl_id": "CASE WHEN tx_key % 4 = 1 THEN NULL ELSE gene_ensembl_id END",
    "protein_refseq_id": "CASE WHEN tx_key % 6 = 1 THEN NULL ELSE protein_refseq_id END",
    "protein_ensembl_id": "CASE WHEN tx_key % 8 = 2 THEN NULL ELSE protein_ensembl_id END",
}
BROKEN_SQL = "SELECT tx_key, " + ", ".join(f"{e} AS {n}" for n, e in BROKEN.items()) + " FROM transcripts"


def _filled_sql(source: str, key: str) -> str:
    """Stepwise fill of one source of transcripts; later steps see the ids filled before."""

    def cascade(col: str) -> str:
        return f"""CASE WHEN EXISTS (SELECT 1 FROM t2p WHERE t2p.id = {col}) THEN (SELECT other FROM t2p WHERE t2p.id = {col})
          WHEN EXISTS (SELECT 1 FROM p2t WHERE p2t.id = {col}) THEN (SELECT other FROM p2t WHERE p2t.id = {col})
          WHEN EXISTS (SELECT 1 FROM tmap JOIN t2p ON t2p.id = tmap.other WHERE tmap.id = {col})
            THEN (SELECT pmap.other FROM tmap JOIN t2p ON t2p.id = tmap.other LEFT JOIN pmap ON pmap.id = t2p.other WHERE tmap.id = {col})
          WHEN EXISTS (SELECT 1 FROM pmap JOIN p2t ON p2t.id = pmap.other WHERE pmap.id = {col})
            THEN (SELECT tmap.other FROM pmap JOIN p2t ON p2t.id = pmap.other LEFT JOIN tmap ON tmap.id = p2t.other WHERE pmap.id = {col}) END"""

    def gene(col: str) -> str:
        return f"""coalesce((SELECT other FROM t2g WHERE id = {col}),
          (SELECT t2g.other FROM idnov JOIN t2g ON t2g.id = idnov.other WHERE idnov.id = split_part({col}, '.', 1)))"""

    return f"""{source}_r1 AS (SELECT {key}, transcript_refseq_id, coalesce(transcript_ensembl_id, (SELECT other FROM tmap WHERE id = transcript_refseq_id)) AS transcript_ensembl_id,
         coalesce(gene_geneid_id, {gene('transcript_refseq_id')}) AS gene_geneid_id, gene_ensembl_id,
         coalesce(protein_refseq_id, {cascade('transcript_refseq_id')}) AS protein_refseq_id, protein_ensembl_id FROM {source} WHERE transcript_refseq_id IS NOT NULL),
       {source}_r2 AS (SELECT {key}, transcript_refseq_id, transcript_ensembl_id, gene_geneid_id,
         coalesce(gene_ensembl_id, (SELECT other FROM gmap WHERE id = gene_geneid_id)) AS gene_ensembl_id, protein_refseq_id,
         coalesce(protein_ensembl_id, (SELECT other FROM pmap WHERE id = protein_refseq_id)) AS protein_ensembl_id FROM {source}_r1),
       {source}_e1 AS (SELECT {key}, (SELECT other FROM tmap WHERE id = transcript_ensembl_id) AS transcript_refseq_id, transcript_ensembl_id, gene_geneid_id,
         coalesce(gene_ensembl_id, {gene('transcript_ensembl_id')}) AS gene_ensembl_id, protein_refseq_id,
         coalesce(protein_ensembl_id, {cascade('transcript_ensembl_id')}) AS protein_ensembl_id FROM {source}
         WHERE transcript_refseq_id IS NULL AND transcript_ensembl_id IS NOT NULL),
       {source}_e2 AS (SELECT {key}, transcript_refseq_id, transcript_ensembl_id, coalesce(gene_geneid_id, (SELECT other FROM gmap WHERE id = gene_ensembl_id)) AS gene_geneid_id,
         gene_ensembl_id, coalesce(protein_refseq_id, (SELECT other FROM pmap WHERE id = protein_ensembl_id)) AS protein_refseq_id, protein_ensembl_id FROM {source}_e1),
       {source}_filled AS (SELECT * FROM {source}_r2 UNION ALL SELECT * FROM {source}_e2 UNION ALL
         SELECT {key}, transcript_refseq_id, transcript_ensembl_id, gene_geneid_id, gene_ensembl_id, protein_refseq_id, protein_ensembl_id FROM {source}
         WHERE transcript_refseq_id IS NULL AND transcript_ensembl_id IS NULL)"""


@query("fill_missing_ids", f"WITH broken AS ({BROKEN_SQL}), {_filled_sql('broken', 'tx_key')} SELECT * FROM broken_filled")
def fill_missing_ids(t: Tables) -> DataFrame:
    broken = t.transcripts.selectExpr("tx_key", *[f"{e} AS {n}" for n, e in BROKEN.items()])
    return xw.fill_missing_ids(broken, xw.crosswalk_facts(_crosswalk(t)))


@query(
    "fill_missing_proteins",
    """SELECT tx_key, coalesce(protein_refseq_id, (SELECT other FROM pmap WHERE id = protein_ensembl_id)) AS protein_refseq_id,
       CASE WHEN protein_refseq_id IS NOT NULL THEN coalesce(protein_ensembl_id, (SELECT other FROM pmap WHERE id = protein_refseq_id))
         ELSE protein_ensembl_id END AS protein_ensembl_id FROM proteins""",
)
def fill_missing_proteins(t: Tables) -> DataFrame:
    return xw.fill_missing_proteins(t.proteins.select("tx_key", "protein_refseq_id", "protein_ensembl_id"), _crosswalk(t))


@query(
    "or_join",
    """SELECT tx_key, g.gene_key FROM transcripts t JOIN genes g ON t.gene_geneid_id = g.gene_geneid_id OR t.gene_ensembl_id = g.gene_ensembl_id""",
)
def or_join(t: Tables) -> DataFrame:
    g = t.genes.select("gene_key", F.col("gene_geneid_id").alias("g1"), F.col("gene_ensembl_id").alias("g2"))
    tx = t.transcripts.select("tx_key", "gene_geneid_id", "gene_ensembl_id")
    return joins.or_join(tx, g, ("gene_geneid_id", "g1"), ("gene_ensembl_id", "g2")).select("tx_key", "gene_key")


@query(
    "semi_join_known",
    "SELECT tx_key, order_in_transcript FROM exons WHERE tx_key IN (SELECT tx_key FROM proteins)",
)
def semi_join_known(t: Tables) -> DataFrame:
    return joins.semi_join_known(t.exons.select("tx_key", "order_in_transcript"), t.proteins, "tx_key")


@query(
    "insert_or_ignore",
    """SELECT tx_key, transcript_refseq_id, transcript_ensembl_id, exon_count FROM (SELECT *, row_number() OVER (PARTITION BY transcript_refseq_id ORDER BY tx_key) AS rn
       FROM transcripts_dup) WHERE rn = 1 OR transcript_refseq_id IS NULL""",
)
def insert_or_ignore(t: Tables) -> DataFrame:
    return joins.insert_or_ignore(t.transcripts_dup, ["transcript_refseq_id"], ["tx_key"])


@query(
    "dedupe_keep_first",
    """SELECT tx_key, transcript_ensembl_id FROM (SELECT *, row_number() OVER (PARTITION BY transcript_ensembl_id ORDER BY tx_key) AS rn
       FROM transcripts_dup) WHERE rn = 1 OR transcript_ensembl_id IS NULL""",
)
def dedupe_keep_first(t: Tables) -> DataFrame:
    return joins.insert_or_ignore(t.transcripts_dup.select("tx_key", "transcript_ensembl_id"), ["transcript_ensembl_id"], ["tx_key"])


@query(
    "dedupe_transcripts",
    """SELECT tx_key, r AS transcript_refseq_id, e AS transcript_ensembl_id, exon_count FROM (SELECT tx_key, exon_count,
       CASE WHEN row_number() OVER (PARTITION BY transcript_refseq_id ORDER BY tx_key) = 1 THEN transcript_refseq_id END AS r,
       CASE WHEN row_number() OVER (PARTITION BY transcript_ensembl_id ORDER BY tx_key) = 1 THEN transcript_ensembl_id END AS e
       FROM transcripts_dup) WHERE r IS NOT NULL OR e IS NOT NULL""",
)
def dedupe_transcripts(t: Tables) -> DataFrame:
    return joins.dedupe_transcripts(t.transcripts_dup, "tx_key")


@query(
    "one_gene_row",
    """SELECT tx_key, gene_geneid_id, gene_ensembl_id FROM (SELECT tx_key, gene_geneid_id, gene_ensembl_id,
       row_number() OVER (PARTITION BY gene_geneid_id ORDER BY tx_key) AS a, row_number() OVER (PARTITION BY gene_ensembl_id ORDER BY tx_key) AS b FROM transcripts)
       WHERE (a = 1 OR gene_geneid_id IS NULL) AND (b = 1 OR gene_ensembl_id IS NULL)""",
)
def one_gene_row(t: Tables) -> DataFrame:
    return joins.one_gene_row(t.transcripts.select("tx_key", "gene_geneid_id", "gene_ensembl_id"), "tx_key")


VERSIONS = """SELECT concat('NM_', CAST(tx_key - tx_key % 4 AS STRING)) AS id, tx_key % 4 AS version, tx_key AS ord,
       protein_refseq_id, gene_ensembl_id, cds_start FROM transcripts"""


@query(
    "newest_version",
    f"""WITH v AS ({VERSIONS}) SELECT id, max(version) AS version,
       arg_max(protein_refseq_id, version) FILTER (protein_refseq_id IS NOT NULL) AS protein_refseq_id,
       arg_max(gene_ensembl_id, version) FILTER (gene_ensembl_id IS NOT NULL) AS gene_ensembl_id,
       arg_max(cds_start, version) FILTER (cds_start IS NOT NULL) AS cds_start FROM v GROUP BY id""",
)
def newest_version(t: Tables) -> DataFrame:
    rows = t.transcripts.selectExpr(
        "concat('NM_', CAST(tx_key - tx_key % 4 AS STRING)) AS id",
        "tx_key % 4 AS version",
        "tx_key AS ord",
        "protein_refseq_id",
        "gene_ensembl_id",
        "cds_start",
    )
    return joins.newest_version(rows, "id", "version", "ord")


# --- reconciliation -----------------------------------------------------------

PAIR_SQL = """ens AS (SELECT * FROM source_b), ensp AS (SELECT protein_ensembl_id AS p, arg_max(transcript_ensembl_id, ord) AS tx, arg_max(length, ord) AS len
         FROM source_b WHERE protein_ensembl_id IS NOT NULL GROUP BY 1),
       p0 AS (SELECT a.*, x.other AS xw, coalesce(own_ensembl_id, x.other) AS t0, p.other AS q0, g.other AS ens_gene
         FROM source_a a LEFT JOIN tmap x ON x.id = transcript_refseq_id LEFT JOIN pmap p ON p.id = protein_refseq_id LEFT JOIN gmap g ON g.id = gene_geneid_id),
       p1 AS (SELECT p0.*, b.transcript_ensembl_id IS NOT NULL AS kt, e.p IS NOT NULL AS kp, b.protein_ensembl_id AS p_of_t, e.tx AS t_of_p
         FROM p0 LEFT JOIN ens b ON b.transcript_ensembl_id = t0 LEFT JOIN ensp e ON e.p = q0),
       p2 AS (SELECT *, CASE WHEN NOT kt AND kp THEN t_of_p ELSE t0 END AS ens_tx, CASE WHEN kt AND NOT kp THEN p_of_t ELSE q0 END AS ens_prot FROM p1),
       pairs AS (SELECT p2.*, e.len AS ens_len, CASE WHEN e.len IS NOT NULL AND abs(length - e.len) <= 1 THEN 'merge' WHEN e.len IS NOT NULL THEN 'separate'
         WHEN NOT kt AND NOT kp THEN 'fill' ELSE 'alone' END AS action,
         CASE WHEN own_ensembl_id IS NOT NULL AND xw <> own_ensembl_id THEN xw END AS rejected FROM p2 LEFT JOIN ensp e ON e.p = ens_prot)"""

RECONCILE_SQL = f"""WITH {PAIR_SQL},
       part AS (SELECT pairs.*, b.transcript_ensembl_id AS e_tx, b.gene_ensembl_id AS e_gene, b.protein_ensembl_id AS e_prot, b.canonical AS e_can
         FROM pairs LEFT JOIN ens b ON b.transcript_ensembl_id = ens_tx),
       ref0 AS (SELECT ord * 2 AS seq, action, transcript_refseq_id, CASE WHEN action = 'merge' THEN coalesce(own_ensembl_id, ens_tx) ELSE own_ensembl_id END AS transcript_ensembl_id,
         gene_geneid_id, ens_gene AS gene_ensembl_id, protein_refseq_id, CAST(NULL AS VARCHAR) AS protein_ensembl_id,
         CASE WHEN action = 'merge' THEN canonical | coalesce(e_can, 0) ELSE canonical END AS canonical,
         CASE WHEN action = 'merge' AND e_tx IS NOT NULL THEN 'ensembl' ELSE 'refseq' END AS exon_source FROM part),
       tofill AS (SELECT * FROM ref0 WHERE action IN ('merge', 'fill')), {_filled_sql('tofill', 'seq')},
       apart AS (SELECT min(ord) * 2 + 1 AS seq, 'kept_apart' AS action, CAST(NULL AS VARCHAR) AS transcript_refseq_id, e_tx AS transcript_ensembl_id,
         any_value(g.other) AS gene_geneid_id, any_value(e_gene) AS gene_ensembl_id, CAST(NULL AS VARCHAR) AS protein_refseq_id, any_value(e_prot) AS protein_ensembl_id,
         any_value(e_can) AS canonical, 'ensembl' AS exon_source FROM part LEFT JOIN gmap g ON g.id = e_gene WHERE action = 'separate' AND e_tx IS NOT NULL GROUP BY e_tx),
       written AS (SELECT ens_tx AS tx FROM pairs WHERE action IN ('merge', 'separate') UNION
         SELECT rejected FROM pairs WHERE rejected IS NOT NULL AND rejected <> coalesce(ens_tx, '')),
       left0 AS (SELECT 1000000000000 + ord AS seq, CAST(NULL AS VARCHAR) AS transcript_refseq_id, transcript_ensembl_id, CAST(NULL AS VARCHAR) AS gene_geneid_id, gene_ensembl_id,
         CAST(NULL AS VARCHAR) AS protein_refseq_id, protein_ensembl_id, canonical FROM ens WHERE transcript_ensembl_id NOT IN (SELECT tx FROM written WHERE tx IS NOT NULL)),
       {_filled_sql('left0', 'seq')},
       everything AS (SELECT seq, action, transcript_refseq_id, transcript_ensembl_id, gene_geneid_id, gene_ensembl_id, protein_refseq_id, protein_ensembl_id, canonical, exon_source
           FROM ref0 WHERE action NOT IN ('merge', 'fill')
         UNION ALL SELECT f.seq, r.action, f.transcript_refseq_id, f.transcript_ensembl_id, f.gene_geneid_id, f.gene_ensembl_id, f.protein_refseq_id, f.protein_ensembl_id, r.canonical, r.exon_source
           FROM tofill_filled f JOIN ref0 r ON f.seq = r.seq
         UNION ALL SELECT * FROM apart
         UNION ALL SELECT f.seq, 'leftover', f.transcript_refseq_id, f.transcript_ensembl_id, f.gene_geneid_id, f.gene_ensembl_id, f.protein_refseq_id, f.protein_ensembl_id,
           l.canonical | coalesce(a.canonical, 0), 'ensembl' FROM left0_filled f JOIN left0 l ON f.seq = l.seq LEFT JOIN source_a a ON a.transcript_refseq_id = f.transcript_refseq_id),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY transcript_refseq_id ORDER BY seq) AS rr, row_number() OVER (PARTITION BY transcript_ensembl_id ORDER BY seq) AS re FROM everything),
       unique_rows AS (SELECT seq, action, CASE WHEN rr = 1 THEN transcript_refseq_id END AS transcript_refseq_id, CASE WHEN re = 1 THEN transcript_ensembl_id END AS transcript_ensembl_id,
         gene_geneid_id, gene_ensembl_id, protein_refseq_id, protein_ensembl_id, canonical, exon_source FROM ranked),
       canon AS (SELECT gene_ensembl_id AS id, arg_min_null(gene_geneid_id, seq) AS other FROM everything WHERE gene_ensembl_id IS NOT NULL GROUP BY 1)"""


@query(
    "reconcile_sources",
    RECONCILE_SQL
    + """ SELECT action, transcript_refseq_id, transcript_ensembl_id, coalesce(c.other, gene_geneid_id) AS gene_geneid_id, gene_ensembl_id, protein_refseq_id,
       protein_ensembl_id, canonical, exon_source FROM unique_rows LEFT JOIN canon c ON c.id = gene_ensembl_id
       WHERE transcript_refseq_id IS NOT NULL OR transcript_ensembl_id IS NOT NULL""",
)
def reconcile_sources(t: Tables) -> DataFrame:
    return rc.reconcile_transcripts(t.source_a, t.source_b, _crosswalk(t)).drop("seq", "ref_tx", "ens_tx", "ens_prot")


@query(
    "reconcile_metrics",
    f"""WITH {PAIR_SQL} SELECT count(*) FILTER (own_ensembl_id = xw) AS id_matches, count(*) FILTER (own_ensembl_id <> xw) AS id_mismatches,
       count(*) FILTER (action = 'merge') AS merged_pairs, count(*) FILTER (action = 'separate') AS separated_pairs,
       count(*) FILTER (action = 'fill') AS filled, count(*) FILTER (action = 'alone') AS alone FROM pairs""",
)
def reconcile_metrics(t: Tables) -> DataFrame:
    return rc.reconcile_metrics(t.source_a, t.source_b, _crosswalk(t))


@query(
    "first_pairing_wins",
    """SELECT gene_ensembl_id AS id, arg_min_null(geneid, tx_key) AS other FROM (SELECT tx_key, gene_ensembl_id,
       CASE WHEN tx_key % 6 = 5 THEN NULL WHEN tx_key % 3 = 1 THEN gene_geneid_id || 'b' ELSE gene_geneid_id END AS geneid FROM transcripts)
       WHERE gene_ensembl_id IS NOT NULL GROUP BY 1""",
)
def first_pairing_wins(t: Tables) -> DataFrame:
    pairings = t.transcripts.selectExpr(
        "tx_key",
        "gene_ensembl_id",
        "CASE WHEN tx_key % 6 = 5 THEN NULL WHEN tx_key % 3 = 1 THEN gene_geneid_id || 'b' ELSE gene_geneid_id END AS geneid",
    )
    return rc.first_pairing_wins(pairings, "gene_ensembl_id", "geneid", "tx_key")


GENE_A = {
    "gene_geneid_id": "gene_geneid_id",
    "gene_ensembl_id": "gene_ensembl_id",
    "gene_symbol": "CASE WHEN gene_key % 8 = 0 THEN NULL ELSE gene_symbol END",
    "synonyms": "synonyms",
    "chromosome": "chromosome",
    "strand": "strand",
}
GENE_B = {
    "gene_geneid_id": "CAST(NULL AS STRING)",
    "gene_ensembl_id": "gene_ensembl_id",
    "gene_symbol": "CASE WHEN gene_key % 3 = 0 THEN concat('E', gene_symbol) ELSE gene_symbol END",
    "synonyms": "CASE WHEN gene_key % 2 = 0 THEN concat('OTHER', CAST(gene_key AS STRING), '; SYN', CAST(gene_key AS STRING)) ELSE NULL END",
    "chromosome": "chromosome",
    "strand": "strand",
}
GENE_A_ROWS, GENE_B_ROWS = "gene_key % 11 <> 4", "gene_ensembl_id IS NOT NULL AND gene_key % 13 <> 5"


def _exprs(formulas: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in formulas.items())


@query(
    "merge_genes",
    f"""WITH a AS (SELECT {_exprs(GENE_A)} FROM genes WHERE {GENE_A_ROWS}), b AS (SELECT {_exprs(GENE_B)} FROM genes WHERE {GENE_B_ROWS}),
       j AS (SELECT a.gene_geneid_id, coalesce(a.gene_ensembl_id, b.gene_ensembl_id) AS gene_ensembl_id, coalesce(a.gene_symbol, b.gene_symbol) AS sym, a.synonyms AS s1, b.synonyms AS s2,
         b.gene_symbol AS bsym, a.gene_ensembl_id IS NOT NULL AS has_a, b.gene_ensembl_id IS NOT NULL AS has_b, coalesce(a.chromosome, b.chromosome) AS chromosome, coalesce(a.strand, b.strand) AS strand
         FROM (SELECT * FROM a WHERE gene_ensembl_id IS NOT NULL) a FULL JOIN b ON a.gene_ensembl_id = b.gene_ensembl_id),
       m AS (SELECT *, coalesce(string_split(s1, '; '), []) AS own, list_concat(coalesce(string_split(s2, '; '), []), [bsym]) AS oth FROM j)
       SELECT gene_geneid_id, gene_ensembl_id, sym AS gene_symbol, CASE WHEN has_a AND has_b THEN nullif(array_to_string(list_sort(list_distinct(list_concat(own,
           list_filter(oth, lambda s: s <> sym AND NOT list_contains(own, s))))), '; '), '') ELSE coalesce(s1, s2) END AS synonyms, chromosome, strand FROM m
       UNION ALL SELECT gene_geneid_id, gene_ensembl_id, gene_symbol, synonyms, chromosome, strand FROM a WHERE gene_ensembl_id IS NULL""",
)
def merge_genes(t: Tables) -> DataFrame:
    a = t.genes.filter(GENE_A_ROWS).selectExpr(*[f"{e} AS {n}" for n, e in GENE_A.items()])
    b = t.genes.filter(GENE_B_ROWS).selectExpr(*[f"{e} AS {n}" for n, e in GENE_B.items()])
    return rc.merge_genes(a, b)


@query(
    "recover_missing_gene",
    """WITH kept AS (SELECT * FROM genes WHERE gene_key % 9 <> 2), used AS (SELECT DISTINCT gene_geneid_id AS g, gene_ensembl_id AS e FROM transcripts)
       SELECT gene_geneid_id, gene_ensembl_id, gene_symbol FROM kept UNION ALL
       SELECT gene_geneid_id, gene_ensembl_id, gene_symbol FROM genes x WHERE gene_key % 9 = 2 AND gene_key IN (SELECT gene_key FROM transcripts)""",
)
def recover_missing_gene(t: Tables) -> DataFrame:
    merged = t.genes.filter("gene_key % 9 <> 2")
    found, _ = rc.recover_missing_genes(t.transcripts, merged, t.genes)
    return found.select("gene_geneid_id", "gene_ensembl_id", "gene_symbol")


@query("merge_canonical", "SELECT tx_key, CAST(canonical | (tx_key % 3) AS BIGINT) AS canonical FROM transcripts")
def merge_canonical(t: Tables) -> DataFrame:
    return t.transcripts.select(
        "tx_key", rc.merge_canonical(F.col("canonical").cast("bigint"), F.col("tx_key") % 3).alias("canonical")
    )


@query(
    "same_transcript",
    """WITH lists AS (SELECT tx_key, list((genomic_start_tx, genomic_end_tx) ORDER BY order_in_transcript) AS ex FROM exons GROUP BY 1),
       f AS (SELECT t.tx_key, d.transcript_refseq_id AS r, d.transcript_ensembl_id AS e, strand, ex FROM transcripts t JOIN transcripts_dup d ON t.tx_key = d.tx_key
         JOIN genes g ON t.gene_key = g.gene_key JOIN lists l ON t.tx_key = l.tx_key)
       SELECT a.tx_key AS a_tx, b.tx_key AS b_tx, CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN a.r = b.r WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN a.e = b.e
         ELSE a.strand = b.strand AND a.ex = b.ex END AS same FROM f a JOIN f b ON b.tx_key = a.tx_key + 1""",
)
def same_transcript(t: Tables) -> DataFrame:
    """Each transcript against the one with the next key."""
    f = t.transcripts_dup.join(t.transcripts.select("tx_key", "gene_key"), "tx_key").join(
        t.genes.select("gene_key", "strand"), "gene_key"
    )

    def side(tag: str) -> DataFrame:
        return f.select(
            F.col("tx_key").alias(f"{tag}_tx"),
            F.col("transcript_refseq_id").alias(f"{tag}_r"),
            F.col("transcript_ensembl_id").alias(f"{tag}_e"),
            F.col("strand").alias(f"{tag}_s"),
        )

    pairs = rc.same_exons(side("a").withColumn("b_tx", F.col("a_tx") + 1).join(side("b"), "b_tx"), t.exons)
    return pairs.select("a_tx", "b_tx", rc.same_transcript(("a_r", "b_r"), ("a_e", "b_e"), ("a_s", "b_s")).alias("same"))


@query(
    "same_gene",
    """SELECT a.gene_key AS a_key, b.gene_key AS b_key, (a.g IS NOT DISTINCT FROM b.g AND a.e IS NOT DISTINCT FROM b.e)
         OR ((a.g IS NULL OR b.g IS NULL) AND a.e IS NOT DISTINCT FROM b.e) OR ((a.e IS NULL OR b.e IS NULL) AND a.g IS NOT DISTINCT FROM b.g) AS same
       FROM (SELECT gene_key, gene_geneid_id AS g, gene_ensembl_id AS e FROM genes) a
       JOIN (SELECT gene_key, CASE WHEN gene_key % 3 = 0 THEN gene_geneid_id END AS g, CASE WHEN gene_key % 4 = 1 THEN 'other' ELSE gene_ensembl_id END AS e FROM genes) b
         ON a.gene_key = b.gene_key""",
)
def same_gene(t: Tables) -> DataFrame:
    """Each gene against a copy that has lost or changed some of its ids."""
    other = t.genes.selectExpr(
        "gene_key AS b_key", "CASE WHEN gene_key % 3 = 0 THEN gene_geneid_id END AS g2", "CASE WHEN gene_key % 4 = 1 THEN 'other' ELSE gene_ensembl_id END AS e2"
    )
    pairs = t.genes.selectExpr("gene_key AS a_key", "gene_geneid_id AS g1", "gene_ensembl_id AS e1").join(other, F.col("a_key") == F.col("b_key"))
    return pairs.select("a_key", "b_key", rc.same_gene(("g1", "g2"), ("e1", "e2")).alias("same"))


# --- accession mapping --------------------------------------------------------

HITS_SQL = """hits AS (SELECT p.tx_key AS protein_key, (SELECT arg_max(accession, ord) FROM mapping m WHERE m.refseq_id = p.protein_refseq_id AND m.refseq_id <> '') AS refseq_hit,
         (SELECT arg_max(accession, ord) FROM mapping m WHERE m.enst_id = split_part(p.transcript_ensembl_id, '.', 1) AND m.enst_id <> '') AS ensembl_hit FROM proteins p)"""


def _keyed_proteins(t: Tables) -> DataFrame:
    return t.proteins.select(F.col("tx_key").alias("protein_key"), "protein_refseq_id", "transcript_ensembl_id")


@query(
    "id_mapping_last_wins",
    f"WITH {HITS_SQL} SELECT * FROM hits WHERE refseq_hit IS NOT NULL OR ensembl_hit IS NOT NULL",
)
def id_mapping_last_wins(t: Tables) -> DataFrame:
    return im.mapping_hits(_keyed_proteins(t), t.mapping)


@query(
    "collision_strategy",
    f"""WITH {HITS_SQL}, r AS (SELECT protein_key, refseq_hit <> ensembl_hit AS clash, coalesce(refseq_hit, ensembl_hit) AS any_hit, refseq_hit, ensembl_hit
         FROM hits WHERE refseq_hit IS NOT NULL OR ensembl_hit IS NOT NULL)
       SELECT protein_key, coalesce(clash, FALSE) AS collision, CASE WHEN clash THEN ensembl_hit ELSE any_hit END AS by_ensembl,
         CASE WHEN clash THEN refseq_hit ELSE any_hit END AS by_refseq, CASE WHEN clash THEN NULL ELSE any_hit END AS by_ignore FROM r""",
)
def collision_strategy(t: Tables) -> DataFrame:
    hits = im.mapping_hits(_keyed_proteins(t), t.mapping)
    out = im.resolve_collision(hits, "ensembl").withColumnRenamed("protein_interpro_id", "by_ensembl")
    for s in ("refseq", "ignore"):
        other = im.resolve_collision(hits, s).select("protein_key", F.col("protein_interpro_id").alias(f"by_{s}"))
        out = out.join(other, "protein_key")
    return out
