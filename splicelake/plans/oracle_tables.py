"""The derived tables as SQL, for checking query results on another engine."""

from __future__ import annotations

import re

from splicelake.plans import derived as d


def _cols(formulas: dict[str, str]) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in formulas.items())


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
ORDER = "PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity"

CTES: dict[str, str] = {
    "genes": f"SELECT {_cols(d.GENE)} FROM customer",
    "exon_runs": f"""SELECT o_orderkey AS tx_key, o_custkey AS gene_key, {d.EXON_LEN} AS len,
        row_number() OVER ({ORDER}) AS ord,
        CAST(sum({d.EXON_LEN} + 200) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM {LINES}""",
    "exons": f"SELECT {_cols(d.EXON)} FROM exon_runs",
    "tx_spans": """SELECT tx_key, e.gene_key, gene_geneid_id, gene_ensembl_id, min(genomic_start_tx) AS tx_start,
        max(genomic_end_tx) AS tx_end, count(*) AS exon_count
        FROM exons e JOIN genes g ON e.gene_key = g.gene_key GROUP BY ALL""",
    "transcripts": f"SELECT {_cols(d.TRANSCRIPT)} FROM tx_spans",
    "exon_coding": """SELECT e.*, greatest(0, least(genomic_end_tx, coalesce(cds_end, tx_end))
        - greatest(genomic_start_tx, coalesce(cds_start, tx_start))) AS clen
        FROM exons e JOIN transcripts t ON e.tx_key = t.tx_key""",
    "exon_cum": """SELECT *, CAST(sum(clen) OVER (PARTITION BY tx_key ORDER BY order_in_transcript
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM exon_coding""",
    "cds": """SELECT tx_key, gene_key, order_in_transcript, genomic_start_tx, genomic_end_tx,
        CAST(CASE WHEN clen > 0 THEN cum - clen + 1 ELSE 0 END AS BIGINT) AS abs_start_cds,
        CAST(CASE WHEN clen > 0 THEN cum ELSE 0 END AS BIGINT) AS abs_end_cds FROM exon_cum""",
    "coding_ends": "SELECT tx_key, max(abs_end_cds) AS coding_end FROM cds GROUP BY tx_key",
    "proteins": f"""SELECT {_cols(d.PROTEIN)} FROM (SELECT t.*, coding_end FROM transcripts t
        JOIN coding_ends c ON t.tx_key = c.tx_key
        WHERE protein_refseq_id IS NOT NULL OR protein_ensembl_id IS NOT NULL)""",
    "domain_lines": f"""SELECT o_orderkey AS tx_key, l_linenumber, {d.TYPE_ID.replace('gene_key', 'o_custkey')} AS type_id,
        1 + l_suppkey % 40 AS aa_start, 5 + l_suppkey % 40 + l_partkey % 30 AS aa_end FROM {LINES}""",
    "domains": f"""SELECT DISTINCT {_cols(d.DOMAIN)} FROM (SELECT l.*, length FROM domain_lines l
        JOIN proteins p ON l.tx_key = p.tx_key WHERE aa_end <= length)""",
    "rep_domains": f"SELECT {_cols(d.REP_DOMAIN)} FROM domains WHERE type_id % 3 = 0 AND tx_key % 2 = 0",
    "entry_nos": f"SELECT DISTINCT {d.ENTRY_NO} AS k FROM domains",
    "entry_heads": f"SELECT k, {_cols(d.ENTRY)} FROM entry_nos",
    "entry_index": f"""SELECT DISTINCT {d.MEMBER_SOURCE} AS source, lower(ext_id) AS ext_id, accession, entry_type
        FROM domains JOIN entry_heads ON {d.ENTRY_NO} = k WHERE type_id % 5 <> 4 AND k % 6 <> 5
        UNION ALL SELECT 'interpro', accession, accession, entry_type FROM entry_heads""",
    "crosswalk_raw": f"SELECT {_cols(d.CROSSWALK)} FROM transcripts WHERE tx_key % 7 <> 0",
    "crosswalk": """SELECT nullif(gene_id, '-') AS gene_id, nullif(ens_gene, '-') AS ens_gene,
        CASE WHEN mito THEN concat('mito-', gene_id) ELSE nullif(refseq_tx, '-') END AS refseq_tx,
        CASE WHEN mito THEN concat('mito-', ens_gene) ELSE nullif(ens_tx, '-') END AS ens_tx,
        nullif(refseq_prot, '-') AS refseq_prot, nullif(ens_prot, '-') AS ens_prot, ord
        FROM (SELECT *, refseq_tx = '-' AND ens_tx = '-' AND gene_id <> '-' AND ens_gene <> '-'
              AND refseq_prot <> '-' AND ens_prot <> '-' AS mito FROM crosswalk_raw)""",
    "gmap": """SELECT id, arg_min_null(other, ord) AS other FROM (SELECT gene_id AS id, ens_gene AS other, ord FROM crosswalk
        UNION ALL SELECT ens_gene, gene_id, ord FROM crosswalk) WHERE id IS NOT NULL GROUP BY id""",
    "tmap": """SELECT id, arg_max_null(other, ord) AS other FROM (SELECT refseq_tx AS id, ens_tx AS other, ord FROM crosswalk
        UNION ALL SELECT ens_tx, refseq_tx, ord FROM crosswalk) WHERE id IS NOT NULL GROUP BY id""",
    "pmap": """SELECT id, arg_max_null(other, ord) AS other FROM (SELECT refseq_prot AS id, ens_prot AS other, ord FROM crosswalk
        UNION ALL SELECT ens_prot, refseq_prot, ord FROM crosswalk) WHERE id IS NOT NULL GROUP BY id""",
    "t2p": """SELECT refseq_tx AS id, arg_max_null(refseq_prot, ord) AS other FROM crosswalk
        WHERE refseq_tx IS NOT NULL GROUP BY 1""",
    "p2t": """SELECT refseq_prot AS id, arg_max_null(refseq_tx, ord) AS other FROM crosswalk
        WHERE refseq_prot IS NOT NULL GROUP BY 1""",
    "t2g": """SELECT id, arg_max_null(other, ord) AS other FROM (SELECT refseq_tx AS id, gene_id AS other, ord FROM crosswalk
        UNION ALL SELECT ens_tx, ens_gene, ord FROM crosswalk) WHERE id IS NOT NULL GROUP BY id""",
    "idnov": """SELECT split_part(f, '.', 1) AS id, arg_max(f, ord * 10 + place) AS other FROM (
        SELECT gene_id AS f, ord, 0 AS place FROM crosswalk UNION ALL SELECT ens_gene, ord, 1 FROM crosswalk
        UNION ALL SELECT refseq_tx, ord, 2 FROM crosswalk UNION ALL SELECT ens_tx, ord, 3 FROM crosswalk
        UNION ALL SELECT refseq_prot, ord, 4 FROM crosswalk UNION ALL SELECT ens_prot, ord, 5 FROM crosswalk)
        WHERE f IS NOT NULL GROUP BY 1""",
    "tx_lengths": "SELECT t.*, p.length FROM transcripts t LEFT JOIN proteins p ON t.tx_key = p.tx_key",
    "source_a": f"""SELECT {_cols(d.SOURCE_A)} FROM tx_lengths
        WHERE transcript_refseq_id IS NOT NULL AND gene_geneid_id IS NOT NULL""",
    "source_b": f"""SELECT {_cols(d.SOURCE_B)} FROM tx_lengths
        WHERE transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL""",
    "transcripts_dup": f"SELECT {_cols(d.TRANSCRIPT_DUP)} FROM transcripts",
    "ortholog_rows": """SELECT a.gene_ensembl_id AS a_id, a.specie AS a_species, b.gene_ensembl_id AS b_id, b.specie AS b_species
        FROM genes a JOIN genes b ON a.family = b.family AND a.specie < b.specie
        WHERE a.gene_ensembl_id IS NOT NULL AND b.gene_ensembl_id IS NOT NULL""",
    "orthology": """SELECT DISTINCT a_id AS a_ensembl_id, upper(a.gene_symbol) AS a_genesymb, a_species,
        b_id AS b_ensembl_id, upper(b.gene_symbol) AS b_genesymb, b_species FROM ortholog_rows
        JOIN genes a ON a.gene_ensembl_id = a_id AND a.specie = a_species
        JOIN genes b ON b.gene_ensembl_id = b_id AND b.specie = b_species""",
    "search_terms": f"""SELECT DISTINCT term, species FROM (SELECT {_cols(d.GENE_TERM)} FROM genes
        UNION ALL SELECT {_cols(d.TRANSCRIPT_TERM)} FROM transcripts) WHERE term IS NOT NULL""",
    "mapping": f"""SELECT {_cols(d.MAP_FIRST)} FROM proteins
        UNION ALL SELECT {_cols(d.MAP_SECOND)} FROM proteins WHERE {d.MAP_SECOND_ROWS}""",
    # Shared intermediate results of several checks.
    "spans": "SELECT *, aa_start * 3 - 2 AS nuc_start, aa_end * 3 AS nuc_end, aa_end * 3 - aa_start * 3 + 3 AS total_length FROM domains",
    "relation": """SELECT s.*, c.order_in_transcript AS first_exon,
        CASE WHEN nuc_end <= abs_end_cds THEN 'complete_exon' ELSE 'splice_junction' END AS relation
        FROM spans s JOIN cds c ON s.tx_key = c.tx_key AND abs_start_cds > 0 AND nuc_start BETWEEN abs_start_cds AND abs_end_cds""",
    "pieces": """SELECT r.*, c.order_in_transcript AS exon_order,
        least(abs_end_cds, nuc_end) - greatest(abs_start_cds, nuc_start) + 1 AS included_abs,
        row_number() OVER (PARTITION BY r.tx_key, type_id, aa_start, aa_end, ext_id ORDER BY c.order_in_transcript) AS piece_no
        FROM relation r JOIN cds c ON r.tx_key = c.tx_key AND abs_start_cds > 0 AND abs_start_cds <= nuc_end AND abs_end_cds >= nuc_start
        WHERE relation = 'splice_junction'""",
    "exon_types": """SELECT tx_key, first_exon AS ord, type_id, count(*) AS n FROM relation
        WHERE relation = 'complete_exon' GROUP BY ALL""",
    "exon_feats": """SELECT c.gene_key, c.tx_key, c.order_in_transcript AS ord, genomic_start_tx AS s, genomic_end_tx AS e,
        abs_end_cds - abs_start_cds AS clen, CAST(coalesce(sum(n), 0) AS BIGINT) AS held
        FROM cds c LEFT JOIN exon_types x ON c.tx_key = x.tx_key AND c.order_in_transcript = x.ord
        GROUP BY c.gene_key, c.tx_key, c.order_in_transcript, genomic_start_tx, genomic_end_tx, abs_end_cds, abs_start_cds""",
    "tx_next": """SELECT tx_key AS a_tx, lead(tx_key) OVER (PARTITION BY gene_key ORDER BY tx_key) AS b_tx FROM transcripts""",
    "labelled": "SELECT *, coalesce(CASE WHEN trim(name) <> '' THEN name END, ext_id) AS label FROM domains",
    "span_rows": "SELECT *, row_number() OVER (ORDER BY tx_key, aa_start, aa_end DESC, type_id, ext_id) AS rid FROM domains",
    "islands": """SELECT *, CAST(sum(CASE WHEN prev_end >= aa_start THEN 0 ELSE 1 END) OVER (PARTITION BY tx_key ORDER BY aa_start, aa_end DESC, type_id, ext_id
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, max(aa_end) OVER (PARTITION BY tx_key
        ORDER BY aa_start, aa_end DESC, type_id, ext_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM domains)""",
}


def needed(sql: str) -> list[str]:
    """Names of the derived tables a statement uses, dependencies first."""
    found: list[str] = []

    def visit(text: str, local: frozenset[str]) -> None:
        for name in CTES:
            if name not in found and name not in local and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name], frozenset())
                if name not in found:
                    found.append(name)

    visit(sql, frozenset())
    return found


def with_tables(sql: str) -> str:
    """Prefix a statement with the derived tables it uses."""
    names = needed(sql)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    own = re.match(r"(?is)^with\s+(?:recursive\s+)?", body)
    parts = [f"{n} AS ({CTES[n]})" for n in names]
    if own:
        rest = body[own.end():]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*parts, rest])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
