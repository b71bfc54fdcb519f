"""Queries on domains: against exons, against each other, and their types."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from splicelake.functions import text
from splicelake.operators import domains as dom
from splicelake.operators import types as ty
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query
from splicelake.session import discard, scratch, shared_dir, staged
from splicelake.sinks.tables import export_transcript_domains_csv, transcript_domains, write_texts
from splicelake.sources import interpro
from splicelake.sources.checks import read_result_csv

KEYS = ["tx_key", "type_id", "aa_start", "aa_end", "ext_id"]


@query(
    "splice_in_domains",
    """SELECT tx_key, type_id, aa_start, aa_end, ext_id, nuc_start, total_length, exon_order,
       CASE WHEN exon_order = first_exon THEN -included_abs ELSE included_abs END AS included_len, included_abs,
       CAST(piece_no AS INTEGER) AS exon_num_in_domain FROM pieces""",
)
def splice_in_domains(t: Tables) -> DataFrame:
    pieces = dom.splice_in_domains(t.domains, t.cds)
    return pieces.select(
        *KEYS, "nuc_start", "total_length", "exon_order", "included_len", "included_abs", "exon_num_in_domain"
    )


@query(
    "domain_exon_relation",
    "SELECT tx_key, type_id, aa_start, aa_end, ext_id, nuc_start, nuc_end, total_length, first_exon, relation FROM relation",
)
def domain_exon_relation(t: Tables) -> DataFrame:
    return dom.domain_exon_relation(t.domains, t.cds).select(
        *KEYS, "nuc_start", "nuc_end", "total_length", "first_exon", "relation"
    )


@query(
    "complete_domain_exon",
    """SELECT tx_key, type_id, aa_start, aa_end, ext_id, CASE WHEN relation = 'complete_exon' THEN first_exon ELSE -1 END AS exon_order
       FROM relation UNION ALL SELECT tx_key, type_id, aa_start, aa_end, ext_id, -1 FROM domains ANTI JOIN relation
       USING (tx_key, type_id, aa_start, aa_end, ext_id)""",
)
def complete_domain_exon(t: Tables) -> DataFrame:
    return dom.complete_domain_exon(t.domains, t.cds).select(*KEYS, "exon_order")


@query(
    "domain_exon_fraction",
    """SELECT s.tx_key, type_id, aa_start, aa_end, ext_id, c.order_in_transcript AS exon_order,
       (least(abs_end_cds, nuc_end) - greatest(abs_start_cds, nuc_start) + 1) / CAST(total_length AS DOUBLE) AS fraction,
       CASE WHEN abs_end_cds < nuc_end THEN (abs_end_cds - nuc_start) / CAST(nuc_end - nuc_start AS DOUBLE) END AS junction_at
       FROM spans s JOIN cds c ON s.tx_key = c.tx_key AND abs_start_cds > 0 AND abs_start_cds <= nuc_end AND abs_end_cds >= nuc_start""",
)
def domain_exon_fraction(t: Tables) -> DataFrame:
    return dom.domain_exon_fraction(t.domains, t.cds).select(*KEYS, "exon_order", "fraction", "junction_at")


@query(
    "collapse_events",
    """SELECT tx_key, type_id, aa_start, aa_end, nuc_start, nuc_end, total_length, relation = 'splice_junction' AS splice_junction,
       relation = 'complete_exon' AS complete_exon, string_agg(ext_id, '; ' ORDER BY ext_id) AS ext_id FROM relation
       GROUP BY tx_key, type_id, aa_start, aa_end, nuc_start, nuc_end, total_length, relation""",
)
def collapse_events(t: Tables) -> DataFrame:
    events = dom.domain_events(t.domains, t.cds)
    return dom.collapse_events(
        events.select(*KEYS, "nuc_start", "nuc_end", "total_length", "splice_junction", "complete_exon")
    )


@query(
    "merge_domains",
    """SELECT DISTINCT tx_key, ext_id, aa_start, aa_end FROM (SELECT tx_key, ext_id, aa_start, aa_end FROM domains
       UNION ALL SELECT CAST(substr(protein_interpro_id, 2) AS BIGINT), domain_id, "start", "end" FROM rep_domains)""",
)
def merge_domains(t: Tables) -> DataFrame:
    other = t.rep_domains.select(
        F.substr("protein_interpro_id", F.lit(2)).cast("bigint").alias("tx_key"),
        F.col("domain_id").alias("ext_id"),
        F.col("start").alias("aa_start"),
        F.col("end").alias("aa_end"),
    )
    return dom.merge_domain_lists(t.domains, other)


REP_COLUMNS = """domain_id AS type_id, "start" AS aa_start, "end" AS aa_end, ("start" - 1) * 3 + 1 AS nuc_start, "end" * 3 AS nuc_end,
       domain_id AS ext_id, CASE WHEN trim(domain_name) <> '' THEN domain_name END AS name"""


@query("rep_domain_view", f"SELECT protein_interpro_id, {REP_COLUMNS} FROM rep_domains")
def rep_domain_view(t: Tables) -> DataFrame:
    return dom.rep_domain_view(t.rep_domains)


@query(
    "domain_fallback",
    f"""SELECT CAST(substr(protein_interpro_id, 2) AS BIGINT) AS tx_key, {REP_COLUMNS}, 'representative' AS origin FROM rep_domains
       UNION ALL SELECT d.tx_key, CAST(type_id AS VARCHAR), aa_start, aa_end, aa_start * 3 - 2, aa_end * 3, ext_id, name, 'event'
       FROM domains d WHERE concat('P', CAST(d.tx_key AS VARCHAR)) NOT IN (SELECT protein_interpro_id FROM rep_domains)""",
)
def domain_fallback(t: Tables) -> DataFrame:
    proteins = t.proteins.select("tx_key", F.concat(F.lit("P"), F.col("tx_key").cast("string")).alias("protein_interpro_id"))
    return dom.domains_with_fallback(proteins, t.rep_domains, t.domains)


@query(
    "event_type_join",
    """SELECT r.tx_key, r.type_id, aa_start, aa_end, ext_id, relation, x.type_name FROM relation r
       LEFT JOIN (SELECT type_id, min(name) AS type_name FROM domains WHERE type_id % 7 <> 0 GROUP BY 1) x ON r.type_id = x.type_id""",
)
def event_type_join(t: Tables) -> DataFrame:
    types = ty.type_attributes(t.domains.withColumn("note", F.lit(None).cast("string")))
    named = types.filter("name IS NOT NULL").select("type_id", F.col("name").alias("type_name"))
    events = dom.domain_exon_relation(t.domains, t.cds).select(*KEYS, "relation")
    return events.join(named, "type_id", "left")


@query(
    "domains_text",
    """SELECT protein_refseq_id, protein_ensembl_id,
       string_agg(concat(coalesce(name, ''), ';', ext_id, ';', aa_start, '-', aa_end, ';', nuc_start, '-', nuc_end), '||'
         ORDER BY aa_start, aa_end, type_id) AS domains_info
       FROM (SELECT tx_key, type_id, aa_start, aa_end, nuc_start, nuc_end, name, replace(string_agg(ext_id, '; ' ORDER BY ext_id), '; ', '/') AS ext_id
             FROM spans GROUP BY ALL) e JOIN proteins p ON e.tx_key = p.tx_key
       GROUP BY protein_refseq_id, protein_ensembl_id""",
)
def domains_text(t: Tables) -> DataFrame:
    return _domains_text(t)


PROTEIN = ["protein_refseq_id", "protein_ensembl_id"]


def _named_events(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events with their protein, written, and the names of the types. What follows from a span is added when equal events have met."""
    collapsed = dom.with_nuc_span(dom.collapse_events(t.domains.drop("name", "cdd")))
    events = staged(collapsed.join(t.proteins.select("tx_key", *PROTEIN), "tx_key"))
    return events, t.domains.select("type_id", "name").distinct()


def _domains_text(t: Tables) -> DataFrame:
    with scratch(t.spark):
        return staged(dom.domains_text(*_named_events(t), PROTEIN), kept=True)


DOMAIN_ITEMS_SQL = """SELECT *, row_number() OVER (PARTITION BY protein_refseq_id, protein_ensembl_id ORDER BY aa_start, aa_end, type_id, item) AS position
       FROM (SELECT protein_refseq_id, protein_ensembl_id, aa_start, aa_end, type_id,
               concat(coalesce(name, ''), ';', ext_id, ';', aa_start, '-', aa_end, ';', nuc_start, '-', nuc_end) AS item
             FROM (SELECT tx_key, type_id, aa_start, aa_end, nuc_start, nuc_end, name, replace(string_agg(ext_id, '; ' ORDER BY ext_id), '; ', '/') AS ext_id
                   FROM spans GROUP BY ALL) e JOIN proteins p ON e.tx_key = p.tx_key)"""


@query("domains_text_items", f"SELECT protein_refseq_id, protein_ensembl_id, position, item FROM ({DOMAIN_ITEMS_SQL})")
def domains_text_items(t: Tables) -> DataFrame:
    events, types = _named_events(t)
    items = dom.domain_items(events, types, PROTEIN)
    discard(events)  # the items are written
    return items


@query(
    "domains_text_pieces",
    f"""SELECT protein_refseq_id, protein_ensembl_id, (position - 1) // 3 AS piece, string_agg(item, '||' ORDER BY position) AS text
        FROM ({DOMAIN_ITEMS_SQL}) GROUP BY ALL""",
)
def domains_text_pieces(t: Tables) -> DataFrame:
    """Domain texts as stored: pieces of three items, written and read back."""
    spark = t.domains.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/texts/{uuid.uuid4().hex}"
    write_texts(domains_text_items(t), folder, "domains_text", PROTEIN, sep="||", per_piece=3)
    return spark.read.parquet(f"{folder}/domains_text")


EXPORT_SQL = """WITH texts AS (SELECT coalesce(protein_refseq_id, '') AS r, coalesce(protein_ensembl_id, '') AS e,
         string_agg(concat(coalesce(name, ''), ';', ext_id, ';', aa_start, '-', aa_end, ';', nuc_start, '-', nuc_end), '||'
           ORDER BY aa_start, aa_end, type_id) AS domains_info
         FROM (SELECT tx_key, type_id, aa_start, aa_end, nuc_start, nuc_end, name, replace(string_agg(ext_id, '; ' ORDER BY ext_id), '; ', '/') AS ext_id
               FROM spans GROUP BY ALL) e JOIN proteins p ON e.tx_key = p.tx_key GROUP BY 1, 2)
       SELECT coalesce(g.gene_geneid_id, '') AS gene_geneid_id, coalesce(g.gene_ensembl_id, '') AS gene_ensembl_id, gene_symbol, specie AS species,
         coalesce(transcript_refseq_id, '') AS transcript_refseq_id, coalesce(transcript_ensembl_id, '') AS transcript_ensembl_id,
         coalesce(protein_refseq_id, '') AS protein_refseq_id, coalesce(protein_ensembl_id, '') AS protein_ensembl_id, domains_info
       FROM transcripts t JOIN genes g ON t.gene_key = g.gene_key
       FULL JOIN texts ON coalesce(protein_refseq_id, '') = r AND coalesce(protein_ensembl_id, '') = e"""


@query("outer_join_domains", EXPORT_SQL)
def outer_join_domains(t: Tables) -> DataFrame:
    return transcript_domains(t.genes, t.transcripts, _domains_text(t))


@query("export_transcript_domains", EXPORT_SQL)
def export_transcript_domains(t: Tables) -> DataFrame:
    """The same rows written as the CSV export and read back from it, where an empty id is an empty cell."""
    folder = t.folder("export", uuid.uuid4().hex)
    export_transcript_domains_csv(transcript_domains(t.genes, t.transcripts, _domains_text(t)), folder)
    ids = [f"{kind}_{source}_id" for kind, source in itertools.product(("transcript", "protein"), ("refseq", "ensembl"))]
    return read_result_csv(t.spark, f"{folder}/all_species").na.fill("", ["gene_geneid_id", "gene_ensembl_id", *ids])


# --- intervals ----------------------------------------------------------------


@query(
    "overlap_flag",
    """SELECT a.tx_key, a.type_id, a.aa_start, a.aa_end, a.ext_id, count(b.rid) > 0 AS overlap FROM span_rows a
       LEFT JOIN span_rows b ON a.tx_key = b.tx_key AND a.rid <> b.rid AND a.aa_start <= b.aa_end AND a.aa_end >= b.aa_start
       GROUP BY a.rid, a.tx_key, a.type_id, a.aa_start, a.aa_end, a.ext_id""",
)
def overlap_flag(t: Tables) -> DataFrame:
    return dom.overlap_flags(t.domains).select(*KEYS, "overlap")


@query(
    "overlap_islands",
    """SELECT tx_key, type_id, aa_start, aa_end, ext_id, island, min(aa_start) OVER w AS group_start, max(aa_end) OVER w AS group_end,
       count(*) OVER w AS n_domains FROM islands WINDOW w AS (PARTITION BY tx_key, island)""",
)
def overlap_islands(t: Tables) -> DataFrame:
    return dom.overlap_groups(t.domains).select(*KEYS, "island", "group_start", "group_end", "n_domains")


CLOSE_SQL = """WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY tx_key ORDER BY aa_start, aa_end DESC, type_id, ext_id) AS rn FROM labelled),
       fold AS (SELECT tx_key, rn, aa_start AS gs, aa_end AS ge, 1 AS grp FROM seq WHERE rn = 1
         UNION ALL SELECT s.tx_key, s.rn, CASE WHEN j THEN least(gs, aa_start) ELSE aa_start END, CASE WHEN j THEN greatest(ge, aa_end) ELSE aa_end END,
           CASE WHEN j THEN grp ELSE grp + 1 END
         FROM (SELECT s.*, gs, ge, grp, (s.aa_end <= ge AND gs <= s.aa_start) OR (s.aa_end >= ge AND gs >= s.aa_start)
               OR (least(ge, s.aa_end) - greatest(gs, s.aa_start)) >= 0.5 * (greatest(ge, s.aa_end) - least(gs, s.aa_start)) AS j
               FROM fold f JOIN seq s ON s.tx_key = f.tx_key AND s.rn = f.rn + 1) s),
       grouped AS (SELECT q.*, f.grp FROM seq q JOIN fold f ON q.tx_key = f.tx_key AND q.rn = f.rn)"""


@query(
    "close_groups",
    CLOSE_SQL
    + """ SELECT tx_key, type_id, aa_start, aa_end, ext_id, min(aa_start) OVER w AS group_start, max(aa_end) OVER w AS group_end,
       count(*) OVER w AS n_domains FROM grouped WINDOW w AS (PARTITION BY tx_key, grp)""",
)
def close_groups(t: Tables) -> DataFrame:
    keys = ["tx_key", "island", "group_at"]
    grouped = staged(dom.close_groups(t.domains))
    return grouped.select(*KEYS, *keys[1:]).join(dom.group_extents(grouped, keys), keys).drop("island", "group_at")


@query(
    "group_name",
    CLOSE_SQL
    + """, label_counts AS (SELECT tx_key, grp, label, count(*) AS n FROM grouped GROUP BY tx_key, grp, label),
       counts AS (SELECT *, sum(n) OVER (PARTITION BY tx_key, grp) AS total FROM label_counts),
       major AS (SELECT tx_key, grp, label FROM counts WHERE n * 2 > total),
       firsts AS (SELECT tx_key, grp, arg_min(label, row(aa_start, -aa_end, label)) AS label, arg_min(aa_end - aa_start, row(aa_start, -aa_end, label)) AS len
         FROM grouped GROUP BY tx_key, grp),
       best AS (SELECT tx_key, grp, max(aa_end - aa_start) AS len, arg_min(label, row(-(aa_end - aa_start), length(label), label)) AS label
         FROM grouped WHERE NOT regexp_matches(label, '^(?i:smart|pfam|tigr|ipr)[0-9]+$|^cd[0-9]+$') GROUP BY tx_key, grp),
       sizes AS (SELECT tx_key, grp, min(aa_start) AS group_start, max(aa_end) AS group_end, count(*) AS n_domains FROM grouped GROUP BY tx_key, grp)
       SELECT s.tx_key, group_start, group_end, n_domains, CASE WHEN m.label IS NOT NULL THEN m.label WHEN b.len > f.len THEN b.label
         WHEN b.len = f.len AND length(b.label) < length(f.label) THEN b.label ELSE f.label END AS group_name
       FROM sizes s JOIN firsts f USING (tx_key, grp) LEFT JOIN major m USING (tx_key, grp) LEFT JOIN best b USING (tx_key, grp)""",
)
def group_name(t: Tables) -> DataFrame:
    keys = ["tx_key", "island", "group_at"]
    labelled = t.domains.withColumn(
        "label", text.domain_label(F.col("name"), F.lit(None).cast("string"), F.col("ext_id"))
    )
    grouped = staged(dom.close_groups(labelled))
    named = dom.group_names(grouped, keys, "label").drop("n_domains")
    return dom.group_extents(grouped, keys).join(named, keys).drop("island", "group_at")


@query(
    "max_overlap_depth",
    CLOSE_SQL + " SELECT tx_key, max(n) AS max_depth FROM (SELECT tx_key, grp, count(*) AS n FROM grouped GROUP BY ALL) GROUP BY tx_key",
)
def max_overlap_depth(t: Tables) -> DataFrame:
    return dom.max_overlap_depth(dom.close_groups(t.domains), ["island", "group_at"])


@query(
    "rank_domains",
    """SELECT tx_key, type_id, aa_start, aa_end, ext_id, row_number() OVER (PARTITION BY tx_key
       ORDER BY aa_start - aa_end, aa_start, type_id, ext_id) AS draw_rank FROM domains""",
)
def rank_domains(t: Tables) -> DataFrame:
    """Longest domain first, ties by position and type."""
    return dom.rank_domains(t.domains.select(*KEYS))


# --- types --------------------------------------------------------------------


@query("interpro_index", "SELECT source, ext_id, accession, entry_type FROM entry_index")
def interpro_index(t: Tables) -> DataFrame:
    return interpro.entry_index(t.entries)


@query(
    "interpro_columns",
    """SELECT accession, entry_type, string_agg(ext_id, '; ' ORDER BY ext_id) FILTER (source = 'interpro') AS interpro,
       string_agg(ext_id, '; ' ORDER BY ext_id) FILTER (source = 'pfam') AS pfam, string_agg(ext_id, '; ' ORDER BY ext_id) FILTER (source = 'smart') AS smart,
       string_agg(ext_id, '; ' ORDER BY ext_id) FILTER (source = 'cdd') AS cdd, string_agg(ext_id, '; ' ORDER BY ext_id) FILTER (source = 'tigrfams') AS tigrfams
       FROM entry_index GROUP BY accession, entry_type""",
)
def interpro_columns(t: Tables) -> DataFrame:
    return interpro.entry_columns(interpro.entry_index(t.entries))


ELIGIBLE_SQL = """verdicts AS (SELECT d.*, x.accession, x.entry_type,
         CASE WHEN x.accession IS NOT NULL AND d.type_id % 5 = 4 AND x.accession NOT IN (SELECT accession FROM entry_index WHERE source <> 'interpro') THEN 'only_interpro'
         WHEN x.accession IS NOT NULL AND x.entry_type NOT IN ('domain', 'repeat') THEN 'other_entry_type'
         WHEN d.type_id % 5 = 4 THEN 'name_only' ELSE 'used' END AS verdict
         FROM domains d LEFT JOIN entry_index x ON lower(d.ext_id) = lower(x.ext_id)
           AND x.source = CASE d.type_id % 5 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cdd' WHEN 3 THEN 'tigrfams' ELSE 'interpro' END)"""


@query(
    "eligible_domains",
    f"""WITH {ELIGIBLE_SQL} SELECT tx_key, type_id, aa_start, aa_end, ext_id, accession, verdict,
       CASE WHEN entry_type = 'repeat' THEN 'Repeat_domain' END AS note FROM verdicts""",
)
def eligible_domains(t: Tables) -> DataFrame:
    return ty.eligible_domains(t.domains, interpro.entry_index(t.entries)).select(*KEYS, "accession", "verdict", "note")


@query(
    "dropped_domains",
    f"""WITH {ELIGIBLE_SQL} SELECT count(*) AS domains, {", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ty.VERDICTS)} FROM verdicts""",
)
def dropped_domains(t: Tables) -> DataFrame:
    """Kept and dropped domains, counted by the pass that writes the labelled ones."""
    counts = Observation()
    staged(ty.observe_verdicts(ty.eligible_domains(t.domains, interpro.entry_index(t.entries)), counts))
    return t.spark.createDataFrame([counts.get], ", ".join(f"{c} bigint" for c in ("domains", *ty.VERDICTS)))


def _linked(t: Tables) -> DataFrame:
    """What the kept domains say of their accessions. A verdict depends on the accession alone, so the many domains of one are judged once."""
    told = t.domains.select("ext_id", "cdd", "name").distinct()
    good = ty.eligible_domains(told, interpro.entry_index(t.entries)).filter("verdict IN ('used', 'name_only')")
    return staged(good.select("ext_id", "accession", "cdd", "name", "note", "entry_type").distinct())


COMPONENT_SQL = f"""WITH RECURSIVE {ELIGIBLE_SQL},
       edges AS (SELECT DISTINCT ext_id AS node, 'i' || accession AS hub FROM verdicts WHERE verdict IN ('used', 'name_only') AND accession IS NOT NULL
         UNION SELECT DISTINCT ext_id, 'c' || cdd FROM verdicts WHERE verdict IN ('used', 'name_only') AND cdd IS NOT NULL
         UNION SELECT DISTINCT ext_id, 'x' || ext_id FROM verdicts WHERE verdict IN ('used', 'name_only')),
       steps AS (SELECT DISTINCT a.node AS a, b.node AS b FROM edges a JOIN edges b ON a.hub = b.hub),
       closure AS (SELECT a, b FROM steps UNION SELECT c.a, s.b FROM closure c JOIN steps s ON c.b = s.a),
       comps AS (SELECT a AS node, min(b) AS component FROM closure GROUP BY a)"""


@query("domain_components", COMPONENT_SQL + " SELECT node, component FROM comps")
def domain_components(t: Tables) -> DataFrame:
    return ty.resolve_domain_types(ty.type_edges(_linked(t)))


@query(
    "domain_components_by_name",
    COMPONENT_SQL.replace(
        "UNION SELECT DISTINCT ext_id, 'x'",
        "UNION SELECT DISTINCT ext_id, 'n' || regexp_replace(lower(name), '[_ ][0-9]+$', '') FROM verdicts "
        "WHERE verdict IN ('used', 'name_only') AND name IS NOT NULL UNION SELECT DISTINCT ext_id, 'x'",
    )
    + " SELECT node, component FROM comps",
)
def domain_components_by_name(t: Tables) -> DataFrame:
    return ty.resolve_domain_types(ty.type_edges(_linked(t), by_name=True))


@query(
    "type_attributes",
    COMPONENT_SQL
    + """, facts AS (SELECT DISTINCT component, v.ext_id, v.type_id % 5 AS src, cdd, name, CASE WHEN entry_type = 'repeat' THEN 'Repeat_domain' END AS note
         FROM verdicts v JOIN comps ON v.ext_id = node WHERE verdict IN ('used', 'name_only')),
       lists AS (SELECT component, arg_min(name, row(length(name), name)) FILTER (name IS NOT NULL) AS name,
         list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))) AS names, string_agg(DISTINCT note, '; ' ORDER BY note) AS description,
         string_agg(DISTINCT cdd, '; ' ORDER BY cdd) AS cdd_id,
         string_agg(DISTINCT ext_id, '; ' ORDER BY ext_id) FILTER (src = 2) AS cdd, string_agg(DISTINCT ext_id, '; ' ORDER BY ext_id) FILTER (src = 0) AS pfam,
         string_agg(DISTINCT ext_id, '; ' ORDER BY ext_id) FILTER (src = 1) AS smart, string_agg(DISTINCT ext_id, '; ' ORDER BY ext_id) FILTER (src = 3) AS tigr,
         string_agg(DISTINCT ext_id, '; ' ORDER BY ext_id) FILTER (src = 4) AS interpro FROM facts GROUP BY component)
       SELECT dense_rank() OVER (ORDER BY component) AS type_id, name,
         nullif(array_to_string(list_filter(names, lambda n: n <> name), '; '), '') AS other_name, description, cdd_id, cdd, pfam, smart, tigr, interpro FROM lists""",
)
def type_attributes(t: Tables) -> DataFrame:
    linked = _linked(t)
    numbered = ty.number_types(ty.resolve_domain_types(ty.type_edges(linked)))
    return ty.type_attributes(linked.join(numbered, "ext_id"))


@query(
    "type_attribute_items",
    COMPONENT_SQL
    + """, facts AS (SELECT DISTINCT component, v.ext_id, v.type_id % 5 AS src, cdd, name, CASE WHEN entry_type = 'repeat' THEN 'Repeat_domain' END AS note
         FROM verdicts v JOIN comps ON v.ext_id = node WHERE verdict IN ('used', 'name_only')),
       ids AS (SELECT component, dense_rank() OVER (ORDER BY component) AS type_id FROM (SELECT DISTINCT component FROM facts)),
       heads AS (SELECT component, arg_min(name, row(length(name), name)) AS main FROM facts WHERE name IS NOT NULL GROUP BY component),
       long AS (SELECT component, CASE WHEN name = main THEN 'name' ELSE 'other_name' END AS attribute, name AS item FROM facts JOIN heads USING (component)
         WHERE name IS NOT NULL
         UNION SELECT component, 'description', note FROM facts WHERE note IS NOT NULL UNION SELECT component, 'cdd_id', cdd FROM facts WHERE cdd IS NOT NULL
         UNION SELECT component, ['pfam', 'smart', 'cdd', 'tigr', 'interpro'][src + 1], ext_id FROM facts)
       SELECT type_id, attribute, row_number() OVER (PARTITION BY type_id, attribute ORDER BY item) AS position, item FROM long JOIN ids USING (component)""",
)
def type_attribute_items(t: Tables) -> DataFrame:
    linked = _linked(t)
    numbered = ty.number_types(ty.resolve_domain_types(ty.type_edges(linked)))
    return ty.type_attribute_items(linked.join(numbered, "ext_id"))


@query(
    "stable_ids",
    COMPONENT_SQL
    + """, old AS (SELECT DISTINCT ext_id, type_id * 10 AS type_id FROM domains WHERE type_id % 5 < 2),
       seen AS (SELECT component, min(type_id) AS old_id FROM comps LEFT JOIN old ON ext_id = node GROUP BY component),
       fresh AS (SELECT component, coalesce((SELECT max(type_id) FROM old), 0) + row_number() OVER (ORDER BY component) AS type_id FROM seen WHERE old_id IS NULL)
       SELECT node AS ext_id, coalesce(old_id, f.type_id) AS type_id FROM comps JOIN seen USING (component) LEFT JOIN fresh f USING (component)""",
)
def stable_ids(t: Tables) -> DataFrame:
    """Earlier types are known for Pfam and SMART accessions only."""
    previous = t.domains.filter("type_id % 5 < 2").select("ext_id", (F.col("type_id") * 10).alias("type_id")).distinct()
    return ty.number_types(ty.resolve_domain_types(ty.type_edges(_linked(t))), previous)


@query(
    "relevant_types",
    """SELECT DISTINCT type_id, cdd FROM domains WHERE type_id IN (SELECT type_id FROM relation WHERE relation = 'splice_junction')
       OR type_id IN (SELECT type_id FROM domains WHERE tx_key % 2 = 0 AND type_id % 3 = 0)""",
)
def relevant_types(t: Tables) -> DataFrame:
    types = t.domains.select("type_id", "cdd").distinct()
    cut = dom.domain_events(t.domains, t.cds, events="cut")
    previous = t.domains.filter("tx_key % 2 = 0 AND type_id % 3 = 0")
    return ty.relevant_types(types, cut, previous)
