"""Id crosswalk between the two annotation sources and everything looked up in it.

The crosswalk table has one row per transcript: ``tax_id, gene_id, ens_gene,
refseq_tx, ens_tx, refseq_prot, ens_prot, ord`` with nulls for absent ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions.ids import dash_to_null, strip_version
from splicelake.session import scratch, staged

ID_COLUMNS = ("gene_id", "ens_gene", "refseq_tx", "ens_tx", "refseq_prot", "ens_prot")


def clean_crosswalk(raw: DataFrame, tax_id: int | None = None) -> DataFrame:
    """``-`` becomes null; a row missing only both transcripts gets mitochondrial placeholders."""
    rows = raw if tax_id is None else raw.filter(F.col("tax_id") == tax_id)
    others = [c for c in ID_COLUMNS if c not in ("refseq_tx", "ens_tx")]
    mito = (F.col("refseq_tx") == "-") & (F.col("ens_tx") == "-")
    for c in others:
        mito = mito & (F.col(c) != "-")
    named = rows.withColumn("_mito", mito)
    named = named.withColumn(
        "refseq_tx", F.when(F.col("_mito"), F.concat(F.lit("mito-"), "gene_id")).otherwise(F.col("refseq_tx"))
    ).withColumn("ens_tx", F.when(F.col("_mito"), F.concat(F.lit("mito-"), "ens_gene")).otherwise(F.col("ens_tx")))
    return named.select(
        *[dash_to_null(F.col(c)).alias(c) if c in ID_COLUMNS else F.col(c) for c in raw.columns]
    )


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of one id pair as (id, other, ord)."""
    sides = [
        rows.select(F.col(x).alias("id"), F.col(y).alias("other"), "ord").filter("id IS NOT NULL")
        for x, y in ((a, b), (b, a))
    ]
    return sides[0].unionByName(sides[1])


def gene_map(rows: DataFrame) -> DataFrame:
    """The first pairing of a gene id wins."""
    return _pairs(rows, "gene_id", "ens_gene").groupBy("id").agg(F.min_by("other", "ord").alias("other"))


def transcript_map(rows: DataFrame) -> DataFrame:
    """The last pairing of a transcript id wins."""
    return _pairs(rows, "refseq_tx", "ens_tx").groupBy("id").agg(F.max_by("other", "ord").alias("other"))


def protein_map(rows: DataFrame) -> DataFrame:
    return _pairs(rows, "refseq_prot", "ens_prot").groupBy("id").agg(F.max_by("other", "ord").alias("other"))


def versionless(rows: DataFrame) -> DataFrame:
    """Id without version to the last full id seen for it."""
    columns = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("full")) for i, c in enumerate(ID_COLUMNS)])
    stacked = rows.select("ord", F.inline(columns)).filter("full IS NOT NULL")
    return stacked.groupBy(strip_version(F.col("full")).alias("id")).agg(
        F.max_by("full", F.struct("ord", "place")).alias("other")
    )


def look_up(df: DataFrame, key: str, table: DataFrame, out: str) -> DataFrame:
    """Left join ``df.key`` to an (id, other) map; the answer is column ``out``."""
    renamed = table.select(F.col("id").alias(f"_{out}_id"), F.col("other").alias(out))
    return df.join(renamed, F.col(key) == F.col(f"_{out}_id"), "left").drop(f"_{out}_id")


def crosswalk_facts(rows: DataFrame) -> DataFrame:
    """Everything the crosswalk knows about an id, one row per id, computed once.

    Columns: ``id``; ``gene_other``, ``tx_other``, ``prot_other`` (the same thing
    in the other source); ``gene`` of a transcript; ``loose_gene`` of an id
    without version; ``answer``, the protein of a transcript or transcript of a
    protein. The answer comes from the first of these that knows the id, even when
    it is null: own pairing, reverse pairing, the other source's transcript, the
    other source's protein.
    """
    with scratch(rows.sparkSession):
        return staged(_facts(rows), kept=True)


def _facts(rows: DataFrame) -> DataFrame:
    def last(id_column: str, **values: str) -> DataFrame:
        """Last crosswalk row of every id in one column."""
        fields = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
        return (
            rows.filter(F.col(id_column).isNotNull())
            .groupBy(F.col(id_column).alias("id"))
            .agg(F.max_by(fields, "ord").alias("v"))
            .select("id", "v.*")
        )

    def padded(df: DataFrame, **columns: str | None) -> DataFrame:
        return df.select(
            "id", *[(F.lit(None).cast("string") if c is None else F.col(c)).alias(n) for n, c in columns.items()]
        )

    ref_tx = staged(last("refseq_tx", other="ens_tx", mate="refseq_prot", gene="gene_id"))
    ens_tx = staged(last("ens_tx", other="refseq_tx", gene="ens_gene"))
    ref_prot = staged(last("refseq_prot", other="ens_prot", mate="refseq_tx"))
    ens_prot = staged(last("ens_prot", other="refseq_prot"))

    def via(df: DataFrame, mates: DataFrame, back: DataFrame) -> DataFrame:
        """Add ``answer`` through the other source: its mate there, brought back over the id pairing."""
        mate = mates.select(F.col("id").alias("other"), F.col("mate").alias("_mate"))
        home = back.select(F.col("id").alias("_mate"), F.col("other").alias("answer"))
        return df.join(mate, "other", "left").join(home, "_mate", "left")

    tx_facts = padded(
        ref_tx, gene_other=None, tx_other="other", prot_other=None, gene="gene", answer="mate"
    ).unionByName(
        padded(
            via(ens_tx, ref_tx, ref_prot), gene_other=None, tx_other="other", prot_other=None, gene="gene", answer="answer"
        )
    )
    prot_facts = padded(
        ref_prot, gene_other=None, tx_other=None, prot_other="other", gene=None, answer="mate"
    ).unionByName(
        padded(
            via(ens_prot, ref_prot, ref_tx), gene_other=None, tx_other=None, prot_other="other", gene=None, answer="answer"
        )
    )
    gene_facts = padded(
        gene_map(rows), gene_other="other", tx_other=None, prot_other=None, gene=None, answer=None
    )
    exact = tx_facts.unionByName(prot_facts).unionByName(gene_facts)

    # Version-less ids lead to the last full id seen, and that to its gene.
    genes = ref_tx.select("id", "gene").unionByName(ens_tx.select("id", "gene"))
    full = versionless(rows).select(F.col("other").alias("_full"), F.col("id").alias("bare"))
    loose = full.join(genes.withColumnRenamed("id", "_full"), "_full").select(
        F.col("bare").alias("id"), F.col("gene").alias("loose_gene")
    )
    return exact.withColumn("is_tx", F.col("tx_other").isNotNull() | F.col("gene").isNotNull()).unionByName(
        loose, allowMissingColumns=True
    )


def _ask(df: DataFrame, key: str, facts: DataFrame, **columns: str) -> DataFrame:
    """Left join of ``df.key`` to the facts; ``columns`` maps new names to fact columns."""
    needed = facts.select(F.col("id").alias(key), *[F.col(c).alias(n) for n, c in columns.items()])
    useful = " OR ".join(f"{n} IS NOT NULL" for n in columns)
    return df.join(needed.filter(useful), key, "left")


def gene_of_transcript(df: DataFrame, key: str, facts: DataFrame, out: str) -> DataFrame:
    """Gene by exact transcript id, else by the full id behind its version-less form."""
    found = _ask(df, key, facts, _exact="gene").withColumn("_bare", strip_version(F.col(key)))
    found = _ask(found, "_bare", facts, _loose="loose_gene")
    return found.withColumn(out, F.coalesce("_exact", "_loose")).drop("_exact", "_bare", "_loose")


def transcript_protein_lookup(df: DataFrame, key: str, facts: DataFrame, out: str) -> DataFrame:
    """Protein of a transcript or transcript of a protein; see ``crosswalk_facts``."""
    return _ask(df, key, facts, **{out: "answer"})


TRANSCRIPT_IDS = (
    "transcript_refseq_id",
    "transcript_ensembl_id",
    "gene_geneid_id",
    "gene_ensembl_id",
    "protein_refseq_id",
    "protein_ensembl_id",
)


def fill_missing_ids(transcripts: DataFrame, facts: DataFrame) -> DataFrame:
    """Fill null ids of transcripts, from the RefSeq side when it has an id, else the Ensembl side.

    A mitochondrial Ensembl transcript without a RefSeq partner takes the
    placeholder ``mito-<GeneID>`` when the crosswalk knows it.
    """
    ids = set(TRANSCRIPT_IDS)

    def fill(df: DataFrame, own: str, other: str) -> DataFrame:
        """``own`` and ``other`` name the source whose id leads and the one that follows."""
        tx, gene, prot = (f"{k}_{own}_id" for k in ("transcript", "gene", "protein"))
        tx2, gene2, prot2 = (f"{k}_{other}_id" for k in ("transcript", "gene", "protein"))
        gene, gene2 = (g.replace("gene_refseq", "gene_geneid") for g in (gene, gene2))
        assert {tx, gene, prot, tx2, gene2, prot2} == ids
        x = _ask(df, tx, facts, _tx="tx_other", _gene="gene", _prot="answer").withColumn("_bare", strip_version(F.col(tx)))
        x = _ask(x, "_bare", facts, _loose="loose_gene")
        x = x.withColumns({gene: F.coalesce(gene, "_gene", "_loose"), prot: F.coalesce(prot, "_prot"), tx2: F.coalesce(tx2, "_tx")})
        x = _ask(x, gene, facts, _gene2="gene_other")
        x = _ask(x, prot, facts, _prot2="prot_other")
        x = x.withColumns({gene2: F.coalesce(gene2, "_gene2"), prot2: F.coalesce(prot2, "_prot2")})
        return x.select(*transcripts.columns)

    refseq = fill(transcripts.filter("transcript_refseq_id IS NOT NULL"), "refseq", "ensembl")
    ensembl = fill(
        transcripts.filter("transcript_refseq_id IS NULL AND transcript_ensembl_id IS NOT NULL"), "ensembl", "refseq"
    )
    neither = transcripts.filter("transcript_refseq_id IS NULL AND transcript_ensembl_id IS NULL")
    if "chromosome" in transcripts.columns:
        named = ensembl.withColumn("_mito", F.concat(F.lit("mito-"), "gene_geneid_id"))
        named = named.join(facts.filter("is_tx").select(F.col("id").alias("_mito"), F.lit(True).alias("_known")), "_mito", "left")
        use = F.col("transcript_refseq_id").isNull() & (F.col("chromosome") == "MT") & F.col("_known")
        ensembl = named.withColumn(
            "transcript_refseq_id", F.when(use, F.col("_mito")).otherwise(F.col("transcript_refseq_id"))
        ).select(*transcripts.columns)
    return refseq.unionByName(ensembl).unionByName(neither)


def fill_missing_proteins(proteins: DataFrame, rows: DataFrame) -> DataFrame:
    other = protein_map(rows)
    x = look_up(proteins, "protein_ensembl_id", other, "_r")
    x = look_up(x, "protein_refseq_id", other, "_e")
    return x.withColumn(
        "protein_ensembl_id",
        F.when(F.col("protein_refseq_id").isNotNull(), F.coalesce("protein_ensembl_id", "_e")).otherwise(
            F.col("protein_ensembl_id")
        ),
    ).withColumn("protein_refseq_id", F.coalesce("protein_refseq_id", "_r")).drop("_r", "_e")
