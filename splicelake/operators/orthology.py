"""Orthologous genes across species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions import text
from splicelake.operators.search import close_genes
from splicelake.session import staged

COLUMNS = ["a_ensembl_id", "a_genesymb", "a_species", "b_ensembl_id", "b_genesymb", "b_species"]


def orthology_pairs(pair_rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Pair rows (``a_id, a_species, b_id, b_species``) whose genes are both stored."""
    side = genes.filter("gene_ensembl_id IS NOT NULL").select(
        "gene_ensembl_id", F.upper("gene_symbol").alias("symbol"), "specie"
    )

    def of(tag: str) -> DataFrame:
        return side.select(
            F.col("gene_ensembl_id").alias(f"{tag}_id"), F.col("symbol").alias(f"{tag}_genesymb"), F.col("specie").alias(f"{tag}_species")
        )

    joined = pair_rows.select("a_id", "a_species", "b_id", "b_species").join(of("a"), ["a_id", "a_species"]).join(
        of("b"), ["b_id", "b_species"]
    )
    return joined.select(
        F.col("a_id").alias("a_ensembl_id"), "a_genesymb", "a_species", F.col("b_id").alias("b_ensembl_id"), "b_genesymb", "b_species"
    ).distinct()


def collapse_orthology(pairs: DataFrame) -> DataFrame:
    """One row per (A, B); differing values of the other columns become sorted lists."""
    others = [c for c in COLUMNS if c not in ("a_ensembl_id", "b_ensembl_id")]
    return (
        pairs.groupBy("a_ensembl_id", "b_ensembl_id")
        .agg(*[F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(c) for c in others])
        .select(*COLUMNS)
    )


def ortholog_wide(pairs: DataFrame, species: list[str]) -> DataFrame:
    """One row per gene with the symbols of its orthologs, one column per species."""
    flipped = both_directions(pairs)
    lists = flipped.groupBy("ensembl_id", "species").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("other_species") == s, F.col("other_symbol")))).alias(s) for s in species]
    )
    return lists.select(
        "ensembl_id", "species", *[F.nullif(F.array_join(s, text.SEP), F.lit("")).alias(s) for s in species]
    )


def both_directions(pairs: DataFrame) -> DataFrame:
    """Every pair seen from either side: (ensembl_id, symbol, species) and the other gene."""
    ends = (("a", "b"), ("b", "a"))
    views = [
        pairs.select(
            F.col(f"{x}_ensembl_id").alias("ensembl_id"),
            F.col(f"{x}_genesymb").alias("symbol"),
            F.col(f"{x}_species").alias("species"),
            F.col(f"{y}_ensembl_id").alias("other_ensembl_id"),
            F.col(f"{y}_genesymb").alias("other_symbol"),
            F.col(f"{y}_species").alias("other_species"),
        )
        for x, y in ends
    ]
    return views[0].unionByName(views[1])


def symbol_matches(terms: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes of any species whose symbol or Ensembl id is the term."""
    keyed = genes.select(
        F.explode(F.array_distinct(F.array(F.upper("gene_symbol"), F.upper("gene_ensembl_id")))).alias("key"),
        "gene_symbol",
        "specie",
    ).filter("key IS NOT NULL")
    return (
        terms.select("term", F.upper("term").alias("key"))
        .distinct()
        .join(keyed, "key")
        .select("term", F.col("gene_symbol").alias("match_symbol"), F.col("specie").alias("match_species"))
    )


def orthologs(terms: DataFrame, pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Orthology rows and symbol matches for a batch of (term, species).

    ``kind`` is ``orthology`` for a pair seen from the term's gene (directly, or
    through the symbol of a gene of that species that has the term as a synonym)
    and ``symbol`` for a gene with the same symbol or Ensembl id. A term that is
    such a synonym but leads to no orthology row gives nothing at all.
    """
    asked = terms.select("term", "species").distinct()
    views = both_directions(pairs)
    keyed = views.select(
        F.explode(F.array_distinct(F.array(F.upper("ensembl_id"), F.upper("symbol")))).alias("key"), "*"
    )

    def rows_for(named: DataFrame) -> DataFrame:
        return named.join(keyed, ["key", "species"]).select(
            "term", "species", F.col("ensembl_id"), "other_ensembl_id", "other_symbol", "other_species"
        )

    direct = rows_for(asked.withColumn("key", F.upper("term")))
    synonyms = staged(
        close_genes(terms, genes)
        .withColumnRenamed("specie", "species")
        .join(asked, ["term", "species"])
        .groupBy("term", "species")
        .agg(F.max_by("gene_symbol", "gene_key").alias("found"))
    )
    through = rows_for(synonyms.select("term", "species", F.upper("found").alias("key")))
    found = staged(direct.unionByName(through).distinct())

    stopped = synonyms.select("term", "species").join(found.select("term", "species").distinct(), ["term", "species"], "left_anti")
    matches = (
        asked.join(symbol_matches(terms, genes), "term")
        .join(stopped, ["term", "species"], "left_anti")
        .distinct()
    )
    empty = F.lit(None).cast("string")
    return found.select("term", "species", F.lit("orthology").alias("kind"), "ensembl_id", "other_ensembl_id", "other_symbol", "other_species").unionByName(
        matches.select(
            "term",
            "species",
            F.lit("symbol").alias("kind"),
            empty.alias("ensembl_id"),
            empty.alias("other_ensembl_id"),
            F.col("match_symbol").alias("other_symbol"),
            F.col("match_species").alias("other_species"),
        )
    )


def ortholog_options(found: DataFrame) -> DataFrame:
    """Choices per (term, species, target): orthology symbols first, symbol matches second.

    The second list is hidden when its first entry is already in the first list.
    """
    other = found.filter("species <> other_species").select("term", "species", "kind", F.col("other_species").alias("target"), "other_symbol")
    first = (
        other.filter("kind = 'orthology'")
        .withColumn("option", F.explode(F.split("other_symbol", ", ")))
        .select("term", "species", "target", "option")
        .distinct()
    )
    second = other.filter("kind = 'symbol'").select("term", "species", "target", F.col("other_symbol").alias("option")).distinct()
    keys = ["term", "species", "target"]
    heads = second.groupBy(*keys).agg(F.min("option").alias("_head"))
    hidden = heads.withColumn("_u", F.upper("_head")).join(
        first.select(*keys, F.upper("option").alias("_u")).distinct(), [*keys, "_u"], "left_semi"
    ).select(*keys)
    shown = second.join(hidden, keys, "left_anti")
    return first.withColumn("source", F.lit("orthology")).unionByName(shown.withColumn("source", F.lit("symbol")))


def compare_species(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Two gene documents side by side for every ortholog pair of gene keys (a_key, b_key)."""
    def side(tag: str) -> DataFrame:
        return documents.select(*[F.col(c).alias(f"{tag}_key" if c == "gene_key" else f"{tag}_{c}") for c in documents.columns])

    return pairs.join(side("a"), "a_key").join(side("b"), "b_key")


def compare_documents(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The whole documents of both genes of every ortholog pair (a_key, b_key): one row per transcript, ``side`` a or b.

    ``documents`` are those of ``search.gene_document``. A gene without transcripts has its one row, so
    both sides of every pair are there.
    """
    both = [F.struct(F.lit(side).alias("side"), F.col(f"{side}_key").alias("gene_key")) for side in ("a", "b")]
    sides = pairs.select("a_key", "b_key", F.explode(F.array(*both)).alias("s"))
    return sides.select("a_key", "b_key", "s.side", "s.gene_key").join(documents, "gene_key")
