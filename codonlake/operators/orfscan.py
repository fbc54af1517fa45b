"""Transcripts to the table of their ORFs: splicing, model, scan, kinds, genomic blocks, flanks and stop matches, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.operators import orfs, transcripts

#: The columns of the table, in order.
COLUMNS = tuple(
    """torf_id gene_id gene_name gene_biotype transcript_id transcript_name transcript_biotype tx_tags has_MANE_Select_tag chrom strand tx_model tx_complete_cds tx_has_start_annot tx_has_stop_annot
    tx_stop_recovered tx_cds_synthesized t_start t_end frame aa_len start_codon kozak_seq kozak_class orf_biotype overlap_cds_bp overlap_utr5_bp overlap_utr3_bp cds_first_t cds_last_t is_annotated_cds
    annotated_cds_id orf_has_upstream_start_annot orf_shares_annotated_stop intorf_shares_annotated_stop_same_gene intorf_shares_annotated_stop_any_gene intorf_annotated_stop_confounded chromStart1
    chromEnd1 blockCount blockSizes genomic_block_starts1 genomic_block_ends1 flank5_genomic_starts1 flank5_genomic_ends1 flank3_genomic_starts1 flank3_genomic_ends1 flank5_tx_len_requested
    flank5_tx_len_actual flank5_complete flank5_piece_count flank3_tx_len_requested flank3_tx_len_actual flank3_complete flank3_piece_count peptide_len peptide""".split()
)


def _join(pieces: Column, part) -> Column:
    return F.array_join(F.transform(pieces, lambda p: part(p).cast("string")), ",")


def modelled(tx: DataFrame) -> DataFrame:
    """Transcripts (as `transcripts.indexed`, with seq) in their own coordinates: placed exons, CDS, start and stop, model and flags; annotated stops as signatures."""
    x = tx.withColumn("placed", transcripts.placed(F.col("exons"), F.col("strand")))
    inner = lambda c: transcripts.to_transcript(F.col(c), F.col("placed"), F.col("strand")).alias(c)
    names = [c for c in x.columns if c not in ("cds", "start_codon", "stop_codon")]
    return transcripts.with_model(x.select(*names, inner("cds"), inner("start_codon"), inner("stop_codon")))


def torfs(tx: DataFrame, starts: tuple[str, ...] = ("ATG",), min_aa: int = 6, flank: int = 30) -> DataFrame:
    """One row for each ORF of each transcript, with the 57 columns of `COLUMNS`. tx as `transcripts.indexed`, with seq."""
    m = modelled(tx)
    found = orfs.scan(m.select(F.col("transcript_id").alias("tx"), "seq"), starts, min_aa)
    long = lambda c: F.col(c).cast("long").alias(c)
    x = found.select(F.col("tx").alias("transcript_id"), long("frame"), long("t_start"), long("t_end")).join(m, "transcript_id")
    x = transcripts.kinds(transcripts.forced(x, min_aa)).withColumn("aa_len", F.expr("(t_end - t_start) div 3 - 1"))
    s, e, n = F.col("t_start"), F.col("t_end"), F.length("seq").cast("long")
    around, strength = orfs.kozak(F.col("seq"), s)
    blocks = transcripts.lift(F.col("placed"), F.col("strand"), s, e)
    x = x.select("*", blocks.alias("blocks"), *transcripts.flanks(F.col("placed"), F.col("strand"), s, e, n, flank))
    stop = transcripts.stop_signature(F.col("chrom"), F.col("strand"), transcripts.lift(F.col("placed"), F.col("strand"), e - 3, e))
    x = x.withColumn("stop", F.when(F.col("orf_biotype") == "intORF_altframe", stop))
    x = transcripts.stop_matches(x, transcripts.annotated_stops(tx))
    size = lambda p: p["e"] - p["s"]
    made = {
        "torf_id": F.concat(F.lit("t|"), "transcript_id", F.lit("|"), s.cast("string"), F.lit("|"), e.cast("string"), F.lit("|f"), F.col("frame").cast("string")), "tx_tags": F.array_join("tags", ";"),
        "has_MANE_Select_tag": F.array_contains("tags", "MANE_Select").cast("int"), "start_codon": F.substring(F.col("seq"), (s + 1).cast("int"), F.lit(3)), "kozak_seq": around, "kozak_class": strength,
        "annotated_cds_id": F.when(F.col("is_annotated_cds") == 1, F.concat(F.lit("cds|"), "transcript_id", F.lit("|"), s.cast("string"), F.lit("|"), e.cast("string"))).otherwise(""),
        "intorf_shares_annotated_stop_same_gene": F.col("same_gene"), "intorf_shares_annotated_stop_any_gene": F.col("any_gene"), "intorf_annotated_stop_confounded": F.col("confounded"),
        "chromStart1": F.array_min(F.transform("blocks", lambda p: p["s"])) + 1, "chromEnd1": F.array_max(F.transform("blocks", lambda p: p["e"])), "blockCount": F.size("blocks"), "blockSizes": _join(F.col("blocks"), size),
        "genomic_block_starts1": _join(F.col("blocks"), lambda p: p["s"] + 1), "genomic_block_ends1": _join(F.col("blocks"), lambda p: p["e"]),
        **{f"{f}_genomic_starts1": _join(F.col(f), lambda p: p["s"] + 1) for f in ("flank5", "flank3")}, **{f"{f}_genomic_ends1": _join(F.col(f), lambda p: p["e"]) for f in ("flank5", "flank3")},
        **{f"{f}_tx_len_requested": F.lit(flank) for f in ("flank5", "flank3")}, **{f"{f}_tx_len_actual": F.col(f"{f}_len") for f in ("flank5", "flank3")}, **{f"{f}_piece_count": F.col(f"{f}_pieces") for f in ("flank5", "flank3")},
        "peptide": orfs.translate(F.col("seq"), s.cast("int"), e.cast("int"), starts),
    }
    made["peptide_len"] = F.length(made["peptide"])
    return x.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in COLUMNS])


def in_order(rows: DataFrame, gtf: DataFrame) -> DataFrame:
    """Adds `line`, the place of each ORF: transcripts in the order of the annotation's lines, then frames and starts."""
    first = gtf.filter("transcript_id is not null").groupBy("transcript_id").agg(F.min("line").alias("_first"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    place = big("_first") * F.lit(10**13).cast("decimal(14,0)") + big("frame") * F.lit(10**12).cast("decimal(13,0)") + big("t_start")
    return rows.join(first, "transcript_id").withColumn("line", place.cast("decimal(38,0)")).drop("_first")


def for_collapse(rows: DataFrame) -> DataFrame:
    """The table's rows as `orfs.collapse` takes them. Rows need their `line`, the order of reading."""
    numbers = lambda c: F.transform(F.split(c, ","), lambda v: v.cast("long"))
    return rows.select(
        "line", F.col("torf_id").alias("torf"), F.col("transcript_id").alias("tx"), F.col("gene_id").alias("gene"), "gene_name", F.col("orf_biotype").alias("biotype"), "chrom", "strand",
        F.col("chromStart1").alias("start1"), F.col("chromEnd1").alias("end1"), numbers("blockSizes").alias("sizes"), numbers("genomic_block_starts1").alias("starts1"), "peptide_len", "peptide", "aa_len",
        F.col("intorf_shares_annotated_stop_same_gene").alias("same_gene"), F.col("intorf_shares_annotated_stop_any_gene").alias("any_gene"), F.col("intorf_annotated_stop_confounded").alias("confounded"),
    )
