"""ORF enumeration, translation, context and collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STOPS = ("TAA", "TAG", "TGA")
#: Amino acids of the standard code for codons in the order of the bases TCAG. Fixed values.
BASES, AMINO = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_index(codon: Column) -> Column:
    """Place of a codon in `AMINO`, from 1; null for other letters."""
    at = lambda i: F.nullif(F.instr(F.lit(BASES), codon.substr(i, 1)), F.lit(0)) - 1
    return at(1) * 16 + at(2) * 4 + at(3) + 1


def amino_acid(codon: Column) -> Column:
    return F.coalesce(F.substring(F.lit(AMINO), codon_index(codon).cast("int"), F.lit(1)), F.lit("X"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def scan(seqs: DataFrame, starts: tuple[str, ...] = ("ATG",), min_aa: int = 6) -> DataFrame:
    """tx, frame, t_start, t_end, aa_len: in each frame, between stops, the earliest start that a stop follows.

    A frame's codons come from one pass over the shifted sequence, so a transcript costs as much as it is long; only
    starts and stops are exploded. A running count of the stops before a codon numbers its segment, and one
    aggregation finds the segment's first start and its stop."""
    frames = seqs.select("tx", F.inline(F.array(*[F.struct(F.lit(f).alias("frame"), F.substring("seq", f + 1, 1 << 30).alias("s")) for f in range(3)])))
    codons = F.regexp_extract_all("s", F.lit("(...)"), F.lit(1))
    marked = F.filter(F.transform(codons, lambda c, i: F.struct(i.alias("i"), c.alias("codon"))), lambda x: x["codon"].isin(*starts, *STOPS))
    hits = frames.select("tx", "frame", F.inline(marked)).select("tx", "frame", (F.col("i") * 3 + F.col("frame")).alias("pos"), F.col("codon").isin(*STOPS).alias("stop"))
    w = W.partitionBy("tx", "frame").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    segment = hits.withColumn("segment", F.coalesce(F.sum(F.col("stop").cast("int")).over(w), F.lit(0)))
    found = segment.groupBy("tx", "frame", "segment").agg(F.min(F.when(~F.col("stop"), F.col("pos"))).alias("t_start"), (F.min(F.when(F.col("stop"), F.col("pos"))) + 3).alias("t_end"))
    out = found.filter("t_start is not null and t_end is not null").withColumn("aa_len", F.expr("(t_end - 3 - t_start) div 3"))
    return out.filter(F.col("aa_len") >= min_aa).select("tx", "frame", "t_start", "t_end", "aa_len")


def translate(seq: Column, t_start: Column, t_end: Column, starts: tuple[str, ...] | None = None) -> Column:
    """The peptide up to the first stop. The first codon counts as M where it is among the starts (always, if none are given).

    The ORF is cut out once and split in threes."""
    codons = F.regexp_extract_all(F.substring(seq, t_start + 1, t_end - t_start), F.lit("(...)"), F.lit(1))
    begins = lambda c, i: (i == 0) if starts is None else (i == 0) & c.isin(*starts)
    letters = F.transform(codons, lambda c, i: F.when(begins(c, i), "M").otherwise(amino_acid(c)))
    stop = F.array_position(letters, "*")
    return F.array_join(F.when(stop > 0, F.slice(letters, F.lit(1), (stop - 1).cast("int"))).otherwise(letters), "")


def kozak(seq: Column, t_start: Column) -> tuple[Column, Column]:
    """The 14 bases from -6 to +8 around the start, padded with N, and the class of the context."""
    padded = F.concat(F.lit("NNNNNN"), seq, F.lit("NNNNNNNN"))
    around = F.substring(padded, t_start + 1, F.lit(14))
    purine, g = F.substring(around, 4, 1).isin("A", "G"), F.substring(around, 10, 1) == "G"
    return around, F.when(purine & g, "Strong").when(purine | g, "Moderate").otherwise("Weak")


#: Kinds of ORFs, from the one that represents a group before all others.
PRIORITY = ("CDS", "intORF_inframe", "intORF_altframe", "uoORF", "doORF", "uORF", "dORF", "other", "ncORF")


def rank(biotype: Column) -> Column:
    """Place of a kind in `PRIORITY`; unknown kinds come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), biotype)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(PRIORITY) + 10).cast("long"))


def _json(key: list[Column], merge_by: str) -> Column:
    return F.concat(F.lit('{"key":['), F.concat_ws(",", *key), F.lit(f'],"merge_by":"{merge_by}"}}'))


def _text(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def signature(chrom: Column, strand: Column, sizes: Column, starts1: Column, merge_by: str = "blocks", kind: str = "blocks") -> Column:
    """The identity of an ORF's blocks: compact JSON with sorted keys."""
    return _json([F.lit(f'"{kind}"'), _text(chrom), _text(strand), F.to_json(sizes), F.to_json(starts1)], merge_by)


def stop_signature(chrom: Column, strand: Column, start1: Column, end1: Column, sizes: Column, starts1: Column) -> Column:
    """The identity of an ORF's stop: its last genomic base and that base's genomic frame, never the transcript's frame.

    Without its ends an ORF is known by its blocks."""
    at = F.when(strand == "-", start1).otherwise(end1).cast("long")
    stop = _json([F.lit('"stop"'), _text(chrom), _text(strand), at.cast("string"), F.pmod(at - 1, F.lit(3)).cast("string")], "stop")
    return F.when(start1.isNotNull() & end1.isNotNull(), stop).otherwise(signature(chrom, strand, sizes, starts1, "stop", "fallback_blocks"))


def with_gorf(orfs: DataFrame, merge_by: str = "blocks") -> DataFrame:
    """orfs(chrom, strand, sizes, starts1, and start1, end1 for stops): adds gorf_signature and gorf_id."""
    c = F.col
    if merge_by not in ("blocks", "stop"):
        raise ValueError(f"unknown way to merge: {merge_by}")
    sig = signature(c("chrom"), c("strand"), c("sizes"), c("starts1")) if merge_by == "blocks" else stop_signature(c("chrom"), c("strand"), c("start1"), c("end1"), c("sizes"), c("starts1"))
    x = orfs.withColumn("gorf_signature", sig)
    return x.withColumn("gorf_id", F.concat(F.lit("g|"), "chrom", F.lit("|"), "strand", F.lit(f"|{merge_by}|h"), F.substring(F.sha1("gorf_signature"), 1, 16)))


def collapse(orfs: DataFrame, merge_by: str = "blocks") -> DataFrame:
    """One row for each genomic ORF.

    orfs: torf, tx, gene, gene_name, biotype, chrom, strand, start1, end1, sizes, starts1, peptide_len, peptide, aa_len,
    same_gene, any_gene, confounded, line (order of reading). The representative has the best kind, then the longest
    peptide, the longest ORF and the least name; gene and name are the most frequent, ties to the first read. Two
    signatures of one id, or a tORF of two genomic ORFs, are an error. Members are counted before the shuffle;
    lists of members and transcripts are as long as the group."""
    x = with_gorf(orfs, merge_by).withColumn("rank", rank(F.col("biotype")))

    def modal(c: str) -> DataFrame:
        seen = x.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy("gorf_id", c).agg(F.count(F.lit(1)).alias("k"), F.min("line").alias("first"))
        return seen.groupBy("gorf_id").agg(F.min_by(c, F.struct(-F.col("k"), "first")).alias(f"modal_{c}"))

    kinds = x.groupBy("gorf_id", "rank", "biotype").agg(F.count(F.lit(1)).alias("k"))
    kinds = kinds.groupBy("gorf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "biotype", "k"))), lambda t: F.concat(t["biotype"], F.lit(":"), t["k"].cast("string"))), ",").alias("biotype_summary"))
    best = F.min_by(F.struct("torf", "gene", "gene_name", "chrom", "strand", "start1", "end1", "sizes", "starts1", "biotype", "peptide_len", "peptide"), F.struct("rank", -F.col("peptide_len"), -F.col("aa_len"), "torf"))
    one = x.groupBy("gorf_id").agg(
        best.alias("r"), F.count(F.lit(1)).alias("n_members"), F.min("gorf_signature").alias("gorf_signature"), F.max("gorf_signature").alias("other_signature"),
        *[F.max(F.coalesce(c, F.lit(0))).alias(f"{c}_any") for c in ("same_gene", "any_gene", "confounded")],
        F.array_sort(F.collect_set("tx")).alias("txs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "torf"))), lambda t: t["torf"]), ",").alias("torf_ids"),
    )
    sure = F.when(F.col("gorf_signature") != F.col("other_signature"), F.raise_error(F.concat(F.lit("two signatures of one id: "), "gorf_id"))).otherwise(F.col("gorf_id"))
    joined = one.join(kinds, "gorf_id").join(modal("gene"), "gorf_id", "left").join(modal("gene_name"), "gorf_id", "left")
    return joined.select(
        sure.alias("gorf_id"), "gorf_signature", F.lit(merge_by).alias("merge_by"), F.coalesce("modal_gene", "r.gene").alias("gene_id"), F.coalesce("modal_gene_name", "r.gene_name").alias("gene_name"), "r.chrom", "r.strand",
        F.col("r.start1").alias("chromStart1"), F.col("r.end1").alias("chromEnd1"), F.size("r.sizes").alias("blockCount"), F.array_join(F.col("r.sizes").cast("array<string>"), ",").alias("blockSizes"),
        F.array_join(F.col("r.starts1").cast("array<string>"), ",").alias("genomic_block_starts1"), F.array_join(F.zip_with("r.starts1", "r.sizes", lambda s, n: s + n - 1).cast("array<string>"), ",").alias("genomic_block_ends1"),
        F.col("r.torf").alias("representative"), F.col("r.biotype").alias("orf_biotype_rep"), "biotype_summary", F.col("same_gene_any").alias("intorf_shared_annotated_stop_same_gene_any"),
        F.col("any_gene_any").alias("intorf_shared_annotated_stop_any_gene_any"), F.col("confounded_any").alias("intorf_annotated_stop_confounded_any"), F.coalesce("r.peptide_len", F.length("r.peptide")).alias("peptide_len"), "r.peptide",
        "n_members", F.size("txs").alias("n_transcripts"), F.array_join("txs", ",").alias("transcripts"), "torf_ids",
    )


def members(orfs: DataFrame, merge_by: str = "blocks") -> DataFrame:
    """gorf_id, torf for every ORF."""
    return with_gorf(orfs, merge_by).select("gorf_id", "torf")


def audit(orfs: DataFrame, member_rows: DataFrame, gorfs: DataFrame) -> DataFrame:
    """metric, value: how far tORFs, members and genomic ORFs cover each other. All but the first three must be 0 (`passed` tells).

    orfs(torf), member_rows(gorf_id, torf), gorfs(gorf_id, gorf_signature)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    t, m, g = orfs.select("torf"), member_rows.select("gorf_id", "torf"), gorfs.select("gorf_id", "gorf_signature")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("value"))
    repeated = lambda df, *keys: count(df.groupBy(*keys).count().filter("count > 1"))
    several = m.distinct().groupBy("torf").count().filter("count > 1")
    shared = g.distinct().groupBy("gorf_id").agg(F.count_distinct("gorf_signature").alias("n")).filter("n > 1")
    found = {
        "torf_rows": count(t), "member_rows": count(m), "gorf_rows": count(g), "blank_torf_ids": count(t.filter(blank("torf"))), "blank_member_ids": count(m.filter(blank("torf") | blank("gorf_id"))), "blank_gorf_ids": count(g.filter(blank("gorf_id"))),
        "duplicate_torf_ids": repeated(t, "torf"), "duplicate_member_pairs": repeated(m, "gorf_id", "torf"), "duplicate_gorf_ids": repeated(g, "gorf_id"), "torfs_of_several_gorfs": count(several), "ids_of_several_signatures": count(shared),
        "torfs_without_member": count(t.select("torf").distinct().join(m, "torf", "left_anti")), "members_without_torf": count(m.select("torf").distinct().join(t, "torf", "left_anti")),
        "gorfs_without_member": count(g.select("gorf_id").distinct().join(m, "gorf_id", "left_anti")), "members_without_gorf": count(m.select("gorf_id").distinct().join(g, "gorf_id", "left_anti")),
    }
    out = None
    for name, one in found.items():
        row = one.select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.union(row)
    return out


def passed(report: DataFrame) -> bool:
    """Whether an audit's report of fifteen lines has no fault."""
    return not [r for r in report.collect() if not r.metric.endswith("_rows") and r.value]


def contig_class(name: Column) -> Column:
    """Kind of a contig by its name. What is neither assembled in place nor an alternative is unlocalized, but names of
    that kind are alternatives first, so only the word itself is left."""
    base = F.regexp_replace(name, "^chr", "")
    alt = name.rlike("(?i)(_alt|_fix|_random|_decoy|_patch|chrUn|Un_|_unlocalized)")
    return F.when(alt & name.rlike("(?i)(patch|fix)"), "patch").when(alt, "alt").when(name.rlike("(?i)unlocalized"), "unlocalized").when(base.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$"), "primary").otherwise("other")


#: Bases of a bin when ranges or sites of one chromosome are dealt to tasks.
BIN = 1 << 20


def merge_ranges(ranges: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """key, start0, end0: unions of overlapping or touching ranges; ranges without a base are left out.

    Ranges are first joined inside bins of fixed width, to which they are cut, so a chromosome is no single task; the
    pieces that touch a bin's edge are joined over bins, and only those. A bin's own pieces are few, whatever its depth."""
    some = ranges.filter("end0 > start0").select(key, F.col("start0").cast("long").alias("s"), F.col("end0").cast("long").alias("e"))
    cut = some.withColumn("bin", F.explode(F.expr(f"sequence(s div {width}, (e - 1) div {width})")))
    cut = cut.select(key, "bin", F.greatest("s", F.col("bin") * width).alias("s"), F.least("e", (F.col("bin") + 1) * width).alias("e")).groupBy(key, "bin", "s").agg(F.max("e").alias("e"))

    def islands(x: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy("s", "e")
        x = x.withColumn("_upto", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
        x = x.withColumn("_island", F.sum(F.when(F.col("_upto").isNull() | (F.col("s") > F.col("_upto")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
        return x.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")

    inner = islands(cut, [key, "bin"])
    edge = (F.col("s") % width == 0) | (F.col("e") % width == 0)
    whole = inner.filter(~edge).select(key, "s", "e")
    return whole.union(islands(inner.filter(edge).select(key, "s", "e"), [key])).select(key, F.col("s").alias("start0"), F.col("e").alias("end0"))
