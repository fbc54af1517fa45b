"""Transcript models, coordinate maps between genome and transcript, and the kinds of ORFs on a transcript.

A transcript is one row with short arrays of intervals (0-based, half-open), so maps are array expressions
beside the row and need no join. Its arrays are bounded by its exons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.operators.orfs import STOPS

INTERVALS = "array<struct<s:long,e:long>>"


def none() -> Column:
    return F.array().cast(INTERVALS)


def genes(gtf: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """gene_id, gene_name, gene_biotype, chrom, strand of each gene's first feature, its own or a transcript's, on the contigs to keep."""
    x = gtf if contigs is None else gtf.join(F.broadcast(contigs.select("chrom")), "chrom", "left_semi")
    x = x.filter("gene_id is not null and (feature = 'gene' or transcript_id is not null)")
    first = F.min_by(F.struct(F.coalesce("gene_name", F.lit("")).alias("gene_name"), F.coalesce("gene_biotype", F.lit("")).alias("gene_biotype"), "chrom", "strand"), "line")
    return x.groupBy("gene_id").agg(first.alias("g")).select("gene_id", "g.*")


def indexed(gtf: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """`models` on the contigs to keep, with gene names and kinds from the genes' own first feature.

    A transcript without a feature of its own is made from its exons; one without gene is left out."""
    x = gtf if contigs is None else gtf.join(F.broadcast(contigs.select("chrom")), "chrom", "left_semi")
    made = models(x.filter("gene_id is not null and feature <> 'gene'")).drop("gene_name", "gene_biotype")
    return made.join(genes(gtf, contigs).select("gene_id", "gene_name", "gene_biotype"), "gene_id")


def annotated_stops(tx: DataFrame) -> DataFrame:
    """gene_id, stop (its signature, null if it isn't three positions) of the transcripts with a CDS and an explicit stop codon, in genomic coordinates."""
    x = tx.filter((F.size("cds") > 0) & (F.size("stop_codon") > 0))
    return x.select("gene_id", stop_signature(F.col("chrom"), F.col("strand"), F.col("stop_codon")).alias("stop"))


def invalid_stops(stops: DataFrame) -> DataFrame:
    """One row: transcripts whose annotated stop isn't three positions on a strand."""
    return stops.agg(F.count_if(F.col("stop").isNull()).alias("invalid_stop_transcripts"))


def models(gtf: DataFrame) -> DataFrame:
    """One row for each transcript of the features that has exons: names of its first feature, distinct tags, intervals by kind.

    gtf as read by `formats.read_gtf`, with `line`, the place of a feature in the file."""
    kind = lambda f: F.sort_array(F.collect_list(F.when(F.col("feature") == f, F.struct(F.col("start0").cast("long").alias("s"), F.col("end0").cast("long").alias("e")))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    names = [first(c) for c in ("gene_id", "gene_name", "gene_biotype", "transcript_name", "transcript_biotype", "chrom", "strand")]
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags")
    out = gtf.filter("transcript_id is not null").groupBy("transcript_id").agg(*names, tags, kind("exon").alias("exons"), kind("CDS").alias("cds"), kind("start_codon").alias("start_codon"), kind("stop_codon").alias("stop_codon"))
    return out.filter("size(exons) > 0")


def placed(exons: Column, strand: Column) -> Column:
    """Exons in transcript order as (s, e, t): t is the transcript index of an exon's first base."""
    ordered = F.when(strand == "-", F.reverse(F.array_sort(exons))).otherwise(F.array_sort(exons))
    start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<struct<s:long,e:long,t:long>>").alias("out"))
    step = lambda a, x: F.struct((a["t"] + x["e"] - x["s"]).alias("t"), F.concat(a["out"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), a["t"].alias("t")))).alias("out"))
    return F.aggregate(ordered, start, step, lambda a: a["out"])


def union(intervals: Column) -> Column:
    """Sorted intervals with overlapping or touching ones made one."""
    first = lambda a: F.slice(a, 1, F.size(a) - 1)

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(first(a), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]), joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(intervals), none(), step)


def to_transcript(intervals: Column, exons: Column, strand: Column) -> Column:
    """The transcript intervals of genomic ones, cut to the exons; exons as from `placed`."""

    def cut(x: Column, i: Column) -> Column:
        lo, hi = F.greatest(x["s"], i["s"]), F.least(x["e"], i["e"])
        at = F.when(strand == "-", x["t"] + x["e"] - hi).otherwise(x["t"] + lo - x["s"])
        return F.struct(at.alias("s"), (at + hi - lo).alias("e"))

    parts = F.flatten(F.transform(intervals, lambda i: F.filter(F.transform(exons, lambda x: cut(x, i)), lambda p: p["e"] > p["s"])))
    return union(parts)


def lift(exons: Column, strand: Column, s: Column, e: Column) -> Column:
    """Genomic pieces (s, e) of the transcript range s to e, in genome order; neighbours across exons that touch are one."""

    def piece(x: Column) -> Column:
        lo, hi = F.greatest(x["t"], s), F.least(x["t"] + x["e"] - x["s"], e)
        from_ = F.when(strand == "-", x["e"] - (hi - x["t"])).otherwise(x["s"] + lo - x["t"])
        return F.struct(from_.alias("s"), (from_ + hi - lo).alias("e"))

    return union(F.filter(F.transform(exons, piece), lambda p: p["e"] > p["s"]))


def flanks(exons: Column, strand: Column, s: Column, e: Column, length: Column, want: int = 30) -> list[Column]:
    """Pieces of the flanks before and after a range, cut to the transcript, and for each its length, whether it is whole, and its number of pieces."""
    a, b = F.greatest(s - want, F.lit(0).cast("long")), F.least(e + want, length)
    out = []
    for name, lo, hi in (("flank5", a, s), ("flank3", e, b)):
        pieces = lift(exons, strand, lo, hi)
        out += [pieces.alias(name), (hi - lo).alias(f"{name}_len"), (hi - lo >= want).cast("int").alias(f"{name}_complete"), F.size(pieces).alias(f"{name}_pieces")]
    return out


def in_frame_stop(seq: Column, start: Column) -> Column:
    """The end of the first stop in the frame of a start; null if none."""
    places = F.when(F.length(seq) - 3 >= start, F.sequence(start, F.length(seq) - 3, F.lit(3))).otherwise(F.array().cast("array<long>"))
    return F.try_element_at(F.filter(places, lambda i: F.substring(seq, (i + 1).cast("int"), F.lit(3)).isin(*STOPS)), F.lit(1)) + 3


def with_model(tx: DataFrame) -> DataFrame:
    """tx(seq, cds, start_codon, stop_codon in transcript coordinates): adds model, the flags, and the intervals that follow from them.

    With a CDS, a stop right after its end stands for a missing annotated one; the model is coding with start and
    stop, non_coding without a start, else no_stop. Without a CDS, a start makes one, up to its frame's first stop."""
    first = F.try_element_at("start_codon", F.lit(1))["s"]
    has_cds, has_start, has_stop = F.size("cds") > 0, F.size("start_codon") > 0, F.size("stop_codon") > 0
    last = F.array_max(F.transform("cds", lambda x: x["e"]))
    next3 = F.substring(F.col("seq"), (last + 1).cast("int"), F.lit(3))
    found = has_cds & ~has_stop & next3.isin(*STOPS)
    made = ~has_cds & has_start
    end = in_frame_stop(F.col("seq"), first.cast("long"))
    one = lambda s, e: F.array(F.struct(s.cast("long").alias("s"), e.cast("long").alias("e")))
    stop = F.when(found, one(last, last + 3)).when(made, F.when(end.isNotNull(), one(end - 3, end)).otherwise(none())).otherwise(F.col("stop_codon"))
    cds = F.when(made, one(first, F.coalesce(end - 3, F.length("seq").cast("long")))).otherwise(F.col("cds"))
    x = tx.withColumns({"tx_has_start_annot": has_start.cast("int"), "tx_has_stop_annot": has_stop.cast("int"), "tx_stop_recovered": F.coalesce(found, F.lit(False)).cast("int"), "tx_cds_synthesized": made.cast("int"), "_cds": cds, "_stop": stop})
    model = F.when(F.size("cds") == 0, "non_coding").when(F.size("start_codon") == 0, "non_coding").when(F.size("stop_codon") > 0, "coding").otherwise("no_stop")
    x = x.drop("cds", "stop_codon").withColumnsRenamed({"_cds": "cds", "_stop": "stop_codon"}).withColumn("tx_model", model)
    both = (F.size("start_codon") > 0) & (F.size("stop_codon") > 0)
    lo, hi = F.array_min(F.transform("start_codon", lambda i: i["s"])), F.array_max(F.transform("stop_codon", lambda i: i["e"]))
    whole = both & (hi > lo)
    return x.withColumns({"ann_start": F.when(whole, lo), "ann_end": F.when(whole, hi), "tx_complete_cds": (both & (F.size("cds") > 0)).cast("int"), "cds_first_t": F.array_min(F.transform("cds", lambda i: i["s"])), "cds_last_t": F.array_max(F.transform("cds", lambda i: i["e"]))})


def overlap(s: Column, e: Column, intervals: Column) -> Column:
    """Bases of a range inside the intervals."""
    zero = F.lit(0).cast("long")
    return F.aggregate(intervals, zero, lambda a, i: a + F.greatest(zero, F.least(e, i["e"]) - F.greatest(s, i["s"])))


def forced(x: DataFrame, min_aa: int = 0) -> DataFrame:
    """ORFs(t_start, t_end) with their transcript's model: one that ends at the annotated stop takes the annotated range; `is_cds` tells.

    Those that are shorter than min_aa then are left out."""
    cds = (F.col("tx_complete_cds") == 1) & F.col("ann_end").isNotNull() & (F.col("t_end") == F.col("ann_end"))
    x = x.withColumn("is_cds", F.coalesce(cds, F.lit(False))).withColumn("t_start", F.when(F.col("is_cds"), F.col("ann_start")).otherwise(F.col("t_start")))
    return x.filter(F.expr("(t_end - t_start) div 3 - 1") >= min_aa) if min_aa else x


def kinds(x: DataFrame) -> DataFrame:
    """Adds orf_biotype, its overlaps with CDS and UTRs, and the flags of annotation. x: rows of `forced` with seq."""
    s, e, length = F.col("t_start"), F.col("t_end"), F.length("seq").cast("long")
    zero = F.lit(0).cast("long")
    coding = (F.col("tx_model") != "non_coding") & (F.size("cds") > 0)
    inside, utr5 = overlap(s, e, F.col("cds")), F.greatest(zero, F.least(e, F.col("cds_first_t")) - s)
    utr3 = F.when(F.col("ann_end").isNotNull(), F.greatest(zero, F.least(e, length) - F.greatest(s, F.col("ann_end")))).otherwise(zero)
    x = x.withColumns({"overlap_cds_bp": F.when(coding, inside).otherwise(zero), "overlap_utr5_bp": F.when(coding, utr5).otherwise(zero), "overlap_utr3_bp": F.when(coding, utr3).otherwise(zero)})
    within = F.when(F.pmod(s - F.col("cds_first_t"), F.lit(3)) == 0, "intORF_inframe").otherwise("intORF_altframe")
    crossing = F.when((F.col("overlap_cds_bp") > 0) & (F.col("overlap_utr5_bp") > 0), "uoORF").when((F.col("overlap_cds_bp") > 0) & (F.col("overlap_utr3_bp") > 0), "doORF").otherwise("other")
    kind = F.when(F.col("is_cds"), "CDS").when(~coding, "ncORF").when(F.col("overlap_cds_bp") == e - s, within).when(e <= F.col("cds_first_t"), "uORF").when(s >= F.col("ann_end"), "dORF").otherwise(crossing)
    return x.withColumns(
        {
            "orf_biotype": kind,
            "is_annotated_cds": F.coalesce((s == F.col("ann_start")) & (e == F.col("ann_end")), F.lit(False)).cast("int"),
            "orf_has_upstream_start_annot": F.exists("start_codon", lambda i: i["s"] < s).cast("int"),
            "orf_shares_annotated_stop": F.exists("stop_codon", lambda i: i["e"] == e).cast("int"),
        }
    )


def stop_signature(chrom: Column, strand: Column, pieces: Column) -> Column:
    """Name of a stop codon's three positions; null unless there are three and a strand."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.sequence(p["s"], p["e"] - 1)))))
    return F.when(strand.isin("+", "-") & (F.size(places) == 3), F.concat_ws("|", chrom, strand, F.array_join(places.cast("array<string>"), ",")))


def stop_matches(orfs: DataFrame, stops: DataFrame) -> DataFrame:
    """orfs(orf_biotype, gene_id, stop) against annotated stops(gene_id, stop): whether an alternative-frame ORF ends in one, of its gene or of any."""
    known = stops.filter("stop is not null").select("gene_id", "stop").distinct()
    same = known.withColumn("same_gene", F.lit(1))
    any_ = known.select("stop").distinct().withColumn("any_gene", F.lit(1))
    out = orfs.join(same, ["gene_id", "stop"], "left").join(any_, "stop", "left")
    flag = lambda c: F.when(F.col("orf_biotype") == "intORF_altframe", F.coalesce(c, F.lit(0))).otherwise(0)
    return out.withColumn("same_gene", flag("same_gene")).withColumn("any_gene", flag("any_gene")).withColumn("confounded", F.col("any_gene"))
