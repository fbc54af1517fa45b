"""How far candidates repeat the path of an annotated CDS of their gene from its own codons on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept

#: Classes, contexts and reasons.
PURE = "pure_intorf_no_annotated_cds_nterm_reuse"
CLASSES = {
    "full_coordinate_path": "annotated_cds_derived_full_coordinate_path",
    "full_peptide_alternative_path": "annotated_cds_full_peptide_alternative_coordinate_path",
    "partial_nterm_reuse": "annotated_cds_nterm_reuse_with_splice_derived_cterm",
    "below_minimum_prefix": PURE,
    "none": PURE,
}
ABSENT, NO_CDS, NO_PREFIX = "candidate_gorf_absent_from_torf", "no_annotated_cds_for_same_versioned_gene", "no_same_gene_same_strand_codon_aligned_coordinate_prefix"
WHOLE, ENDED, DIVERGED = "candidate_fully_contained_in_annotated_cds_path", "annotated_cds_path_ended", "splice_or_coordinate_path_divergence"


def translation_path(starts1: Column, ends1: Column, strand: Column, peptide_len: Column) -> Column:
    """1-based genomic positions of a peptide's codons in translation order, from arrays of closed blocks.

    Unlike numbers of starts and ends, a start after its end, another strand than + and -, and a path shorter than the
    peptide needs are errors."""
    blocks = F.sort_array(F.zip_with(starts1, ends1, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    flat = F.flatten(F.transform(blocks, lambda b: F.sequence(b["s"], b["e"])))
    path = F.when(strand == "-", F.reverse(flat)).otherwise(flat)
    wrong = (
        F.when(F.size(starts1) != F.size(ends1), "unlike numbers of block starts and ends").when(F.exists(blocks, lambda b: b["s"] > b["e"]), "a block's start comes after its end").when(~strand.isin("+", "-"), "another strand than + and -")
        .when(peptide_len.isNull() | (peptide_len < 1), "a peptide without length").when(F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + b["e"] - b["s"] + 1) < peptide_len * 3, "the path is shorter than the peptide needs")
    )
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<bigint>")).otherwise(F.slice(path, F.lit(1), (peptide_len * 3).cast("int")))


def priority(tags: Column) -> Column:
    """Rank of a CDS by its transcript's tags; 0 is best."""
    has = lambda t: F.lower(F.coalesce(tags, F.lit(""))).contains(t)
    return F.when(has("mane_select"), 0).when(has("ccds"), 1).when(has("ensembl_canonical") | has("gencode_primary"), 2).when(has("appris"), 3).otherwise(4)


def _runs(path: Column, strand: Column) -> Column:
    """The path's stretches without a gap: array of (at, pos, n): index and position of the first base, and bases."""
    step = F.when(strand == "-", -1).otherwise(1)
    jumps = F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda i: (i == 0) | (F.get(path, i) - F.get(path, F.greatest(i - 1, F.lit(0))) != step))
    ends = F.concat(F.slice(jumps, F.lit(2), F.size(jumps)), F.array(F.size(path)))
    return F.when(F.size(path) > 0, F.zip_with(jumps, ends, lambda i, e: F.struct(i.alias("at"), F.get(path, i).alias("pos"), (e - i).alias("n"))))


#: SQL: the stretches of a CDS from its codon `start` on.
_REST = """transform(filter(cds_runs, r -> r.at + r.n > start), r -> named_struct(
  'pos', r.pos + if(strand = '-', -1, 1) * greatest(start - r.at, 0), 'n', r.n - greatest(start - r.at, 0)))"""
#: SQL: common bases of two paths: whole stretches that are alike, and the shorter of the first two that aren't but begin alike.
_COMMON = """aggregate(sequence(0, least(size(runs), size(rest)) - 1), named_struct('go', true, 'n', 0L), (s, k) -> if(s.go and runs[k].pos = rest[k].pos,
  named_struct('go', runs[k].n = rest[k].n, 'n', s.n + cast(least(runs[k].n, rest[k].n) as bigint)), named_struct('go', false, 'n', s.n)), s -> s.n)"""
#: SQL: common letters of two peptides, by halving; the second begins at the codon `start`.
_ALIKE = """aggregate(transform(sequence(20, 0, -1), k -> shiftleft(1, k)), 0, (n, w) -> if(
  n + w <= least(length(peptide), length(cds_peptide) - start div 3) and substring(peptide, 1, n + w) = substring(cds_peptide, start div 3 + 1, n + w), n + w, n))"""


def context(candidates: DataFrame, torfs: DataFrame, least_codons: int = 5) -> DataFrame:
    """candidates(gorf_id, gene_id, ...) with their sixteen columns of context.

    torfs: torf_id, gorf_id, gene_id, transcript_id, transcript_name, tx_tags, chrom, strand, is_annotated_cds, path,
    peptide. tORFs of one gene, place, path and peptide are one shape, and shapes are compared. The codons of all CDSs are an
    index by gene, chromosome, strand and position, where a candidate's shapes look up their first position; only such pairs
    are compared, by the stretches of their paths. Candidates of the same shapes have one profile, whose best pair and tied
    transcripts are found once; a candidate takes its own least tORF. The best pair has the longest
    common path, then the longest common peptide, the best tags, and the least transcript and tORF. A (gorf, gene)
    key without tORFs is an error where the key's gorf is known."""
    if least_codons < 1:
        raise ValueError("the least number of codons must be positive")
    keys = candidates.select("gorf_id", "gene_id").distinct()
    place = ["gene_id", "chrom", "strand"]
    named = torfs.withColumn("shape", F.md5(F.to_json(F.struct(*place, "path", "peptide"))))
    # rows go on by the name of their shape; paths and peptides stay in one table of shapes
    shapes = kept(named.select("is_annotated_cds", "shape", *place, "path", "peptide").distinct())
    own = named.filter("not is_annotated_cds").select("gorf_id", "gene_id", "shape", "torf_id").join(keys, ["gorf_id", "gene_id"], "left_semi")
    # a candidate's shapes, each with its least tORF; candidates of the same shapes have one profile
    members = own.groupBy("gorf_id", "gene_id", "shape").agg(F.min("torf_id").alias("torf_id")).groupBy("gorf_id", "gene_id").agg(F.sort_array(F.collect_list(F.struct("shape", "torf_id"))).alias("own"))
    members = kept(members.withColumn("profile", F.md5(F.array_join("own.shape", ","))))
    cds = named.filter("is_annotated_cds").select("gene_id", "shape", "transcript_id", "transcript_name", "tx_tags").join(members.select("gene_id").distinct(), "gene_id", "left_semi").withColumn("rank", F.struct(priority(F.col("tx_tags")).alias("tags"), "transcript_id"))
    profiles = members.select("profile", F.col("own.shape").alias("own")).distinct().select("profile", F.explode("own").alias("shape"))
    asked = shapes.filter("not is_annotated_cds and size(path) > 0").join(profiles.select("shape").distinct(), "shape", "left_semi").select("shape", *place, "peptide", F.size("path").alias("path_nt"), F.get("path", F.lit(0)).alias("pos"), _runs(F.col("path"), F.col("strand")).alias("runs"))
    transcripts = kept(cds.groupBy("shape").agg(F.first("gene_id").alias("gene_id"), F.min("rank").alias("rank"), F.min_by(F.struct("transcript_id", "transcript_name", F.col("tx_tags").alias("tags")), "rank").alias("t"), F.collect_set("transcript_id").alias("ids")))
    known = shapes.filter("is_annotated_cds").withColumnRenamed("shape", "cds_torf")
    one = known.join(transcripts.select(F.col("shape").alias("cds_torf"), "rank", "t"), "cds_torf").select(*place, "cds_torf", "rank", "t", F.size("path").alias("cds_nt"), _runs(F.col("path"), F.col("strand")).alias("cds_runs"), F.col("peptide").alias("cds_peptide"))
    starts = F.filter("path", lambda _, i: i % 3 == 0)
    index = known.select(*place, "cds_torf", F.posexplode(starts).alias("codon", "pos")).withColumn("start", F.col("codon") * 3).drop("codon")
    both = asked.join(index, [*place, "pos"]).join(one, [*place, "cds_torf"]).withColumn("rest", F.expr(_REST))
    both = both.withColumn("nt", F.expr(_COMMON)).withColumn("aa", F.expr(_ALIKE).cast("long"))
    both = both.withColumn("why", F.when(F.col("nt") >= F.col("path_nt"), WHOLE).when(F.col("nt") >= F.col("cds_nt") - F.col("start"), ENDED).otherwise(DIVERGED))
    told = F.struct("t.*", "nt", "aa", "path_nt", F.length("peptide").alias("peptide_aa"), "why")
    alike = both.groupBy("shape", "nt", "aa").agg(F.min_by(told, F.struct("rank", "cds_torf")).alias("b"), F.min("rank").alias("rank"), F.collect_set("cds_torf").alias("tied"))
    best = alike.groupBy("shape").agg(F.max_by(F.struct("b", "rank", "tied"), F.struct("nt", "aa")).alias("best")).select("shape", "best.*")
    # of a profile's shapes those that are best, of these those of the best CDS, and the transcripts of all CDSs that tie
    top = profiles.join(best, "shape").groupBy("profile", "b.nt", "b.aa", "rank").agg(F.collect_list(F.struct("shape", "b")).alias("won"), F.flatten(F.collect_list("tied")).alias("tied"))
    top = top.groupBy("profile", "nt", "aa").agg(F.min_by("won", "rank").alias("won"), F.array_distinct(F.flatten(F.collect_list("tied"))).alias("tied"))
    top = top.groupBy("profile").agg(F.max_by(F.struct("won", "tied"), F.struct("nt", "aa")).alias("best")).select("profile", "best.won", F.explode("best.tied").alias("shape"))
    top = top.join(transcripts.select("shape", "ids"), "shape").groupBy("profile").agg(F.first("won").alias("_won"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), ",").alias("_tied"))
    genes = transcripts.select("gene_id").distinct().withColumn("_has_cds", F.lit(True))
    # the long names come last, and so are in no shuffle of candidates
    mine = members.select("gorf_id", "gene_id", F.col("own").alias("_own"), F.col("profile").alias("_profile"))
    x = candidates.join(mine, ["gorf_id", "gene_id"], "left").join(genes, "gene_id", "left").join(top.withColumnRenamed("profile", "_profile"), "_profile", "left")
    least = lambda rows: F.array_min(F.transform(rows, lambda m: F.struct(m["torf_id"], m["shape"])))
    x = x.withColumn("_first", least(F.col("_own"))).withColumn("_mine", least(F.filter("_own", lambda m: F.array_contains("_won.shape", m["shape"]))))
    x = x.withColumn("_b", F.get(F.filter("_won", lambda w: w["shape"] == F.col("_mine.shape")), F.lit(0))["b"])
    b = lambda c: F.col(f"_b.{c}")
    met = F.col("_b").isNotNull()
    enough = met & (F.expr("_b.nt div 3") >= least_codons)
    x = x.withColumn("_kind", F.when(~met, "none").when(~enough, "below_minimum_prefix").when(b("nt") >= b("path_nt"), "full_coordinate_path").when(b("aa") >= b("peptide_aa"), "full_peptide_alternative_path").otherwise("partial_nterm_reuse"))
    zero = F.lit(0).cast("long")
    text = lambda c: F.coalesce(b(c), F.lit(""))
    none = F.when(F.col("_first").isNull(), ABSENT).when(F.col("_has_cds").isNull(), NO_CDS).otherwise(NO_PREFIX)
    found = {
        "gene_level_orf_class": F.element_at(F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv]), F.col("_kind")),
        "gene_level_pure_intorf_eligible": (~F.coalesce(enough, F.lit(False))).cast("int"),
        "gene_cds_nterm_match": F.coalesce(enough, F.lit(False)).cast("int"),
        "gene_cds_nterm_context": F.col("_kind"),
        "gene_cds_nterm_candidate_torf_id": F.coalesce("_mine.torf_id", "_first.torf_id", F.lit("")),
        "gene_cds_nterm_best_transcript_id": text("transcript_id"),
        "gene_cds_nterm_best_transcript_name": text("transcript_name"),
        "gene_cds_nterm_best_transcript_tags": text("tags"),
        "gene_cds_nterm_tied_transcript_ids": F.coalesce("_tied", F.lit("")),
        "gene_cds_nterm_coordinate_prefix_nt": F.coalesce(b("nt"), zero),
        "gene_cds_nterm_coordinate_prefix_complete_codons": F.coalesce(F.expr("_b.nt div 3"), zero),
        "gene_cds_nterm_coordinate_prefix_fraction": F.coalesce(b("nt") / b("path_nt"), F.lit(0.0)),
        "gene_cds_nterm_peptide_prefix_aa": F.coalesce(b("aa"), zero),
        "gene_cds_nterm_peptide_prefix_fraction": F.coalesce(b("aa") / b("peptide_aa"), F.lit(0.0)),
        "gene_cds_nterm_break_reason": F.coalesce(b("why"), none),
        "gene_cds_nterm_min_prefix_codons": F.lit(least_codons),
    }
    keyed = F.col("gorf_id").isNotNull() & F.col("gene_id").isNotNull()
    return x.select("gorf_id", "gene_id", *[c for c in candidates.columns if c not in ("gorf_id", "gene_id")], *[F.when(keyed, c).alias(n) for n, c in found.items()])


def uncovered(candidates: DataFrame, torfs: DataFrame) -> DataFrame:
    """(gorf_id, gene_id) of candidates that no tORF has; a complete table of tORFs leaves none."""
    return candidates.select("gorf_id", "gene_id").distinct().join(torfs.filter("not is_annotated_cds"), ["gorf_id", "gene_id"], "left_anti")


def class_counts(rows: DataFrame) -> DataFrame:
    """metric, value: rows by class, among all and among primary calls."""
    name = lambda p: F.concat(F.lit(p), "gene_level_orf_class")
    parts = F.array_compact(F.array(name("gene_level_orf_class::"), F.when(F.col("primary_credible_call") == 1, name("primary_gene_level_orf_class::")), F.lit("candidate_rows")))
    return rows.select(F.explode(parts).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
