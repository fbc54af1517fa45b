"""The files of a run, for other programs: text tables, FASTA, BED, bedGraph, BAM and a manifest, from the tables of its stages.

Every file is written beside its place and moved when it is whole. Large ones are folders of parts, in order; reports are one
part. ORFs are also kept by chromosome, where a run of some chromosomes replaces those and leaves the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators import context, psites
from codonlake.plans import pipeline, stages
from codonlake.sources import bam_output, fasta, outputs

#: Columns of a written alignment.
ALIGNED = ("qname", "flag", "rname", "pos0", "mapq", "cigar", "seq", "qual", "OL", "AL", "PO", "RL", "NH")


def add_by_chrom(rows: DataFrame, path: str, key: str) -> None:
    """Rows (with chrom) as Parquet by chromosome: their chromosomes are replaced, others stay as they are.

    Before anything is written, a key that comes twice, or that another chromosome there has, is an error."""
    spark = rows.sparkSession
    if twice := rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect():
        raise ValueError(f"an id comes twice: {twice[0][key]}")
    try:
        there = spark.read.parquet(path)
    except AnalysisException:
        there = None
    if there is not None:
        others = there.join(F.broadcast(rows.select("chrom").distinct()), "chrom", "left_anti")  # contigs of an assembly
        if met := others.select(key).join(rows.select(key), key, "left_semi").limit(1).collect():
            raise ValueError(f"an id of another chromosome: {met[0][key]}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(path)


def _bed(sites: DataFrame) -> DataFrame:
    """The lines of a BED table of alignments of one base."""
    strand = F.when(F.col("flag") == 16, "-").otherwise("+")
    return sites.select(F.concat_ws("\t", "rname", F.col("pos0").cast("string"), (F.col("pos0") + 1).cast("string"), "qname", F.col("mapq").cast("string"), strand).alias("value"), "rname", "pos0", "qname")


def _graph(found: DataFrame, strand: str) -> DataFrame:
    depth = F.col("depth") if strand == "+" else -F.col("depth")
    return found.filter(F.col("strand") == strand).orderBy("chrom", "start0").select(F.concat_ws("\t", "chrom", F.col("start0").cast("string"), F.col("end0").cast("string"), depth.cast("string")).alias("value"))


def write_files(spark: SparkSession, c: pipeline.Config, version: str = "1") -> dict[str, str]:
    """Writes all files of a sample's tables; (name, path) of each. Tables that a run didn't make have no files.

    The manifest names what the run was made from, by content, and rows and columns of its results."""
    home, out = f"{c.folder}/{c.sample}", {}

    def table(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{home}/{name}/data") if stages.record(spark, home, name) else None

    def place(name: str) -> str:
        out[name] = f"{home}/files/{c.sample}.{name}"
        return out[name]

    def tsv(name: str, rows: DataFrame | None, order: Sequence[str] = (), one: bool = False, compressed: bool = False) -> None:
        if rows is not None:
            outputs.write_one(rows, place(name), order) if one else outputs.write_tsv(rows, place(name), order, compressed)

    torf, gorf, members = table("torf"), table("gorf"), table("gorf_members")
    if torf is not None:
        plain = torf.join(members.select(F.col("torf").alias("torf_id"), "gorf_id"), "torf_id", "left") if members is not None else torf
        tsv("torf.tsv", plain.orderBy("line").drop("line"))
        outputs.write_faa(torf.orderBy("line"), place("torf.faa"))
        add_by_chrom(torf, place("torf.by_chrom"), "torf_id")
    if gorf is not None and members is not None:
        outputs.write_gorfs(gorf, members, f"{home}/files/{c.sample}")
        out |= {n: f"{home}/files/{c.sample}.{n}" for n in ("gorf.tsv", "gorf_members.tsv", "gorf.faa")}
        add_by_chrom(gorf, place("gorf.by_chrom"), "gorf_id")
        tsv("gorf_audit.tsv", table("gorf_audit"), ["metric"], True)
    tsv("offset_selection.tsv", table("offsets"), ["length"], True)
    sites = table("psite")
    if sites is not None:
        if c.fasta:
            contigs = [(r.chrom, int(r.size)) for r in fasta.read_fai(spark, c.fasta).select("chrom", F.col("length").alias("size")).collect()]  # of an assembly
            bam_output.write_bam(sites.select(*[x for x in ALIGNED if x in sites.columns]), place("psite.bam"), contigs)
        outputs.write_lines(_bed(sites).orderBy("rname", "pos0", "qname").select("value"), place("psite.bed"))
        depth = psites.bedgraph(pipeline.site_counts(sites))
        for strand, name in (("+", "plus"), ("-", "minus")):
            outputs.write_lines(_graph(depth, strand), place(f"psite.{name}.bedGraph"))
    tsv("cds_metrics.tsv", table("cds_metrics"), ["orf"])
    back = table("background")
    if back is not None:
        row = back.first().asDict()
        outputs.write_key_values(list(row.items()), spark, place("dm_background.tsv"))
    for mode in pipeline.MODES[c.mode]:
        named = lambda name, mode=mode: name if c.mode != "both" else f"{mode}.{name}"
        results = table(f"{mode}_results")
        if results is None:
            continue
        tsv(named("intorf_dm_results.tsv"), results, ["candidate_order"])
        tsv(named("intorf_abundance.tsv"), table(f"{mode}_abundance"), ["id"])
        found = table(f"{mode}_context")
        if found is not None:
            tsv(named("gene_cds_context.tsv"), found, ["candidate_order"])
            tsv(named("gene_cds_context_summary.tsv"), context.class_counts(found), ["metric"], True)
        tsv(named("orf_psite_codons.tsv"), table(f"{mode}_codons"), ["candidate_key"], compressed=True)
        tsv(named("orf_psite_ternary.tsv"), table(f"{mode}_ternary"), ["candidate_key"])
        tsv(named("orf_psite_summary.tsv"), table(f"{mode}_summary"), ["candidate_key"])
        for name in ("plot_data", "gate_waterfall"):
            tsv(named(f"{name}.tsv"), table(f"{mode}_{name}"), one=name == "gate_waterfall")
        tsv(named("length_stratification.tsv"), table(f"{mode}_length_table"), one=True)
        records = {n: stages.record(spark, home, n) for n in ("torf", "offsets", "psite", "background", f"{mode}_results")}
        inputs = {k: v for r in records.values() if r for k, v in r["files"].items()}
        parameters = {k: v for r in records.values() if r for k, v in r["parameters"].items()}
        content = outputs.manifest("codonlake", version, parameters, inputs, results, [outputs.identity(spark, out[named("intorf_dm_results.tsv")])])
        outputs.write_manifest(spark, place(named("run_manifest.json")), content | {"mode": mode, "signature": records[f"{mode}_results"]["signature"], "code": records[f"{mode}_results"]["code"]})
    return out
