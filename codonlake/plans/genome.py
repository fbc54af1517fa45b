"""Sequences by pieces, genomic ORFs and their audit, offsets, calls, gene context and codon export on the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.sqlx import rounded
from codonlake.operators import context, export, orfs, psites
from codonlake.plans import domain
from codonlake.plans.annotation import tx_sequences
from codonlake.plans.inference import CAND_SQL, cand_codons
from codonlake.sources import fasta
from codonlake.sources.tables import table


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bases as contigs, cut to pieces of 64 bases."""
    parts = tx_sequences(spark, sf_dir).select(F.col("tx").cast("string").alias("chrom"), F.lit(0).cast("long").alias("start"), "seq")
    return fasta.to_pieces(parts, 64)


def fa_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each document's bases, over pieces and beyond the end."""
    k = F.col("doc_id")
    x = table(spark, sf_dir, "documents").select(k.alias("id"), k.cast("string").alias("chrom"), (k * 7 % 90).alias("start0"), (k * 7 % 90 + 1 + k % 150).alias("end0"))
    return fasta.slices(_pieces(spark, sf_dir), x, "id", 64).select("id", "start0", "end0", "seq")


def fa_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of two exons on both strands."""
    k = F.col("doc_id")
    pair = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    x = table(spark, sf_dir, "documents").select(k.alias("transcript_id"), k.cast("string").alias("chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.array(pair(70 + k % 20, 100 + k % 40), pair(k % 9, 30 + k % 20)).alias("exons"))
    return fasta.splice(_pieces(spark, sf_dir), x, piece=64).select("transcript_id", "strand", F.coalesce("seq", F.lit("")).alias("seq"))


def _torfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as transcript ORFs of one block; every fiftieth has no ends."""
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in orfs.PRIORITY])
    start, size = (F.lit(101) + k % 40).cast("long"), (F.lit(30) + 3 * (k % 5)).cast("long")
    ends = lambda c: F.when(k % 50 != 0, c)
    return table(spark, sf_dir, "part").select(
        k.alias("line"), F.concat(F.lit("t"), k.cast("string")).alias("torf"), F.concat(F.lit("x"), (k % 37).cast("string")).alias("tx"), F.when(k % 8 == 0, "").otherwise(F.col("p_brand")).alias("gene"), F.concat(F.lit("N"), (k % 9).cast("string")).alias("gene_name"),
        F.element_at(kinds, (k % 9 + 1).cast("int")).alias("biotype"), F.concat(F.lit("chr"), (k % 3).cast("string")).alias("chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), ends(start).alias("start1"), ends(start + size - 1).alias("end1"),
        F.array(size).alias("sizes"), F.array(start).alias("starts1"), (k * 7 % 11).alias("peptide_len"), F.repeat(F.lit("M"), (k * 7 % 11).cast("int")).alias("peptide"), (k * 5 % 13).alias("aa_len"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("same_gene"), F.when(k % 5 == 0, 1).otherwise(0).alias("any_gene"), F.when(k % 5 == 0, 1).otherwise(0).alias("confounded"),
    )


def gorf_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.collapse(_torfs(spark, sf_dir))


def gorf_by_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.collapse(_torfs(spark, sf_dir), "stop")


def gorf_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on tables with faults: tORFs that come twice, members without an ORF, a genomic ORF without members."""
    x = _torfs(spark, sf_dir)
    members = orfs.members(x.filter("line % 71 <> 3")).union(spark.createDataFrame([("g|none", "t-none")], "gorf_id string, torf string"))
    gorfs = orfs.with_gorf(x).select("gorf_id", "gorf_signature").distinct().union(spark.createDataFrame([("g|empty", "s"), ("g|twice", "a"), ("g|twice", "b"), ("", "c")], "gorf_id string, gorf_signature string"))
    return orfs.audit(x.select("torf").union(x.filter("line % 97 = 0").select("torf")), members, gorfs)


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read lengths from events: 25 has no offset, 26 one beyond the read, 33 no counts, 34 neither reads nor counts."""
    e = domain.psites(spark, sf_dir).withColumn("f", F.when(F.col("pos") % 5 < 4, F.col("rl") % 3).otherwise(F.col("pos") % 3))
    s = e.groupBy(F.col("rl").cast("int").alias("length")).agg(F.count(F.lit(1)).alias("reads"), *[F.count_if(F.col("f") == k).alias(f"f{k}") for k in range(3)])
    s = s.union(spark.createDataFrame([(34, 0, 0, 0, 0)], "length int, reads long, f0 long, f1 long, f2 long"))
    offset = F.when(F.col("length") == 25, None).when(F.col("length") == 26, 27).otherwise(12 + F.col("length") % 3 + F.when(F.col("length") == 30, 1).otherwise(0))
    counted = lambda c: F.when(F.col("length") != 33, F.col(c)).alias(c)
    return s.select("length", offset.cast("int").alias("offset"), "reads", *[counted(f"f{k}") for k in range(3)])


def ps_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = psites.select_offsets(_support(spark, sf_dir), whitelist=[27, 28, 29, 30, 31, 33, 34])
    return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in out.dtypes])


def ps_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = psites.override_offsets(_support(spark, sf_dir), [26, 28, 40])
    return out.select("selection_mode", F.col("length").cast("long").alias("length"), F.col("offset").cast("long").alias("offset"), "selected", "reason")


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments made from lineitem, each row one: a clip, an intron and an insertion in a read of 30 bases; some begin with = or X."""
    clip, gap, p = F.col("l_partkey") % 3, F.col("l_suppkey") % 4, F.col("l_partkey") % 5
    s = lambda c: c.cast("string")
    first = F.when(p == 0, "=").when(p == 1, "X").otherwise("M")
    cigar = F.concat(F.when(clip > 0, F.concat(s(clip), F.lit("S"))).otherwise(""), s(12 - clip), first, F.when(gap > 0, F.concat(s(gap * 50), F.lit("N"))).otherwise(""), F.lit("3M2I"), F.lit("13M"))
    forward = F.col("l_orderkey") % 2 != 0
    md = F.when((p < 2) & forward, None).when(F.col("l_partkey") % 7 == 0, "0A27").otherwise("28")
    reads = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", s(F.col("l_linenumber")), "l_suppkey").alias("qname"), F.when(forward, 0).otherwise(16).alias("flag"), F.lit("chr1").alias("rname"), (F.col("l_partkey") * 10).alias("pos0"),
        (F.col("l_partkey") * 7 % 60).alias("mapq"), cigar.alias("cigar"), md.alias("md"), F.when(F.col("l_linenumber") == 7, 2).when(F.col("l_linenumber") != 6, 1).alias("nh"), F.repeat(F.lit("acgtn"), 6).alias("seq"),
    )
    return psites.call(reads, spark.createDataFrame([(30, 12)], "length int, offset int"))


def ps_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(spark, sf_dir).select("qname", F.coalesce("reason", F.lit("called")).alias("reason"), "psite")


def ps_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psites.rejections(_called(spark, sf_dir))


def ps_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = psites.records(_called(spark, sf_dir))
    return out.select("qname", "flag", "pos0", "cigar", "seq", "OL", "AL", "PO", "RL", "NH")


def _context_torfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates' ORFs (two of a genomic ORF) and suppliers as CDSs, each of two blocks."""
    strand = F.when(F.col("gene_id") % 2 == 0, "+").otherwise("-")

    def made(x: DataFrame, cds: bool) -> DataFrame:
        starts, ends = F.array("s", F.col("s") + 40), F.array(F.col("s") + 14, F.col("s") + 39 + F.col("n"))
        x = x.withColumn("strand", strand).withColumn("peptide_len", F.expr("(15 + n) div 3")).withColumn("path", context.translation_path(starts, ends, F.col("strand"), F.col("peptide_len")))
        letter = lambda i: F.substring(F.lit("ACDEF"), (F.element_at("path", (i * 3 + 1).cast("int")) % 5 + 1).cast("int"), F.lit(1))
        own = letter if cds else lambda i: F.when((F.col("k") % 3 == 0) & (i >= 2), "W").when((F.col("k") % 7 == 0) & (i >= 6), "Y").otherwise(letter(i))
        pep = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("peptide_len") - 1), own), "")
        tag = F.element_at(F.array(F.lit("basic;MANE_Select"), F.lit("CCDS"), F.lit("Ensembl_canonical"), F.lit("appris_principal_1"), F.lit("")), (F.col("k") % 5 + 1).cast("int"))
        kind = "c" if cds else "t"
        return x.select(
            F.concat(F.lit(kind), F.col("k").cast("string")).alias("torf_id"), (F.lit("") if cds else F.concat(F.lit("g"), F.expr("k div 2").cast("string"))).alias("gorf_id"), F.col("gene_id").cast("string").alias("gene_id"), F.concat(F.lit("T"), F.col("k").cast("string")).alias("transcript_id"),
            F.concat(F.lit("name"), F.col("k").cast("string")).alias("transcript_name"), tag.alias("tx_tags"), F.lit("chr1").alias("chrom"), "strand", F.lit(cds).alias("is_annotated_cds"), "path", pep.alias("peptide"),
        )

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("(c_custkey div 2) % 25").alias("gene_id"), (F.col("c_custkey") * 3 % 45).alias("s"), (12 + F.col("c_custkey") % 4 * 3).alias("n"))
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 23).alias("gene_id"), (F.col("s_suppkey") * 6 % 45).alias("s"), (15 + F.col("s_suppkey") % 5 * 3).alias("n"))
    # few bytes are much work here, so small files must not be one task, nor many tasks that cost more than their rows
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return made(c.repartition(parts, "k"), False).unionByName(made(d.repartition(parts, "k"), True))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    torfs = _context_torfs(spark, sf_dir)
    x = torfs.filter("not is_annotated_cds").select("gorf_id", "gene_id").distinct().union(spark.createDataFrame([("g-none", "3")], "gorf_id string, gene_id string"))
    return context.context(x.withColumn("primary_credible_call", F.when(F.length("gorf_id") % 2 == 0, 1).otherwise(0)), torfs)


def cx_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _context(spark, sf_dir)
    return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "primary_credible_call"])


def cx_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.class_counts(_context(spark, sf_dir))


def cx_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose genomic ORF is in the table with another gene only, or not at all."""
    k = F.col("c_custkey")
    x = table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), F.expr("c_custkey div 2").cast("string")).alias("gorf_id"), F.when(k % 11 == 0, "other").otherwise(F.expr("cast((c_custkey div 2) % 25 as string)")).alias("gene_id"))
    return context.uncovered(x, _context_torfs(spark, sf_dir))


N_CODONS = 3000


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cand_codons(spark, sf_dir).select(F.col("orf").alias("candidate_key"), "codon", F.lit(N_CODONS).cast("long").alias("n_codons"), "c0", "c1", "c2")
    return export.core(x, 1, 1)


def _export_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("candidate_key")
    pair = lambda s, e: F.struct(s.cast("long").alias("start0"), e.cast("long").alias("end0"))
    x = cand_codons(spark, sf_dir).select(F.col("orf").alias("candidate_key")).distinct()
    return x.select("candidate_key", F.lit("chr1").alias("chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.array(pair(1050 + k, 1050 + k + 3 * N_CODONS - 31), pair(1000 + k, 1031 + k)).alias("blocks"))


def _plain(out: DataFrame) -> DataFrame:
    return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def ex_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(export.codon_rows(_core(spark, sf_dir), _export_orfs(spark, sf_dir), least_reads=2))


def ex_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(export.ternary_rows(_core(spark, sf_dir), least_reads=2))


def ex_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(export.summaries(_core(spark, sf_dir), least_reads=2))


def ex_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved totals, one in ten with a read too many and one in fifteen without a number, against the codons."""
    k = F.col("candidate_key")
    saved = export.totals(_core(spark, sf_dir)).withColumn("core_reads", F.when(k % 15 == 0, "n/a").otherwise((F.col("core_reads") + F.when(k % 10 == 3, 1).otherwise(0)).cast("string")))
    return export.reconciled(saved.select("candidate_key", "core_reads", "n_core_codons", "observed_phase1_core_reads"), _core(spark, sf_dir))


def ex_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credible and pure orders, by their candidate keys."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("g"), k.cast("string"))).alias("gorf_id"), F.concat(F.lit("t"), k.cast("string")).alias("torf_id"), F.lit("F1").alias("overlap_type"),
        F.when(k % 3 == 0, "True").otherwise("0").alias("primary_credible_call"), F.when(k % 5 == 0, "0").otherwise("yes").alias("gene_level_pure_intorf_eligible"))
    return export.selected(x, pure_only=True).select("candidate_key", "torf_id")


_SEQ = "seqs AS (SELECT doc_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS seq FROM documents)"
_TORF_SQL = """t AS (SELECT p_partkey AS line, 't' || p_partkey AS torf, 'x' || (p_partkey % 37) AS tx, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand END AS gene, 'N' || (p_partkey % 9) AS gene_name, p_partkey % 9 AS rk,
  ['CDS', 'intORF_inframe', 'intORF_altframe', 'uoORF', 'doORF', 'uORF', 'dORF', 'other', 'ncORF'][p_partkey % 9 + 1] AS biotype, 'chr' || (p_partkey % 3) AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 101 + p_partkey % 40 AS s1, 30 + 3 * (p_partkey % 5) AS size,
  p_partkey % 50 <> 0 AS ends, p_partkey * 7 % 11 AS pl, p_partkey * 5 % 13 AS al, CAST(p_partkey % 10 = 0 AS INT) AS sg, CAST(p_partkey % 5 = 0 AS INT) AS ag FROM part)"""


def _gorf_sql(by: str) -> str:
    blocks = lambda kind: f"""'{{"key":["{kind}","' || chrom || '","' || strand || '",[' || size || '],[' || s1 || ']],"merge_by":"{by}"}}'"""
    stop = """'{"key":["stop","' || chrom || '","' || strand || '",' || (CASE WHEN strand = '-' THEN s1 ELSE s1 + size - 1 END) || ',' || ((CASE WHEN strand = '-' THEN s1 ELSE s1 + size - 1 END) - 1) % 3 || '],"merge_by":"stop"}'"""
    sig = blocks("blocks") if by == "blocks" else f"CASE WHEN ends THEN {stop} ELSE {blocks('fallback_blocks')} END"
    return f"""WITH {_TORF_SQL}, s AS (SELECT *, {sig} AS sig FROM t), k AS (SELECT *, 'g|' || chrom || '|' || strand || '|{by}|h' || substr(sha1(sig), 1, 16) AS gorf_id FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY gorf_id ORDER BY rk, pl DESC, al DESC, torf) AS rn FROM k), rep AS (SELECT * FROM r WHERE rn = 1),
g AS (SELECT gorf_id, gene, row_number() OVER (PARTITION BY gorf_id ORDER BY count(*) DESC, min(line)) AS rn FROM k WHERE gene <> '' GROUP BY gorf_id, gene),
h AS (SELECT gorf_id, gene_name, row_number() OVER (PARTITION BY gorf_id ORDER BY count(*) DESC, min(line)) AS rn FROM k GROUP BY gorf_id, gene_name),
b AS (SELECT gorf_id, string_agg(biotype || ':' || n, ',' ORDER BY rk) AS biotype_summary FROM (SELECT gorf_id, rk, biotype, count(*) AS n FROM k GROUP BY ALL) GROUP BY gorf_id),
a AS (SELECT gorf_id, count(*) AS n_members, CAST(count(DISTINCT tx) AS INT) AS n_transcripts, string_agg(DISTINCT tx, ',' ORDER BY tx) AS transcripts, string_agg(torf, ',' ORDER BY line) AS torf_ids, max(sg) AS sg, max(ag) AS ag FROM k GROUP BY gorf_id)
SELECT rep.gorf_id, sig AS gorf_signature, '{by}' AS merge_by, coalesce(g.gene, rep.gene) AS gene_id, h.gene_name, chrom, strand, CASE WHEN ends THEN s1 END AS "chromStart1", CASE WHEN ends THEN s1 + size - 1 END AS "chromEnd1", 1 AS "blockCount", CAST(size AS VARCHAR) AS "blockSizes",
  CAST(s1 AS VARCHAR) AS genomic_block_starts1, CAST(s1 + size - 1 AS VARCHAR) AS genomic_block_ends1, torf AS representative, biotype AS orf_biotype_rep, biotype_summary, a.sg AS intorf_shared_annotated_stop_same_gene_any, a.ag AS intorf_shared_annotated_stop_any_gene_any,
  a.ag AS intorf_annotated_stop_confounded_any, pl AS peptide_len, repeat('M', CAST(pl AS INT)) AS peptide, n_members, n_transcripts, transcripts, torf_ids
FROM rep JOIN a ON rep.gorf_id = a.gorf_id JOIN b ON rep.gorf_id = b.gorf_id JOIN h ON rep.gorf_id = h.gorf_id AND h.rn = 1 LEFT JOIN g ON rep.gorf_id = g.gorf_id AND g.rn = 1"""


_SUPPORT_SQL = f"""WITH {domain.PSITE_SQL}, e AS (SELECT rl, CASE WHEN pos % 5 < 4 THEN rl % 3 ELSE pos % 3 END AS f FROM psite),
s AS (SELECT rl AS length, count(*) AS reads, count(*) FILTER (f = 0) AS f0, count(*) FILTER (f = 1) AS f1, count(*) FILTER (f = 2) AS f2 FROM e GROUP BY rl UNION ALL SELECT 34, 0, 0, 0, 0),
o AS (SELECT length, CASE WHEN length = 26 THEN 27 WHEN length <> 25 THEN 12 + length % 3 + CAST(length = 30 AS INT) END AS o, reads, CASE WHEN length <> 33 THEN f0 END AS f0, CASE WHEN length <> 33 THEN f1 END AS f1, CASE WHEN length <> 33 THEN f2 END AS f2 FROM s)"""
_CALL_SQL = """x AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS ln, l_suppkey AS s, l_partkey % 3 AS clip, (l_suppkey % 4) * 50 AS gap, l_orderkey % 2 = 0 AS rev, l_partkey % 5 AS e FROM lineitem),
q AS (SELECT *, CASE WHEN rev THEN 29 - 12 ELSE clip + 12 END AS qi FROM x),
r AS (SELECT *, CASE WHEN qi < 12 THEN p * 10 + qi - clip WHEN qi < 15 THEN p * 10 + qi - clip + gap WHEN qi < 17 THEN NULL ELSE p * 10 + qi - clip + gap - 2 END AS pos,
  CASE WHEN p * 7 % 60 < 20 THEN 'skipped_mapq' WHEN ln = 7 THEN 'skipped_multimapper' WHEN NOT rev AND clip > 0 THEN 'skipped_5p_not_aligned' WHEN NOT rev AND (e = 1 OR (e > 1 AND p % 7 = 0)) THEN 'skipped_5p_mismatch' END AS why FROM q),
z AS (SELECT *, coalesce(why, CASE WHEN pos IS NULL THEN 'skipped_qmap' ELSE 'called' END) AS reason, concat_ws('-', o, p, ln, s) AS qname FROM r)"""
_CX_SQL = """c AS (SELECT false AS cds, c_custkey AS k, (c_custkey // 2) % 25 AS gene, c_custkey * 3 % 45 AS s, 12 + c_custkey % 4 * 3 AS n FROM customer UNION ALL SELECT true, s_suppkey, s_suppkey % 23, s_suppkey * 6 % 45, 15 + s_suppkey % 5 * 3 FROM supplier),
pos AS (SELECT cds, k, gene, i, CASE WHEN gene % 2 = 0 THEN CASE WHEN i < 15 THEN s + i ELSE s + 25 + i END ELSE CASE WHEN i < n THEN s + 39 + n - i ELSE s + 14 - (i - n) END END AS x, n FROM (SELECT *, unnest(range(0, 15 + n)) AS i FROM c)),
pep AS (SELECT cds, k, i // 3 AS j, CASE WHEN NOT cds AND k % 3 = 0 AND i // 3 >= 2 THEN 'W' WHEN NOT cds AND k % 7 = 0 AND i // 3 >= 6 THEN 'Y' ELSE substr('ACDEF', CAST(x % 5 + 1 AS INT), 1) END AS a FROM pos WHERE i % 3 = 0),
st AS (SELECT a.k AS tk, b.k AS ck, a.gene, b.i AS at0, a.n + 15 AS path_nt, b.n + 15 AS cds_nt FROM pos a JOIN pos b ON NOT a.cds AND a.i = 0 AND b.cds AND a.gene = b.gene AND a.x = b.x WHERE b.i % 3 = 0),
nt AS (SELECT st.*, (SELECT coalesce(min(a.i) FILTER (b.x IS NULL OR a.x <> b.x), count(*)) FROM pos a LEFT JOIN pos b ON b.cds AND b.k = st.ck AND b.i = st.at0 + a.i WHERE NOT a.cds AND a.k = st.tk) AS nt,
  (SELECT coalesce(min(a.j) FILTER (b.a IS NULL OR a.a <> b.a), count(*)) FROM pep a LEFT JOIN pep b ON b.cds AND b.k = st.ck AND b.j = st.at0 // 3 + a.j WHERE NOT a.cds AND a.k = st.tk) AS aa FROM st),
m AS (SELECT *, 'g' || (tk // 2) AS gorf_id, CAST(gene AS VARCHAR) AS gene_id, ck % 5 AS prio, ['basic;MANE_Select', 'CCDS', 'Ensembl_canonical', 'appris_principal_1', ''][ck % 5 + 1] AS tags,
  CASE WHEN nt >= path_nt THEN 'candidate_fully_contained_in_annotated_cds_path' WHEN nt >= cds_nt - at0 THEN 'annotated_cds_path_ended' ELSE 'splice_or_coordinate_path_divergence' END AS why FROM nt),
b AS (SELECT *, row_number() OVER (PARTITION BY gorf_id, gene_id ORDER BY nt DESC, aa DESC, prio, 'T' || ck, 't' || tk) AS rn, max(nt) OVER (PARTITION BY gorf_id, gene_id) AS top FROM m),
ties AS (SELECT gorf_id, gene_id, string_agg(DISTINCT 'T' || ck, ',' ORDER BY 'T' || ck) AS tied FROM (SELECT *, max(aa) OVER (PARTITION BY gorf_id, gene_id) AS topaa FROM b WHERE nt = top) WHERE aa = topaa GROUP BY gorf_id, gene_id),
keys AS (SELECT 'g' || (k // 2) AS gorf_id, CAST(gene AS VARCHAR) AS gene_id, min('t' || k) AS first_torf FROM c WHERE NOT cds GROUP BY 1, 2 UNION ALL SELECT 'g-none', '3', NULL),
ctx AS (SELECT keys.*, b.*  EXCLUDE (gorf_id, gene_id), tied, CASE WHEN b.nt IS NULL THEN 'none' WHEN b.nt // 3 < 5 THEN 'below_minimum_prefix' WHEN b.nt >= path_nt THEN 'full_coordinate_path' WHEN b.aa >= path_nt // 3 THEN 'full_peptide_alternative_path' ELSE 'partial_nterm_reuse' END AS kind
  FROM keys LEFT JOIN b ON b.rn = 1 AND b.gorf_id = keys.gorf_id AND b.gene_id = keys.gene_id LEFT JOIN ties ON ties.gorf_id = keys.gorf_id AND ties.gene_id = keys.gene_id),
cls AS (SELECT *, CASE kind WHEN 'full_coordinate_path' THEN 'annotated_cds_derived_full_coordinate_path' WHEN 'full_peptide_alternative_path' THEN 'annotated_cds_full_peptide_alternative_coordinate_path' WHEN 'partial_nterm_reuse' THEN 'annotated_cds_nterm_reuse_with_splice_derived_cterm'
  ELSE 'pure_intorf_no_annotated_cds_nterm_reuse' END AS gene_level_orf_class, coalesce(nt // 3 >= 5, false) AS enough FROM ctx)"""
_CORE_SQL = f"""{CAND_SQL}, core AS (SELECT orf AS candidate_key, codon, codon - 1 AS core_codon_index0, c0, c1, c2, c0 + c1 + c2 AS n FROM cand WHERE codon >= 1 AND codon < {N_CODONS - 1})"""


def _place(f: int) -> str:
    t = f"(codon * 3 + {f})"
    return f"CASE WHEN candidate_key % 2 = 0 THEN CASE WHEN {t} < 31 THEN 1000 + candidate_key + {t} ELSE 1050 + candidate_key + {t} - 31 END ELSE CASE WHEN {t} < {3 * N_CODONS - 31} THEN 1050 + candidate_key + {3 * N_CODONS - 32} - {t} ELSE 1030 + candidate_key - ({t} - {3 * N_CODONS - 31}) END END + 1"


QUERIES = {
    f.__name__: f
    for f in (fa_slices, fa_splice, gorf_by_blocks, gorf_by_stop, gorf_audit, ps_audit, ps_override, ps_calls, ps_rejections, ps_records, cx_context, cx_class_counts, cx_uncovered, ex_codons, ex_ternary, ex_summary, ex_reconcile, ex_selected)
}
ORACLES = {
    "fa_slices": f"WITH {_SEQ} SELECT doc_id AS id, doc_id * 7 % 90 AS start0, doc_id * 7 % 90 + 1 + doc_id % 150 AS end0, substr(coalesce(seq, ''), CAST(doc_id * 7 % 90 + 1 AS INT), CAST(1 + doc_id % 150 AS INT)) AS seq FROM seqs",
    "fa_splice": f"""WITH {_SEQ}, x AS (SELECT doc_id, substr(coalesce(seq, ''), CAST(doc_id % 9 + 1 AS INT), CAST(30 + doc_id % 20 - doc_id % 9 AS INT)) || substr(coalesce(seq, ''), CAST(71 + doc_id % 20 AS INT), CAST(30 + doc_id % 40 - doc_id % 20 AS INT)) AS s FROM seqs)
SELECT doc_id AS transcript_id, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN doc_id % 2 = 0 THEN s ELSE reverse(translate(s, 'ACGT', 'TGCA')) END AS seq FROM x""",
    "gorf_by_blocks": _gorf_sql("blocks"),
    "gorf_by_stop": _gorf_sql("stop"),
    "gorf_audit": f"""WITH {_TORF_SQL}, k AS (SELECT *, 'g|' || chrom || '|' || strand || '|blocks|h' || substr(sha1('{{"key":["blocks","' || chrom || '","' || strand || '",[' || size || '],[' || s1 || ']],"merge_by":"blocks"}}'), 1, 16) AS g FROM t),
tt AS (SELECT torf FROM k UNION ALL SELECT torf FROM k WHERE line % 97 = 0), mm AS (SELECT g, torf FROM k WHERE line % 71 <> 3 UNION ALL SELECT 'g|none', 't-none'),
gg AS (SELECT DISTINCT g, 's' || g AS sig FROM k UNION ALL SELECT * FROM (VALUES ('g|empty', 's'), ('g|twice', 'a'), ('g|twice', 'b'), ('', 'c')))
SELECT 'torf_rows' AS metric, (SELECT count(*) FROM tt) AS value UNION ALL SELECT 'member_rows', (SELECT count(*) FROM mm) UNION ALL SELECT 'gorf_rows', (SELECT count(*) FROM gg) UNION ALL SELECT 'blank_torf_ids', 0 UNION ALL SELECT 'blank_member_ids', 0 UNION ALL SELECT 'blank_gorf_ids', 1
UNION ALL SELECT 'duplicate_torf_ids', (SELECT count(*) FROM (SELECT torf FROM tt GROUP BY torf HAVING count(*) > 1)) UNION ALL SELECT 'duplicate_member_pairs', 0 UNION ALL SELECT 'duplicate_gorf_ids', 1 UNION ALL SELECT 'torfs_of_several_gorfs', 0 UNION ALL SELECT 'ids_of_several_signatures', 1
UNION ALL SELECT 'torfs_without_member', (SELECT count(DISTINCT torf) FROM tt WHERE torf NOT IN (SELECT torf FROM mm)) UNION ALL SELECT 'members_without_torf', 1 UNION ALL SELECT 'gorfs_without_member', (SELECT count(DISTINCT g) FROM gg WHERE g NOT IN (SELECT g FROM mm)) UNION ALL SELECT 'members_without_gorf', 1""",
    "ps_audit": f"""{_SUPPORT_SQL}, v AS (SELECT *, o >= 0 AND o < length AND f0 IS NOT NULL AS ok FROM o),
r AS (SELECT *, CASE WHEN ok THEN CASE (24 - o) % 3 WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END END AS p0, CASE WHEN ok THEN CASE (25 - o) % 3 WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END END AS p1, CASE WHEN ok THEN CASE (26 - o) % 3 WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END END AS p2 FROM v),
w AS (SELECT *, CASE WHEN o IS NULL THEN 'missing_main_offset' WHEN o >= length THEN 'invalid_offset' WHEN f0 IS NULL THEN 'missing_matched_frame_counts' WHEN p0 + p1 + p2 = 0 THEN 'no_matched_frame_reads' WHEN 3 * p0 <= 2 * (p0 + p1 + p2) THEN 'frame0_not_above_threshold'
  WHEN length NOT IN (27, 28, 29, 30, 31, 33, 34) THEN 'not_in_keep_lengths' END AS why FROM r),
i AS (SELECT *, length - row_number() OVER (ORDER BY length) AS k FROM w WHERE why IS NULL), best AS (SELECT k FROM i GROUP BY k ORDER BY sum(reads) DESC, count(*) DESC, min(length) LIMIT 1),
f AS (SELECT w.*, coalesce(why, CASE WHEN length NOT IN (SELECT length FROM i WHERE k IN (SELECT k FROM best)) THEN 'outside_dominant_contiguous_block' END) AS y FROM w)
SELECT 'ribotish_quality' AS selection_mode, '5prime_match' AS quality_group, CAST(12 AS BIGINT) AS ribotish_qc_offset, round(2 / 3, 6) AS min_frame0_proportion, 'dominant_contiguous' AS length_selection_policy, length, CAST(o AS BIGINT) AS "offset", reads AS matched_reads, f0 AS raw_frame0, f1 AS raw_frame1, f2 AS raw_frame2,
  p0 AS corrected_frame0, p1 AS corrected_frame1, p2 AS corrected_frame2, round(p0 / nullif(p0 + p1 + p2, 0), 6) AS corrected_frame0_proportion, CAST(y IS NULL AS BIGINT) AS selected, coalesce(y, 'selected_quality') AS reason FROM f""",
    "ps_override": f"""{_SUPPORT_SQL}, l AS (SELECT length, o FROM o UNION ALL SELECT 40, NULL), x AS (SELECT *, CASE WHEN length NOT IN (26, 28, 40) THEN 'not_in_keep_lengths' WHEN o IS NULL THEN 'missing_main_offset' WHEN o >= length THEN 'invalid_offset' ELSE 'selected_explicit_override' END AS reason FROM l)
SELECT 'explicit_keep_lengths' AS selection_mode, CAST(length AS BIGINT) AS length, CAST(o AS BIGINT) AS "offset", CAST(reason = 'selected_explicit_override' AS INT) AS selected, reason FROM x""",
    "ps_calls": f"WITH {_CALL_SQL} SELECT qname, reason, CASE WHEN reason = 'called' THEN pos END AS psite FROM z",
    "ps_rejections": f"WITH {_CALL_SQL} SELECT CASE WHEN reason = 'called' THEN 'written' ELSE reason END AS reason, count(*) AS n FROM z GROUP BY 1",
    "ps_records": f"""WITH {_CALL_SQL} SELECT qname, CASE WHEN rev THEN 16 ELSE 0 END AS flag, pos AS pos0, '1M' AS cigar, substr('ACGTNACGTNACGTNACGTNACGTNACGTN', CAST(qi + 1 AS INT), 1) AS seq, 30 AS "OL", CAST(28 - clip AS INT) AS "AL", 12 AS "PO", 30 AS "RL", CASE WHEN ln <> 6 THEN 1 END AS "NH" FROM z WHERE reason = 'called'""",
    "cx_context": f"""WITH {_CX_SQL} SELECT gorf_id, gene_id, gene_level_orf_class, CAST(NOT enough AS INT) AS gene_level_pure_intorf_eligible, CAST(enough AS INT) AS gene_cds_nterm_match, kind AS gene_cds_nterm_context, coalesce('t' || tk, first_torf, '') AS gene_cds_nterm_candidate_torf_id,
  coalesce('T' || ck, '') AS gene_cds_nterm_best_transcript_id, coalesce('name' || ck, '') AS gene_cds_nterm_best_transcript_name, coalesce(tags, '') AS gene_cds_nterm_best_transcript_tags, coalesce(tied, '') AS gene_cds_nterm_tied_transcript_ids, CAST(coalesce(nt, 0) AS BIGINT) AS gene_cds_nterm_coordinate_prefix_nt,
  CAST(coalesce(nt // 3, 0) AS BIGINT) AS gene_cds_nterm_coordinate_prefix_complete_codons, round(coalesce(nt / path_nt, 0), 6) AS gene_cds_nterm_coordinate_prefix_fraction, CAST(coalesce(aa, 0) AS BIGINT) AS gene_cds_nterm_peptide_prefix_aa, round(coalesce(aa / (path_nt // 3), 0), 6) AS gene_cds_nterm_peptide_prefix_fraction,
  coalesce(why, CASE WHEN first_torf IS NULL THEN 'candidate_gorf_absent_from_torf' WHEN CAST(gene_id AS BIGINT) NOT IN (SELECT gene FROM c WHERE cds) THEN 'no_annotated_cds_for_same_versioned_gene' ELSE 'no_same_gene_same_strand_codon_aligned_coordinate_prefix' END) AS gene_cds_nterm_break_reason, 5 AS gene_cds_nterm_min_prefix_codons FROM cls""",
    "cx_class_counts": f"""WITH {_CX_SQL}, u AS (SELECT unnest(['gene_level_orf_class::' || gene_level_orf_class, CASE WHEN length(gorf_id) % 2 = 0 THEN 'primary_gene_level_orf_class::' || gene_level_orf_class END, 'candidate_rows']) AS metric FROM cls) SELECT metric, count(*) AS value FROM u WHERE metric IS NOT NULL GROUP BY metric""",
    "cx_uncovered": "SELECT DISTINCT 'g' || (c_custkey // 2) AS gorf_id, 'other' AS gene_id FROM customer WHERE c_custkey % 11 = 0",
    "ex_codons": f"""WITH {_CORE_SQL} SELECT candidate_key, 'chr1' AS chrom, CASE WHEN candidate_key % 2 = 0 THEN '+' ELSE '-' END AS strand, codon AS orf_codon_index0, core_codon_index0, {", ".join(f"{_place(f)} AS phase{f}_genomic_pos1" for f in range(3))},
  {", ".join(f"c{f} AS phase{f}_reads" for f in range(3))}, n AS codon_reads, {", ".join(f"round(c{f} / n, 6) AS phase{f}_fraction" for f in range(3))}, {", ".join(f"round(100.0::DOUBLE * c{f} / n, 6) AS phase{f}_percent" for f in range(3))} FROM core WHERE n >= 2""",
    "ex_ternary": f"""WITH {_CORE_SQL}, g AS (SELECT *, gcd(gcd(c0, c1), c2) AS g FROM core WHERE n >= 2), r AS (SELECT candidate_key, CAST(c0 // g AS BIGINT) AS a, CAST(c1 // g AS BIGINT) AS b, CAST(c2 // g AS BIGINT) AS c, count(*) AS k FROM g GROUP BY ALL), t AS (SELECT *, CAST(sum(k) OVER (PARTITION BY candidate_key) AS BIGINT) AS total FROM r)
SELECT candidate_key, a AS "phase_ratio_P0", b AS "phase_ratio_P1", c AS "phase_ratio_P2", round(a / (a + b + c), 6) AS "exact_P0_fraction", round(b / (a + b + c), 6) AS "exact_P1_fraction", round(c / (a + b + c), 6) AS "exact_P2_fraction", round(100.0::DOUBLE * a / (a + b + c), 6) AS "exact_P0_percent",
  round(100.0::DOUBLE * b / (a + b + c), 6) AS "exact_P1_percent", round(100.0::DOUBLE * c / (a + b + c), 6) AS "exact_P2_percent", k AS codon_count, total AS total_plotted_codons, round(100.0::DOUBLE * k / total, 6) AS candidate_percentage FROM t""",
    "ex_summary": f"""WITH {_CORE_SQL} SELECT candidate_key, CAST({N_CODONS - 2} AS BIGINT) AS n_core_codons, count(*) FILTER (n > 0) AS n_active_core_codons, count(*) FILTER (n >= 2) AS n_plotted_codons, CAST(sum(n) AS BIGINT) AS core_reads, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS plotted_codon_reads,
  {", ".join(f'round(coalesce(100.0::DOUBLE * avg(c{f} / n) FILTER (n >= 2), 0), 6) AS "codon_equal_mean_P{f}_percent"' for f in range(3))}, {", ".join(f'round(coalesce(100.0::DOUBLE * avg(CAST(c{f} = n AS INT)) FILTER (n >= 2), 0), 6) AS "P{f}_vertex_percent"' for f in range(3))} FROM core GROUP BY candidate_key""",
    "ex_reconcile": f"""WITH {_CORE_SQL}, t AS (SELECT candidate_key, CAST(sum(n) AS BIGINT) AS n FROM core GROUP BY candidate_key)
SELECT candidate_key, CASE WHEN candidate_key % 10 = 3 AND candidate_key % 15 <> 0 THEN 'core_reads: result=' || (n + 1) || ', recomputed=' || n ELSE '' END AS mismatches, CASE WHEN candidate_key % 10 = 3 AND candidate_key % 15 <> 0 THEN 'mismatch' ELSE 'exact_match' END AS status FROM t""",
    "ex_selected": "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 't' || o_orderkey ELSE 'g' || o_orderkey || '|F1' END AS candidate_key, 't' || o_orderkey AS torf_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0",
}
