"""Transcript models, ORF kinds, coordinate maps and candidates on the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators import candidates, orfs, transcripts
from codonlake.plans.annotation import SCAN_SQL, SEQ_SQL, tx_sequences
from codonlake.plans.inference import ORACLES as INFERENCE_SQL
from codonlake.plans.inference import iv_core_summary
from codonlake.sources.tables import table


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a CDS from a tenth to the half of them, start and stop by the transcript's number: a third lack each, in turn."""
    x = tx_sequences(spark, sf_dir).withColumn("n", F.length("seq").cast("long"))
    lo, hi = F.expr("n div 10"), F.expr("n div 10 + (n div 9) * 3")
    one = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
    none = transcripts.none()
    return x.select(
        "tx", "seq", F.when(F.col("tx") % 5 != 4, one(lo, hi)).otherwise(none).alias("cds"), F.when(F.col("tx") % 3 != 2, one(lo, lo + 3)).otherwise(none).alias("start_codon"),
        F.when(F.col("tx") % 4 == 1, one(hi, hi + 3)).otherwise(none).alias("stop_codon"),
    )


def tx_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = transcripts.with_model(_transcripts(spark, sf_dir))
    return x.select("tx", "tx_model", "tx_has_start_annot", "tx_has_stop_annot", "tx_stop_recovered", "tx_cds_synthesized", "tx_complete_cds", "ann_start", "ann_end", "cds_first_t", "cds_last_t")


def orf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _transcripts(spark, sf_dir)
    found = orfs.scan(base.select("tx", "seq")).select("tx", F.col("t_start").cast("long").alias("t_start"), F.col("t_end").cast("long").alias("t_end"))
    x = transcripts.kinds(transcripts.forced(found.join(transcripts.with_model(base), "tx")))
    return x.select("tx", "t_start", "t_end", "orf_biotype", "overlap_cds_bp", "overlap_utr5_bp", "overlap_utr3_bp", "is_annotated_cds", "orf_has_upstream_start_annot", "orf_shares_annotated_stop")


def orf_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' ORFs as ranges on transcripts of two exons: their genomic blocks and flanks as text, 1-based and closed."""
    k = F.col("c_custkey")
    x = table(spark, sf_dir, "customer").select(k.alias("tx"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (1000 + k % 50).alias("a"), (30 + k % 40).alias("n1"), (60 + k % 30).alias("n2"), (k % 45).alias("s"), (k % 45 + 9 + k % 21).alias("e"))
    pair = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    exons = F.array(pair(F.col("a"), F.col("a") + F.col("n1")), pair(F.col("a") + F.col("n1") + 100, F.col("a") + F.col("n1") + 100 + F.col("n2")))
    x = x.withColumn("exons", transcripts.placed(exons, F.col("strand")))
    s, e = F.col("s").cast("long"), F.col("e").cast("long")
    x = x.select("tx", transcripts.lift(F.col("exons"), F.col("strand"), s, e).alias("blocks"), *transcripts.flanks(F.col("exons"), F.col("strand"), s, e, (F.col("n1") + F.col("n2")).cast("long"), 12))
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat((p["s"] + 1).cast("string"), F.lit("-"), p["e"].cast("string"))), ",")
    return x.select("tx", text("blocks").alias("blocks"), text("flank5").alias("flank5"), text("flank3").alias("flank3"), "flank5_len", "flank3_len", "flank5_complete", "flank3_complete")


def orf_stop_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ORFs and suppliers as annotated stops, with three neighbouring positions each."""
    three = lambda s: F.array(F.struct(s.alias("s"), (s + 3).alias("e")))
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    sig = lambda k, m: transcripts.stop_signature(F.concat(F.lit("chr"), k % 3), F.when(k % 2 == 0, "+").otherwise("-"), three(k * 7 % m))
    rows = p.select(F.col("p_partkey").alias("orf"), F.when(F.col("p_partkey") % 4 == 0, "uORF").otherwise("intORF_altframe").alias("orf_biotype"), (F.col("p_partkey") % 11).alias("gene_id"), sig(F.col("p_partkey"), 600).alias("stop"))
    stops = s.select((F.col("s_suppkey") % 11).alias("gene_id"), sig(F.col("s_suppkey"), 600).alias("stop"))
    return transcripts.stop_matches(rows, stops).select("orf", "same_gene", "any_gene", "confounded")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), k.cast("string")).alias("torf"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("g"), (k % 97).cast("string"))).alias("gorf"), F.concat(F.lit("b"), (k % 31).cast("string")).alias("blocks"),
        candidates.overlap_type(k * 5 % 17, k % 3).alias("overlap_type"), F.when(k % 7 == 0, 1).otherwise(0).alias("mane"), (k * 11 % 60).alias("peptide_len"), (k * 3 % 40).alias("n_core_codons"), F.when(k % 211 == 0, 1).otherwise(0).alias("confounded"),
    )


def cand_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _members(spark, sf_dir).withColumn("reason", F.coalesce(candidates.rejection(mane_only=True), F.lit("kept")))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def cand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.grouped(_members(spark, sf_dir).filter("overlap_type is not null"))


def cand_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = iv_core_summary(spark, sf_dir).select("orf", F.col("n_core").alias("n_core_codons"), "active", "core_reads")
    return candidates.coverage(x).select("orf", "prefilter_reason", "classification_pre_fdr", "p_final")


def fdr_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = candidates.contract(table(spark, sf_dir, "orders").select(k.alias("id")), [("geometry", F.col("id") % 3 != 0), ("breadth", F.col("id") % 5 != 0), ("residual", F.nullif(F.col("id") % 7, F.lit(0)) > 0)])
    return out.groupBy("qc_flags", "qc_status").agg(F.count(F.lit(1)).alias("n"))


def fdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.summary(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("classification"), F.col("o_orderpriority").alias("family")))


_MODEL_SQL = """base AS (SELECT tx, seq, length(seq) AS n, length(seq) // 10 AS lo, length(seq) // 10 + (length(seq) // 9) * 3 AS hi FROM seqs),
flags AS (SELECT *, tx % 5 <> 4 AS has_cds, tx % 3 <> 2 AS has_start, tx % 4 = 1 AS has_stop, substr(seq, hi + 1, 3) IN ('TAA', 'TAG', 'TGA') AS next_stop,
  list_min(list_filter(range(lo, n - 2, 3), lambda i: substr(seq, i + 1, 3) IN ('TAA', 'TAG', 'TGA'))) + 3 AS made_end FROM base),
m AS (SELECT *, has_cds AND NOT has_stop AND next_stop AS found, NOT has_cds AND has_start AS made FROM flags),
m2 AS (SELECT *, has_cds OR made AS any_cds, lo AS cs, CASE WHEN made THEN coalesce(made_end - 3, n) ELSE hi END AS ce,
  CASE WHEN found THEN hi + 3 WHEN made THEN made_end WHEN has_stop THEN hi + 3 END AS se FROM m),
model AS (SELECT *, CASE WHEN NOT any_cds OR NOT has_start THEN 'non_coding' WHEN se IS NOT NULL THEN 'coding' ELSE 'no_stop' END AS tx_model,
  CASE WHEN has_start AND se > lo THEN lo END AS ann_start, CASE WHEN has_start AND se > lo THEN se END AS ann_end,
  CAST(any_cds AND has_start AND se IS NOT NULL AS INT) AS complete FROM m2)"""
_PART_SQL = """mem AS (SELECT 't' || p_partkey AS torf, CASE WHEN p_partkey % 13 = 0 THEN 'b' || p_partkey % 31 ELSE 'g' || p_partkey % 97 END AS grp,
  CASE ((p_partkey * 5 % 17 - p_partkey % 3) % 3 + 3) % 3 WHEN 1 THEN 'F1' WHEN 2 THEN 'F2' END AS overlap_type, CAST(p_partkey % 7 = 0 AS INT) AS mane, p_partkey * 11 % 60 AS peptide_len, p_partkey * 3 % 40 AS core,
  CAST(p_partkey % 211 = 0 AS INT) AS confounded FROM part)"""
QUERIES = {f.__name__: f for f in (tx_models, orf_kinds, orf_lift, orf_stop_matches, cand_filters, cand_groups, cand_prefilter, fdr_contract, fdr_summary)}
ORACLES = {
    "tx_models": f"""WITH {SEQ_SQL}, {_MODEL_SQL} SELECT tx, tx_model, CAST(has_start AS INT) AS tx_has_start_annot, CAST(has_stop AS INT) AS tx_has_stop_annot, CAST(found AS INT) AS tx_stop_recovered, CAST(made AS INT) AS tx_cds_synthesized,
  complete AS tx_complete_cds, ann_start, ann_end, CASE WHEN any_cds THEN cs END AS cds_first_t, CASE WHEN any_cds THEN ce END AS cds_last_t FROM model""",
    "orf_kinds": f"""{SCAN_SQL}, {_MODEL_SQL},
o AS (SELECT s.tx, CASE WHEN complete = 1 AND s.t_end = ann_end THEN ann_start ELSE s.t_start END AS t_start, s.t_end, complete = 1 AND ann_end IS NOT NULL AND s.t_end = ann_end AS is_cds, model.* EXCLUDE (tx) FROM found s JOIN model ON s.tx = model.tx),
v AS (SELECT *, tx_model <> 'non_coding' AND any_cds AS coding, CASE WHEN tx_model <> 'non_coding' AND any_cds THEN greatest(0, least(t_end, ce) - greatest(t_start, cs)) ELSE 0 END AS ov,
  CASE WHEN tx_model <> 'non_coding' AND any_cds THEN greatest(0, least(t_end, cs) - t_start) ELSE 0 END AS o5, CASE WHEN tx_model <> 'non_coding' AND any_cds AND ann_end IS NOT NULL THEN greatest(0, least(t_end, n) - greatest(t_start, ann_end)) ELSE 0 END AS o3 FROM o)
SELECT tx, t_start, t_end, CASE WHEN is_cds THEN 'CDS' WHEN NOT coding THEN 'ncORF' WHEN ov = t_end - t_start THEN CASE WHEN (t_start - cs) % 3 = 0 THEN 'intORF_inframe' ELSE 'intORF_altframe' END
  WHEN t_end <= cs THEN 'uORF' WHEN t_start >= ann_end THEN 'dORF' WHEN ov > 0 AND o5 > 0 THEN 'uoORF' WHEN ov > 0 AND o3 > 0 THEN 'doORF' ELSE 'other' END AS orf_biotype, ov AS overlap_cds_bp, o5 AS overlap_utr5_bp, o3 AS overlap_utr3_bp,
  CAST(coalesce(t_start = ann_start AND t_end = ann_end, false) AS INT) AS is_annotated_cds, CAST(has_start AND lo < t_start AS INT) AS orf_has_upstream_start_annot, CAST(coalesce(t_end = se, false) AS INT) AS orf_shares_annotated_stop FROM v""",
    "orf_lift": """WITH c AS (SELECT c_custkey AS tx, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS d, 1000 + c_custkey % 50 AS a, 30 + c_custkey % 40 AS n1, 60 + c_custkey % 30 AS n2, c_custkey % 45 AS s, c_custkey % 45 + 9 + c_custkey % 21 AS e FROM customer),
w AS (SELECT *, 'blocks' AS what, s AS lo, e AS hi FROM c UNION ALL SELECT *, 'flank5', greatest(0, s - 12), s FROM c UNION ALL SELECT *, 'flank3', e, least(e + 12, n1 + n2) FROM c),
p AS (SELECT tx, what, CASE WHEN d = 1 THEN CASE WHEN t < n1 THEN a + t ELSE a + t + 100 END ELSE CASE WHEN t < n2 THEN a + n1 + 99 + n2 - t ELSE a + n1 + n2 - 1 - t END END AS pos FROM (SELECT *, unnest(range(lo, hi)) AS t FROM w)),
g AS (SELECT tx, what, pos, pos - row_number() OVER (PARTITION BY tx, what ORDER BY pos) AS island FROM p),
r AS (SELECT tx, what, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY tx, what, island),
t AS (SELECT tx, what, string_agg(lo + 1 || '-' || hi + 1, ',' ORDER BY lo) AS txt FROM r GROUP BY tx, what)
SELECT c.tx, b.txt AS blocks, coalesce(f.txt, '') AS flank5, coalesce(h.txt, '') AS flank3, least(12, s) AS flank5_len, least(e + 12, n1 + n2) - e AS flank3_len, CAST(s >= 12 AS INT) AS flank5_complete, CAST(e + 12 <= n1 + n2 AS INT) AS flank3_complete
FROM c JOIN t b ON b.tx = c.tx AND b.what = 'blocks' LEFT JOIN t f ON f.tx = c.tx AND f.what = 'flank5' LEFT JOIN t h ON h.tx = c.tx AND h.what = 'flank3'""",
    "orf_stop_matches": """WITH o AS (SELECT p_partkey AS orf, p_partkey % 4 <> 0 AS alt, p_partkey % 11 AS g, p_partkey % 3 AS c, p_partkey % 2 AS d, p_partkey * 7 % 600 AS s FROM part),
k AS (SELECT DISTINCT s_suppkey % 11 AS g, s_suppkey % 3 AS c, s_suppkey % 2 AS d, s_suppkey * 7 % 600 AS s FROM supplier),
x AS (SELECT orf, CAST(alt AND EXISTS (SELECT 1 FROM k WHERE k.g = o.g AND k.c = o.c AND k.d = o.d AND k.s = o.s) AS INT) AS same_gene, CAST(alt AND EXISTS (SELECT 1 FROM k WHERE k.c = o.c AND k.d = o.d AND k.s = o.s) AS INT) AS any_gene FROM o)
SELECT *, any_gene AS confounded FROM x""",
    "cand_filters": f"""WITH {_PART_SQL} SELECT CASE WHEN overlap_type IS NULL THEN 'invalid_overlap_type' WHEN peptide_len < 6 THEN 'peptide_too_short' WHEN core < 3 THEN 'core_too_short' WHEN mane <> 1 THEN 'not_mane' ELSE 'kept' END AS reason, count(*) AS n FROM mem GROUP BY 1""",
    "cand_groups": f"""WITH {_PART_SQL}, x AS (SELECT *, grp || '|' || overlap_type AS candidate, row_number() OVER (PARTITION BY grp, overlap_type ORDER BY mane DESC, peptide_len DESC, torf DESC) AS r,
  row_number() OVER (PARTITION BY grp, overlap_type ORDER BY torf) AS k FROM mem WHERE overlap_type IS NOT NULL)
SELECT candidate, overlap_type, max(torf) FILTER (r = 1) AS representative, max(mane) FILTER (r = 1) AS mane, max(peptide_len) FILTER (r = 1) AS peptide_len, count(*) AS n_members, max(confounded) AS confounded,
  string_agg(torf, ',' ORDER BY torf) FILTER (k <= 20) AS members FROM x GROUP BY candidate, overlap_type HAVING max(confounded) = 0""",
    "cand_prefilter": f"""WITH s AS ({INFERENCE_SQL["iv_core_summary"]}), x AS (SELECT orf, CASE WHEN n_core < 3 THEN 'core_codons' WHEN active < 3 THEN 'active_codons' WHEN core_reads < 15 THEN 'core_reads' END AS prefilter_reason FROM s)
SELECT *, CASE WHEN prefilter_reason IS NULL THEN 'eligible' ELSE 'insufficient_data' END AS classification_pre_fdr, CASE WHEN prefilter_reason IS NOT NULL THEN 1.0::DOUBLE END AS p_final FROM x""",
    "fdr_contract": """WITH x AS (SELECT concat_ws(';', CASE WHEN o_orderkey % 3 = 0 THEN 'geometry' END, CASE WHEN o_orderkey % 5 = 0 THEN 'breadth' END, CASE WHEN o_orderkey % 7 = 0 THEN 'residual' END) AS qc_flags FROM orders)
SELECT qc_flags, CASE WHEN qc_flags = '' THEN 'pass' ELSE 'fail' END AS qc_status, count(*) AS n FROM x GROUP BY qc_flags""",
    "fdr_summary": """SELECT unnest(['class:' || o_orderstatus, 'family:' || o_orderpriority, 'candidates']) AS metric, count(*) AS value FROM orders GROUP BY 1""",
}
