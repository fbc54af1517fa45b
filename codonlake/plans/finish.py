"""Families, contract, report tables and quantities of a run's results, made from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.sqlx import rounded
from codonlake.operators import candidates, fdr, results
from codonlake.sources.tables import table

def _share(n: int, of: float) -> Column:
    return (F.col("k") % n) / F.lit(float(of))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order, as a run's results before multiple testing; order lines that repeat stay."""
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    pre = F.when(F.col("k") % 17 == 0, "insufficient_data").when(F.col("k") % 19 == 0, "too_short").when(F.col("k") % 23 == 0, "host_only_supported").otherwise("tested")
    p = (F.col("k") * 7919 % 9973 + 1) / F.lit(9974.0)
    o0, o1 = (F.col("k") % 7 + 1) / F.lit(20.0), (F.col("k") % 5 + 1) / F.lit(20.0)
    flag = lambda n: F.when(F.col("k") % n == 0, 0).otherwise(1)
    return x.withColumn("classification_pre_fdr", pre).select(
        "k", F.col("k").alias("candidate_order"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("torf_id"), F.concat(F.lit("g"), F.expr("k div 2").cast("string")).alias("gorf_id"), F.concat(F.lit("G"), (F.col("k") % 211).cast("string")).alias("gene_name"),
        F.concat(F.lit("E"), (F.col("k") % 211).cast("string")).alias("gene_id"), F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 2 == 1, "F1").otherwise("F2").alias("overlap_type"), (F.col("k") % 70 + 6).alias("peptide_len"), (F.col("k") % 70 + 6).alias("aa_len"), "classification_pre_fdr",
        F.when(F.col("classification_pre_fdr") == "tested", p * p * p * p).otherwise(1.0).alias("p_final"), F.when(F.col("k") % 13 == 0, None).otherwise(_share(100, 100)).alias("lambda_hat"), ((F.col("k") % 7 - 2) / F.lit(10.0)).alias("alt_frame_gain"),
        ((2 - F.col("k") % 6) / F.lit(10.0)).alias("host_frame_drop"), flag(4).alias("mixture_geometry_consistent"), _share(31, 200).alias("distance_to_mixture_segment"), flag(9).alias("credible_active_core_breadth_ok"), flag(8).alias("credible_target_residual_breadth_ok"),
        flag(29).alias("template_separation_ok"), F.when(F.col("k") % 37 == 0, "failed_low_tail_ess").otherwise("pass").alias("importance_status"), F.when(F.col("k") % 17 == 0, "core_reads").otherwise("").alias("prefilter_reason"), (F.col("k") % 3 * 999).alias("importance_reps"),
        o0.alias("pi_obs_0"), o1.alias("pi_obs_1"), F.when(F.col("k") % 41 == 0, F.lit(float("nan"))).otherwise(1 - o0 - o1).alias("pi_obs_2"), F.lit(0.8).alias("pi_trans_0"), F.lit(0.15).alias("pi_trans_1"), F.lit(0.05).alias("pi_trans_2"),
        (F.col("k") % 300).alias("core_reads"), (F.col("k") % 12).alias("n_active_core_codons"), _share(40, 40).alias("active_core_codon_frac"), _share(30, 30).alias("target_vs_unused_z05_frac_active"), _share(90, 90).alias("lambda_gain_raw"), _share(80, 90).alias("lambda_drop_raw"),
        _share(25, 100).alias("lambda_abs_diff"), _share(50, 100).alias("lambda_rel_diff"), _share(90, 90).alias("lambda_proj_raw"),
    )


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fdr.apply(run_results(spark, sf_dir))


def fdr_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _final(spark, sf_dir)
    return out.select(
        "k", "length_tier", "fdr_family", rounded(F.col("q_BH")).alias("q_bh"), rounded(F.col("q_BY")).alias("q_by"), "classification", "primary_credible_call", "ultra_short_exploratory_call", "qc_status", "qc_flags", "filter_reason",
        "background_template_sensitivity_status", rounded(F.col("dm_evidence_score")).alias("dm_evidence_score"), rounded(F.col("dm_fdr_score")).alias("dm_fdr_score"),
    )


def fdr_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fdr.summary(_final(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = run_results(spark, sf_dir).withColumn("q_BH", (F.col("k") * 613 % 997) / F.lit(4000.0)).withColumn("classification", F.when(F.col("k") % 3 == 0, fdr.CREDIBLE).when(F.col("k") % 11 == 0, fdr.EXPLORATORY).otherwise("atypical_pattern"))
    return results.points(x.withColumn("fdr_family", F.lit("primary")).withColumn("gene_level_pure_intorf_eligible", F.when(F.col("k") % 7 == 0, 0).otherwise(1)).withColumn("gene_level_orf_class", F.lit("x")), True)


def vz_plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.plot_data(_points(spark, sf_dir))
    return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def vz_gate_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _points(spark, sf_dir)
    total = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").count()
    out = results.waterfall(x, total)
    return out.select("step", "stage", "count", rounded(F.col("fraction_of_all")).alias("fraction_of_all"))


def vz_post_bh_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.gate_combinations(_points(spark, sf_dir))


def vz_length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.length_table(_points(spark, sf_dir))
    return out.select(*out.columns[:5], *[rounded(F.col(c)).alias(c) for c in out.columns[5:]])


def vz_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's own limit: 36 rows."""
    out = results.margin_candidates(_points(spark, sf_dir), ["G5", "G17"])
    return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def vz_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each point from the way between host and target templates, in phases of the CDS."""
    x = _points(spark, sf_dir)
    far = results.segment_distance([F.col(c) for c in ("cds_p0", "cds_plus1", "cds_plus2")], [F.col(f"pi_trans_{k}") for k in range(3)], results.target())
    return x.select("k", rounded(far).alias("distance"))


def ab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("k") % 17 == 0, "invalid_core_length").when(F.col("k") % 11 == 0, "not_model_quantifiable").otherwise("quantified")
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(status.alias("status"), _share(977, 8).alias("pfpkm"))
    out = results.abundance_summary(x, 1_000_000)
    return out.select("metric", rounded(F.col("value")).alias("value"))


def cand_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tORFs: what they can be used for."""
    k = F.col("p_partkey")
    flag = F.when(k % 6 == 0, 1).otherwise(0)
    x = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 3 == 0, "CDS").when(k % 3 == 1, "intORF_altframe").otherwise("uORF").alias("orf_biotype"), F.when(k % 2 == 0, 1).otherwise(0).alias("is_annotated_cds"), F.when(k % 5 == 0, 1).otherwise(0).alias("mane"),
        F.array(F.lit(30), (k % 7).cast("int")).alias("sizes"), F.array(F.lit(1), F.lit(50)).alias("starts1"), F.lit(0).alias("same_gene"), flag.alias("any_gene"), flag.alias("confounded"),
    )
    return candidates.eligible(x).select("id", "use")


RESULT_SQL = """res AS (SELECT o_orderkey AS k, 't' || o_orderkey AS torf_id, 'g' || (o_orderkey // 2) AS gorf_id, 'G' || (o_orderkey % 211) AS gene_name, 'E' || (o_orderkey % 211) AS gene_id,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 1 THEN 'F1' ELSE 'F2' END AS overlap_type, o_orderkey % 70 + 6 AS peptide_len,
  CASE WHEN o_orderkey % 17 = 0 THEN 'insufficient_data' WHEN o_orderkey % 19 = 0 THEN 'too_short' WHEN o_orderkey % 23 = 0 THEN 'host_only_supported' ELSE 'tested' END AS pre,
  (o_orderkey * 7919 % 9973 + 1) / 9974.0::DOUBLE AS p0, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS lam, (o_orderkey % 7 - 2) / 10.0::DOUBLE AS gain, (2 - o_orderkey % 6) / 10.0::DOUBLE AS dropped,
  o_orderkey % 4 <> 0 AS geo, (o_orderkey % 31) / 200.0::DOUBLE AS far, o_orderkey % 9 <> 0 AS act, o_orderkey % 8 <> 0 AS resid FROM orders)"""
FAMILY_SQL = f"""{RESULT_SQL}, tier AS (SELECT *, CASE WHEN pre = 'tested' THEN p0 * p0 * p0 * p0 ELSE 1.0::DOUBLE END AS p, CASE WHEN peptide_len < 10 THEN 'ultra_short_exploratory' ELSE 'primary' END AS length_tier,
  pre IN ('insufficient_data', 'too_short') AS outside FROM res),
fam AS (SELECT *, CASE WHEN outside THEN 'excluded' ELSE length_tier END AS fdr_family FROM tier),
r AS (SELECT *, row_number() OVER (PARTITION BY fdr_family ORDER BY p) AS r, count(*) OVER (PARTITION BY fdr_family) AS m FROM fam),
lo AS (SELECT *, least(1.0::DOUBLE, min(p * m / r) OVER (PARTITION BY fdr_family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q0, sum(1.0::DOUBLE / r) OVER (PARTITION BY fdr_family) AS h FROM r),
q AS (SELECT *, CASE WHEN outside THEN 1.0::DOUBLE ELSE q0 END AS q, CASE WHEN outside THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, q0 * h) END AS qy FROM lo),
c AS (SELECT *, CASE WHEN outside THEN pre WHEN q >= 0.05 THEN 'host_only_supported' WHEN NOT coalesce(lam > 0.05 AND gain > 0 AND dropped < 0 AND geo AND far < 0.10, false) THEN 'atypical_pattern' WHEN NOT act THEN 'localized_core_signal'
  WHEN NOT resid THEN 'low_target_frame_residual_breadth' WHEN length_tier = 'ultra_short_exploratory' THEN 'ultra_short_exploratory' ELSE 'credible_extra_ORF_like_signal' END AS classification FROM q),
fl AS (SELECT *, concat_ws('|', CASE WHEN k % 17 = 0 THEN 'core_reads' END, CASE WHEN lam IS NULL AND pre NOT IN ('tested', 'host_only_supported') THEN pre END, CASE WHEN lam IS NOT NULL AND k % 29 = 0 THEN 'template_separation' END,
  CASE WHEN lam IS NOT NULL AND NOT geo THEN 'mixture_geometry' END, CASE WHEN lam IS NOT NULL AND NOT act THEN 'active_core_breadth' END, CASE WHEN lam IS NOT NULL AND NOT resid THEN 'target_residual_breadth' END,
  CASE WHEN lam IS NOT NULL AND k % 37 = 0 THEN 'failed_low_tail_ess' END) AS flags FROM c)"""
POINT_SQL = f"""{RESULT_SQL}, raw AS (SELECT *, (k * 613 % 997) / 4000.0::DOUBLE AS q, CASE WHEN k % 3 = 0 THEN 'credible_extra_ORF_like_signal' WHEN k % 11 = 0 THEN 'ultra_short_exploratory' ELSE 'atypical_pattern' END AS cls,
  (k % 7 + 1) / 20.0::DOUBLE AS o0, (k % 5 + 1) / 20.0::DOUBLE AS o1, 1 - (k % 7 + 1) / 20.0::DOUBLE - (k % 5 + 1) / 20.0::DOUBLE AS o2 FROM res WHERE k % 7 <> 0 AND k % 5 <> 0 AND k % 41 <> 0),
pt AS (SELECT *, CASE WHEN overlap_type = 'F1' THEN o2 ELSE o1 END AS c0, CASE WHEN overlap_type = 'F1' THEN o0 ELSE o2 END AS c1, CASE WHEN overlap_type = 'F1' THEN o1 ELSE o0 END AS c2,
  CASE WHEN overlap_type = 'F1' THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END AS t0, CASE WHEN overlap_type = 'F1' THEN 0.8::DOUBLE ELSE 0.05::DOUBLE END AS t1, CASE WHEN overlap_type = 'F1' THEN 0.15::DOUBLE ELSE 0.8::DOUBLE END AS t2,
  q < 0.05 AS g1, coalesce(lam > 0.05, false) AND gain > 0 AND dropped < 0 AS g2, geo AND far < 0.10 AS g3, k % 12 >= 5 AND (k % 40) / 40.0::DOUBLE >= 0.15 AS g4, (k % 30) / 30.0::DOUBLE > 1.0::DOUBLE / 3 AS g5 FROM raw),
xy AS (SELECT *, 0.5 * c0 + c2 AS x, sqrt(3.0::DOUBLE) / 2 * c0 AS y, 0.5 * 0.8::DOUBLE + 0.05 AS hx, sqrt(3.0::DOUBLE) / 2 * 0.8 AS hy, 0.5 * t0 + t2 AS tx, sqrt(3.0::DOUBLE) / 2 * t0 AS ty FROM pt)"""

QUERIES = {f.__name__: f for f in (fdr_families, fdr_run_summary, vz_plot_data, vz_gate_waterfall, vz_post_bh_combinations, vz_length_table, vz_margins, vz_segment, ab_summary, cand_eligible)}
ORACLES = {
    "fdr_families": f"""WITH {FAMILY_SQL} SELECT k, length_tier, fdr_family, round(q, 6) AS q_bh, round(qy, 6) AS q_by, classification, CAST(classification = 'credible_extra_ORF_like_signal' AS INT) AS primary_credible_call,
  CAST(classification = 'ultra_short_exploratory' AS INT) AS ultra_short_exploratory_call, CASE WHEN lam IS NULL THEN 'not_evaluable' WHEN flags = '' THEN 'pass' ELSE 'flagged' END AS qc_status, flags AS qc_flags,
  CASE WHEN classification IN ('credible_extra_ORF_like_signal', 'ultra_short_exploratory') THEN '' WHEN k % 17 = 0 THEN 'core_reads' ELSE classification END AS filter_reason,
  CASE WHEN lam IS NULL THEN 'not_evaluable' WHEN geo THEN 'pass' ELSE 'flagged' END AS background_template_sensitivity_status, round(0.0 - log10(greatest(1e-300, least(1.0, p))), 6) AS dm_evidence_score, round(0.0 - log10(greatest(1e-300, least(1.0, q))), 6) AS dm_fdr_score FROM fl""",
    "fdr_run_summary": f"""WITH {FAMILY_SQL}, x AS (SELECT unnest(['candidates', 'class:' || classification, 'family:' || fdr_family, 'tier:' || length_tier, 'primary_credible_call', 'importance_reps_total']) AS metric,
  unnest([1, 1, 1, 1, CAST(classification = 'credible_extra_ORF_like_signal' AS BIGINT), k % 3 * 999]) AS v FROM fl) SELECT metric, CAST(sum(v) AS BIGINT) AS value FROM x GROUP BY metric""",
    "vz_plot_data": f"""WITH {POINT_SQL} SELECT torf_id, gorf_id, gene_id, gene_name, overlap_type, cls AS classification, 'x' AS gene_level_orf_class, 1 AS gene_level_pure_intorf_eligible, round(c0, 6) AS cds_p0, round(c1, 6) AS cds_plus1, round(c2, 6) AS cds_plus2,
  round(x, 6) AS ternary_x, round(y, 6) AS ternary_y, round(lam, 6) AS lambda_hat, round((k % 90) / 90.0::DOUBLE, 6) AS lambda_proj, round(CASE WHEN (tx - hx) * (y - hy) - (ty - hy) * (x - hx) >= 0 THEN far ELSE -far END, 6) + 0.0 AS signed_branch_distance, round(q, 6) AS "q_BH",
  k % 300 AS core_reads, k % 12 AS n_active_core_codons, round((k % 40) / 40.0::DOUBLE, 6) AS active_core_codon_frac, round((k % 30) / 30.0::DOUBLE, 6) AS target_residual_supported_frac,
  CAST(g1 AS INT) AS gate_bh, CAST(g2 AS INT) AS gate_direction, CAST(g3 AS INT) AS gate_geometry, CAST(g4 AS INT) AS gate_active_breadth, CAST(g5 AS INT) AS gate_residual_breadth FROM xy""",
    "vz_gate_waterfall": f"""WITH {POINT_SQL}, n AS (SELECT count(*) AS total FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT count(*) AS a, count(*) FILTER (g1) AS b, count(*) FILTER (g1 AND g2 AND g3) AS c, count(*) FILTER (g1 AND g2 AND g3 AND g4) AS d,
  count(*) FILTER (g1 AND g2 AND g3 AND g4 AND g5) AS e, count(*) FILTER (g1 AND g2 AND g3 AND g4 AND g5 AND cls = 'credible_extra_ORF_like_signal') AS f FROM pt),
u AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS step, unnest(['All intORF_altframe', 'Coverage eligible', 'BH q < 0.05', 'Direction + geometry', 'Active-codon breadth', 'Target-residual breadth', 'Primary credible']) AS stage, unnest([total, a, b, c, d, e, f]) AS count, total FROM a, n)
SELECT step, stage, count, round(count / total, 6) AS fraction_of_all FROM u""",
    "vz_post_bh_combinations": f"""WITH {POINT_SQL}, x AS (SELECT CAST(g2 AS INT) AS direction, CAST(g3 AS INT) AS geometry, CAST(g4 AS INT) AS active_breadth, CAST(g5 AS INT) AS residual_breadth, count(*) AS count FROM pt WHERE g1 GROUP BY 1, 2, 3, 4)
SELECT row_number() OVER (ORDER BY count DESC, direction DESC, geometry DESC, active_breadth DESC, residual_breadth DESC) AS rank, coalesce(nullif(concat_ws('+', CASE WHEN direction = 1 THEN 'direction' END, CASE WHEN geometry = 1 THEN 'geometry' END,
  CASE WHEN active_breadth = 1 THEN 'active breadth' END, CASE WHEN residual_breadth = 1 THEN 'residual breadth' END), ''), 'none') AS combination, * FROM x""",
    "vz_length_table": f"""WITH {POINT_SQL}, b(length_bin_aa, lo, hi) AS (VALUES ('6–9', 0, 9), ('10–14', 10, 14), ('15–29', 15, 29), ('30–59', 30, 59), ('≥60', 60, 1000)),
x AS (SELECT length_bin_aa, count(k) AS eligible, count(k) FILTER (q < 0.05) AS bh_significant, count(k) FILTER (cls = 'credible_extra_ORF_like_signal') AS primary_credible, count(k) FILTER (cls = 'ultra_short_exploratory') AS ultra_short_exploratory
  FROM b LEFT JOIN pt ON peptide_len BETWEEN lo AND hi GROUP BY length_bin_aa)
SELECT *, coalesce(round(bh_significant / nullif(eligible, 0), 6), 0) AS bh_significant_frac, coalesce(round(primary_credible / nullif(eligible, 0), 6), 0) AS primary_credible_frac FROM x""",
    "vz_margins": f"""WITH {POINT_SQL}, x AS (SELECT *, gene_name IN ('G5', 'G17') AS lit, CASE WHEN gene_name IN ('G5', 'G17') THEN 0.0 ELSE abs(q - 0.05::DOUBLE) END AS away FROM pt WHERE gene_name IN ('G5', 'G17') OR q < 0.15),
r AS (SELECT *, row_number() OVER (ORDER BY lit DESC, away, torf_id, gorf_id) AS rank FROM x)
SELECT rank, gene_name, gene_id, gorf_id, torf_id, overlap_type, cls AS classification, round((0.05::DOUBLE - q) / 0.05::DOUBLE, 6) AS "margin_q_BH", coalesce(round((lam - 0.05::DOUBLE) / 0.05::DOUBLE, 6), -2.0) AS margin_lambda_hat, round((0.1::DOUBLE - far) / 0.1::DOUBLE, 6) AS margin_distance,
  round((0.1::DOUBLE - (k % 25) / 100.0::DOUBLE) / 0.1::DOUBLE, 6) AS margin_lambda_abs_diff, round((0.3::DOUBLE - (k % 50) / 100.0::DOUBLE) / 0.3::DOUBLE, 6) AS margin_lambda_rel_diff, round((k % 12 - 5) / 5.0::DOUBLE, 6) AS margin_active_core_codons,
  round(((k % 40) / 40.0::DOUBLE - 0.15::DOUBLE) / 0.15::DOUBLE, 6) AS margin_active_core_frac, round(((k % 30) / 30.0::DOUBLE - 1.0::DOUBLE / 3) / (1.0::DOUBLE / 3), 6) AS margin_target_residual_frac FROM r WHERE rank <= 36""",
    "vz_segment": f"""WITH {POINT_SQL}, d AS (SELECT k, c0 - 0.8 AS p0, c1 - 0.15 AS p1, c2 - 0.05 AS p2, t0 - 0.8 AS s0, t1 - 0.15 AS s1, t2 - 0.05 AS s2 FROM pt),
a AS (SELECT *, greatest(0.0, least(1.0, (p0 * s0 + p1 * s1 + p2 * s2) / (s0 * s0 + s1 * s1 + s2 * s2))) AS al FROM d)
SELECT k, round(sqrt(power(p0 - al * s0, 2) + power(p1 - al * s1, 2) + power(p2 - al * s2, 2)), 6) AS distance FROM a""",
    "ab_summary": """WITH x AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'invalid_core_length' WHEN o_orderkey % 11 = 0 THEN 'not_model_quantifiable' ELSE 'quantified' END AS s, (o_orderkey % 977) / 8.0::DOUBLE AS v FROM orders)
SELECT 'candidate_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM x UNION ALL SELECT 'library_psites', 1000000.0 UNION ALL SELECT 'median_intorf_pFPKM', round(median(v) FILTER (s = 'quantified'), 6) FROM x
UNION ALL SELECT 'max_intorf_pFPKM', max(v) FILTER (s = 'quantified') FROM x UNION ALL SELECT 'status::' || s, CAST(count(*) AS DOUBLE) FROM x GROUP BY s""",
    "cand_eligible": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'template' ELSE 'candidate' END AS use FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 5 = 0))""",
}
