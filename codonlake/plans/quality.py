"""Quality control over CDSs with flanks, and replicates, on the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept
from codonlake.functions.sqlx import rounded
from codonlake.operators import intervals, metagene, replicates
from codonlake.plans.counting import iv_site_index
from codonlake.plans.domain import PSITE_SQL
from codonlake.sources.tables import table

NAMES = ("R1", "R2", "R3", "R4", "R5")


def _cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CDSs of two blocks, 10 bases apart, with flanks of 20 bases beyond them."""
    k = F.col("c_custkey")
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct()
    chroms = names.withColumn("c", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("long"))  # five rows
    x = table(spark, sf_dir, "customer").select(k.alias("orf"), (k * 31 % 2500 + 50).alias("s"), (F.lit(60) + 3 * (k % 40)).cast("long").alias("length"), (k % 5).alias("c"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))
    pair = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    s, n = F.col("s"), F.col("length")
    before, after = F.array(pair(s - 20, s)), F.array(pair(s + n + 10, s + n + 30))
    plus = F.col("strand") == "+"
    return x.join(F.broadcast(chroms), "c").select(
        "orf", "chrom", "strand", "length", F.array(pair(s, s + 21), pair(s + 31, s + n + 10)).alias("blocks"), F.when(plus, before).otherwise(after).alias("flank5"), F.when(plus, after).otherwise(before).alias("flank3")
    )


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = metagene.spliced_windows(_cds(spark, sf_dir), 20)
    return intervals.range_join(iv_site_index(spark, sf_dir), windows).select("orf", "t", "n", "length")


def _plain(out: DataFrame) -> DataFrame:
    return out.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def qc_full_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metagene.full_metrics(_hits(spark, sf_dir), _cds(spark, sf_dir).select("orf", "length"))
    return _plain(out)


def qc_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDSs of a density over one read in two bases."""
    inside = _hits(spark, sf_dir).filter("t >= 0 and t < length")
    return _plain(metagene.dense_enough(inside, _cds(spark, sf_dir).select("orf", "length"), 0.5))


def qc_start_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metagene.metagene(_hits(spark, sf_dir), 18)


def qc_stop_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metagene.metagene(_hits(spark, sf_dir), 18, "stop")


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).filter("t >= 0 and t < length")


def qc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metagene.frames(_inside(spark, sf_dir), 30))


def qc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(metagene.profile(_inside(spark, sf_dir), 40, 30))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c0, c1, c2, n: codons by pattern. CDSs of one path are counted once, and their codons as often as there are copies."""
    # the length and the number of copies go along in the name, so that neither a copy nor a second join is needed
    cds = metagene.alike(_cds(spark, sf_dir)).withColumn("orf", F.struct("orf", "length", "copies"))
    inside = intervals.range_join(iv_site_index(spark, sf_dir), metagene.spliced_windows(cds, 20)).filter("t >= 0 and t < length")
    x = intervals.codon_counts(inside.withColumn("n_codons", F.expr("length div 3"))).select("orf.*", "codon", "c0", "c1", "c2")
    return metagene.patterns(x, 45, 30, 2).groupBy("c0", "c1", "c2").agg(F.sum("copies").alias("n"))


def qc_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir)


def qc_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the lattice, and means, of the codons that templates are made of."""
    x = _patterns(spark, sf_dir).withColumnRenamed("n", "times")
    return _plain(metagene.corners_and_means(x, times=F.col("times")))


def qc_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metagene.full_metrics(_hits(spark, sf_dir), _cds(spark, sf_dir).select("orf", "length"))
    return _plain(metagene.describe(out, ["PIF", "Uniformity", "DropOff"]))


def qc_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background of the codon-equal template; its concentration from the grid and bisection of `fit_a0`."""
    x = kept(_patterns(spark, sf_dir)).withColumnRenamed("n", "times")
    row = metagene.template(x, 2, F.col("times")).filter("method = 'codon_equal'")
    out = metagene.background(row, metagene.fit_a0(x, (1 / 3, 1 / 3, 1 / 3), 2, times=F.col("times")), 0.5)
    return _plain(out.select("pi0", "pi1", "pi2", "template_status"))


def qc_load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tORF rows, good and bad."""
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(
        k.alias("line"), F.when(k % 43 == 0, "").otherwise(F.concat(F.lit("t"), (k % 900).cast("string"))).alias("torf_id"), F.when(k % 4 == 0, "uORF").otherwise("CDS").alias("orf_biotype"), F.when(k % 3 == 0, "True").otherwise("1").alias("is_annotated_cds"), F.lit("1").alias("has_MANE_Select_tag"),
        F.when(k % 31 == 0, "x").otherwise((k % 50).cast("string")).alias("t_start"), (k % 50 + 60 + k % 60).cast("string").alias("t_end"), F.lit("1").alias("chromStart1"), F.lit("9").alias("chromEnd1"),
        F.when(k % 17 == 0, "?").otherwise("+").alias("strand"), F.when(k % 13 == 0, F.array(F.lit(0), F.lit(3))).when(k % 37 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(30), F.lit(33))).alias("sizes"), F.array(F.lit(1), F.lit(50)).alias("starts1"),
    )
    return metagene.load_counts(metagene.load_cds(x, 90))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys as results of four replicates of five; the fifth has no table, the fourth not every candidate."""
    one = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    k, g = F.col("k"), F.expr("k div 4")
    return one.select(
        F.concat(F.lit("R"), (k % 4 + 1).cast("string")).alias("rep"), F.concat(F.lit("g"), g.cast("string")).alias("gorf_id"), F.when(g % 3 == 0, "F1").otherwise("F2").alias("overlap_type"),
        F.concat(F.lit("E"), (g % 91).cast("string"), F.when(k % 29 == 0, ".2").otherwise("")).alias("gene_id"), F.concat(F.lit("N"), (g % 40).cast("string")).alias("gene_name"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"),
        F.lit("intORF_altframe").alias("orf_biotype"), F.lit("20").alias("aa_len"), F.lit("20").alias("peptide_len"), F.when(k * 7 % 11 < 6, replicates.CREDIBLE).otherwise("tested").alias("classification"),
        F.when(k % 19 == 0, "nan").when(k % 23 == 0, "").otherwise((k % 80 / F.lit(800.0)).cast("string")).alias("q_BH"), F.when(k % 31 == 0, "inf").otherwise((k % 64 / F.lit(64.0)).cast("string")).alias("lambda_hat"), (k % 77).cast("string").alias("core_reads"),
    ).filter("rep <> 'R4' or length(gorf_id) % 2 = 0")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates.load(_results(spark, sf_dir), F.col("rep"))


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates.integrate(_long(spark, sf_dir), NAMES, NAMES[:4])


def in_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plain(_consensus(spark, sf_dir))
    return out.select(*[F.col(f"`{c}`").alias(c.replace("replicate::", "").replace("::", "_")) for c in out.columns])


def in_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates.label_counts(_consensus(spark, sf_dir))


def rp_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates.call_counts(_long(spark, sf_dir), NAMES)


def rp_state_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's own limit: the first 60 candidates by pattern."""
    return replicates.state_matrix(_consensus(spark, sf_dir), NAMES, 60, True)


def _abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("core_reads").cast("long")
    x = _results(spark, sf_dir).withColumn("abundance_status", F.when(k % 6 == 0, "invalid_core_length").otherwise("quantified")).withColumn("intorf_pFPKM", F.when(k % 6 == 0, "").otherwise((k * 37 % 101 / F.lit(4.0)).cast("string")))
    out = None
    for r in NAMES[:4]:
        one = replicates.load_abundance(x.filter(F.col("rep") == r), r)
        out = one if out is None else out.unionByName(one)
    return out


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates.abundance_matrix(_consensus(spark, sf_dir), _abundance(spark, sf_dir), NAMES)


def rp_abundance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_matrix(spark, sf_dir))


def rp_matrix_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(replicates.matrix_correlations(_matrix(spark, sf_dir), NAMES))


def rp_quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as samples, some without metadata."""
    k = F.col("s_suppkey")
    x = table(spark, sf_dir, "supplier").select(k.cast("string").alias("replicate_id"), (k * k * 1000 + 400).alias("psite_alignments"), F.when(k % 7 == 0, None).otherwise(k % 16 / F.lit(16.0)).alias("qc_frame0_prop"), (k % 8 / F.lit(4.0)).alias("qc_A0"), F.when(k % 2 == 0, "28:12, 29:12").otherwise("").alias("selected_length_offsets"))
    return replicates.quality_labels(x.select("replicate_id"), replicates.metadata(x.filter("replicate_id % 5 <> 1")))


def rp_pure_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay of each table, and candidates left out."""
    c = _consensus(spark, sf_dir).withColumn("gene_level_pure_intorf_eligible", F.when(F.length("gorf_id") % 2 == 0, "1").otherwise("0"))
    kept, rows, gone = replicates.pure_only(c, _long(spark, sf_dir))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value")
    return one(kept, "consensus").union(one(rows, "rows")).union(gone.select(F.lit("excluded"), "gene_context_excluded"))


def rp_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates.unexpected(_abundance(spark, sf_dir), _consensus(spark, sf_dir).filter("gene_name <> 'N7'"))


HIT_SQL = f"""{PSITE_SQL}, chroms AS (SELECT event_type AS chrom, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events)),
cds AS (SELECT c_custkey AS orf, chrom, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, c_custkey * 31 % 2500 + 50 AS s, 60 + 3 * (c_custkey % 40) AS length FROM customer JOIN chroms ON c = c_custkey % 5),
site AS (SELECT chrom, strand, pos, count(*) AS n FROM psite GROUP BY ALL),
raw AS (SELECT orf, length, cds.strand, n, pos - s AS d FROM cds JOIN site ON cds.chrom = site.chrom AND cds.strand = site.strand AND pos >= s - 20 AND pos < s + length + 30 AND NOT (pos >= s + 21 AND pos < s + 31)),
fwd AS (SELECT *, CASE WHEN d < 21 THEN d ELSE d - 10 END AS f FROM raw), hit AS (SELECT orf, length, n, CASE WHEN strand = '+' THEN f ELSE length - 1 - f END AS t FROM fwd), inner_hit AS (SELECT * FROM hit WHERE t >= 0 AND t < length)"""
METRIC_SQL = f"""{HIT_SQL}, a AS (SELECT orf, sum(n) FILTER (t >= 0 AND t < length) AS total, sum(n) FILTER (t >= 0 AND t < length AND t % 3 = 0) AS f0, sum(n) FILTER (t < 0 AND t >= -15) AS sb, sum(n) FILTER (t >= 0 AND t < 15) AS sa, sum(n) FILTER (t >= length - 18 AND t < length - 3) AS eb,
  sum(n) FILTER (t >= length AND t < length + 15) AS ea, sum(n) FILTER (t = 0) AS tis FROM hit GROUP BY orf),
cc AS (SELECT orf, t // 3 AS codon, sum(n) AS h, sum(n) FILTER (t % 3 = 0) AS h0 FROM inner_hit GROUP BY orf, t // 3), cm AS (SELECT orf, count(*) AS withreads, count(*) FILTER (coalesce(h0, 0) / h > 1.0::DOUBLE / 3) AS passing FROM cc GROUP BY orf),
med AS (SELECT orf, median(v) AS m FROM (SELECT cds.orf, p, coalesce(sum(n), 0) AS v FROM cds, (SELECT unnest(range(3, 33, 3)) AS p) g LEFT JOIN hit ON hit.orf = cds.orf AND hit.t = p GROUP BY cds.orf, p) GROUP BY orf),
m AS (SELECT cds.orf, cds.length, coalesce(total, 0) AS total, coalesce(f0, 0) AS f0, coalesce(sb, 0) AS sb, coalesce(sa, 0) AS sa, coalesce(eb, 0) AS eb, coalesce(ea, 0) AS ea, coalesce(tis, 0) AS tis, coalesce(withreads, 0) AS withreads, coalesce(passing, 0) AS passing, m
  FROM cds LEFT JOIN a ON a.orf = cds.orf LEFT JOIN cm ON cm.orf = cds.orf JOIN med ON med.orf = cds.orf),
metric AS (SELECT orf, length, CAST(total AS BIGINT) AS total_reads, round(total / length, 6) AS read_density, coalesce(round(f0 / nullif(total, 0), 6), 0.0) AS "PIF", round(passing / (length // 3), 6) AS "Uniformity", coalesce(round(sa / nullif(sb + sa, 0), 6), 0.0) AS "StartIncrease", coalesce(round(eb / nullif(eb + ea, 0), 6), 0.0) AS "DropOff",
  CASE WHEN f0 > 0 THEN round(tis / (f0 / (length // 3)), 6) ELSE 0.0 END AS "TIS_global_enrich", round((tis + 1.0::DOUBLE) / (m + 1.0::DOUBLE), 6) AS "TIS_local_score", CAST(length // 3 AS BIGINT) AS codon_count, withreads AS codons_with_reads, CAST(sb AS BIGINT) AS start_before, CAST(sa AS BIGINT) AS start_after, CAST(eb AS BIGINT) AS stop_before, CAST(ea AS BIGINT) AS stop_after FROM m)"""
PATTERN_SQL = f"""{HIT_SQL}, cod AS (SELECT orf, length, t // 3 AS codon, CAST(coalesce(sum(n) FILTER (t % 3 = 0), 0) AS BIGINT) AS c0, CAST(coalesce(sum(n) FILTER (t % 3 = 1), 0) AS BIGINT) AS c1, CAST(coalesce(sum(n) FILTER (t % 3 = 2), 0) AS BIGINT) AS c2 FROM inner_hit GROUP BY orf, length, t // 3),
pat AS (SELECT * FROM cod WHERE codon >= 15 AND codon < floor((length - 30) / 3) AND c0 + c1 + c2 >= 2)"""
LONG_SQL = """one AS (SELECT DISTINCT o_orderkey AS k, o_orderkey // 4 AS g FROM orders), res AS (SELECT 'R' || (k % 4 + 1) AS rep, k, 'g' || g || '|' || CASE WHEN g % 3 = 0 THEN 'F1' ELSE 'F2' END AS key, 'g' || g AS gorf_id, CASE WHEN g % 3 = 0 THEN 'F1' ELSE 'F2' END AS overlap_type, 'E' || (g % 91) || CASE WHEN k % 29 = 0 THEN '.2' ELSE '' END AS gene_id,
  'N' || (g % 40) AS gene_name, CASE WHEN k * 7 % 11 < 6 THEN 'credible_extra_ORF_like_signal' ELSE 'tested' END AS cls, CAST(k * 7 % 11 < 6 AS INT) AS prim, CASE WHEN k % 19 <> 0 AND k % 23 <> 0 THEN (k % 80) / 800.0::DOUBLE END AS q, CASE WHEN k % 19 = 0 THEN 'nan' WHEN k % 23 = 0 THEN '' ELSE CAST((k % 80) / 800.0::DOUBLE AS VARCHAR) END AS qt,
  CASE WHEN k % 31 <> 0 THEN (k % 64) / 64.0::DOUBLE END AS lam, CASE WHEN k % 31 = 0 THEN 'inf' ELSE CAST((k % 64) / 64.0::DOUBLE AS VARCHAR) END AS lt, k % 77 AS reads FROM one WHERE k % 4 <> 3 OR length('g' || g) % 2 = 0)"""
CONSENSUS_SQL = f"""{LONG_SQL}, con AS (SELECT key, min(gorf_id) AS gorf_id, min(overlap_type) AS overlap_type, min_by(gene_id, rep) AS gene_id, min(gene_name) AS gene_name, CASE WHEN count(DISTINCT gene_id) > 1 THEN 'gene_id' ELSE '' END AS conflicts, count(*) AS n_obs, count(*) FILTER (prim = 1) AS n_prim, count(*) FILTER (q <= 0.05) AS n_bh,
  min(q) AS min_q, median(q) AS med_q, median(lam) AS med_l, max(reads) AS max_reads, coalesce(string_agg(rep, ',' ORDER BY rep) FILTER (prim = 1), '') AS reps FROM res GROUP BY key),
lab AS (SELECT *, CASE WHEN n_prim >= 2 AND n_prim / 4 >= 0.5 THEN 'reproducible_primary_credible' WHEN n_prim > 0 THEN 'primary_credible_not_reproducible' ELSE 'not_primary_credible' END AS label FROM con)"""
MATRIX_SQL = f"""{CONSENSUS_SQL}, ab AS (SELECT key, rep, CASE WHEN reads % 6 <> 0 THEN (reads * 37 % 101) / 4.0::DOUBLE END AS v FROM res),
mat AS (SELECT lab.key AS candidate_key, n_prim AS support, median(v) AS middle, max(v) FILTER (rep = 'R1') AS r0, max(v) FILTER (rep = 'R2') AS r1, max(v) FILTER (rep = 'R3') AS r2, max(v) FILTER (rep = 'R4') AS r3, CAST(NULL AS DOUBLE) AS r4 FROM lab JOIN ab ON ab.key = lab.key WHERE n_prim > 0 GROUP BY lab.key, n_prim HAVING count(v) > 0)"""


def _cells(r: str) -> str:
    cell = lambda c: f"coalesce(max({c}) FILTER (rep = '{r}'), '')"
    return f"""CAST(count(*) FILTER (rep = '{r}') AS BIGINT) AS "{r}_present", {cell('cls')} AS "{r}_classification", {cell('CAST(prim AS VARCHAR)')} AS "{r}_primary_credible_call", {cell('qt')} AS "{r}_q_BH", {cell('lt')} AS "{r}_lambda_hat", {cell('CAST(reads AS VARCHAR)')} AS "{r}_core_reads\""""


QUERIES = {
    f.__name__: f
    for f in (qc_full_metrics, qc_dense, qc_start_meta, qc_stop_meta, qc_frames, qc_profile, qc_patterns, qc_vertices, qc_describe, qc_background, qc_load_counts, in_consensus, in_label_counts, rp_call_counts, rp_state_matrix, rp_abundance_matrix, rp_matrix_correlations, rp_quality_labels, rp_pure_only, rp_unexpected)
}
ORACLES = {
    "qc_full_metrics": f"WITH {METRIC_SQL} SELECT * FROM metric",
    "qc_dense": f"WITH {HIT_SQL}, t AS (SELECT cds.orf, cds.length, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_reads FROM cds LEFT JOIN inner_hit h ON h.orf = cds.orf GROUP BY cds.orf, cds.length) SELECT *, round(total_reads / length, 6) AS read_density FROM t WHERE total_reads / length >= 0.5",
    "qc_start_meta": f"WITH {HIT_SQL}, g AS (SELECT unnest(range(-18, 19)) AS rel_nt) SELECT rel_nt, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM g LEFT JOIN hit ON t = rel_nt AND t < length GROUP BY rel_nt",
    "qc_stop_meta": f"WITH {HIT_SQL}, g AS (SELECT unnest(range(-18, 19)) AS rel_nt) SELECT rel_nt, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM g LEFT JOIN hit ON t - (length - 3) = rel_nt AND t >= 0 GROUP BY rel_nt",
    "qc_frames": f"""WITH {HIT_SQL}, ok AS (SELECT orf FROM inner_hit GROUP BY orf HAVING sum(n) >= 30), f AS (SELECT unnest([0, 1, 2]) AS frame), x AS (SELECT frame, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM f LEFT JOIN (SELECT * FROM inner_hit WHERE orf IN (SELECT orf FROM ok)) h ON h.t % 3 = frame GROUP BY frame)
SELECT frame, count, coalesce(round(count / nullif(sum(count) OVER (), 0), 6), 0.0) AS proportion, CAST(sum(count) OVER () AS BIGINT) AS total FROM x""",
    "qc_profile": f"""WITH {HIT_SQL}, ok AS (SELECT orf FROM inner_hit GROUP BY orf HAVING sum(n) >= 30), c AS (SELECT count(*) AS cds FROM ok), b AS (SELECT least(39, t * 40 // length) AS bin, t % 3 AS f, n FROM inner_hit WHERE orf IN (SELECT orf FROM ok)), g AS (SELECT unnest(range(0, 40)) AS bin)
SELECT g.bin, coalesce(round(sum(n) / any_value(cds), 6), 0.0) AS mean_count_per_cds, coalesce(round(sum(n) FILTER (f = 0) / any_value(cds), 6), 0.0) AS f0, coalesce(round(sum(n) FILTER (f = 1) / any_value(cds), 6), 0.0) AS f1, coalesce(round(sum(n) FILTER (f = 2) / any_value(cds), 6), 0.0) AS f2 FROM g LEFT JOIN b ON b.bin = g.bin, c GROUP BY g.bin""",
    "qc_patterns": f"WITH {PATTERN_SQL} SELECT c0, c1, c2, count(*) AS n FROM pat GROUP BY ALL",
    "qc_vertices": f"""WITH {PATTERN_SQL}, x AS (SELECT c0 + c1 + c2 AS n, c0, c1, c2, c0 * 20 // (c0 + c1 + c2) AS b0, c1 * 20 // (c0 + c1 + c2) AS b1, c2 * 20 // (c0 + c1 + c2) AS b2, c0 * 20 % (c0 + c1 + c2) AS r0, c1 * 20 % (c0 + c1 + c2) AS r1, c2 * 20 % (c0 + c1 + c2) AS r2 FROM pat),
g AS (SELECT *, b0 + CAST((r1 > r0)::INT + (r2 > r0)::INT < 20 - b0 - b1 - b2 AS INT) AS g0, b1 + CAST((r0 >= r1)::INT + (r2 > r1)::INT < 20 - b0 - b1 - b2 AS INT) AS g1, b2 + CAST((r0 >= r2)::INT + (r1 >= r2)::INT < 20 - b0 - b1 - b2 AS INT) AS g2 FROM x)
SELECT coalesce(round(100.0 * count(*) FILTER (g0 = 20) / count(*), 6), 0.0) AS v0, coalesce(round(100.0 * count(*) FILTER (g1 = 20) / count(*), 6), 0.0) AS v1, coalesce(round(100.0 * count(*) FILTER (g2 = 20) / count(*), 6), 0.0) AS v2,
  coalesce(round(100.0 * avg(c0 / n), 6), 0.0) AS m0, coalesce(round(100.0 * avg(c1 / n), 6), 0.0) AS m1, coalesce(round(100.0 * avg(c2 / n), 6), 0.0) AS m2 FROM g""",
    "qc_describe": f"""WITH {METRIC_SQL.replace('round(passing / (length // 3), 6)', 'passing / (length // 3)').replace('coalesce(round(f0 / nullif(total, 0), 6), 0.0)', 'coalesce(f0 / nullif(total, 0), 0.0)').replace('coalesce(round(eb / nullif(eb + ea, 0), 6), 0.0)', 'coalesce(eb / nullif(eb + ea, 0), 0.0)')}, u AS (SELECT unnest(['PIF', 'Uniformity', 'DropOff']) AS metric, unnest(["PIF", "Uniformity", "DropOff"]) AS v FROM metric)
SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(*) AS n FROM u GROUP BY metric""",
    "qc_background": f"""WITH {PATTERN_SQL} SELECT round(avg(c0 / (c0 + c1 + c2)), 6) AS pi0, round(avg(c1 / (c0 + c1 + c2)), 6) AS pi1, round(avg(c2 / (c0 + c1 + c2)), 6) AS pi2, CASE WHEN count(*) = 0 THEN 'failed' ELSE 'success' END AS template_status FROM pat""",
    "qc_load_counts": """WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 43 = 0 THEN 'CDS_fallback_' || p_partkey ELSE 't' || (p_partkey % 900) END AS id, CASE WHEN p_partkey % 4 = 0 THEN 'not_mane_cds' WHEN p_partkey % 31 = 0 THEN 'skip_invalid_coordinates' WHEN 60 + p_partkey % 60 < 90 THEN 'skip_short_cds' WHEN p_partkey % 13 = 0 THEN 'skip_invalid_blocks' WHEN p_partkey % 17 = 0 THEN 'skip_invalid_strand' END AS why FROM part),
f AS (SELECT id, min(k) AS k0 FROM x WHERE why IS NULL GROUP BY id), y AS (SELECT x.k, coalesce(why, CASE WHEN x.k <> k0 THEN 'skip_duplicate_torf_id' WHEN x.k % 37 = 0 AND x.k % 13 <> 0 THEN 'skip_invalid_orf_length' END) AS why FROM x LEFT JOIN f ON f.id = x.id),
u AS (SELECT unnest(['torf_rows_scanned', CASE WHEN why IS NULL OR why <> 'not_mane_cds' THEN 'mane_cds_rows' END, CASE WHEN why <> 'not_mane_cds' THEN why END, CASE WHEN why IS NULL THEN 'mane_cds_loaded' END]) AS metric FROM y) SELECT metric, count(*) AS value FROM u WHERE metric IS NOT NULL GROUP BY metric""",
    "in_consensus": f"""WITH {CONSENSUS_SQL}, w AS (SELECT key, {", ".join(_cells(r) for r in NAMES)} FROM res GROUP BY key)
SELECT lab.key AS candidate_key, gorf_id, overlap_type, gene_id, gene_name, 'chr1' AS chrom, '+' AS strand, 'intORF_altframe' AS orf_biotype, '20' AS aa_len, '20' AS peptide_len, conflicts AS metadata_conflict_columns, 5 AS n_replicates_expected, 4 AS n_replicates_available, n_obs AS n_replicates_observed, n_prim AS n_primary_credible,
  round(n_prim / 4, 6) AS primary_credible_fraction_available, n_bh AS n_bh_significant, round(min_q, 6) AS "min_q_BH", round(med_q, 6) AS "median_q_BH", round(med_l, 6) AS median_lambda_hat, max_reads AS max_core_reads, label AS consensus_classification, reps AS primary_credible_replicates, w.* EXCLUDE (key) FROM lab JOIN w ON w.key = lab.key""",
    "in_label_counts": f"""WITH {CONSENSUS_SQL}, n(l) AS (VALUES ('reproducible_primary_credible'), ('single_replicate_primary_credible'), ('primary_credible_not_reproducible'), ('not_primary_credible'))
SELECT 'candidate_union_total' AS metric, count(*) AS value FROM lab UNION ALL SELECT 'consensus::' || l, (SELECT count(*) FROM lab WHERE label = l) FROM n""",
    "rp_call_counts": f"""WITH {LONG_SQL}, n(r) AS (VALUES ('R1'), ('R2'), ('R3'), ('R4'), ('R5')) SELECT r AS replicate_id, count(k) AS total, count(k) FILTER (q <= 0.05) AS significant, count(k) FILTER (prim = 1) AS primary_calls FROM n LEFT JOIN res ON rep = r GROUP BY r""",
    "rp_state_matrix": f"""WITH {CONSENSUS_SQL}, s AS (SELECT key, {", ".join(f"coalesce(max(1 + prim) FILTER (rep = 'R{i + 1}'), 0) AS state{i}" for i in range(4))}, -1 AS state4 FROM res GROUP BY key),
t AS (SELECT s.*, n_prim, max_reads, gene_name, gorf_id, overlap_type, row_number() OVER (ORDER BY n_prim DESC, state0 DESC, state1 DESC, state2 DESC, state3 DESC, max_reads DESC, s.key) AS rank FROM s JOIN lab ON lab.key = s.key WHERE n_prim > 0), top AS (SELECT * FROM t WHERE rank <= 60)
SELECT rank, key AS candidate_key, CASE WHEN count(*) OVER (PARTITION BY gene_name) > 1 THEN gene_name || ' (' || overlap_type || ')' ELSE gene_name END AS label, state0, state1, state2, state3, state4 FROM top""",
    "rp_abundance_matrix": f"WITH {MATRIX_SQL} SELECT candidate_key, support, round(middle, 6) AS middle, r0, r1, r2, r3, r4 FROM mat",
    "rp_matrix_correlations": f"""WITH {MATRIX_SQL}, l AS (SELECT candidate_key, unnest([0, 1, 2, 3]) AS i, unnest([r0, r1, r2, r3]) AS v FROM mat), p AS (SELECT a.i, b.i AS j, log2(1 + a.v) AS x, log2(1 + b.v) AS y FROM l a JOIN l b ON a.candidate_key = b.candidate_key AND a.i < b.i WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY i, j ORDER BY x) + (count(*) OVER (PARTITION BY i, j, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY i, j ORDER BY y) + (count(*) OVER (PARTITION BY i, j, y) - 1) / 2.0 AS ry FROM p), c AS (SELECT i, j, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY i, j),
g AS (SELECT a.i, b.j FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i) a, (SELECT unnest([0, 1, 2, 3, 4]) AS j) b WHERE a.i < b.j) SELECT 'R' || (g.i + 1) AS rep_a, 'R' || (g.j + 1) AS rep_b, coalesce(n, 0) AS n, pearson, spearman FROM g LEFT JOIN c ON c.i = g.i AND c.j = g.j""",
    "rp_quality_labels": """WITH x AS (SELECT s_suppkey AS k, s_suppkey * s_suppkey * 1000 + 400 AS n FROM supplier)
SELECT CAST(k AS VARCHAR) AS replicate_id, CASE WHEN k % 5 = 1 THEN CAST(k AS VARCHAR) ELSE k || chr(10) || CASE WHEN n >= 1000000 THEN format('{:.1f}M', n / 1e6) WHEN n >= 1000 THEN format('{:.1f}k', n / 1e3) ELSE format('{:.0f}', n * 1.0::DOUBLE) END || ' P-sites' || CASE WHEN k % 2 = 0 THEN ' · L 28/29' ELSE '' END || chr(10) || 'F0 ' ||
  CASE WHEN k % 7 = 0 THEN 'NA' ELSE format('{:.1f}%', 100 * (k % 16) / 16.0::DOUBLE) END || ' · A0 ' || format('{:.2f}', (k % 8) / 4.0::DOUBLE) END AS label FROM x""",
    "rp_pure_only": f"WITH {CONSENSUS_SQL} SELECT 'consensus' AS metric, count(*) FILTER (length(gorf_id) % 2 = 0) AS value FROM lab UNION ALL SELECT 'rows', count(*) FILTER (length(gorf_id) % 2 = 0) FROM res UNION ALL SELECT 'excluded', count(*) FILTER (length(gorf_id) % 2 <> 0) FROM lab",
    "rp_unexpected": f"WITH {LONG_SQL} SELECT DISTINCT key AS candidate_key FROM res WHERE gene_name = 'N7'",
}
