"""Candidate inference, multiple testing and quality control on the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept
from codonlake.functions.sqlx import rounded
from codonlake.operators import dm, fdr, metagene, resample
from codonlake.plans import counting
from codonlake.sources.tables import table

HOST, TRANS, A0 = (0.1, 0.2, 0.7), (0.8, 0.1, 0.1), 20.0


def cand_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orf, codon, c0, c1, c2 from lineitem."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("orf"), F.expr("l_orderkey div 500").alias("codon"), (F.col("l_suppkey") % 3).alias("f"))
    return x.groupBy("orf", "codon").agg(*[F.count_if(F.col("f") == k).alias(f"c{k}") for k in range(3)])


CAND_SQL = """cand AS (
  SELECT l_orderkey % 500 AS orf, l_orderkey // 500 AS codon,
         count(*) FILTER (l_suppkey % 3 = 0) AS c0, count(*) FILTER (l_suppkey % 3 = 1) AS c1, count(*) FILTER (l_suppkey % 3 = 2) AS c2
  FROM lineitem GROUP BY ALL)"""


def iv_core_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and core totals, breadth and eligibility of each ORF (core: without first and last codon)."""
    blocks = counting.domain.orf_blocks(spark, sf_dir).groupBy("orf").agg(F.expr("max(len) div 3").alias("n_codons"))
    x = counting.codons(spark, sf_dir).join(blocks, "orf")
    n = F.col("c0") + F.col("c1") + F.col("c2")
    core = (F.col("codon") >= 1) & (F.col("codon") <= F.col("n_codons") - 2)
    in_core = lambda c: F.sum(F.when(core, c).otherwise(0)).cast("long")
    out = x.groupBy("orf", (F.col("n_codons") - 2).alias("n_core")).agg(
        F.sum(n).cast("long").alias("region_reads"), in_core(n).alias("core_reads"), *[in_core(F.col(f"c{k}")).alias(f"core_p{k}") for k in range(3)], F.count_if(core & (n > 0)).alias("active")
    )
    share = F.col("active") / F.col("n_core")
    label = F.when((F.col("active") >= 5) & (share >= 0.15), "broad").when(F.col("active") >= 5, "low_fraction").when(share >= 0.15, "few_codons").otherwise("localized")
    eligible = (F.col("active") >= 3) & (F.col("core_reads") >= 15)
    return out.withColumn("breadth", label).withColumn("eligible", F.when(eligible, 1).otherwise(0))


def dm_loglik_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.loglik(cand_codons(spark, sf_dir), HOST, A0).select("orf", rounded(F.col("loglik")).alias("loglik"))


def dm_lambda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dm.fit_lambda(cand_codons(spark, sf_dir), HOST, TRANS, A0)
    return out.select("orf", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cand_codons(spark, sf_dir).groupBy("orf").agg(*[F.sum(f"c{k}").alias(f"s{k}") for k in range(3)])
    n = F.col("s0") + F.col("s1") + F.col("s2")
    return x.select("orf", n.alias("reads"), *[(F.col(f"s{k}") / n).alias(f"o{k}") for k in range(3)])


def dm_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = dm.geometry([F.col(f"o{k}") for k in range(3)], HOST, TRANS, 2)
    out = _shares(spark, sf_dir).select("orf", *cols)
    return out.select("orf", *[rounded(F.col(c)).alias(c) for c in out.columns[1:-1]], F.col("consistent").cast("int").alias("consistent"))


def dm_expected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam = (F.col("orf") % 101) / F.lit(100.0)
    out = _shares(spark, sf_dir).select("orf", *dm.expected_reads(lam, F.col("reads"), HOST, TRANS))
    return out.select("orf", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


def dm_residual_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons whose target phase exceeds the unused one by half a standard deviation, and whether they are over a third."""
    n = F.col("c0") + F.col("c1") + F.col("c2")
    z = ((F.col("c0") - n * HOST[0]) - (F.col("c1") - n * HOST[1])) / F.sqrt(dm.contrast_variance(n, HOST[0], HOST[1], A0))
    out = cand_codons(spark, sf_dir).groupBy("orf").agg(F.count_if(z >= 0.5).alias("supported"), F.count(F.lit(1)).alias("codons"))
    return out.withColumn("passes", F.when(F.col("supported") * 3 > F.col("codons"), 1).otherwise(0))


def dm_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c0") + F.col("c1") + F.col("c2")
    out = dm.lag1(cand_codons(spark, sf_dir).select("orf", "codon", ((F.col("c0") - n * HOST[0]) / n).alias("value")))
    return out.select("orf", "n_pairs", rounded(F.col("lag1")).alias("lag1"))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), ((F.col("o_orderkey") * 7919 % 9973 + 1) / F.lit(9974.0)).alias("p"))


def fdr_bh_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fdr.adjust(_tests(spark, sf_dir))
    return out.select("id", "family", rounded(F.col("q_bh")).alias("q_bh"), rounded(F.col("q_by")).alias("q_by"))


def fdr_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and their counts by tier, with gates from the ids."""
    x = fdr.adjust(_tests(spark, sf_dir).withColumn("p", F.col("p") ** 4))
    flag = lambda m: F.col("id") % m != 0
    tier = fdr.length_tier(F.col("id") % 40)
    x = x.select(tier.alias("tier"), fdr.classify(F.col("q_bh"), flag(3), flag(5), flag(7), tier).alias("classification"))
    return x.groupBy("tier", "classification").agg(F.count(F.lit(1)).alias("n"))


def qc_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metagene.template(cand_codons(spark, sf_dir))
    return out.select("method", "n_codons", *[rounded(F.col(f"pi{k}")).alias(f"pi{k}") for k in range(3)])


def qc_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metagene.ternary(cand_codons(spark, sf_dir))
    return out.select("g0", "g1", "g2", "n", rounded(F.col("percent")).alias("percent"))


def qc_start_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metagene.relative_histogram(counting.hits(spark, sf_dir), F.lit(15), 30)


def qc_cds_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = counting.domain.orf_blocks(spark, sf_dir).groupBy("orf").agg(F.expr("max(len) div 3").alias("n_codons"))
    out = metagene.cds_metrics(counting.codons(spark, sf_dir).join(blocks, "orf"))
    return out.select("orf", F.col("reads").cast("long").alias("reads"), rounded(F.col("pif")).alias("pif"), rounded(F.col("uniformity")).alias("uniformity"))


def qc_trimmed_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metagene.trimmed_template(cand_codons(spark, sf_dir), 0.1)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


def qc_reservoir_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trimmed template of the 2,000 codons with the least hashes, however the table is cut in parts."""
    out = metagene.reservoir_template(cand_codons(spark, sf_dir), 2000, 0.1)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


def dm_projected_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of neighbouring codons' residuals along the way from host to trans, after a share by the ORF's number."""
    lam = (F.col("orf") % 101) / F.lit(100.0)
    out = dm.lag1(dm.projected_residuals(cand_codons(spark, sf_dir), lam, HOST, TRANS))
    return out.select("orf", "n_pairs", rounded(F.col("lag1")).alias("lag1"))


def qc_a0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concentration to five digits of its logarithm."""
    out = metagene.fit_a0(cand_codons(spark, sf_dir), HOST)
    return out.select(F.round(F.log("a0"), 5).alias("log_a0"), F.col("at_edge").cast("int").alias("at_edge"), "n_codons")


def candidate_rows(spark: SparkSession, sf_dir: str, host: tuple[float, float, float] = HOST, trans: tuple[float, float, float] = TRANS) -> DataFrame:
    """Candidates with their codons, templates and fit, as resampling takes them."""
    x = cand_codons(spark, sf_dir)
    held = x.groupBy("orf").agg(F.sort_array(F.collect_list(F.struct("codon", "c0", "c1", "c2"))).alias("codons"))
    fixed = lambda v: F.array(*[F.lit(p) for p in v])
    fit = dm.fit_lambda(x, host, trans, A0).join(held, "orf")
    return fit.select(F.col("orf").cast("string").alias("key"), "codons", fixed(host).alias("host"), fixed(trans).alias("trans"), F.lit(A0).alias("a0"), "lambda_hat", "lrt", "p_asym")


def dm_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final p of all candidates under the formal engine; drawn numbers have no SQL twin, a test holds them against a plain bootstrap."""
    return resample.final_p(kept(candidate_rows(spark, sf_dir)), mode="fast")


def _mix(lam: str) -> str:
    """A0 times the mixture's share of phase t.f."""
    pick = lambda v: f"(CASE t.f WHEN 0 THEN {v[0]}::DOUBLE WHEN 1 THEN {v[1]}::DOUBLE ELSE {v[2]}::DOUBLE END)"
    return f"{A0}::DOUBLE * ((1 - {lam}) * {pick(HOST)} + {lam} * {pick(TRANS)})"


def _ll(lam: str, terms: str = "terms") -> str:
    return f"list_sum(list_transform({terms}, lambda t: t.n * ln({_mix(lam)} + t.k)))"


def _slope(lam: str) -> str:
    step = " ".join(f"WHEN {f} THEN {TRANS[f] - HOST[f]}::DOUBLE" for f in range(2))
    return f"list_sum(list_transform(terms, lambda t: t.n * {A0}::DOUBLE * (CASE t.f {step} ELSE {TRANS[2] - HOST[2]}::DOUBLE END) / ({_mix(lam)} + t.k)))"


_MID = "((lo + hi) / 2)"
_FIT_SQL = f"""WITH RECURSIVE {CAND_SQL}, deep AS (SELECT orf, unnest([0, 1, 2]) AS f, unnest([c0, c1, c2]) AS c FROM cand), ks AS (SELECT orf, f, unnest(range(0, c)) AS k FROM deep WHERE c > 0),
cnt AS (SELECT orf, f, k, count(*) AS n FROM ks GROUP BY ALL), terms AS (SELECT orf, list({{'f': f, 'k': k, 'n': n}}) AS terms FROM cnt GROUP BY orf),
r1 AS (SELECT orf, terms, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM terms UNION ALL SELECT orf, terms, i + 1, CASE WHEN {_slope(_MID)} > 0 THEN {_MID} ELSE lo END, CASE WHEN {_slope(_MID)} > 0 THEN hi ELSE {_MID} END FROM r1 WHERE i < 60),
fit AS (SELECT orf, terms, CASE WHEN {_slope('0.0::DOUBLE')} <= 0 THEN 0.0::DOUBLE WHEN {_slope('1.0::DOUBLE')} >= 0 THEN 1.0::DOUBLE ELSE {_MID} END AS lam FROM r1 WHERE i = 60),
top AS (SELECT *, {_ll('lam')} AS top, {_ll('0.0::DOUBLE')} AS at0, {_ll('1.0::DOUBLE')} AS at1, {_ll('lam')} - 3.841458820694124::DOUBLE / 2 AS low FROM fit),
r2 AS (SELECT orf, terms, low, 0 AS i, 0.0::DOUBLE AS lo, lam AS hi FROM top UNION ALL SELECT orf, terms, low, i + 1, CASE WHEN {_ll(_MID)} < low THEN {_MID} ELSE lo END, CASE WHEN {_ll(_MID)} < low THEN hi ELSE {_MID} END FROM r2 WHERE i < 60),
r3 AS (SELECT orf, terms, low, 0 AS i, lam AS lo, 1.0::DOUBLE AS hi FROM top UNION ALL SELECT orf, terms, low, i + 1, CASE WHEN {_ll(_MID)} >= low THEN {_MID} ELSE lo END, CASE WHEN {_ll(_MID)} >= low THEN hi ELSE {_MID} END FROM r3 WHERE i < 60),
z AS (SELECT orf, lam, top, at0, at1, low, greatest(0.0::DOUBLE, 2 * (top - at0)) AS lrt, sqrt(greatest(0.0::DOUBLE, 2 * (top - at0)) / 2) AS z FROM top)
SELECT z.orf, round(lam, 6) AS lambda_hat, round(lrt, 6) AS lrt, CASE WHEN lrt <= 1e-14 THEN 1.0::DOUBLE ELSE round(0.004::DOUBLE / 3 / sqrt(pi()) * list_sum(list_transform(range(0, 2001), lambda j: CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z + j * 0.004::DOUBLE, 2)))), 6) END AS p_asym,
  CASE WHEN at0 >= z.low THEN 0.0::DOUBLE ELSE round((r2.lo + r2.hi) / 2, 6) END AS ci_low, CASE WHEN at1 >= z.low THEN 1.0::DOUBLE ELSE round((r3.lo + r3.hi) / 2, 6) END AS ci_high
FROM z JOIN r2 ON r2.orf = z.orf AND r2.i = 60 JOIN r3 ON r3.orf = z.orf AND r3.i = 60"""


def _a0_sum(log_a: str, kind: str) -> str:
    share = f"(CASE t.f WHEN 0 THEN {HOST[0]}::DOUBLE WHEN 1 THEN {HOST[1]}::DOUBLE WHEN 2 THEN {HOST[2]}::DOUBLE ELSE 1.0::DOUBLE END)"
    inner = f"ln(exp({log_a}) * {share} + t.k)" if kind == "value" else f"{share} / (exp({log_a}) * {share} + t.k)"
    return f"list_sum(list_transform(terms, lambda t: CASE WHEN t.f = 3 THEN -1 ELSE 1 END * t.m * {inner}))"


_STEP = "(ln(1e5::DOUBLE) - ln(0.02::DOUBLE)) / 96"
_A0_SQL = f"""WITH RECURSIVE {CAND_SQL}, deep AS (SELECT unnest([0, 1, 2, 3]) AS f, unnest([c0, c1, c2, c0 + c1 + c2]) AS c FROM cand WHERE c0 + c1 + c2 >= 3), ks AS (SELECT f, unnest(range(0, c)) AS k FROM deep WHERE c > 0),
cnt AS (SELECT f, k, count(*) AS m FROM ks GROUP BY ALL), one AS (SELECT list({{'f': f, 'k': k, 'm': m}}) AS terms, sum(m) FILTER (f = 3 AND k = 0) AS n FROM cnt),
grid AS (SELECT g, ln(0.02::DOUBLE) + g * {_STEP} AS x, terms FROM one, (SELECT unnest(range(0, 97)) AS g)), best AS (SELECT max_by(g, v) AS g FROM (SELECT g, {_a0_sum('x', 'value')} AS v FROM grid)),
r AS (SELECT 0 AS i, terms, n, best.g, ln(0.02::DOUBLE) + greatest(0, g - 1) * {_STEP} AS lo, ln(0.02::DOUBLE) + least(96, g + 1) * {_STEP} AS hi FROM one, best
  UNION ALL SELECT i + 1, terms, n, g, CASE WHEN {_a0_sum(_MID, 'slope')} > 0 THEN {_MID} ELSE lo END, CASE WHEN {_a0_sum(_MID, 'slope')} > 0 THEN hi ELSE {_MID} END FROM r WHERE i < 50)
SELECT round((lo + hi) / 2, 5) AS log_a0, CAST(g IN (0, 96) AS INT) AS at_edge, CAST(n AS BIGINT) AS n_codons FROM r WHERE i = 50"""


_SHARE_SQL = f"""WITH {CAND_SQL}, s AS (SELECT orf, CAST(sum(c0 + c1 + c2) AS DOUBLE) AS reads, sum(c0) / sum(c0 + c1 + c2) AS o0, sum(c1) / sum(c0 + c1 + c2) AS o1, sum(c2) / sum(c0 + c1 + c2) AS o2 FROM cand GROUP BY orf)"""
_ADJUST_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM tests),
low AS (
  SELECT *, min(p * m / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low,
         sum(1.0 / r) OVER (PARTITION BY family) AS h FROM ranked)"""
_TEST_SQL = "tests AS (SELECT o_orderkey AS id, o_orderpriority AS family, (o_orderkey * 7919 % 9973 + 1) / 9974.0 AS p FROM orders)"

QUERIES = {f.__name__: f for f in (iv_core_summary, dm_loglik_host, dm_lambda_fit, dm_geometry, dm_expected_reads, dm_residual_breadth, dm_lag1, dm_projected_lag1, fdr_bh_by, fdr_classes, qc_template, qc_ternary, qc_start_histogram, qc_cds_metrics, qc_trimmed_template, qc_reservoir_template, qc_a0, dm_bootstrap)}
ORACLES = {
    "dm_lambda_fit": _FIT_SQL,
    "qc_a0": _A0_SQL,
    "dm_projected_lag1": f"""WITH {CAND_SQL}, s AS (SELECT orf, codon, (orf % 101) / 100.0::DOUBLE AS l, c0 / (c0 + c1 + c2) AS a, c1 / (c0 + c1 + c2) AS b, c2 / (c0 + c1 + c2) AS c FROM cand),
v AS (SELECT orf, codon, ((a - (1 - l) * 0.1 - l * 0.8) * 0.7 - (b - (1 - l) * 0.2 - l * 0.1) * 0.1 - (c - (1 - l) * 0.7 - l * 0.1) * 0.6) / sqrt(0.86::DOUBLE) AS v FROM s), p AS (SELECT a.orf, a.v AS x, b.v AS y FROM v a JOIN v b ON a.orf = b.orf AND b.codon = a.codon + 1)
SELECT orf, count(*) AS n_pairs, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN round(corr(x, y), 6) END AS lag1 FROM p GROUP BY orf""",
    "iv_core_summary": f"""{counting.CODON_SQL},
size AS (SELECT orf, max(len) // 3 AS n_codons FROM block GROUP BY orf),
x AS (SELECT c.*, n_codons, c0 + c1 + c2 AS n, codon BETWEEN 1 AND n_codons - 2 AS core FROM codon c JOIN size USING (orf)),
agg AS (SELECT orf, n_codons - 2 AS n_core, CAST(sum(n) AS BIGINT) AS region_reads, CAST(sum(CASE WHEN core THEN n ELSE 0 END) AS BIGINT) AS core_reads,
  CAST(sum(CASE WHEN core THEN c0 ELSE 0 END) AS BIGINT) AS core_p0, CAST(sum(CASE WHEN core THEN c1 ELSE 0 END) AS BIGINT) AS core_p1, CAST(sum(CASE WHEN core THEN c2 ELSE 0 END) AS BIGINT) AS core_p2,
  count(*) FILTER (core AND n > 0) AS active FROM x GROUP BY orf, n_codons)
SELECT *, CASE WHEN active >= 5 AND active / n_core >= 0.15 THEN 'broad' WHEN active >= 5 THEN 'low_fraction' WHEN active / n_core >= 0.15 THEN 'few_codons' ELSE 'localized' END AS breadth,
  CASE WHEN active >= 3 AND core_reads >= 15 THEN 1 ELSE 0 END AS eligible FROM agg""",
    "dm_loglik_host": f"""WITH {CAND_SQL} SELECT orf, round(sum(lgamma(20.0) - lgamma(c0 + c1 + c2 + 20.0) + lgamma(c0 + 2.0) - lgamma(2.0) + lgamma(c1 + 4.0) - lgamma(4.0) + lgamma(c2 + 14.0) - lgamma(14.0)), 6) AS loglik FROM cand GROUP BY orf""",
    "dm_geometry": f"""{_SHARE_SQL}, g AS (SELECT *, (o0 - 0.1) / 0.7 AS gain, (0.7 - o2) / 0.6 AS dropped,
  greatest(0.0, least(1.0, ((o0 - 0.1) * 0.7 - (o1 - 0.2) * 0.1 - (o2 - 0.7) * 0.6) / 0.86)) AS al FROM s),
f AS (SELECT *, abs(gain - dropped) AS d, abs(gain - dropped) / (greatest(abs(gain), abs(dropped)) + 0.01) AS rel,
  sqrt(power(o0 - 0.1 - al * 0.7, 2) + power(o1 - 0.2 + al * 0.1, 2) + power(o2 - 0.7 + al * 0.6, 2)) AS far FROM g)
SELECT orf, round(gain, 6) AS gain, round(dropped, 6) AS "drop", round(d, 6) AS abs_diff, round(rel, 6) AS rel_diff, round(al, 6) AS projection, round(far, 6) AS distance,
  CAST(gain > 0.05 AND dropped > 0.05 AND far < 0.1 AND d < 0.1 AND rel < 0.3 AS INTEGER) AS consistent FROM f""",
    "dm_expected_reads": f"""{_SHARE_SQL}, x AS (SELECT orf, (orf % 101) / 100.0::DOUBLE AS l, reads AS n FROM s)
SELECT orf, round((1 - l) * n, 6) AS expected_host, round(l * n, 6) AS expected_trans, round((1 - l) * n * 0.1::DOUBLE, 6) AS expected_host_p0, round((1 - l) * n * 0.2::DOUBLE, 6) AS expected_host_p1, round((1 - l) * n * 0.7::DOUBLE, 6) AS expected_host_p2,
  round(l * n * 0.8::DOUBLE, 6) AS expected_trans_p0, round(l * n * 0.1::DOUBLE, 6) AS expected_trans_p1, round(l * n * 0.1::DOUBLE, 6) AS expected_trans_p2 FROM x""",
    "dm_residual_breadth": f"""WITH {CAND_SQL}, z AS (SELECT orf, c0 + c1 + c2 AS n, ((c0 - n * 0.1) - (c1 - n * 0.2)) / sqrt(n * (n + 20.0) / 21.0 * (0.1 * 0.9 + 0.2 * 0.8 + 2 * 0.1 * 0.2)) AS z FROM cand),
a AS (SELECT orf, count(*) FILTER (z >= 0.5) AS supported, count(*) AS codons FROM z GROUP BY orf) SELECT *, CAST(supported * 3 > codons AS INTEGER) AS passes FROM a""",
    "dm_lag1": f"""WITH {CAND_SQL}, v AS (SELECT orf, codon, (c0 - (c0 + c1 + c2) * 0.1::DOUBLE) / (c0 + c1 + c2) AS v FROM cand),
p AS (SELECT a.orf, a.v AS x, b.v AS y FROM v a JOIN v b ON a.orf = b.orf AND b.codon = a.codon + 1)
SELECT orf, count(*) AS n_pairs, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN round(corr(x, y), 6) END AS lag1 FROM p GROUP BY orf""",
    "fdr_bh_by": f"WITH {_TEST_SQL}, {_ADJUST_SQL} SELECT id, family, round(least(1.0, low), 6) AS q_bh, round(least(1.0, low * h), 6) AS q_by FROM low",
    "fdr_classes": f"""WITH {_TEST_SQL.replace('AS p FROM', 'AS p0, power(p0, 4) AS p FROM')}, {_ADJUST_SQL}, c AS (
  SELECT id, least(1.0, low) AS q, CASE WHEN id % 40 < 10 THEN 'ultra_short_exploratory' ELSE 'primary' END AS tier FROM low)
SELECT tier, CASE WHEN q >= 0.05 THEN 'host_only_supported' WHEN id % 3 = 0 THEN 'atypical_pattern' WHEN id % 5 = 0 THEN 'localized_core_signal' WHEN id % 7 = 0 THEN 'low_target_frame_residual_breadth'
  WHEN tier = 'ultra_short_exploratory' THEN 'ultra_short_exploratory' ELSE 'credible_extra_ORF_like_signal' END AS classification, count(*) AS n FROM c GROUP BY ALL""",
    "qc_template": f"""WITH {CAND_SQL}, x AS (SELECT *, c0 + c1 + c2 AS n FROM cand WHERE c0 + c1 + c2 >= 3)
SELECT 'read_weighted' AS method, count(*) AS n_codons, round(sum(c0) / sum(n), 6) AS pi0, round(sum(c1) / sum(n), 6) AS pi1, round(sum(c2) / sum(n), 6) AS pi2 FROM x
UNION ALL SELECT 'codon_equal', count(*), round(avg(c0 / n), 6), round(avg(c1 / n), 6), round(avg(c2 / n), 6) FROM x""",
    "qc_ternary": f"""WITH {CAND_SQL}, x AS (SELECT c0 + c1 + c2 AS n, c0 * 20 // n AS b0, c1 * 20 // n AS b1, c2 * 20 // n AS b2, c0 * 20 % n AS r0, c1 * 20 % n AS r1, c2 * 20 % n AS r2 FROM cand),
g AS (SELECT b0 + CAST((r1 > r0)::INT + (r2 > r0)::INT < 20 - b0 - b1 - b2 AS INT) AS g0, b1 + CAST((r0 >= r1)::INT + (r2 > r1)::INT < 20 - b0 - b1 - b2 AS INT) AS g1,
  b2 + CAST((r0 >= r2)::INT + (r1 >= r2)::INT < 20 - b0 - b1 - b2 AS INT) AS g2 FROM x)
SELECT CAST(g0 AS BIGINT) AS g0, CAST(g1 AS BIGINT) AS g1, CAST(g2 AS BIGINT) AS g2, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM g GROUP BY ALL""",
    "qc_start_histogram": f"""{counting.CODON_SQL}, grid AS (SELECT unnest(range(-30, 31)) AS rel_nt)
SELECT rel_nt, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM grid LEFT JOIN hit ON t - 15 = rel_nt GROUP BY rel_nt""",
    "qc_cds_metrics": f"""{counting.CODON_SQL}, size AS (SELECT orf, max(len) // 3 AS n_codons FROM block GROUP BY orf)
SELECT orf, CAST(sum(c0 + c1 + c2) AS BIGINT) AS reads, round(sum(c0) / sum(c0 + c1 + c2), 6) AS pif, round(count(*) FILTER (c0 * 3 > c0 + c1 + c2) / any_value(n_codons), 6) AS uniformity
FROM codon JOIN size USING (orf) GROUP BY orf""",
    "qc_reservoir_template": f"""WITH {CAND_SQL}, kept AS (SELECT * FROM cand WHERE c0 + c1 + c2 >= 3 ORDER BY md5('1|' || orf || '|' || codon), orf, codon LIMIT 2000), v AS (
  SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS r, count(*) OVER (PARTITION BY f) AS n FROM (
    SELECT unnest([0, 1, 2]) AS f, unnest([c0 / (c0 + c1 + c2), c1 / (c0 + c1 + c2), c2 / (c0 + c1 + c2)]) AS x FROM kept)),
m AS (SELECT f, avg(x) AS m FROM v WHERE r > floor(n * 0.1::DOUBLE) AND r <= n - floor(n * 0.1::DOUBLE) GROUP BY f),
p AS (SELECT f, m / sum(m) OVER () AS p FROM m)
SELECT round(max(p) FILTER (f = 0), 6) AS pi0, round(max(p) FILTER (f = 1), 6) AS pi1, round(max(p) FILTER (f = 2), 6) AS pi2 FROM p""",
    "qc_trimmed_template": f"""WITH {CAND_SQL}, v AS (
  SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS r, count(*) OVER (PARTITION BY f) AS n FROM (
    SELECT unnest([0, 1, 2]) AS f, unnest([c0 / (c0 + c1 + c2), c1 / (c0 + c1 + c2), c2 / (c0 + c1 + c2)]) AS x FROM cand WHERE c0 + c1 + c2 >= 3)),
m AS (SELECT f, avg(x) AS m FROM v WHERE r > floor(n * 0.1::DOUBLE) AND r <= n - floor(n * 0.1::DOUBLE) GROUP BY f),
p AS (SELECT f, m / sum(m) OVER () AS p FROM m)
SELECT round(max(p) FILTER (f = 0), 6) AS pi0, round(max(p) FILTER (f = 1), 6) AS pi1, round(max(p) FILTER (f = 2), 6) AS pi2 FROM p""",
}
