"""ORF scanning, P-site calling and report queries on the adapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.sqlx import rounded
from codonlake.operators import matrices, orfs, psites, reports
from codonlake.plans import domain
from codonlake.plans.counting import iv_site_index
from codonlake.sources.tables import table


def tx_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("tx"), F.translate(F.regexp_replace("text", "[^ACGTacgt]", ""), "acgt", "ACGT").alias("seq"))


def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orfs.scan(tx_sequences(spark, sf_dir))
    return out.select("tx", *[F.col(c).cast("long").alias(c) for c in ("frame", "t_start", "t_end", "aa_len")])


def orf_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orfs.scan(tx_sequences(spark, sf_dir)).join(tx_sequences(spark, sf_dir), "tx")
    around, strength = orfs.kozak(F.col("seq"), F.col("t_start"))
    out = x.select("tx", F.col("t_start").cast("long").alias("t_start"), orfs.translate(F.col("seq"), F.col("t_start"), F.col("t_end")).alias("peptide"), around.alias("kozak_seq"), strength.alias("kozak_class"))
    return out.withColumn("start_revcomp", orfs.reverse_complement(F.substring("kozak_seq", 7, 3)))


def ann_merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.merge_ranges(domain.orf_blocks(spark, sf_dir).select(F.concat_ws("", "chrom", "strand").alias("chrom"), "start0", "end0"), "chrom")


def ps_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psites.bedgraph(iv_site_index(spark, sf_dir))


def ab_quantify(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lam = F.when(k % 11 == 0, None).when(k % 13 == 0, 1.5).otherwise(k % 100 / 100.0)
    rows = o.select(k.alias("id"), (k % 17).alias("n_core_codons"), (k % 23).alias("reads"), lam.alias("lambda"), (k % 100 / 200.0).alias("ci_low"), ((k % 100 + 20) / 100.0).alias("ci_high"), (k % 5).alias("host_reads"))
    out = reports.quantify(rows, 1_000_000)
    return out.select("id", "status", *[rounded(F.col(c)).alias(c) for c in out.columns[2:]])


def ex_ternary_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons by their phase ratio in lowest terms."""
    from codonlake.plans.inference import cand_codons

    g = reports.gcd(reports.gcd(F.col("c0"), F.col("c1")), F.col("c2"))
    x = cand_codons(spark, sf_dir).withColumn("g", g).select(*[F.expr(f"c{k} div g").alias(f"r{k}") for k in range(3)])
    return x.groupBy("r0", "r1", "r2").agg(F.count(F.lit(1)).alias("n"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = e.groupBy(F.col("event_type").alias("replicate"), F.col("user_id").alias("key")).agg(F.min("event_id").alias("m"), F.count(F.lit(1)).alias("n"))
    return x.select("key", "replicate", (F.col("m") % 97 / 97.0).alias("q"), (F.col("m") % 101 / 100.0).alias("lambda"), F.when(F.col("n") % 3 == 0, 1).otherwise(0).alias("primary"))


def in_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    names = [r[0] for r in calls.select("replicate").distinct().orderBy("replicate").collect()]  # a few replicates
    out = reports.integrate(calls, names)
    return out.select("key", "n_observed", F.col("n_primary").cast("long").alias("n_primary"), "n_bh", rounded(F.col("median_lambda")).alias("median_lambda"), rounded(F.col("min_q")).alias("min_q"), "label")


def rp_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.pairwise(_calls(spark, sf_dir).select("key", "replicate", F.col("lambda").alias("x")))
    return out.select("rep_a", "rep_b", "n", *[rounded(F.col(c)).alias(c) for c in ("pearson", "spearman", "median_diff")])


def rp_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.support_combinations(_calls(spark, sf_dir))


def vz_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return reports.waterfall(table(spark, sf_dir, "orders"), [("bh", k % 20 != 0), ("direction", k % 3 != 0), ("distance", k % 7 != 0), ("breadth", k % 5 != 0), ("residual", k % 11 != 0)])


def vz_length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size").between(30, 59), 12).otherwise(F.col("p_size")))  # an empty bin
    return reports.length_bins(x, "size", F.col("p_partkey") % 3 == 0)


def _names(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a few replicates


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("key", "replicate", F.col("lambda").alias("x"), "primary")


def rp_lambda_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide values up to 0.9, with neutral column names."""
    names = _names(spark, sf_dir)
    out = matrices.wide(_values(spark, sf_dir), names, 0.0, 0.9)
    return out.select("key", "support", rounded(F.col("middle")).alias("middle"), *[rounded(F.col(f"`{r}`")).alias(f"r{k}") for k, r in enumerate(names)])


def rp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    out = matrices.states(_calls(spark, sf_dir), [*names, "absent"], names)
    return out.select("key", *[F.col(f"`{r}`").alias(f"r{k}") for k, r in enumerate([*names, "absent"])])


def rp_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matrices.correlations(_values(spark, sf_dir), _names(spark, sf_dir))
    return out.select("rep_a", "rep_b", "n", rounded(F.col("pearson")).alias("pearson"))


def vz_gate_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select((k % 3 != 0).alias("direction"), (k % 7 != 0).alias("distance"), (k % 5 != 0).alias("breadth"))
    return matrices.combinations(x, ["direction", "distance", "breadth"])


SEQ_SQL = "seqs AS (SELECT doc_id AS tx, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS seq FROM documents)"
SCAN_SQL = f"""WITH {SEQ_SQL},
places AS (SELECT tx, seq, unnest(range(0, greatest(length(seq) - 2, 0))) AS pos FROM seqs),
codon AS (SELECT tx, pos, pos % 3 AS frame, substr(seq, pos + 1, 3) AS codon FROM places),
hit AS (SELECT *, codon <> 'ATG' AS stop FROM codon WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA')),
seg AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY tx, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM hit),
orf AS (SELECT tx, frame, min(pos) FILTER (NOT stop) AS t_start, min(pos) FILTER (stop) + 3 AS t_end FROM seg GROUP BY tx, frame, seg),
found AS (SELECT tx, frame, t_start, t_end, (t_end - 3 - t_start) // 3 AS aa_len FROM orf WHERE t_start IS NOT NULL AND t_end IS NOT NULL AND (t_end - 3 - t_start) // 3 >= 6)"""
CALL_SQL = """calls AS (SELECT user_id AS key, event_type AS replicate, (min(event_id) % 97) / 97.0::DOUBLE AS q, (min(event_id) % 101) / 100.0::DOUBLE AS lam, CASE WHEN count(*) % 3 = 0 THEN 1 ELSE 0 END AS prim
  FROM events GROUP BY event_type, user_id)"""

QUERIES = {f.__name__: f for f in (orf_scan, orf_peptides, ann_merged_blocks, ps_bedgraph, ab_quantify, ex_ternary_ratios, in_replicates, rp_pairwise, rp_support, vz_waterfall, vz_length_bins, rp_lambda_matrix, rp_states, rp_correlations, vz_gate_combinations)}
ORACLES = {
    "orf_scan": f"{SCAN_SQL} SELECT tx, frame, t_start, t_end, aa_len FROM found",
    "orf_peptides": f"""{SCAN_SQL}, x AS (SELECT f.*, seq, substr('NNNNNN' || seq || 'NNNNNNNN', CAST(t_start AS INT) + 1, 14) AS kz FROM found f JOIN seqs USING (tx)),
aa AS (SELECT tx, t_start, i, CASE WHEN i = t_start THEN 'M' ELSE substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',
  CAST((strpos('TCAG', substr(seq, CAST(i AS INT) + 1, 1)) - 1) * 16 + (strpos('TCAG', substr(seq, CAST(i AS INT) + 2, 1)) - 1) * 4 + strpos('TCAG', substr(seq, CAST(i AS INT) + 3, 1)) AS INT), 1) END AS a
  FROM (SELECT tx, t_start, seq, unnest(range(t_start, t_end - 3, 3)) AS i FROM x)),
pep AS (SELECT tx, t_start, string_agg(a, '' ORDER BY i) AS peptide FROM aa GROUP BY tx, t_start)
SELECT tx, t_start, peptide, kz AS kozak_seq, CASE WHEN substr(kz, 4, 1) IN ('A', 'G') AND substr(kz, 10, 1) = 'G' THEN 'Strong' WHEN substr(kz, 4, 1) IN ('A', 'G') OR substr(kz, 10, 1) = 'G' THEN 'Moderate' ELSE 'Weak' END AS kozak_class,
  reverse(translate(substr(kz, 7, 3), 'ACGT', 'TGCA')) AS start_revcomp FROM x JOIN pep USING (tx, t_start)""",
    "ann_merged_blocks": f"""WITH {domain.BLOCK_SQL}, x AS (SELECT chrom || strand AS chrom, start0, end0, max(end0) OVER (PARTITION BY chrom, strand ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM block),
y AS (SELECT *, sum(CASE WHEN upto IS NULL OR start0 > upto THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM x)
SELECT chrom, min(start0) AS start0, max(end0) AS end0 FROM y GROUP BY chrom, k""",
    "ps_bedgraph": f"""WITH {domain.PSITE_SQL}, site AS (SELECT chrom, strand, pos, count(*) AS n FROM psite GROUP BY ALL),
x AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(n) OVER w = n THEN 0 ELSE 1 END AS new FROM site WINDOW w AS (PARTITION BY chrom, strand ORDER BY pos)),
y AS (SELECT *, sum(new) OVER (PARTITION BY chrom, strand ORDER BY pos) AS run FROM x) SELECT chrom, strand, min(pos) AS start0, max(pos) + 1 AS end0, max(n) AS depth FROM y GROUP BY chrom, strand, run""",
    "ab_quantify": """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 17 AS c, o_orderkey % 23 AS r, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 1.5::DOUBLE ELSE (o_orderkey % 100) / 100.0::DOUBLE END AS l,
  (o_orderkey % 100) / 200.0::DOUBLE AS lo, (o_orderkey % 100 + 20) / 100.0::DOUBLE AS hi, o_orderkey % 5 AS h FROM orders),
y AS (SELECT *, CASE WHEN c <= 0 THEN 'invalid_core_length' WHEN l IS NULL THEN 'not_model_quantifiable' WHEN l < 0 OR l > 1 THEN 'invalid_model_expected_reads' ELSE 'quantified' END AS status FROM x)
SELECT id, status, CASE WHEN status = 'quantified' THEN round(1e9 * (l * r) / (c * 3 * 1e6), 6) END AS pfpkm, CASE WHEN status = 'quantified' AND lo >= 0 AND lo <= hi AND hi <= 1 THEN round(1e9 * (lo * r) / (c * 3 * 1e6), 6) END AS pfpkm_low,
  CASE WHEN status = 'quantified' AND lo >= 0 AND lo <= hi AND hi <= 1 THEN round(1e9 * (hi * r) / (c * 3 * 1e6), 6) END AS pfpkm_high, CASE WHEN status = 'quantified' AND h > 0 THEN round(l * r / h, 6) END AS host_ratio FROM y""",
    "ex_ternary_ratios": """WITH cand AS (SELECT l_orderkey % 500 AS orf, l_orderkey // 500 AS codon, count(*) FILTER (l_suppkey % 3 = 0) AS c0, count(*) FILTER (l_suppkey % 3 = 1) AS c1, count(*) FILTER (l_suppkey % 3 = 2) AS c2 FROM lineitem GROUP BY ALL),
x AS (SELECT *, gcd(gcd(c0, c1), c2) AS g FROM cand) SELECT CAST(c0 // g AS BIGINT) AS r0, CAST(c1 // g AS BIGINT) AS r1, CAST(c2 // g AS BIGINT) AS r2, count(*) AS n FROM x GROUP BY ALL""",
    "in_replicates": f"""WITH {CALL_SQL}, n AS (SELECT count(DISTINCT replicate) AS n FROM calls),
a AS (SELECT key, count(*) AS n_observed, CAST(sum(prim) AS BIGINT) AS n_primary, count(*) FILTER (q <= 0.05) AS n_bh, round(median(lam), 6) AS median_lambda, round(min(q), 6) AS min_q FROM calls GROUP BY key)
SELECT a.*, CASE WHEN n_primary >= 2 AND n_primary >= 0.5 * n THEN 'reproducible_primary_credible' WHEN n_primary > 0 THEN 'primary_credible_not_reproducible' ELSE 'not_primary_credible' END AS label FROM a, n""",
    "rp_pairwise": f"""WITH {CALL_SQL}, b AS (SELECT x.replicate AS rep_a, y.replicate AS rep_b, x.lam AS a, y.lam AS b FROM calls x JOIN calls y ON x.key = y.key AND x.replicate < y.replicate),
r AS (SELECT *, rank() OVER (PARTITION BY rep_a, rep_b ORDER BY a) + (count(*) OVER (PARTITION BY rep_a, rep_b, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY rep_a, rep_b ORDER BY b) + (count(*) OVER (PARTITION BY rep_a, rep_b, b) - 1) / 2.0 AS rb FROM b)
SELECT rep_a, rep_b, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(median(abs(a - b)), 6) AS median_diff FROM r GROUP BY rep_a, rep_b""",
    "rp_support": f"WITH {CALL_SQL}, s AS (SELECT key, string_agg(replicate, '+' ORDER BY replicate) AS supporting FROM calls WHERE prim = 1 GROUP BY key) SELECT supporting, count(*) AS n FROM s GROUP BY supporting",
    "vz_waterfall": """WITH g AS (SELECT o_orderkey % 20 <> 0 AS a, o_orderkey % 3 <> 0 AS b, o_orderkey % 7 <> 0 AS c, o_orderkey % 5 <> 0 AS d, o_orderkey % 11 <> 0 AS e FROM orders)
SELECT 0 AS step, 'all' AS gate, count(*) AS n FROM g UNION ALL SELECT 1, 'bh', count(*) FILTER (a) FROM g UNION ALL SELECT 2, 'direction', count(*) FILTER (a AND b) FROM g UNION ALL SELECT 3, 'distance', count(*) FILTER (a AND b AND c) FROM g
UNION ALL SELECT 4, 'breadth', count(*) FILTER (a AND b AND c AND d) FROM g UNION ALL SELECT 5, 'residual', count(*) FILTER (a AND b AND c AND d AND e) FROM g""",
    "vz_length_bins": """WITH b(bin, lo, hi) AS (VALUES ('6-9', -1, 9), ('10-14', 10, 14), ('15-29', 15, 29), ('30-59', 30, 59), ('>=60', 60, 1000000))
SELECT bin, count(p_partkey) AS n, count(p_partkey) FILTER (p_partkey % 3 = 0) AS passing FROM b LEFT JOIN part ON CASE WHEN p_size BETWEEN 30 AND 59 THEN 12 ELSE p_size END BETWEEN lo AND hi GROUP BY bin""",
    "rp_lambda_matrix": f"""WITH {CALL_SQL}, reps AS (SELECT replicate, row_number() OVER (ORDER BY replicate) - 1 AS k FROM (SELECT DISTINCT replicate FROM calls)),
x AS (SELECT key, k, prim, CASE WHEN lam <= 0.9 THEN lam END AS v FROM calls JOIN reps USING (replicate))
SELECT key, count(*) FILTER (prim = 1) AS support, round(median(v), 6) AS middle, max(v) FILTER (k = 0) AS r0, max(v) FILTER (k = 1) AS r1, max(v) FILTER (k = 2) AS r2, max(v) FILTER (k = 3) AS r3, max(v) FILTER (k = 4) AS r4 FROM x GROUP BY key HAVING count(*) FILTER (prim = 1) > 0 AND count(v) > 0""",
    "rp_states": f"""WITH {CALL_SQL}, reps AS (SELECT replicate, row_number() OVER (ORDER BY replicate) - 1 AS k FROM (SELECT DISTINCT replicate FROM calls)) SELECT key, coalesce(max(1 + prim) FILTER (k = 0), 0) AS r0, coalesce(max(1 + prim) FILTER (k = 1), 0) AS r1, coalesce(max(1 + prim) FILTER (k = 2), 0) AS r2, coalesce(max(1 + prim) FILTER (k = 3), 0) AS r3, coalesce(max(1 + prim) FILTER (k = 4), 0) AS r4, -1 AS r5 FROM calls JOIN reps USING (replicate) GROUP BY key""",
    "rp_correlations": f"""WITH {CALL_SQL} SELECT a.replicate AS rep_a, b.replicate AS rep_b, count(*) AS n, round(corr(log2(1 + a.lam), log2(1 + b.lam)), 6) AS pearson
FROM calls a JOIN calls b ON a.key = b.key AND a.replicate < b.replicate GROUP BY ALL""",
    "vz_gate_combinations": """WITH x AS (SELECT CAST(o_orderkey % 3 <> 0 AS INT) AS direction, CAST(o_orderkey % 7 <> 0 AS INT) AS distance, CAST(o_orderkey % 5 <> 0 AS INT) AS breadth, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY n DESC, direction DESC, distance DESC, breadth DESC) AS rank FROM x""",
}
