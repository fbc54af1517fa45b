"""Multiple testing by family, final classes, and the quality contract of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions import skew
from codonlake.functions.sqlx import finite

#: Classes that are never tested, families, and the classes of calls.
EXCLUDED = ("invalid_overlap_type", "too_short", "insufficient_data", "template_separation_too_small")
PRIMARY, EXPLORATORY, OUTSIDE = "primary", "ultra_short_exploratory", "excluded"
CREDIBLE, HOST_ONLY = "credible_extra_ORF_like_signal", "host_only_supported"


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: the sum itself for few terms, else its expansion, whose first left-out term is under 1e-13."""
    x = m.cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)
    many = F.log(x) + F.lit(0.57721566490153286) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)
    return F.when(m <= 64, few).otherwise(many)


def adjust(tests: DataFrame, family: str = "family", p: str = "p") -> DataFrame:
    """Adds q_bh and q_by: step-up adjustment inside each family. A p that is no number counts as 1.

    Only distinct p values are ranked. They are dealt by ranges, so a family is no single task: ranks are running
    totals of counts, and the least step from a value on is the least of its range and of the ranges after it."""
    name = F.coalesce(F.concat(F.lit("f:"), F.col(family).cast("string")), F.lit("none"))
    x = tests.withColumn("_test", F.struct(name.alias("family"), F.coalesce(finite(F.col(p)), F.lit(1.0)).alias("p")))
    values = x.groupBy("_test").agg(F.count(F.lit(1)).alias("k")).select("_test", F.col("_test.family").alias("family"), F.col("_test.p").alias("p"), "k")
    ranked = skew.running(skew.ranges(values, "family", "p"), "family", "p", F.col("k"), "rank")
    sizes = values.groupBy("family").agg(F.sum("k").alias("m"))  # one row for each family
    ranked = ranked.join(F.broadcast(sizes), "family").withColumn("step", F.col("p") * F.col("m") / F.col("rank"))
    low = skew.least_from(ranked, "family", "p", "step", "low")
    lookup = low.select("_test", F.least(F.lit(1.0), "low").alias("q_bh"), F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("low")) * harmonic(F.col("m"))).alias("q_by"))
    return skew.join_unique(x, lookup, "_test", p, "inner").drop("_test")


def classify(q: Column, consistent: Column, breadth: Column, residual: Column, tier: Column, alpha: float = 0.05) -> Column:
    """The first gate that fails names the class; a q that is no number counts as 1."""
    return (
        F.when(F.coalesce(finite(q), F.lit(1.0)) >= alpha, HOST_ONLY).when(~F.coalesce(consistent, F.lit(False)), "atypical_pattern").when(~F.coalesce(breadth, F.lit(False)), "localized_core_signal")
        .when(~F.coalesce(residual, F.lit(False)), "low_target_frame_residual_breadth").when(tier == EXPLORATORY, EXPLORATORY).otherwise(CREDIBLE)
    )


def length_tier(peptide_len: Column, primary: int = 10) -> Column:
    return F.when(F.coalesce(peptide_len, F.lit(0)) < primary, EXPLORATORY).otherwise(PRIMARY)


def score(p: Column) -> Column:
    """-log10 of p between 1e-300 and 1; 0 for null or NaN."""
    return F.when(p.isNull() | F.isnan(p), F.lit(0.0)).otherwise(F.lit(0.0) - F.log10(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p))))


def effect_fits(lambda_min: float = 0.05, farthest: float = 0.10) -> Column:
    """Whether share, gain, drop and distance of a row tell of the same mixture."""
    value = lambda c: finite(F.col(c))
    ok = (value("lambda_hat") > lambda_min) & (value("alt_frame_gain") > 0) & (value("host_frame_drop") < 0) & (F.col("mixture_geometry_consistent") == 1)
    return F.coalesce(ok & (value("distance_to_mixture_segment") < farthest), F.lit(False))


def with_contract(x: DataFrame) -> DataFrame:
    """Adds the scores, qc_status, qc_flags (joined by |, each once), and filter_reason. No significance is no failure."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    before, pre, status = empty("prefilter_reason"), empty("classification_pre_fdr"), empty("importance_status")
    fitted = finite(F.col("lambda_hat")).isNotNull()
    unless = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(0)) != 1, name)
    checks = [unless("template_separation_ok", "template_separation"), unless("mixture_geometry_consistent", "mixture_geometry"), unless("credible_active_core_breadth_ok", "active_core_breadth"), unless("credible_target_residual_breadth_ok", "target_residual_breadth"), F.when(status.startswith("failed_"), status)]
    unfitted = F.array(F.when(~pre.isin("", HOST_ONLY, "tested"), pre))
    flags = F.array_distinct(F.array_compact(F.concat(F.array(F.when(before != "", before)), F.when(fitted, F.array(*checks)).otherwise(unfitted))))
    consistent = F.when(F.col("mixture_geometry_consistent") == 1, "pass").otherwise("flagged")
    out = x.withColumn("dm_evidence_score", score(F.coalesce(F.col("p_final"), F.lit(1.0)))).withColumn("dm_fdr_score", score(F.col("q_BH"))).withColumn("_flags", flags)
    return out.withColumns(
        {
            "qc_status": F.when(~fitted, "not_evaluable").when(F.size("_flags") == 0, "pass").otherwise("flagged"),
            "background_template_sensitivity_status": F.when(~fitted, "not_evaluable").otherwise(consistent),
            "qc_flags": F.array_join("_flags", "|"),
            "filter_reason": F.when(F.col("classification").isin(CREDIBLE, EXPLORATORY), "").when(before != "", before).otherwise(F.col("classification")),
        }
    ).drop("_flags")


def apply(results: DataFrame, primary: int = 10, alpha: float = 0.05, lambda_min: float = 0.05, farthest: float = 0.10) -> DataFrame:
    """All rows with length_tier, fdr_family, q_BH, q_BY, classification, the calls and the contract.

    Rows of an excluded class stand outside the families with q = 1; the others are adjusted inside their tier's."""
    x = results.withColumn("length_tier", length_tier(F.coalesce("peptide_len", "aa_len"), primary))
    outside = F.coalesce(F.col("classification_pre_fdr").isin(*EXCLUDED), F.lit(False))
    x = x.withColumn("fdr_family", F.when(outside, OUTSIDE).otherwise(F.col("length_tier")))
    q = adjust(x, "fdr_family", "p_final")
    one = lambda c: F.when(F.col("fdr_family") == OUTSIDE, F.lit(1.0)).otherwise(F.col(c))
    q = q.withColumn("q_BH_", one("q_bh")).withColumn("q_BY", one("q_by")).drop("q_bh").withColumnRenamed("q_BH_", "q_BH")
    flag = lambda c: F.col(c) == 1
    final = classify(F.col("q_BH"), effect_fits(lambda_min, farthest), flag("credible_active_core_breadth_ok"), flag("credible_target_residual_breadth_ok"), F.col("length_tier"), alpha)
    q = q.withColumn("classification", F.when(F.col("fdr_family") == OUTSIDE, F.col("classification_pre_fdr")).otherwise(final))
    q = q.withColumn("primary_credible_call", (F.col("classification") == CREDIBLE).cast("int")).withColumn("ultra_short_exploratory_call", (F.col("classification") == EXPLORATORY).cast("int"))
    return with_contract(q)


def in_order(results: DataFrame, order: str = "candidate_order") -> DataFrame:
    """Results by the order in which candidates were read."""
    return results.orderBy(F.col(order).asc_nulls_last())


def summary(results: DataFrame) -> DataFrame:
    """metric, value: counts of rows by class, family and tier, of calls, and the importance draws, in one pass."""
    name = lambda p, c: F.concat(F.lit(p), F.coalesce(F.col(c), F.lit("")))
    parts = F.array(
        *[F.struct(m.alias("metric"), v.cast("long").alias("v")) for m, v in (
            (F.lit("candidates"), F.lit(1)), (name("class:", "classification"), F.lit(1)), (name("family:", "fdr_family"), F.lit(1)), (name("tier:", "length_tier"), F.lit(1)),
            (F.lit("primary_credible_call"), F.col("primary_credible_call")), (F.lit("importance_reps_total"), F.coalesce(F.col("importance_reps"), F.lit(0))),
        )]
    )
    return results.select(F.inline(parts)).groupBy("metric").agg(F.sum("v").alias("value"))
