"""Tables behind the figures of one run: points, gates, margins, waterfall, combinations, bins, selections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonlake.functions.sqlx import finite
from codonlake.operators.fdr import CREDIBLE, EXPLORATORY

#: Columns that a run's table must have, the gates in order, and the bins of peptide lengths.
REQUIRED = frozenset(
    """torf_id gorf_id gene_name gene_id overlap_type classification classification_pre_fdr fdr_family peptide_len pi_trans_0 pi_trans_1 pi_trans_2 pi_obs_0 pi_obs_1 pi_obs_2 q_BH p_final core_reads
    n_active_core_codons active_core_codon_frac target_vs_unused_z05_frac_active lambda_hat lambda_gain_raw lambda_drop_raw lambda_abs_diff lambda_rel_diff lambda_proj_raw distance_to_mixture_segment
    alt_frame_gain host_frame_drop mixture_geometry_consistent""".split()
)
GATES = ("bh", "direction", "geometry", "active_breadth", "residual_breadth")
BINS = ((9, "6–9"), (14, "10–14"), (29, "15–29"), (59, "30–59"), (None, "≥60"))
MARGINS = ("q_BH", "lambda_hat", "distance", "lambda_abs_diff", "lambda_rel_diff", "active_core_codons", "active_core_frac", "target_residual_frac")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the gates."""

    fdr: float = 0.05
    lambda_min: float = 0.05
    farthest: float = 0.10
    abs_diff: float = 0.10
    rel_diff: float = 0.30
    active_codons: int = 5
    active_frac: float = 0.15
    residual_frac: float = 1 / 3


def rotated(prefix: str) -> list[Column]:
    """Shares of a candidate's phases as phases 0, +1, +2 of the CDS."""
    c = [F.col(f"{prefix}_{k}") for k in range(3)]
    return [F.when(F.col("overlap_type") == "F1", c[(2 + k) % 3]).when(F.col("overlap_type") == "F2", c[(1 + k) % 3]) for k in range(3)]


def target() -> list[Column]:
    """The trans template as the CDS's phases."""
    c = [F.col(f"pi_trans_{k}") for k in range(3)]
    return [F.when(F.col("overlap_type") == "F1", c[(2 + k) % 3]).otherwise(c[(1 + k) % 3]) for k in range(3)]


def place(p: Sequence[Column]) -> tuple[Column, Column]:
    """A composition's place in a triangle."""
    return 0.5 * p[0] + p[2], F.lit(math.sqrt(3) / 2) * p[0]


def segment_distance(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance of a point from a segment; from its start, where it has no length."""
    step = [y - x for x, y in zip(a, b, strict=True)]
    norm = sum((s * s for s in step[1:]), step[0] * step[0])
    dot = sum(((x - o) * s for x, o, s in zip(p[1:], a[1:], step[1:], strict=True)), (p[0] - a[0]) * step[0])
    along = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.nullif(norm, F.lit(0.0))))).otherwise(0.0)
    far = [x - (o + along * s) for x, o, s in zip(p, a, step, strict=True)]
    return F.sqrt(far[0] * far[0] + far[1] * far[1] + far[2] * far[2])


def points(results: DataFrame, pure_only: bool = False) -> DataFrame:
    """The rows with numbers for all shares and an overlap type, with cds_p0, cds_plus1, cds_plus2, ternary_x, ternary_y and signed_branch_distance."""
    if missing := sorted(REQUIRED - set(results.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    context = {"gene_level_orf_class", "gene_level_pure_intorf_eligible"}
    if pure_only and (missing := sorted(context - set(results.columns))):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    pure = F.coalesce(F.col("gene_level_pure_intorf_eligible").try_cast("double").cast("int"), F.lit(0)) if "gene_level_pure_intorf_eligible" in results.columns else F.lit(1)
    x = results.withColumn("gene_level_pure_intorf_eligible", pure)
    if "gene_level_orf_class" not in x.columns:
        x = x.withColumn("gene_level_orf_class", F.lit(""))
    x = x.filter("gene_level_pure_intorf_eligible = 1") if pure_only else x
    text = {"torf_id", "gorf_id", "gene_name", "gene_id", "overlap_type", "classification", "classification_pre_fdr", "fdr_family"}
    whole = {"peptide_len", "core_reads", "n_active_core_codons", "mixture_geometry_consistent"}
    zero = {"q_BH": 1.0, "p_final": 1.0, "active_core_codon_frac": 0.0, "target_vs_unused_z05_frac_active": 0.0}
    for c in sorted(REQUIRED - text):
        v = finite(F.col(c))
        x = x.withColumn(c, F.coalesce(v.cast("long"), F.lit(0).cast("long")) if c in whole else F.coalesce(v, F.lit(zero[c])) if c in zero else v)
    shares = [f"pi_{s}_{k}" for s in ("obs", "trans") for k in range(3)]
    x = x.filter(F.col("overlap_type").isin("F1", "F2")).filter(" and ".join(f"{c} is not null" for c in shares))
    cds = rotated("pi_obs")
    (hx, hy), (tx, ty), (ox, oy) = place([F.col(f"pi_trans_{k}") for k in range(3)]), place(target()), place(cds)
    cross = (tx - hx) * (oy - hy) - (ty - hy) * (ox - hx)
    return x.withColumns({"cds_p0": cds[0], "cds_plus1": cds[1], "cds_plus2": cds[2], "ternary_x": ox, "ternary_y": oy, "signed_branch_distance": F.when(cross >= 0, F.col("distance_to_mixture_segment")).otherwise(-F.col("distance_to_mixture_segment"))})


def gates(limits: Limits = Limits()) -> dict[str, Column]:
    """The five gates of a point, as booleans that are never null."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return {
        "bh": ok(F.col("q_BH") < limits.fdr),
        "direction": ok((F.col("lambda_hat") > limits.lambda_min) & (F.col("alt_frame_gain") > 0) & (F.col("host_frame_drop") < 0)),
        "geometry": ok((F.col("mixture_geometry_consistent") == 1) & (F.col("distance_to_mixture_segment") < limits.farthest)),
        "active_breadth": ok((F.col("n_active_core_codons") >= limits.active_codons) & (F.col("active_core_codon_frac") >= limits.active_frac)),
        "residual_breadth": ok(F.col("target_vs_unused_z05_frac_active") > limits.residual_frac),
    }


def margins(limits: Limits = Limits()) -> dict[str, Column]:
    """How far a point is inside each of eight limits, as a share of the limit; -2 for what is no number."""
    share = lambda v, limit, above: F.coalesce(((v - limit) if above else (limit - v)) / limit, F.lit(-2.0))
    c = F.col
    return dict(
        zip(
            MARGINS,
            (
                share(c("q_BH"), limits.fdr, False), share(c("lambda_hat"), limits.lambda_min, True), share(c("distance_to_mixture_segment"), limits.farthest, False), share(c("lambda_abs_diff"), limits.abs_diff, False),
                share(c("lambda_rel_diff"), limits.rel_diff, False), (c("n_active_core_codons") - limits.active_codons) / max(limits.active_codons, 1), share(c("active_core_codon_frac"), max(limits.active_frac, 1e-12), True),
                share(c("target_vs_unused_z05_frac_active"), max(limits.residual_frac, 1e-12), True),
            ),
            strict=True,
        )
    )


def plot_data(pts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The 26 columns of a point."""
    flags = [g.cast("int").alias(f"gate_{n}") for n, g in gates(limits).items()]
    return pts.select(
        "torf_id", "gorf_id", "gene_id", "gene_name", "overlap_type", "classification", "gene_level_orf_class", "gene_level_pure_intorf_eligible", "cds_p0", "cds_plus1", "cds_plus2", "ternary_x", "ternary_y", "lambda_hat",
        F.col("lambda_proj_raw").alias("lambda_proj"), "signed_branch_distance", "q_BH", "core_reads", "n_active_core_codons", "active_core_codon_frac", F.col("target_vs_unused_z05_frac_active").alias("target_residual_supported_frac"), *flags,
    )


def waterfall(pts: DataFrame, total: int, limits: Limits = Limits()) -> DataFrame:
    """step, stage, count, fraction_of_all: the seven counts, each inside the one before, in one pass."""
    g = gates(limits)
    s2 = g["bh"]
    s3 = s2 & g["direction"] & g["geometry"]
    s4 = s3 & g["active_breadth"]
    s5 = s4 & g["residual_breadth"]
    names = ["All intORF_altframe", "Coverage eligible", f"BH q < {limits.fdr:g}", "Direction + geometry", "Active-codon breadth", "Target-residual breadth", "Primary credible"]
    one = pts.agg(*[c.alias(f"_{k}") for k, c in enumerate((F.count(F.lit(1)), F.count_if(s2), F.count_if(s3), F.count_if(s4), F.count_if(s5), F.count_if(s5 & (F.col("classification") == CREDIBLE))), 1)]).withColumn("_0", F.lit(total).cast("long"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), F.col(f"_{k}").alias("count"), (F.col(f"_{k}") / F.nullif("_0", F.lit(0))).alias("fraction_of_all")) for k, n in enumerate(names)])))


def gate_combinations(pts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """rank, combination, count and four flags among the significant points: most points first, then those that pass the earlier gates."""
    g = {n: c for n, c in gates(limits).items() if n != "bh"}
    x = pts.filter(gates(limits)["bh"]).select(*[c.cast("int").alias(n) for n, c in g.items()]).groupBy(*g).agg(F.count(F.lit(1)).alias("count"))
    name = F.concat_ws("+", *[F.when(F.col(n) == 1, n.replace("_", " ")) for n in g])
    # sixteen rows at most
    return x.select(F.row_number().over(W.orderBy(F.desc("count"), *[F.desc(n) for n in g])).alias("rank"), F.when(name == "", "none").otherwise(name).alias("combination"), "count", *g)


def length_table(pts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each bin of peptide lengths, empty ones included."""
    own = F.lit(BINS[-1][1])
    for top, name in reversed(BINS[:-1]):
        own = F.when(F.col("peptide_len") <= top, name).otherwise(own)
    x = pts.groupBy(own.alias("length_bin_aa")).agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("q_BH") < limits.fdr).alias("bh_significant"), F.count_if(F.col("classification") == CREDIBLE).alias("primary_credible"), F.count_if(F.col("classification") == EXPLORATORY).alias("ultra_short_exploratory")
    )
    names = pts.sparkSession.createDataFrame([(n,) for _, n in BINS], "length_bin_aa string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    y = names.join(F.broadcast(x), "length_bin_aa", "left").select("length_bin_aa", *[zero(F.col(c)).alias(c) for c in x.columns[1:]])
    share = lambda c: F.coalesce(F.col(c) / F.nullif("eligible", F.lit(0)), F.lit(0.0)).alias(f"{c}_frac")
    return y.select("*", share("bh_significant"), share("primary_credible"))


def margin_candidates(pts: DataFrame, highlight: Sequence[str] = (), most: int = 36, limits: Limits = Limits(), near: float = 0.15) -> DataFrame:
    """The highlighted genes' points and, up to `most` in all, those nearest to the threshold; with margins and their rank."""
    lit = F.col("gene_name").isin(*highlight) if highlight else F.lit(False)
    x = pts.withColumn("_group", F.when(lit, 0).otherwise(1)).filter((F.col("_group") == 0) | (F.col("q_BH") < near)).withColumn("_far", F.when(F.col("_group") == 1, F.abs(F.col("q_BH") - limits.fdr)).otherwise(0.0))
    order = ["_group", "_far", "torf_id", "gorf_id"]
    top = x.orderBy(*order).limit(most)
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "gene_name", "gene_id", "gorf_id", "torf_id", "overlap_type", "classification", *[m.alias(f"margin_{n}") for n, m in margins(limits).items()])


def background_sample(pts: DataFrame, most: int = 30_000, seed: int = 0, key: str = "torf_id") -> DataFrame:
    """All points, or that many chosen by a hash of the key: the same ones however the table is partitioned."""
    return pts.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)


def abundance_summary(rows: DataFrame, library: int, x: str = "pfpkm") -> DataFrame:
    """metric, value of quantities (status, x): rows, rows by status, library size, median and maximum of the quantified."""
    value = F.when(F.col("status") == "quantified", finite(F.col(x)))
    one = rows.agg(F.count(F.lit(1)).cast("double").alias("candidate_rows"), F.median(value).alias("median"), F.max(value).alias("max"))
    fixed = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in (("candidate_rows", F.col("candidate_rows")), ("library_psites", F.lit(float(library))), ("median_intorf_pFPKM", F.col("median")), ("max_intorf_pFPKM", F.col("max")))])))
    return fixed.union(rows.groupBy(F.concat(F.lit("status::"), "status").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")))
