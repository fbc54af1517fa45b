"""Tail probabilities of the likelihood ratio under the host template: parametric, importance and block resampling.

A candidate's replicates are split into batches of bounded size, every batch a row of its own, so one long
or deep candidate spreads over many tasks. Parametric and importance draws need no more of the codons than how many have
each depth: those of one depth are alike, so the numbers of them with each count are drawn at once. A batch is seeded by the candidate's name, the method and its own
number, never by its partition: repeated or moved tasks draw the same replicates. Batches return sums, which
add up by candidate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept

#: Places of the proposals on the way from host to trans, beside the fitted share and its half. Fixed values.
ETAS = (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
#: Numbers held for one batch.
CELLS = 300_000
STEPS = 45
SUMS = "key string, drawn long, tail long, w double, w2 double, t double, t2 double, top double, usable boolean"


def seeded(seed: int, key: str, method: str, batch: int) -> np.random.Generator:
    """The generator of one batch, the same wherever it runs."""
    digest = hashlib.blake2b(f"{method}\x1f{batch}\x1f{key}".encode(), digest_size=16).digest()
    return np.random.default_rng(np.random.SeedSequence([seed, *np.frombuffer(digest, "<u4").tolist()]))


def draw(rng: np.random.Generator, depth: np.ndarray, pi: np.ndarray, a0: float) -> np.ndarray:
    """Dirichlet-multinomial counts, one replicate for each row of pi: (replicates, codons, 3)."""
    g = rng.standard_gamma(a0 * pi[:, None, :], size=(len(pi), len(depth), 3))
    total = g.sum(axis=2, keepdims=True)
    share = np.where(total > 0, g / np.where(total > 0, total, 1.0), 1 / 3)
    return rng.multinomial(depth[None, :], share)


def rising(a: float, d: int) -> np.ndarray:
    """ln G(a + c) - ln G(a) for c from 0 to d."""
    return np.concatenate([[0.0], np.cumsum(np.log(a + np.arange(d)))])


def drawn_classes(rng: np.random.Generator, depths: list, mixes: np.ndarray, picked: np.ndarray, a0: float) -> np.ndarray:
    """`exceeding` of Dirichlet-multinomial replicates; depths: (depth, codons), mixes[picked]: the replicates' shares.

    Where a depth has fewer triples of counts than codons, a multinomial draw tells how many codons have each triple."""
    top = max(d for d, _ in depths)
    out = np.zeros((len(picked), 3, top), dtype=np.int64)
    for d, m in depths:
        if (d + 1) * (d + 2) // 2 > m:
            n = exceeding(draw(rng, np.full(m, d), mixes[picked], a0))
            out[:, :, : n.shape[2]] += n
            continue
        first, second = (v.ravel() for v in np.meshgrid(np.arange(d + 1), np.arange(d + 1), indexing="ij"))
        c = np.stack([first, second, d - first - second])[:, first + second <= d]
        more = (c[:, :, None] > np.arange(d)).astype(np.float64)  # exact: sums stay far under 2^53
        ways = sum(rising(1.0, d)[x] for x in c)
        for k in np.unique(picked):
            logs = sum(rising(a0 * mixes[k, f], d)[c[f]] for f in range(3)) - ways
            p = np.exp(logs - logs.max())
            rows = np.flatnonzero(picked == k)
            seen = rng.multinomial(m, p / p.sum(), size=len(rows)).astype(np.float64)
            out[rows, :, :d] += np.stack([seen @ more[f] for f in range(3)], axis=1).astype(np.int64)
    return out


def exceeding(counts: np.ndarray) -> np.ndarray:
    """(replicates, 3, k): codons with more than k reads in a phase."""
    reps, _, phases = counts.shape
    width = int(counts.max(initial=0)) + 1
    slot = (np.arange(reps)[:, None, None] * phases + np.arange(phases)) * width + counts
    seen = np.bincount(slot.ravel(), minlength=reps * phases * width).reshape(reps, phases, width)
    return seen[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]


def level(n: np.ndarray, pi: np.ndarray, a0: float) -> np.ndarray:
    """The part of the log-likelihood that depends on pi, by replicate; pi is (3,) or (replicates, 3)."""
    k = np.arange(n.shape[2])
    return (n * np.log(a0 * np.atleast_2d(pi)[:, :, None] + k)).sum(axis=(1, 2))


def ratios(n: np.ndarray, host: np.ndarray, trans: np.ndarray, a0: float) -> np.ndarray:
    """Likelihood-ratio statistics; the likelihood is concave in the share, so its slope is bisected."""
    k, step = np.arange(n.shape[2]), a0 * (trans - host)

    def slope(lam: np.ndarray) -> np.ndarray:
        at = a0 * (host + lam[:, None] * (trans - host))
        return (n * step[None, :, None] / (at[:, :, None] + k)).sum(axis=(1, 2))

    lo, hi = np.zeros(len(n)), np.ones(len(n))
    flat, full = slope(lo) <= 0, slope(hi) >= 0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    lam = np.where(flat, 0.0, np.where(full, 1.0, (lo + hi) / 2))
    return np.maximum(0.0, 2 * (level(n, host + lam[:, None] * (trans - host), a0) - level(n, host, a0)))


def on_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest points of the simplex to the vectors in the last axis."""
    u = -np.sort(-x, axis=-1)
    over = (np.cumsum(u, axis=-1) - 1) / np.arange(1, x.shape[-1] + 1)
    last = (u > over).sum(axis=-1, keepdims=True) - 1
    w = np.maximum(x - np.take_along_axis(over, last, axis=-1), 0)
    return w / w.sum(axis=-1, keepdims=True)


def block_counts(rng: np.random.Generator, place: np.ndarray, counts: np.ndarray, host: np.ndarray, width: int, reps: int) -> np.ndarray | None:
    """Counts around the host template with residuals in runs of neighbouring codons; None with fewer than two runs."""
    depth, m = counts.sum(axis=1), len(counts)
    rest = counts / depth[:, None] - host
    rest -= rest.mean(axis=0)
    first = np.arange(max(0, m - width + 1))
    first = first[place[first + width - 1] - place[first] == width - 1] if len(first) else first
    if len(first) < 2:
        return None
    picked = first[rng.integers(0, len(first), size=(reps, -(-m // width)))]
    rows = (picked[:, :, None] + np.arange(width)).reshape(reps, -1)[:, :m]
    return rng.multinomial(depth[None, :], on_simplex(host + rest[rows]))


def _batch(row, method: str, etas: Sequence[float], width: int, seed: int) -> tuple:
    host, trans = (np.maximum(np.asarray(v, dtype=float), 1e-12) for v in (row.host, row.trans))
    host, trans = host / host.sum(), trans / trans.sum()
    rng, reps, weight = seeded(seed, row.key, method, row.batch), int(row.size), None
    depths = [] if method == "block" else [(int(x["d"]), int(x["m"])) for x in row.depths]
    if method == "block":
        counts = np.array([[c["c0"], c["c1"], c["c2"]] for c in row.codons], dtype=np.int64)
        sim = block_counts(rng, np.array([c["codon"] for c in row.codons]), counts, host, width, reps)
        if sim is None:
            return row.key, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, False
        n = exceeding(sim)
    elif method == "iid":
        n = drawn_classes(rng, depths, host[None, :], np.zeros(reps, dtype=np.int64), row.a0)
    else:
        places = sorted({round(min(1.0, max(0.0, e)), 12) for e in (*etas, 0.0, row.lambda_hat / 2, row.lambda_hat)})
        mixes = np.array([host + e * (trans - host) for e in places])
        n = drawn_classes(rng, depths, mixes, rng.integers(0, len(mixes), reps), row.a0)
        logs = np.array([level(n, mix, row.a0) for mix in mixes])
        peak = logs.max(axis=0)
        weight = np.exp(np.clip(level(n, host, row.a0) - peak - np.log(np.exp(logs - peak).mean(axis=0)), -745, 709))
    hit = ratios(n, host, trans, row.a0) >= row.lrt - 1e-12
    weight = np.ones(reps) if weight is None else weight
    t = weight[hit]
    return row.key, reps, int(hit.sum()), float(weight.sum()), float((weight**2).sum()), float(t.sum()), float((t**2).sum()), float(t.max(initial=0.0)), True


def _batches(frames: Iterator[pd.DataFrame], method: str, etas: Sequence[float], width: int, seed: int) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SUMS.split(", ")]
    for frame in frames:
        for row in frame.itertuples(index=False):
            yield pd.DataFrame([_batch(row, method, etas, width, seed)], columns=names)


def tails(candidates: DataFrame, reps: Column | int, method: str, seed: int = 1, etas: Sequence[float] = ETAS, width: int = 2) -> DataFrame:
    """key and the sums of its replicates. candidates(key string, codons: array of (codon, c0, c1, c2) with reads, in order,
    host, trans: array of 3, a0, lambda_hat, lrt); reps may differ by candidate; method: iid, importance or block."""
    reps = reps if isinstance(reps, Column) else F.lit(reps)
    x = candidates.withColumn("_reps", reps.cast("int")).filter("_reps > 0 and size(codons) > 0").select("key", "codons", "host", "trans", "a0", "lambda_hat", "lrt", "_reps")
    held = "codons"
    work = F.greatest(F.size("codons"), F.array_max(F.transform("codons", lambda c: c["c0"] + c["c1"] + c["c2"])))
    if method != "block":
        held = "depths"
        seen = x.select("key", F.explode(F.transform("codons", lambda c: (c["c0"] + c["c1"] + c["c2"]).cast("long"))).alias("d")).groupBy("key", "d").agg(F.count(F.lit(1)).alias("m"))
        x = x.drop("codons").join(seen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("depths")), "key")
        work = F.expr("greatest(array_max(depths).d, aggregate(depths, 0L, (s, x) -> s + least(x.m, (x.d + 1) * (x.d + 2) div 2)))")
    x = x.withColumn("_most", F.greatest(F.lit(1), F.expr(f"{CELLS} div 3") / work).cast("int"))
    x = x.withColumn("batch", F.explode(F.sequence(F.lit(0), F.expr("(_reps - 1) div _most"))))
    x = x.withColumn("size", F.least(F.col("_most"), F.col("_reps") - F.col("batch") * F.col("_most")))
    x = x.select("key", held, "host", "trans", "a0", "lambda_hat", "lrt", "batch", "size")
    # as many parts as asked for: few bytes are much work here, so small parts must not be put together
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "batch")
    parts = x.mapInPandas(partial(_batches, method=method, etas=tuple(etas), width=width, seed=seed), SUMS)
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("drawn", "tail", "w", "w2", "t", "t2")], F.max("top").alias("top"), F.bool_and("usable").alias("usable"))


def iid_p(candidates: DataFrame, reps: int = 999, seed: int = 1, sampler: Callable = tails) -> DataFrame:
    """key, p_iid, exceedances: (1 + replicates that reach the statistic) / (replicates + 1). sampler: `tails`, or `draws.tails`."""
    return sampler(candidates, reps, "iid", seed).select("key", ((1 + F.col("tail")) / (F.col("drawn") + 1)).alias("p_iid"), F.col("tail").alias("exceedances"))


def block_p(candidates: DataFrame, width: int, reps: int = 999, seed: int = 1, sampler: Callable = tails) -> DataFrame:
    """key, p_block: as `iid_p` with runs of `width` residuals; null where there are fewer than two runs."""
    return sampler(candidates, reps, "block", seed + width, width=width).select("key", F.when(F.col("usable"), (1 + F.col("tail")) / (F.col("drawn") + 1)).alias("p_block"))


def importance_p(candidates: DataFrame, reps: Column | int = 9999, seed: int = 1, etas: Sequence[float] = ETAS, sampler: Callable = tails) -> DataFrame:
    """key, p_importance and its diagnostics. A statistic of 0 has the probability 1 without a draw."""
    drawn = F.when(F.col("lrt") <= 1e-14, 0).otherwise(reps if isinstance(reps, Column) else F.lit(reps))
    x = candidates.select("key", F.col("lrt").alias("_lrt")).join(sampler(candidates, drawn, "importance", seed, etas), "key", "left")
    zero, n = F.col("_lrt") <= 1e-14, F.col("drawn")
    asked = (reps if isinstance(reps, Column) else F.lit(reps)).cast("double")
    x = x if not isinstance(reps, Column) else x.join(candidates.select("key", asked.alias("_asked")), "key")
    asked = asked if not isinstance(reps, Column) else F.col("_asked")
    mean = F.col("t") / n
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("t2") - n * mean * mean) / F.nullif(n - 1, F.lit(0)) / n)
    ess = F.coalesce(F.try_divide(F.col("t") * F.col("t"), F.col("t2")), F.lit(0.0))
    return x.select(
        "key", F.when(zero, 1.0).when(F.col("tail") > 0, F.least(F.lit(1.0), mean)).alias("p_importance"), F.when(zero, 0.0).otherwise(error).alias("se"), F.when(zero, 0.0).otherwise(F.try_divide(error, mean)).alias("relative_se"),
        F.coalesce(n, F.lit(0)).alias("reps_used"), F.when(zero, asked).otherwise(ess).alias("tail_ess"), F.when(zero, 1.0).otherwise(F.col("w") / n).alias("weight_mean"), F.when(zero, 1 / asked).otherwise(F.try_divide("top", "t")).alias("max_tail_weight"),
    )


def planned(pilot: DataFrame, drawn: int, most: int, least: int = 999, safety: float = 1.25, ess: float = 30.0, relative_se: float = 0.25) -> DataFrame:
    """key, planned: the size of a sample of its own, from the pilot's precision; `most` where the pilot tells nothing."""
    by_error = F.ceil(drawn * safety * (F.col("relative_se") / relative_se) ** 2)
    by_ess = F.ceil(drawn * safety * ess / F.col("tail_ess"))
    known = (F.col("relative_se") > 0) & (F.col("tail_ess") > 0)
    return pilot.select("key", F.when(known, F.least(F.lit(most).cast("long"), F.greatest(F.lit(least).cast("long"), by_error, by_ess))).otherwise(F.lit(most)).alias("planned"))


def status(ess: float = 30.0, relative_se: float = 0.25) -> Column:
    """pass, or the first reason against an importance estimate."""
    mean = F.col("weight_mean")
    return (
        F.when(F.col("p_importance").isNull() | (F.col("p_importance") <= 0), "failed_no_weighted_tail").when(mean.isNull() | ~mean.between(0.5, 1.5), "failed_weight_mean")
        .when(F.col("tail_ess") < ess, "failed_low_tail_ess").when(F.col("relative_se").isNull() | (F.col("relative_se") > relative_se), "failed_high_relative_se").otherwise("pass")
    )


def policy(engine: str, mode: str = "accurate") -> tuple[str, str, bool]:
    """(when importance runs, its mode, whether it may set the final p) of an engine's name."""
    known = {
        "adaptive_importance": ("adaptive", mode, True),
        "adaptive_importance_trial": ("adaptive", "accurate", False),
        "adaptive_two_stage_importance_trial": ("adaptive", "fast", False),
        "iid_plus_importance_trial": ("always", "accurate", False),
        "iid": ("none", "not_run", False),
    }
    if engine not in known:
        raise ValueError(f"unknown engine: {engine}")
    return known[engine]


def final_p(
    candidates: DataFrame, engine: str = "adaptive_importance", mode: str = "accurate", reps: int = 999, importance_reps: int = 9999, pilot_reps: int = 999, gate: float = 0.20, few: int = 10, blocks: Sequence[int] = (),
    lag: float = 0.30, least_active: int = 15, seed: int = 1, sampler: Callable = tails,
) -> DataFrame:
    """candidates as in `tails`, with p_asym, and lag1 where blocks are asked for: key, p_iid, exceedances, importance
    columns, p_block<width>, p_final and the class before multiple testing. Candidates at or over the gate keep p_final 1."""
    when, how, may_set = policy(engine, mode)
    tested = candidates.filter(F.col("p_asym") < gate)
    first = kept(iid_p(tested, reps, seed, sampler))
    out = candidates.select("key", "p_asym", *(["lag1"] if blocks else [])).join(first, "key", "left")
    if when != "none":
        some = tested if when == "always" else tested.join(first.filter(F.col("exceedances") < few), "key", "left_semi")
        size: Column | int = importance_reps
        if how == "fast":
            plan = kept(planned(importance_p(some, pilot_reps, seed + 1, sampler=sampler), pilot_reps, importance_reps))
            some, size = some.join(plan, "key"), F.col("planned")
        found = importance_p(some, size, seed + 2, sampler=sampler).withColumn("importance_status", status())
        out = out.join(found, "key", "left")
        use = (F.col("importance_status") == "pass") & F.lit(may_set)
        out = out.withColumn("importance_status", F.coalesce("importance_status", F.when(F.col("p_iid").isNotNull(), "not_needed_iid_tail_resolved").otherwise("not_run")))
        main = F.when(use, F.col("p_importance")).otherwise(F.col("p_iid"))
    else:
        main = F.col("p_iid")
    ps = [main]
    for width in blocks:
        lagged = tested.filter((F.col("lag1") > lag) & (F.size("codons") >= least_active))
        out = out.join(block_p(lagged, width, reps, seed, sampler).withColumnRenamed("p_block", f"p_block{width}"), "key", "left")
        ps.append(F.col(f"p_block{width}"))
    robust = F.greatest(*ps) if len(ps) > 1 else main
    label = F.when(F.col("p_iid").isNull(), "host_only_supported").otherwise("tested")
    return out.withColumn("p_final", F.when(F.col("p_iid").isNull(), 1.0).otherwise(robust)).withColumn("classification_pre_fdr", label)
