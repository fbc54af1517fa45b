"""Queries of resampling by counters: every number that is drawn is drawn again by the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.lineage import kept
from codonlake.functions.sqlx import rounded
from codonlake.operators import counters, resample
from codonlake.plans.inference import A0, CAND_SQL, candidate_rows

#: Templates near what the adapter's candidates hold, so that tails are neither empty nor whole.
HOST, TRANS = (0.30, 0.32, 0.38), (0.42, 0.29, 0.29)
REPS, IMPORTANCE, PILOT, LEAST, MOST, WIDTH = 199, 299, 99, 149, 399, 2


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(candidate_rows(spark, sf_dir, HOST, TRANS))


def dm_iid_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.iid_p(_rows(spark, sf_dir), REPS, sampler=counters.tails)
    return out.select(F.col("key").cast("long").alias("orf"), rounded(F.col("p_iid")).alias("p_iid"), "exceedances")


def dm_block_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.block_p(_rows(spark, sf_dir), WIDTH, REPS, sampler=counters.tails)
    return out.select(F.col("key").cast("long").alias("orf"), rounded(F.col("p_block")).alias("p_block"))


def _told(found: DataFrame) -> DataFrame:
    out = found.withColumn("status", resample.status())
    return out.select(F.col("key").cast("long").alias("orf"), *[rounded(F.col(c)).alias(c) for c in ("p_importance", "se", "relative_se", "tail_ess", "weight_mean", "max_tail_weight")], F.col("reps_used").cast("long").alias("reps_used"), "status")


def dm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(resample.importance_p(_rows(spark, sf_dir), IMPORTANCE, sampler=counters.tails))


def dm_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pilot tells the size of a sample of its own, which alone gives the estimate."""
    rows = _rows(spark, sf_dir)
    plan = kept(resample.planned(resample.importance_p(rows, PILOT, 2, sampler=counters.tails), PILOT, MOST, LEAST))
    return _told(resample.importance_p(rows.join(plan, "key"), F.col("planned"), 3, sampler=counters.tails))


QUERIES = {f.__name__: f for f in (dm_iid_draws, dm_block_draws, dm_importance, dm_two_stage)}


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _hash(numbers: str) -> str:
    first = f"list_transform({numbers}, lambda x: (xor(x & 4294967295, (x & 4294967295) >> 15) * 739982445) & 4294967295)"
    second = f"list_transform({first}, lambda x: (xor(x, x >> 12) * 695872825) & 4294967295)"
    return f"list_transform({second}, lambda x: xor(x, x >> 15))"


def _uniform(seed: str, n: str) -> str:
    return f"list_transform({_hash(f'list_transform(range(0, {n}), lambda j: {seed} + j * 3266489917)')}, lambda x: (x + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def _slope(at: str) -> str:
    return f"coalesce(list_sum(list_transform(terms, lambda t: t.n * t.d / (t.h + ({at}) * t.d + t.k))), 0)"


def _value(at: str) -> str:
    return f"coalesce(list_sum(list_transform(terms, lambda t: t.n * ln(t.h + ({at}) * t.d + t.k))), 0)"


def _terms(counts: str) -> str:
    one = lambda f: (
        f"list_transform(range(0, list_max(list_transform({counts}, lambda c: c.c{f}))), lambda k: {{'k': k::DOUBLE, 'n': len(list_filter({counts}, lambda c: c.c{f} > k))::DOUBLE, 'h': {_d(A0)} * {_d(HOST[f])}, 'd': {_d(A0)} * ({_d(TRANS[f])} - {_d(HOST[f])})}})"
    )
    return f"list_concat(list_concat({one(0)}, {one(1)}), {one(2)})"


def _fit(name: str, source: str, columns: str) -> str:
    """CTEs with the share and the ratio of the rows' terms."""
    climbed = f"list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, 46), lambda i: power(0.5::DOUBLE, i))), lambda lo, w: lo + CASE WHEN {_slope('lo + w')} > 0 THEN w ELSE 0 END) + power(0.5::DOUBLE, 46)"
    return f"""{name}_share AS MATERIALIZED (SELECT {columns}, terms, CASE WHEN {_slope('0::DOUBLE')} <= 0 THEN 0::DOUBLE WHEN {_slope('1::DOUBLE')} >= 0 THEN 1::DOUBLE ELSE {climbed} END AS share FROM {source}),
{name} AS MATERIALIZED (SELECT *, greatest(0::DOUBLE, 2 * ({_value('share')} - {_value('0::DOUBLE')})) AS ratio FROM {name}_share)"""


_OBSERVED = f"""{CAND_SQL},
held AS MATERIALIZED (SELECT orf, list({{'codon': codon, 'c0': c0, 'c1': c1, 'c2': c2}} ORDER BY codon) AS codons FROM cand GROUP BY orf),
seen AS MATERIALIZED (SELECT orf, codons, list_transform(codons, lambda c: c.c0 + c.c1 + c.c2) AS depths, {_terms('codons')} AS terms FROM held),
{_fit('fit', 'seen', 'orf, codons, depths')}"""


def _own(method: str, number: int, reps: str, source: str = "fit", more: str = "") -> str:
    return f"""own AS MATERIALIZED (SELECT orf, codons, depths, share AS lam, ratio AS lrt{more}, {_hash(f"[('0x' || substr(md5('{method}|{number}|' || orf), 1, 7))::BIGINT + rep * 2654435761]")}[1] AS own FROM (SELECT *, unnest(range(0, {reps})) AS rep FROM {source})),
seeded AS MATERIALIZED (SELECT *, {_hash('list_transform(range(1, len(depths) + 1), lambda i: own + i * 2246822519)')} AS seeds FROM own)"""


def _urn(us: str, pi: list[str]) -> str:
    at = f"x.u * ({_d(A0)} + s.c0 + s.c1 + s.c2)"
    low, mid = f"{_d(A0)} * {pi[0]} + s.c0", f"{_d(A0)} * {pi[0]} + s.c0 + {_d(A0)} * {pi[1]} + s.c1"
    step = f"{{'c0': s.c0 + CASE WHEN {at} < {low} THEN 1 ELSE 0 END, 'c1': s.c1 + CASE WHEN {at} >= {low} AND {at} < {mid} THEN 1 ELSE 0 END, 'c2': s.c2 + CASE WHEN {at} >= {low} AND {at} >= {mid} THEN 1 ELSE 0 END, 'u': 0::DOUBLE}}"
    zero = "{'c0': 0, 'c1': 0, 'c2': 0, 'u': %s}"
    return f"list_reduce(list_prepend({zero % '0::DOUBLE'}, list_transform({us}, lambda u: {zero % 'u'})), lambda s, x: {step})"


_IID = f"""WITH {_OBSERVED}, {_own('iid', 1, str(REPS))},
drawn AS MATERIALIZED (SELECT orf, lrt, list_transform(range(1, len(depths) + 1), lambda i: {_urn(_uniform('seeds[i]', 'depths[i]'), [_d(x) for x in HOST])}) AS counts FROM seeded),
termed AS MATERIALIZED (SELECT orf, lrt, {_terms('counts')} AS terms FROM drawn), {_fit('sim', 'termed', 'orf, lrt')}
SELECT orf, round((1 + count(*) FILTER (ratio >= lrt - 1e-12::DOUBLE)) / ({REPS}::DOUBLE + 1), 6) AS p_iid, count(*) FILTER (ratio >= lrt - 1e-12::DOUBLE) AS exceedances FROM sim GROUP BY orf"""

_PART = "list_transform(codons, lambda c: c.c{f} / (c.c0 + c.c1 + c.c2)::DOUBLE - {h})"
_BLOCK = f"""WITH {_OBSERVED},
rest AS MATERIALIZED (SELECT *, {', '.join(f"{_PART.format(f=f, h=_d(HOST[f]))} AS r{f}" for f in range(3))}, list_filter(range(0, len(codons) - {WIDTH - 1}), lambda i: codons[i + {WIDTH}].codon - codons[i + 1].codon = {WIDTH - 1}) AS first FROM fit),
moved AS MATERIALIZED (SELECT *, {', '.join(f"list_transform(r{f}, lambda r: {_d(HOST[f])} + (r - list_sum(r{f}) / len(r{f}))) AS x{f}" for f in range(3))} FROM rest),
flat AS (SELECT orf, unnest(range(1, len(x0) + 1)) AS i, unnest(x0) AS x0, unnest(x1) AS x1, unnest(x2) AS x2 FROM moved),
over AS (SELECT *, x0 + x1 + x2 AS s, greatest(x0, x1, x2) AS hi, least(x0, x1, x2) AS lo FROM flat),
cut AS (SELECT *, CASE WHEN lo > (s - 1) / 3 THEN (s - 1) / 3 WHEN s - lo - hi > (s - lo - 1) / 2 THEN (s - lo - 1) / 2 ELSE hi - 1 END AS o FROM over),
part AS (SELECT orf, i, greatest(x0 - o, 0::DOUBLE) AS p0, greatest(x1 - o, 0::DOUBLE) AS p1, greatest(x2 - o, 0::DOUBLE) AS p2 FROM cut),
points AS MATERIALIZED (SELECT orf, list({{'p0': p0 / (p0 + p1 + p2), 'p1': p1 / (p0 + p1 + p2)}} ORDER BY i) AS points FROM part GROUP BY orf),
usable AS MATERIALIZED (SELECT orf, codons, depths, share, ratio, first, points FROM moved JOIN points USING (orf) WHERE len(first) >= 2),
{_own('block', 1 + WIDTH, str(REPS), 'usable', ', first, points')},
picked AS MATERIALIZED (SELECT *, list_transform({_uniform('own', f'CAST(ceil(len(depths) / {WIDTH}::DOUBLE) AS BIGINT)')}, lambda u: first[CAST(floor(u * len(first)) AS BIGINT) + 1]) AS picks FROM seeded),
drawn AS MATERIALIZED (SELECT orf, lrt, list_transform(range(1, len(depths) + 1), lambda i: list_transform([[points[picks[(i - 1) // {WIDTH} + 1] + (i - 1) % {WIDTH} + 1].p0, points[picks[(i - 1) // {WIDTH} + 1] + (i - 1) % {WIDTH} + 1].p1]], lambda p:
  list_transform([{_uniform('seeds[i]', 'depths[i]')}], lambda us: {{'c0': len(list_filter(us, lambda u: u < p[1])), 'c1': len(list_filter(us, lambda u: u >= p[1] AND u < p[1] + p[2])), 'c2': len(list_filter(us, lambda u: u >= p[1] AND u >= p[1] + p[2]))}})[1])[1]) AS counts FROM picked),
termed AS MATERIALIZED (SELECT orf, lrt, {_terms('counts')} AS terms FROM drawn), {_fit('sim', 'termed', 'orf, lrt')},
tail AS (SELECT orf, count(*) FILTER (ratio >= lrt - 1e-12::DOUBLE) AS n FROM sim GROUP BY orf)
SELECT orf, CASE WHEN n IS NOT NULL THEN round((1 + n) / ({REPS}::DOUBLE + 1), 6) END AS p_block FROM fit LEFT JOIN tail USING (orf)"""


def _sampled(name: str, number: int, reps: str, source: str) -> str:
    """CTEs of one importance sample: name has orf, asked, and sums of its replicates."""
    etas = ", ".join(_d(float(e)) for e in (*resample.ETAS, 0.0))
    renamed = _own("importance", number, reps, f"{name}_from").replace("own AS MAT", f"{name}_own AS MAT").replace("FROM own)", f"FROM {name}_own)").replace("seeded AS MAT", f"{name}_seeded AS MAT")
    renamed = renamed.replace("AS lrt,", "AS lrt, places, asked,")
    mix = [f"({_d(HOST[f])} + place * ({_d(TRANS[f])} - {_d(HOST[f])}))" for f in range(3)]
    return f"""{name}_from AS MATERIALIZED (SELECT *, {reps} AS asked, list_sort(list_distinct(list_transform([{etas}, share / 2, share], lambda e: round(least(1::DOUBLE, greatest(0::DOUBLE, e)), 12)))) AS places FROM {source} WHERE ratio > 1e-14),
{renamed},
{name}_placed AS MATERIALIZED (SELECT *, places[CAST(floor({_uniform('own', '1')}[1] * len(places)) AS BIGINT) + 1] AS place FROM {name}_seeded),
{name}_drawn AS MATERIALIZED (SELECT orf, lrt, places, asked, list_transform(range(1, len(depths) + 1), lambda i: {_urn(_uniform('seeds[i]', 'depths[i]'), mix)}) AS counts FROM {name}_placed),
{name}_termed AS MATERIALIZED (SELECT orf, lrt, places, asked, {_terms('counts')} AS terms FROM {name}_drawn), {_fit(f'{name}_sim', f'{name}_termed', 'orf, lrt, places, asked')},
{name}_logs AS MATERIALIZED (SELECT *, list_transform(places, lambda e: {_value('e')}) AS logs, {_value('0::DOUBLE')} AS base FROM {name}_sim),
{name}_weighed AS (SELECT orf, asked, ratio >= lrt - 1e-12::DOUBLE AS hit, exp(base - list_max(logs) - ln(list_sum(list_transform(logs, lambda l: exp(l - list_max(logs)))) / len(logs))) AS w FROM {name}_logs),
{name} AS MATERIALIZED (SELECT orf, any_value(asked) AS asked, count(*)::DOUBLE AS n, count(*) FILTER (hit) AS tail, sum(w) AS w, coalesce(sum(w) FILTER (hit), 0) AS t, coalesce(sum(w * w) FILTER (hit), 0) AS t2, coalesce(max(w) FILTER (hit), 0) AS top FROM {name}_weighed GROUP BY orf),
{name}_est AS MATERIALIZED (SELECT *, t / n AS mean, sqrt(greatest(0::DOUBLE, t2 - n * (t / n) * (t / n)) / (n - 1) / n) AS se, CASE WHEN t2 > 0 THEN t * t / t2 ELSE 0 END AS ess FROM {name})"""


def _said(name: str, asked: str) -> str:
    return f"""told AS (SELECT fit.orf, ratio <= 1e-14 AS zero, {asked}::DOUBLE AS asked, e.* EXCLUDE (orf, asked) FROM fit LEFT JOIN {name}_est e ON e.orf = fit.orf{' LEFT JOIN plan ON plan.orf = fit.orf' if 'planned' in asked else ''}),
said AS (SELECT orf, CASE WHEN zero THEN 1::DOUBLE WHEN tail > 0 THEN least(1::DOUBLE, mean) END AS p_importance, CASE WHEN zero THEN 0::DOUBLE ELSE se END AS se, CASE WHEN zero THEN 0::DOUBLE WHEN mean > 0 THEN se / mean END AS relative_se,
  CASE WHEN zero THEN asked ELSE ess END AS tail_ess, CASE WHEN zero THEN 1::DOUBLE ELSE w / n END AS weight_mean, CASE WHEN zero THEN 1 / asked WHEN t > 0 THEN top / t END AS max_tail_weight, CAST(coalesce(n, 0) AS BIGINT) AS reps_used FROM told)"""


_FINISH = """SELECT orf, round(p_importance, 6) AS p_importance, round(se, 6) AS se, round(relative_se, 6) AS relative_se, round(tail_ess, 6) AS tail_ess, round(weight_mean, 6) AS weight_mean, round(max_tail_weight, 6) AS max_tail_weight, reps_used,
  CASE WHEN p_importance IS NULL OR p_importance <= 0 THEN 'failed_no_weighted_tail' WHEN weight_mean IS NULL OR weight_mean < 0.5 OR weight_mean > 1.5 THEN 'failed_weight_mean' WHEN tail_ess < 30 THEN 'failed_low_tail_ess'
       WHEN relative_se IS NULL OR relative_se > 0.25 THEN 'failed_high_relative_se' ELSE 'pass' END AS status FROM said"""
_IMPORTANCE = f"WITH {_OBSERVED}, {_sampled('one', 1, str(IMPORTANCE), 'fit')}, {_said('one', str(IMPORTANCE))} {_FINISH}"
_TWO = f"""WITH {_OBSERVED}, {_sampled('pilot', 2, str(PILOT), 'fit')},
plan AS MATERIALIZED (SELECT fit.orf, CASE WHEN se / mean > 0 AND ess > 0 AND NOT ratio <= 1e-14
  THEN least({MOST}, greatest({LEAST}, CAST(ceil({PILOT} * 1.25::DOUBLE * power(se / mean / 0.25::DOUBLE, 2)) AS BIGINT), CAST(ceil({PILOT} * 1.25::DOUBLE * 30::DOUBLE / ess) AS BIGINT))) ELSE {MOST} END AS planned FROM fit LEFT JOIN pilot_est e ON e.orf = fit.orf),
ready AS MATERIALIZED (SELECT fit.*, planned FROM fit JOIN plan USING (orf)), {_sampled('two', 3, 'planned', 'ready')}, {_said('two', 'plan.planned')} {_FINISH}"""
ORACLES = {"dm_iid_draws": _IID, "dm_block_draws": _BLOCK, "dm_importance": _IMPORTANCE, "dm_two_stage": _TWO}
