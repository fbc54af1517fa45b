"""Resampling in column expressions alone: draws that any SQL engine repeats, from counters instead of a generator.

A candidate's seed comes from its name. Hashing it with the numbers of the replicate, the codon and the read gives 32 bits
for every read, whatever runs it. Dirichlet-multinomial counts need nothing but such uniform numbers: reads go into a Pólya
urn, where a phase is drawn in proportion to its prior weight and the reads it has. One row is one replicate of one
candidate; counts, the fitted share, the ratio and the weights are arrays and numbers of that row, so nothing is shuffled but
candidates before they are repeated and sums afterwards.

`tails` gives what `resample.tails` does, so `resample.final_p` works with either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.operators.resample import ETAS

#: 32 bits, odd steps of the counters, and factors of the hash.
BITS, STEP_REP, STEP_CODON, STEP_READ = 4294967295, 2654435761, 2246822519, 3266489917
FACTORS = (739982445, 695872825)
#: Replicates of one candidate in a row before they are dealt out.
BATCH, HALVINGS = 256, 45


def let(name: str, value: str, body: str) -> str:
    """SQL: body with a value that is worked out once. The optimizer would write out a column again wherever it is read, also inside functions of arrays."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hashed(numbers: str) -> str:
    """SQL: every number of an array, its 32 bits mixed."""
    first = f"transform({numbers}, x -> (((x & {BITS}) ^ shiftright(x & {BITS}, 15)) * {FACTORS[0]}L) & {BITS})"
    second = f"transform({first}, x -> ((x ^ shiftright(x, 12)) * {FACTORS[1]}L) & {BITS})"
    return f"transform({second}, x -> x ^ shiftright(x, 15))"


def seed(key: str, method: str, number: int) -> str:
    """SQL: 28 bits from a candidate's name."""
    return f"cast(conv(substr(md5(concat('{method}|{number}|', {key})), 1, 7), 16, 10) as bigint)"


def uniform(seeds: str, n: str) -> str:
    """SQL: n numbers in (0, 1) from a seed."""
    return f"transform({hashed(f'transform(sequence(0L, {n} - 1), j -> {seeds} + j * {STEP_READ})')}, x -> (x + 0.5D) / 4294967296D)"


def urn(us: str, a0: str, pi: str) -> str:
    """SQL: counts of the phases, for uniform numbers one read at a time."""
    at = "u * (a + s.c0 + s.c1 + s.c2)".replace("a +", f"{a0} +")
    low, mid = f"{a0} * {pi}[0] + s.c0", f"{a0} * {pi}[0] + s.c0 + {a0} * {pi}[1] + s.c1"
    add = f"named_struct('c0', s.c0 + cast({at} < {low} as int), 'c1', s.c1 + cast({at} >= {low} and {at} < {mid} as int), 'c2', s.c2 + cast({at} >= {low} and {at} >= {mid} as int))"
    return f"aggregate({us}, named_struct('c0', 0, 'c1', 0, 'c2', 0), (s, u) -> {add})"


def shares(us: str, p: str) -> str:
    """SQL: counts of the phases, for uniform numbers and fixed shares."""
    low, mid = f"{p}.p0", f"{p}.p0 + {p}.p1"
    return f"named_struct('c0', size(filter({us}, u -> u < {low})), 'c1', size(filter({us}, u -> u >= {low} and u < {mid})), 'c2', size(filter({us}, u -> u >= {low} and u >= {mid})))"


def _terms(counts: str) -> str:
    """SQL: (k, n: codons with more than k reads in a phase, the phase's weight under the host and its change to trans)."""
    one = lambda f: (
        f"transform(sequence(0, array_max(transform({counts}, c -> c.c{f})) - 1), k -> named_struct('f', {f}, 'k', cast(k as double), 'n', cast(size(filter({counts}, c -> c.c{f} > k)) as double), "
        f"'h', a0 * host[{f}], 'd', a0 * (trans[{f}] - host[{f}])))"
    )
    some = lambda f: f"if(array_max(transform({counts}, c -> c.c{f})) > 0, {one(f)}, array())"
    return f"concat({some(0)}, {some(1)}, {some(2)})"


def _slope(at: str) -> str:
    return f"aggregate(terms, 0D, (s, t) -> s + t.n * t.d / (t.h + ({at}) * t.d + t.k))"


def _value(at: str) -> str:
    return f"aggregate(terms, 0D, (s, t) -> s + t.n * ln(t.h + ({at}) * t.d + t.k))"


def _ratio(body: str) -> str:
    """SQL: body over `ratio`, the likelihood-ratio statistic of the terms. The slope falls, so halving finds its zero."""
    climbed = f"aggregate(steps, 0D, (lo, w) -> lo + if({_slope('lo + w')} > 0, w, 0D)) + {0.5 ** (HALVINGS + 1)!r}D"
    share = f"case when {_slope('0D')} <= 0 then 0D when {_slope('1D')} >= 0 then 1D else {climbed} end"
    return let("share", share, let("ratio", f"greatest(0D, 2 * ({_value('share')} - {_value('0D')}))", body))


def _simplex(x: str) -> str:
    """SQL: the nearest point of the simplex to x.p0, x.p1, x.p2."""
    top, low = f"greatest({x}.p0, {x}.p1, {x}.p2)", f"least({x}.p0, {x}.p1, {x}.p2)"
    total = f"({x}.p0 + {x}.p1 + {x}.p2)"
    third, second, first = f"(({total} - 1) / 3)", f"(({total} - {low} - 1) / 2)", f"({top} - 1)"
    middle = f"({total} - {low} - {top})"
    over = f"(case when {low} > {third} then {third} when {middle} > {second} then {second} else {first} end)"
    part = lambda f: f"greatest({x}.p{f} - {over}, 0D)"
    return f"named_struct('p0', {part(0)}, 'p1', {part(1)}, 'p2', {part(2)})"


def _blocks(x: DataFrame, width: int) -> DataFrame:
    """Adds `points`: the template with each codon's residuals, on the simplex; and `first`: where runs of neighbouring codons begin."""
    n = "(c.c0 + c.c1 + c.c2)"
    rest = ", ".join(f"'p{f}', c.c{f} / {n} - host[{f}]" for f in range(3))
    x = x.withColumn("rest", F.expr(f"transform(codons, c -> named_struct({rest}))"))
    mean = ", ".join(f"'p{f}', aggregate(rest, 0D, (s, r) -> s + r.p{f}) / size(rest)" for f in range(3))
    x = x.withColumn("mean", F.expr(f"named_struct({mean})"))
    moved = ", ".join(f"'p{f}', host[{f}] + (r.p{f} - mean.p{f})" for f in range(3))
    x = x.withColumn("points", F.expr(f"transform(transform(rest, r -> named_struct({moved})), x -> {_simplex('x')})"))
    x = x.withColumn("points", F.expr("transform(points, x -> named_struct('p0', x.p0 / (x.p0 + x.p1 + x.p2), 'p1', x.p1 / (x.p0 + x.p1 + x.p2), 'p2', x.p2 / (x.p0 + x.p1 + x.p2)))"))
    first = f"filter(sequence(0, size(codons) - {width}), i -> codons[i + {width - 1}].codon - codons[i].codon = {width - 1})"
    return x.withColumn("first", F.expr(f"if(size(codons) >= {width}, {first}, array())")).drop("rest", "mean")


def places(etas: Sequence[float]) -> Column:
    """The proposals' places between host and trans, in order."""
    listed = ", ".join(f"{float(e)!r}D" for e in (*etas, 0.0))
    return F.expr(f"array_sort(array_distinct(transform(array({listed}, lambda_hat / 2, lambda_hat), e -> round(least(1D, greatest(0D, e)), 12))))")


def tails(candidates: DataFrame, reps: Column | int, method: str, seed_number: int = 1, etas: Sequence[float] = ETAS, width: int = 2) -> DataFrame:
    """key and the sums of its replicates, as `resample.tails`."""
    reps = reps if isinstance(reps, Column) else F.lit(reps)
    unit = lambda c: F.expr(f"transform({c}, x -> greatest(cast(x as double), 1e-12D) / aggregate({c}, 0D, (s, y) -> s + greatest(cast(y as double), 1e-12D)))")
    x = candidates.select("key", "codons", "host", "trans", F.col("a0").cast("double").alias("a0"), "lambda_hat", "lrt", reps.cast("long").alias("reps")).filter("reps > 0 and size(codons) > 0")
    x = x.withColumn("host", unit("host")).withColumn("trans", unit("trans")).withColumn("seed", F.expr(seed("key", method, seed_number)))
    x = x.withColumn("depths", F.expr("transform(codons, c -> cast(c.c0 + c.c1 + c.c2 as long))"))
    if method == "block":
        x = _blocks(x, width)
        unusable = x.filter("size(first) < 2").select("key", *[F.lit(0).cast("long").alias(c) for c in ("drawn", "tail")], *[F.lit(0.0).alias(c) for c in ("w", "w2", "t", "t2", "top")], F.lit(False).alias("usable"))
        x = x.filter("size(first) >= 2")
    if method == "importance":
        x = x.withColumn("places", places(etas))
    # as many parts as asked for: few bytes are much work here, so small parts must not be put together
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.drop("codons", "lambda_hat").withColumn("batch", F.explode(F.expr(f"sequence(0L, (reps - 1) div {BATCH})"))).repartition(parts, "key", "batch")
    x = x.withColumn("rep", F.explode(F.expr(f"sequence(batch * {BATCH}, least(reps, (batch + 1) * {BATCH}) - 1)"))).drop("batch", "reps")
    x = x.withColumn("steps", F.array(*[F.lit(0.5**k) for k in range(1, HALVINGS + 1)]))
    weight = "1D"
    if method == "importance":
        weight = let("logs", f"transform(places, e -> {_value('e')})", let("top_log", "array_max(logs)", f"exp({_value('0D')} - top_log - ln(aggregate(logs, 0D, (s, l) -> s + exp(l - top_log)) / size(logs)))"))
    done = let("terms", _terms("counts"), _ratio(f"named_struct('hit', ratio >= lrt - 1e-12D, 'weight', {weight})"))
    if method == "block":
        one = let("p", f"points[picks[i div {width}] + i % {width}]", let("us", uniform("seeds[i]", "n"), shares("us", "p")))
        picks = f"transform({uniform('own', f'cast(ceil(size(depths) / {width}) as long)')}, u -> first[cast(u * size(first) as int)])"
        done = let("picks", picks, let("counts", f"transform(depths, (n, i) -> {one})", done))
    else:
        pi = "pi" if method == "importance" else "host"
        done = let("counts", f"transform(depths, (n, i) -> {urn(uniform('seeds[i]', 'n'), 'a0', pi)})", done)
    done = let("seeds", hashed(f"transform(sequence(1L, cast(size(depths) as long)), i -> own + i * {STEP_CODON})"), done)
    if method == "importance":  # the place by the first number; codons are counted from 1
        done = let("place", f"places[cast({uniform('own', '1L')}[0] * size(places) as int)]", let("pi", "transform(sequence(0, 2), f -> host[f] + place * (trans[f] - host[f]))", done))
    done = let("own", f"{hashed(f'array(seed + rep * {STEP_REP})')}[0]", done)
    x = x.select("key", F.expr(done).alias("r")).select("key", "r.hit", "r.weight")
    t = F.when(F.col("hit"), F.col("weight")).otherwise(0.0)
    out = x.groupBy("key").agg(
        F.count(F.lit(1)).alias("drawn"), F.count_if("hit").alias("tail"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.sum(t).alias("t"), F.sum(t * t).alias("t2"), F.max(t).alias("top"), F.lit(True).alias("usable")
    )
    return out if method != "block" else out.unionByName(unusable)
