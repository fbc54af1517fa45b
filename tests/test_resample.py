"""Resampling, concentration and trimming against plain versions."""

import math

import numpy as np
import pytest
from codonlake.operators import dm, draws, metagene, resample
from pyspark.sql import functions as F

HOST, TRANS, A0 = (0.1, 0.2, 0.7), (0.8, 0.1, 0.1), 20.0


def plain_value(codons, pi, a0):
    total = 0.0
    for c in codons:
        total += math.lgamma(a0) - math.lgamma(a0 + sum(c)) + sum(math.lgamma(x + a0 * p) - math.lgamma(a0 * p) for x, p in zip(c, pi, strict=True))
    return total


def plain_ratio(codons):
    mix = lambda lam: [h + lam * (t - h) for h, t in zip(HOST, TRANS, strict=True)]
    return max(0.0, 2 * (max(plain_value(codons, mix(k / 400), A0) for k in range(401)) - plain_value(codons, HOST, A0)))


@pytest.fixture(scope="module")
def candidates(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, lam in (("a", 0.0), ("b", 0.25), ("c", 0.9)):
        pi = [h + lam * (t - h) for h, t in zip(HOST, TRANS, strict=True)]
        for k in range(18):
            c = rng.multinomial(6, rng.dirichlet(A0 * np.array(pi)))
            rows.append((key, k, *map(int, c)))
    x = spark.createDataFrame(rows, "orf string, codon long, c0 long, c1 long, c2 long")
    fit = dm.fit_lambda(x, HOST, TRANS, A0)
    held = x.groupBy("orf").agg(F.sort_array(F.collect_list(F.struct("codon", "c0", "c1", "c2"))).alias("codons"))
    arr = lambda v: F.array(*[F.lit(p) for p in v])
    out = fit.join(held, "orf").select(F.col("orf").alias("key"), "codons", arr(HOST).alias("host"), arr(TRANS).alias("trans"), F.lit(A0).alias("a0"), "lambda_hat", "lrt", "p_asym", F.lit(0.5).alias("lag1"))
    return spark.createDataFrame(out.collect(), out.schema)


def test_statistics_equal_the_plain_ones():
    rng = np.random.default_rng(5)
    sim = resample.draw(rng, np.array([5, 9, 1, 12]), np.tile(HOST, (20, 1)), A0)
    assert (sim.sum(axis=2) == [5, 9, 1, 12]).all()
    got = resample.ratios(resample.exceeding(sim), np.array(HOST), np.array(TRANS), A0)
    want = [plain_ratio(s.tolist()) for s in sim]
    assert np.allclose(got, want, atol=2e-3) and (np.abs(got) >= 0).all()


def test_simplex_projection():
    got = resample.on_simplex(np.array([[0.2, 0.3, 0.5], [1.5, 0.0, 0.0], [-1.0, 0.4, 0.8]]))
    assert np.allclose(got, [[0.2, 0.3, 0.5], [1, 0, 0], [0, 0.3, 0.7]])


def test_iid_equals_a_plain_bootstrap_and_ignores_partitions(candidates):
    got = {r.key: r.p_iid for r in resample.iid_p(candidates, 999).collect()}
    again = {r.key: r.p_iid for r in resample.iid_p(candidates.repartition(7), 999).collect()}
    assert got == again
    rng = np.random.default_rng(11)
    for r in candidates.collect():
        depth = [c.c0 + c.c1 + c.c2 for c in r.codons]
        sims = [[rng.multinomial(n, rng.dirichlet(A0 * np.array(HOST))).tolist() for n in depth] for _ in range(120)]
        p = (1 + sum(plain_ratio(s) >= r.lrt - 1e-3 for s in sims)) / 121
        assert abs(got[r.key] - p) < 4 * math.sqrt(max(p * (1 - p), 0.01) / 120)


def test_importance_agrees_with_iid_and_reaches_further(candidates):
    iid = {r.key: r.p_iid for r in resample.iid_p(candidates, 4000, seed=9).collect()}
    got = {r.key: r for r in resample.importance_p(candidates, 4000).withColumn("status", resample.status()).collect()}
    assert got["a"].p_importance == 1.0 and got["a"].reps_used == 0 if candidates.filter("key = 'a'").first().lrt <= 1e-14 else abs(got["a"].p_importance - iid["a"]) < 0.1
    assert got["b"].status == "pass" and abs(got["b"].p_importance - iid["b"]) < 5 * got["b"].se + 0.02
    assert got["c"].status == "pass" and 0 < got["c"].p_importance < 1e-6


def test_final_p_by_engine(candidates):
    rows = {r.key: r for r in resample.final_p(candidates, reps=199, blocks=(2,)).collect()}
    assert rows["c"].importance_status == "pass" and rows["c"].p_final >= rows["c"].p_importance and rows["c"].p_block2 is not None
    untested = [r for r in rows.values() if r.p_iid is None]
    assert all(r.p_final == 1.0 and r.classification_pre_fdr == "host_only_supported" and r.p_asym >= 0.2 for r in untested)
    fast = {r.key: r for r in resample.final_p(candidates, mode="fast", reps=199, importance_reps=3000, pilot_reps=199).collect()}
    assert 999 <= fast["c"].reps_used <= 3000
    plain = {r.key: r for r in resample.final_p(candidates, engine="iid", reps=199).collect()}
    assert plain["c"].p_final == 1 / 200
    with pytest.raises(ValueError):
        resample.policy("other")


def test_no_two_runs_gives_no_block_p(spark, candidates):
    x = candidates.filter("key = 'b'").withColumn("codons", F.transform("codons", lambda c: F.struct((c["codon"] * 2).alias("codon"), c["c0"].alias("c0"), c["c1"].alias("c1"), c["c2"].alias("c2"))))
    assert resample.block_p(x, 2, 50).first().p_block is None


def test_concentration_and_trimming(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(int, rng.multinomial(8, rng.dirichlet(12 * np.array(HOST))))) for _ in range(300)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "orf long, codon long, c0 long, c1 long, c2 long")
    got = metagene.fit_a0(df, HOST).first()
    grid = np.exp(np.linspace(math.log(0.02), math.log(1e5), 3001))
    best = grid[int(np.argmax([plain_value(rows, HOST, a) for a in grid]))]
    assert got.a0 == pytest.approx(best, rel=0.01) and not got.at_edge and got.n_codons == 300
    assert metagene.fit_a0(df.filter("false"), HOST).first().a0 == 20.0
    shares = np.array(rows) / 8
    k = int(0.1 * 300)
    want = np.array([np.sort(shares[:, f])[k : 300 - k].mean() for f in range(3)])
    r = metagene.trimmed_template(df, 0.1).first()
    assert np.allclose([r.pi0, r.pi1, r.pi2], want / want.sum())


def test_draws_by_counters_agree_with_the_generator(spark):
    """Uniform numbers are uniform, urns have the right means and spread, and tails agree with those of the other sampler."""
    us = spark.range(400).select(F.explode(F.expr(draws.uniform("(id * 7919)", "50L"))).alias("u"))
    row = us.agg(F.avg("u").alias("m"), F.var_pop("u").alias("v"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.count_distinct("u").alias("n")).first()
    assert abs(row.m - 0.5) < 0.008 and abs(row.v - 1 / 12) < 0.003 and 0 < row.lo and row.hi < 1 and row.n > 19_900
    one = spark.range(6000).select(F.lit(8.0).alias("a0"), F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("host"), F.expr(draws.uniform("(id * 104729)", "10L")).alias("us"))
    counts = one.select(F.expr(draws.urn("us", "a0", "host")).alias("c")).select("c.*")
    for f, p in enumerate((0.2, 0.3, 0.5)):
        got = counts.agg(F.avg(f"c{f}").alias("m"), F.var_pop(f"c{f}").alias("v")).first()
        want = 10 * p * (1 - p) * (10 + 8) / (1 + 8)
        assert abs(got.m - 10 * p) < 0.1 and abs(got.v - want) < 0.1 * want
    rng = np.random.default_rng(3)
    host, trans = [0.3, 0.32, 0.38], [0.42, 0.29, 0.29]
    rows = []
    for k in range(6):
        codons = [(i + i // 9, *rng.multinomial(int(rng.integers(1, 6)), [1 / 3] * 3).tolist()) for i in range(25)]
        rows.append((f"k{k}", codons, host, trans, 12.0, 0.1 + 0.1 * k, 0.05 * 4**k))
    rows.append(("short", [(0, 1, 0, 0), (5, 0, 1, 0)], host, trans, 12.0, 0.2, 0.1))
    x = spark.createDataFrame(rows, "key string, codons array<struct<codon:int,c0:int,c1:int,c2:int>>, host array<double>, trans array<double>, a0 double, lambda_hat double, lrt double").cache()
    for method in ("iid", "block", "importance"):
        a, b = ({r.key: r for r in sampler(x, 1500, method).collect()} for sampler in (draws.tails, resample.tails))
        assert a.keys() == b.keys() and len(a) == 7
        for key, r in a.items():
            o = b[key]
            if method == "block" and key == "short":
                assert not r.usable and not o.usable
                continue
            assert r.drawn == o.drawn == 1500 and r.usable
            p, q = r.t / 1500, o.t / 1500
            error = (max(r.t2, o.t2) / 1500 - min(p, q) ** 2) ** 0.5 / 1500**0.5
            assert abs(p - q) < 5 * error + 0.004 and abs(r.w - o.w) / 1500 < 0.15
    again = draws.tails(x.repartition(3), 300, "importance")
    same = draws.tails(x.coalesce(1), 300, "importance")
    assert sorted((r.key, r.tail) for r in again.collect()) == sorted((r.key, r.tail) for r in same.collect())
    assert draws.tails(x.limit(0), 10, "iid").count() == 0
    assert "ArrowEvalPython" not in same._jdf.queryExecution().toString() and "MapInPandas" not in same._jdf.queryExecution().toString()
    final = resample.final_p(x.withColumn("p_asym", F.lit(0.1)), reps=60, importance_reps=80, sampler=draws.tails)
    assert final.filter("p_final is null or p_final <= 0").count() == 0
