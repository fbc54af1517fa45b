"""Draws of codons by depth against draws of each codon."""

import numpy as np
from codonlake.operators import resample
from pyspark.sql import functions as F

HOST, TRANS = np.array([0.1, 0.2, 0.7]), np.array([0.8, 0.1, 0.1])


def test_codons_of_one_depth_drawn_at_once_are_those_drawn_one_by_one():
    rng, depths = np.random.default_rng(4), [(1, 40), (3, 60), (9, 2)]
    mixes, picked = np.array([HOST, (HOST + TRANS) / 2]), np.arange(6000) % 2
    got = resample.drawn_classes(rng, depths, mixes, picked, 20.0)
    want = resample.exceeding(resample.draw(rng, np.repeat([d for d, _ in depths], [m for _, m in depths]), mixes[picked], 20.0))
    got, want = got[:, :, : want.shape[2]], want[:, :, : got.shape[2]]
    assert (got.sum(axis=(1, 2)) == 40 + 180 + 18).all()
    for k in (0, 1):
        a, b = got[picked == k], want[picked == k]
        error = np.sqrt((a.var(axis=0) + b.var(axis=0)) / 3000) + 1e-3
        assert (np.abs(a.mean(axis=0) - b.mean(axis=0)) < 5 * error).all()
        assert np.allclose(a[:, :, :2].std(axis=0), b[:, :, :2].std(axis=0), rtol=0.1, atol=0.05)


def test_batches_do_not_grow_with_codons(spark):
    """A batch holds a count for each depth: 20,000 codons took 200 batches, each with all of them."""
    x = spark.createDataFrame([("k",)], "key string").select("key", F.expr("transform(sequence(1, 20000), i -> named_struct('codon', i, 'c0', i % 3, 'c1', 1, 'c2', i % 2))").alias("codons"), F.array(*map(F.lit, HOST.tolist())).alias("host"), F.array(*map(F.lit, TRANS.tolist())).alias("trans"), F.lit(20.0).alias("a0"), F.lit(0.2).alias("lambda_hat"), F.lit(3.0).alias("lrt"))
    out = resample.tails(x, 999, "iid")
    assert out.first().drawn == 999
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    repeated = [line for line in plan.splitlines() if "RepartitionByExpression" in line or "MapInPandas" in line]
    assert repeated and not any("codons#" in line for line in repeated)
