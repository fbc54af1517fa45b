"""Stage records: what runs again, and what fails."""

import hashlib
import os
import sys

import pytest
from codonlake.operators import fdr
from codonlake.plans import pipeline
from codonlake.plans import stages as stages_module
from codonlake.sources import outputs
from codonlake.plans.stages import Stage, plan, run, run_all
from pyspark.sql import functions as F


def numbers(spark, inputs, parameters):
    return spark.range(parameters["n"])


def total(spark, inputs, parameters):
    return inputs["numbers"].agg(F.sum("id").alias("total"))


def broken(spark, inputs, parameters):
    raise RuntimeError("no")


def stages(n=4):
    return [Stage("numbers", numbers, (), {"n": n}, ("id",)), Stage("total", total, ("numbers",), {}, ("total",))]


def test_records_decide_what_runs(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert run(spark, folder, stages(), dry=True) == [("numbers", "would run"), ("total", "would run")]
    assert run(spark, folder, stages()) == [("numbers", "run"), ("total", "run")]
    assert run(spark, folder, stages()) == [("numbers", "kept"), ("total", "kept")]
    assert run(spark, folder, stages(5)) == [("numbers", "run"), ("total", "run")]
    assert spark.read.parquet(f"{folder}/total/data").first().total == 10
    assert run(spark, folder, stages(5), first="total", force=True) == [("total", "run")]


def test_bad_plans_and_failed_samples(spark, tmp_path):
    with pytest.raises(ValueError, match="no earlier stage"):
        plan(stages()[::-1])
    with pytest.raises(ValueError, match="unknown"):
        plan(stages(), "other")
    with pytest.raises(ValueError, match="lacks columns"):
        run(spark, f"file://{tmp_path}/x", [Stage("numbers", numbers, (), {"n": 1}, ("other",))])
    got = run_all(spark, {"a": (f"file://{tmp_path}/a", [Stage("broken", broken)]), "b": (f"file://{tmp_path}/b", stages())})
    assert got == {"a": "failed: RuntimeError: no", "b": "complete"}


def halved(x):
    return x / 2


def uses(spark, inputs, parameters):
    return spark.range(1).select(F.lit(halved(parameters["n"])).alias("x"))


def reads(spark, inputs, parameters):
    return spark.read.text(parameters["path"]).withColumnRenamed("value", "id")


def test_contents_and_reachable_code_decide(spark, tmp_path, monkeypatch):
    """A byte of a file, a helper, a parameter: each runs what depends on it, and nothing else."""
    (tmp_path / "in.txt").write_text("abc\n")

    def made(n=4):
        return [Stage("read", reads, (), {"path": str(tmp_path / "in.txt")}, ("id",), True, ("path",), unique=("id",)), Stage("used", uses, (), {"n": n}, ("x",)), Stage("after", total_rows, ("read",), {}, ("n",))]

    folder = f"file://{tmp_path}/run"
    states = lambda n=4: [state for _, state in run(spark, folder, made(n))]
    assert states() == ["run"] * 3 and states() == ["kept"] * 3
    found = stages_module.record(spark, folder, "read")
    assert found["files"]["path"]["sha256"] == hashlib.sha256(b"abc\n").hexdigest() and found["files"]["path"]["size_bytes"] == 4
    (tmp_path / "in.txt").write_text("abd\n")
    assert states() == ["run", "kept", "run"] and states() == ["kept"] * 3
    os.utime(tmp_path / "in.txt", (5, 5))
    assert states() == ["kept"] * 3  # touched, not changed
    assert states(5) == ["kept", "run", "kept"]
    monkeypatch.setattr(outputs, "PIECE", 1)
    assert outputs.identity(spark, str(tmp_path / "in.txt"))["sha256"] != hashlib.sha256(b"abd\n").hexdigest()
    before = {f: stages_module.code_hash(f) for f in (uses, reads)}
    monkeypatch.setattr(sys.modules[__name__], "halved", third)
    assert stages_module.code_hash(uses) != before[uses] and stages_module.code_hash(reads) == before[reads]
    monkeypatch.undo()
    code = {s.name: stages_module.code_hash(s.make) for _, _, s in pipeline.stages(pipeline.Config(sample="s", folder="f", length_offsets={28: 12}))}
    monkeypatch.setattr(fdr, "adjust", third)
    other = {s.name: stages_module.code_hash(s.make) for _, _, s in pipeline.stages(pipeline.Config(sample="s", folder="f", length_offsets={28: 12}))}
    assert {n for n in code if code[n] != other[n]} == {"accurate_results"}
    (tmp_path / "in.txt").write_text("x\nx\n")
    with pytest.raises(ValueError, match="rows of one key"):
        run(spark, folder, made())
    assert stages_module.record(spark, folder, "read") is None  # not whole


def third(x):
    return x / 3


def total_rows(spark, inputs, parameters):
    return inputs["read"].agg(F.count(F.lit(1)).alias("n"))


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    outputs.write_one(spark.range(2), f"{tmp_path}/t.tsv")
    with pytest.raises(Exception, match="no number"):
        outputs.write_one(spark.range(1).select(F.raise_error(F.lit("no number")).alias("id")), f"{tmp_path}/t.tsv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t.tsv").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t.tsv"]


def test_shared_stages_are_made_once(spark, tmp_path):
    made = [Stage("numbers", numbers, (), {"n": 3}, ("id",), shared=True), Stage("total", total, ("numbers",), {}, ("total",))]
    assert run(spark, f"file://{tmp_path}/a", made, shared=f"file://{tmp_path}/all") == [("numbers", "run"), ("total", "run")]
    assert run(spark, f"file://{tmp_path}/b", made, shared=f"file://{tmp_path}/all") == [("numbers", "kept"), ("total", "run")]
    assert spark.read.parquet(f"file://{tmp_path}/b/total/data").first().total == 3 and not (tmp_path / "b" / "numbers").exists()
