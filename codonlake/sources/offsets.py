"""Offsets and frame counts by read length, from files of literals that are read and never run."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def literal(text: str, label: str) -> dict:
    """A dictionary written as a literal."""
    try:
        found = ast.literal_eval(text)
    except (SyntaxError, ValueError) as error:
        raise ValueError(f"{label} is no literal dictionary") from error
    if not isinstance(found, dict):
        raise ValueError(f"{label} is no dictionary")
    return found


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def counts(found: Mapping, label: str) -> dict[int, int]:
    """The values of integer keys; each must be a whole number from 0 on. Other keys are passed over."""
    out = {k: v for k, v in found.items() if isinstance(k, int) and not isinstance(k, bool)}
    if bad := [k for k, v in out.items() if not _whole(v)]:
        raise ValueError(f"{label}: no whole number from 0 on for {bad}")
    if not out:
        raise ValueError(f"{label} has no integer keys")
    return out


def frames(found: Mapping, label: str) -> dict[int, tuple[int, int, int]]:
    """The three frame counts of integer keys."""
    out = {k: tuple(v) if isinstance(v, (list, tuple)) else () for k, v in found.items() if isinstance(k, int) and not isinstance(k, bool)}
    if bad := [k for k, v in out.items() if len(v) != 3 or not all(map(_whole, v))]:
        raise ValueError(f"{label}: not three whole numbers from 0 on for {bad}")
    if not out:
        raise ValueError(f"{label} has no integer keys")
    return out


def parse_offsets(source: str) -> tuple[dict[int, int], dict[int, int]]:
    """The offsets of an `offdict = {...}` assignment: for reads that match at the 5' end, and (`m0`) that don't."""
    try:
        body = ast.parse(source).body
    except SyntaxError as error:
        raise ValueError("the file of offsets can't be read") from error
    for node in body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "offdict" for t in node.targets):
            found = literal(ast.unparse(node.value), "offdict")
            other = found.get("m0") or {}
            if not isinstance(other, dict):
                raise ValueError("offdict['m0'] is no dictionary")
            return counts(found, "offdict"), counts(other, "offdict['m0']") if other else {}
    raise ValueError("there is no offdict")


def parse_quality(source: str) -> tuple[dict, dict, dict, dict]:
    """Reads and frame counts by length from five lines of literals, and the same of mismatched reads from five more."""
    lines = [x for x in map(str.strip, source.splitlines()) if x]
    if len(lines) not in (5, 10):
        raise ValueError(f"5 or 10 lines are wanted, not {len(lines)}")
    found = [literal(x, f"line {k}") for k, x in enumerate(lines, 1)]
    part = lambda k: (counts(found[k], f"line {k + 1}"), frames(found[k + 3], f"line {k + 4}"))
    return *part(0), *(part(5) if len(found) == 10 else ({}, {}))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any store that Spark reads."""
    rows = spark.read.option("wholetext", True).text(path).collect()
    if len(rows) != 1:
        raise ValueError(f"one file is wanted: {path}")
    return rows[0].value


def support(spark: SparkSession, offsets: Mapping[int, int], reads: Mapping[int, int] | None = None, found: Mapping[int, tuple] | None = None) -> DataFrame:
    """length, offset, reads, f0, f1, f2 for every length that has an offset or counts."""
    reads, found = reads or {}, found or {}
    rows = [(n, offsets.get(n), reads.get(n), *found.get(n, (None,) * 3)) for n in sorted({*offsets, *found})]
    return spark.createDataFrame(rows, "length int, offset int, reads long, f0 long, f1 long, f2 long")
