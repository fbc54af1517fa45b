"""Stages in order, each kept as Parquet with a record of what made it; a stage whose record still fits isn't run again.

A record holds the stage's parameters, the size and SHA-256 of the files it reads, a hash of all code of the library that
it can reach, and the records of its inputs, so a change in one of them runs the stage and those after it, and
nothing else. A file whose size and time of change are those of the record isn't hashed again. Records are one-row
tables beside the data, written last, in any file system that Spark reaches.

A stage's `signature` leaves out what belongs to a sample, its own files among them: results of samples with one signature fit
together.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import types
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from codonlake.sources import outputs

PACKAGE = __name__.split(".")[0]


@dataclass(frozen=True)
class Stage:
    """make(spark, inputs by name, parameters) gives the stage's table; `columns` must be among its columns, `unique` ones
    must name each row once, and a `filled` one must have a row. files: parameters that are paths, whose contents count
    instead of their names; own: parameters that belong to a sample. A shared one may serve several samples."""

    name: str
    make: Callable[[SparkSession, Mapping[str, DataFrame], Mapping], DataFrame]
    inputs: Sequence[str] = ()
    parameters: Mapping = field(default_factory=dict)
    columns: Sequence[str] = ()
    filled: bool = False
    files: Sequence[str] = ()
    own: Sequence[str] = ()
    shared: bool = False
    unique: Sequence[str] = ()


def _codes(code: types.CodeType):
    yield code
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from _codes(c)


def _ours(x: object) -> bool:
    return (getattr(x, "__module__", None) or "").split(".")[0] == PACKAGE


def _source(f: Callable) -> str:
    """The text of a function or class; the byte code of one that was made without a file."""
    try:
        return inspect.getsource(f)
    except (OSError, TypeError):
        return f.__code__.co_code.hex() if isinstance(f, types.FunctionType) else repr(f)


def reached(make: Callable) -> dict[str, str]:
    """Source or value of everything that a function can reach by name: functions, classes and constants of this library, and of its own module."""
    found: dict[str, str] = {}
    home = getattr(make, "__module__", "").split(".")[0]
    todo: list = [make]

    def see(name: str, x: object) -> None:
        if isinstance(x, functools.partial):
            see(name, x.func)
            found[f"{name} (bound)"] = repr((x.args, sorted(x.keywords.items())))
        elif isinstance(x, types.FunctionType | type) and (_ours(x) or (x.__module__ or "").split(".")[0] == home):
            todo.append(x)
        elif isinstance(x, str | int | float | bool | tuple | list | dict | set | frozenset):
            found[name] = repr(sorted(x, key=repr) if isinstance(x, set | frozenset) else x)

    while todo:
        f = todo.pop()
        key = f"{f.__module__}.{f.__qualname__}"
        if key in found:
            continue
        found[key] = _source(f)
        if isinstance(f, type):
            todo += [m for m in vars(f).values() if isinstance(m, types.FunctionType)]
            todo += [b for b in f.__bases__ if _ours(b)]
            continue
        for cell in f.__closure__ or ():
            try:
                see(f"{key} (cell)", cell.cell_contents)
            except ValueError:  # not filled yet
                continue
        names = {n for c in _codes(f.__code__) for n in c.co_names}
        for n in names:
            x = f.__globals__.get(n)
            if isinstance(x, types.ModuleType):
                if x.__name__.split(".")[0] == PACKAGE:
                    for inner in names & set(vars(x)):
                        see(f"{x.__name__}.{inner}", vars(x)[inner])
            elif x is not None:
                see(f"{f.__module__}.{n}", x)
    return found


def code_hash(make: Callable) -> str:
    return hashlib.sha256(json.dumps(reached(make), sort_keys=True).encode()).hexdigest()


def _hash(said: Mapping) -> str:
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(stage: Stage, before: Mapping[str, str], files: Mapping[str, Mapping] | None = None) -> str:
    """Hash of a stage's name, code, parameters, files (size and SHA-256) and the fingerprints of its inputs."""
    plain = {k: v for k, v in stage.parameters.items() if k not in stage.files}
    contents = {k: (f["size_bytes"], f["sha256"]) for k, f in (files or {}).items()}
    return _hash({"name": stage.name, "code": code_hash(stage.make), "parameters": plain, "files": contents, "inputs": {i: before[i] for i in stage.inputs}, "columns": list(stage.columns)})


def _signature(stage: Stage, before: Mapping[str, str], files: Mapping[str, Mapping]) -> str:
    """As the fingerprint, without the parameters and files of a sample."""
    plain = {k: v for k, v in stage.parameters.items() if k not in (*stage.files, *stage.own)}
    contents = {k: (f["size_bytes"], f["sha256"]) for k, f in files.items() if k not in stage.own}
    return _hash({"name": stage.name, "code": code_hash(stage.make), "parameters": plain, "files": contents, "inputs": [before[i] for i in stage.inputs]})


def record(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The record of a stage that is whole; None where there is none, or its writing was interrupted."""
    found = _record(spark, f"{folder}/{name}/record")
    return found if found and found.get("fingerprint") else None


def _record(spark: SparkSession, path: str) -> dict | None:
    try:
        rows = spark.read.text(path).collect()  # one line
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return json.loads(rows[0].value) if rows else None


def plan(stages: Sequence[Stage], first: str | None = None, last: str | None = None) -> list[Stage]:
    """The stages from first to last; an unknown name, a repeated one, or an input that comes later is an error."""
    names = [s.name for s in stages]
    if len(set(names)) < len(names):
        raise ValueError("stage names repeat")
    for k, s in enumerate(stages):
        if late := [i for i in s.inputs if i not in names[:k]]:
            raise ValueError(f"inputs of {s.name} that no earlier stage makes: {', '.join(late)}")
    if unknown := [n for n in (first, last) if n is not None and n not in names]:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if a > b:
        raise ValueError("the first stage comes after the last")
    return list(stages[a : b + 1])


def _identities(spark: SparkSession, stage: Stage, held: Mapping | None, seen: dict[str, dict]) -> dict[str, dict]:
    """Size, time and SHA-256 of the files that a stage's parameters name; known ones that didn't change aren't read."""
    out = {}
    for k in stage.files:
        path = stage.parameters.get(k)
        if not path:
            continue
        if path not in seen:
            before = ((held or {}).get("files") or {}).get(k)
            seen[path] = outputs.identity(spark, path, before if before and before.get("path") == path else None)
        out[k] = seen[path]
    return out


def _check(spark: SparkSession, s: Stage, data: str) -> None:
    """Raises where the written table isn't what the stage promises."""
    from pyspark.sql import functions as F

    found = spark.read.parquet(data)
    if s.filled and found.isEmpty():
        raise ValueError(f"stage {s.name} made no rows")
    if s.unique and (twice := found.groupBy(*s.unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()):
        raise ValueError(f"stage {s.name} has rows of one key: {', '.join(str(twice[0][c]) for c in s.unique)}")


def run(spark: SparkSession, folder: str, stages: Sequence[Stage], first: str | None = None, last: str | None = None, force: bool = False, dry: bool = False, shared: str | None = None) -> list[tuple[str, str]]:
    """(stage, what was done: run, kept, or would run) for the planned stages. Inputs before the first stage must be there.

    shared: a folder where shared stages are kept by their fingerprints, so that samples made alike use one table."""
    wanted, made, signed, done, seen = {s.name for s in plan(stages, first, last)}, {}, {}, [], {}
    places: dict[str, str] = {}
    for s in stages:
        at_home = f"{folder}/{s.name}"
        held = _record(spark, f"{at_home}/record")
        files = _identities(spark, s, held, seen)
        made[s.name] = fingerprint(s, made, files)
        signed[s.name] = _signature(s, signed, files)
        places[s.name] = f"{shared}/{s.name}-{made[s.name][:24]}" if shared and s.shared else at_home
        data, path = f"{places[s.name]}/data", f"{places[s.name]}/record"
        if places[s.name] != at_home:
            held = _record(spark, path)
        if s.name not in wanted:
            continue
        if not force and held is not None and held["fingerprint"] == made[s.name]:
            done.append((s.name, "kept"))
            continue
        if dry:
            done.append((s.name, "would run"))
            continue
        out = s.make(spark, {i: spark.read.parquet(f"{places[i]}/data") for i in s.inputs}, s.parameters)
        if missing := sorted(set(s.columns) - set(out.columns)):
            raise ValueError(f"stage {s.name} lacks columns: {', '.join(missing)}")
        # an interrupted write leaves no record that fits
        spark.createDataFrame([("{\"fingerprint\": null}",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        out.write.mode("overwrite").parquet(data)
        _check(spark, s, data)
        said = {"stage": s.name, "fingerprint": made[s.name], "signature": signed[s.name], "code": code_hash(s.make), "parameters": dict(s.parameters), "files": files, "inputs": {i: made[i] for i in s.inputs}, "columns": out.columns}
        spark.createDataFrame([(json.dumps(said, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        done.append((s.name, "run"))
    return done


def run_all(spark: SparkSession, folders: Mapping[str, tuple[str, Sequence[Stage]]]) -> dict[str, str]:
    """Several samples, one after another; a failed one doesn't stop the others. Its error is its status."""
    out = {}
    for sample, (folder, stages) in folders.items():
        try:
            run(spark, folder, stages)
            out[sample] = "complete"
        except Exception as error:  # noqa: BLE001  any failure belongs to its sample alone
            out[sample] = f"failed: {type(error).__name__}: {error}".splitlines()[0]
    return out
