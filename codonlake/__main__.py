"""Command line: python -m codonlake run ... for one sample, batch ... for a table of samples."""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from collections.abc import Sequence
from dataclasses import replace

from codonlake.operators.calling import Settings
from codonlake.plans.pipeline import MODES, ORDER, Config
from codonlake.sources.formats import length_offsets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codonlake")
    p.add_argument("what", choices=("run", "batch", "integrate"))
    p.add_argument("--folder", required=True, help="where tables go; any store that Spark writes")
    p.add_argument("--sample", default="sample")
    p.add_argument("--samples", default="", help="batch and integrate: a table of replicates")
    for name in ("gtf", "fasta", "alignments", "offset-file", "quality-file"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--length-offsets", default="", help="28:12 29:12")
    p.add_argument("--mode", choices=sorted(MODES), default="accurate")
    p.add_argument("--starts", default="ATG")
    p.add_argument("--min-aa", type=int, default=6)
    p.add_argument("--primary-only", action="store_true")
    p.add_argument("--merge-by", choices=("blocks", "stop"), default="blocks")
    p.add_argument("--export", choices=("credible", "all"), default="credible")
    p.add_argument("--from-stage", choices=ORDER, default=ORDER[0])
    p.add_argument("--to-stage", choices=ORDER, default=ORDER[-1])
    p.add_argument("--with-codon", action="store_true")
    p.add_argument("--set", default="", help="other parameters of a run: name=value name=value")
    p.add_argument("--pure-only", action="store_true", help="integrate: only candidates that repeat no annotated CDS")
    p.add_argument("--no-files", action="store_true", help="run and batch: tables of the stages only, no files for other programs")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    return p


def _value(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def config(args: argparse.Namespace) -> Config:
    """The run that the arguments ask for; unknown names and wrong values are errors."""
    known, settings = {}, {}
    for part in shlex.split(args.set):
        name, sep, value = part.partition("=")
        if not sep:
            raise ValueError(f"name=value is wanted: {part}")
        if name in Settings.__dataclass_fields__:
            settings[name] = _value(value)
        elif name in Config.__dataclass_fields__:
            known[name] = _value(value)
        else:
            raise ValueError(f"unknown parameter: {name}")
    if isinstance(known.get("chroms"), str):
        known["chroms"] = tuple(known["chroms"].split(","))
    c = Config(
        sample=args.sample,
        folder=args.folder,
        gtf=args.gtf,
        fasta=args.fasta,
        alignments=args.alignments,
        length_offsets=length_offsets(args.length_offsets),
        offset_file=args.offset_file,
        quality_file=args.quality_file,
        mode=args.mode,
        starts=tuple(args.starts.split(",")),
        min_aa=args.min_aa,
        primary_only=args.primary_only,
        merge_by=args.merge_by,
        export=args.export,
        from_stage=args.from_stage,
        to_stage=args.to_stage,
        with_codon=args.with_codon,
        settings=Settings(**settings),
    )
    return replace(c, **known)


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    from codonlake.plans import files, pipeline
    from codonlake.sources import inputs
    from codonlake.sources.outputs import write_tsv
    from codonlake.sources.formats import read_tsv

    args = parser().parse_args(argv)
    try:
        base = config(args)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("codonlake").getOrCreate()
        if args.what == "run":
            for name, done in pipeline.run(spark, base, args.force, args.dry_run):
                print(f"{name}\t{done}")
            if not args.no_files and not args.dry_run:
                files.write_files(spark, base)
            return 0
        rows = inputs.replicates(read_tsv(spark, args.samples, {"replicate_id"}))
        configs = [replace(base, sample=r["replicate_id"], alignments=r["bam"], length_offsets=length_offsets(r["length_offsets"]), offset_file=r["ribotish_para"], quality_file=r["ribotish_quality"]) for r in rows]
        if args.what == "batch":
            found = pipeline.run_batch(spark, configs, args.force)
            if not args.no_files:
                whole = {r["replicate_id"] for r in found if r["status"] == "complete"}
                for c in configs:
                    if c.sample in whole:
                        files.write_files(spark, c)
            print("\n".join(json.dumps(r, sort_keys=True) for r in found))
            return 0 if all(r["status"] == "complete" for r in found) else 1
        for mode in MODES[base.mode]:
            for name, found in pipeline.integration(spark, configs, mode, args.pure_only).items():
                write_tsv(found, f"{base.folder}/integration_{mode}/{name}.tsv")
        return 0
    except ValueError as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
