"""Readers of the tables that stages hand to each other, with their checks."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.sources import bam
from codonlake.sources.formats import read_tsv
from codonlake.sources.offsets import read_text


def _exists(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or pattern names, in order, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def torf_files(spark: SparkSession, spec: str) -> list[str]:
    """The tORF tables that a pattern, a folder, a file or a prefix names, sorted; none is an error."""
    if any(c in spec for c in "*?["):
        found = _exists(spark, spec)
    else:
        found = _exists(spark, f"{spec.rstrip('/')}/*.torf.tsv") or _exists(spark, spec) or _exists(spark, f"{spec}.*.torf.tsv")
    if not found:
        raise ValueError(f"no tORF tables: {spec}")
    return found


def read_torfs(spark: SparkSession, spec: str, required: Sequence[str] = ("torf_id",)) -> DataFrame:
    """All tORFs of a spec, as text, with `line`, their order of reading."""
    return read_tsv(spark, torf_files(spark, spec), set(required)).withColumn("line", F.monotonically_increasing_id())


def blocks(sizes: Column, starts1: Column) -> Column:
    """(s, e) of blocks, 0-based and half-open, from comma-joined sizes and 1-based starts; empty where they don't fit each other."""
    numbers = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())
    a, b = numbers(sizes), numbers(starts1)
    made = F.zip_with(b, a, lambda s, n: F.struct((s - 1).alias("s"), (s - 1 + n).alias("e")))
    return F.when((F.size(a) == F.size(b)) & ~F.exists(a, lambda n: n <= 0), made).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def ranges(starts1: Column, ends1: Column) -> Column:
    """(s, e), 0-based and half-open, from comma-joined 1-based closed starts and ends."""
    numbers = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())
    return F.zip_with(numbers(starts1), numbers(ends1), lambda s, e: F.struct((s - 1).alias("s"), e.alias("e")))


def key_values(rows: DataFrame, key: Sequence[str] = ("metric", "parameter", "key")) -> dict[str, str]:
    """A small table of names and values; a name that comes twice is an error."""
    name = next((k for k in key if k in rows.columns), None)
    if name is None or "value" not in rows.columns:
        raise ValueError("a table of names and values is wanted")
    found: dict[str, str] = {}
    for r in rows.select(F.trim(name).alias("k"), F.trim(F.col("value").cast("string")).alias("v")).collect():  # a report of some dozen lines
        if r.k and r.k in found:
            raise ValueError(f"{r.k} comes twice")
        if r.k:
            found[r.k] = r.v or ""
    return found


def background(found: Mapping[str, str], pi_method: str = "codon_equal", least_a0: float = 0.5, length: int | None = None, psites: str | None = None) -> tuple[tuple[float, float, float], float]:
    """Template and concentration of a background's names and values; anything that doesn't fit the run is an error."""
    if missing := sorted({"pi0", "pi1", "pi2", "A"} - set(found)):
        raise ValueError(f"the background lacks: {', '.join(missing)}")
    if (status := found.get("template_status", "success")) != "success":
        raise ValueError(f"the background's template is {status}")
    try:
        pi, a0 = [float(found[f"pi{k}"]) for k in range(3)], float(found["A"])
    except ValueError as error:
        raise ValueError("the background holds what is no number") from error
    if not all(math.isfinite(p) and p > 0 for p in pi) or abs(sum(pi) - 1) > 1e-6:
        raise ValueError("the background's shares must be over 0 and sum to 1")
    if not math.isfinite(a0) or a0 <= 0 or a0 < least_a0:
        raise ValueError("the background's concentration is too low")
    if (method := found.get("pi_method", found.get("pi_method_used", ""))) and method != pi_method:
        raise ValueError(f"the background was made by {method}")
    if (rl := found.get("rl_filter", "")) and rl != ("pooled" if length is None else str(length)):
        raise ValueError(f"the background is of read length {rl}")
    if psites and found.get("psite_bam") and found["psite_bam"] != psites:
        raise ValueError("the background is of other P-sites")
    return tuple(p / sum(pi) for p in pi), a0


def relevant(torfs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates' tORFs that are no annotated CDS, and the CDSs of their genes."""
    cds = F.lower(F.trim(F.col("is_annotated_cds").cast("string"))).isin("1", "true", "yes", "y")
    x = torfs.withColumn("is_annotated_cds", cds)
    own = x.filter("not is_annotated_cds").join(candidates.select("gorf_id").distinct(), "gorf_id", "left_semi")
    return own.unionByName(x.filter("is_annotated_cds").join(candidates.select("gene_id").distinct(), "gene_id", "left_semi"))


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON object from any store."""
    found = json.loads(read_text(spark, path))
    if not isinstance(found, dict):
        raise ValueError(f"no object: {path}")
    return found


def exclusions(manifest: Mapping, start: int | None = None, stop: int | None = None) -> tuple[int, int, int | None, str]:
    """First and last codons to leave out, read length and its source, from a run's parameters; what is given goes before them."""
    p = manifest.get("parameters")
    if not isinstance(p, dict):
        raise ValueError("the manifest has no parameters")
    a, b = p.get("exclude_start_codons") if start is None else start, p.get("exclude_stop_codons") if stop is None else stop
    if not all(isinstance(x, int) and x >= 0 for x in (a, b)):
        raise ValueError("the numbers of codons to leave out must be known")
    return a, b, None if p.get("rl") in (None, "", "pooled") else int(p["rl"]), str(p.get("rl_source") or "auto")


ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def replicates(rows: DataFrame) -> list[dict[str, str]]:
    """The replicates of a batch: unlike names (whatever their case), all with offsets of their own or all with files of them."""
    if missing := sorted({"replicate_id", "bam", "input_mode", "length_offsets", "ribotish_para", "ribotish_quality"} - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = [{c: (v or "").strip() for c, v in r.asDict().items()} for r in rows.collect()]  # a few replicates
    names = [r["replicate_id"] for r in out]
    if not out or not all(ID.fullmatch(n) for n in names):
        raise ValueError("each replicate needs a plain name")
    if len({n.casefold() for n in names}) < len(names):
        raise ValueError("two replicates have one name")
    if len({r["input_mode"] for r in out}) > 1 or out[0]["input_mode"] not in ("explicit", "ribotish"):
        raise ValueError("all replicates must have one input mode, explicit or ribotish")
    for r in out:
        explicit = r["input_mode"] == "explicit"
        if not r["bam"] or bool(r["length_offsets"]) != explicit or bool(r["ribotish_para"] and r["ribotish_quality"]) == explicit:
            raise ValueError(f"the inputs of {r['replicate_id']} don't fit its mode")
    return out


ID_COLUMNS = ("orf_id", "candidate_key", "gorf_id", "torf_id")


def orf_list(spark: SparkSession, path: str) -> DataFrame:
    """id: of a plain list, or of a table with any of the known columns; `#` begins a comment."""
    lines = spark.read.text(path).filter("trim(value) <> '' and ltrim(value) not like '#%'")
    first = lines.first()
    if first is None:
        raise ValueError("the list is empty")
    head = [x.strip() for x in first.value.lstrip("﻿").rstrip("\r").split("\t")]
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    wanted = [k for k, c in enumerate(head) if c in ID_COLUMNS]
    if wanted:
        rows = lines.filter(F.col("value") != first.value).select(F.explode(F.array(*[F.get(cells, F.lit(k)) for k in wanted])).alias("id"))
    else:
        rows = lines.select(F.regexp_replace(F.get(cells, F.lit(0)), "^﻿", "").alias("id"))
    return rows.select(F.trim("id").alias("id")).filter("id <> ''").distinct()


def requested(values: Sequence[str]) -> set[str]:
    """Ids from texts that join them by commas."""
    return {x.strip() for v in values for x in v.split(",") if x.strip()}


def lookup(torfs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tORFs of the wanted ids (torf_id), each once; unlike rows of one id, and ids without a row, are errors."""
    x = torfs.drop("line").join(wanted.select("torf_id").distinct(), "torf_id", "left_semi").distinct()
    if twice := x.groupBy("torf_id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"unlike rows of {twice[0].torf_id}")
    if lost := wanted.select("torf_id").distinct().join(x, "torf_id", "left_anti").limit(5).collect():
        raise ValueError(f"no rows of: {', '.join(r.torf_id for r in lost)}")
    return x


def library_size(psites: DataFrame | None, alignments: str = "") -> int:
    """Mapped P-sites, from the index of their BAM file where there is one, else by a scan; none is an error."""
    counts = bam.indexed_counts(alignments) if alignments else None
    if counts is not None:
        n = sum(mapped for _, mapped, _ in counts)
    else:
        n = psites.filter(F.expr("flag & 4 = 0")).count() if "flag" in psites.columns else psites.count()
    if n <= 0:
        raise ValueError("there are no P-sites")
    return n


def alignment_summary(spark: SparkSession, alignments: str) -> DataFrame:
    """contig, mapped and unmapped records of a BAM file, from its index alone; one without index is an error."""
    counts = bam.indexed_counts(alignments)
    if counts is None:
        raise ValueError(f"no index of {alignments}")
    return spark.createDataFrame(counts, "contig string, mapped long, unmapped long")


def metric(found: Mapping[str, str], *names: str) -> str:
    """The first of the names that a report has; empty if none."""
    return next((found[n] for n in names if found.get(n)), "")


def selected_text(audit: DataFrame) -> str:
    """The selected lengths and offsets of an audit, as `L:O` joined by commas."""
    return ",".join(f"{r.length}:{r.offset}" for r in audit.filter("selected = 1").select("length", "offset").orderBy("length").collect())  # some dozen lengths
