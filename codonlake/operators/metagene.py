"""Metagene quality control: templates, ternary lattice, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _times(times: Column | None) -> Column:
    return (F.lit(1) if times is None else times).cast("long")


def template(codons: DataFrame, least_reads: int = 3, times: Column | None = None) -> DataFrame:
    """method, pi0, pi1, pi2, n_codons: phase templates, read-weighted and codon-equal, in one pass. times: the codons a row stands for, else one."""
    times = _times(times)
    x = codons.withColumn("n", F.col("c0") + F.col("c1") + F.col("c2")).filter(F.col("n") >= least_reads)
    one = x.agg(
        F.coalesce(F.sum(times), F.lit(0)).cast("long").alias("n_codons"), *[(F.sum(F.col(f"c{f}") * times) / F.sum(F.col("n") * times)).alias(f"r{f}") for f in range(3)], *[(F.sum(F.col(f"c{f}") / F.col("n") * times) / F.sum(times)).alias(f"e{f}") for f in range(3)]
    )
    rows = [F.struct(F.lit(m).alias("method"), *[F.col(f"{k}{f}").alias(f"pi{f}") for f in range(3)]) for m, k in (("read_weighted", "r"), ("codon_equal", "e"))]
    return one.select("n_codons", F.inline(F.array(*rows)))


def lattice(c: list[Column], resolution: int = 20) -> list[Column]:
    """Grid counts of the phase shares by largest remainders, ties to the lower phase."""
    n = c[0] + c[1] + c[2]
    scaled = [x * resolution for x in c]
    base, rest = [F.floor(s / n) for s in scaled], [s % n for s in scaled]
    short = F.lit(resolution) - (base[0] + base[1] + base[2])
    out = []
    for i in range(3):
        ahead = sum((((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("long") for j in range(3) if j != i), F.lit(0).cast("long"))
        out.append((base[i] + F.when(ahead < short, 1).otherwise(0)).cast("long").alias(f"g{i}"))
    return out


def ternary(codons: DataFrame, resolution: int = 20, times: Column | None = None) -> DataFrame:
    """g0, g1, g2, n, percent: codons by lattice point."""
    x = codons.filter("c0 + c1 + c2 > 0").select(*lattice([F.col(f"c{f}") for f in range(3)], resolution), _times(times).alias("_times")).groupBy("g0", "g1", "g2").agg(F.sum("_times").alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    # one row
    return x.join(F.broadcast(total)).select("g0", "g1", "g2", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def relative_histogram(hits: DataFrame, anchor: Column, window: int) -> DataFrame:
    """rel_nt, count: reads by distance from an anchor, with zeros, from -window to window."""
    spark = hits.sparkSession
    grid = spark.range(-window, window + 1).select(F.col("id").alias("rel_nt"))
    seen = hits.select((F.col("t") - anchor).alias("rel_nt"), "n").filter(F.abs("rel_nt") <= window).groupBy("rel_nt").agg(F.sum("n").cast("long").alias("count"))
    return grid.join(seen, "rel_nt", "left").select("rel_nt", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def cds_metrics(codons: DataFrame) -> DataFrame:
    """orf, reads, pif, uniformity: share of reads in phase 0, and of codons with over a third of theirs there."""
    n = F.col("c0") + F.col("c1") + F.col("c2")
    return codons.groupBy("orf", "n_codons").agg(
        F.sum(n).alias("reads"), (F.sum("c0") / F.sum(n)).alias("pif"), F.sum(F.when(F.col("c0") * 3 > n, 1).otherwise(0)).alias("periodic")
    ).select("orf", "reads", "pif", (F.col("periodic") / F.col("n_codons")).alias("uniformity"))


def trimmed_template(codons: DataFrame, share: float, least_reads: int = 3) -> DataFrame:
    """pi0, pi1, pi2: means of the codons' phase shares without floor(share * n) codons at each end, scaled to the sum 1.

    Codons are counted by pattern first, so the window over a phase's values sees the distinct patterns only,
    which the depth of codons bounds. Ties share no order, so the trimmed ranks need none."""
    share = min(max(share, 0.0), 0.49)
    n = F.col("c0") + F.col("c1") + F.col("c2")
    seen = codons.filter(n >= least_reads).groupBy("c0", "c1", "c2").agg(F.count(F.lit(1)).alias("k"))
    long = seen.select("k", F.inline(F.array(*[F.struct(F.lit(f).alias("f"), (F.col(f"c{f}") / n).alias("x")) for f in range(3)]))).groupBy("f", "x").agg(F.sum("k").alias("k"))
    w = W.partitionBy("f")
    upto, total = F.sum("k").over(w.orderBy("x")), F.sum("k").over(w)
    long = long.select("f", "x", "k", upto.alias("upto"), total.alias("total")).withColumn("cut", F.floor(F.col("total") * F.lit(share)))
    left = F.greatest(F.lit(0).cast("long"), F.least("upto", F.col("total") - F.col("cut")) - F.greatest(F.col("upto") - F.col("k"), F.col("cut")))
    mean = long.groupBy("f").agg((F.sum(F.col("x") * left) / F.sum(left)).alias("m"))
    one = mean.agg(*[F.max(F.when(F.col("f") == f, F.col("m"))).alias(f"m{f}") for f in range(3)])
    return one.select(*[(F.col(f"m{f}") / (F.col("m0") + F.col("m1") + F.col("m2"))).alias(f"pi{f}") for f in range(3)])


def reservoir(codons: DataFrame, size: int, least_reads: int = 3, seed: int = 1) -> DataFrame:
    """A sample of at most `size` codons with enough reads: those with the least hashes of ORF and codon.

    The same codons come out whatever the order and parts, and the reservoir of two tables is that of their reservoirs
    (`merged_reservoirs`). A task keeps `size` rows at most, whatever the depth."""
    enough = codons.filter(F.col("c0") + F.col("c1") + F.col("c2") >= least_reads)
    named = enough.select("orf", "codon", "c0", "c1", "c2", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("orf").cast("string"), F.col("codon").cast("string")).cast("binary")).alias("hash"))
    return _least(named, size)


def merged_reservoirs(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """The reservoir of two tables from those of each, made with one seed."""
    return _least(a.unionByName(b).distinct(), size)


def _least(named: DataFrame, size: int) -> DataFrame:
    return named.orderBy("hash", "orf", "codon").limit(size)


def reservoir_template(codons: DataFrame, size: int = 200_000, share: float = 0.1, least_reads: int = 3, seed: int = 1) -> DataFrame:
    """`trimmed_template` of a reservoir: exact trimming of a bounded sample, for codons of any number and depth."""
    return trimmed_template(reservoir(codons, size, least_reads, seed), share, least_reads)


def fit_a0(codons: DataFrame, pi: tuple[float, float, float], least_reads: int = 3, low: float = 0.02, high: float = 1e5, points: int = 96, times: Column | None = None) -> DataFrame:
    """a0, at_edge, n_codons: the concentration of largest likelihood between low and high; 20 without codons.

    The likelihood needs the numbers of codons with more than k reads, by phase and in all: as many as the
    deepest codon's reads. A grid on the logarithm finds the hill, and the slope is bisected beside its top."""
    pi = tuple(max(p, 1e-9) / sum(max(q, 1e-9) for q in pi) for p in pi)
    n = F.col("c0") + F.col("c1") + F.col("c2")
    x = codons.filter(n >= least_reads)
    parts = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"c{f}").cast("long").alias("c")) for f in range(3)], F.struct(F.lit(3).alias("f"), n.cast("long").alias("c")))
    long = x.select(_times(times).alias("_times"), F.inline(parts)).filter("c > 0").groupBy("f", "c").agg(F.sum("_times").alias("m"))
    more = long.select("f", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("k")).groupBy("f", "k").agg(F.sum("m").alias("m"))
    one = more.agg(F.sort_array(F.collect_list(F.struct("f", "k", "m"))).alias("terms"), F.coalesce(F.sum(F.when((F.col("f") == 3) & (F.col("k") == 0), F.col("m"))), F.lit(0).cast("long")).alias("n_codons"))
    weight = lambda f: F.when(f == 0, pi[0]).when(f == 1, pi[1]).when(f == 2, pi[2]).otherwise(1.0)
    sign = lambda f: F.when(f == 3, -1.0).otherwise(1.0)
    value = lambda a: F.aggregate("terms", F.lit(0.0), lambda s, t: s + sign(t["f"]) * t["m"] * F.log(a * weight(t["f"]) + t["k"]))
    slope = lambda a: F.aggregate("terms", F.lit(0.0), lambda s, t: s + sign(t["f"]) * t["m"] * weight(t["f"]) / (a * weight(t["f"]) + t["k"]))
    start, step = math.log(low), (math.log(high) - math.log(low)) / points
    tried = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.struct(value(F.exp(F.lit(start) + F.lit(step) * i)).alias("v"), i.alias("i")))
    one = one.withColumn("best", F.array_max(tried)["i"])
    lo = F.lit(start) + F.lit(step) * F.greatest(F.lit(0), F.col("best") - 1)
    hi = F.lit(start) + F.lit(step) * F.least(F.lit(points), F.col("best") + 1)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = slope(F.exp(mid)) > 0
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    top = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(lo.alias("lo"), hi.alias("hi")), halve, lambda s: F.exp((s["lo"] + s["hi"]) / 2))
    some = F.col("n_codons") > 0
    return one.select(F.when(some, top).otherwise(20.0).alias("a0"), (some & F.col("best").isin(0, points)).alias("at_edge"), "n_codons")


def load_cds(rows: DataFrame, least_nt: int = 90) -> DataFrame:
    """Every tORF row with `skip`: why it is no CDS record; null for those that are.

    rows: line, torf_id, orf_biotype, is_annotated_cds, has_MANE_Select_tag, t_start, t_end, chromStart1, chromEnd1, strand, sizes,
    starts1. Annotated MANE CDSs only; of rows of one id the first read stays; a blank id gets a name from its line."""
    yes = lambda c: F.lower(F.trim(F.col(c).cast("string"))).isin("1", "true", "t", "yes", "y")
    number = lambda c: F.col(c).try_cast("int")
    sizes = F.col("sizes")
    bad_blocks = F.coalesce((F.size(sizes) == 0) | (F.size(sizes) != F.size("starts1")) | F.exists(sizes, lambda n: n <= 0), F.lit(True))
    why = (
        F.when(~F.coalesce((F.col("orf_biotype") == "CDS") & yes("is_annotated_cds") & yes("has_MANE_Select_tag"), F.lit(False)), "not_mane_cds")
        .when(number("t_start").isNull() | number("t_end").isNull() | number("chromStart1").isNull() | number("chromEnd1").isNull(), "skip_invalid_coordinates").when(number("t_end") - number("t_start") < least_nt, "skip_short_cds")
        .when(bad_blocks, "skip_invalid_blocks").when(~F.coalesce(F.nullif(F.trim("strand"), F.lit("")), F.lit("+")).isin("+", "-"), "skip_invalid_strand")
    )
    name = F.coalesce(F.nullif(F.trim("torf_id"), F.lit("")), F.concat(F.lit("CDS_fallback_"), F.col("line").cast("string")))
    x = rows.withColumn("torf_id", name).withColumn("skip", why)
    # of rows of one id the first read stays, also where lines are alike
    x = x.withColumn("_first", F.when(F.col("skip").isNull(), F.row_number().over(W.partitionBy("torf_id", F.col("skip").isNull()).orderBy("line"))))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)
    return x.withColumn("skip", F.coalesce("skip", F.when(F.col("_first") > 1, "skip_duplicate_torf_id").when(total < 3, "skip_invalid_orf_length"))).drop("_first")


def load_counts(loaded: DataFrame) -> DataFrame:
    """metric, value: rows scanned, CDS rows, those left out by reason, and those loaded, in one pass."""
    parts = F.array_compact(F.array(F.lit("torf_rows_scanned"), F.when(F.coalesce(F.col("skip") != "not_mane_cds", F.lit(True)), "mane_cds_rows"), F.when(F.col("skip") != "not_mane_cds", F.col("skip")), F.when(F.col("skip").isNull(), "mane_cds_loaded")))
    return loaded.select(F.explode(parts).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))


def dense_enough(hits: DataFrame, cds: DataFrame, least: float = 0.05) -> DataFrame:
    """cds (orf, length) with total_reads and read_density, of at least the density. hits: orf, n."""
    reads = hits.groupBy("orf").agg(F.sum("n").alias("total_reads"))
    x = cds.join(reads, "orf", "left").withColumn("total_reads", F.coalesce("total_reads", F.lit(0).cast("long"))).withColumn("read_density", F.col("total_reads") / F.col("length"))
    return x.filter(F.col("read_density") >= least)


def spliced_windows(cds: DataFrame, window: int) -> DataFrame:
    """orf, piece ranges as rows (orf, chrom, strand, start0, end0, offset) in one coordinate a transcript has: CDS bases from 0 on,
    the 5' flank below 0, the 3' flank from the CDS's length on; only `window` bases of each flank.

    cds: orf, chrom, strand, length, blocks, flank5, flank3: arrays of (s, e) in genome order."""
    from codonlake.operators.transcripts import placed

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    moved = lambda c, base: F.transform(placed(F.col(c), F.col("strand")), lambda x: F.struct(x["s"].alias("start0"), x["e"].alias("end0"), (x["t"] + base).alias("offset")))
    rows = [moved("flank5", -total(F.col("flank5"))), moved("blocks", F.lit(0).cast("long")), moved("flank3", F.col("length").cast("long"))]
    x = cds.select("orf", "chrom", "strand", "length", F.inline(F.concat(*rows)))
    return x.filter((F.col("offset") + F.col("end0") - F.col("start0") > -window) & (F.col("offset") < F.col("length") + window))


def alike(cds: DataFrame) -> DataFrame:
    """CDSs of one path as one row: the least orf, its columns as for `spliced_windows`, and `copies`."""
    path = ["chrom", "strand", "length", "blocks", "flank5", "flank3"]
    return cds.groupBy(*path).agg(F.min("orf").alias("orf"), F.count(F.lit(1)).alias("copies")).select("orf", *path, "copies")


def metagene(hits: DataFrame, window: int, which: str = "start") -> DataFrame:
    """rel_nt, count from -window to window around the first base of the start or of the stop codon; hits: t as from
    `spliced_windows`, length, n. The start's window leaves out the 3' flank, the stop's the 5' flank."""
    inside = (F.col("t") < F.col("length")) if which == "start" else (F.col("t") >= 0)
    anchor = F.lit(0) if which == "start" else F.col("length") - 3
    return relative_histogram(hits.filter(inside), anchor, window)


def full_metrics(hits: DataFrame, cds: DataFrame, threshold: float = 1 / 3) -> DataFrame:
    """The metrics of each CDS (orf, length, ...): periodicity, uniformity, and what happens at start and stop.

    hits: orf, t (flanks below 0 and from the length on), n and length. They are counted by codon once, and the codons by
    CDS. Counts at the codons that follow the start are filled with zeros before their median is taken."""
    w = 15
    t, n, length = F.col("t"), F.col("n"), F.col("length")
    inside = (t >= 0) & (t < length)
    codon_count = F.expr("length div 3")
    whole = inside & (t < codon_count * 3)
    among = lambda ok: F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).cast("long")
    counted = {
        "total_reads": inside, "f0": inside & (t % 3 == 0), "start_before": (t < 0) & (t >= -w), "start_after": inside & (t < w), "stop_before": inside & (t >= length - 3 - w) & (t < length - 3),
        "stop_after": (t >= length) & (t < length + w), "tis": t == 0, "_h": whole, "_h0": whole & (t % 3 == 0),
    }
    near = (t >= 3) & (t < F.least(length, F.lit(33))) & (t % 3 == 0)  # one base of a codon
    codons = hits.groupBy("orf", F.floor(t / 3).alias("codon")).agg(*[among(ok).alias(c) for c, ok in counted.items()], F.sum(F.when(near, n)).alias("_near"))
    one = codons.groupBy("orf").agg(
        *[F.sum(c).alias(c) for c in counted if not c.startswith("_")], F.count_if(F.col("_h") > 0).alias("codons_with_reads"), F.count_if((F.col("_h") > 0) & (F.col("_h0") / F.col("_h") > threshold)).alias("passing"),
        F.collect_list(F.when(F.col("_near").isNotNull(), F.struct((F.col("codon") * 3).cast("int").alias("t"), F.col("_near").alias("n")))).alias("near"),
    )
    x = cds.join(one, "orf", "left")
    zero = F.lit(0).cast("long")
    x = x.withColumns({c: F.coalesce(c, zero) for c in ("total_reads", "f0", "start_before", "start_after", "stop_before", "stop_after", "tis", "codons_with_reads", "passing")})
    # counts at 3, 6, ... below the lesser of the length and 33; sites of one position come once
    places = F.when(F.least(length, F.lit(33)) > 3, F.sequence(F.lit(3), F.least(length, F.lit(33)).cast("int") - 1, F.lit(3))).otherwise(F.array().cast("array<int>"))
    seen = F.array_sort(F.transform(places, lambda k: F.aggregate(F.coalesce("near", F.array().cast("array<struct<t:int,n:bigint>>")), zero, lambda a, s: a + F.when(s["t"] == k, s["n"]).otherwise(0))))
    x = x.withColumn("_seen", seen).withColumn("_m", F.size("_seen"))
    middle = F.when(F.col("_m") == 0, 0.0).otherwise((F.get("_seen", F.expr("(_m - 1) div 2").cast("int")) + F.get("_seen", F.expr("_m div 2").cast("int"))) / 2.0)
    share = lambda a, b: F.coalesce(a / F.nullif(b, zero), F.lit(0.0))
    mean0 = share(F.col("f0"), codon_count)
    return x.select(
        *cds.columns, "total_reads", (F.col("total_reads") / length).alias("read_density"), share(F.col("f0"), F.col("total_reads")).alias("PIF"), share(F.col("passing"), codon_count).alias("Uniformity"),
        share(F.col("start_after"), F.col("start_before") + F.col("start_after")).alias("StartIncrease"), share(F.col("stop_before"), F.col("stop_before") + F.col("stop_after")).alias("DropOff"),
        F.when(mean0 > 0, F.col("tis") / mean0).otherwise(0.0).alias("TIS_global_enrich"), ((F.col("tis") + 1.0) / (middle + 1.0)).alias("TIS_local_score"), codon_count.alias("codon_count"), "codons_with_reads", "start_before", "start_after", "stop_before", "stop_after",
    )


def frames(hits: DataFrame, least_reads: int = 50) -> DataFrame:
    """frame, count, proportion, total over the CDSs with enough reads. hits: orf, t, n inside CDSs."""
    n = hits.groupBy("orf", (F.col("t") % 3).alias("frame")).agg(F.sum("n").alias("n"))
    enough = n.groupBy("orf").agg(F.sum("n").alias("all")).filter(F.col("all") >= least_reads).select("orf")
    one = n.join(enough, "orf", "left_semi").agg(*[F.coalesce(F.sum(F.when(F.col("frame") == f, F.col("n"))), F.lit(0)).cast("long").alias(f"f{f}") for f in range(3)])
    total = F.col("f0") + F.col("f1") + F.col("f2")
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("frame"), F.col(f"f{f}").alias("count"), F.coalesce(F.col(f"f{f}") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("proportion"), total.alias("total")) for f in range(3)])))


def profile(hits: DataFrame, bins: int = 100, least_reads: int = 50) -> DataFrame:
    """bin, mean_count_per_cds, f0, f1, f2: reads by place in the CDS, over all CDSs with enough reads, divided by their number; empty bins stay.

    hits: orf, t, n, length inside CDSs."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("t") * bins / F.col("length"))))
    by = hits.groupBy("orf", at.cast("long").alias("bin"), (F.col("t") % 3).alias("frame")).agg(F.sum("n").alias("n"))
    enough = by.groupBy("orf").agg(F.sum("n").alias("all")).filter(F.col("all") >= least_reads).select("orf")
    number = enough.agg(F.count(F.lit(1)).alias("cds"))
    sums = by.join(enough, "orf", "left_semi").groupBy("bin").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("frame") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(3)])
    grid = hits.sparkSession.range(bins).select(F.col("id").alias("bin"))
    mean = lambda c: F.coalesce(F.col(c) / F.nullif("cds", F.lit(0)), F.lit(0.0))
    # one row of the number
    return grid.join(sums, "bin", "left").join(F.broadcast(number)).select("bin", mean("n").alias("mean_count_per_cds"), *[mean(f"n{f}").alias(f"f{f}") for f in range(3)])


def patterns(codons: DataFrame, trim_start: int = 45, trim_stop: int = 30, least_reads: int = 3) -> DataFrame:
    """The codons (orf, codon, c0, c1, c2, length) that templates are made of: away from both ends, with enough reads."""
    first, last = -(-trim_start // 3), F.floor((F.col("length") - trim_stop) / 3)
    return codons.filter((F.col("codon") >= first) & (F.col("codon") < last) & (F.col("c0") + F.col("c1") + F.col("c2") >= least_reads))


def background(template_row: DataFrame, a0: DataFrame, least_a0: float = 0.5) -> DataFrame:
    """pi0, pi1, pi2, A, status: failed_low_a0 where the concentration is under its least value, failed without codons.

    template_row: one row of pi0, pi1, pi2, n_codons; a0: one row of a0."""
    if least_a0 <= 0:
        raise ValueError("the least concentration must be positive")
    status = F.when(F.coalesce(F.col("n_codons"), F.lit(0)) == 0, "failed").when(F.col("a0") < least_a0, "failed_low_a0").otherwise("success")
    return template_row.join(F.broadcast(a0.select("a0"))).select("pi0", "pi1", "pi2", F.col("a0").alias("A"), status.alias("template_status"))


def vertices(lattice_rows: DataFrame, resolution: int = 20) -> DataFrame:
    """v0, v1, v2: percent of codons at the corners. lattice_rows as from `ternary`."""
    corner = lambda f: F.coalesce(F.max(F.when(F.col(f"g{f}") == resolution, F.col("percent"))), F.lit(0.0)).alias(f"v{f}")
    return lattice_rows.agg(*[corner(f) for f in range(3)])


def mean_shares(codons: DataFrame, times: Column | None = None) -> DataFrame:
    """m0, m1, m2: codon-equal mean of the phases in percent; 0 without codons."""
    n, times = F.col("c0") + F.col("c1") + F.col("c2"), _times(times)
    return codons.filter(n > 0).agg(*[F.coalesce(F.lit(100.0) * F.sum(F.col(f"c{f}") / n * times) / F.sum(times), F.lit(0.0)).alias(f"m{f}") for f in range(3)])


def corners_and_means(codons: DataFrame, resolution: int = 20, times: Column | None = None) -> DataFrame:
    """v0, v1, v2, m0, m1, m2: `vertices` of `ternary`, and `mean_shares`, in one pass; zeros without codons."""
    n = F.col("c0") + F.col("c1") + F.col("c2")
    phases = [F.col(f"c{f}") for f in range(3)]
    x = codons.filter(n > 0).select(*phases, n.alias("n"), _times(times).alias("_times"), *lattice(phases, resolution))
    times, total = F.col("_times"), F.sum("_times")
    share = lambda part, name: F.coalesce(F.lit(100.0) * F.sum(part) / total, F.lit(0.0)).alias(name)
    return x.agg(*[share(F.when(F.col(f"g{f}") == resolution, times).otherwise(0), f"v{f}") for f in range(3)], *[share(F.col(f"c{f}") / F.col("n") * times, f"m{f}") for f in range(3)])


def ternary_xy(p0: Column, p2: Column) -> tuple[Column, Column]:
    """Place of shares in a triangle with sides of 1."""
    return 0.5 * p0 + p2, F.lit(math.sqrt(3) / 2) * p0


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean, median, n of the columns, numbers only; zeros where there is no row."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    one = rows.agg(*[x for c in columns for x in (F.avg(number(c)).alias(f"{c}_a"), F.median(number(c)).alias(f"{c}_m"))], F.count(F.lit(1)).alias("_n"))
    some = lambda x: F.when(F.col("_n") == 0, 0.0).otherwise(F.col(x))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), some(f"{c}_a").alias("mean"), some(f"{c}_m").alias("median"), F.col("_n").alias("n")) for c in columns])))
