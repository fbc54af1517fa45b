"""Offset selection and P-site placement from alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bases of a bin when sites of one chromosome are dealt to tasks.
BIN = 1 << 20


def rotate(frames: list[Column], offset: Column, reference: int = 12) -> list[Column]:
    """Frame counts after an offset other than the reference one is applied."""
    turn = lambda f: F.pmod(F.lit(f) - (offset - reference), F.lit(3))
    return [F.element_at(F.array(*frames), (turn(f) + 1).cast("int")) for f in range(3)]


def dominant_block(rows: DataFrame) -> DataFrame:
    """rows(length, reads): the run of consecutive lengths with most reads, then most lengths, then the earliest."""
    w = W.orderBy("length")  # a few dozen read lengths
    x = rows.withColumn("island", F.col("length") - F.row_number().over(w))
    best = x.groupBy("island").agg(F.sum("reads").alias("reads"), F.count(F.lit(1)).alias("n"), F.min("length").alias("first"))
    best = best.agg(F.max_by("island", F.struct("reads", "n", -F.col("first"))).alias("island"))
    return x.join(F.broadcast(best), "island").select("length")


#: The anchor of quality counts, and the columns of the audit of offsets.
QC_OFFSET = 12
AUDIT = (
    "selection_mode", "quality_group", "ribotish_qc_offset", "min_frame0_proportion", "length_selection_policy", "length", "offset", "matched_reads", "raw_frame0", "raw_frame1", "raw_frame2", "corrected_frame0",
    "corrected_frame1", "corrected_frame2", "corrected_frame0_proportion", "selected", "reason",
)


def select_offsets(support: DataFrame, least_share: tuple[int, int] = (2, 3), policy: str = "dominant_contiguous", whitelist: list[int] | None = None) -> DataFrame:
    """support(length, offset, reads, f0, f1, f2; nulls where a length has no offset or no counts): the audit, a row for each length.

    A length passes if the corrected counts of phase 0 are over the share (a fraction, compared in integers), and it is
    in the whitelist, if there is one; of those the dominant run of consecutive lengths is selected, or all."""
    if policy not in ("dominant_contiguous", "all_passing"):
        raise ValueError(f"unknown policy: {policy}")
    if whitelist is not None and (not whitelist or min(whitelist) <= 0):
        raise ValueError("the whitelist must hold positive read lengths")
    top, bottom = least_share
    valid = (F.col("offset") >= 0) & (F.col("offset") < F.col("length"))
    counted = F.col("f0").isNotNull()
    p = rotate([F.col(f"f{k}") for k in range(3)], F.col("offset"), QC_OFFSET)
    x = support.select("*", *[F.when(valid & counted, c).alias(f"p{k}") for k, c in enumerate(p)])
    total = F.col("p0") + F.col("p1") + F.col("p2")
    kept = F.lit(True) if whitelist is None else F.col("length").isin(*whitelist)
    why = (
        F.when(F.col("offset").isNull(), "missing_main_offset").when(~valid, "invalid_offset").when(~counted, "missing_matched_frame_counts").when(total == 0, "no_matched_frame_reads")
        .when(F.col("p0") * bottom <= total * top, "frame0_not_above_threshold").when(~kept, "not_in_keep_lengths")
    )
    x = x.withColumn("why", why)
    if policy == "dominant_contiguous":
        weight = F.coalesce("reads", F.col("f0") + F.col("f1") + F.col("f2")).alias("reads")
        block = dominant_block(x.filter("why is null").select("length", weight)).withColumn("inside", F.lit(True))
        x = x.join(F.broadcast(block), "length", "left")
        x = x.withColumn("why", F.coalesce("why", F.when(F.col("inside").isNull(), "outside_dominant_contiguous_block")))
    return x.select(
        F.lit("ribotish_quality").alias("selection_mode"), F.lit("5prime_match").alias("quality_group"), F.lit(QC_OFFSET).alias("ribotish_qc_offset"), F.lit(top / bottom).alias("min_frame0_proportion"), F.lit(policy).alias("length_selection_policy"),
        "length", "offset", F.col("reads").alias("matched_reads"), *[F.col(f"f{k}").alias(f"raw_frame{k}") for k in range(3)], *[F.col(f"p{k}").alias(f"corrected_frame{k}") for k in range(3)],
        (F.col("p0") / F.nullif(total, F.lit(0))).alias("corrected_frame0_proportion"), F.col("why").isNull().cast("int").alias("selected"), F.coalesce("why", F.lit("selected_quality")).alias("reason"),
    )


def override_offsets(support: DataFrame, whitelist: list[int]) -> DataFrame:
    """The audit where no quality counts are at hand: support(length, offset) and the lengths to keep decide."""
    if not whitelist or min(whitelist) <= 0:
        raise ValueError("the whitelist must hold positive read lengths")
    lengths = support.sparkSession.createDataFrame([(x,) for x in sorted(set(whitelist))], "length int").withColumn("kept", F.lit(True))
    x = support.select("length", "offset").join(lengths, "length", "full")
    why = F.when(F.col("kept").isNull(), "not_in_keep_lengths").when(F.col("offset").isNull(), "missing_main_offset").when((F.col("offset") < 0) | (F.col("offset") >= F.col("length")), "invalid_offset")
    return _plain_audit(x.withColumn("why", why), "explicit_keep_lengths", "selected_explicit_override")


def explicit_offsets(spark: SparkSession, offsets: dict[int, int]) -> DataFrame:
    """The audit of lengths and offsets that the user gave: all are selected."""
    if bad := {n: o for n, o in offsets.items() if n <= 0 or not 0 <= o < n}:
        raise ValueError(f"bad lengths and offsets: {bad}")
    rows = spark.createDataFrame(sorted(offsets.items()), "length int, offset int").withColumn("why", F.lit(None).cast("string"))
    return _plain_audit(rows, "explicit_length_offsets", "selected_explicit_length_offset")


def _plain_audit(x: DataFrame, mode: str, selected: str) -> DataFrame:
    found = {"selection_mode": F.lit(mode), "quality_group": F.lit(""), "length_selection_policy": F.lit(mode), "length": F.col("length"), "offset": F.col("offset"), "selected": F.col("why").isNull().cast("int"), "reason": F.coalesce("why", F.lit(selected))}
    return x.select(*[found.get(c, F.lit(None).cast("double" if c.endswith("proportion") else "long")).alias(c) for c in AUDIT])


def cigar_ops(cigar: Column) -> Column:
    """array of (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def five_prime_query(ops: Column, reverse: Column) -> Column:
    """Query index of the 5' aligned base: after the first soft clip forward, before the last one on reverse."""
    clip = lambda o: F.when(o["op"] == "S", o["n"]).otherwise(0)
    inner = F.filter(ops, lambda o: o["op"] != "H")
    length = F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0))
    return F.when(reverse, length - 1 - clip(F.try_element_at(inner, F.lit(-1)))).otherwise(clip(F.try_element_at(inner, F.lit(1))))


def five_prime_match(md: Column, reverse: Column) -> Column:
    """Whether the base at the 5' end matches, from the MD text: its first token from that end that isn't a deletion or 0."""
    tokens = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), F.lit(1))
    seen = F.filter(tokens, lambda t: ~t.startswith("^") & (t != "0"))
    return F.when(reverse, F.try_element_at(seen, F.lit(-1))).otherwise(F.try_element_at(seen, F.lit(1))).rlike("^[0-9]")


def reference_position(ops: Column, pos0: Column, query: Column) -> Column:
    """Reference position of a query index; null inside an insertion or clip, or outside the read."""
    start = F.struct(F.lit(0).alias("q"), pos0.cast("long").alias("r"), F.lit(None).cast("long").alias("hit"))

    def step(s: Column, o: Column) -> Column:
        both, eats, moves = o["op"].isin("M", "=", "X"), o["op"].isin("I", "S"), o["op"].isin("D", "N")
        inside = both & (query >= s["q"]) & (query < s["q"] + o["n"])
        return F.struct(
            F.when(both | eats, s["q"] + o["n"]).otherwise(s["q"]).alias("q"), F.when(both | moves, s["r"] + o["n"]).otherwise(s["r"]).alias("r"),
            F.when(inside, s["r"] + query - s["q"]).otherwise(s["hit"]).alias("hit"),
        )

    return F.aggregate(ops, start, step, lambda s: s["hit"])


def call(reads: DataFrame, offsets: DataFrame, min_mapq: int = 20) -> DataFrame:
    """reads(qname, flag, rname, pos0, mapq, cigar, md, nh): with offset, reason (null if called) and psite.

    reads may have seq; then `base` is the base at the P-site, N outside. Unmapped, secondary and supplementary reads are dropped; the other filters are in order, and the first
    that fails is the reason. offsets(length, offset) has a row for each read length used."""
    x = reads.filter(F.expr("flag & (4 | 256 | 2048) = 0")).withColumn("reverse", F.expr("flag & 16 != 0"))
    reverse = F.col("reverse")

    def once(value: Column, use) -> Column:
        """use(value), where the value is worked out once a row."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def ends(ops: Column) -> Column:
        seen = F.filter(ops, lambda o: ~o["op"].isin("H", "D", "N"))
        return F.when(reverse, F.try_element_at(seen, F.lit(-1))).otherwise(F.try_element_at(seen, F.lit(1)))["op"]

    length = lambda ops: F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "I", "S", "=", "X"), o["n"]).otherwise(0))
    walk = once(cigar_ops(F.col("cigar")), lambda ops: F.struct(ops.alias("ops"), length(ops).alias("length"), five_prime_query(ops, reverse).alias("q5"), ends(ops).alias("end")))
    x = x.withColumn("walk", walk).withColumn("length", F.col("walk.length")).join(F.broadcast(offsets), "length", "left")
    at = F.when(reverse, F.col("walk.q5") - F.col("offset")).otherwise(F.col("walk.q5") + F.col("offset"))
    x = x.withColumn("site", once(at, lambda q: F.struct(q.alias("at"), reference_position(F.col("walk.ops"), F.col("pos0"), q).alias("place"))))
    end = F.col("walk.end")
    # = and X tell by themselves; only M needs the MD tag
    checked = F.when(end == "=", True).when(end == "X", False).when(F.col("md").isNull(), F.raise_error(F.lit("an alignment has no MD tag"))).otherwise(five_prime_match(F.col("md"), reverse))
    reason = (
        F.when(F.col("mapq") < min_mapq, "skipped_mapq").when(F.col("nh") != 1, "skipped_multimapper").when(F.col("offset").isNull(), "skipped_length")
        .when(~F.coalesce(end.isin("M", "=", "X"), F.lit(False)), "skipped_5p_not_aligned").when(~F.coalesce(checked, F.lit(False)), "skipped_5p_mismatch").when(F.col("site.place").isNull(), "skipped_qmap")
    )
    x = x.withColumn("reason", reason).withColumn("psite", F.when(F.col("reason").isNull(), F.col("site.place")))
    if "seq" in reads.columns:
        place = F.col("site.at")
        base = F.when((place >= 0) & (place < F.length("seq")), F.upper(F.substring("seq", place + 1, F.lit(1))))
        x = x.withColumn("base", F.when(F.col("reason").isNull(), F.coalesce(F.nullif(base, F.lit("")), F.lit("N"))))
    return x.drop("walk", "site")


def rejections(called: DataFrame) -> DataFrame:
    """reason, n: reads by the first filter that they failed, and those called."""
    return called.groupBy(F.coalesce("reason", F.lit("written")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def records(called: DataFrame) -> DataFrame:
    """The called reads as alignments of one base, with the read's length, offset and aligned length as tags (OL, PO, AL, RL) and NH."""
    aligned = F.aggregate(cigar_ops(F.col("cigar")), F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "=", "X"), o["n"]).otherwise(0))
    return called.filter("reason is null").select(
        "qname", F.when(F.col("reverse"), 16).otherwise(0).alias("flag"), "rname", F.col("psite").alias("pos0"), "mapq", F.lit("1M").alias("cigar"), (F.col("base") if "base" in called.columns else F.lit("N")).alias("seq"), F.lit("I").alias("qual"),
        F.col("length").alias("OL"), aligned.alias("AL"), F.col("offset").alias("PO"), F.col("length").alias("RL"), F.col("nh").cast("int").alias("NH"),
    )


def of_length(sites: DataFrame, length: int | None, source: str = "auto") -> DataFrame:
    """P-sites(RL, query_length) of one read length; all where it is None. source: tag, query_length, or auto (the tag, else the length)."""
    by = {"tag": F.col("RL"), "query_length": F.col("query_length"), "auto": F.coalesce("RL", "query_length")}
    if source not in by:
        raise ValueError(f"unknown source of read lengths: {source}")
    return sites if length is None else sites.filter(by[source] == length)


def check_length(sites: DataFrame, length: int | None, source: str = "auto", sample: int = 5000) -> None:
    """Raises where a filter by read length can't be meant: no P-site of a sample has it, or the source holds no lengths."""
    if length is None:
        return
    if length <= 0:
        raise ValueError("the read length must be positive")
    some = sites.limit(sample)
    n, tagged, found = some.agg(F.count(F.lit(1)), F.count("RL"), F.count_if(F.coalesce("RL", "query_length") == length)).first()
    if not n:
        raise ValueError("there are no P-sites")
    if source == "tag" and not tagged:
        raise ValueError("no P-site of the sample has a read length as tag")
    if source != "tag" and not tagged and some.filter("query_length > 1").isEmpty():
        raise ValueError("P-sites of one base have no read length of their own")
    if not found:
        raise ValueError(f"no P-site of the sample has read length {length}")


def bedgraph(sites: DataFrame, width: int = BIN) -> DataFrame:
    """chrom, strand, start0, end0, depth: runs of adjacent positions of equal depth.

    Runs are found in bins of fixed width, and those that touch a bin's edge are joined over bins, so a chromosome is
    no single task."""
    by = ["chrom", "strand", "bin"]
    w = W.partitionBy(*by).orderBy("pos")
    x = sites.withColumn("bin", F.expr(f"pos div {width}"))
    x = x.withColumn("new", F.when((F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("n").over(w) == F.col("n")), 0).otherwise(1))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = x.groupBy(*by, "run").agg(F.min("pos").alias("start0"), (F.max("pos") + 1).alias("end0"), F.max("n").alias("depth")).drop("run", "bin")
    edge = (F.col("start0") % width == 0) | (F.col("end0") % width == 0)
    v = W.partitionBy("chrom", "strand").orderBy("start0")  # two runs a bin at most
    y = runs.filter(edge).withColumn("new", F.when((F.lag("end0").over(v) == F.col("start0")) & (F.lag("depth").over(v) == F.col("depth")), 0).otherwise(1))
    y = y.withColumn("run", F.sum("new").over(v.rowsBetween(W.unboundedPreceding, 0)))
    joined = y.groupBy("chrom", "strand", "run").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"), F.max("depth").alias("depth")).drop("run")
    return runs.filter(~edge).unionByName(joined)
