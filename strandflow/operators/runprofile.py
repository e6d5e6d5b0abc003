"""Profiles of a run: gaps, blocks, scans, channel activity, read allocation. Times are integers of one unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.intervals import merge


def in_time(summary: DataFrame, lo: int, hi: int) -> DataFrame:
    return summary.filter((F.col("st") >= lo) & (F.col("en") <= hi))


def channel_gaps(summary: DataFrame) -> DataFrame:
    """The gap before each read of its channel; the first one's starts at 0."""
    w = Window.partitionBy("channel").orderBy("st", "read_id")
    before = F.lag("en", 1, 0).over(w)
    return summary.select("channel", "read_id", before.cast("long").alias("gap_st"), (F.col("st") - before).alias("gap_len"))


def long_gaps(gaps: DataFrame) -> DataFrame:
    """Per channel: gaps over its median plus one population standard deviation."""
    limit = gaps.groupBy("channel").agg((F.median("gap_len") + F.stddev_pop("gap_len")).alias("limit"))
    return gaps.join(limit, "channel").filter(F.col("gap_len") >= F.col("limit"))


def channel_counts(summary: DataFrame, channels: int) -> DataFrame:
    """Reads of each channel 1..channels, 0 where it has none."""
    n = summary.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    all_ = summary.sparkSession.range(1, channels + 1).select(F.col("id").alias("channel"))
    return all_.join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mux_majority(summary: DataFrame, by: str = "channel", share: float = 0.95) -> DataFrame:
    """The commonest mux of each group (of ties the larger), its share and whether that is dominant."""
    n = summary.groupBy(by, "mux").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(by).agg(F.max(F.struct("n", "mux")).alias("top"), F.sum("n").alias("total"))
    return top.select(by, F.col("top.mux").alias("mux"), F.round(F.col("top.n") / F.col("total"), 4).alias("share"), (F.col("top.n") / F.col("total") >= share).alias("dominant"))


def blocks(summary: DataFrame, gap: int, by: str = "channel") -> DataFrame:
    """Reads that start at most ``gap`` after all earlier ones have ended form a block."""
    return merge(summary, [by], "st", "en", gap)


def rank_channels(counts: DataFrame) -> DataFrame:
    return counts.withColumn("place", F.row_number().over(Window.orderBy("n", "channel")).cast("long"))


def _grow_scan(found: list[tuple[float, float, int, float]], first: int, limit: float, share: float) -> tuple[int, tuple[float, float] | None]:
    """The scan that block ``first`` (mux 1) opens: (where to look for the next opening, the scan if it gets to mux 4).

    A block goes on with the scan if it comes within ``limit`` of the scan's end and has a dominant mux, the same as the
    last one's or the next. The next mux moves the end; the same one moves it if the block ends within ``limit`` of it.
    """
    begin, have, end = found[first][0], 1, found[first][1]
    lead = begin - (found[first - 1][1] if first else 0.0)
    for j in range(first + 1, len(found)):
        st, en, mux, part = found[j]
        far = st - end > limit
        if far or part < share or mux - have not in (0, 1):
            done = (begin - lead, end if far else st) if have == 4 else None
            # a block that is far away, or has a dominant mux after a whole scan, may open the next
            return (j if far or (done and part >= share) else j + 1), done
        if mux > have or en - end < limit:
            have, end = mux, en
        elif mux == 1:
            return j, None
    return len(found), None


def assemble_scans(found: list[tuple[float, float, int, float]], limit: float = 20.0, share: float = 0.95) -> list[tuple[float, float]]:
    """Mux scans in ordered blocks (start, end, mux, share): four dominant muxes 1 to 4 in a row.

    Each is given from the end of the block before it to the start of the block after it (to its own end where that is far
    away). A scan that the run ends in is left out. Blocks of a run are few (a scan makes four).
    """
    out, at = [], 0
    while at < len(found):
        if found[at][2] != 1 or found[at][3] < share:
            at += 1
            continue
        at, scan = _grow_scan(found, at, limit, share)
        out += [scan] if scan else []
    return out


def mux_scans(summary: DataFrame, gap: float = 1.0, limit: float = 20.0, share: float = 0.95, width: float = 3600.0) -> DataFrame:
    """(scan_st, scan_en) of the mux scans of a run: blocks of all channels' reads, each block's commonest mux, then ``assemble_scans``.

    Blocks are merged within stretches of ``width`` first, so that the one ordered pass sees blocks and not reads.
    """
    from strandflow.functions.intervals import range_join

    st, en = F.col("st").cast("double"), F.col("en").cast("double")
    reads = summary.select("mux", st.alias("st"), en.alias("en"))
    whole = merge(reads.withColumn("run", F.lit(0)), ["run"], "st", "en", gap, width).select(F.col("st").alias("block"), F.col("en").alias("block_en"))
    top = mux_majority(range_join(reads, "st", whole.withColumn("_to", F.col("block_en") + gap / 2), "block", "_to", width), "block", share)
    found = sorted(tuple(r) for r in whole.join(top, "block").select("block", "block_en", "mux", "share").collect())  # one row a block
    return summary.sparkSession.createDataFrame(assemble_scans(found, limit, share), "scan_st double, scan_en double")


def remove_scans(summary: DataFrame, scans: DataFrame) -> DataFrame:
    """Reads inside a scan go; later ones move up by the length of the scans before them. Scans (scan_st, scan_en) are few
    (some tens a run) and travel as one array, so that every row is handled on its own, repeated ones too."""
    one = scans.agg(F.array_sort(F.collect_list(F.struct("scan_st", "scan_en"))).alias("_scans"))
    st, en = F.col("st"), F.col("en")
    inside = lambda x: (st >= x["scan_st"]) & (en <= x["scan_en"])
    before = F.filter("_scans", lambda x: (x["scan_st"] <= en) & (x["scan_st"] <= st))
    rows = summary.crossJoin(F.broadcast(one)).withColumn("_before", before)
    rows = rows.filter(~F.exists("_before", inside)).withColumn("_shift", F.aggregate("_before", en - en, lambda s, x: s + (x["scan_en"] - x["scan_st"])))
    return rows.select("channel", "read_id", (st - F.col("_shift")).alias("st"), (en - F.col("_shift")).alias("en"))


def activity(gaps: DataFrame, limit: int) -> DataFrame:
    """Active intervals of each channel: what lies between its gaps of at least ``limit``."""
    w = Window.partitionBy("channel").orderBy("gap_st", "read_id")
    flagged = gaps.withColumn("part", F.sum(F.when(F.col("gap_len") >= limit, 1).otherwise(0)).over(w))
    return flagged.groupBy("channel", "part").agg(F.min(F.col("gap_st") + F.col("gap_len")).alias("st"), F.max("gap_st").alias("en"), F.count(F.lit(1)).alias("n"))


def allocation(counts: DataFrame, total: int, least: int) -> DataFrame:
    """Targets of reads per channel: ``least`` (0 for a channel without reads) and a share of the rest by what the channel has over it,
    rounded half to even, and mended by one from the last channel backwards until they add up to ``total``. Where no channel has anything over, targets are plain shares. One row a channel."""
    w = Window.partitionBy()
    df = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    df = df.withColumn("least", F.when(F.col("n") > 0, least).otherwise(0)).withColumn("remain", F.lit(total) * F.col("share") - F.col("least")).withColumn("over", F.greatest("remain", F.lit(0.0)))
    df = df.withColumn("raw", F.col("least") + F.sum("remain").over(w) * F.col("over") / F.nullif(F.sum("over").over(w), F.lit(0.0))).withColumn("raw", F.coalesce("raw", F.lit(total) * F.col("share"))).withColumn("target", F.bround("raw").cast("long"))
    df = df.withColumn("error", F.lit(total) - F.sum("target").over(w)).withColumn("back", F.row_number().over(Window.orderBy(F.col("channel").desc())))
    mended = F.col("target") + F.when(F.col("back") <= F.abs("error"), F.signum("error").cast("long")).otherwise(0)
    return df.select("channel", "n", mended.alias("target"))


def donate(targets: DataFrame) -> DataFrame:
    """Reads that channels have over their targets go, in order, to slots that others lack: (from_channel, to_channel, slot)."""
    by = lambda c: Window.orderBy(c, "channel", "k")
    spare = targets.filter("n > target").select("channel", (F.col("n") - F.col("target")).alias("more"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("target"))).alias("k"))
    lack = targets.filter("n < target").select("channel", F.explode(F.sequence(F.lit(1).cast("long"), F.col("target") - F.col("n"))).alias("k"))
    a = spare.select(F.row_number().over(by(F.col("more").desc())).alias("slot"), F.col("channel").alias("from_channel"))
    b = lack.select(F.row_number().over(by("channel")).alias("slot"), F.col("channel").alias("to_channel"))
    return a.join(b, "slot")


def gaps_by_scan(gaps: DataFrame, bounds: DataFrame) -> DataFrame:
    """Gaps (gap_st, gap_len) with the number ``scan`` of the stretch between two bounds (``bound``, few) that holds them whole; others go."""
    order = Window.orderBy("bound")  # a run's bounds are few
    spans = bounds.select((F.row_number().over(order) - 1).cast("long").alias("scan"), F.col("bound").alias("_lo"), F.lead("bound").over(order).alias("_hi")).filter("_hi is not null")
    return gaps.join(F.broadcast(spans), (F.col("gap_st") > F.col("_lo")) & (F.col("gap_st") + F.col("gap_len") <= F.col("_hi"))).drop("_lo", "_hi")


def scan_pauses(intervals: DataFrame, pause: float) -> DataFrame:
    """Active intervals (channel, i, st, en) of a simulated run with a scan of ``pause`` after each round of them: (channel, i, st, en).

    A round ends when the last channel's interval has; all channels' next intervals then wait for the scan to end.
    """
    rounds = intervals.groupBy("i").agg(F.max(F.col("en") - F.col("st")).alias("long"))
    before = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # one row a round
    begin = rounds.select(F.col("i").alias("_i"), (F.coalesce(F.sum("long").over(before), F.lit(0.0)) + (F.row_number().over(Window.orderBy("i")) - 1) * pause).alias("_begin"))
    return intervals.join(F.broadcast(begin), F.col("i") == F.col("_i")).select("channel", "i", F.col("_begin").alias("st"), (F.col("_begin") + F.col("en") - F.col("st")).alias("en"))
