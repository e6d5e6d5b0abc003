"""Command line: ``python -m strandflow COMMAND ...``. Reads are Parquet of (read_id, channel, number, start_sample, signal), or fast5."""

from __future__ import annotations

import argparse
import sys
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import model as models
from strandflow.operators import dtw, index, masking, pafstats, presets, simulate, yields
from strandflow.operators.mapper import K, MapConfig, Mapper, map_reads
from strandflow.sources import chunks, readers
from strandflow.streaming import realtime


def _model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Levels and deviations by k-mer (4^k rows) of a model file; ``rule`` is the model made by rule, for trials."""
    table = models.rule_model(spark) if path == "rule" else models.read_model(spark, path)
    rows = {r.kmer: (r.level_mean, r.level_stdv) for r in table.collect()}
    if set(rows) != set(range(4**K)):
        raise SystemExit(f"{path} has no level for some {K}-mer")
    both = np.array([rows[i] for i in range(4**K)])
    return both[:, 0], both[:, 1]


def _sequences(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """A reference's sequences, once their size is known to be within the limit."""
    seqs = readers.read_fasta(spark, path)
    if (size := seqs.agg(F.sum(F.char_length("seq") + 1)).first()[0] or 0) > index.MAX_BASES:
        raise SystemExit(f"references are limited to {index.MAX_BASES} bases; {path} has {size}")
    return [(r.name, r.seq) for r in seqs.orderBy("name").collect()]


def _mapper(spark: SparkSession, a):
    """(build, name) of the mapper that the options ask for: a stored index is read and broadcast, a FASTA file is sorted in each worker."""
    mean, stdv = _model(spark, a.model)
    conf = MapConfig()
    if a.presets:
        conf = MapConfig(thresholds=tuple(readers.pick_preset(readers.read_presets(spark, a.presets), a.preset)))
    ref, sa = index.load_index(spark, a.index) if a.index else (index.Reference(_sequences(spark, a.fasta)), None)
    shipped = spark.sparkContext.broadcast((ref, sa))
    return lambda: Mapper(shipped.value[0], mean, stdv, conf, shipped.value[1]), f"{a.index or a.fasta}:{a.model}:{a.presets}:{a.preset}:{uuid.uuid4().hex}"


def _reads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "fast5":
        from strandflow.sources.fast5 import Fast5

        spark.dataSource.register(Fast5)
        return spark.read.format("fast5").load(path)
    return spark.read.parquet(path)


def index_(spark, a) -> None:
    """Stores the index of a reference and searches its presets."""
    seqs = readers.read_fasta(spark, a.fasta).withColumn("seq", F.upper("seq"))
    index.store_index(spark, _sequences(spark, a.fasta), f"{a.out}/index")
    targets = {"default": {"speed": a.speed}} | ({"prob": {"prob": a.prob}} if a.prob else {})
    readers.write_presets(presets.search_presets(seqs, "name", *_model(spark, a.model), targets), f"{a.out}/presets")


def _records(reads: DataFrame, mapped: DataFrame) -> DataFrame:
    """Alignment records of mapped reads, with the map time and the read's start and channel as tags."""
    own = [c for c in ("channel", "start_sample") if c in reads.columns]
    sizes = reads.select("rid", F.col("read_id").cast("string").alias("qr_name"), *own).dropDuplicates(["rid"])
    out = sizes.join(mapped.withColumnsRenamed({"read_id": "b_id", "matches": "match_num"}).dropDuplicates(["b_id"]), F.col("rid") == F.col("b_id"))
    tags = F.create_map().cast("map<string,struct<type:string,value:string>>")
    for name, value, kind in (("mt", F.round("mt", 6), "f"), ("ch", F.col("channel") if "channel" in own else None, "i"), ("st", F.col("start_sample") if "start_sample" in own else None, "i")):
        tags = tags if value is None else pafstats.set_tag(tags, name, value, kind)
    return out.withColumn("tags", tags)


def map_(spark, a) -> None:
    """Maps reads to all sequences of the reference at once."""
    reads = _reads(spark, a.reads, a.format)
    if a.ids:
        reads = readers.only_reads(reads, spark.read.text(a.ids).select(F.btrim("value").alias("read_id")), a.max_reads)
    reads = reads.withColumn("rid", F.xxhash64("read_id"))
    found = map_reads(reads.select(F.col("rid").alias("read_id"), "signal"), *_mapper(spark, a))
    readers.write_paf(_records(reads, found), a.out)


def replay(spark, a) -> None:
    """Maps reads chunk by chunk in the order of each channel, as a device would bring them."""
    cut = chunks.from_reads(_reads(spark, a.reads, a.format), a.chunk)
    realtime.run_channels(cut, *_mapper(spark, a), max_chunks=a.max_chunks).write.parquet(a.out)


def yield_(spark, a) -> None:
    """What a run yields against its control, by a genome's sequences or by intervals of its reads."""
    s = readers.read_summary(spark, a.summary)
    s = s.select("read_id", "duration", (F.col("template_start") - F.col("start_time")).alias("template_start"), "template_duration", F.col("sequence_length_template").alias("bases"))
    calls = readers.read_paf(spark, a.paf)
    if a.bed:
        out = yields.bed_yield(s, calls, readers.read_bed(spark, a.bed), a.sim_speed)
    else:
        names = readers.read_annotations(spark, a.annotation) if a.annotation else readers.read_fasta(spark, a.fasta).select("name")
        out = yields.genome_yield(s, calls, yields.target_reads(readers.read_paf(spark, a.truth), names, a.deplete), a.sim_speed)
    out.show(truncate=False)
    yields.median_delay(yields.eject_delays(s, calls)).show(truncate=False)
    yields.run_seconds(calls).show(truncate=False)


def warp_(spark, a) -> None:
    """Warps reads onto spans of sequences."""
    mean, stdv = _model(spark, a.model)
    found = dtw.warp_reads(_reads(spark, a.reads, a.format), readers.read_dtw_queries(spark, a.queries), readers.read_fasta(spark, a.fasta), mean, by_event=not a.raw, stdv=stdv if a.likelihood else None)
    found.write.csv(a.out, sep="\t")


def pafstats_(spark, a) -> None:
    calls = readers.read_paf(spark, a.paf, a.max_reads)
    calls.agg(F.count(F.lit(1)).alias("reads"), F.count_if("is_mapped").alias("mapped")).show(truncate=False)
    if a.truth:
        truth = readers.read_paf(spark, a.truth)
        pafstats.confusion(pafstats.classify(calls, truth.withColumn("rn", F.monotonically_increasing_id()))).orderBy("cls").show()
    pafstats.speed(calls.withColumn("mt", pafstats.tag("mt").cast("double")).filter("mt > 0")).show(truncate=False)


def sim(spark, a) -> None:
    s = readers.read_schedule(spark, a.schedule)
    gaps = s["gaps"].groupBy("ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "len"))), lambda x: x["len"].cast("double")).alias("gaps"))
    spans = s["itvs"].groupBy("ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "st", "en"))), lambda x: F.struct(x["st"].cast("double").alias("st"), x["en"].cast("double").alias("en"))).alias("intervals"))
    lengths = s["reads"].join(_reads(spark, a.reads, a.format).select(F.col("read_id").cast("string").alias("read_id"), F.size("signal").alias("len")), "read_id").groupBy("ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "read_id", "len"))), lambda x: x["len"].cast("double")).alias("lengths"))
    simulate.timeline(spans.join(gaps, "ch").join(lengths, "ch").withColumnRenamed("ch", "channel")).write.parquet(a.out)


def realtime_(spark, a) -> None:
    """Maps a stream of chunks and writes a decision for each read; scans (Parquet of st, en in samples, few) put ejections off."""
    live = chunks.stream(spark, a.chunks)
    if a.parity:
        live = live.filter(realtime.channel_parity(F.col("channel"), a.parity))
    done = realtime.run_channels(live, *_mapper(spark, a), max_chunks=a.max_chunks)
    scans = [(r.st, r.en) for r in spark.read.parquet(a.scans).collect()] if a.scans else []
    in_scan = F.lit(False)
    for st, en in scans:
        in_scan = in_scan | F.col("at_sample").between(st, en)
    out = done.withColumn("decision", realtime.decide(F.col("outcome") == "ended", F.col("outcome") == "mapped", in_scan, a.mode))
    out.writeStream.format("parquet").option("path", a.out).option("checkpointLocation", a.checkpoint).trigger(availableNow=True).start().awaitTermination()


def mask(spark, a) -> None:
    seqs = readers.read_fasta(spark, a.fasta)
    if a.reference:
        spans = masking.external_repeats(seqs, readers.read_fasta(spark, a.reference), a.k, a.min_copy, by="name")
        seqs = masking.apply_mask(seqs, spans, by="name")
    else:
        seqs = masking.mask_internal(seqs, a.k, a.rounds)
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandflow")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        c.set_defaults(run=run)
        for flag, kw in options:
            c.add_argument(flag, **kw)

    need, count = {"required": True}, {"type": int}
    reads = [("--reads", need), ("--format", {"choices": ["parquet", "fast5"], "default": "parquet"})]
    mapper = [("--fasta", {}), ("--index", {"help": "a stored index"}), ("--model", need), ("--presets", {}), ("--preset", {"default": ""})]
    command("index", index_, ("--fasta", need), ("--out", need), ("--model", need), ("--speed", {"type": float, "default": 115.0}), ("--prob", {"type": float}))
    command("map", map_, *mapper, *reads, ("--out", need), ("--ids", {}), ("--max-reads", count))
    command("replay", replay, *mapper, *reads, ("--out", need), ("--chunk", count | {"default": 4000}), ("--max-chunks", count | {"default": 10}))
    command("yield", yield_, ("--summary", need), ("--paf", need), ("--truth", {}), ("--fasta", {}), ("--annotation", {}), ("--bed", {}), ("--deplete", {"action": "store_true"}), ("--sim-speed", {"type": float, "default": 1.0}))
    command("warp", warp_, ("--queries", need), ("--fasta", need), ("--model", need), *reads, ("--out", need), ("--raw", {"action": "store_true"}), ("--likelihood", {"action": "store_true"}))
    command("pafstats", pafstats_, ("--paf", need), ("--truth", {}), ("--max-reads", count))
    command("sim", sim, ("--schedule", need), *reads, ("--out", need))
    command("realtime", realtime_, *mapper, ("--chunks", need), ("--out", need), ("--checkpoint", need), ("--scans", {}), ("--mode", {"choices": ["enrich", "deplete"], "default": "enrich"}), ("--parity", {"choices": ["even", "odd"]}), ("--max-chunks", count | {"default": 10}))
    command("mask", mask, ("--fasta", need), ("--reference", {}), ("--out", need), ("--k", count | {"default": 10}), ("--rounds", count | {"default": 30}), ("--min-copy", count | {"default": 1}))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
