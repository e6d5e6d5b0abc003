"""Streams against batches; text formats there and back."""

import numpy as np
from pyspark.sql import functions as F

from strandflow.operators import pafstats, simulate
from strandflow.operators.mapper import map_reads
from strandflow.sources import chunks, readers
from strandflow.streaming import realtime
from strandflow.streaming.normaliser import RollingScale

CHUNKS = "channel long, number long, start_sample long, samples array<double>"
MADE = (simulate.made_mapper, "made-in-tests")
FIELDS = [f for f in realtime.NAMES if f not in ("channel",)]


def made_chunks(reads=14, channels=3, size=700, bases=300):
    """Chunks of reads that follow each other on a channel, one read of noise on each."""
    ref, (mean, stdv) = simulate.make_reference(simulate.MADE_LENGTH), simulate.make_model()
    rng, out, at = np.random.default_rng(0), [], [0] * channels
    signals = [np.array(r.signal) for r in simulate.make_reads(reads, ref, mean, stdv, bases).itertuples()]
    signals += [rng.normal(90, 12, 3000) for _ in range(channels)]
    for n, x in enumerate(signals):
        ch = n % channels
        for i in range(0, len(x), size):
            out.append((ch, n, at[ch], x[i : i + size].tolist()))
            at[ch] += len(x[i : i + size])
    return out


def outcome(df):
    return sorted(tuple(r[f] for f in ["channel", *FIELDS]) for r in df.collect())


def test_stream_equals_batch_for_any_split(spark, tmp_path):
    data = made_chunks()
    want = outcome(realtime.run_channels(spark.createDataFrame(data, CHUNKS), *MADE, max_chunks=3))
    assert {"mapped", "gave_up"} <= {r[2] for r in want}
    # the same, chunk by chunk, without Spark
    mapper, plain = simulate.made_mapper(), []
    for ch in range(3):
        channel = realtime.Channel(mapper)
        for _, number, start, x in (r for r in data if r[0] == ch):
            plain += [(ch, *(row.get(f) for f in FIELDS)) for row in channel.take(mapper, number, start, np.array(x), 3)]
    assert want == sorted(plain)
    for size in (5, 1000):
        src = tmp_path / f"in{size}"
        for i, a in enumerate(range(0, len(data), size)):
            part = sorted(data, key=lambda r: r[2])[a : a + size]
            spark.createDataFrame(part, CHUNKS).coalesce(1).write.parquet(f"{src}/p{i:03d}")
        stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
        q = realtime.run_channels(stream, *MADE, max_chunks=3).writeStream.format("memory").queryName(f"o{size}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{size}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert outcome(spark.table(f"o{size}")) == want


def test_live_places_are_those_of_whole_reads(spark):
    ref, (mean, stdv) = simulate.make_reference(simulate.MADE_LENGTH), simulate.make_model()
    reads = simulate.make_reads(12, ref, mean, stdv, 300)
    df = spark.createDataFrame([(i, i, 0, s) for i, s in zip(reads.read_id.tolist(), reads.signal.tolist(), strict=True)], "channel long, number long, start_sample long, signal array<double>")
    whole = {r.read_id: r for r in map_reads(df.select(F.col("number").alias("read_id"), "signal"), *MADE).collect()}
    same = ("is_fwd", "rf_name", "rf_len", "rf_st", "rf_en", "matches")
    # one chunk a read on a channel of its own: the scale is that of the whole read
    for r in realtime.run_channels(chunks.from_reads(df, 100_000), *MADE).collect():
        assert (r.outcome == "mapped") == whole[r.number].is_mapped and [r[f] for f in same] == [whole[r.number][f] for f in same] and r.n_events == whole[r.number].events
    cut = realtime.run_channels(chunks.from_reads(df, 1000), *MADE).collect()
    home = [r for r in cut if r.outcome == "mapped" and whole[r.number].is_mapped and r.rf_st < whole[r.number].rf_en + 300 and whole[r.number].rf_st < r.rf_en + 300]
    assert len(cut) >= 10 and len(home) >= 0.9 * len(cut)


def test_channel_rules():
    mapper = simulate.made_mapper()
    noise = lambda n: np.random.default_rng(n).normal(90, 12, 400)
    c = realtime.Channel(mapper)
    take = lambda number, start, most=3: [(r["number"], r["outcome"], r["n_chunks"]) for r in c.take(mapper, number, start, noise(start), most)]
    assert take(1, 0) == [] and take(2, 400) == [(1, "ended", 1)] and take(2, 800) == [] and take(2, 1200) == [(2, "gave_up", 3)]
    assert take(2, 1600) == [] and take(3, 2000) == [] and take(3, 2400 + realtime.PATIENCE + 1) == [(3, "ended", 1)] and take(3, 30_000) == []
    seen = len(c.scale.window)
    take(4, 31_000)
    assert len(c.scale.window) > seen


def test_rolling_scale():
    s = RollingScale(10.0, 2.0, 4)
    assert s.pop().tolist() == [] and s.push(np.array([1.0, 2, 3])) == 3 and s.unread() == 3
    assert s.push(np.array([4.0, 5.0])) == 1 and s.unread() == 4 and s.skip_unread(2) == 2
    x = np.array([1.0, 2, 3, 4])
    assert np.allclose(s.pop(), (x[2:] - x.mean()) / x.std() * 2 + 10) and s.unread() == 0
    assert s.push(np.array([7.0])) == 1 and np.allclose(s.pop(), (7 - 4) / np.array([2.0, 3, 4, 7]).std() * 2 + 10)
    s.reset(3)
    assert s.push(np.full(3, 5.0)) == 3 and s.pop().tolist() == [10.0] * 3


def test_event_time_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "ev")
    events.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = realtime.tumbling(stream, "ts", "1 day").writeStream.format("memory").queryName("tw").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tw").collect())) == sorted(map(tuple, realtime.tumbling(events, "ts", "1 day").collect()))


def test_decisions(spark):
    df = spark.createDataFrame([(e, m, s) for e in (True, False) for m in (True, False) for s in (True, False)], "e boolean, m boolean, s boolean")
    got = [tuple(r) for r in df.select(*[realtime.decide(F.col("e"), F.col("m"), F.col("s"), mode) for mode in ("enrich", "deplete")]).collect()]
    assert got == [("en", "en")] * 4 + [("kp", "mx"), ("kp", "ej"), ("mx", "kp"), ("ej", "kp")]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one", "ACGTAC"), ("two", "GG")]
    (tmp_path / "a.bed").write_text("c 1 5 r1\nc\t7\t9\tr2\n")
    assert [tuple(r) for r in readers.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("c", 1, 5, "r1"), ("c", 7, 9, "r2")]
    (tmp_path / "a.ann").write_text("10 1 11\n0 chr1 (null)\n0 7 0\n0 chr2 (null)\n7 3 0\n")
    assert [tuple(r) for r in readers.read_annotations(spark, str(tmp_path / "a.ann")).orderBy("rid").collect()] == [(0, "chr1", 0, 7), (1, "chr2", 7, 3)]
    (tmp_path / "s.txt").write_text("\t".join([*readers.SUMMARY_FIELDS, "more"]) + "\n1\t0.5\t2\t3\tr\t0.6\t1.5\t900\tx\n2\t50\t2\t3\tq\t51\t1.5\t900\tx\n")
    assert [r.read_id for r in readers.read_summary(spark, str(tmp_path / "s.txt"), 0, 10).collect()] == ["r"]
    (tmp_path / "p.txt").write_text("default\t-10.0,-3.0\t0.3\t115\n")
    p = readers.read_presets(spark, str(tmp_path / "p.txt"))
    readers.write_presets(p, str(tmp_path / "out"))
    assert [tuple(r) for r in readers.read_presets(spark, str(tmp_path / "out")).collect()] == [("default", 0.3, 115.0, [-10.0, -3.0])]


def test_dumps(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("start\tlength\tmean\tstdv\tnorm_scale\tnorm_shift\twin_mean\twin_stdv\twin_mask\n0\t9\t80.5\t1\t2\t-3\t81\t6\t1\n9\t7\t70\t1\t2\t-3\t80\t4\t0\n")
    events = readers.read_event_dump(spark, str(tmp_path / "e.tsv")).orderBy("evt").collect()
    assert [(r.evt, r.start, r.length, r["mean"], r.norm_scale, r.mask) for r in events] == [(0, 0, 9, 80.5, 2.0, True), (1, 9, 7, 70.0, 2.0, False)]
    (tmp_path / "s.bed").write_text("chr1\t100\t126\t7:3:12\t+\nchr1\t90\t116\t8:0:12\t-\nshort line\n")
    seeds = readers.parse_seeds(spark.read.text(str(tmp_path / "s.bed"))).orderBy("evt").collect()
    assert [tuple(r) for r in seeds] == [("chr1", 100, 126, 7, 3, 12, True), ("chr1", 90, 116, 8, 0, 12, False)]
    head = "id\tparent\tfm_start\tfm_len\tkmer\tfull_len\tmatch_prob\tmoves"
    (tmp_path / "p.tsv").write_text(f"{head}\n5:1\t4:0\t10\t2\tACGTA\t22\t-2.5\t0110\n{head}\n6:0\t5:1\t11\t1\tCGTAC\t22\t-2\t1101\n")
    paths = readers.read_path_dump(spark, str(tmp_path / "p.tsv")).orderBy("evt").collect()
    assert [(r.evt, r.path, r.parent, r.fm_len, r.kmer, r.match_prob, r.moves) for r in paths] == [(5, 1, "4:0", 2, "ACGTA", -2.5, "0110"), (6, 0, "5:1", 1, "CGTAC", -2.0, "1101")]
    (tmp_path / "c.tsv").write_text("evt\tclust\ttop\tmean\n30\t12\t2.5\t7\n")
    assert [tuple(r)[1:] for r in readers.read_confidence_dump(spark, str(tmp_path / "c.tsv")).collect()] == [(30, 12, 2.5, 7.0)]


def test_paf_text(spark, tmp_path):
    lines = ["# comment", "r1\t100\t1\t50\t+\tchr1\t1000\t10\t60\t40\t51\t255\tmt:f:5.5\tct:Z:a:b", "r2\t80\t*\t*\t*\t*\t*\t*\t*\t*\t*\t255"]
    (tmp_path / "a.paf").write_text("\n".join(lines) + "\n")
    df = readers.read_paf(spark, str(tmp_path / "a.paf"))
    got = df.select("qr_name", "qr_st", "rf_en", "is_mapped", pafstats.tag("ct").alias("ct")).orderBy("qr_name").collect()
    assert [tuple(r) for r in got] == [("r1", 1, 60, True, "a:b"), ("r2", None, None, False, None)]
    readers.write_paf(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["\t".join([*lines[1].split("\t")[:12], "ct:Z:a:b", "mt:f:5.5"]), lines[2]]
    assert readers.read_paf(spark, str(tmp_path / "out"), 1).count() == 1 and [r.qr_name for r in readers.read_paf(spark, str(tmp_path / "a.paf"), 1).collect()] == ["r1"]
    tags = df.select("qr_name", pafstats.set_tag(F.col("tags"), "mt", F.lit(7), "i").alias("tags")).orderBy("qr_name").collect()
    assert [{k: tuple(v) for k, v in r.tags.items()} for r in tags] == [{"ct": ("Z", "a:b"), "mt": ("i", "7")}, {"mt": ("i", "7")}]


def test_chunk_decoding(spark):
    raw = [np.array([1, -2, 3], dtype=d).tobytes() for d in ("<f4", "<i2", "<i4")]
    df = spark.createDataFrame([tuple(bytearray(b) for b in raw)], "a binary, b binary, c binary")
    got = df.select(*[readers.decode_samples(F.col(c), t).alias(c) for c, t in zip("abc", ("float32", "int16", "int32"), strict=True)], readers.decode_samples(F.col("a"), "odd").alias("d")).first()
    assert [list(x) for x in got] == [[1, -2, 3]] * 3 + [[]]
