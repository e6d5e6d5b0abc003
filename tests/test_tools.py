"""Sources that stand for a device or HDF5 files, the warp driver and the command line."""

import numpy as np
from pyspark.sql import functions as F

from strandflow import cli
from strandflow.operators import dtw, simulate
from strandflow.operators.segment import events
from strandflow.sources import chunks, fast5, readers
from strandflow.streaming import realtime


class Group(dict):
    def __init__(self, attrs=None, **members):
        super().__init__(members)
        self.attrs = attrs or {}


def test_fast5_layouts(tmp_path):
    raw = lambda i: Group({"read_id": f"r{i}".encode(), "read_number": i, "start_time": 10 * i}, Signal=np.array([1, -2, 3], dtype="i2"))
    channel = Group({"channel_number": b"7", "range": 8.0, "digitisation": 4.0, "offset": 1.0})
    single = Group(Raw=Group(Reads=Group(Read_1=raw(1))), UniqueGlobalKey=Group(channel_id=channel))
    many = Group(read_a=Group(Raw=raw(1), channel_id=channel), read_b=Group(Raw=raw(2), channel_id=channel), other=Group())
    want = ("r1", 7, 1, 10, [4.0, -2.0, 8.0])
    assert [fast5.decode(*g) for g in fast5.groups(single)] == [want]
    assert [fast5.decode(*g)[0] for g in fast5.groups(many)] == ["r1", "r2"]
    assert fast5.decode(raw(1), Group(), 2) == ("r1", 0, 1, 10, [1.0, -2.0])
    (tmp_path / "in").mkdir()
    for f in ("a.fast5", "b.txt", "in/c.fast5"):
        (tmp_path / f).write_text("")
    (tmp_path / "list").write_text("# no\nx.fast5\n\ny.fast5\n")
    ends = lambda paths: [p.rsplit("/", 1)[-1] for p in paths]
    assert ends(fast5.expand(str(tmp_path))) == ["a.fast5"] and ends(fast5.expand(str(tmp_path), True)) == ["a.fast5", "c.fast5"]
    assert fast5.expand(str(tmp_path / "list")) == ["x.fast5", "y.fast5"] and fast5.expand("z.fast5") == ["z.fast5"]


def test_replayed_chunks_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(c, n, 1000 * n, rng.normal(90, 5, int(rng.integers(0, 60))).tolist()) for c in range(3) for n in range(4)]
    reads = spark.createDataFrame(rows, "channel long, number long, start_sample long, signal array<double>")
    cut = chunks.from_reads(reads, 10)
    assert cut.agg(F.sum(F.size("samples"))).first()[0] == sum(len(r[3]) for r in rows)
    assert chunks.from_reads(reads, 10, tail=False).filter(F.size("samples") < 10).count() == 0
    chunks.write_rounds(cut, str(tmp_path / "in"), 1000)
    made = (simulate.made_mapper, "made-in-tests")
    q = realtime.run_channels(chunks.stream(spark, str(tmp_path / "in")), *made).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.channel, r.number, r.n_samples, r.outcome) for r in df.collect())
    assert key(spark.table("replayed")) == key(realtime.run_channels(cut, *made))
    ticks = {r.start_sample: r.tick for r in chunks.emitted(cut.filter("channel = 0 AND number = 1"), 25).collect()}
    assert all(25 * (t - 1) < s + 10 for s, t in ticks.items())


def test_device_chunks_follow_the_timeline(spark):
    ch = spark.createDataFrame([(1, [(0.0, 0.1)], [0.01], [0.02, 0.03])], "channel long, intervals array<struct<st:double,en:double>>, gaps array<double>, lengths array<double>")
    ejected = spark.createDataFrame([(1, 0, 0.005)], "channel long, n long, delay double")
    line = simulate.timeline(ch, ejected, 0.0)
    reads = spark.createDataFrame([(1, 0, [float(i) for i in range(80)]), (1, 1, [-float(i) for i in range(120)])], "channel long, k long, signal array<double>")
    got = chunks.device_chunks(line, reads, 50).collect()
    want = []
    for r in line.orderBy("n").collect():
        x = ([float(i) for i in range(80)], [-float(i) for i in range(120)])[r.n % 2][: round((r.en - r.st) * 4000)]
        want += [(1, r.n, i // 50, round(r.st * 4000) + i, x[i : i + 50]) for i in range(0, len(x), 50)]
    assert sorted(tuple(r) for r in got) == want and len(want) > 4


def test_kept_events_against_plain_windows():
    rng = np.random.default_rng(4)
    for n in (0, 5, 25, 60, 120):
        x = np.where(rng.random(n) < 0.02, 200.0, 90.0) + rng.normal(0, 6, n)
        still = [j >= 12 and x[max(0, j - 24) : j + 1].std() < 5 for j in range(n)]
        want = [not any(still[p + 1 : p + 25] if p <= n - 25 else still[p:]) for p in range(n)]
        assert dtw.kept_events(x).tolist() == want


def test_warped_reads_prefer_their_own_span(spark):
    ref, (mean, stdv) = simulate.make_reference(3000), simulate.make_model()
    rows = simulate.make_reads(6, ref, mean, stdv, 300)
    reads = spark.createDataFrame(rows[["read_id", "signal"]])
    spans = []
    for r in rows.itertuples():
        strand = "+" if r.true_fwd else "-"
        far = (r.true_st + 1200) % 2600
        spans += [(str(r.read_id), 0, 0, "ref", r.true_st, r.true_st + 300, strand), (str(r.read_id), 0, 0, "ref", far, far + 300, strand)]
    spans.append(("0", 5, 5, "ref", 0, 3, "+"))
    queries = spark.createDataFrame(spans, "rd_name string, rd_st long, rd_en long, rf_name string, rf_st long, rf_en long, strand string")
    got = {(r.rd_name, r.rf_st): r.mean_score for r in dtw.warp_reads(reads, queries, spark.createDataFrame([("ref", ref)], "name string, seq string"), mean).collect()}
    assert got[("0", 0)] is None and len(events(np.array(rows.signal[0]))) > 100
    for r in rows.itertuples():
        own, other = got[(str(r.read_id), r.true_st)], got[(str(r.read_id), (r.true_st + 1200) % 2600)]
        assert own < 0.6 * other


def test_command_line(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    ref, (mean, stdv) = simulate.make_reference(4000), simulate.make_model()
    (tmp_path / "ref.fa").write_text(f">chr\n{ref[:2000]}\n{ref[2000:]}\n>two\n{ref[100:160]}NNNN\n")
    kmer = lambda i: "".join("ACGT"[(i >> (2 * (4 - j))) & 3] for j in range(5))
    (tmp_path / "model.tsv").write_text("kmer\tmean\tstdv\n" + "".join(f"{kmer(i)}\t{mean[i]}\t{stdv[i]}\n" for i in range(1024)))
    cli.main(["index", "--fasta", at("ref.fa"), "--out", at("index"), "--model", at("model.tsv"), "--prob", "0.3"])
    rows = simulate.make_reads(12, ref, mean, stdv, 500)
    spark.createDataFrame(rows[["read_id", "signal"]]).withColumns({"channel": F.col("read_id") % 3, "number": F.col("read_id"), "start_sample": F.col("read_id") * 8000}).write.parquet(at("reads"))
    true = {str(r.read_id): (r.true_st, r.true_fwd) for r in rows.itertuples()}
    own = ["--reads", at("reads"), "--model", at("model.tsv"), "--presets", at("index/presets"), "--preset", "default"]
    for name, source in (("paf", ["--index", at("index/index")]), ("paf2", ["--fasta", at("ref.fa")])):
        cli.main(["map", *source, *own, "--out", at(name)])
    lines = sorted(r.value.split("\t") for r in spark.read.text(at("paf")).collect())
    assert [x[:12] for x in lines] == sorted(r.value.split("\t")[:12] for r in spark.read.text(at("paf2")).collect())
    mapped = [x for x in lines if x[5] in ("chr", "two")]
    home = [x for x in mapped if x[5] == "chr" and (x[4] == "+") == true[x[0]][1] and int(x[7]) < true[x[0]][0] + 500 and int(x[8]) > true[x[0]][0]]
    assert len(lines) == 12 and len(mapped) >= 9 and len(home) >= 0.9 * len(mapped)
    assert all(0 <= int(x[2]) < int(x[3]) <= int(x[1]) for x in mapped) and all({t[:5] for t in x[12:]} == {"ch:i:", "mt:f:", "st:i:"} for x in lines)
    cli.main(["pafstats", "--paf", at("paf"), "--truth", at("paf")])
    said = capsys.readouterr().out
    assert "tp" in said and "NULL" not in said
    (tmp_path / "summary.tsv").write_text("\t".join(readers.SUMMARY_FIELDS) + "\n" + "".join(f"1\t{i}\t2.0\t1\t{i}\t{i + 0.5}\t1.5\t500\n" for i in range(12)))
    (tmp_path / "truth.paf").write_text("".join(f"{i}\t500\t0\t500\t+\tchr\t4000\t0\t500\t500\t500\t60\ttp:A:P\n" for i in range(3)))
    cli.main(["yield", "--summary", at("summary.tsv"), "--paf", at("paf"), "--truth", at("truth.paf"), "--fasta", at("ref.fa")])
    assert "0.0015" in capsys.readouterr().out
    cli.main(["replay", "--index", at("index/index"), *own, "--out", at("replayed"), "--chunk", "1000"])
    assert spark.read.parquet(at("replayed")).filter("outcome = 'mapped'").count() >= 8
    (tmp_path / "q.tsv").write_text("0\t0\t0\tchr\t0\t300\t+\n")
    cli.main(["warp", "--queries", at("q.tsv"), "--fasta", at("ref.fa"), "--model", at("model.tsv"), "--reads", at("reads"), "--out", at("warped"), "--likelihood"])
    assert spark.read.text(at("warped")).count() == 1
    cli.main(["mask", "--fasta", at("ref.fa"), "--out", at("masked"), "--k", "4", "--rounds", "2"])
    assert sum(len(r.value) for r in spark.read.text(at("masked")).collect() if r.value[0] != ">") == 4064
    reads = spark.createDataFrame([(1, 1, 0, [90.0] * 50), (2, 1, 0, [90.0] * 5)], "channel long, number long, start_sample long, signal array<double>")
    chunks.write_rounds(chunks.from_reads(reads, 10), at("live"), 100)
    cli.main(["realtime", "--index", at("index/index"), *own[2:], "--chunks", at("live"), "--out", at("decisions"), "--checkpoint", at("cp"), "--mode", "enrich", "--max-chunks", "2"])
    assert [(r.channel, r.outcome, r.decision) for r in spark.read.parquet(at("decisions")).collect()] == [(1, "gave_up", "ej")]
    for kind, text in {"itvs": "1\t0\t0\t100\n", "gaps": "1\t0\t5\n", "delays": "1\t0\t1\n", "reads": "1\t0\t0\n1\t1\t1\n"}.items():
        (tmp_path / f"s_{kind}.txt").write_text(text)
    spark.createDataFrame([("0", [1.0] * 20), ("1", [1.0] * 30)], "read_id string, signal array<double>").write.parquet(at("simreads"))
    cli.main(["sim", "--schedule", str(tmp_path), "--reads", at("simreads"), "--out", at("timeline")])
    assert [(r.st, r.en) for r in spark.read.parquet(at("timeline")).orderBy("n").collect()] == [(5.0, 25.0), (30.0, 60.0), (65.0, 85.0), (90.0, 100.0)]
