"""Kernels against plain restatements, simulated truth and properties."""

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.functions import intervals, kmers
from strandflow.functions import signal as S
from strandflow.operators import index, masking, pafstats, presets, runprofile, simulate, traces, yields
from strandflow.operators.dtw import EVENT_COLUMNS, EVENT_GLOBAL, EVENT_ROWS, DtwConfig, difference, unlikeliness, warp, warp_score
from strandflow.operators.index import FmIndex
from strandflow.operators.mapper import Beam, Mapper, event_table, map_reads, path_counts, path_table, seed_table
from strandflow.operators.segment import boundaries, events, statistic

DNA = st.text("ACGT", min_size=1, max_size=60)
COMPLEMENT = str.maketrans("ACGT", "TGCA")


@settings(max_examples=60, deadline=None)
@given(DNA, st.text("ACGT", min_size=1, max_size=4))
def test_fm_ranges_count_occurrences(seq, part):
    both = seq + seq[::-1].translate(COMPLEMENT)
    at = [i for i in range(len(both) - len(part) + 1) if both[i : i + len(part)] == part]
    fm = FmIndex(seq)
    lo, hi = fm.search(part)
    assert sorted(fm.places(lo, hi, len(part)).tolist() if hi > lo else []) == at


def test_kmer_round_trips(spark):
    df = spark.createDataFrame([("ACGTA",), ("TTTTT",), ("ACNTA",)], "s string").withColumn("k", kmers.encode(F.col("s")))
    rows = df.select("s", "k", kmers.decode(F.col("k"), 5).alias("d"), kmers.revcomp(kmers.revcomp(F.col("k"), 5), 5).alias("rr"), kmers.comp(kmers.comp(F.col("k"), 5), 5).alias("cc")).collect()
    assert [(r.k, r.d, r.rr, r.cc) for r in rows[:2]] == [(108, "ACGTA", 108, 108), (1023, "TTTTT", 1023, 1023)] and rows[2].k is None


def test_preset_fill(spark):
    line = "-10.07,-3.0414736324726217,-2.531717283679984,-2.3585861097820924,-2.2706664023093497,-2.2677272727272726"
    t = spark.range(1).select(index.preset_thresholds(F.lit(line))).first()[0]
    assert len(t) == 64 and t[63] == -10.07 and round(t[62], 4) == -3.0415 and round(t[59], 4) == -2.2707 and {round(x, 4) for x in t[:59]} == {-2.2677}


def test_statistic_is_the_windows_one(spark):
    x = np.random.default_rng(0).normal(90, 10, 40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "read_id long, i long, x double")
    got = [r.t for r in S.tstat(df, 3).orderBy("i").collect()]
    assert np.allclose(got, statistic(x, 3), atol=1e-6)


def test_segments_follow_steps():
    rng = np.random.default_rng(1)
    levels = rng.permutation(np.linspace(60, 120, 30))
    x = np.repeat(levels, 10) + rng.normal(0, 0.5, 300)
    cuts = np.array(boundaries(x)[1:])
    true = np.arange(10, 300, 10)
    assert np.mean([np.abs(cuts - t).min() <= 2 for t in true]) > 0.9
    assert all(e[1] > 0 for e in events(x)) and events(np.array([])) == []


def naive_warp(cost, c):
    n, m = cost.shape
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    if c.free == "col":
        d[0, :] = 0
    if c.free == "row":
        d[:, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j - 1] + c.diagonal * cost[i - 1, j - 1], d[i, j - 1] + c.horizontal * cost[i - 1, j - 1], d[i - 1, j] + c.vertical * cost[i - 1, j - 1])
    return d[n, m] if c.free == "none" else d[n, 1:].min() if c.free == "col" else d[1:, m].min()


@pytest.mark.parametrize("free", ["none", "col", "row"])
def test_warping_against_plain_loops(free):
    rng = np.random.default_rng(2)
    for _ in range(10):
        conf = DtwConfig(2, 1, 3, free)
        cost = rng.random((rng.integers(1, 9), rng.integers(1, 9)))
        score, path = warp(cost, conf)
        assert np.isclose(score, naive_warp(cost, conf))
        assert all(0 <= b[0] - a[0] <= 1 and 0 <= b[1] - a[1] <= 1 for a, b in zip(path, path[1:], strict=False))


def test_simulated_reads_map_home(spark):
    keys = spark.range(40).select(F.col("id").alias("read_id"))
    reads = simulate.reads_by_key(keys, 400)
    got = {r.read_id: r for r in map_reads(reads, simulate.made_mapper, "made-in-tests").collect()}
    true = {r.read_id: r for r in reads.select("read_id", "true_st", "true_fwd").collect()}
    mapped = [r for r in got.values() if r.is_mapped]
    home = [r for r in mapped if r.is_fwd == true[r.read_id].true_fwd and r.rf_st < true[r.read_id].true_st + 400 and r.rf_en > true[r.read_id].true_st]
    assert len(got) == 40 and len(mapped) >= 36 and len(home) >= 0.97 * len(mapped)
    mapper = simulate.made_mapper()
    for r in reads.limit(5).collect():
        plain = mapper.map_signal(np.array(r.signal))
        assert {k: got[r.read_id][k] for k in plain} == plain
    seeds = seed_table(reads, simulate.made_mapper, "made-in-tests").collect()
    at = {}
    for s in seeds:
        t = true[s.read_id]
        at.setdefault(s.read_id, []).append(s.is_fwd == t.true_fwd and t.true_st - 1 <= s.st and s.en <= t.true_st + 401)
    assert len(at) >= 36 and sum(map(sum, at.values())) >= 0.6 * len(seeds)
    events_ = event_table(reads.limit(2), simulate.made_mapper, "made-in-tests").collect()
    assert {e.read_id for e in events_} == {r.read_id for r in reads.limit(2).collect()} and all(e.length > 0 for e in events_)
    paths = path_table(reads.limit(1), simulate.made_mapper, "made-in-tests").collect()
    assert paths and all(p.fm_len > 0 and 2 <= p.full_len <= 22 and len(p.moves) == p.full_len - 1 for p in paths)


@pytest.mark.parametrize("limits", [{}, {"max_paths": 150, "max_stays": 3}, {"max_events": 30}])
def test_reads_searched_side_by_side_are_as_alone(limits):
    ref, model = simulate.make_reference(3000), simulate.make_model()
    mapper = Mapper(ref, *model, replace(simulate.MADE_CONF, **limits))
    signals = [np.array(s) for s in simulate.make_reads(6, ref, *model, bases=120).signal] + [np.empty(0), np.full(100, 90.0)]
    new = lambda: Beam(mapper.conf, [], [])
    together, alone, halves = [new() for _ in signals], [new() for _ in signals], [new() for _ in signals]
    records = mapper.search_all(signals, together)
    assert records == [mapper.search_all([s], [b])[0] for s, b in zip(signals, alone, strict=True)]
    # levels that come in two parts, of unequal lengths
    levels = [mapper.normalise(np.array([e[2] for e in events(s)] or [0.0])) if events(s) else np.empty(0) for s in signals]
    for part in (lambda i, x: x[: 5 * i], lambda i, x: x[5 * i :]):
        mapper.advance_all(halves, [part(i, x) for i, x in enumerate(levels)])
    for a, b, c in zip(together, alone, halves, strict=True):
        assert a.seen_seeds == b.seen_seeds == c.seen_seeds and a.clusters.rows == b.clusters.rows == c.clusters.rows
        assert len(a.seen_paths) == len(b.seen_paths) == len(c.seen_paths)
        for p, q, r in zip(a.seen_paths, b.seen_paths, c.seen_paths, strict=True):
            assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(p, q, r, strict=True))
    assert any(a.seen_seeds for a in together) or "max_events" in limits


def test_reads_are_dealt_out_and_counted(spark):
    keys = spark.range(0, 9, 1, 1).selectExpr("if(id = 8, 3, id) read_id")
    reads = simulate.reads_by_key(keys, 60)
    assert reads.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    counted = path_counts(reads, simulate.made_mapper, "made-in-tests").groupBy("read_id", "evt").agg(F.sum("n").alias("n"), F.max("longest").alias("longest"))
    rows = path_table(reads, simulate.made_mapper, "made-in-tests").groupBy("read_id", "evt").agg(F.count(F.lit(1)).alias("n"), F.max("full_len").alias("longest"))
    assert sorted(counted.collect()) == sorted(rows.collect()) and counted.count() > 100


def test_n_matches_nothing_and_sequences_stand_apart():
    a, b = "ACGTACGTTGCA", "TTGCANNACGTA"
    ref = index.Reference([("a", a), ("b", b)])
    fm = FmIndex(ref.text)
    both = ref.text + ref.text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for m in (1, 2, 3, 5):
        for q in {both[i : i + m] for i in range(len(both) - m)}:
            lo, hi = fm.search(q)
            want = [i for i in range(len(both) - m + 1) if both[i : i + m] == q] if "N" not in q else []
            assert sorted(fm.places(lo, hi, m).tolist()) == want
    assert ref.at(0) == ("a", 0, 12) and ref.at(11) == ("a", 11, 12) and ref.at(13) == ("b", 0, 12) and ref.at(24) == ("b", 11, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=12), st.lists(st.floats(-5, 5), min_size=1, max_size=12), st.sampled_from([EVENT_GLOBAL, EVENT_COLUMNS, EVENT_ROWS]), st.sampled_from([difference, unlikeliness]))
def test_warp_score_is_that_of_the_whole_matrix(levels, x, conf, cost):
    levels, x, sd = np.array(levels), np.array(x), np.linspace(0.5, 2, len(levels))
    score, path = warp(cost(levels[:, None], sd[:, None], x[None, :]), conf)
    got, length = warp_score(levels, sd, x, cost, conf)
    assert got == pytest.approx(score) and (length == len(path) or len(set(levels)) < len(levels) or len(set(x)) < len(x))


def test_boundaries_of_a_part_are_a_part():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(90, 12, 120), rng.integers(5, 14, 120))
    x = x + rng.normal(0, 1.5, len(x))
    whole = boundaries(x)
    for n in range(0, len(x), 37):
        part = boundaries(x[:n])
        assert part == whole[: len(part)]


def test_scans_by_hand():
    """Scans from the formulas worked by hand: (start, end, mux, share) blocks; a limit of 20 from the scan's end."""
    four = [(100.0, 103.0, 1, 1.0), (104.0, 107.0, 2, 1.0), (108.0, 111.0, 3, 1.0), (112.0, 115.0, 4, 1.0)]
    scans = lambda *b: runprofile.assemble_scans(list(b))
    assert scans(*four, (118.0, 119.0, 2, 1.0)) == [(0.0, 118.0)]  # the next block, dominant or not, ends it
    assert scans((0.0, 40.0, 3, 0.5), *four, (118.0, 119.0, 2, 0.5)) == [(40.0, 118.0)]
    assert scans(*four, (140.0, 150.0, 2, 1.0)) == [(0.0, 115.0)]  # too far away: the scan's own end
    assert scans(*four) == []  # the run ends in it
    # a repeat of a mux that ends within the limit of the scan's end moves the end
    assert scans(*four[:2], (107.5, 126.0, 2, 1.0), (127.0, 128.0, 3, 1.0), (129.0, 130.0, 4, 1.0), (131.0, 132.0, 1, 0.5)) == [(0.0, 131.0)]
    # a longer one of mux 2 to 4 leaves the scan as it is, one of mux 1 begins it anew
    assert scans(*four[:2], (107.5, 128.0, 2, 1.0), (126.5, 127.0, 3, 1.0), (127.5, 129.0, 4, 1.0), (131.0, 132.0, 1, 0.5)) == [(0.0, 131.0)]
    assert scans((50.0, 53.0, 1, 1.0), (54.0, 80.0, 1, 1.0), (81.0, 82.0, 2, 1.0), (83.0, 84.0, 3, 1.0), (85.0, 86.0, 4, 1.0), (90.0, 91.0, 1, 0.1)) == [(53.0, 90.0)]
    # a mux out of turn ends the attempt, and a whole scan's follower may open the next
    assert scans(four[0], (104.0, 107.0, 3, 1.0), *[(s + 20, e + 20, m, p) for s, e, m, p in four], (140.0, 141.0, 1, 0.1)) == [(107.0, 140.0)]
    again = [(s + 18, e + 18, m, p) for s, e, m, p in four]
    assert scans(*four, *again, (134.0, 135.0, 2, 1.0)) == [(0.0, 118.0), (115.0, 134.0)]


def test_allocation_gives_nothing_to_channels_without_reads(spark):
    n = spark.createDataFrame([(1, 0), (2, 30), (3, 70), (4, 10)], "channel long, n long")
    got = {r.channel: r.target for r in runprofile.allocation(n, 110, 20).collect()}
    # shares 0, 30, 70, 10 of 110; remain 0, 10, 50, -10; of 50 in all, 10/60 and 50/60 go to channels 2 and 3
    assert got == {1: 0, 2: 28, 3: 62, 4: 20}
    slots = runprofile.donate(spark.createDataFrame([(1, 0, 3), (2, 5, 3), (3, 2, 1)], "channel long, n long, target long")).collect()
    assert sorted((r.slot, r.from_channel, r.to_channel) for r in slots) == [(1, 2, 1), (2, 2, 1), (3, 3, 1)]


def test_yields_by_hand(spark):
    s = spark.createDataFrame([("a", 10.0, 1.0, 9.0, 4000), ("b", 8.0, 0.5, 7.5, 3000), ("c", 6.0, 0.0, 6.0, 2000)], "read_id string, duration double, template_start double, template_duration double, bases long")
    lines = ["a\t450\t*\t*\t*\t*\t*\t*\t*\t*\t*\t255\tst:i:4000\tej:f:0.5\tdl:i:4000", "b\t900\t0\t900\t+\tx\t9\t0\t9\t9\t9\t255\tst:i:8000", "z\t450\t*\t*\t*\t*\t*\t*\t*\t*\t*\t255\tst:i:0\tub:f:9"]
    calls = pafstats.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    delays = {r.read_id: r.delay for r in yields.eject_delays(s, calls).collect()}
    assert delays == {"a": pytest.approx(10 - 1 - (450 / 450 + 0.5)), "b": None, "c": None}
    assert yields.median_delay(yields.eject_delays(s, calls)).first() == (1, pytest.approx(7.5))
    assert yields.run_seconds(calls).first().seconds == pytest.approx(8000 / 4000 + 900 / 450)
    kept = 4000 / 9 * (450 / 450 + 4000 / 4000 + 0.5 - 1)
    on = spark.createDataFrame([("a",), ("c",)], "read_id string")
    r = yields.genome_yield(s, calls, on, 0.5).first()
    assert [r.unc_on_bp, r.unc_total_bp, r.cnt_on_bp, r.cnt_total_bp] == pytest.approx([kept / 1e6 / 0.5, (kept + 3000) / 1e6 / 0.5, 0.006, 0.009])
    bed = spark.createDataFrame([("x", 0, 100, "b"), ("x", 50, 80, "b")], "chrom string, st long, en long, name string")
    r = yields.bed_yield(s, calls, bed).first()
    assert [r.unc_on_bp, r.unc_total_bp, r.cnt_on_bp, r.cnt_total_bp] == pytest.approx([130 / 1e6, (kept + 3000) / 1e6, 130 / 1e6, 0.009])


def test_rounds_of_masking_by_plain_loops(spark):
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGT"), 60)) + "acgtacgtacgt", "ACGTACGTNNACGTA", "", "AC"]
    got = {r.doc_id: r.seq for r in masking.mask_internal(spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string"), 4, 30).collect()}
    for _ in range(30):
        n = Counter(s[i : i + 4].upper() for s in seqs for i in range(len(s) - 3) if set(s[i : i + 4].upper()) <= set("ACGT"))
        if not n:
            break
        top = max(n, key=lambda k: (n[k], k))
        seqs = ["".join("N" if any(s[j : j + 4].upper() == top for j in range(max(0, i - 3), i + 1)) else c for i, c in enumerate(s)) for s in seqs]
    assert got == dict(enumerate(seqs))


def test_masks_of_any_letters(spark):
    seqs = spark.createDataFrame([(1, "aé🙂cGTé"), (2, "ACGT"), (3, None)], "item_id long, seq string")
    bed = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (2, 3, 9), (2, 5, 7), (3, 0, 1)], "item_id long, st long, en long")
    assert {r.item_id: r.seq for r in masking.apply_mask(seqs, bed).collect()} == {1: "aNNNGTé", 2: "ACGN", 3: None}


def test_interval_gaps_and_joins(spark):
    df = spark.createDataFrame([(1, 5, 9, 0, 20), (1, 8, 12, 0, 20), (1, 15, 20, 0, 20)], "g long, st long, en long, lo long, hi long")
    assert sorted(map(tuple, intervals.gaps(df, ["g"], "st", "en", "lo", "hi").collect())) == [(1, 0, 4), (1, 13, 14)]
    pairs = intervals.overlap_join(df.select("g", "st", "en"), df.select("g", F.col("st").alias("s2"), F.col("en").alias("e2")), ("st", "en"), ("s2", "e2"), 4, ["g"])
    assert pairs.count() == 5


def test_masks_never_change_length(spark):
    df = spark.createDataFrame([(1, "ATATATA"), (2, "ccATAcc"), (3, ""), (4, "AT")], "doc_id long, seq string")
    got = [r.m for r in df.select("doc_id", masking.mask_kmer(F.col("seq"), F.lit("ATA")).alias("m")).orderBy("doc_id").collect()]
    assert got == ["NNNNNNN", "ccNNNcc", "", "AT"]
    assert masking.mask_internal(df, 3, 2).filter("length(seq) > 7").count() == 0


def test_scans():
    blocks = [(0.0, 50.0, 2, 0.5), (100.0, 103.0, 1, 1.0), (104.0, 107.0, 2, 1.0), (108.0, 111.0, 3, 1.0), (112.0, 115.0, 4, 1.0), (120.0, 900.0, 1, 0.4)]
    assert runprofile.assemble_scans(blocks) == [(50.0, 120.0)]
    assert runprofile.assemble_scans(blocks[:4]) == []


def test_timeline(spark):
    ch = spark.createDataFrame([(1, [(0.0, 10.0)], [1.0], [2.0])], "channel long, intervals array<struct<st:double,en:double>>, gaps array<double>, lengths array<double>")
    assert [(r.st, r.en) for r in simulate.timeline(ch).orderBy("n").collect()] == [(1.0, 3.0), (4.0, 6.0), (7.0, 9.0)]
    ejected = spark.createDataFrame([(1, 0, 0.5)], "channel long, n long, delay double")
    assert [(r.st, round(r.en, 2)) for r in simulate.timeline(ch, ejected, 0.5).orderBy("n").collect()][:2] == [(1.0, 1.5), (3.0, 5.0)]


def test_growth_widens_or_begins_blocks():
    seeds = [(1, "a", 0, 10), (1, "a", 5, 12), (1, "a", 30, 40), (1, "b", 31, 41), (1, "a", 2, 4), (2, "b", 3, 9)]
    plain = lambda rows: [(gain, covered, block[1]) for block, gain, covered in rows]
    want = [(10, 10, 0), (2, 12, 0), (10, 22, 1), (10, 32, 2), (2, 34, 3), (6, 6, 0)]
    assert plain(traces.growth(seeds)) == want
    for cut in range(1, len(seeds)):
        first = list(traces.growth(seeds[:cut]))
        assert plain(first) + plain(traces.growth(seeds[cut:], first[-1][0], first[-1][2])) == want
    assert list(traces.growth([])) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from("MIDNSHP=X")), max_size=8), st.booleans())
def test_cigar_pairs_against_plain_steps(spark, ops, fwd):
    want, q, r = [], 3, 0
    for n, o in ops if fwd else ops[::-1]:
        both = [n if o in side else 1 for side in (traces.ALONG_QUERY, traces.ALONG_REFERENCE)]
        want += [(q + i, r + i) for i in range(min(both))]
        q, r = q + n * (o in traces.ALONG_QUERY), r + n * (o in traces.ALONG_REFERENCE)
    df = spark.createDataFrame([(1, "".join(f"{n}{o}" for n, o in ops), 3, fwd), (2, None, 0, True)], "id long, cigar string, qr_st long, is_fwd boolean")
    assert sorted((x.qr, x.rf) for x in traces.cigar_pairs(df, "id").collect()) == sorted(want)


def test_packed_bits(spark):
    df = spark.createDataFrame([(b"\x81\x0f",), (b"",), (None,)], "b binary")
    got = [r[0] for r in df.select(traces.packed_bits(F.col("b"))).collect()]
    assert got == [[1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 1, 1], [], []]


def test_preset_search_meets_its_targets(spark):
    seqs = spark.createDataFrame([(1, simulate.make_reference(6000))], "doc_id long, seq string")
    grown = presets.extensions(seqs, "doc_id", 5, 12)
    rows = grown.collect()
    paths = {}
    for r in sorted(rows, key=lambda r: (r.pos, r.step)):
        paths.setdefault(r.pos, []).append(r.copies)
    counts = presets.profile(grown, "doc_id")
    plain = np.zeros_like(counts)
    for p in paths.values():
        for i in range(counts.shape[1]):
            plain[int(np.log2(p[i])) if i < len(p) else 0, i] += 1
    assert np.array_equal(counts, plain)
    grid = np.linspace(-12, -0.5, 200)
    mean, stdv = simulate.make_model()
    own, seen = presets.model_table(mean, stdv, grid)
    assert (np.diff(own) <= 0).all() and (np.diff(seen) <= 0).all() and 0 <= own[-1] <= own[0] <= 1
    s = presets.Search(counts, grid, own, seen)
    assert abs(s.find(prob=0.3).prob - 0.3) < 1e-3
    mid = (s.speed(0.5) + s.speed(8)) / 2
    assert abs(s.find(speed=mid).speed - mid) < 1e-2
    assert len(s.find(speed=1e9).thresholds) == len(counts)


def test_mux_scans_over_blocks(spark):
    rows = [(m, 100.0 + 10 * i + d, 103.0 + 10 * i + d) for i, m in enumerate((1, 2, 3, 4)) for d in (0.0, 0.5)] + [(1, 150.0, 900.0), (2, 151.0, 160.0)]
    got = runprofile.mux_scans(spark.createDataFrame(rows, "mux long, st double, en double"), width=7.0).collect()
    assert [tuple(r) for r in got] == [(0.0, 150.0)]


def test_merging_in_stretches_changes_nothing(spark):
    rng = np.random.default_rng(12)
    rows = [(int(g), int(a), int(a + n)) for g, a, n in zip(rng.integers(0, 2, 300), rng.integers(0, 3000, 300), rng.integers(0, 25, 300), strict=True)]
    df = spark.createDataFrame(rows, "g long, st long, en long")
    want = sorted(map(tuple, intervals.merge(df, ["g"], "st", "en", 2).collect()))
    for width in (1, 37, 10_000):
        assert sorted(map(tuple, intervals.merge(df, ["g"], "st", "en", 2, width).collect())) == want
