"""Signal-to-reference mapping: a beam of paths over an FM index, seeds, clusters, one location a read (Arrow UDF).

Per normalised event each path may stay on its k-mer or move by one base; the longer its FM range, the better its
probability must be. Paths with one range keep the likeliest. k-mers that no path covers start new ones. A path of
``seed_len`` events with a good mean, (nearly) unique and not mostly stays, is a seed; seeds chain into clusters by
place and event; a read is located once its best cluster stands out.

Results follow the reads alone: there is no time budget. K-mer scores of an event come from the model in one step, and
paths are arrays. Some reads are searched side by side, their paths in common arrays by owner, so that a step of all
of them is one pass of vectors; each read's search is as it would be alone.
"""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.functions.signal import BASES_PER_SECOND, SAMPLES_PER_SECOND
from strandflow.operators.index import FmIndex, Reference
from strandflow.operators.segment import SegmentConfig, boundaries, events, mean_event_length

K = 5


@dataclass(frozen=True)
class MapConfig:
    seed_len: int = 22
    max_paths: int = 10_000
    max_stays: int = 8
    max_events: int = 30_000
    max_stay_share: float = 0.5
    min_seed_prob: float = -3.75
    max_copies: int = 50
    min_map_len: int = 25
    min_mean_ratio: float = 6.0
    min_top_ratio: float = 1.85
    #: log-probability thresholds from the largest range's bin down; the last holds for all smaller ranges
    thresholds: tuple[float, ...] = (-10.07, -3.0415, -2.5317, -2.3586, -2.2707, -2.2677)
    segment: SegmentConfig = field(default_factory=SegmentConfig)

    def table(self) -> np.ndarray:
        """Thresholds by bin, the number of leading zeros of a 64-bit range length."""
        t = list(self.thresholds) + [self.thresholds[-1]] * (64 - len(self.thresholds))
        return np.array(t[::-1])


class Clusters:
    """Seed chains in places of k-mers: [first start, start of the last seed, end, first event, last event, covered k-mers]."""

    def __init__(self, conf: MapConfig):
        self.conf, self.rows = conf, []
        #: (start of the last seed, number) of all chains in order, and their sizes in order
        self.starts: list[tuple[int, int]] = []
        self.sizes: list[int] = []
        self.total = 0

    def add(self, end: int, length: int, evt: int) -> int:
        """The number of the chain that the seed of ``length`` k-mers up to ``end`` goes to: the longest that it can follow, the nearest of equal ones."""
        start, best = end - length + 1, -1
        # a chain further back than there are events can't be followed
        for at, n in reversed(self.starts[bisect_left(self.starts, (start - evt, -1)) : bisect_right(self.starts, (start, len(self.rows)))]):
            move, passed = start - at, evt - self.rows[n][4]
            if move <= passed and move >= passed // 12 and (best < 0 or self.rows[n][5] > self.rows[best][5]):
                best = n
        if best < 0:
            self.rows.append([start, start, end, evt, evt, length])
            insort(self.starts, (start, len(self.rows) - 1))
            insort(self.sizes, length)
            self.total += length
            return len(self.rows) - 1
        row = self.rows[best]
        gain = max(0, end - row[2]) if start < row[2] else length
        del self.starts[bisect_left(self.starts, (row[1], best))], self.sizes[bisect_left(self.sizes, row[5])]
        row[1], row[2], row[4], row[5] = start, max(end, row[2]), evt, row[5] + gain
        insort(self.starts, (start, best))
        insort(self.sizes, row[5])
        self.total += gain
        return best

    def confident(self):
        """The longest chain, if it stands out."""
        c, sizes = self.conf, self.sizes
        if len(sizes) < 2 or sizes[-1] < c.min_map_len or not (sizes[-1] * len(sizes) >= c.min_mean_ratio * self.total or sizes[-1] >= c.min_top_ratio * sizes[-2]):
            return None
        return max(self.rows, key=lambda r: r[5])


class Beam:
    """A read's search: its paths as arrays, its chains and the number of events seen. Plain data, so that it can be kept as state.

    ``probs`` has a column for each path, the newest event's in the last row. Where lists are given, rows of seeds,
    arrays of each event's paths, or each event's number of paths and the longest, are added to them.
    """

    def __init__(self, conf: MapConfig, seen_seeds: list | None = None, seen_paths: list | None = None, seen_counts: list | None = None):
        self.lo = self.hi = self.kmer = self.stays = self.moves = self.steps = np.empty(0, dtype=np.int64)
        self.score, self.probs = np.empty(0), np.empty((conf.seed_len, 0))
        self.clusters, self.events, self.best = Clusters(conf), 0, None
        self.seen_seeds, self.seen_paths, self.seen_counts = seen_seeds, seen_paths, seen_counts


#: What a beam holds of each path.
COLUMNS = ("lo", "hi", "kmer", "stays", "moves", "steps", "score", "probs")


def _rank(owner: np.ndarray) -> np.ndarray:
    """Each one's place among those of its owner."""
    order = np.argsort(owner, kind="stable")
    mine = owner[order]
    out = np.empty(len(owner), dtype=np.int64)
    out[order] = np.arange(len(owner)) - np.searchsorted(mine, mine)
    return out


class Mapper:
    """One reference (a sequence, or a ``Reference`` of several), one model, one configuration."""

    def __init__(self, ref: str | Reference, mean: np.ndarray, stdv: np.ndarray, conf: MapConfig = MapConfig(), sa: np.ndarray | None = None):
        self.ref = ref if isinstance(ref, Reference) else None
        text = ref.text if self.ref else ref
        self.fm, self.conf, self.length = FmIndex(text, sa), conf, len(text)
        self.mean, self.two_var, self.log_den = mean, 2 * stdv * stdv, np.log(np.sqrt(2 * np.pi) * stdv)
        self.tgt_mean, self.tgt_stdv = float(mean.mean()), float(mean.std())
        self.table = conf.table()
        n = 4**K
        codes = np.arange(n)
        base = [(codes >> (2 * (K - 1 - i))) & 3 for i in range(K)]
        lo, hi = self.fm.first[base[0]], self.fm.first[base[0] + 1]
        for b in base[1:]:
            lo, hi = self.fm.extend(lo, hi, b)
        self.kmer_lo, self.kmer_hi = lo, np.maximum(lo, hi)
        self.present = self.kmer_hi > self.kmer_lo

    def _bin(self, size: np.ndarray) -> np.ndarray:
        # the exponent of a float is the place of the highest bit
        return 64 - np.frexp(np.maximum(size, 1))[1]

    def normalise(self, x: np.ndarray) -> np.ndarray:
        sd = x.std()
        return (x - x.mean()) * (self.tgt_stdv / sd if sd > 0 else 1.0) + self.tgt_mean

    def advance(self, beam: Beam, levels: np.ndarray) -> bool:
        """Take normalised events in order; True as soon as a chain is confident (``beam.best``)."""
        self.advance_all([beam], [levels])
        return beam.best is not None

    def advance_all(self, beams: list[Beam], levels: list[np.ndarray]) -> None:
        """``advance`` for each beam, side by side."""
        n_events = [min(len(x), self.conf.max_events - b.events) if b.best is None else 0 for b, x in zip(beams, levels, strict=True)]
        active = [(b, x[:n]) for b, x, n in zip(beams, levels, n_events, strict=True) if n > 0]
        if not active:
            return
        owner = np.repeat(np.arange(len(active)), [len(b.lo) for b, _ in active])
        paths = [np.concatenate([getattr(b, c) for b, _ in active], axis=-1) for c in COLUMNS]
        at = 0
        while active:
            owner, paths, seeded = self._event([b for b, _ in active], owner, paths, np.array([x[at] for _, x in active]))
            at += 1
            for b, _ in active:
                b.events += 1
            # a beam without a new seed stands as it stood
            for i in seeded:
                active[i][0].best = active[i][0].clusters.confident()
            done = np.array([b.best is not None or at == len(x) for b, x in active])
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    mine = np.flatnonzero(owner == i)
                    for c, v in zip(COLUMNS, paths, strict=True):
                        setattr(active[i][0], c, v[..., mine])
                rest = np.flatnonzero(~done[owner])
                owner, paths = (np.cumsum(~done) - 1)[owner[rest]], [v[..., rest] for v in paths]
                active = [a for a, d in zip(active, done, strict=True) if not d]

    def _event(self, beams: list[Beam], owner: np.ndarray, paths: list[np.ndarray], x: np.ndarray):
        """One event of each beam: the owners and paths that it leaves, and the beams that got a seed."""
        c, fm, n_kmers = self.conf, self.fm, 4**K
        p = (-((x[:, None] - self.mean) ** 2) / self.two_var - self.log_den).ravel()
        lo, hi, kmer, stays, moves, steps, score, probs = paths
        seeded, before = set(), owner
        if len(lo):
            need = self.table[self._bin(hi - lo)]
            p_stay = p[owner * n_kmers + kmer]
            stay = np.flatnonzero((stays < c.max_stays) & (p_stay >= need))
            # a k-mer's successors are four in a row
            p_next = p.reshape(-1, 4)[owner * (n_kmers // 4) + (kmer & (n_kmers // 4 - 1))]
            passing = np.flatnonzero(p_next >= need[:, None])
            parent, base = passing >> 2, passing & 3
            l2, h2 = fm.extend(lo[parent], hi[parent], base)
            live = np.flatnonzero(h2 > l2)
            parent, base = parent[live], base[live]
            nlo, nhi = np.concatenate((lo[stay], l2[live])), np.concatenate((hi[stay], h2[live]))
            nk = np.concatenate((kmer[stay], ((kmer[parent] << 2) & (n_kmers - 1)) | base))
            newest = np.concatenate((p_stay[stay], p_next.ravel()[passing[live]]))
            parent = np.concatenate((stay, parent))
            alone = np.ones(len(lo), dtype=bool)
            alone[parent] = False
            seeded |= self._seeds(beams, owner, paths, np.flatnonzero(alone & (steps >= c.seed_len)), True)
            nt = np.minimum(steps[parent] + 1, c.seed_len)
            nscore = (self._older(probs, steps)[parent] + newest) / nt
            keep = self._likeliest(len(beams), owner[parent], nlo, nhi, nscore)
            moved, parent = (keep >= len(stay)).astype(np.int64), parent[keep]
            lo, hi, kmer, score, steps, owner = nlo[keep], nhi[keep], nk[keep], nscore[keep], nt[keep], owner[parent]
            stays = np.where(moved == 1, 0, stays[parent] + 1)
            # the history is a bit row of the last seed_len - 1 steps, the newest lowest
            moves = ((moves[parent] << 1) | moved) & ((1 << (c.seed_len - 1)) - 1)
            paths = [lo, hi, kmer, stays, moves, steps, score, None]
            if any(b.seen_paths is not None or b.seen_counts is not None for b in beams):
                self._note_paths(beams, owner, before, parent, paths)
            seeded |= self._seeds(beams, owner, paths, np.flatnonzero((moved == 1) & (steps >= c.seed_len)), False)
        else:
            parent, newest, keep = np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64)
        # new paths over the k-mers that pass the strictest threshold: whole ranges without a path, and what paths leave uncovered
        at = owner * n_kmers + kmer
        passing = np.flatnonzero((p.reshape(-1, n_kmers) >= self.table[0]) & self.present)
        covered = np.zeros(len(p), dtype=bool)
        covered[at] = True
        seen = covered[passing]
        src = passing[~seen]
        glo, ghi, gap = self._uncovered(passing[seen], lo, hi, at)
        new, slo, shi = np.concatenate((src, gap)), np.concatenate((self.kmer_lo[src % n_kmers], glo)), np.concatenate((self.kmer_hi[src % n_kmers], ghi))
        mine = new // n_kmers
        room = np.maximum(0, c.max_paths - np.bincount(owner, minlength=len(beams)))
        if (np.bincount(mine, minlength=len(beams)) > room).any():
            fits = np.flatnonzero(_rank(mine) < room[mine])
            new, slo, shi, mine = new[fits], slo[fits], shi[fits], mine[fits]
        n, zeros = len(keep), np.zeros(len(new), dtype=np.int64)
        after = np.zeros((c.seed_len, n + len(new)))
        # few paths are longer than ``short``: what is older is moved on for them only
        short = min(8, c.seed_len)
        after[-short:-1, :n] = probs[c.seed_len - short + 1 :].take(parent, axis=1)
        long = np.flatnonzero(steps > short)
        if len(long):
            after[:-short, long] = probs[1 : c.seed_len - short + 1].take(parent[long], axis=1)
        after[-1, :n], after[-1, n:] = newest[keep], p[new]
        join = np.concatenate
        paths = [join((lo, slo)), join((hi, shi)), join((kmer, new % n_kmers)), join((stays, zeros)), join((moves, zeros)), join((steps, zeros + 1)), join((score, p[new])), after]
        return join((owner, mine)), paths, seeded

    @staticmethod
    def _older(probs: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The sum of all but the oldest event of each path: eight lanes, which are joined, and then the rest. Most paths are so short that their lanes are empty."""
        rows = probs[1:]
        whole = len(rows) // 8 * 8
        out = np.zeros(rows.shape[1])
        long = np.flatnonzero(steps > len(rows) - whole)
        if whole and len(long):
            r = rows[:whole].take(long, axis=1).reshape(-1, 8, len(long)).sum(axis=0)
            out[long] = ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))
        for row in rows[whole:]:
            out += row
        return out

    def _likeliest(self, n_beams: int, owner, lo, hi, score) -> np.ndarray:
        """Of a beam's equal ranges the likeliest, the first of equal ones, by owner and range; the best ``max_paths`` where there are more."""
        none = np.empty(0, dtype=np.int64)
        if not len(lo):
            return none
        span = self.fm.size + 1
        # at most 64 beams and ranges of two strands of 20 M bases: under 2^63
        key = (owner * span + lo) * span + hi
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(first, append=len(order))
        best, sorted_score, group, at = first.copy(), score[order], np.flatnonzero(size > 1), 1
        while len(group):
            rival = first[group] + at
            better = sorted_score[rival] > sorted_score[best[group]]
            best[group[better]] = rival[better]
            at += 1
            group = group[size[group] > at]
        order = order[best]
        counts = np.bincount(owner[order], minlength=n_beams)
        if (counts > self.conf.max_paths).any():
            parts = np.split(order, np.cumsum(counts)[:-1])
            order = np.concatenate([q if len(q) <= self.conf.max_paths else q[np.argsort(-score[q], kind="stable")[: self.conf.max_paths]] for q in parts])
        return order

    def _uncovered(self, which, lo, hi, at):
        """The parts of the ranges of the given k-mers (of a beam) that no path's range covers. ``at``: each path's k-mer, likewise."""
        none = np.empty(0, dtype=np.int64)
        if not len(which):
            return none, none, none
        wanted = np.zeros(max(int(which[-1]), int(at.max())) + 1, dtype=bool)
        wanted[which] = True
        order = np.flatnonzero(wanted[at])
        # a beam's paths come by range, save where there were too many, and each k-mer's ranges lie together; a number of 16 bits is ordered by its digits
        if len(at) == 0 or np.all((at[1:] // 4**K > at[:-1] // 4**K) | (lo[1:] >= lo[:-1])):
            order = order[np.argsort(at[order].astype(np.uint16 if len(wanted) <= 1 << 16 else np.int64), kind="stable")]
        else:
            order = order[np.lexsort((lo[order], at[order]))]
        k, left, right = at[order], lo[order], hi[order]
        # the furthest end so far within a k-mer: ranges of one k-mer stay within its own, so a shift per k-mer keeps them apart
        turn = np.concatenate(([True], k[1:] != k[:-1]))
        group = np.cumsum(turn) - 1
        shift = group * (self.fm.size + 1)
        reach = np.maximum.accumulate(right + shift) - shift
        begin = np.where(turn, self.kmer_lo[k % 4**K], np.concatenate(([0], reach[:-1])))
        last = np.concatenate((turn[1:], [True]))
        glo, ghi, gk = np.concatenate((begin, reach[last])), np.concatenate((left, self.kmer_hi[k[last] % 4**K])), np.concatenate((k, k[last]))
        free = ghi > glo
        return glo[free], ghi[free], gk[free]

    def _seeds(self, beams: list[Beam], owner, paths, full, ended: bool) -> set[int]:
        """Add the seeds among full paths to their beams' chains; the beams that got one."""
        if not len(full):
            return set()
        c, (lo, hi, _, _, moves, _, score, _) = self.conf, paths
        full = full[score[full] >= c.min_seed_prob]
        n_moves = np.bitwise_count(moves[full]).astype(np.int64)
        size = hi[full] - lo[full]
        ok = (size <= c.max_copies) if ended else ((size == 1) & (c.seed_len - 1 - n_moves <= c.max_stay_share * c.seed_len))
        full, n_moves = full[ok], n_moves[ok]
        mine = owner[full].tolist()
        for i, b, m in zip(full.tolist(), mine, n_moves.tolist(), strict=True):
            beam = beams[b]
            evt = beam.events - ended
            for place in self.fm.places(int(lo[i]), int(hi[i]), m + K).tolist():
                chain = beam.clusters.add(place + m, m + 1, evt)
                if beam.seen_seeds is not None:
                    beam.seen_seeds.append((place, place + m + K, evt, int(np.count_nonzero(owner[:i] == b)), chain))
        return set(mine)

    def _note_paths(self, beams: list[Beam], owner, before, parent, paths) -> None:
        """Note the paths that go on, which come by owner; ``before``: the owners of the paths that parents are among."""
        lo, hi, kmer, _, moves, steps, score, _ = paths
        ends = np.searchsorted(owner, np.arange(len(beams) + 1)).tolist()
        number = _rank(before)[parent] if any(b.seen_paths is not None for b in beams) else None
        for beam, a, b in zip(beams, ends, ends[1:], strict=False):
            if a < b and beam.seen_counts is not None:
                beam.seen_counts.append((beam.events, b - a, int(steps[a:b].max())))
            if a < b and beam.seen_paths is not None:
                beam.seen_paths.append((beam.events, *(v[a:b] for v in (number, lo, hi - lo, kmer, steps, score, moves))))

    def located(self, best: list):
        """A chain's place: forward, 0-based and half-open, in its own sequence."""
        st, en, size = best[0], best[2] + K, self.fm.size
        fwd = st < size // 2
        at = st if fwd else size - en
        name, local, length = self.ref.at(at) if self.ref else (None, at, self.length)
        return {"is_fwd": bool(fwd), "rf_name": name, "rf_len": length, "rf_st": local, "rf_en": local + en - st, "matches": int(best[5]) + K - 1}

    def record(self, beam: Beam, mean_length: float | None) -> dict:
        """The read's record: unmapped ones have nulls. Read places are events by their mean length, in bases."""
        bp = lambda evt, last: int(max(0, evt) * (mean_length or 0.0) * BASES_PER_SECOND / SAMPLES_PER_SECOND) + (K - 1 if last else 0)
        out = {"is_mapped": beam.best is not None, "events": beam.events, "qr_len": bp(beam.events, True)}
        if beam.best is None:
            return out
        return out | {"qr_st": bp(beam.best[3] - self.conf.seed_len, False), "qr_en": bp(beam.best[4], True)} | self.located(beam.best)

    def search_all(self, signals: list[np.ndarray], beams: list[Beam]) -> list[dict]:
        """Search whole signals side by side in new beams: their records."""
        cuts = [boundaries(x, self.conf.segment) for x in signals]
        found = [events(x, self.conf.segment, c) for x, c in zip(signals, cuts, strict=True)]
        self.advance_all(beams, [self.normalise(np.array([e[2] for e in f])) if f else np.empty(0) for f in found])
        return [self.record(b, mean_event_length(x, self.conf.segment, c)) for b, x, c in zip(beams, signals, cuts, strict=True)]

    def map_signal(self, signal: np.ndarray) -> dict:
        return self.search_all([signal], [Beam(self.conf)])[0]


FIELDS = [("read_id", "long"), ("is_mapped", "boolean"), ("is_fwd", "boolean"), ("rf_name", "string"), ("rf_len", "long"), ("rf_st", "long"), ("rf_en", "long"), ("matches", "long"), ("events", "long"), ("qr_len", "long"), ("qr_st", "long"), ("qr_en", "long"), ("mt", "double")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
_BUILT: dict[str, Mapper] = {}
#: Reads that are searched side by side; up to 64 a k-mer of a beam has a number of 16 bits, which is ordered faster.
TOGETHER = 32


def worker_mapper(build: Callable[[], Mapper], name: str) -> Mapper:
    """The mapper of this name, made once a worker; an older one goes first, as each holds a whole reference."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build()
    return _BUILT[name]


def _mapped(reads: DataFrame, fields: list[tuple[str, str]], columns_of: Callable, carry: tuple[str, ...] = ()) -> DataFrame:
    """``columns_of`` (ids, signals) gives the fields' columns for some reads; with ``carry``, one row a read, which takes these columns of the reads along."""
    types = [(f"`{c}`", reads.schema[c].dataType.simpleString()) for c in carry]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                signals = [np.array(s.as_py() or [], dtype=float) for s in part.column("signal")]
                columns = columns_of(part.column("read_id").to_pylist(), signals)
                made = [c if isinstance(c, pa.Array) else pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(made + [part.column(c) for c in carry], names=[n for n, _ in fields] + list(carry))

    return reads.selectExpr("cast(read_id as bigint) read_id", "cast(signal as array<double>) signal", *[n for n, _ in types]).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields + types))


def _columns(rows: list[dict], fields: list[tuple[str, str]]) -> list[list]:
    return [[r.get(n) for r in rows] for n, _ in fields]


def map_reads(reads: DataFrame, build: Callable[[], Mapper], name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """reads (read_id, signal) to records. ``build`` makes the mapper, once a worker, from bounded inputs (a reference of at most MAX_BASES).

    ``mt`` is the milliseconds that a read took, of reads searched side by side its share by events; all else follows the
    read alone. Columns of the reads that ``carry`` names stand behind.
    """

    def some(ids, signals):
        mapper, began = worker_mapper(build, name), time.perf_counter()
        rows = mapper.search_all(signals, [Beam(mapper.conf) for _ in ids])
        share = 1000 * (time.perf_counter() - began) / sum(r["events"] + 1 for r in rows)
        return _columns([{"read_id": i} | r | {"mt": share * (r["events"] + 1)} for i, r in zip(ids, rows, strict=True)], FIELDS)

    return _mapped(reads, FIELDS, some, carry)


SEED_FIELDS = [("read_id", "long"), ("rf", "string"), ("st", "long"), ("en", "long"), ("evt", "long"), ("path", "long"), ("cluster", "long"), ("is_fwd", "boolean")]
PATH_FIELDS = [("read_id", "long"), ("evt", "long"), ("path", "long"), ("parent", "long"), ("fm_start", "long"), ("fm_len", "long"), ("kmer", "long"), ("full_len", "long"), ("match_prob", "double"), ("moves", "string")]
COUNT_FIELDS = [("read_id", "long"), ("evt", "long"), ("n", "long"), ("longest", "long")]
EVENT_FIELDS = [("read_id", "long"), ("evt", "long"), ("start", "long"), ("length", "long"), ("mean", "double"), ("stdv", "double"), ("norm", "double")]


def seed_table(reads: DataFrame, build: Callable[[], Mapper], name: str) -> DataFrame:
    """Every seed of the reads' searches: its place on the forward strand, event, path number and chain."""

    def some(ids, signals):
        mapper = worker_mapper(build, name)
        beams, size = [Beam(mapper.conf, seen_seeds=[]) for _ in ids], mapper.fm.size
        mapper.search_all(signals, beams)
        out = []
        for i, beam in zip(ids, beams, strict=True):
            for st, en, evt, path, number in beam.seen_seeds:
                fwd = st < size // 2
                at = st if fwd else size - en
                rf, local, _ = mapper.ref.at(at) if mapper.ref else (None, at, 0)
                out.append((i, rf, local, local + en - st, evt, path, number, fwd))
        return list(zip(*out, strict=True)) if out else [[]] * len(SEED_FIELDS)

    return _mapped(reads, SEED_FIELDS, some)


def path_table(reads: DataFrame, build: Callable[[], Mapper], name: str) -> DataFrame:
    """Every path that an event leaves, with its parent among those of the event before (a new path has none and is listed with its first child)."""

    def some(ids, signals):
        mapper = worker_mapper(build, name)
        beams = [Beam(mapper.conf, seen_paths=[]) for _ in ids]
        mapper.search_all(signals, beams)
        seen = [(i, *e) for i, beam in zip(ids, beams, strict=True) for e in beam.seen_paths]
        if not seen:
            return [[]] * len(PATH_FIELDS)
        sizes = [len(e[2]) for e in seen]
        parent, lo, size, kmer, steps, score, moves = (np.concatenate([e[k] for e in seen]) for k in range(2, 9))
        # the newest step first, as one letter a step
        step = np.arange(mapper.conf.seed_len - 1)
        letters = (((moves[:, None] >> step) & 1) + ord("0")).astype(np.uint8)[step < steps[:, None] - 1]
        ends = np.concatenate(([0], np.cumsum(steps - 1)))
        bits = pa.LargeStringArray.from_buffers(len(steps), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())
        of = lambda v: pa.array(np.repeat(np.array(v, dtype=np.int64), sizes))
        read = pa.array([e[0] for e in seen], pa.int64()).take(of(range(len(seen))))
        return [read, of([e[1] for e in seen]), pa.array(np.concatenate([np.arange(n) for n in sizes])), *(pa.array(v) for v in (parent, lo, size, kmer, steps, score)), bits]

    return _mapped(reads, PATH_FIELDS, some)


def path_counts(reads: DataFrame, build: Callable[[], Mapper], name: str) -> DataFrame:
    """How many rows ``path_table`` has for each event, and the longest path: (read_id, evt, n, longest). The paths stay in the worker."""

    def some(ids, signals):
        mapper = worker_mapper(build, name)
        beams = [Beam(mapper.conf, seen_counts=[]) for _ in ids]
        mapper.search_all(signals, beams)
        out = [(i, *e) for i, beam in zip(ids, beams, strict=True) for e in beam.seen_counts]
        return list(zip(*out, strict=True)) if out else [[]] * len(COUNT_FIELDS)

    return _mapped(reads, COUNT_FIELDS, some)


def event_table(reads: DataFrame, build: Callable[[], Mapper], name: str) -> DataFrame:
    """The events of the reads, as measured and as the search sees them."""

    def some(ids, signals):
        mapper, out = worker_mapper(build, name), []
        for i, signal in zip(ids, signals, strict=True):
            found = events(signal, mapper.conf.segment)
            norm = mapper.normalise(np.array([e[2] for e in found])) if found else []
            out += [(i, k, *e, float(x)) for k, (e, x) in enumerate(zip(found, norm, strict=True))]
        return list(zip(*out, strict=True)) if out else [[]] * len(EVENT_FIELDS)

    return _mapped(reads, EVENT_FIELDS, some)
