"""Raw fixtures, and a plain row-by-row account of what an ingest must find."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from statistics import median

START = datetime(2026, 1, 1)


@dataclass
class File:
    """`rows` are (time, {head: (count, torque, status)}); None is missing."""

    name: str
    rows: list = field(default_factory=list)

    @property
    def heads(self):
        return sorted(self.rows[0][1]) if self.rows else []

    def csv(self, heads=None):
        heads = heads or self.heads
        names = [f"{h} {f}" for f in ("Count", "AppTorque", "Status") for h in heads]
        lines = [",".join(["timestamp", *names])]
        for at, values in self.rows:
            cells = ["" if values[h][i] is None else repr(float(values[h][i])) for i in range(3) for h in heads]
            lines.append(",".join([at.isoformat(timespec="milliseconds"), *cells]))
        return "\n".join(lines) + "\n"


def at(seconds):
    return START + timedelta(seconds=seconds)


def one_head(*days, torque=2.0, status=0, head="H01"):
    """Files from lists of counts, or of (second, count) pairs."""
    files, clock = [], 0
    for i, counts in enumerate(days):
        f = File(f"day{i + 1:02d}.csv")
        for c in counts:
            if isinstance(c, tuple):
                clock, c = c
            f.rows.append((at(clock), {head: (c, torque, status)}))
            clock += 1
        files.append(f)
    return files


def write(files, folder):
    folder.mkdir(parents=True, exist_ok=True)
    for f in files:
        (folder / f.name).write_text(f.csv())
    return str(folder)


def raw_500():
    f = File("synthetic_2026-01-01.csv")
    counts = {"H01": 100, "H02": 100, "H03": 100}
    for i in range(500):
        idle = 300 <= i < 360
        if i and not idle:
            counts["H01"] += 1
            counts["H02"] += i % 2 == 1
            counts["H03"] += i >= 50
        status = dict.fromkeys(counts, 2 if idle else 0)
        if i == 100:
            status["H01"] = 9
        if i in (150, 151):
            status["H03"] = 65
        torque = {"H01": 2.5, "H02": 2.0, "H03": 1.8}
        f.rows.append((at(i), {h: (counts[h], 0.0 if idle else torque[h], status[h]) for h in counts}))
    return f


def split(f, *cuts):
    ends = [0, *cuts, len(f.rows)]
    return [File(f"part{i:02d}.csv", f.rows[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def random_archive(seed, n_files=5, heads=("H01", "H02")):
    """Counters with stuck zeros, missing values, resets and pauses."""
    rng = random.Random(seed)
    counts = {h: rng.randint(0, 5) for h in heads}
    stuck = dict.fromkeys(heads, 0)
    files, clock, idle = [], 0, 0
    for i in range(n_files):
        f = File(f"day{i:02d}.csv")
        present = [h for h in heads if i == 0 or rng.random() > 0.15] or [heads[0]]
        for _ in range(rng.randint(1, 25)):
            clock += rng.choice([1, 1, 1, 1, 1, 2, 9, 0])
            idle = idle - 1 if idle else rng.choice([0] * 9 + [4, 40])
            row = {}
            for h in present:
                counts[h] += rng.choice([0, 1, 1, 3])
                if rng.random() < 0.03:
                    counts[h] = rng.randint(0, 2)
                stuck[h] = stuck[h] - 1 if stuck[h] else rng.choice([0] * 14 + [1, 2, 12, 40])
                shown = 0 if stuck[h] else counts[h]
                shown = None if rng.random() < 0.06 else shown
                status = 2 if idle else rng.choice([0, 0, 0, 9, 65, 4, None])
                row[h] = (shown, rng.choice([0.0, 1.5, 2.0, -1.0, None]), status)
            f.rows.append((at(clock), row))
        files.append(f)
    return files


# --- the account --------------------------------------------------------------


def usual_step(steps):
    steps = [s for s in steps if s is not None]
    return median(steps) if steps else None


def account(files):
    """Events, resets, masked rows and idle periods, one reading at a time."""
    found = {"events": [], "resets": [], "masked": 0, "idle": []}
    last, segment, last_time = {}, {}, None
    runs = []
    for number, f in enumerate(files):
        times = [t for t, _ in f.rows]
        steps = [None if last_time is None else (times[0] - last_time).total_seconds()]
        steps += [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        usual = usual_step(steps)
        usual = usual if usual and usual > 0 else 1.0
        next_last, next_segment = {}, {}
        for h in f.heads:
            counts = [v[h][0] for _, v in f.rows]
            hidden = corrupted(counts, last.get(h), later_value(files[number + 1 :], h))
            found["masked"] += len(hidden)
            value, seg = last.get(h), segment.get(h, 0)
            for i, c in enumerate(counts):
                if c is None or i in hidden:
                    continue
                if value is not None and c < value:
                    seg += 1
                    found["resets"].append((times[i], h, value, c, seg - 1, seg, f.name))
                if value is not None and c > value:
                    gap = steps[i] is not None and steps[i] > 2 * usual
                    quality = "gap" if gap else "aggregated" if c - value > 1 else "single"
                    found["events"].append((times[i], h, seg, c, c - value, quality, f.name))
                value = c
            if value is not None:
                next_last[h] = value
            next_segment[h] = seg
        last, segment = next_last, next_segment
        runs.append(idle_runs(f, times))
        last_time = times[-1]
    found["idle"] = idle_periods(runs)
    return found


def later_value(files, h):
    for f in files:
        for _, v in f.rows:
            if h in v and v[h][0]:
                return v[h][0]
    return None


def corrupted(counts, before_file, after_file):
    hidden, i = set(), 0
    while i < len(counts):
        if counts[i] != 0:
            i += 1
            continue
        j = i
        while j < len(counts) and counts[j] == 0:
            j += 1
        earlier = [c for c in counts[:i] if c is not None]
        before = before_file if i == 0 else (earlier[-1] if earlier else None)
        after = after_file if j == len(counts) else counts[j]
        if before and after is not None and after >= before:
            hidden |= set(range(i, j))
        i = j
    return hidden


def idle_runs(f, times):
    steps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    usual = usual_step([s for s in steps if s > 0])
    runs = []
    for i, (t, values) in enumerate(f.rows):
        if any(v[2] != 2 for v in values.values()):
            continue
        paused = i > 0 and usual and steps[i - 1] > 2 * usual
        if runs and runs[-1][1] == i - 1 and not paused:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    n = len(f.rows)
    return [[times[a], times[b], b - a + 1, a == 0, b == n - 1] for a, b in runs]


def idle_periods(files):
    whole, pending = [], None
    for runs in files:
        for run in runs:
            if pending is not None:
                if run[3] and (run[0] - pending[1]).total_seconds() <= 5:
                    run = [pending[0], run[1], pending[2] + run[2], False, run[4]]
                else:
                    whole.append(pending)
                pending = None
            if run[4]:
                pending = run
            else:
                whole.append(run)
        if not runs and pending is not None:
            whole.append(pending)
            pending = None
    if pending is not None:
        whole.append(pending)
    long = [(a, b, (b - a).total_seconds()) for a, b, n, *_ in whole if n >= 30 or (b - a).total_seconds() >= 30]
    return sorted(long)
