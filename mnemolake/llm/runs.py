"""Runs of near-identical consecutive events, by pruned dynamic programming.

Per entity the ordered events x1..xn are segmented so that  sum of the runs' dissimilarity + penalty * (number of runs)
is least.  A run's dissimilarity is what its neighbours differ, plus the REACHth part of what each event differs from those
up to REACH places before it in the run: an event that differs for a moment costs little, a lasting change much.
F(j) = min over starts i of F(i) + C(i..j) + penalty is computed with pruning: C of a run is never less than the sum of its
parts, so a start whose cost has reached F(j) + penalty can never win again and is dropped; once one start is left, all
runs before it are settled and leave memory.  A gap, another entity or another app costs without bound.  The state is the
live starts and the last REACH titles, however long a run; neighbours with equal titles are added at once (a border within
them is never better than one at their ends).  Of equal costs the longer first run wins.

Dissimilarity of two titles is 0 if they name the same window, else OTHER to 1 by the words they do not share.  With the
default penalty, of less than half of OTHER, no run holds two windows, however alike, as a number or version makes another
window.  With a greater penalty a run bridges events that differ from it for a moment.

The events are range-partitioned by (entity, time), so an entity with a third of all rows is spread over many tasks; each
task streams its sorted rows.  A task does not know what precedes its first certain border (a gap, another app, or
neighbours that differ by more than the penalty, which every optimum separates) nor what follows its last settled run.
These open ends leave it as blocks of equal titles, and a second pass of the same programme over them joins the tasks.

Nulls: no part is taken by events without entity (null or '') or time (null or <= 0); a null app or title equals ''.
Ties in time are ordered by id.  Rows repeated under one id count once.  Empty tables give no runs.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize, once_per_id, partitions

GAP_MS = 1_800_000
PENALTY, OTHER, REACH = 0.2, 0.5, 8

_CLOCK = r"\d{1,3}(?::\d{2}){1,2}"
_WORDS = r"(?:edited|modified|unsaved|saved|saving|loading|not responding|muted|unmuted|paused|playing|read[- ]only|offline|syncing|recording)"
#: State that applications put before a title.
_BEFORE = re.compile(
    r"^(?:\(\d+\+?\)|\[\d+\+?\]|\[?\d{1,3} ?%\]?|\[" + _CLOCK + r"\]|(?:loading|saving|connecting)(?:…|\.\.\.)|[⠀-⣿●•○◉▶►⏸⏵⏹🔊🔇🔈🔴✱∗*!])(?=\s|[^\W\d_]|[#~/]|$)\s*", re.I
)
#: State that applications put behind a title.
_AFTER = re.compile(
    r"(?:"
    r"\s*\*|\s*\[\+\]|\s+●"
    r"|\s*[\[(]" + _WORDS + r"[\])]"
    r"|\s*\(\d+\+? (?:unread|new)\)"
    r"|\s*\((?:autosaved|running|elapsed|saved)(?: at)? " + _CLOCK + r"\)"
    r"|\s+[-|·] (?:" + _WORDS + r"(?:…|\.\.\.)?"
    r"|last edit(?:ed)? \d+ \w+ ago"
    r"|\d+\+? (?:new |unread )?(?:messages?|items?|notifications?|participants?)"
    r"|rec " + _CLOCK + r"|\d+×\d+)"
    r")$",
    re.I,
)
_DASH = re.compile(r"[‐-―−]")
_SPACE = re.compile(r"\s+")


def title_key(title: str | None) -> tuple[str, bool]:
    """(the named window, whether its name is cut off): without case, spacing, dash forms and passing state."""
    if not title:
        return "", False
    s = title if title.isascii() else unicodedata.normalize("NFC", title).replace("​", "").replace("﻿", "")
    s = _SPACE.sub(" ", _DASH.sub("-", s)).strip().casefold()
    while s:
        t = _BEFORE.sub("", _AFTER.sub("", s), count=1).strip()
        if t == s or not t:
            break
        s = t
    for dots in ("…", "..."):
        if s.endswith(dots) and len(s) > len(dots) + 2:
            return s[: -len(dots)].rstrip(), True
    return s, False


def app_key(app: str | None) -> str:
    return (app or "").strip().casefold()


@functools.lru_cache(100_000)
def title_dissimilarity(a: tuple[str, bool], b: tuple[str, bool]) -> float:
    """0 if both name the same window (a name that is cut off matches every longer name it begins), else OTHER to 1."""
    if a == b:
        return 0.0
    (x, xcut), (y, ycut) = a, b
    if xcut and ycut:
        same = x.startswith(y) or y.startswith(x)
    else:
        same = (xcut and len(y) > len(x) and y.startswith(x)) or (ycut and len(x) > len(y) and x.startswith(y))
    if same:
        return 0.0
    p, q = set(x.split()), set(y.split())
    return 1.0 - (1.0 - OTHER) * len(p & q) / max(1, len(p | q))


class _Start:
    """A run that may begin here: cost of all before it and of itself, its first event, its place and the runs before it."""

    __slots__ = ("cost", "first", "at", "before")

    def __init__(self, cost: float, first: tuple, at: int, before):
        self.cost, self.first, self.at, self.before = cost, first, at, before


class PrunedSegmentation:
    """Streaming form of the pruned programme over one chain of blocks; settled runs are returned as they leave.

    A run is (first block, end of its last block, number of events)."""

    def __init__(self, penalty: float, differ: Callable = title_dissimilarity):
        self.penalty, self.differ = penalty, differ
        self.starts: list[_Start] = []
        self.recent: list[tuple[int, tuple]] = []  # place and title of the last REACH events
        self.n, self.last_end, self.last_key = 0, None, None

    def add(self, key, n: int, end, first) -> list[tuple]:
        """A block of n events with one title; `first` describes its first event."""
        if not (len(self.starts) == 1 and key == self.last_key and self.starts[0].at <= self.n - REACH and self.recent[0][1] == key):
            # what the block differs from the events before it, nearest first
            steps = []
            for place, k in reversed(self.recent):
                if d := self.differ(k, key):
                    lag = self.n - place
                    steps.append((place, d * (min(n, REACH - lag + 1) / REACH + (lag == 1) * (1 - 1 / REACH))))
            if self.starts:
                best = min(self.starts, key=lambda s: (s.cost, s.at))
                new = _Start(best.cost + self.penalty, first, self.n, (best.before, (best.first, self.last_end, self.n - best.at)))
                for s in self.starts:
                    s.cost += sum(c for place, c in steps if place >= s.at)
                bound = min(new.cost, *(s.cost for s in self.starts)) + self.penalty - 1e-9
                self.starts = [s for s in (*self.starts, new) if s.cost < bound]
            else:
                self.starts = [_Start(self.penalty, first, self.n, None)]
        self.n, self.last_end, self.last_key = self.n + n, end, key
        self.recent = [x for x in self.recent if x[0] >= self.n - REACH] + [(i, key) for i in range(max(self.n - n, self.n - REACH), self.n)]
        return self._settled() if len(self.starts) == 1 else []

    def _settled(self) -> list[tuple]:
        s, out = self.starts[0], []
        before, s.before = s.before, None
        while before:
            before, run = before
            out.append(run)
        return out[::-1]

    def end(self) -> list[tuple]:
        if not self.starts:
            return []
        self.starts = [min(self.starts, key=lambda s: (s.cost, s.at))]
        out, s = self._settled(), self.starts[0]
        self.starts = []
        return [*out, (s.first, self.last_end, self.n - s.at)]


def best_segmentation(keys: list, penalty: float, differ: Callable = title_dissimilarity) -> list[tuple[int, int]]:
    """Runs (first, last) of one chain of events."""
    dp, out = PrunedSegmentation(penalty, differ), []
    for j, k in enumerate(keys):
        out += dp.add(k, 1, j, j)
    return [(a, z) for a, z, _ in out + dp.end()]


_RUN_SCHEMA = "session_id string, start_ms bigint, end_ms bigint, app_name string, window_title string, n bigint, settled boolean, begins boolean, place bigint"
COLUMNS = [c.split()[0] for c in _RUN_SCHEMA.split(", ")]


def _segment(gap_ms: int, penalty: float, differ: Callable, whole: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks (e, t, z, app, title, n, begins) to runs.  begins: a run starts here for certain; whole: nothing is left open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: dict[str | None, tuple[str, bool]] = {}
        apps: dict[str | None, str] = {}
        dp = PrunedSegmentation(penalty, differ)
        prev = None  # entity, end, app, key of the last event
        head = None if whole else []  # the block before the first certain border
        known = whole
        open_blocks: list[list] = []  # of runs that are not settled
        context = TaskContext.get()
        place = (context.partitionId() if context else 0) << 33  # the order of the open blocks over all tasks

        def settle(runs: list[tuple]) -> list[list]:
            if runs and not whole:
                keep = dp.starts[0].at if dp.starts else dp.n
                while open_blocks and open_blocks[0][8] < keep:
                    open_blocks.pop(0)
            return [[f[0], f[1], z, f[3], f[4], n, True, True, 0] for f, z, n in runs]

        for pdf in batches:
            out: list[list] = []
            e, t, z, app, title, count, begins = (pdf[c].to_numpy() for c in ("e", "t", "z", "app", "title", "n", "begins"))
            # neighbours that are equal in all are one block from the start
            same = np.zeros(len(pdf), bool)
            if len(pdf) > 1:
                same[1:] = (e[1:] == e[:-1]) & (app[1:] == app[:-1]) & (title[1:] == title[:-1]) & (t[1:] - z[:-1] <= gap_ms) & ~begins[1:]
            cuts = np.flatnonzero(~same)
            sums = np.add.reduceat(count, cuts) if len(cuts) else count
            ends = z[np.append(cuts[1:], len(pdf)) - 1] if len(cuts) else z
            for i, n, last in zip(cuts.tolist(), sums.tolist(), ends.tolist()):
                a, x = app[i], title[i]
                if (k := keys.get(x)) is None:
                    if len(keys) > 200_000:
                        keys.clear()
                    k = keys[x] = title_key(x)
                if (g := apps.get(a)) is None:
                    if len(apps) > 200_000:
                        apps.clear()
                    g = apps[a] = app_key(a)
                first = (e[i], int(t[i]), last, a, x)
                hard = begins[i] or (prev is not None and (prev[0] != e[i] or t[i] - prev[1] > gap_ms or prev[2] != g))
                if not known:
                    if hard or (prev is not None and differ(prev[3], k) > penalty):
                        known = True
                        if head:
                            out.append(head)
                            place += 1
                    elif head and prev[3] == k:
                        head[2], head[5] = last, head[5] + n
                    else:
                        if head:
                            out.append(head)
                            place += 1
                        head = [*first, n, False, False, place]
                if known:
                    if hard:
                        out += settle(dp.end())
                        dp = PrunedSegmentation(penalty, differ)
                        open_blocks.clear()
                    at = dp.n
                    equal = dp.starts and dp.last_key == k
                    out += settle(dp.add(k, n, last, first))
                    if not whole:
                        if equal and open_blocks:
                            open_blocks[-1][2], open_blocks[-1][5] = last, open_blocks[-1][5] + n
                        else:
                            open_blocks.append([*first, n, False, False, at])
                prev = (e[i], last, g, k)
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        if whole:
            tail = settle(dp.end())
        elif known:
            tail = [[*x[:7], i == 0, place + 1 + i] for i, x in enumerate(open_blocks)]
        else:
            tail = [head] if head else []
        if tail:
            yield pd.DataFrame(tail, columns=COLUMNS)

    return run


def collapse_runs(
    df: DataFrame,
    entity: str = "session_id",
    time: str = "captured_at_ms",
    app: str = "app_name",
    title: str = "window_title",
    key: str = "id",
    gap_ms: int = GAP_MS,
    penalty: float = PENALTY,
) -> DataFrame:
    """One row per run: session_id, app_name, window_title (of its first event), start_ms, end_ms, duration_ms, n."""
    known = df.filter((F.col(time) > 0) & (F.col(entity) != ""))
    d = once_per_id(known, key, time, entity, app, title)
    d = d.select(F.col(entity).alias("e"), F.col(time).alias("t"), F.col(time).alias("z"), F.col(app).alias("app"), F.col(title).alias("title"), F.col(key).alias("id"))
    n = partitions(df.sparkSession)
    d = d.repartitionByRange(n, "e", "t", "id").sortWithinPartitions("e", "t", "id").drop("id").withColumns({"n": F.lit(1).cast("bigint"), "begins": F.lit(False)})
    runs = materialize(d.mapInPandas(_segment(gap_ms, penalty, title_dissimilarity, False), _RUN_SCHEMA))
    cols = ["session_id", "app_name", "window_title", "start_ms", "end_ms", "n"]
    ends = runs.filter(~F.col("settled")).select(
        F.col("session_id").alias("e"), F.col("start_ms").alias("t"), F.col("end_ms").alias("z"), F.col("app_name").alias("app"), F.col("window_title").alias("title"), "n", "begins", "place"
    )
    ends = ends.repartition(n, "e").sortWithinPartitions("e", "place")
    joined = ends.mapInPandas(_segment(gap_ms, penalty, title_dissimilarity, True), _RUN_SCHEMA)
    out = runs.filter("settled").select(*cols).unionByName(joined.select(*cols))
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
