"""Operators whose next step depends on their own last outcome.

Each is a fold over an ordered log. To keep one busy key from being one task, a
key's log is cut into chunks (`seq div size`) and folded in two passes:

1. every chunk is folded for *all* states it could be entered with. Trajectories
   that reach the same state are merged at once, so few stay alive; the result is
   a small table "entry state -> exit state";
2. the tables of a key, in chunk order, give each chunk its true entry state;
3. every chunk is folded again from that state and emits its rows.

All passes are sorted scans (`repartition` + `sortWithinPartitions` +
`mapInPandas`): state moves from Arrow batch to Arrow batch and no group is ever
held in memory. Logs must be in arrival order, with times that do not decrease.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from pricelake.operators.chunks import CHUNK, CHUNK_ROWS, add_chunk
from pricelake.session import materialize

# Guard limit, feed breaker and delivery settings, request limits.
GUARD_BPS = 2000
FAILURE_THRESHOLD = 3
COOLDOWN_MS = 30_000
HALF_OPEN_SUCCESSES = 2
MIN_INTERVAL_MS = 60_000
QUOTA_WINDOW_MS = 60_000
QUOTA_CHUNK_MS = 15 * QUOTA_WINDOW_MS
TIER_LIMITS = {"free": 60, "pro": 500, "enterprise": 10_000, "admin": 100_000}


def _scan(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def _rows(frame: pd.DataFrame, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, tuple]]:
    """(key, values) per row of one batch."""
    key_lists = [frame[k].tolist() for k in keys]
    value_lists = [frame[c].tolist() for c in columns]
    return zip(zip(*key_lists), zip(*value_lists))


def _compose(tables: DataFrame, key: str, start: str, advance: Callable[[str, str], str]) -> DataFrame:
    """Entry state per (key, chunk) from the chunk tables; one small row per chunk."""

    def walk(frames):
        current, state = None, start
        for frame in frames:
            out = []
            for name, chunk, table in zip(frame[key], frame[CHUNK], frame["table"]):
                if name != current:
                    current, state = name, start
                out.append((name, chunk, state))
                state = advance(state, table)
            yield pd.DataFrame(out, columns=[key, CHUNK, "entry"])

    return _scan(tables, [key], [CHUNK], walk, f"`{key}` string, `{CHUNK}` bigint, entry string")


def _two_pass(
    df: DataFrame, key: str, columns: list[str], *, start: str, tabulate: Callable, advance: Callable,
    replay: Callable, added: str, size: int,
) -> DataFrame:
    """`columns` feed the chunk tables; `replay` sees every column and adds `added`."""
    base = add_chunk(df, "seq", size)
    part = [key, CHUNK]
    slim = base.select(*part, *dict.fromkeys(["seq", *columns]))
    tables = _scan(slim, part, ["seq"], tabulate, f"`{key}` string, `{CHUNK}` bigint, table string")
    entries = _compose(tables, key, start, advance)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return _scan(base.join(entries, part), part, ["seq"], replay, f"{kept}, {added}")


# -- deviation guard ---------------------------------------------------------


def _within(price: int, previous: int | None, bps: int) -> bool:
    """Whether the guard lets `price` follow the accepted price `previous`."""
    return not previous or abs(price - previous) * 10000 // abs(previous) <= bps


def _accepting(price: int, bps: int) -> list[tuple[float | int, float | int]]:
    """Closed ranges of non-zero previous prices after which `price` is accepted.

    For previous q > 0 the rule is |price - q| * 10000 < (bps + 1) * q; negative
    q mirror it.
    """
    inf = float("inf")
    found = []
    for sign in (1, -1):
        p = price * sign
        low, high = max(1, (10000 * p) // (10001 + bps) + 1), inf
        slope = 9999 - bps
        if slope > 0:
            high = -((-10000 * p) // slope) - 1
        elif slope == 0:
            high = inf if p > 0 else 0
        else:
            low = max(low, (10000 * p) // slope + 1)
        if low <= high:
            found.append((low, high) if sign > 0 else (-high, -low))
    return found


class _Cover:
    """Disjoint ranges of entry prices, each tied to a trajectory."""

    def __init__(self):
        self.lows: list = []
        self.highs: list = []
        self.owner: list = []

    def claim(self, low, high, owner, root) -> bool:
        """Give every uncovered part of [low, high] to `owner`; whether there was any."""
        at = bisect_left(self.highs, low)
        found = False
        while low <= high:
            if at < len(self.lows) and self.lows[at] <= low:
                if self.highs[at] >= high:
                    break
                low = self.highs[at] + 1
                at += 1
                continue
            found = True
            upto = min(high, self.lows[at] - 1) if at < len(self.lows) else high
            if at > 0 and self.highs[at - 1] == low - 1 and root(self.owner[at - 1]) == root(owner):
                self.highs[at - 1] = upto
            else:
                self.lows.insert(at, low)
                self.highs.insert(at, upto)
                self.owner.insert(at, owner)
                at += 1
            if upto >= high:
                break
            low = upto + 1
        return found


def guard_replay(submissions: DataFrame, *, bps: int = GUARD_BPS, size: int = CHUNK_ROWS) -> DataFrame:
    """Add `accepted`: a submission may not move more than `bps` basis points from
    the last accepted price of its asset."""

    def tabulate(frames):
        state = {}

        def close():
            parent, price_of, cover = state["parent"], state["price"], state["cover"]
            root = _finder(parent)
            table = [[str(lo), str(hi), str(price_of[root(o)])]
                     for lo, hi, o in zip(cover.lows, cover.highs, cover.owner)]
            return (*state["key"], json.dumps({"zero": str(price_of[root(state["zero"])]), "ranges": table}))

        def _finder(parent):
            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i
            return root

        for frame in frames:
            done = []
            for key, (text,) in _rows(frame, ["asset", CHUNK], ["price"]):
                price = int(text)
                if state.get("key") != key:
                    if state:
                        done.append(close())
                    state.clear()
                    state.update(key=key, parent=[0], price=[price], alive=[0], cover=_Cover(), zero=0)
                    for low, high in _accepting(price, bps):
                        state["cover"].claim(low, high, 0, lambda i: i)
                    continue
                parent, price_of = state["parent"], state["price"]
                takes = [t for t in state["alive"] if _within(price, price_of[t], bps)]
                if takes:
                    head = takes[0]
                    for other in takes[1:]:
                        parent[other] = head
                    price_of[head] = price
                    if len(takes) > 1:
                        gone = set(takes[1:])
                        state["alive"] = [t for t in state["alive"] if t not in gone]
                else:
                    head = len(parent)
                    parent.append(head)
                    price_of.append(price)
                root = _finder(parent)
                claimed = [state["cover"].claim(low, high, head, root) for low, high in _accepting(price, bps)]
                if not takes and any(claimed):
                    state["alive"].append(head)
            yield pd.DataFrame(done, columns=["asset", CHUNK, "table"])
        if state:
            yield pd.DataFrame([close()], columns=["asset", CHUNK, "table"])

    def advance(entry: str, table: str) -> str:
        parsed = json.loads(table)
        if entry in ("", "0"):
            return parsed["zero"]
        q = int(entry)
        for low, high, exit_price in parsed["ranges"]:
            if (low == "-inf" or int(low) <= q) and (high == "inf" or q <= int(high)):
                return exit_price
        return entry

    def replay(frames):
        current, previous = None, None
        for frame in frames:
            flags = []
            for key, (text, entry) in _rows(frame, ["asset", CHUNK], ["price", "entry"]):
                if key != current:
                    current, previous = key, int(entry) if entry else None
                price = int(text)
                ok = _within(price, previous, bps)
                flags.append(ok)
                if ok:
                    previous = price
            yield frame[names].assign(accepted=flags)

    names = submissions.columns
    texts = submissions.withColumn("price", F.col("price").cast("string"))
    out = _two_pass(
        texts, "asset", ["price"], start="", tabulate=tabulate, advance=advance, replay=replay,
        added="accepted boolean", size=size)
    return out.withColumn("price", F.col("price").cast(submissions.schema["price"].dataType))


# -- feed breaker ------------------------------------------------------------

# Names of the states.
CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


def _call(state: tuple, ts: int, ok: bool, threshold: int, cooldown: int, needed: int) -> tuple[tuple, bool, int]:
    """One call: (state, allowed, trips). A state is (name, successes, failures, last failure)."""
    name, wins, failures, failed_at = state
    if name == OPEN:
        if ts - failed_at < cooldown:
            return state, False, 0
        name, wins = HALF_OPEN, 0
    if ok:
        if name == HALF_OPEN:
            wins += 1
            if wins >= needed:
                return (CLOSED, 0, 0, None), True, 0
            return (HALF_OPEN, wins, failures, None), True, 0
        return (CLOSED, 0, 0, None), True, 0
    failures += 1
    if name == HALF_OPEN or failures >= threshold:
        return (OPEN, 0, failures, ts), True, 1
    return (CLOSED, 0, failures, None), True, 0


def feed_breaker(
    calls: DataFrame, *, threshold: int = FAILURE_THRESHOLD, cooldown_ms: int = COOLDOWN_MS,
    successes: int = HALF_OPEN_SUCCESSES, size: int = CHUNK_ROWS,
) -> DataFrame:
    """Breaker timeline per source: state after each call, whether it was let
    through, the failure count and the trips so far.

    The failure count of an open or half-open feed has no bound, so a table entry
    keeps it relative to the entry (`base`) until the feed closes.
    """

    def tabulate(frames):
        # state -> [trips of the group, [(entry label, own offset)]]
        live: dict = {}
        key, newest, horizon = None, None, None

        def close():
            rows = sorted(
                ((label, state, trips + own) for state, (trips, members) in live.items() for label, own in members),
                key=lambda r: (r[0][0], int(r[0][1:])))
            slim = [r for r, after in zip(rows, [*rows[1:], None])
                    if r[0][0] != "O" or after is None or after[0][0] != "O" or after[1:] != r[1:]]
            return (*key, json.dumps(slim))

        def merge(target, state, trips, members):
            if state not in target:
                target[state] = [trips, members]
                return
            have_trips, have = target[state]
            if len(have) < len(members):
                have_trips, have, trips, members = trips, members, have_trips, have
            have.extend((label, own + trips - have_trips) for label, own in members)
            target[state] = [have_trips, have]

        for frame in frames:
            done = []
            for here, (ts, ok) in _rows(frame, ["source", CHUNK], ["ts_ms", "ok"]):
                if here != key:
                    if key is not None:
                        done.append(close())
                    live, key, newest, horizon = {}, here, None, ts + cooldown_ms
                    for f in range(threshold):
                        merge(live, (CLOSED, 0, f, None, False), 0, [(f"C{f}", 0)])
                    for w in range(successes):
                        merge(live, (HALF_OPEN, w, 0, None, True), 0, [(f"H{w}", 0)])
                if newest is None or ts > newest and newest < horizon:
                    # An open feed may resume here: first call at or after its time,
                    # which is at most a cool-down after the chunk begins.
                    merge(live, (HALF_OPEN, 0, 0, None, True), 0, [(f"O{ts}", 0)])
                newest = ts
                moved: dict = {}
                for state, (trips, members) in live.items():
                    after, _, more = _call(state[:4], ts, ok, threshold, cooldown_ms, successes)
                    merge(moved, (*after, state[4] and after[0] != CLOSED), trips + more, members)
                live = moved
            yield pd.DataFrame(done, columns=["source", CHUNK, "table"])
        if key is not None:
            yield pd.DataFrame([close()], columns=["source", CHUNK, "table"])

    def advance(entry: str, table: str) -> str:
        name, wins, failures, failed_at, trips = json.loads(entry)
        rows = {label: (state, n) for label, state, n in json.loads(table)}
        if name == CLOSED:
            label = f"C{failures}"
        elif name == HALF_OPEN:
            label = f"H{wins}"
        else:
            resume = sorted(int(x[1:]) for x in rows if x[0] == "O" and int(x[1:]) >= failed_at + cooldown_ms)
            if not resume:
                return entry
            label = f"O{resume[0]}"
        (after, wins, count, at, relative), more = rows[label]
        return json.dumps([after, wins, count + failures if relative else count, at, trips + more])

    def replay(frames):
        current, state, trips = None, None, 0
        for frame in frames:
            out = []
            for key, (ts, ok, entry) in _rows(frame, ["source", CHUNK], ["ts_ms", "ok", "entry"]):
                if key != current:
                    name, wins, failures, at, trips = json.loads(entry)
                    current, state = key, (name, wins, failures, at)
                state, allowed, more = _call(state, ts, ok, threshold, cooldown_ms, successes)
                trips += more
                out.append((allowed, state[0], state[2], trips))
            added = pd.DataFrame(out, columns=["allowed", "state", "failures", "trips"], index=frame.index)
            yield pd.concat([frame[names], added], axis=1)

    names = calls.columns
    return _two_pass(
        calls, "source", ["ts_ms", "ok"], start=json.dumps([CLOSED, 0, 0, None, 0]), tabulate=tabulate,
        advance=advance, replay=replay,
        added="allowed boolean, state string, failures bigint, trips bigint", size=size)


# -- interval webhooks -------------------------------------------------------


def webhook_interval(
    registrations: DataFrame, updates: DataFrame, *, floor_ms: int = MIN_INTERVAL_MS, size: int = CHUNK_ROWS
) -> DataFrame:
    """Fires of interval webhooks: at the first update at least max(value, 60 s)
    after the last fire.

    Updates are first reduced to one per asset and millisecond. `seq` orders the
    updates of an asset; time does not decrease along it.
    """
    once = updates.groupBy("asset", "ts_ms").agg(F.min("seq").alias("seq"))
    wanted = registrations.filter("type = 'interval'").select(
        "id", "asset", "created_ms", F.greatest(F.col("value").cast("bigint"), F.lit(floor_ms)).alias("wait"))
    pairs = once.join(wanted, "asset").filter(F.col("ts_ms") >= F.col("created_ms"))
    pairs = pairs.select("id", "seq", "ts_ms", "wait")

    def tabulate(frames):
        key = None
        allowed: list = []  # next allowed time per live trajectory, ascending
        labels: list = []  # entry bounds per trajectory
        newest = horizon = None

        def close():
            rows = sorted((bound, at) for at, group in zip(allowed, labels) for bound in group)
            slim = []
            for i, (bound, at) in enumerate(rows):
                if i + 1 < len(rows) and rows[i + 1][1] == at:
                    continue  # the next bound leads to the same exit
                slim.append([bound, at])
            return (*key, json.dumps(slim))

        for frame in frames:
            done = []
            for here, (ts, wait) in _rows(frame, ["id", CHUNK], ["ts_ms", "wait"]):
                if here != key:
                    if key is not None:
                        done.append(close())
                    key, allowed, labels, newest, horizon = here, [], [], None, ts + wait
                merged = None
                while allowed and allowed[0] <= ts:
                    allowed.pop(0)
                    group = labels.pop(0)
                    if merged is None:
                        merged = group
                    else:
                        merged.extend(group)
                if newest is None or ts > newest and newest < horizon:
                    # Entries allowed from (previous time, ts] fire here first; no
                    # entry can lie beyond one wait after the chunk begins.
                    merged = [ts] if merged is None else [*merged, ts]
                newest = ts
                if merged is not None:
                    allowed.append(ts + wait)
                    labels.append(merged)
            yield pd.DataFrame(done, columns=["id", CHUNK, "table"])
        if key is not None:
            yield pd.DataFrame([close()], columns=["id", CHUNK, "table"])

    def advance(entry: str, table: str) -> str:
        at = int(entry)
        rows = json.loads(table)
        spot = bisect_left([r[0] for r in rows], at)
        return str(rows[spot][1]) if spot < len(rows) else entry

    def replay(frames):
        current, at = None, 0
        for frame in frames:
            fires = []
            for key, (ts, wait, entry) in _rows(frame, ["id", CHUNK], ["ts_ms", "wait", "entry"]):
                if key != current:
                    current, at = key, int(entry)
                hit = ts >= at
                fires.append(hit)
                if hit:
                    at = ts + wait
            yield frame.loc[fires, names].assign(fired=True)

    names = pairs.columns
    return _two_pass(
        pairs, "id", ["ts_ms", "wait"], start=str(-(2**62)), tabulate=tabulate, advance=advance, replay=replay,
        added="fired boolean", size=size)


# -- request quota -----------------------------------------------------------


class _Log:
    """Accepted requests of one key that are still inside the window: (time, how many), oldest first."""

    def __init__(self, text: str | None = None):
        self.entries = [tuple(e) for e in json.loads(text)] if text else []
        self.first, self.total = 0, sum(n for _, n in self.entries)

    def leave(self, now: int) -> None:
        while self.first < len(self.entries) and self.entries[self.first][0] <= now - QUOTA_WINDOW_MS:
            self.total -= self.entries[self.first][1]
            self.first += 1
        if self.first > 4096:
            self.entries, self.first = self.entries[self.first:], 0

    def text(self, now: int) -> str:
        self.leave(now)
        return json.dumps(self.entries[self.first:])

    def walk(self, ts: np.ndarray, n: np.ndarray, busy: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(taken, time of the oldest logged request) per row; jumps over stretches that are rejected whole."""
        taken, oldest = np.zeros(len(ts), np.int64), ts.copy()
        # A limit of 0 lets nothing through, and no log ever begins.
        i = 0 if limit > 0 else len(ts)
        while i < len(ts):
            self.leave(ts[i])
            if self.total >= limit:
                # Nothing passes before the oldest request leaves the window.
                upto = int(np.searchsorted(ts, self.entries[self.first][0] + QUOTA_WINDOW_MS))
                oldest[i:upto] = self.entries[self.first][0]
                i = upto
                continue
            taken[i] = n[i] if not busy[i] else min(n[i], limit - self.total)
            self.entries.append((int(ts[i]), int(taken[i])))
            self.total += int(taken[i])
            oldest[i] = self.entries[self.first][0]
            i += 1
        return taken, oldest


_LOGS = f"key string, run bigint, `{CHUNK}` bigint, log string"
_PART = ["key", "run", CHUNK]


def _parts(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of equal keys of one sorted batch."""
    edges = np.flatnonzero(np.logical_or.reduce([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys])) + 1
    for a, b in zip([0, *edges], [*edges, len(frame)]):
        if b > a:
            yield tuple(frame[k].iloc[a] for k in keys), frame.iloc[a:b]


def _from_logs(rows: DataFrame, logs: DataFrame | None) -> DataFrame:
    """Rows of every chunk after a head row that holds the log it is entered with."""
    rows = rows.withColumn("log", F.lit(None).cast("string"))
    if logs is None:
        return rows
    heads = logs.select(
        *_PART, F.lit(-(2**62)).alias("ts_ms"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("busy"),
        F.lit(0).cast("bigint").alias("limit"), "log")
    return rows.unionByName(heads)


def _exits(rows: DataFrame, logs: DataFrame | None, chunk_ms: int) -> DataFrame:
    """The log that each chunk is left with, if entered with its own of `logs`, or else an empty one."""

    def fold(frames):
        current, log = None, _Log()
        for frame in frames:
            out = []
            for key, part in _parts(frame, _PART):
                if key != current:
                    if current is not None:
                        out.append((*current, log.text((current[2] + 1) * chunk_ms - 1)))
                    current, log = key, _Log(part["log"].iloc[0])
                    part = part.iloc[1:] if part["log"].iloc[0] is not None else part
                if len(part):
                    log.walk(*(part[c].to_numpy() for c in ("ts_ms", "n", "busy")), int(part["limit"].iloc[0]))
            yield pd.DataFrame(out, columns=["key", "run", CHUNK, "log"])
        if current is not None:
            yield pd.DataFrame([(*current, log.text((current[2] + 1) * chunk_ms - 1))], columns=["key", "run", CHUNK, "log"])

    return _scan(_from_logs(rows, logs), _PART, ["ts_ms"], fold, _LOGS)


def _chained(rows: DataFrame, chunk_ms: int) -> DataFrame:
    """The log that each chunk is entered with, found by one scan a run."""

    def fold(frames):
        current, chunk, log = None, None, _Log()
        for frame in frames:
            out = []
            for (key, run, here), part in _parts(frame, _PART):
                if (key, run) != current:
                    current, chunk, log = (key, run), here, _Log()
                elif here != chunk:
                    out.append((key, run, here, log.text(here * chunk_ms - 1)))
                    chunk = here
                log.walk(*(part[c].to_numpy() for c in ("ts_ms", "n", "busy")), int(part["limit"].iloc[0]))
            yield pd.DataFrame(out, columns=["key", "run", CHUNK, "log"])

    return _scan(rows, ["key", "run"], ["ts_ms"], fold, _LOGS)


def _entry_logs(rows: DataFrame, chunk_ms: int) -> DataFrame:
    """The log that each chunk but the first of a run is entered with.

    Chunks are run from an empty log, and once more from what the chunk before was left with then.
    If no log of a run changes the second time, each was entered as it truly is, by induction from
    the run's first chunk: the first start no longer matters, since all that it let through has left the
    window or is let through from every start. Runs in which a log does change go through in order.
    """
    last = rows.groupBy("key", "run").agg(F.max(CHUNK).alias("last"), F.min(CHUNK).alias("first"))
    last = last.filter(F.col("last") > F.col("first"))
    several = materialize(rows.join(last, ["key", "run"]).drop("first"), "quota-chunks")
    inner = several.filter(F.col(CHUNK) < F.col("last")).drop("last")
    guess = materialize(_exits(inner, None, chunk_ms), "quota-guess")
    after = lambda logs: logs.withColumn(CHUNK, F.col(CHUNK) + 1)
    starts = after(guess).join(inner.select(*_PART).distinct(), _PART, "left_semi")
    again = materialize(_exits(inner, starts, chunk_ms), "quota-again")
    changed = again.join(guess.withColumnRenamed("log", "before"), _PART).filter(F.col("log") != F.col("before"))
    changed = materialize(changed.select("key", "run").distinct(), "quota-changed")
    settled = after(again).join(changed, ["key", "run"], "left_anti")
    return settled.unionByName(_chained(several.drop("last").join(changed, ["key", "run"], "left_semi"), chunk_ms))


def quota_replay(requests: DataFrame, limits: DataFrame, *, chunk_ms: int = QUOTA_CHUNK_MS) -> DataFrame:
    """Add `allowed` and `retry_after_s`: which requests a sliding 60 s limit lets
    through. Rejected requests do not count against the limit.

    `requests`: key, seq, ts_ms; `limits`: key, limit. Requests of a key in the
    same millisecond share one row. A minute is calm when it and the minute before
    hold no more requests than the limit: everything in it is allowed, so the log
    falls apart into independent runs of busy minutes, each with one calm minute
    before it as its starting state. Runs are cut into chunks of `chunk_ms`, which are
    judged in tasks of their own once the log is known that each is entered with.
    """
    step = F.floor(F.col("ts_ms") / QUOTA_WINDOW_MS)
    per_ms = requests.groupBy("key", "ts_ms").agg(F.count(F.lit(1)).alias("n")).withColumn("minute", step)
    minutes = per_ms.groupBy("key", "minute").agg(F.sum("n").alias("m"))
    before = minutes.select("key", (F.col("minute") + 1).alias("minute"), F.col("m").alias("__prior"))
    minutes = minutes.join(before, ["key", "minute"], "left").join(limits, "key")
    busy = minutes.filter(F.col("m") + F.coalesce("__prior", F.lit(0)) > F.col("limit")).select("key", "minute", "limit")
    order = W.partitionBy("key").orderBy("minute")
    starts = (F.coalesce(F.lag("minute").over(order), F.lit(-1)) != F.col("minute") - 1).cast("bigint")
    runs = busy.withColumn("__s", starts).withColumn("run", F.sum("__s").over(order))
    heads = runs.filter("__s = 1").select("key", (F.col("minute") - 1).alias("minute"), "limit", "run")
    spans = runs.select("key", "minute", "limit", "run", F.lit(True).alias("busy")).unionByName(
        heads.withColumn("busy", F.lit(False)))
    rows = per_ms.join(spans, ["key", "minute"]).select(
        "key", "run", F.floor(F.col("ts_ms") / chunk_ms).alias(CHUNK), "ts_ms", "n", "busy",
        F.col("limit").cast("bigint").alias("limit"))
    rows = materialize(rows, "quota-rows")
    logs = _entry_logs(rows, chunk_ms)

    def judge(frames):
        current, log = None, _Log()
        for frame in frames:
            out = [pd.DataFrame(columns=["key", "ts_ms", "taken", "wait"])]
            for key, part in _parts(frame, _PART):
                if key != current:
                    current, log = key, _Log(part["log"].iloc[0])
                    part = part.iloc[1:] if part["log"].iloc[0] is not None else part
                if not len(part):
                    continue
                ts, n, busy = (part[c].to_numpy() for c in ("ts_ms", "n", "busy"))
                taken, oldest = log.walk(ts, n, busy, int(part["limit"].iloc[0]))
                wait = -((ts - oldest - QUOTA_WINDOW_MS) // 1000)
                out.append(pd.DataFrame({"key": key[0], "ts_ms": ts, "taken": taken, "wait": wait})[busy])
            yield pd.concat(out[1:] or out)

    verdict = _scan(_from_logs(rows, logs), _PART, ["ts_ms"], judge, "key string, ts_ms bigint, taken bigint, wait bigint")
    judged = requests.join(verdict, ["key", "ts_ms"], "left").join(limits, "key", "left")
    rank = F.row_number().over(W.partitionBy("key", "ts_ms").orderBy("seq"))
    allowed = F.col("limit").isNotNull() & (F.col("taken").isNull() | (rank <= F.col("taken")))
    out = judged.withColumn("allowed", allowed)
    return out.withColumn("retry_after_s", F.when(~F.col("allowed"), F.col("wait"))).drop("taken", "wait", "limit")
