"""Plain-Python step-by-step versions of the sequential rules, written from the
specification, to compare the Spark results with."""

import random
import statistics
from fractions import Fraction


def series(seed, n, keys, walk=0.05, negatives=False, step=60_000):
    rng = random.Random(seed)
    level = {k: rng.randint(500, 50_000) for k in keys}
    rows, ts = [], 1_700_000_000_000
    for seq in range(n):
        key = keys[0] if rng.random() < 0.4 else rng.choice(keys)
        level[key] = max(1, int(level[key] * (1 + rng.uniform(-walk, walk))))
        price = level[key]
        roll = rng.random()
        if roll < 0.1:
            price = rng.randint(0, 100_000)
        elif negatives and roll < 0.15:
            price = -price
        ts += rng.choice([0, 1, step // 10, step, step * 3])
        rows.append((seq, key, price, ts))
    return rows


def guard(rows, bps):
    last, out = {}, {}
    for seq, key, price, _ in rows:
        prev = last.get(key)
        ok = prev is None or prev == 0 or abs(price - prev) * 10000 // abs(prev) <= bps
        if ok:
            last[key] = price
        out[seq] = ok
    return out


def feed_breaker(rows, threshold, cooldown, needed):
    state, out = {}, {}
    for seq, key, ts, ok in rows:
        s = state.setdefault(key, {"st": "CLOSED", "f": 0, "last": 0, "w": 0, "trips": 0})
        if s["st"] == "OPEN":
            if ts - s["last"] >= cooldown:
                s["st"], s["w"] = "HALF_OPEN", 0
            else:
                out[seq] = (False, s["st"], s["f"], s["trips"])
                continue
        if ok:
            if s["st"] == "HALF_OPEN":
                s["w"] += 1
                if s["w"] >= needed:
                    s["st"], s["f"] = "CLOSED", 0
            else:
                s["f"] = 0
        else:
            s["f"] += 1
            s["last"] = ts
            if s["st"] == "HALF_OPEN" or (s["st"] == "CLOSED" and s["f"] >= threshold):
                s["st"] = "OPEN"
                s["trips"] += 1
        out[seq] = (True, s["st"], s["f"], s["trips"])
    return out


def quota(rows, limits, window=60_000):
    log, out = {}, {}
    for seq, key, ts in rows:
        if key not in limits:
            out[seq] = (False, None)
            continue
        recent = [t for t in log.get(key, []) if t > ts - window]
        if len(recent) >= limits[key]:
            out[seq] = (False, -((ts - min(recent) - window) // 1000))
            log[key] = recent
        else:
            log[key] = recent + [ts]
            out[seq] = (True, None)
    return out


def interval_fires(hooks, updates, floor):
    fired = {}
    for hook, asset, created, value in hooks:
        wait, last = max(int(value), floor), None
        for seq, a, ts in updates:
            if a == asset and ts >= created and (last is None or ts - last >= wait):
                fired.setdefault(hook, set()).add(ts)
                last = ts
    return fired


def middle(values):
    ordered = sorted(values)
    n = len(ordered)
    return Fraction(ordered[(n - 1) // 2] + ordered[n // 2], 2)


def deviation_breaker(rows, limit, recovery):
    latest, state, out = {}, {}, {}
    for seq, asset, source, price, ts in rows:
        latest[(asset, source)] = price
        m = middle([p for (a, _), p in latest.items() if a == asset])
        dev = 0 if m == 0 else abs(Fraction(price) - m) / m * 100
        s = state.setdefault((asset, source), {"sus": False, "ok": 0, "n": 0, "last": None})
        if dev > limit:
            s.update(sus=True, ok=0, n=s["n"] + 1, last=ts)
        elif s["sus"]:
            s["ok"] += 1
            if s["ok"] >= recovery:
                s.update(sus=False, ok=0)
        out[seq] = (s["sus"], s["n"], s["last"], s["ok"])
    return out


def anomaly(values, window=20):
    history, out = [], []
    for x in values:
        if len(history) < 5:
            history.append(x)
            out.append(None)
            continue
        w = history[-window:]
        mean, sd = statistics.fmean(w), statistics.pstdev(w)
        z = 0.0 if sd == 0 else abs((x - mean) / sd)
        ma = 0.0 if mean == 0 else abs(x - mean) / mean * 100
        rets = [(b - a) / a for a, b in zip(w, w[1:]) if a != 0]
        vol = statistics.pstdev(rets) if rets else None
        jump = 0.0 if w[-1] == 0 else abs((x - w[-1]) / w[-1])
        score = 0.0 if not vol else jump / (vol * 3)
        out.append((z / 3, ma / 5, score))
        history.append(x)
    return out


def stakes(rows):
    balance, out = {}, {}
    for seq, source, kind, amount in rows:
        have = balance.get(source, 0)
        balance[source] = have + amount if kind == "stake" else have - min(amount, have)
        out[seq] = balance[source]
    return out
