"""Slow, literal restatements of the definitions to compare with."""

import math
from collections import Counter, defaultdict


def by_entity(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["event_id"])):
        groups[r["entity_id"]].append(r)
    return groups


def windows(rows):
    """event_id -> (count 5m, count 60m, failed 5m, failed 30m, breadth, gap, previous id)."""
    out = {}
    for group in by_entity(rows).values():
        for i, r in enumerate(group):
            ages = [((r["timestamp"] - p["timestamp"]).total_seconds(), p) for p in group[:i]]
            failed = [(a, p) for a, p in ages if not p["auth_success"]]
            out[r["event_id"]] = (
                sum(a <= 300 for a, _ in ages),
                sum(a <= 3600 for a, _ in ages),
                sum(a <= 300 for a, _ in failed),
                sum(a <= 1800 for a, _ in failed),
                len({p["resource_accessed"] for a, p in ages if a <= 86400}),
                ages[-1][0] if ages else 0.0,
            )
    return out


def evidence(rows, half_life, cap):
    """event_id -> (decayed, state); rows carry ``e``."""
    out = {}
    for group in by_entity(rows).values():
        state, last = 0.0, None
        for r in group:
            gap = (r["timestamp"] - last).total_seconds() if last else 0.0
            decayed = state * 0.5 ** (gap / half_life)
            state, last = min(decayed + r["e"], cap), r["timestamp"]
            out[r["event_id"]] = (decayed, state)
    return out


def alerts(pages, cooldown, escalate=True):
    """Opened event ids of (entity, at seconds, event_id, rank) candidates."""
    out, state = [], {}
    for entity, at, event_id, rank in sorted(pages, key=lambda p: (p[1], p[2])):
        last = state.get(entity)
        if last is None or at - last[0] >= cooldown or (escalate and rank > last[1]):
            out.append(event_id)
            state[entity] = (at, rank)
    return sorted(out)


def adaptive(rows, seed, half_life_days):
    """Event-by-event replay of accepted rows of one entity from a seed profile."""
    counts = {k: dict(v) for k, v in seed["counts"].items()}
    m = dict(seed["moments"])
    n = total = float(seed["n"])
    last = before = None
    for r in rows:
        days = (r["timestamp"] - last).total_seconds() / 86400 if last else 0.0
        d = 0.5 ** (max(0.0, days) / half_life_days)
        values = {
            "hour": str(r["timestamp"].hour),
            "location": f"{r['country']}|{r['city']}",
            "device": f"{r['device_id']}|{r['device_mac']}",
            "resource": r["resource_accessed"],
            "auth": r["auth_method"],
            "transition": f"{before or '<START>'}->{r['resource_accessed']}",
        }
        for kind, value in values.items():
            table = {k: v * d for k, v in counts[kind].items() if v * d > 1e-12}
            table[value] = table.get(value, 0.0) + 1.0
            counts[kind] = table
        n, total = d * n + 1, d * total + 1
        for name, v in (("duration", r["session_duration_s"]), ("bytes", r["bytes_transferred"])):
            mean, m2 = m[f"{name}_mean"], m[f"{name}_m2"]
            if d >= 1 and mean == 0 and m2 == 0:
                m[f"{name}_mean"], m[f"{name}_m2"] = v, 0.0
                continue
            new = d * mean + (1 - d) * v
            m[f"{name}_mean"], m[f"{name}_m2"] = new, max(0.0, d * m2 + (1 - d) * (v - mean) * (v - new))
        m["auth_failure_rate"] = d * m["auth_failure_rate"] + (1 - d) * (0.0 if r["auth_success"] else 1.0)
        m["baseline_latitude"] = d * m["baseline_latitude"] + (1 - d) * r["latitude"]
        m["baseline_longitude"] = d * m["baseline_longitude"] + (1 - d) * r["longitude"]
        last, before = r["timestamp"], r["resource_accessed"]
    return counts, m, n, total


def frozen(rows):
    """Counts and moments of one key's fit rows, in order."""
    counts = {k: Counter() for k in ("hour", "location", "device", "resource", "auth", "transition")}
    before = None
    for r in rows:
        counts["hour"][str(r["timestamp"].hour)] += 1
        counts["location"][f"{r['country']}|{r['city']}"] += 1
        counts["device"][f"{r['device_id']}|{r['device_mac']}"] += 1
        counts["resource"][r["resource_accessed"]] += 1
        counts["auth"][r["auth_method"]] += 1
        counts["transition"][f"{before or '<START>'}->{r['resource_accessed']}"] += 1
        before = r["resource_accessed"]
    n = len(rows)
    mean = lambda xs: sum(xs) / n
    moments = {}
    for name, column in (("duration", "session_duration_s"), ("bytes", "bytes_transferred")):
        xs = [r[column] for r in rows]
        moments[f"{name}_mean"] = mean(xs)
        moments[f"{name}_m2"] = mean([(x - mean(xs)) ** 2 for x in xs])
    moments["auth_failure_rate"] = mean([0.0 if r["auth_success"] else 1.0 for r in rows])
    moments["baseline_latitude"] = mean([r["latitude"] for r in rows])
    moments["baseline_longitude"] = mean([r["longitude"] for r in rows])
    return {"counts": counts, "moments": moments, "n": n}


def average_precision(scores, truth):
    """Step sum over distinct thresholds."""
    ap, seen, tp, p = 0.0, 0, 0, sum(truth)
    for s in sorted(set(scores), reverse=True):
        here = [t for x, t in zip(scores, truth) if x == s]
        tp += sum(here)
        seen += len(here)
        ap += sum(here) / p * tp / seen
    return ap


def roc_auc(scores, truth):
    pos = [s for s, t in zip(scores, truth) if t]
    neg = [s for s, t in zip(scores, truth) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def haversine(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))
