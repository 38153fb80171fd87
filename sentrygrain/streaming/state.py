"""What one entity remembers between live events, kept in parts.

The state store holds one small row of numbers per entity (``Head``) and maps
beside it: blocks of recent events, the last place of each recent resource, and
one entry per learned key of the adaptive profile. Within a trigger a part is read when
an event first needs it and written back once. The frozen profile is never copied: every
event brings the counts the profile holds for its own values.

Windows are pointers into the numbered events with running totals of failures, so
an event costs O(1) on average, however many events a window holds.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from ..config import Config
from ..operators.profiles import KINDS, START

BLOCK = 256
#: Learned counts at or below this are forgotten at the next accepted event.
FORGOTTEN = 1e-12
#: A count of one takes log2(1e12), more than 39, half-lives to be forgotten. Keys due within
#: ``HORIZON`` half-lives are collected at a time, before the first of them can be due.
SAFE, HORIZON = 39, 20
MOMENTS = ("duration_mean", "duration_m2", "bytes_mean", "bytes_m2", "auth_failure_rate", "baseline_latitude", "baseline_longitude")
KIND_NUMBER = {kind: i for i, kind in enumerate(KINDS)}


@dataclass
class Head:
    """The numbers of one entity; ``HEAD_SCHEMA`` has the same fields in the same order."""

    last_at: int | None = None
    last_id: str = ""
    latitude: float = 0.0
    longitude: float = 0.0
    fp: str = ""
    resource: str = ""
    evidence: float = 0.0
    alert_at: int | None = None
    alert_rank: int = 0
    events: int = 0
    failures: int = 0
    pointers: list = field(default_factory=lambda: [0, 0, 0, 0])
    seen: int = 0
    seen_first: int = 0
    distinct: int = 0
    first_at: int | None = None
    learned_at: int | None = None
    learned_resource: str | None = None
    n: float = 0.0
    total: float = 0.0
    moments: list = field(default_factory=lambda: [0.0] * len(MOMENTS))
    learned_keys: list = field(default_factory=lambda: [0] * len(KINDS))
    taken_keys: list = field(default_factory=lambda: [0] * len(KINDS))
    sweep_at: int | None = None
    due_at: int | None = None


HEAD_SCHEMA = (
    "last_at bigint, last_id string, latitude double, longitude double, fp string, resource string, evidence double, "
    "alert_at bigint, alert_rank int, events bigint, failures bigint, pointers array<bigint>, seen bigint, "
    "seen_first bigint, distinct bigint, first_at bigint, learned_at bigint, learned_resource string, n double, "
    "total double, moments array<double>, learned_keys array<bigint>, taken_keys array<bigint>, sweep_at bigint, due_at bigint"
)
HEAD_FIELDS = [f.name for f in fields(Head)]
#: Maps beside the head: schema of the key and of the value.
MAPS = {
    "window": ("block bigint", "ats array<bigint>, failures array<bigint>"),
    "sights": ("block bigint", "ats array<bigint>, resources array<string>"),
    "recent": ("resource string", "seq bigint"),
    "learned": ("kind string, value string", "weight double, at bigint"),
    "taken": ("kind string, n bigint", "keys bigint"),
}
DUE_SCHEMA = "at bigint, kind string, value string"


class Part:
    """A map of the state store as one trigger sees it: read through, written back once."""

    def __init__(self, state, fresh: bool):
        self.state, self.fresh = state, fresh
        self.held: dict[tuple, tuple | None] = {}
        self.dirty: set[tuple] = set()

    def get(self, key: tuple) -> tuple | None:
        if key not in self.held:
            found = None if self.fresh else self.state.getValue(key)
            self.held[key] = None if found is None else tuple(found)
        return self.held[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.held[key] = value
        self.dirty.add(key)

    def items(self) -> Iterator[tuple[tuple, tuple]]:
        """Every entry as of now, stored or not."""
        stored = () if self.fresh else self.state.iterator()
        for key, value in stored:
            if tuple(key) not in self.held:
                yield tuple(key), tuple(value)
        yield from ((k, v) for k, v in self.held.items() if v is not None)

    def flush(self) -> None:
        for key in self.dirty:
            if self.held[key] is not None:
                self.state.updateValue(key, self.held[key])
            elif not self.fresh:
                self.state.removeKey(key)
        self.dirty.clear()


class Numbered:
    """A sequence of pairs in blocks of a map; entries before the oldest pointer are dropped with their block."""

    def __init__(self, part: Part):
        self.part = part

    def at(self, i: int) -> tuple:
        first, second = self.part.get((i // BLOCK,))
        return first[i % BLOCK], second[i % BLOCK]

    def append(self, i: int, first, second) -> None:
        key = (i // BLOCK,)
        if i % BLOCK:
            a, b = self.part.get(key)
            if key not in self.part.dirty:  # rows of the store are not to be changed in place
                a, b = list(a), list(b)
        else:
            a, b = [], []
        a.append(first)
        b.append(second)
        self.part.put(key, (a, b))

    def drop(self, before: int, after: int) -> None:
        """Forget the blocks that end when a pointer moves from ``before`` to ``after``."""
        for block in range(before // BLOCK, after // BLOCK):
            self.part.put((block,), None)


class EntityMemory:
    """An entity's state during one trigger."""

    def __init__(self, head: Head | None, states: dict[str, object]):
        self.fresh = head is None
        self.head = head or Head()
        self.parts = {name: Part(states[name], self.fresh) for name in MAPS}
        self.window, self.sights = Numbered(self.parts["window"]), Numbered(self.parts["sights"])
        self.due_state = states["due"]
        self.due: list[tuple] | None = [] if self.fresh else None
        self.due_changed = False

    def flush(self) -> None:
        for part in self.parts.values():
            part.flush()
        if self.due_changed:
            self.due_state.put(self.due) if self.due else self.due_state.clear()

    # -- history -------------------------------------------------------------------
    def commit(self, e) -> None:
        """Add an event to the history."""
        h, resource = self.head, (e["resource_accessed"],)
        self.window.append(h.events, e["at"], h.failures)
        h.events += 1
        h.failures += 0 if e["auth_success"] else 1
        if self.parts["recent"].get(resource) is None:
            h.distinct += 1
        self.parts["recent"].put(resource, (h.seen,))
        self.sights.append(h.seen, e["at"], e["resource_accessed"])
        h.seen += 1
        h.last_at, h.last_id = e["at"], e["event_id"]
        h.latitude, h.longitude = e["latitude"], e["longitude"]
        h.fp, h.resource = e["fp"], e["resource_accessed"]

    def counted(self, at: int, widths_us: list[int], keep_us: int) -> list[tuple[int, int]]:
        """(events, failures) among the remembered ones at most each width old."""
        h = self.head
        oldest, out = min(h.pointers), []
        for k, width in enumerate(widths_us):
            limit = at - width if h.last_at is None else max(at - width, h.last_at - keep_us)
            first = h.pointers[k]
            while first < h.events and self.window.at(first)[0] < limit:
                first += 1
            h.pointers[k] = first
            failed = h.failures - self.window.at(first)[1] if first < h.events else 0
            out.append((h.events - first, failed))
        self.window.drop(oldest, min(h.pointers))
        return out

    def breadth(self, at: int, width_us: int, keep_us: int) -> int:
        """Distinct resources among the remembered events at most ``width_us`` old."""
        h, recent = self.head, self.parts["recent"]
        limit = at - width_us if h.last_at is None else max(at - width_us, h.last_at - keep_us)
        first = h.seen_first
        while first < h.seen:
            then, resource = self.sights.at(first)
            if then >= limit:
                break
            if recent.get((resource,)) == (first,):  # not seen again since
                recent.put((resource,), None)
                h.distinct -= 1
            first += 1
        self.sights.drop(h.seen_first, first)
        h.seen_first = first
        return h.distinct

    # -- learned profile -----------------------------------------------------------
    def forget(self, now: int, half: float, recount: bool) -> None:
        """Remove learned keys that have faded by ``now``."""
        h, learned = self.head, self.parts["learned"]
        if h.sweep_at is not None and now >= h.sweep_at:
            self.due, self.due_changed = [], True
            counts = [0] * len(KINDS)
            for (kind, value), (weight, at) in learned.items():
                counts[KIND_NUMBER[kind]] += 1
                gone = at + math.ceil(half * math.log2(weight / FORGOTTEN)) + 1
                if gone < now + HORIZON * half:
                    self.due.append((gone, kind, value))
            if recount:  # the store may have let keys expire
                h.learned_keys = counts
            heapq.heapify(self.due)
            h.sweep_at = now + int(HORIZON * half)
            h.due_at = self.due[0][0] if self.due else None
        if h.due_at is None or now < h.due_at:
            return
        if self.due is None:
            self.due = [tuple(x) for x in self.due_state.get()]
            heapq.heapify(self.due)
        while self.due and self.due[0][0] <= now:
            _, kind, value = heapq.heappop(self.due)
            self.due_changed = True
            found = learned.get((kind, value))
            if found is not None and faded(found, now, half) <= FORGOTTEN:  # else it was learned again
                learned.put((kind, value), None)
                h.learned_keys[KIND_NUMBER[kind]] -= 1
        h.due_at = self.due[0][0] if self.due else None


def faded(entry: tuple, now: int, half: float) -> float:
    weight, at = entry
    return weight * 2.0 ** (-(now - at) / half)


class AdaptiveView:
    """An entity's current profile: frozen seed faded, plus what was learned."""

    def __init__(self, memory: EntityMemory, e, config: Config):
        self.memory, self.h, self.e = memory, memory.head, e
        self.half = config.ewma_halflife_days * 86_400e6

    def fade(self) -> float:
        h = self.h
        return 1.0 if h.first_at is None else 2.0 ** (-(h.learned_at - h.first_at) / self.half)

    def exists(self) -> bool:
        return self.h.first_at is not None or self.e["own_n_events"] is not None

    def n_events(self) -> float:
        return self.h.n if self.h.first_at is not None else self.e["seed_n_events"] or 0.0

    def total(self) -> float:
        return self.h.total if self.h.first_at is not None else self.e["seed_total_transitions"] or 0.0

    def keys(self, kind: str) -> int:
        """Distinct values: those of the seed that are neither faded nor learned since, and the learned ones."""
        h, k = self.h, KIND_NUMBER[kind]
        fade = self.fade()
        if fade > FORGOTTEN:
            return (self.e[f"seed_keys_{kind}"] or 0) - h.taken_keys[k] + h.learned_keys[k]
        taken = self.memory.parts["taken"]
        levels = json.loads(self.e["seed_levels"] or "{}").get(kind, {})
        left = ((int(n), keys) for n, keys in levels.items() if float(n) * fade > FORGOTTEN)
        return h.learned_keys[k] + sum(keys - (taken.get((kind, n)) or (0,))[0] for n, keys in left)

    def count(self, kind: str, value: str, seeded: float | None) -> float | None:
        """Faded count, or None when the value was never seen or is forgotten."""
        learned = None if self.h.first_at is None else self.memory.parts["learned"].get((kind, value))
        if learned is not None:
            return faded(learned, self.h.learned_at, self.half)
        if seeded is None or seeded * self.fade() <= FORGOTTEN:
            return None
        return seeded * self.fade()

    def moment(self, name: str) -> float | None:
        return self.h.moments[MOMENTS.index(name)] if self.h.first_at is not None else self.e[f"seed_{name}"]


def seeded_transition(e, previous: str | None, side: str) -> float | None:
    """Count of previous -> this resource in the frozen profile."""
    table = e[f"{side}_arrivals"]
    return None if table is None else table.get(previous if previous is not None else START)


def absorb(memory: EntityMemory, e, values: dict[str, str], config: Config, expiring: bool = False) -> None:
    """Learn one accepted event: fade, forget, add one to its values, move the running moments."""
    h, half = memory.head, config.ewma_halflife_days * 86_400e6
    learned, taken = memory.parts["learned"], memory.parts["taken"]
    if h.first_at is None:
        h.first_at = h.learned_at = e["at"]
        h.sweep_at = e["at"] + int(SAFE * half)
        h.n, h.total = e["seed_n_events"] or 0.0, e["seed_total_transitions"] or 0.0
        if e["seed_n_events"] is None:
            start = {"duration_m2": 1.0, "bytes_m2": 1.0, "baseline_latitude": e["latitude"], "baseline_longitude": e["longitude"]}
            h.moments = [start.get(name, 0.0) for name in MOMENTS]
        else:
            h.moments = [e[f"seed_{name}"] for name in MOMENTS]
    d = 0.5 ** (max(0, e["at"] - h.learned_at) / half)
    now = h.learned_at = max(h.learned_at, e["at"])
    memory.forget(now, half, expiring)
    fade = 2.0 ** (-(now - h.first_at) / half)
    for kind, value in values.items():
        if kind == "transition":
            value = f"{START if h.learned_resource is None else h.learned_resource}->{e['resource_accessed']}"
            seeded = seeded_transition(e, h.learned_resource, "seed")
        else:
            seeded = e[f"seed_count_{kind}"]
        found, before = learned.get((kind, value)), 0.0
        if found is not None:
            before = faded(found, now, half)
        else:
            h.learned_keys[KIND_NUMBER[kind]] += 1
            if seeded is not None and seeded * fade > FORGOTTEN:
                before = seeded * fade
                level = (kind, int(seeded))
                taken.put(level, ((taken.get(level) or (0,))[0] + 1,))
                h.taken_keys[KIND_NUMBER[kind]] += 1
        learned.put((kind, value), (before + 1.0, now))
    h.n, h.total = d * h.n + 1.0, d * h.total + 1.0
    m = h.moments
    for i, value in ((0, e["session_duration_s"]), (2, e["bytes_transferred"])):
        mean, m2 = m[i], m[i + 1]
        if d >= 1.0 and mean == 0.0 and m2 == 0.0:
            m[i] = value
            continue
        gap = value - mean
        m[i] = mean + (1.0 - d) * gap
        m[i + 1] = max(0.0, d * m2 + (1.0 - d) * d * gap * gap)
    for i, value in ((4, 0.0 if e["auth_success"] else 1.0), (5, e["latitude"]), (6, e["longitude"])):
        m[i] = d * m[i] + (1.0 - d) * value
    h.learned_resource = e["resource_accessed"]


def rounded(x: float) -> int:
    """Python rounds halves to even, as the frozen snapshot does."""
    return int(round(x)) if math.isfinite(x) else 0


# -- state as rows ---------------------------------------------------------------------
def decoded(part: str, payload: str) -> tuple:
    """(key, value) of a row of state; the head and the due list have no key."""
    fields = json.loads(payload)
    if part == "head":
        return (), tuple(fields.get(name) for name in HEAD_FIELDS)
    if part == "due":
        return (), (fields["at"], fields["kind"], fields["value"])
    key, value = (tuple(fields.get(c.split()[0]) for c in schema.split(", ")) for schema in MAPS[part])
    return key, value
