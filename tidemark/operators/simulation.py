"""A store simulator: visitors as state machines that share a queue and fitting rooms within a day.

A day is sequential, so it is one grouped function with a seed of its own; days run side by side.
Randomness comes from a generator in that function, so a day's log depends on its seed alone.
"""

from __future__ import annotations

import random
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The profiles' parameters (ranges are inclusive) and weights.
PROFILES = {
    "quick_buyer": dict(weight=0.15, speed=(2, 3), n_sections=(1, 3), browse=(3, 7), checkout=(2, 4), pick=0.85, put_back=0.05, fitting=0.25, keep=0.92, leave=0.10, abandon=0.03, pause=0.01),
    "browser": dict(weight=0.20, speed=(1, 2), n_sections=(4, 7), browse=(6, 15), checkout=(2, 5), pick=0.35, put_back=0.30, fitting=0.55, keep=0.60, leave=0.30, abandon=0.12, pause=0.06),
    "indecisive": dict(weight=0.15, speed=(1, 2), n_sections=(3, 6), browse=(8, 18), checkout=(3, 7), pick=0.65, put_back=0.45, fitting=0.80, keep=0.50, leave=0.40, abandon=0.08, pause=0.08),
    "window_shopper": dict(weight=0.10, speed=(1, 2), n_sections=(3, 6), browse=(4, 10), checkout=(2, 4), pick=0.12, put_back=0.88, fitting=0.15, keep=0.20, leave=0.60, abandon=0.40, pause=0.07),
    "regular": dict(weight=0.40, speed=(1, 2), n_sections=(2, 5), browse=(4, 10), checkout=(2, 5), pick=0.62, put_back=0.15, fitting=0.55, keep=0.75, leave=0.15, abandon=0.07, pause=0.04),
}
GENDERS, AGES = {"female": 0.58, "male": 0.42}, {"young": 0.30, "adult": 0.50, "senior": 0.20}
# What gender and age change; numbers are factors, pairs are added to a range's ends.
MODIFIERS = {
    "female": {"browse": 1.25, "fitting": 1.30, "pick": 1.15, "n_sections": (0, 1)},
    "male": {"browse": 0.80, "fitting": 0.50, "put_back": 1.25, "n_sections": (-1, -1)},
    "young": {"speed": (1, 1), "pause": 2.0, "put_back": 1.20},
    "senior": {"speed": (-1, -1), "browse": 1.20, "checkout": 1.40, "abandon": 0.50},
}
MOST = {"speed": 3, "n_sections": 12, "pause": 0.5}
LOG_SCHEMA = "day string, seq long, timestamp string, shopper_id int, action string, row string, col int, details string"
ROWS, COLS, ENTRANCE, COUNTER = 8, 14, (7, 7), (7, 11)
ROOMS = ((0, 12), (0, 13), (1, 13))
SHELVES = {(1 + k // 4 * 2, 1 + k % 4 * 3 + side) for k in range(12) for side in (0, 1)}
SECTIONS = {f"Section {chr(65 + k)}": (2 + k // 4 * 2, 1 + k % 4 * 3) for k in range(12)}  # the cell in front of a shelf


def modified(profile: dict, *kinds: str) -> dict:
    """The profile as gender and age change it, one after the other, within its bounds."""
    out = dict(profile)
    for name, change in (x for kind in kinds for x in MODIFIERS.get(kind, {}).items()):
        most, old = MOST.get(name, float("inf")), out[name]
        if isinstance(old, tuple):
            ends = [a + b for a, b in zip(old, change)] if isinstance(change, tuple) else [int(round(a * change, 6)) for a in old]
            out[name] = tuple(int(max(1, min(most, x))) for x in ends)
        else:
            out[name] = min(most, 1.0, old * change)
    return out


def shortest_path(start: tuple[int, int], goals: set[tuple[int, int]], walkable: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cells after ``start`` on a shortest walk to the nearest goal; neighbours in the order up, down, left, right."""
    back, todo = {start: start}, deque([start])
    while todo:
        cell = todo.popleft()
        if cell in goals:
            path = []
            while cell != start:
                path.append(cell)
                cell = back[cell]
            return path[::-1]
        for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            nxt = cell[0] + dr, cell[1] + dc
            if nxt in walkable and nxt not in back:
                back[nxt] = cell
                todo.append(nxt)
    return []


@dataclass
class _Visitor:
    id: int
    profile: dict
    todo: list[str]
    at: tuple[int, int] = ENTRANCE
    state: str = "walk"
    goal: str = "section"
    path: list = field(default_factory=list)
    items: list[str] = field(default_factory=list)
    speed: int = 1
    rest: int = 0
    busy: int = 0
    spent: int = 0


class Day:
    """One day's store: ``run`` gives the log rows in order."""

    def __init__(self, day: str, seed: int, arrivals: float, minutes: int = 480, opens: int = 600) -> None:
        self.day, self.rng, self.arrivals, self.minutes, self.opens = day, random.Random(seed), arrivals, minutes, opens
        self.cells = {(r, c) for r in range(ROWS) for c in range(COLS)} - SHELVES
        self.rows: list[tuple] = []
        self.queue: list[_Visitor] = []
        self.serving: _Visitor | None = None
        self.taken: dict[tuple[int, int], int] = {}
        self.entered = 0

    def run(self) -> list[tuple]:
        inside: list[_Visitor] = []
        names = list(PROFILES)
        for tick in range(self.minutes):
            hour = (self.opens + tick) / 60
            hump = max(2.718281828 ** (-0.5 * ((hour - m) / s) ** 2) for m, s in ((13, 1.5), (16.5, 1.2)))
            if self.rng.random() < self.arrivals * (0.15 + 0.85 * hump):
                name = self.rng.choices(names, [p["weight"] for p in PROFILES.values()])[0]
                gender, age = (self.rng.choices(list(x), list(x.values()))[0] for x in (GENDERS, AGES))
                p = modified(PROFILES[name], gender, age)
                self.entered += 1
                who = _Visitor(self.entered, p, self.rng.sample(list(SECTIONS), self.rng.randint(*p["n_sections"])), speed=self.rng.randint(*p["speed"]))
                self._log(tick, who, "ENTERED", f"profile={name} gender={gender} age={age} plan=[{', '.join(who.todo)}]")
                self._go(who, "section")
                inside.append(who)
            if self.serving is None and self.queue:
                self.serving = self.queue[0]
                self.serving.state, self.serving.spent = "counter", 0
                self.serving.busy = self.rng.randint(*self.serving.profile["checkout"]) + len(self.serving.items)
                self._log(tick, self.serving, "REACHED_COUNTER", "")
            for v in list(inside):
                getattr(self, "_" + v.state)(tick, v)
                if v.state == "gone":
                    inside.remove(v)
        return self.rows

    def _log(self, tick: int, v: _Visitor, action: str, details: str) -> None:
        minute = self.opens + tick
        self.rows.append((self.day, len(self.rows), f"{minute // 60:02d}:{minute % 60:02d}", v.id, action, chr(97 + v.at[0]), COLS - v.at[1], details))

    def _go(self, v: _Visitor, goal: str) -> None:
        goals = {"section": {SECTIONS[v.todo[0]]} if v.todo else set(), "fitting": set(ROOMS), "checkout": {COUNTER}, "exit": {ENTRANCE}}[goal]
        v.state, v.goal, v.path = "walk", goal, shortest_path(v.at, goals, self.cells)

    def _leave_shelves(self, tick: int, v: _Visitor) -> None:
        self._go(v, "checkout" if v.items else "exit")

    def _walk(self, tick: int, v: _Visitor) -> None:
        target = {"section": v.todo[0] if v.todo else "", "fitting": "fitting room"}.get(v.goal, v.goal)
        if v.path and not v.rest and self.rng.random() < v.profile["pause"]:
            v.rest = self.rng.randint(1, 3) + 1
        if v.path and v.rest:
            v.rest -= 1
            self._log(tick, v, "PAUSED", f"→ {target}")
            return
        for _ in range(v.speed):
            if v.path:
                v.at = v.path.pop(0)
        if v.path:
            self._log(tick, v, "MOVING", f"→ {target}")
        elif v.goal == "section":
            v.state, v.spent, v.busy = "shelf", 0, self.rng.randint(*v.profile["browse"])
            self._log(tick, v, "ARRIVED_SECTION", target)
        elif v.goal == "fitting":
            v.state = "wait"
            self._log(tick, v, "ARRIVED_FITTING_AREA", f"{len(v.items)} item(s)")
        elif v.goal == "checkout":
            self.queue.append(v)
            v.state = "line"
            self._log(tick, v, "JOINED_QUEUE", f"position #{len(self.queue)}, {len(v.items)} item(s)")
        else:
            v.state = "gone"
            self._log(tick, v, "EXITED", "")

    def _shelf(self, tick: int, v: _Visitor) -> None:
        v.spent += 1
        if v.spent < v.busy:
            self._log(tick, v, "BROWSING", v.todo[0])
            return
        section = v.todo.pop(0)
        picked = self.rng.random() < v.profile["pick"]
        kept = picked and self.rng.random() >= v.profile["put_back"]
        if kept:
            v.items.append(section)
        self._log(tick, v, "PICKED_ITEM" if kept else "PUT_BACK_SHELF" if picked else "NO_PICK", section)
        if v.todo:
            self._go(v, "section")
        elif v.items and self.rng.random() < v.profile["fitting"]:
            self._go(v, "fitting")
            self._log(tick, v, "HEADING", "fitting room")
        else:
            self._leave_shelves(tick, v)

    def _wait(self, tick: int, v: _Visitor) -> None:
        free = [r for r in ROOMS if r not in self.taken]
        if not free:  # nobody waits for a room: the visitor gives up at once
            self._log(tick, v, "GAVE_UP_FITTING", "waited 0 ticks")
            self._leave_shelves(tick, v)
            return
        v.at = min(free, key=lambda r: abs(r[0] - v.at[0]) + abs(r[1] - v.at[1]))
        self.taken[v.at] = v.id
        v.state, v.spent = "room", 0
        v.busy = self.rng.randint(5, 10) + len(v.items) * self.rng.randint(2, 4)
        self._log(tick, v, "ENTERED_FITTING", f"{len(v.items)} item(s) to try on, waited 0 ticks")

    def _room(self, tick: int, v: _Visitor) -> None:
        v.spent += 1
        if v.spent < v.busy:
            self._log(tick, v, "IN_FITTING", f"{v.spent}/{v.busy} min")
            return
        fate = ["keeping" if self.rng.random() < v.profile["keep"] else "left_in_room" if self.rng.random() < v.profile["leave"] else "returned_to_shelf" for _ in v.items]
        v.items = [x for x, f in zip(v.items, fate) if f == "keeping"]
        counts = [f"{k}={fate.count(k)}" for k in ("keeping", "returned_to_shelf", "left_in_room") if k in fate]
        self._log(tick, v, "LEFT_FITTING", ", ".join(counts) if v.items or counts else "kept nothing")
        self.taken.pop(v.at, None)
        self._leave_shelves(tick, v)

    def _line(self, tick: int, v: _Visitor) -> None:
        place = self.queue.index(v) + 1
        if self.rng.random() < min(v.profile["abandon"] * (1 + 0.4 * (place - 1)), 0.6):
            self.queue.remove(v)
            self._log(tick, v, "ABANDONED_QUEUE", f"position #{place}, left {len(v.items)} item(s)")
            v.items = []
            self._go(v, "exit")
        else:
            self._log(tick, v, "IN_QUEUE", f"position #{place}")

    def _counter(self, tick: int, v: _Visitor) -> None:
        v.spent += 1
        if v.spent < v.busy:
            self._log(tick, v, "AT_CHECKOUT", f"{v.spent}/{v.busy} min")
            return
        self._log(tick, v, "PURCHASED", f"{len(v.items)} item(s): {', '.join(v.items)}")
        self.queue.remove(v)
        self.serving, v.items = None, []
        self._go(v, "exit")


def simulate(spark: SparkSession, days: list[tuple[str, int, float]]) -> DataFrame:
    """The event log of (day, seed, arrival chance a minute) rows, each day in a task of its own."""
    plan = spark.createDataFrame(days, "day string, seed long, arrivals double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        names = [x.split()[0] for x in LOG_SCHEMA.split(", ")]
        return pd.DataFrame(Day(r.day, int(r.seed), float(r.arrivals)).run(), columns=names)

    return plan.groupBy("day").applyInPandas(run, LOG_SCHEMA)
