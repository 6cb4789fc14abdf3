"""An optimisation as a stream: each glyph's search is state, and every tick moves it on and shows the best so far.

The search fits a straight stroke to a mask: downhill simplex, then a population, then the simplex from
what is best; a phase ends when a number of rounds has not made it better. All that a search is at lies
in the state store, so that a query which stops goes on from its checkpoint as if it had not. ``Search`` is
one search; a task moves the searches of many glyphs on together (``advance_all``), number for number as it does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import glyphs as Y

PHASES = ("initial", "simplex", "population", "polish", "final")
PEOPLE = 12
#: Where searches are, a record each; ``n`` of the points count.
RECORD = np.dtype([("begun", "?"), ("phase", "i4"), ("rounds", "i8"), ("stale", "i4"), ("n", "i4"), ("points", "f8", (PEOPLE, 4)), ("values", "f8", PEOPLE), ("best", "f8", 4), ("cost", "f8")])
FRAMES = "tick long, phase string, rounds long, score double, best double, stroke array<double>, done boolean"
BETTER = 1e-6


def line_cost(mask: np.ndarray, reach: float = 3.0, n: int = 32):
    """A function of a line (x0, y0, x1, y1): how much of the mask is not near it, plus half of its share outside the mask; and its bounds."""
    ys, xs = np.nonzero(mask)
    low = np.array([xs.min(), ys.min()] * 2, float) if len(xs) else np.zeros(4)
    high = np.array([xs.max(), ys.max()] * 2, float) if len(xs) else np.ones(4)
    steps = np.linspace(0, 1, n)[:, None]

    def cost(line: np.ndarray) -> float:
        inside = np.clip(line, low, high)
        points = inside[:2] + steps * (inside[2:] - inside[:2])
        at = np.rint(points).astype(int)
        off = 1 - mask[at[:, 1], at[:, 0]].mean() if len(xs) else 1.0
        near = ((xs[:, None] - points[:, 0]) ** 2 + (ys[:, None] - points[:, 1]) ** 2 <= reach * reach).any(axis=1).mean() if len(xs) else 0.0
        return 1 - float(near) + 0.5 * float(off) + float(((line - inside) ** 2).sum())

    return cost, low, high


@dataclass
class Search:
    """Where the search of one glyph is."""

    phase: int = 0
    rounds: int = 0
    stale: int = 0
    points: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    best: list[float] = field(default_factory=list)
    cost: float = 0.0

    def state(self) -> tuple:
        return self.phase, self.rounds, self.stale, self.points, self.values, self.best, self.cost

    @property
    def done(self) -> bool:
        return PHASES[self.phase] == "final"

    def _begin(self, f, low: np.ndarray, high: np.ndarray, seed: int, people: int) -> None:
        """The first points of a phase."""
        name = PHASES[self.phase]
        if name == "population":
            points = low + np.random.default_rng([seed, 0]).random((people, len(low))) * (high - low)
            points[0] = self.best
        else:
            reach = np.maximum(high - low, 1) / (4 if name == "simplex" else 8)
            points = np.array([self.best] + [np.array(self.best) + reach * np.eye(len(low))[i] for i in range(len(low))])
        self._keep(points, np.array([f(p) for p in points]))
        self.stale = 0

    def _keep(self, points: np.ndarray, values: np.ndarray) -> None:
        self.points, self.values = np.asarray(points, float).reshape(-1).tolist(), np.asarray(values, float).tolist()
        k = int(np.argmin(values))
        if values[k] < self.cost - BETTER:
            self.best, self.cost, self.stale = np.asarray(points[k], float).tolist(), float(values[k]), 0
        else:
            self.stale += 1

    def advance(self, mask: np.ndarray, rounds: int, patience: int = 8, people: int = 12, seed: int = 0) -> None:
        """So many rounds more; the first tick only values the diagonal of the box."""
        f, low, high = line_cost(mask)
        if PHASES[self.phase] == "initial" and not self.best:
            self.best = [float(v) for v in (low[0], low[1], high[2], high[3])]
            self.cost = float(f(np.array(self.best)))
            return
        for _ in range(rounds):
            if self.done:
                return
            if PHASES[self.phase] == "initial" or self.stale >= patience:
                self.phase += 1
                if self.done:
                    return
                self._begin(f, low, high, seed, people)
            points, values = np.array(self.points).reshape(-1, len(low)), np.array(self.values)
            self.rounds += 1
            if PHASES[self.phase] == "population":
                Y.generation_step(f, points, values, low, high, np.random.default_rng([seed, self.rounds]))
                self._keep(points, values)
            else:
                self._keep(*map(np.array, Y.simplex_step(f, list(points), list(values))))

    def frame(self, tick: int) -> tuple:
        now = min(self.values) if self.values else self.cost
        return int(tick), PHASES[self.phase], self.rounds, 1 - float(now), 1 - self.cost, list(self.best), self.done


class LineCosts:
    """:func:`line_cost` of many masks of one shape at once; ``at`` says which masks the lines are for.

    A point reaches pixels of eight rows and columns around it. Those of a row are the bits of a byte, which
    goes into the row's words of 32 columns each; the pixels near a line are counted by words.
    """

    def __init__(self, masks: np.ndarray, reach: float = 3.0, n: int = 32):
        self.masks, self.reach, self.n = masks, reach, n
        count, self.height, self.width = masks.shape
        self.ink = masks.sum(axis=(1, 2))
        self.low, self.high = np.zeros((count, 4)), np.ones((count, 4))
        for side, axis in ((0, 1), (1, 2)):  # x by columns, y by rows
            some = masks.any(axis=axis)
            if some.size:
                self.low[:, side] = self.low[:, side + 2] = np.where(self.ink > 0, some.argmax(axis=1), 0)
                self.high[:, side] = self.high[:, side + 2] = np.where(self.ink > 0, some.shape[1] - 1 - some[:, ::-1].argmax(axis=1), 1)
        self.rows, self.lanes = self.height + 7, (self.width + 7) // 32 + 2
        wide = np.zeros((count, self.rows, self.lanes * 32), np.uint8)
        wide[:, 3 : 3 + self.height, 3 : 3 + self.width] = masks
        self.words = np.packbits(wide, axis=2, bitorder="little").view("<u4")

    def __call__(self, at: np.ndarray, lines: np.ndarray) -> np.ndarray:
        inside = np.clip(lines, self.low[at], self.high[at])
        off, near = np.ones(len(at)), np.zeros(len(at))
        inked = np.flatnonzero(self.ink[at] > 0)
        for part in np.array_split(inked, -(-len(inked) // 256)) if len(inked) else ():
            off[part], near[part] = self._shares(at[part], inside[part])
        return 1 - near + 0.5 * off + ((lines - inside) ** 2).sum(axis=1)

    def _shares(self, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of each line outside its mask, and the share of its mask near it."""
        points = inside[:, None, :2] + np.linspace(0, 1, self.n)[:, None] * (inside[:, None, 2:] - inside[:, None, :2])
        x, y = np.rint(points).astype(int).transpose(2, 0, 1)
        off = 1 - self.masks[at[:, None], y, x].sum(axis=1) / self.n
        first = np.floor(points).astype(int) - 3
        apart = (first[..., None] + np.arange(8) - points[..., None]) ** 2  # line, point, x or y, eight pixels
        lane, shift = np.divmod(first[..., 0] + 3, 32)
        place = ((np.arange(len(at))[:, None] * self.rows + first[..., 1] + 3) * self.lanes + lane)[..., None] + np.arange(8) * self.lanes
        bits = np.packbits((apart[:, :, 0, None, :] + apart[:, :, 1, :, None] <= self.reach * self.reach).reshape(-1), bitorder="little")
        bits = bits.reshape(len(at), self.n, 8).astype(np.uint64) << shift[..., None].astype(np.uint64)
        found = np.zeros(len(at) * self.rows * self.lanes, np.uint64)
        for k in range(self.n):
            found[place[:, k]] |= bits[:, k]
        found = found.reshape(len(at), self.rows, self.lanes)
        found[..., 1:] |= found[..., :-1] >> np.uint64(32)
        near = np.bitwise_count(found.astype(np.uint32) & self.words[at]).sum(axis=(1, 2))
        return off, near / self.ink[at]


def _keep_all(s: np.ndarray, at: np.ndarray) -> None:
    """``Search._keep`` of the records ``at``."""
    values = np.where(np.arange(PEOPLE) < s["n"][at, None], s["values"][at], np.inf)
    k = values.argmin(axis=1)
    better = values[np.arange(len(at)), k] < s["cost"][at] - BETTER
    up, k = at[better], k[better]
    s["best"][up], s["cost"][up] = s["points"][up, k], s["values"][up, k]
    s["stale"][up] = 0
    s["stale"][at[~better]] += 1


def _begin_all(s: np.ndarray, at: np.ndarray, f: LineCosts, seeds: list[int]) -> None:
    """``Search._begin`` of the records ``at``."""
    crowd = s["phase"][at] == PHASES.index("population")
    for i in at[crowd]:
        s["points"][i] = f.low[i] + np.random.default_rng([seeds[i], 0]).random((PEOPLE, 4)) * (f.high[i] - f.low[i])
        s["points"][i, 0] = s["best"][i]
    s["n"][at] = np.where(crowd, PEOPLE, 5)
    few = at[~crowd]
    reach = np.maximum(f.high[few] - f.low[few], 1) / np.where(s["phase"][few] == PHASES.index("simplex"), 4, 8)[:, None]
    s["points"][few, :5] = s["best"][few, None]
    for k in range(4):
        s["points"][few, k + 1, k] += reach[:, k]
    for k in range(PEOPLE):
        some = at[s["n"][at] > k]
        s["values"][some, k] = f(some, s["points"][some, k])
    _keep_all(s, at)
    s["stale"][at] = 0


def _simplex_all(s: np.ndarray, at: np.ndarray, f: LineCosts) -> None:
    """``glyphs.simplex_step`` of the records ``at``."""
    order = np.argsort(s["values"][at, :5], axis=1, kind="stable")
    points, values = np.take_along_axis(s["points"][at, :5], order[..., None], 1), np.take_along_axis(s["values"][at, :5], order, 1)
    centre = (points[:, 0] + points[:, 1] + points[:, 2] + points[:, 3]) / 4
    tried = lambda k, some: centre[some] + k * (points[some, 4] - centre[some])
    every = np.arange(len(at))
    new, value = tried(-1.0, every), np.zeros(len(at))
    value[:] = f(at, new)
    far, shy = np.flatnonzero(value < values[:, 0]), np.flatnonzero(~(value < values[:, 0]) & ~(value < values[:, 3]))
    line = tried(-2.0, far)
    v = f(at[far], line)
    better = v < value[far]
    new[far[better]], value[far[better]] = line[better], v[better]
    new[shy] = tried(0.5, shy)
    value[shy] = f(at[shy], new[shy])
    good, bad = np.flatnonzero(value < values[:, 4]), np.flatnonzero(~(value < values[:, 4]))
    points[good, 4], values[good, 4] = new[good], value[good]
    points[bad, 1:] = (points[bad, 1:] + points[bad, :1]) / 2
    for k in range(1, 5):
        values[bad, k] = f(at[bad], points[bad, k])
    s["points"][at, :5], s["values"][at, :5] = points, values


def _generation_all(s: np.ndarray, at: np.ndarray, f: LineCosts, seeds: list[int]) -> None:
    """``glyphs.generation_step`` of the records ``at``."""
    pairs, drawn = np.empty((len(at), PEOPLE, 2), int), np.empty((len(at), PEOPLE, 4))
    for j, i in enumerate(at):
        rng = np.random.default_rng([seeds[i], int(s["rounds"][i])])
        for k in range(PEOPLE):
            pairs[j, k], drawn[j, k] = rng.choice(PEOPLE, 2, replace=False), rng.random(4)
    people, values, every = s["points"][at], s["values"][at], np.arange(len(at))
    for k in range(PEOPLE):
        a, b = people[every, pairs[:, k, 0]], people[every, pairs[:, k, 1]]
        trial = np.clip(people[every, values.argmin(axis=1)] + 0.7 * (a - b), f.low[at], f.high[at])
        trial = np.where(drawn[:, k] < 0.9, trial, people[:, k])
        v = f(at, trial)
        better = v <= values[:, k]
        people[better, k], values[better, k] = trial[better], v[better]
    s["points"][at], s["values"][at] = people, values


def advance_all(s: np.ndarray, masks: list[np.ndarray], rounds: int, patience: int = 8, seeds: list[int] | None = None) -> None:
    """``Search.advance`` of many searches, in place; ``masks`` and ``seeds`` are theirs."""
    seeds = seeds or [0] * len(s)
    shapes: dict[tuple[int, ...], list[int]] = {}
    for i, m in enumerate(masks):
        shapes.setdefault(m.shape, []).append(i)
    for of in shapes.values():
        own, f, seed = s[of], LineCosts(np.stack([masks[i] for i in of])), [seeds[i] for i in of]
        new = np.flatnonzero(~own["begun"])
        own["best"][new] = np.concatenate([f.low[new, :2], f.high[new, 2:]], axis=1)
        own["cost"][new] = f(new, own["best"][new])
        final = PHASES.index("final")
        for _ in range(rounds):
            at = np.flatnonzero(own["begun"] & (own["phase"] < final))
            turn = at[(own["phase"][at] == 0) | (own["stale"][at] >= patience)]
            own["phase"][turn] += 1
            _begin_all(own, turn[own["phase"][turn] < final], f, seed)
            at = at[own["phase"][at] < final]
            own["rounds"][at] += 1
            crowd = own["phase"][at] == PHASES.index("population")
            _generation_all(own, at[crowd], f, seed)
            _simplex_all(own, at[~crowd], f)
            _keep_all(own, at)
        own["begun"] = True
        s[of] = own


def frames_all(s: np.ndarray) -> dict[str, object]:
    """``Search.frame`` of many searches, by columns."""
    values = np.where(np.arange(PEOPLE) < s["n"][:, None], s["values"], np.inf).min(axis=1)
    now = np.where(s["n"] > 0, values, s["cost"])
    return {"phase": [PHASES[p] for p in s["phase"]], "rounds": s["rounds"], "score": 1 - now, "best": 1 - s["cost"], "stroke": list(s["best"].copy()), "done": s["phase"] == PHASES.index("final")}


def search_frames(ticks: DataFrame, key: str = "glyph", rounds: int = 10, patience: int = 8, parts: int = 128) -> DataFrame:
    """key and a frame for each tick (key, tick, mask, width) of a stream: phase, rounds, score of now, best so far, the stroke, done.

    Ticks of a glyph count in their order; after the search is done they give its last frame again. Glyphs are
    dealt to ``parts``, whose searches are one state and move on together; a checkpoint keeps their number.
    """
    kind = ticks.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("tick", kind="stable")
        kept, saved = (list(state.get[0]), np.frombuffer(bytes(state.get[1]), RECORD)) if state.exists else ([], np.zeros(0, RECORD))
        keys = f[key].astype(object).where(f[key].notna(), None).tolist()
        names = list(dict.fromkeys([*kept, *keys]))
        s, place = np.zeros(len(names), RECORD), {k: i for i, k in enumerate(names)}
        s[: len(kept)] = saved
        nth = f.groupby(key, dropna=False).cumcount().to_numpy()
        rows = np.array([place[k] for k in keys])
        for n in range(nth.max() + 1):
            here = np.flatnonzero(nth == n)
            some = f.iloc[here]
            own = s[rows[here]]
            advance_all(own, [Y.mask_of(m, w) for m, w in zip(some["mask"], some["width"], strict=True)], rounds, patience, [zlib.crc32(str(keys[i]).encode()) for i in here])
            s[rows[here]] = own
            yield pd.DataFrame({key: [keys[i] for i in here], "tick": some["tick"].to_numpy(), **frames_all(own)})
        state.update((names, s.tobytes()))

    part = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(parts))).cast("int")  # numbers stay numbers where none is null
    dealt = ticks.select(part.alias("_part"), key, "tick", "mask", "width")
    return dealt.groupBy("_part").applyInPandasWithState(step, f"{key} {kind}, {FRAMES}", f"names array<{kind}>, saved binary", "append", GroupStateTimeout.NoTimeout)


def run_search(ticks: DataFrame, results: str, checkpoint: str, **how) -> None:
    """Work off the ticks that are there, a file at a time; frames are appended below ``results``."""
    search_frames(ticks, **how).writeStream.format("parquet").outputMode("append").option("path", results).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
