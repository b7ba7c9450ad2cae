"""The simulation over tables: time steps as queries over cells, and runs of many candidates.

A step looks at a cell's four neighbours through windows along raster rows and columns, so it is two sorts at any grid size and any
number of candidates. Runs are tables of tiles (`tiles.run_tiles`).

`Run` holds the same scheme in arrays, for analytic cases on small grids; tests hold the two forms against each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.functions import hydraulics as H
from rillwork.operators.kernel import hll as hll_of
from rillwork.operators.tiles import Domain, OnSync, Outcome, Params, cells_of, rain_between, run_tiles, tiled
from rillwork.sources.stored import stored

#: Arrays of one grid are for cases of a bounded size.
MOST_CELLS = 4_000_000
STATE = ("cell", "r", "c", "z", "n", "wall", "h", "qx", "qy")


def _sides(rows: DataFrame, keys: tuple[str, ...], along: str, across: str, columns: tuple[str, ...]) -> DataFrame:
    """Adds `before` and `after`: the named columns of the neighbours along an axis; null at the border and beside missing cells."""
    w = Window.partitionBy(*keys, across).orderBy(along)
    item = F.struct(F.col(along).alias("at"), *columns)
    near = lambda x, step: F.when(x["at"] == F.col(along) + step, x)
    return rows.withColumns({"_b": F.lag(item).over(w), "_a": F.lead(item).over(w)}).withColumns({"before": near(F.col("_b"), -1), "after": near(F.col("_a"), 1)}).drop("_b", "_a")


def _face(rows: DataFrame, name: str, left: tuple[Column, ...], right: tuple[Column, ...]) -> DataFrame:
    """Adds struct `name` (mass, normal, tangential, pa, pb) of the face between two cells (h, normal u, tangential u, z)."""
    rows = rows.withColumns({f"_l{i}": x for i, x in enumerate(left)} | {f"_r{i}": x for i, x in enumerate(right)})
    a, b = H.reconstructed(F.col("_l0"), F.col("_r0"), F.col("_r3") - F.col("_l3"))
    rows = rows.withColumns({"_l": a, "_r": b})
    low, high = H.wave_speeds(F.col("_l"), F.col("_l1"), F.col("_r"), F.col("_r1"))
    rows = rows.withColumns({"_low": low, "_high": high})
    flux = H.hll(*(F.col(k) for k in ("_l", "_l1", "_l2", "_r", "_r1", "_r2")), speeds=(F.col("_low"), F.col("_high")))
    pressure = lambda h: H.G / 2 * F.col(h) * F.col(h)
    both = F.struct(*(x.alias(k) for k, x in flux.items()), pressure("_l").alias("pa"), pressure("_r").alias("pb"))
    return rows.withColumn(name, both).drop("_l", "_r", "_low", "_high", *(f"_{s}{i}" for s in "lr" for i in range(4)))


def _divergence(rows: DataFrame, keys: tuple[str, ...], axis: str, d: float) -> DataFrame:
    """Adds m_, n_ and t_ of an axis: what a cell gains a second in mass, normal and tangential momentum through its two faces.

    Beyond the border stands the mirrored cell, so a closed side gives pressure alone."""
    along, across, n, t = ("c", "r", "u", "v") if axis == "x" else ("r", "c", "v", "u")
    rows = _sides(rows, keys, along, across, ("h", "z", "u", "v"))
    own = (F.col("h"), F.col(n), F.col(t), F.col("z"))
    side = lambda x, sign: (F.coalesce(F.col(f"{x}.h"), F.col("h")), F.coalesce(F.col(f"{x}.{n}"), -F.col(n)), F.coalesce(F.col(f"{x}.{t}"), F.col(t)), F.coalesce(F.col(f"{x}.z"), F.col("z")))
    rows = _face(_face(rows, "low", side("before", -1), own), "high", own, side("after", 1))
    inner = {"low": F.col("before").isNotNull(), "high": F.col("after").isNotNull()}
    through = lambda k, f: F.when(inner[f], F.col(f"{f}.{k}")).otherwise(0.0)
    mass, tangential = ((through(k, "low") - through(k, "high")) / d for k in ("mass", "tangential"))
    normal = ((F.col("low.normal") - F.col("low.pb")) - (F.col("high.normal") - F.col("high.pa"))) / d
    return rows.withColumns({f"m_{axis}": mass, f"n_{axis}": normal, f"t_{axis}": tangential}).drop("low", "high", "before", "after")


def updated(rows: DataFrame, dt: Column | float) -> DataFrame:
    """Depths and discharges after what both axes bring."""
    qx, qy = F.col("qx") + dt * (F.col("n_x") + F.col("t_y")), F.col("qy") + dt * (F.col("n_y") + F.col("t_x"))
    return rows.withColumns({"h": F.col("h") + dt * (F.col("m_x") + F.col("m_y")), "qx": qx, "qy": qy}).drop(*(f"{k}_{x}" for k in "mnt" for x in "xy"))


Number = Column | float


def _number(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sourced(rows: DataFrame, dt: Number, rain: Number = 0.0, infiltration: Number = 0.0) -> DataFrame:
    """After a step's sources: depths below 0 are mended (fix), rain falls and water seeps away off walls, friction slows what flows, what
    is dry or hardly moves stands still; rain and infiltration in m/s. Adds fix and seeped (m), and healthy: a depth far below 0 or none isn't."""
    dt = _number(dt)
    rows = _wetted(rows, dt, rain, infiltration, -H.H_DRY).withColumn("_s", F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy")))
    gn2 = H.G * F.col("n") * F.col("n")
    slow = lambda q: H.flushed(H.friction(F.col(q), F.col("_s"), F.col("h"), gn2, dt))
    return rows.withColumns({"qx": slow("qx"), "qy": slow("qy")}).drop("_s")


def _wetted(rows: DataFrame, dt: Column, rain: Number, infiltration: Number, least: float) -> DataFrame:
    """Mends depths, lets rain fall and water seep; adds fix, seeped and healthy (no depth is below `least`)."""
    flow = ~F.col("wall")
    healthy = F.col("h").isNotNull() & ~F.isnan("h") & (F.col("h") >= least)
    rows = rows.withColumns({"healthy": healthy, "fix": F.greatest(-F.col("h"), F.lit(0.0)), "h": F.greatest(F.col("h"), F.lit(0.0)) + F.when(flow, _number(rain) * dt).otherwise(0.0)})
    rows = rows.withColumn("seeped", F.when(flow, F.least(_number(infiltration) * dt, F.col("h"))).otherwise(0.0))
    return rows.withColumn("h", F.col("h") - F.col("seeped"))


def one_step(cells: DataFrame, dt: Number, dx: float, dy: float, rain: Number = 0.0, infiltration: Number = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cells (STATE; with keys, of each run) after dt in a closed basin, with fix, seeped and healthy; z of walls stands high."""
    rows = cells.withColumns({"u": H.velocity(F.col("h"), F.col("qx")), "v": H.velocity(F.col("h"), F.col("qy"))})
    rows = _divergence(_divergence(rows, keys, "x", dx), keys, "y", dy).drop("u", "v")
    return sourced(updated(rows, dt), dt, rain, infiltration)


def through_faces(rows: DataFrame, dt: float, dx: float, dy: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Depths after what flows through faces: east and south are the discharges through a cell's own two; none crosses the border."""
    for face, along, across, d in (("east", "c", "r", dx), ("south", "r", "c", dy)):
        rows = _sides(rows, keys, along, across, (face,))
        gone = F.when(F.col("after").isNotNull(), F.col(face)).otherwise(0.0) - F.coalesce(F.col(f"before.{face}"), F.lit(0.0))
        rows = rows.withColumn(f"_{face}", gone / d).drop("before", "after")
    return rows.withColumn("h", F.col("h") - dt * (F.col("_east") + F.col("_south"))).drop("_east", "_south")


def _inertial_axis(rows: DataFrame, keys: tuple[str, ...], axis: str, dt: Column, d: float) -> DataFrame:
    """The discharge through each cell's face after dt (east for x, south for y), and m_: what the cell gains in depth through both faces."""
    along, across, q = ("c", "r", "qx") if axis == "x" else ("r", "c", "qy")
    w = Window.partitionBy(*keys, across).orderBy(along)
    rows = _sides(rows, keys, along, across, ("h", "z", "n", "wall", q))
    inner = F.col("after").isNotNull() & ~F.col("wall") & ~F.col("after.wall")
    rise = F.col("after.z") - F.col("z")
    depth = F.greatest(F.col("h") - F.greatest(rise, F.lit(0.0)), F.col("after.h") - F.greatest(-rise, F.lit(0.0)), F.lit(0.0))
    beyond = F.lead(along, 2).over(w) == F.col(along) + 2  # the last face of an axis isn't smoothed; what comes in over the border is 0
    smooth = F.when(beyond & F.col("after").isNotNull(), 0.8 * F.col(q) + 0.1 * (F.coalesce(F.col(f"before.{q}"), F.lit(0.0)) + F.col(f"after.{q}"))).otherwise(F.col(q))
    n2 = (F.col("n") * F.col("n") + F.col("after.n") * F.col("after.n")) / 2
    slope = (F.col("after.z") + F.col("after.h") - F.col("z") - F.col("h")) / d
    new = F.when(inner, H.inertial_discharge(smooth, depth, slope, n2, dt)).otherwise(0.0)
    rows = rows.withColumn(f"_{q}", new)
    gone = F.col(f"_{q}") - F.coalesce(F.when(F.col("before").isNotNull(), F.lag(f"_{q}").over(w)), F.lit(0.0))
    return rows.withColumn(f"m_{axis}", -gone / d).drop("before", "after")


def inertial_step(cells: DataFrame, dt: Number, dx: float, dy: float, rain: Number = 0.0, infiltration: Number = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """A local-inertial step in a closed basin; qx and qy are the discharges through a cell's east and south face."""
    dt = _number(dt)
    rows = _inertial_axis(_inertial_axis(cells, keys, "x", dt, dx), keys, "y", dt, dy)
    rows = rows.withColumns({"h": F.col("h") + dt * (F.col("m_x") + F.col("m_y")), "qx": F.col("_qx"), "qy": F.col("_qy")}).drop("_qx", "_qy", "m_x", "m_y")
    return _wetted(rows, dt, rain, infiltration, float("-inf"))  # more may leave a cell than it has; depths are mended


def inertial_rate(h: Column, qx: Column, qy: Column, dx: float, dy: float) -> Column:
    """Courant rate of the local-inertial scheme over 0.7, of one cell."""
    safe = F.when(h > H.H_DRY, h).otherwise(1.0)
    return F.when(h > H.H_DRY, (H.celerity(safe) + F.greatest(F.abs(qx), F.abs(qy)) / safe) / min(dx, dy)).otherwise(0.0)


def run_batch(state: DataFrame, p: Params, dx: float, dy: float, on_sync: OnSync | None = None, tile: int = 64) -> tuple[DataFrame, Outcome]:
    """Runs all candidates of a batch: state has cand and STATE of every cell. Gives the final cells of those that ran to the end, with peak, t_peak and
    first_wet (s, null if never wet), and the outcome by tiles; cells of tiles that stayed dry keep their row."""
    size = state.agg(F.max("c"), F.max("r")).first()
    domain = Domain(int(size[0] or 0) + 1, int(size[1] or 0) + 1, dx, dy, max(tile, p.hold + 2))
    ground = stored(tiled(state, domain), "ground")
    done = run_tiles(state.select("cand").distinct(), lambda keys: keys.join(ground, ["cand", "tile"]), domain, p, on_sync)
    ran = done.ledger.filter(F.col("number") == p.last()).select("cand") if p.last() else state.select("cand").distinct()
    wet = cells_of(done.state, domain).select("cand", "cell", *(F.col(k).alias(f"{k}_") for k in ("h", "qx", "qy", "peak", "t_peak", "first_wet")))
    every = state.select("cand", *STATE).join(ran.distinct(), "cand", "left_semi").join(wet, ["cand", "cell"], "left")
    value = lambda k: F.coalesce(f"{k}_", F.lit(0.0)).alias(k)
    return every.select("cand", "cell", "r", "c", "z", "n", "wall", *map(value, ("h", "qx", "qy", "peak")), F.col("t_peak_").alias("t_peak"), F.col("first_wet_").alias("first_wet")), done


@dataclass
class Grid:
    """Arrays of a problem: bed, roughness, walls; cell size; boundary kinds of the sides west, east, north, south.

    A side is "wall", "open", ("stage", level) or ("inflow", function of time to m3/s, first cell, cells).
    """

    z: np.ndarray
    n: np.ndarray | float = 0.0
    wall: np.ndarray | None = None
    dx: float = 1.0
    dy: float = 1.0
    sides: dict = field(default_factory=dict)

    def __post_init__(self):
        assert self.z.size <= MOST_CELLS, "the grid is too large for one group"
        self.wall = np.zeros(self.z.shape, bool) if self.wall is None else self.wall
        self.n = np.broadcast_to(np.asarray(self.n, float), self.z.shape)
        self.z = np.where(self.wall, np.nanmax(np.where(self.wall, np.nan, self.z)) + 100, self.z)


class Run:
    """One candidate's run. step() advances; ledger rows are (t, volume, rain, inflow, outflow, infiltration, fix, residual)."""

    def __init__(self, grid: Grid, p: Params, h: np.ndarray, dz: np.ndarray | None = None):
        self.g, self.p = grid, p
        self.z = grid.z + (np.where(grid.wall, 0, dz) if dz is not None else 0.0)
        self.flow = ~grid.wall
        self.h = np.where(self.flow, np.maximum(h, 0), 0.0)
        self.qx, self.qy = np.zeros_like(self.h), np.zeros_like(self.h)
        self.area, self.t, self.steps, self.gn2 = grid.dx * grid.dy, 0.0, 0, H.G * grid.n**2
        self.peak, self.t_peak = self.h.copy(), np.zeros_like(self.h)
        self.sums = dict.fromkeys(("rain", "inflow", "outflow", "infiltration", "fix"), 0.0)
        self.v0, self.ledger, self.dts = self.volume(), [], []

    def volume(self) -> float:
        return float(self.h.sum()) * self.area

    def rate(self) -> float:
        wet = self.h > H.H_DRY
        h = np.where(wet, self.h, 1.0)
        c = np.sqrt(H.G * h)
        return float(np.where(wet, (np.abs(self.qx) / h + c) / self.g.dx + (np.abs(self.qy) / h + c) / self.g.dy, 0.0).max(initial=0.0))

    def _ghost(self, name: str, h, q, t, z, inward: float, length: float, dt: float):
        """Depth, normal and tangential discharge beyond a side whose inner cells are given."""
        kind = self.g.sides.get(name, "wall")
        if kind == "wall":
            return h, -q, t
        if kind == "open":
            return h, q, t
        if kind[0] == "stage":
            return np.maximum(kind[1] - z, 0), q, t
        total = kind[1](self.t + dt / 2)
        on = np.zeros(len(h), bool)
        on[kind[2] : kind[2] + kind[3]] = True
        unit = total / (kind[3] * length)
        return np.where(on, np.maximum(h, np.cbrt(unit * unit / H.G)), h), np.where(on, inward * unit, -q), np.where(on, 0.0, t)

    def _axis(self, h, q, t, z, first: str, last: str, length: float, dt: float):
        """Fluxes along axis 1 of all faces, with the two sides: mass, what the left and right cell get, tangential."""
        a, b = (self._ghost(s, h[:, k], q[:, k], t[:, k], z[:, k], i, length, dt) for s, k, i in ((first, 0, 1.0), (last, -1, -1.0)))
        h, q, t = (np.concatenate([a[i][:, None], x, b[i][:, None]], axis=1) for i, x in enumerate((h, q, t)))
        z = np.concatenate([z[:, :1], z, z[:, -1:]], axis=1)
        h2 = h * h
        f = 2 * h / (h2 + np.maximum(h2, H.H_EPS**2))
        u, v = f * q, f * t
        rise = z[:, 1:] - z[:, :-1]
        hl, hr = np.maximum(h[:, :-1] - np.maximum(rise, 0), 0), np.maximum(h[:, 1:] - np.maximum(-rise, 0), 0)
        mass, normal, tangential = hll_of(hl, u[:, :-1], v[:, :-1], hr, u[:, 1:], v[:, 1:])
        for k, s in ((0, first), (-1, last)):  # nothing crosses a closed side
            if self.g.sides.get(s, "wall") == "wall":
                mass[:, k] = tangential[:, k] = 0.0
        return mass, normal - H.G / 2 * hl * hl, normal - H.G / 2 * hr * hr, tangential

    def step(self, dt: float) -> None:
        g, p = self.g, self.p
        mx, xl, xr, xt = self._axis(self.h, self.qx, self.qy, self.z, "west", "east", g.dy, dt)
        my, yl, yr, yt = (x.T for x in self._axis(self.h.T, self.qy.T, self.qx.T, self.z.T, "north", "south", g.dx, dt))
        kx, ky = dt / g.dx, dt / g.dy
        h = self.h - kx * (mx[:, 1:] - mx[:, :-1]) - ky * (my[1:] - my[:-1])
        qx = self.qx - kx * (xl[:, 1:] - xr[:, :-1]) - ky * (yt[1:] - yt[:-1])
        qy = self.qy - ky * (yl[1:] - yr[:-1]) - kx * (xt[:, 1:] - xt[:, :-1])
        for into, length in ((mx[:, 0], g.dy), (-mx[:, -1], g.dy), (my[0], g.dx), (-my[-1], g.dx)):
            self.sums["inflow"] += float(into[into > 0].sum()) * length * dt
            self.sums["outflow"] -= float(into[into < 0].sum()) * length * dt
        self._sources(h, qx, qy, dt)

    def _sources(self, h, qx, qy, dt: float) -> None:
        p = self.p
        if not np.isfinite(h).all() or h.min() < -H.H_DRY:
            raise FloatingPointError("unhealthy")
        self.sums["fix"] -= float(h[h < 0].sum()) * self.area
        h = np.maximum(h, 0)
        rain = rain_between(p.rain, self.t, self.t + dt)
        if rain:
            h = h + rain * self.flow
            self.sums["rain"] += rain * float(self.flow.sum()) * self.area
        if p.infiltration:
            gone = np.minimum(p.infiltration * dt, h) * self.flow
            h = h - gone
            self.sums["infiltration"] += float(gone.sum()) * self.area
        dry = h < H.H_DRY
        size = np.sqrt(qx * qx + qy * qy)
        drag = 1 + dt * self.gn2 * size * np.where(dry, 1.0, h) ** (-7 / 3)
        self.h = h
        self.qx, self.qy = (np.where(dry | (np.abs(q / drag) < H.Q_MIN), 0.0, q / drag) for q in (qx, qy))
        self.t += dt
        self.steps += 1
        self.dts.append(dt)
        more = h > self.peak
        self.peak, self.t_peak = np.where(more, h, self.peak), np.where(more, self.t, self.t_peak)

    def inertial_step(self, dt: float) -> None:
        """Local-inertial faces; qx and qy hold the discharge through each cell's east and south face. Sides are closed or open."""
        g = self.g
        moved = []
        for h, q, z, d, side in ((self.h, self.qx, self.z, g.dx, "east"), (self.h.T, self.qy.T, self.z.T, g.dy, "south")):
            eta = z + h
            depth = np.maximum(np.maximum(h[:, :-1] - np.maximum(z[:, 1:] - z[:, :-1], 0), h[:, 1:] - np.maximum(z[:, :-1] - z[:, 1:], 0)), 0)
            depth = np.where((z[:, :-1] > z.max() - 50) & g.wall.any() | (z[:, 1:] > z.max() - 50) & g.wall.any(), 0.0, depth)
            face = q[:, :-1]
            smooth = face.copy()
            smooth[:, :-1] = 0.8 * face[:, :-1] + 0.1 * (np.pad(face, ((0, 0), (1, 0)))[:, :-2] + face[:, 1:])
            n2 = (g.n**2 if side == "east" else g.n.T**2)
            n2 = (n2[:, :-1] + n2[:, 1:]) / 2
            wet = depth > H.H_DRY
            safe = np.where(wet, depth, 1.0)
            new = np.where(wet, (smooth - H.G * depth * dt * (eta[:, 1:] - eta[:, :-1]) / d) / (1 + H.G * n2 * dt * np.abs(smooth) * safe ** (-7 / 3)), 0.0)
            out = np.maximum(new[:, -1], 0) if g.sides.get(side) == "open" else np.zeros(len(new))
            moved.append(np.concatenate([new, out[:, None]], axis=1))
        qx, qy = moved[0], moved[1].T
        h = self.h - dt / g.dx * (qx - np.pad(qx, ((0, 0), (1, 0)))[:, :-1]) - dt / g.dy * (qy - np.pad(qy, ((1, 0), (0, 0)))[:-1])
        self.sums["outflow"] += dt * (float(qx[:, -1].sum()) * g.dy + float(qy[-1].sum()) * g.dx)
        self.sums["fix"] -= float(h[h < 0].sum()) * self.area
        h = np.maximum(h, 0)
        rain = rain_between(self.p.rain, self.t, self.t + dt)
        h = h + rain * self.flow
        self.sums["rain"] += rain * float(self.flow.sum()) * self.area
        self.h, self.qx, self.qy = h, qx, qy
        self.t += dt
        self.steps += 1
        self.dts.append(dt)
        more = h > self.peak
        self.peak, self.t_peak = np.where(more, h, self.peak), np.where(more, self.t, self.t_peak)

    def syncs(self):
        """Runs from sync point to sync point; yields the time of each. A step that nearly reaches one is cut or stretched to it."""
        p = self.p
        inertial = p.scheme == "inertial"
        next_sync = min(p.sync, p.duration)
        while self.t < p.duration - 1e-9:
            if inertial:
                wet = self.h > H.H_DRY
                deep = np.where(wet, self.h, 1.0)
                fast = np.maximum(np.abs(self.qx), np.abs(self.qy)) / deep
                rate = float(np.where(wet, np.sqrt(H.G * deep) + fast, 0.0).max(initial=0.0)) / min(self.g.dx, self.g.dy)
                dt = min(0.7 / rate if rate > 0 else p.dt_max, p.dt_max)
            else:
                rate = self.rate()
                dt = min(p.cfl / rate if rate > 0 else p.dt_max, p.dt_max)
            hits = self.t + dt >= next_sync - 1e-9 * p.sync
            if hits:
                dt = next_sync - self.t
            (self.inertial_step if inertial else self.step)(dt)
            if hits:
                self.t = next_sync
                s = self.sums
                v = self.volume()
                self.ledger.append((self.t, v, *s.values(), v - (self.v0 + s["rain"] + s["inflow"] - s["outflow"] - s["infiltration"] + s["fix"])))
                next_sync = min(next_sync + p.sync, p.duration)
                yield self.t
