"""Column expressions of the shallow-water scheme: HLL fluxes on reconstructed depths, sources, local inertia, boundaries.

Methods: Audusse et al. 2004 (hydrostatic reconstruction), Toro (HLL, two-rarefaction speeds), Bates et al. 2010 (local inertia).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the numerical method.
G = 9.81
H_DRY, H_EPS, Q_MIN = 1e-6, 1e-5, 1e-30


def larger(a: Column, b: Column | float) -> Column:
    return F.when(a > b, a).otherwise(b)


def smaller(a: Column, b: Column | float) -> Column:
    return F.when(a < b, a).otherwise(b)


def velocity(h: Column, q: Column, h_eps: float = H_EPS) -> Column:
    """Discharge over depth, bounded where water is shallow."""
    h2 = h * h
    return 2 * h * q / (h2 + larger(h2, h_eps * h_eps))


def celerity(h: Column) -> Column:
    return F.sqrt(G * h)


def reconstructed(h_left: Column, h_right: Column, rise: Column) -> tuple[Column, Column]:
    """Depths at a face whose bed rises by `rise` from left to right."""
    return larger(h_left - larger(rise, 0.0), 0.0), larger(h_right - larger(-rise, 0.0), 0.0)


def over_crest(h_left: Column, h_right: Column, rise_left: Column, rise_right: Column) -> tuple[Column, Column]:
    """Depths at a face with a crest above both beds."""
    return larger(h_left - rise_left, 0.0), larger(h_right - rise_right, 0.0)


def wave_speeds(h_left: Column, u_left: Column, h_right: Column, u_right: Column, dry: float = H_DRY) -> tuple[Column, Column]:
    c_left, c_right = celerity(h_left), celerity(h_right)
    u = (u_left + u_right) / 2 + c_left - c_right
    c = (c_left + c_right) / 2 + (u_left - u_right) / 4
    low = F.when(h_left <= dry, u_right - 2 * c_right).when(h_right <= dry, u_left - c_left).otherwise(smaller(u_left - c_left, u - c))
    high = F.when(h_left <= dry, u_right + c_right).when(h_right <= dry, u_left + 2 * c_left).otherwise(larger(u_right + c_right, u + c))
    return low, high


def hll(h_left: Column, u_left: Column, v_left: Column, h_right: Column, u_right: Column, v_right: Column, dry: float = H_DRY, speeds: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Flux through a face: mass, normal momentum, tangential momentum (carried from upwind). speeds: wave_speeds() where they are columns already."""
    low, high = speeds or wave_speeds(h_left, u_left, h_right, u_right, dry)
    q_left, q_right = h_left * u_left, h_right * u_right
    p_left, p_right = q_left * u_left + G / 2 * h_left * h_left, q_right * u_right + G / 2 * h_right * h_right
    both_dry = (h_left <= dry) & (h_right <= dry)
    width = F.when(high - low > 0, high - low).otherwise(1.0)

    def middle(f_left: Column, f_right: Column, s_left: Column, s_right: Column) -> Column:
        mixed = (high * f_left - low * f_right + low * high * (s_right - s_left)) / width
        return F.when(both_dry, 0.0).when(low >= 0, f_left).when(high <= 0, f_right).otherwise(mixed)

    mass = middle(q_left, q_right, h_left, h_right)
    return {"mass": mass, "normal": middle(p_left, p_right, q_left, q_right), "tangential": mass * F.when(mass > 0, v_left).otherwise(v_right)}


def friction(q: Column, speed_q: Column, h: Column, n2g: Column, dt: Column) -> Column:
    """Discharge after Manning's friction, taken implicitly."""
    safe = F.when(h < H_DRY, 1.0).otherwise(h)
    return F.when(h < H_DRY, 0.0).otherwise(q / (1 + dt * n2g * speed_q * F.pow(safe, F.lit(-7 / 3))))


def flushed(q: Column) -> Column:
    return F.when(F.abs(q) < Q_MIN, 0.0).otherwise(q)


def courant_rate(h: Column, qx: Column, qy: Column, dx: float, dy: float) -> Column:
    """Cells that a wave crosses in a second; 0 where it is dry."""
    safe = F.when(h > H_DRY, h).otherwise(1.0)
    c = celerity(safe)
    return F.when(h > H_DRY, (F.abs(qx) / safe + c) / dx + (F.abs(qy) / safe + c) / dy).otherwise(0.0)


def critical_depth(q: Column) -> Column:
    return F.cbrt(q * q / G)


def inertial_discharge(q: Column, depth: Column, slope: Column, n2: Column, dt: Column | float) -> Column:
    """Local-inertial face discharge with semi-implicit friction."""
    safe = F.when(depth > H_DRY, depth).otherwise(1.0)
    return F.when(depth > H_DRY, (q - G * depth * dt * slope) / (1 + G * n2 * dt * F.abs(q) * F.pow(safe, F.lit(-7 / 3)))).otherwise(0.0)
