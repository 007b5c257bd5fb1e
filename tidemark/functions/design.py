"""Recursive filter design: a low-pass prototype, its band, and second-order sections.

Prototypes are poles, zeros and the gain at frequency 0, with the pass band's
(type II: the stop band's) edge at 1. The band substitution and the bilinear
map act on roots; the overall gain follows from the prototype's gain at the
one frequency that 0 is sent to. Elliptic functions are evaluated by Landen
steps on the modulus.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOW, HIGH, PASS, STOP = 0, 1, 2, 3
FAMILIES = ("butterworth", "cheby1", "cheby2", "elliptic")


def _ripple(db: float) -> float:
    return float(np.sqrt(10 ** (db / 10) - 1))


def _angles(n: int) -> np.ndarray:
    return (2 * np.arange(n) + 1) * np.pi / (2 * n)


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-15 and len(out) < 20:
        k = (k / (1 + np.sqrt((1 - k) * (1 + k)))) ** 2
        out.append(k)
    return out


def _ascend(w, moduli: list[float]):
    for v in reversed(moduli):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _cd(u, k: float):
    """Elliptic cd; ``u`` in quarter periods."""
    return _ascend(np.cos(np.asarray(u) * np.pi / 2), _landen(k))


def _sn(u, k: float):
    return _ascend(np.sin(np.asarray(u) * np.pi / 2), _landen(k))


def _arc_sn(w: complex, k: float) -> complex:
    w = complex(w)
    for before, v in zip([k, *_landen(k)], _landen(k), strict=False):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (w * before) ** 2 + 0j)))
    return 2 / np.pi * np.arcsin(w)


def _selectivity(n: int, k1: float) -> float:
    """The modulus of an elliptic filter of order ``n`` whose ripples have ratio ``k1``."""
    other = np.sqrt((1 - k1) * (1 + k1))
    u = (2 * np.arange(1, n // 2 + 1) - 1) / n
    k = other**n * np.prod(_sn(u, other) ** 4)
    return float(np.sqrt((1 - k) * (1 + k)))


def prototype(family: str, n: int, pass_db: float = 0.0, stop_db: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """zeros, poles, gain at 0."""
    a, even_gain = _angles(n), 10 ** (-pass_db / 20) if n % 2 == 0 else 1.0
    none = np.zeros(0, complex)
    if family == "butterworth":
        return none, -np.sin(a) + 1j * np.cos(a), 1.0
    if family == "cheby1":
        v = np.arcsinh(1 / _ripple(pass_db)) / n
        return none, -np.sinh(v) * np.sin(a) + 1j * np.cosh(v) * np.cos(a), even_gain
    if family == "cheby2":
        v = np.arcsinh(_ripple(stop_db)) / n
        finite = a[np.abs(np.cos(a)) > 1e-12]
        return 1j / np.cos(finite), 1 / (-np.sinh(v) * np.sin(a) + 1j * np.cosh(v) * np.cos(a)), 1.0
    if family != "elliptic":
        raise ValueError(f"no filter family {family!r}")
    ripple = _ripple(pass_db)
    k1 = ripple / _ripple(stop_db)
    k = _selectivity(n, k1) if n > 1 else k1
    u = (2 * np.arange(1, n // 2 + 1) - 1) / n
    v = (-1j * _arc_sn(1j / ripple, k1) / n).real
    half = 1j * _cd(u - 1j * v, k)
    poles = np.concatenate([half, half.conj(), [1j * _sn(1j * v, k)] if n % 2 else []])
    zero = 1j / (k * _cd(u, k))
    return np.concatenate([zero, zero.conj()]), poles, even_gain


def _roots(s: np.ndarray, band: int, edges: tuple[float, ...]) -> np.ndarray:
    """Where the band substitution sends prototype roots."""
    if band == LOW:
        return s * edges[0]
    if band == HIGH:
        return edges[0] / s
    width, middle = edges[1] - edges[0], edges[0] * edges[1]
    half = (s * width if band == PASS else width / s) / 2
    spread = np.sqrt(half * half - middle + 0j)
    return np.concatenate([half + spread, half - spread])


def _sections(z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows (b0, b1, b2, a1, a2); roots pair with their conjugates, real ones among themselves."""

    def quadratics(r: np.ndarray) -> list[tuple[float, float]]:
        real = np.sort(r[np.abs(r.imag) < 1e-9].real)
        out = [(-2 * x.real, abs(x) ** 2) for x in r[r.imag >= 1e-9]]
        if len(real) % 2:
            real = np.append(real, 0.0)
        return out + [(-(x + y), x * y) for x, y in real.reshape(-1, 2)]

    top, bottom = quadratics(z), quadratics(p)
    return np.array([(1.0, *n, *d) for n, d in zip(top, bottom, strict=True)])


@lru_cache(maxsize=256)
def design(family: str, band: int, order: int, edges: tuple[float, ...], fs: float, pass_db: float = 0.0, stop_db: float = 0.0) -> np.ndarray:
    """Second-order sections for a sample rate."""
    check(family, band, order, edges, pass_db, stop_db)
    if max(edges) >= fs / 2:
        raise ValueError(f"the cutoff must be below the Nyquist frequency, {fs / 2} Hz")
    warped = tuple(float(np.tan(np.pi * e / fs)) for e in edges)
    z, p, gain = prototype(family, order, pass_db, stop_db)
    # A zero at infinity goes where the substitution sends it: infinity, 0, both, or the middle.
    missing = len(p) - len(z)
    z, p = _roots(z, band, warped), _roots(p, band, warped)
    far = {LOW: [], HIGH: [0.0], PASS: [0.0], STOP: [1j * np.sqrt(np.prod(warped)), -1j * np.sqrt(np.prod(warped))]}[band]
    z = np.concatenate([z, far * missing])
    z, p = (1 + z) / (1 - z), (1 + p) / (1 - p)
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    middle = 2 * np.arctan(np.sqrt(np.prod(warped)))
    at = {LOW: 1.0, HIGH: -1.0, PASS: np.exp(1j * middle), STOP: 1.0}[band]
    out = _sections(z, p)
    out[0, :3] *= (gain / (np.prod(at - z) / np.prod(at - p) * at ** (len(p) - len(z)))).real
    return out


def check(family: str, band: int, order: int, edges: tuple[float, ...], pass_db: float, stop_db: float) -> None:
    if family not in FAMILIES or band not in (LOW, HIGH, PASS, STOP) or order < 1:
        raise ValueError("family, band (0 low, 1 high, 2 pass, 3 stop) or order is none there is")
    if len(edges) != (2 if band in (PASS, STOP) else 1) or edges[0] <= 0 or list(edges) != sorted(set(edges)):
        raise ValueError("low and high take one cutoff above 0, pass and stop 0 < f1 < f2")
    if family == "cheby1" and pass_db <= 0 or family == "cheby2" and stop_db <= 0 or family == "elliptic" and not 0 < pass_db < stop_db:
        raise ValueError("ripple and attenuation must be above 0, and the attenuation above the ripple")
