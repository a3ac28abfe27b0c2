"""Small dense numerics in numpy, for the driver and for functions of bounded groups: special functions, factorisations,
quadrature rules, minimisers, quadratic programs, splines, trees of binned columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

# special functions of arrays


def gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.gamma, otypes=[float])(x)


def betaln(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(np.add(a, b))


def erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def gammaincc(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma: one less the series below a + 1, Lentz's fraction above."""

    def one(v: float) -> float:
        if v <= 0:
            return 1.0
        front = math.exp(a * math.log(v) - v - math.lgamma(a))
        if v < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > 1e-17 * abs(total):
                k += 1
                term *= v / k
                total += term
            return 1 - front * total
        b = v + 1 - a
        c, d = 1e300, 1 / b
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return front * h

    return np.vectorize(one, otypes=[float])(x)


_LEGENDRE = np.polynomial.legendre.leggauss(400)


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """K_nu for nu >= 0 and x > 0, by Gauss-Legendre on exp(-x cosh t) cosh(nu t), cut where it falls under 1e-18 of its top."""
    x = np.asarray(x, float)
    flat = x.reshape(-1)
    # x (cosh t - 1) - nu t = 42 bounds the tail
    t = np.full(len(flat), 1.0)
    for _ in range(60):
        t = np.arccosh(1 + (45 + nu * t) / np.maximum(flat, 1e-300))
    at, w = _LEGENDRE
    u = (at[None, :] + 1) / 2 * t[:, None]
    # cosh(nu t) with its exponential taken into the other's, so that nothing overflows
    value = np.exp(nu * u - flat[:, None] * np.cosh(u)) * (1 + np.exp(-2 * nu * u)) / 2
    return (value * w).sum(1).reshape(x.shape) * (t / 2).reshape(x.shape)


def bessel_k_pair(nu: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return bessel_k(nu, x), bessel_k(nu + 1, x)


# factorisations


def solve_triangular(t: np.ndarray, b: np.ndarray, lower: bool = True, trans: bool = False) -> np.ndarray:
    """x of T x = b, or of T'x = b, by substitution."""
    a = t.T if trans else t
    forward = lower != trans
    x = np.array(b, float)
    order = range(len(a)) if forward else reversed(range(len(a)))
    for i in order:
        done = slice(0, i) if forward else slice(i + 1, None)
        x[i] = (x[i] - a[i, done] @ x[done]) / a[i, i]
    return x


def cholesky_jitter(a: np.ndarray, tries: int = 8) -> tuple[np.ndarray, float]:
    """(lower factor, jitter): the diagonal grows from nothing by tenfold steps until the matrix factors."""
    jitter = 0.0
    for k in range(tries):
        try:
            return np.linalg.cholesky(a + jitter * np.eye(len(a))), jitter
        except np.linalg.LinAlgError:
            jitter = float(np.trace(a) / len(a)) * 10.0 ** (k - 12)
    raise np.linalg.LinAlgError("not positive definite")


def cho_solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def cho_inverse(low: np.ndarray) -> np.ndarray:
    return cho_solve(low, np.eye(len(low)))


def cho_logdet(low: np.ndarray) -> float:
    return float(2 * np.log(np.diag(low)).sum())


def least_squares_svd(a: np.ndarray, b: np.ndarray, rcond: float | None = None) -> tuple[np.ndarray, int]:
    """(x, rank) of min |Ax - b|, the columns scaled to length one first; singular values under rcond of the largest are nought."""
    scale = np.sqrt((a * a).sum(0))
    scale[scale == 0] = 1
    u, s, vt = np.linalg.svd(a / scale, full_matrices=False)
    keep = s > (rcond if rcond is not None else max(a.shape) * np.finfo(float).eps) * s.max(initial=0)
    x = vt[keep].T @ ((u[:, keep].T @ b) / (s[keep] if np.ndim(b) == 1 else s[keep, None]))
    return x / (scale if np.ndim(b) == 1 else scale[:, None]), int(keep.sum())


def pls_rotations(x: np.ndarray, y: np.ndarray, components: int) -> np.ndarray:
    """Rotations R of partial least squares with one output: scores are X R. From the moments X'X and X'y alone."""
    return pls_from_moments(x.T @ x, x.T @ y, components)


def pls_from_moments(gram: np.ndarray, cross: np.ndarray, components: int) -> np.ndarray:
    r, p = [], []
    s = np.array(cross, float).reshape(-1)
    for _ in range(components):
        w = s / max(np.linalg.norm(s), 1e-300)
        for a, b in zip(r, p, strict=True):
            w = w - (b @ w) * a
        tt = w @ gram @ w
        load = gram @ w / max(tt, 1e-300)
        r.append(w)
        p.append(load)
        s = s - load * (w @ np.array(cross, float).reshape(-1))
    return np.array(r).T


# derivatives by differences


def jacobian(f: Callable[[np.ndarray], np.ndarray], x: Sequence[float], central: bool = False) -> tuple[np.ndarray, int]:
    """(J, calls) of a vector function."""
    x = np.asarray(x, float)
    f0 = None if central else np.asarray(f(x), float)
    columns, calls = [], 0 if central else 1
    for k in range(len(x)):
        h = (np.finfo(float).eps ** (1 / 3 if central else 1 / 2)) * max(1.0, abs(x[k]))
        up = x.copy()
        up[k] += h
        if central:
            down = x.copy()
            down[k] -= h
            columns.append((np.asarray(f(up), float) - np.asarray(f(down), float)) / (up[k] - down[k]))
            calls += 2
        else:
            columns.append((np.asarray(f(up), float) - f0) / (up[k] - x[k]))
            calls += 1
    return np.stack(columns, -1), calls


def gradient(f: Callable[[np.ndarray], float], x: Sequence[float]) -> np.ndarray:
    return jacobian(lambda v: np.array([f(v)]), x, central=True)[0][0]


def stencil(point: Sequence[float], orders: Sequence[int], step: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights) of the central difference that stands for the mixed derivative of the given orders (0, 1 or 2 each)."""
    rules = {0: ([0], [1.0]), 1: ([-1, 1], [-0.5 / step, 0.5 / step]), 2: ([-1, 0, 1], [1 / step**2, -2 / step**2, 1 / step**2])}
    points, weights = [np.asarray(point, float)], [1.0]
    for k, order in enumerate(orders):
        at, w = rules[order]
        points = [p + step * a * np.eye(len(point))[k] for p in points for a in at]
        weights = [v * u for v in weights for u in w]
    return np.array(points), np.array(weights)


# minimisers


def minimize_scalar(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-9, points: int = 9) -> tuple[float, float]:
    """(x, f(x)) of a least value inside [lo, hi]: an even grid, narrowed again and again to its best point's neighbours."""
    while True:
        at = np.linspace(lo, hi, points)
        values = [f(float(x)) for x in at]
        best = int(np.argmin(values))
        if hi - lo <= tol * max(abs(lo), abs(hi), 1.0):
            return float(at[best]), values[best]
        lo, hi = float(at[max(best - 1, 0)]), float(at[min(best + 1, points - 1)])


def minimize(f: Callable[[np.ndarray], float], x0: Sequence[float], bounds: Sequence[tuple[float, float]] | None = None, method: str = "quasi-newton", tol: float = 1e-9, rounds: int = 1000, memory: int = 10) -> tuple[np.ndarray, float]:
    """(x, f(x)): projected quasi-Newton steps from the last few changes, or a simplex search (`simplex`), inside bounds."""
    lo, hi = (np.array([b[k] for b in bounds], float) for k in (0, 1)) if bounds else (np.full(len(x0), -np.inf), np.full(len(x0), np.inf))
    inside = lambda v: np.clip(v, lo, hi)
    x = inside(np.asarray(x0, float))
    if method == "simplex":
        return _simplex(lambda v: f(inside(v)), x, tol, rounds, inside)
    fx, g = f(x), gradient(lambda v: f(inside(v)), x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if np.abs(np.where(free, g, 0)).max(initial=0) < tol * max(1.0, abs(fx)):
            break
        d, alphas = np.where(free, g, 0), []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        d = -np.where(free, d, 0)
        if d @ g >= 0:
            d, pairs = -np.where(free, g, 0), []
        step, new, fn = 1.0, x, fx
        for _ in range(50):
            new = inside(x + step * d)
            fn = f(new)
            if fn <= fx + 1e-4 * (g @ (new - x)):
                break
            step /= 2
        if not fn < fx:
            break
        gn = gradient(lambda v: f(inside(v)), new)
        s, y = new - x, gn - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(fx - fn) <= 1e-15 * max(1.0, abs(fx))
        x, fx, g = new, fn, gn
        if done:
            break
    return x, float(fx)


def _simplex(f: Callable, x: np.ndarray, tol: float, rounds: int, inside: Callable) -> tuple[np.ndarray, float]:
    points = [x] + [x + (0.05 * abs(x[k]) + 0.05) * np.eye(len(x))[k] for k in range(len(x))]
    held = sorted(((f(p), k, p) for k, p in enumerate(points)), key=lambda t: t[:2])
    n = len(held)
    for _ in range(rounds * len(x)):
        if held[-1][0] - held[0][0] <= tol * (abs(held[0][0]) + tol):
            break
        centre = np.mean([p for _, _, p in held[:-1]], axis=0)
        worst = held[-1][2]
        at = lambda c: (f(centre + c * (centre - worst)), n, centre + c * (centre - worst))  # noqa: B023, E731
        n += 1
        new = at(1.0)
        if new[0] < held[0][0]:
            new = min(new, at(2.0), key=lambda t: t[0])
        elif new[0] >= held[-2][0]:
            new = at(0.5) if new[0] < held[-1][0] else at(-0.5)
        if new[0] < held[-1][0]:
            held[-1] = new
        else:
            best = held[0][2]
            held = [held[0]] + [(f(best + 0.5 * (p - best)), k, best + 0.5 * (p - best)) for _, k, p in held[1:]]
        held.sort(key=lambda t: t[:2])
    return inside(held[0][2]), float(held[0][0])


LOSSES: dict[str, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]] = {
    "linear": lambda z: (z, np.ones_like(z)), "soft_l1": lambda z: (2 * (np.sqrt(1 + z) - 1), 1 / np.sqrt(1 + z)), "cauchy": lambda z: (np.log1p(z), 1 / (1 + z)),
    "huber": lambda z: (np.where(z <= 1, z, 2 * np.sqrt(np.maximum(z, 1)) - 1), np.where(z <= 1, 1.0, 1 / np.sqrt(np.maximum(z, 1)))), "arctan": lambda z: (np.arctan(z), 1 / (1 + z * z)),
}


def least_squares(f: Callable[[np.ndarray], np.ndarray], x0: Sequence[float], bounds: Sequence[tuple[float, float]] | None = None, loss: str = "linear", scale: float = 1.0, tol: float = 1e-12, rounds: int = 200) -> dict:
    """Damped Gauss-Newton steps inside bounds on sum rho((f / scale)^2) * scale^2 / 2: {x, cost, jac, residual}."""
    lo, hi = (np.array([b[k] for b in bounds], float) for k in (0, 1)) if bounds else (np.full(len(x0), -np.inf), np.full(len(x0), np.inf))
    rho = LOSSES[loss]
    cost_of = lambda r: 0.5 * scale**2 * rho((r / scale) ** 2)[0].sum()
    x, damp = np.clip(np.asarray(x0, float), lo, hi), 1e-3
    r = np.asarray(f(x), float)
    cost = cost_of(r)
    for _ in range(rounds):
        j, _ = jacobian(f, x, central=True)
        w = rho((r / scale) ** 2)[1]
        g, h = j.T @ (w * r), j.T @ (w[:, None] * j)
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-14 * max(cost, 1):
            break
        better = False
        for _ in range(40):
            step = np.zeros(len(x))
            hf = h[np.ix_(free, free)]
            step[free] = np.linalg.lstsq(hf + damp * np.diag(np.maximum(np.diag(hf), 1e-300)), -g[free], rcond=None)[0]
            new = np.clip(x + step, lo, hi)
            rn = np.asarray(f(new), float)
            cn = cost_of(rn)
            if cn < cost:
                better = True
                break
            damp *= 4
        if not better:
            break
        small = cost - cn <= tol * cost and np.abs(new - x).max() <= math.sqrt(tol) * (np.abs(x).max() + math.sqrt(tol))
        x, r, cost, damp = new, rn, cn, max(damp / 10, 1e-12)
        if small:
            break
    return {"x": x, "cost": float(cost), "jac": jacobian(f, x, central=True)[0], "residual": r}


def multi_start(optimizer: Callable[[np.ndarray], tuple[np.ndarray, float]], starts: Sequence[Sequence[float]]) -> tuple[np.ndarray, float]:
    """The lowest of an optimizer's results from several starts; a start that raises is passed over."""
    best = None
    for s in starts:
        try:
            x, v = optimizer(np.asarray(s, float))
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            continue
        if math.isfinite(v) and (best is None or v < best[1]):
            best = x, v
    if best is None:
        raise ValueError("no start led to a finite value")
    return best


def bounded_qp(h: np.ndarray, g: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None, ridge: float = 1e-12) -> np.ndarray:
    """min x'Hx / 2 + g'x in a box, by active sets: solve on the free variables, step to the first bound, release by sign."""
    n = len(g)
    lo = np.full(n, -np.inf) if lo is None else np.asarray(lo, float)
    hi = np.full(n, np.inf) if hi is None else np.asarray(hi, float)
    h = h + ridge * max(np.trace(h) / n, 1e-300) * np.eye(n)
    x = np.clip(np.zeros(n), lo, hi)
    fixed = (x == lo) | (x == hi)
    for _ in range(50 * n + 100):
        free = ~fixed
        d = np.zeros(n)
        if free.any():
            d[free] = np.linalg.solve(h[np.ix_(free, free)], -(g + h @ x)[free])
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(d > 0, (hi - x) / d, np.where(d < 0, (lo - x) / d, np.inf))
        k = int(np.argmin(room))
        if room[k] < 1:
            x = x + room[k] * d
            x[k] = hi[k] if d[k] > 0 else lo[k]
            fixed[k] = True
            continue
        x = x + d
        grad = g + h @ x
        pull = np.where(fixed & (x == lo), -grad, np.where(fixed & (x == hi), grad, -np.inf))
        pull[lo == hi] = -np.inf
        k = int(np.argmax(pull))
        if pull[k] <= 1e-12 * max(1.0, np.abs(g).max()):
            break
        fixed[k] = False
    return np.clip(x, lo, hi)


# quadrature


def gauss_jacobi(n: int, alpha: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1] for the weight (1 - x)^alpha, from the eigenvalues of the recurrence."""
    k = np.arange(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = -(alpha**2) / ((2 * k + alpha) * (2 * k + alpha + 2))
    a[0] = -alpha / (alpha + 2)
    j = k[1:]
    s = 2 * j + alpha
    b = 4 * j**2 * (j + alpha) ** 2 / (s**2 * (s + 1) * (s - 1))
    x, v = np.linalg.eigh(np.diag(a) + np.diag(np.sqrt(b), 1) + np.diag(np.sqrt(b), -1))
    return x, v[0] ** 2 * 2 ** (alpha + 1) / (alpha + 1)


def _points(order: int) -> int:
    return order // 2 + 1


def line_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(_points(order))
    return x[:, None], w


def _product(*rules: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    points, weights = rules[0]
    for p, w in rules[1:]:
        points = np.hstack([np.repeat(points, len(p), 0), np.tile(p, (len(points), 1))])
        weights = np.outer(weights, w).reshape(-1)
    return points, weights


def square_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    return _product(line_rule(order), line_rule(order))


def cube_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    return _product(line_rule(order), line_rule(order), line_rule(order))


def _unit_jacobi(order: int, alpha: int) -> tuple[np.ndarray, np.ndarray]:
    """On [0, 1] for the weight (1 - x)^alpha."""
    x, w = gauss_jacobi(_points(order), alpha)
    return (x + 1) / 2, w / 2 ** (alpha + 1)


def triangle_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit triangle, by a square collapsed at one corner."""
    (u, wu), (v, wv) = _unit_jacobi(order, 1), _unit_jacobi(order, 0)
    a, b = np.meshgrid(u, v, indexing="ij")
    return np.stack([a, (1 - a) * b], -1).reshape(-1, 2), np.outer(wu, wv).reshape(-1)


def tetra_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    (u, wu), (v, wv), (t, wt) = (_unit_jacobi(order, k) for k in (2, 1, 0))
    a, b, c = np.meshgrid(u, v, t, indexing="ij")
    return np.stack([a, (1 - a) * b, (1 - a) * (1 - b) * c], -1).reshape(-1, 3), np.einsum("i,j,k->ijk", wu, wv, wt).reshape(-1)


def wedge_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangle times the line [-1, 1]."""
    return _product(triangle_rule(order), line_rule(order))


def pyramid_rule(order: int) -> tuple[np.ndarray, np.ndarray]:
    """The pyramid over the square [-1, 1]^2 with its top at height 1: |x|, |y| <= 1 - z."""
    z, wz = _unit_jacobi(order, 2)
    p, w = square_rule(order)
    points = [np.hstack([p * (1 - h), np.full((len(p), 1), h)]) for h in z]
    return np.vstack(points), np.concatenate([w * k for k in wz])


def box_quadrature(lower: Sequence[float], upper: Sequence[float], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tensor Gauss-Legendre points and weights on a box, exact to degree 2n - 1 an input."""
    rules = []
    for a, b in zip(lower, upper, strict=True):
        x, w = np.polynomial.legendre.leggauss(n)
        rules.append((((x + 1) / 2 * (b - a) + a)[:, None], w * (b - a) / 2))
    return _product(*rules)


# B-splines of any knots


def bspline_basis(t: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
    """Values of the splines of degree k with knots t, by the recurrence; beyond the ends by the end pieces."""
    n = len(t) - k - 1
    x = np.asarray(x, float)
    piece = np.clip(np.searchsorted(t, x, "right") - 1, k, n - 1)
    b = np.zeros((len(x), len(t) - 1))
    b[np.arange(len(x)), piece] = 1
    for d in range(1, k + 1):
        new = np.zeros((len(x), len(t) - 1 - d))
        for i in range(len(t) - 1 - d):
            lo, hi = t[i + d] - t[i], t[i + d + 1] - t[i + 1]
            if lo > 0:
                new[:, i] += (x - t[i]) / lo * b[:, i]
            if hi > 0:
                new[:, i] += (t[i + d + 1] - x) / hi * b[:, i + 1]
        b = new
    return b


def splev(t: np.ndarray, c: np.ndarray, k: int, x: np.ndarray, ext: int = 0) -> np.ndarray:
    """A spline's values: beyond its ends extrapolated (0), zero (1), an error (2) or the end's value (3)."""
    x = np.asarray(x, float)
    lo, hi = t[k], t[-k - 1]
    out = (x < lo) | (x > hi)
    if ext == 2 and out.any():
        raise ValueError("outside the spline's interval")
    v = bspline_basis(t, k, np.clip(x, lo, hi) if ext == 3 else x) @ c[: len(t) - k - 1]
    return np.where(out, 0.0, v) if ext == 1 else v


def splder(t: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Knots, coefficients and degree of the derivative."""
    n = len(t) - k - 1
    gap = t[k + 1 : n + k] - t[1:n]
    return t[1:-1], k * np.diff(c[:n]) / np.where(gap > 0, gap, 1), k - 1


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, s: float | None = None, k: int = 3, knots: np.ndarray | None = None) -> dict:
    """{t, c, k, fp}: the smoothest spline on as few knots as reach sum (w (y - f))^2 <= s, knots added where the misfit is.

    Knots: inner knots to go on from. With s = 0 the spline passes through the points.
    """
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    s = float(len(x) - math.sqrt(2 * len(x))) if s is None else s
    inner = np.array([] if knots is None else knots, float)
    ends = lambda i: np.concatenate([[x[0]] * (k + 1), i, [x[-1]] * (k + 1)])
    most = len(x) - k - 1

    def fit(t: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
        b = bspline_basis(t, k, x) * w[:, None]
        rows, rhs = [b], [w * y]
        if p < np.inf and len(t) > 2 * k + 2:
            rows.append(_jumps(t, k) / math.sqrt(p))
            rhs.append(np.zeros(len(t) - 2 * k - 2))
        c = least_squares_svd(np.vstack(rows), np.concatenate(rhs))[0]
        return c, (b @ c - w * y) ** 2

    while True:
        t = ends(inner)
        c, miss = fit(t, np.inf)
        fp = miss.sum()
        if fp <= s * (1 + 1e-9) + 1e-300 or len(inner) >= most:
            break
        # a knot in the interval with the greatest misfit, at its middle point
        cuts = np.concatenate([[x[0]], inner, [x[-1]]])
        part = np.clip(np.searchsorted(cuts, x, "right") - 1, 0, len(cuts) - 2)
        total = np.bincount(part, miss, len(cuts) - 1)
        total[[len(np.unique(x[(x > a) & (x < b)])) == 0 for a, b in zip(cuts, cuts[1:], strict=False)]] = -1
        q = int(np.argmax(total))
        if total[q] < 0:
            break
        own = x[(x > cuts[q]) & (x < cuts[q + 1])]
        inner = np.sort(np.append(inner, own[len(own) // 2]))
    if s > 0 and fp < s and len(inner):
        # on these knots, the smoothest that still reaches s
        lo, hi = -30.0, 30.0
        for _ in range(80):
            mid = (lo + hi) / 2
            c, miss = fit(t, math.exp(mid))
            lo, hi = (mid, hi) if miss.sum() > s else (lo, mid)
        c, miss = fit(t, math.exp(hi))
        fp = miss.sum()
    return {"t": t, "c": c, "k": k, "fp": float(fp)}


def _jumps(t: np.ndarray, k: int) -> np.ndarray:
    """Jumps of the k-th derivative at the inner knots, a row each."""
    n = len(t) - k - 1
    inner = t[k + 1 : n]
    level, knots, degree = np.eye(n), t, k
    for _ in range(k):
        gap = knots[degree + 1 : len(knots) - 1] - knots[1 : len(knots) - degree - 1]
        level = degree * np.diff(level, axis=0) / np.where(gap > 0, gap, 1)[:, None]
        knots, degree = knots[1:-1], degree - 1
    # level: the k-th derivative in each interval
    edges = knots
    at = [int(np.searchsorted(edges, v, "right")) - 1 for v in inner]
    return np.array([level[min(j, len(level) - 1)] - level[max(j - 1, 0)] for j in at]) if len(inner) else np.zeros((0, n))


def difference_matrix(n: int, order: int) -> np.ndarray:
    return np.diff(np.eye(n), order, axis=0)


def smoothing_criterion(deviance: float, n: float, edf: float, scale: float | None = None, gamma_: float = 1.0) -> float:
    """GCV, or UBRE where the scale is known."""
    return n * deviance / (n - gamma_ * edf) ** 2 if scale is None else deviance / n - scale + 2 * gamma_ * scale * edf / n


# one regression tree on binned columns


@dataclass
class Tree:
    """Nodes in a row: the column and highest bin that go left (column -1: a leaf), children, value, gain."""

    column: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), int)
        column, cut, left, right = (np.array(x) for x in (self.column, self.bin, self.left, self.right))
        while (column[at] >= 0).any():
            go = np.flatnonzero(column[at] >= 0)
            n = at[go]
            at[go] = np.where(codes[go, column[n]] <= cut[n], left[n], right[n])
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(codes)]

    def depth(self) -> int:
        def below(k: int) -> int:
            return 0 if self.column[k] < 0 else 1 + max(below(self.left[k]), below(self.right[k]))

        return below(0)


def build_tree(codes: np.ndarray, g: np.ndarray, h: np.ndarray, max_depth: int = 6, least: int = 1, ridge: float = 0.0) -> Tree:
    """A tree level by level: each level's histograms of gradients at once, the best cut of each node by gain."""
    tree = Tree([], [], [], [], [], [])

    def add(rows: np.ndarray) -> int:
        for name, v in (("column", -1), ("bin", -1), ("left", -1), ("right", -1), ("gain", 0.0)):
            getattr(tree, name).append(v)
        tree.value.append(float(-g[rows].sum() / (h[rows].sum() + ridge)) if len(rows) else 0.0)
        return len(tree.column) - 1

    level = [(add(np.arange(len(codes))), np.arange(len(codes)))]
    bins = int(codes.max(initial=0)) + 1
    for _ in range(max_depth):
        following = []
        for node, rows in level:
            best = (1e-12, -1, -1)
            gs, hs = g[rows].sum(), h[rows].sum()
            for c in range(codes.shape[1]):
                gl = np.cumsum(np.bincount(codes[rows, c], g[rows], bins))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, c], h[rows], bins))[:-1]
                nl = np.cumsum(np.bincount(codes[rows, c], minlength=bins))[:-1]
                ok = (nl >= least) & (len(rows) - nl >= least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), -np.inf)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (float(gain[b]), c, b)
            if best[1] < 0:
                continue
            left = codes[rows, best[1]] <= best[2]
            tree.column[node], tree.bin[node], tree.gain[node] = best[1], best[2], best[0]
            for name, part in (("left", rows[left]), ("right", rows[~left])):
                child = add(part)
                getattr(tree, name)[node] = child
                following.append((child, part))
        level = following
    return tree


def importance(trees: Sequence[Tree], columns: int) -> np.ndarray:
    """Total gain of each column, of sum one."""
    out = np.zeros(columns)
    for t in trees:
        for c, v in zip(t.column, t.gain, strict=True):
            if c >= 0:
                out[c] += v
    return out / max(out.sum(), 1e-300)


# queries: the pieces at given arguments, beside closed forms


def _rows(s, rows):
    return s.createDataFrame([(n, float(v)) for n, v in rows], "name string, value double")


def _q_special(s, d):
    x = np.array([0.5, 1.0, 2.5, 7.0])
    rows = [(f"gamma{k}", v) for k, v in enumerate(gamma(np.array([1.0, 2.0, 5.0])))] + [(f"erfc{k}", v) for k, v in enumerate(erfc(np.array([0.0])))]
    rows += [(f"q1_{v}", q) for v, q in zip(x, gammaincc(1.0, x), strict=True)] + [(f"q2_{v}", q) for v, q in zip(x, gammaincc(2.0, x), strict=True)]
    k0, k1 = bessel_k_pair(0.5, x)
    rows += [(f"k05_{v}", a) for v, a in zip(x, k0, strict=True)] + [(f"k15_{v}", a) for v, a in zip(x, k1, strict=True)] + [("betaln", betaln(2.0, 3.0))]
    return _rows(s, [(n, round(float(v), 10)) for n, v in rows])


def _q_rules(s, d):
    """Integrals of monomials over the reference shapes."""
    rows = []
    for name, rule, powers in (("line", line_rule, [(4,)]), ("square", square_rule, [(2, 4)]), ("cube", cube_rule, [(2, 2, 4)]), ("triangle", triangle_rule, [(2, 1), (0, 3)]), ("tetra", tetra_rule, [(1, 1, 1), (3, 0, 0)]), ("wedge", wedge_rule, [(1, 1, 2)]), ("pyramid", pyramid_rule, [(2, 0, 1), (0, 0, 0)])):
        p, w = rule(6)
        rows += [(name + "".join(map(str, e)), round(float((w * np.prod(p ** np.array(e), 1)).sum()), 12)) for e in powers]
    p, w = box_quadrature([0, 1], [2, 4], 3)
    rows.append(("box", round(float((w * p[:, 0] ** 3 * p[:, 1]).sum()), 12)))
    return _rows(s, rows)


def _q_optimum(s, d):
    rosen = lambda v: 100 * (v[1] - v[0] ** 2) ** 2 + (1 - v[0]) ** 2
    rows = [("scalar", minimize_scalar(lambda t: (t - 1.25) ** 2 + 3, -4, 6)[0])]
    rows += [(f"newton{k}", v) for k, v in enumerate(minimize(rosen, [-1.2, 1.0])[0])]
    rows += [(f"simplex{k}", v) for k, v in enumerate(minimize(rosen, [-1.2, 1.0], method="simplex", tol=1e-14)[0])]
    rows += [(f"bounded{k}", v) for k, v in enumerate(minimize(lambda v: ((v - np.array([2.0, -3.0])) ** 2).sum(), [0, 0], bounds=[(0, 1), (-1, 5)])[0])]
    x = np.arange(1, 9.0)
    rows += [(f"lm{k}", v) for k, v in enumerate(least_squares(lambda p: p[0] * np.exp(-p[1] * x) - 3 * np.exp(-0.4 * x), [1.0, 1.0])["x"])]
    rows += [(f"qp{k}", v) for k, v in enumerate(bounded_qp(np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([-8.0, 1.0]), np.zeros(2), np.array([3.0, 9.0])))]
    return _rows(s, [(n, round(float(v), 4)) for n, v in rows])


def _q_spline(s, d):
    x = np.linspace(0, 2, 21)
    f = smoothing_spline(x, x**3 - x, s=1e-12)
    t, c, k = splder(f["t"], f["c"], f["k"])
    at = np.array([0.0, 0.5, 1.25, 2.0, 2.5])
    return s.createDataFrame([(float(a), round(float(v), 8), round(float(w), 7)) for a, v, w in zip(at, splev(f["t"], f["c"], f["k"], at), splev(t, c, k, at), strict=True)], "x double, value double, slope double")


QUERIES = {"special_more": _q_special, "quadrature_rules": _q_rules, "numeric_optimizers": _q_optimum, "spline_values": _q_spline}
_V = "SELECT * FROM (VALUES {}) t(name, value)"
SQL = {
    "special_more": "SELECT name, round(value::DOUBLE, 10) AS value FROM (SELECT * FROM (VALUES ('gamma0', 1.0::DOUBLE), ('gamma1', 1.0), ('gamma2', 24.0), ('erfc0', 1.0), ('betaln', ln(1.0 / 12))) a(name, value) UNION ALL SELECT 'q1_' || x, exp(-x) FROM (VALUES ('0.5'::VARCHAR, 0.5::DOUBLE), ('1.0', 1.0), ('2.5', 2.5), ('7.0', 7.0)) t(n, x) UNION ALL SELECT 'q2_' || x, exp(-x) * (1 + x) FROM (VALUES (0.5::DOUBLE), (1.0), (2.5), (7.0)) t(x) UNION ALL SELECT 'k05_' || x, sqrt(pi() / (2 * x)) * exp(-x) FROM (VALUES (0.5::DOUBLE), (1.0), (2.5), (7.0)) t(x) UNION ALL SELECT 'k15_' || x, sqrt(pi() / (2 * x)) * exp(-x) * (1 + 1 / x) FROM (VALUES (0.5::DOUBLE), (1.0), (2.5), (7.0)) t(x))",
    "quadrature_rules": "SELECT name, round(value, 12) AS value FROM (VALUES ('line4', 2.0::DOUBLE / 5), ('square24', 4.0::DOUBLE / 15), ('cube224', 8.0::DOUBLE / 45), ('triangle21', 1.0::DOUBLE / 60), ('triangle03', 1.0::DOUBLE / 20), ('tetra111', 1.0::DOUBLE / 720), ('tetra300', 1.0::DOUBLE / 120), ('wedge112', 1.0::DOUBLE / 36), ('pyramid201', 4.0::DOUBLE / 3 / 30), ('pyramid000', 4.0::DOUBLE / 3), ('box', 30.0::DOUBLE)) t(name, value)",
    "numeric_optimizers": "SELECT * FROM (VALUES ('scalar', 1.25::DOUBLE), ('newton0', 1.0), ('newton1', 1.0), ('simplex0', 1.0), ('simplex1', 1.0), ('bounded0', 1.0), ('bounded1', -1.0), ('lm0', 3.0), ('lm1', 0.4), ('qp0', 3.0), ('qp1', 0.0)) t(name, value)",
    "spline_values": "SELECT x::DOUBLE AS x, round(x * x * x - x, 8)::DOUBLE AS value, round(3 * x * x - 1, 7)::DOUBLE AS slope FROM (VALUES (0.0::DOUBLE), (0.5), (1.25), (2.0), (2.5)) t(x)",
}
