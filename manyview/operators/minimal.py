"""Poses from the fewest correspondences that fix them: five for an essential matrix, three (and a fourth to choose) for a camera.

Unlike linear fits of eight and six points these hold for points of a plane too. All hypotheses of a RANSAC are solved
together in stacked arrays; solutions that are not real are NaN.
"""

from __future__ import annotations

import numpy as np

#: Monomials in x, y, z as exponents: of degree one, two and three at most, those of the highest degree first.
_LINEAR = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]
_SQUARE = [(2, 0, 0), (1, 1, 0), (1, 0, 1), (0, 2, 0), (0, 1, 1), (0, 0, 2), *_LINEAR]
_CUBIC = [(3, 0, 0), (2, 1, 0), (2, 0, 1), (1, 2, 0), (1, 1, 1), (1, 0, 2), (0, 3, 0), (0, 2, 1), (0, 1, 2), (0, 0, 3), *_SQUARE]


def _products(left: list, right: list, out: list) -> np.ndarray:
    """(left, right, out): 1 where the product of two monomials is the third."""
    table = np.zeros((len(left), len(right), len(out)))
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            table[i, j, out.index(tuple(x + y for x, y in zip(a, b)))] = 1
    return table


_TO_SQUARE, _TO_CUBIC = _products(_LINEAR, _LINEAR, _SQUARE), _products(_SQUARE, _LINEAR, _CUBIC)


def five_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, 10, 3, 3): the essential matrices of n times five correspondences (n, 5, 2) in normalised coordinates.

    A matrix of the null space of the five epipolar equations, x X + y Y + z Z + W, is essential if ten cubic equations hold. They
    give the cubic monomials by the others; so multiplying by x is linear in the ten others, and its eigenvectors are the solutions.
    """
    ax, ay, bx, by = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    rows = np.stack([bx * ax, bx * ay, bx, by * ax, by * ay, by, ax, ay, np.ones_like(ax)], -1)
    free = np.linalg.svd(rows, full_matrices=True)[2][..., 5:, :]  # (n, 4, 9)
    e = np.moveaxis(free, 1, 2).reshape(-1, 3, 3, 4)  # each entry is a linear form
    gram = np.einsum("nikp,njkq,pqs->nijs", e, e, _TO_SQUARE, optimize=True)
    half = np.einsum("nkks->ns", gram) / 2
    gram = gram - np.eye(3)[None, :, :, None] * half[:, None, None, :]
    traces = np.einsum("niks,nkjp,spc->nijc", gram, e, _TO_CUBIC, optimize=True).reshape(-1, 9, 20)
    cross = np.einsum("nip,njq,pqs->nijs", e[:, 1], e[:, 2], _TO_SQUARE, optimize=True)
    minors = np.stack([cross[:, 1, 2] - cross[:, 2, 1], cross[:, 2, 0] - cross[:, 0, 2], cross[:, 0, 1] - cross[:, 1, 0]], 1)
    volume = np.einsum("nis,nip,spc->nc", minors, e[:, 0], _TO_CUBIC, optimize=True)
    equations = np.concatenate([traces, volume[:, None]], 1)
    lead, rest = equations[..., :10], equations[..., 10:]
    sound = np.linalg.cond(lead) < 1e14
    lead = np.where(sound[:, None, None], lead, np.eye(10))
    reduced = -np.linalg.solve(lead, rest)
    action = np.zeros((len(e), 10, 10))
    for i, monomial in enumerate(_SQUARE):
        to = (monomial[0] + 1, *monomial[1:])
        if to in _SQUARE:
            action[:, i, _SQUARE.index(to)] = 1
        else:
            action[:, i] = reduced[:, _CUBIC.index(to)]
    values, vectors = np.linalg.eig(action)
    with np.errstate(divide="ignore", invalid="ignore"):
        places = np.moveaxis(vectors[:, 6:9] / vectors[:, 9:], 1, 2)
        real = sound[:, None] & (np.abs(values.imag) < 1e-6 * (1 + np.abs(values.real))) & np.isfinite(places).all(-1)
        found = np.einsum("nsp,nijp->nsij", np.concatenate([places.real, np.ones_like(places.real[..., :1])], -1), e)
        found = found / np.linalg.norm(found, axis=(2, 3), keepdims=True)
    return np.where(real[..., None, None], found, np.nan)


def _frames(points: np.ndarray) -> np.ndarray:
    """(..., 3, 3): an orthonormal frame, in columns, of three points (..., 3, 3)."""
    one, other = points[..., 1, :] - points[..., 0, :], points[..., 2, :] - points[..., 0, :]
    x = one / np.linalg.norm(one, axis=-1, keepdims=True)
    z = np.cross(one, other)
    z = z / np.linalg.norm(z, axis=-1, keepdims=True)
    return np.stack([x, np.cross(z, x), z], -1)


def _quartic_roots(c: np.ndarray) -> np.ndarray:
    """(n, 4): the roots of polynomials with coefficients (n, 5), the highest first; two Newton steps each."""
    companion = np.zeros((len(c), 4, 4))
    companion[:, 0] = -c[:, 1:] / c[:, :1]
    companion[:, [1, 2, 3], [0, 1, 2]] = 1
    sound = np.isfinite(companion).all((1, 2))
    roots = np.where(sound[:, None], np.linalg.eigvals(np.where(sound[:, None, None], companion, 0)), np.nan)
    for _ in range(2):
        value, slope = np.zeros_like(roots), np.zeros_like(roots)
        for k in range(5):
            slope = slope * roots + value
            value = value * roots + c[:, k : k + 1]
        roots = roots - np.where(np.abs(slope) > 1e-300, value / np.where(slope == 0, 1, slope), 0)
    return roots


def three_points(x: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R (n, 4, 3, 3) and t (n, 4, 3) from n times three points (n, 3, 3) and their normalised pixels (n, 3, 2).

    The sides of the triangle and the angles between the rays give the ratio of two distances as a root of a quartic; distances
    give the triangle before the camera, and two triangles the pose.
    """
    rays = np.concatenate([uv, np.ones_like(uv[..., :1])], -1)
    rays = rays / np.linalg.norm(rays, axis=-1, keepdims=True)
    cos_a, cos_b, cos_c = ((rays[:, i] * rays[:, j]).sum(-1) for i, j in ((1, 2), (0, 2), (0, 1)))
    with np.errstate(all="ignore"):
        aa, bb, cc = (np.square(x[:, i] - x[:, j]).sum(-1) for i, j in ((1, 2), (0, 2), (0, 1)))
        a, c = aa / bb, cc / bb
        d, s = a - c, a + c
        quartic = np.stack([
            (d - 1) ** 2 - 4 * c * cos_a**2,
            4 * (d * (1 - d) * cos_b - (1 - s) * cos_a * cos_c + 2 * c * cos_a**2 * cos_b),
            2 * (d**2 - 1 + 2 * d**2 * cos_b**2 + 2 * (1 - c) * cos_a**2 - 4 * s * cos_a * cos_b * cos_c + 2 * (1 - a) * cos_c**2),
            4 * (-d * (1 + d) * cos_b + 2 * a * cos_c**2 * cos_b - (1 - s) * cos_a * cos_c),
            (1 + d) ** 2 - 4 * a * cos_c**2,
        ], -1)
        roots = _quartic_roots(quartic)
        v = np.where(np.abs(roots.imag) < 1e-6 * (1 + np.abs(roots.real)), roots.real, np.nan)
        cos_a, cos_b, cos_c, d = (y[:, None] for y in (cos_a, cos_b, cos_c, d))
        u = ((d - 1) * v**2 - 2 * d * cos_b * v + 1 + d) / (2 * (cos_c - v * cos_a))
        first = np.sqrt(bb[:, None] / (1 + v**2 - 2 * v * cos_b))
        far = np.stack([first, u * first, v * first], -1)
        far = np.where((far > 0).all(-1, keepdims=True), far, np.nan)
        seen = far[..., None] * rays[:, None]  # (n, 4, 3, 3)
        r = _frames(seen) @ np.swapaxes(_frames(x), -1, -2)[:, None]
        t = seen[..., 0, :] - (r @ x[:, None, 0, :, None])[..., 0]
    return r, t
