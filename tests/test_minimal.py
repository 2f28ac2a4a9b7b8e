"""Minimal solvers and the poses that stand on them, with points in space, on planes and off by noise."""

import numpy as np
import pytest

from manyview.operators import minimal, twoview
from manyview.operators.adjust import rodrigues, skew


def view(rng, spots):
    """Two cameras about two units apart that look at points five units away."""
    r, t = rodrigues(rng.normal(0, 0.15, 3)), rng.normal(0, 1, 3) * [1, 1, 0.3]
    ahead = spots @ r.T + t
    return r, t, spots[:, :2] / spots[:, 2:], ahead[:, :2] / ahead[:, 2:]


def scene(rng, n, planar):
    spots = rng.uniform(-1.5, 1.5, (n, 3)) + [0, 0, 5]
    if planar:
        spots[:, 2] = 5 + 0.3 * spots[:, 0] - 0.5 * spots[:, 1]
    return spots


def degrees(r, other):
    return np.degrees(np.arccos(np.clip((np.trace(r @ other.T) - 1) / 2, -1, 1)))


@pytest.mark.parametrize("planar", [False, True])
def test_five_points_hold_the_true_matrix(planar):
    rng = np.random.default_rng(1)
    for _ in range(20):
        r, t, a, b = view(rng, scene(rng, 5 * 30, planar))
        found = minimal.five_points(a.reshape(-1, 5, 2), b.reshape(-1, 5, 2))
        true = skew(t) @ r
        true /= np.linalg.norm(true)
        gaps = np.minimum(np.abs(found - true).max((2, 3)), np.abs(found + true).max((2, 3)))
        assert (np.nanmin(gaps, axis=1) < 1e-5).mean() > 0.9
        e = found[np.isfinite(found).all((2, 3))]
        assert np.abs(np.linalg.det(e)).max() < 1e-6


@pytest.mark.parametrize("planar", [False, True])
def test_three_points_hold_the_true_pose(planar):
    rng = np.random.default_rng(2)
    spots = scene(rng, 3 * 500, planar)
    r, t, _, uv = view(rng, spots)
    rs, ts = minimal.three_points(spots.reshape(-1, 3, 3), uv.reshape(-1, 3, 2))
    gap = np.nanmin(np.abs(rs - r).max((2, 3)) + np.abs(ts - t).max(2), axis=1)
    assert (gap < 1e-5).mean() > 0.97
    rs, _ = minimal.three_points(np.zeros((2, 3, 3)), np.zeros((2, 3, 2)))  # one place three times: no pose
    assert np.isnan(rs).any((2, 3)).all()


@pytest.mark.parametrize("planar", [False, True])
def test_relative_poses_with_noise_and_wrong_pairs(planar):
    rng, pixel, off = np.random.default_rng(3), 1 / 800, []
    for k in range(12):
        spots = scene(rng, 200, planar)
        r, t, a, b = view(rng, spots)
        b = b + rng.normal(0, 0.5 * pixel, b.shape)
        b[:50] = rng.uniform(-0.5, 0.5, (50, 2))
        got_r, got_t, inside = twoview.relative_pose(a, b, 2 * pixel, k)
        assert inside[50:].mean() > 0.9 and inside[:50].mean() < 0.2
        off.append(max(degrees(r, got_r), np.degrees(np.arccos(np.clip(got_t @ t / np.linalg.norm(t), -1, 1)))))
    # On a plane two poses fit; where all points are nearer to one camera, nothing tells them apart.
    assert np.median(off) < 1.5 and np.mean(np.array(off) < 3) >= (0.5 if planar else 1)


def test_eight_points_fail_on_a_plane():
    rng = np.random.default_rng(4)
    r, t, a, b = view(rng, scene(rng, 200, True))
    wrong, _ = twoview.pose_of(twoview.eight_points(a, b), a, b)
    right, direction, inside = twoview.relative_pose(a, b, 1e-4, 1)
    assert degrees(wrong, r) > 1 and inside.all()
    assert np.abs(twoview.sampson(skew(direction) @ right, a, b)).max() < 1e-7


@pytest.mark.parametrize("planar", [False, True])
def test_absolute_poses_with_noise_and_wrong_pairs(planar):
    rng, pixel = np.random.default_rng(5), 1 / 800
    for k in range(12):
        spots = scene(rng, 120, planar)
        r, t, _, uv = view(rng, spots)
        uv = uv + rng.normal(0, 0.5 * pixel, uv.shape)
        uv[:40] = rng.uniform(-0.5, 0.5, (40, 2))
        got_r, got_t, inside = twoview.absolute_pose(spots, uv, 3 * pixel, k)
        assert degrees(r, got_r) < 0.3 and np.abs(got_t - t).max() < 0.05 and inside[40:].mean() > 0.95 and inside[:40].mean() < 0.2
    assert twoview.absolute_pose(spots[:5], uv[:5], 1, 0)[2].sum() == 0
    assert not twoview.absolute_pose(np.zeros((9, 3)), np.zeros((9, 2)), 1e-3, 0)[2].any()
