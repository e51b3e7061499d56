"""Polygons that are their boxes' plans are not clipped; others are, and all have the areas that clipping gives."""

import numpy as np
import pyarrow as pa
import pytest

from spandrel.operators import spatial

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
SHAPES = [
    SQUARE, [(x + 0.5, y + 0.25) for x, y in SQUARE], [(x * 2 - 0.5, y / 2 + 0.25) for x, y in SQUARE[2:] + SQUARE[:2]], [(0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5)],
    [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(0.2, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [*SQUARE, (0.0, 0.5)],
]


def test_plans_are_not_clipped(monkeypatch):
    seen, clip = [], spatial.clip_areas
    monkeypatch.setattr(spatial, "clip_areas", lambda p, q: seen.extend([len(p)]) or clip(p, q))
    lo, hi = (np.array([f(np.array(s), axis=0) for s in SHAPES]) for f in (np.min, np.max))
    poly = pa.array([[{"x": x, "y": y} for x, y in s] for s in SHAPES])
    sides = {f"{name}{k}": (v[:, k] if k < 2 else np.zeros(len(SHAPES))) for name, v in (("lo", lo), ("hi", hi)) for k in range(3)}
    x = spatial._Boxes(pa.table({"id": np.arange(len(SHAPES)), "own": np.zeros(len(SHAPES), int), **sides, "poly": poly}))
    a, b = np.triu_indices(len(SHAPES), 1)
    keep, out = spatial._common(1e-6)(x, a, b)
    want = [clip(np.array([SHAPES[i]]), np.array([SHAPES[j]]))[0] for i, j in zip(a[keep], b[keep], strict=True)]
    assert len(keep) > 20 and out["area"] == pytest.approx(want, abs=1e-9)
    assert sum(seen) == sum(i > 2 or j > 2 for i, j in zip(a[keep], b[keep], strict=True))
