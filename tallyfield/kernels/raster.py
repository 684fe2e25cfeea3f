"""Consensus of polygons on a pixel grid."""

from __future__ import annotations

import numpy as np

from .cluster import components


def fill(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies inside a polygon, by the even-odd rule along scan lines."""
    out = np.zeros((height, width), bool)
    x, y = points[:, 0], points[:, 1]
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    for row in range(max(0, int(np.floor(y.min()))), min(height, int(np.ceil(y.max())) + 1)):
        at = row + 0.5
        cross = (y <= at) != (y2 <= at)
        if not cross.any():
            continue
        xs = np.sort(x[cross] + (at - y[cross]) / (y2[cross] - y[cross]) * (x2[cross] - x[cross]))
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            out[row, max(0, int(np.ceil(a - 0.5))) : max(0, int(np.ceil(b - 0.5)))] = True
    return out


def regions(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected regions of a mask, 0 elsewhere; runs of rows joined by union-find."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    links = []
    for r in range(1, mask.shape[0]):
        above = range(first[r - 1], first[r])
        for i in range(first[r], first[r + 1]):
            links += [(j, i) for j in above if begin[j] < end[i] and begin[i] < end[j]]
    labels = np.zeros(mask.shape, np.int32)
    for k, runs in enumerate(components(len(row), links), 1):
        for i in runs:
            labels[row[i], begin[i] : end[i]] = k
    return labels


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """Corners (x, y) of the outer edge of one region, clockwise from its topmost, leftmost pixel."""
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    padded = np.pad(mask, 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    for r, c in zip(*np.nonzero(mask & ~inner), strict=True):
        if not padded[r, c + 1]:
            edges.setdefault((c, r), []).append((c + 1, r))
        if not padded[r + 1, c + 2]:
            edges.setdefault((c + 1, r), []).append((c + 1, r + 1))
        if not padded[r + 2, c + 1]:
            edges.setdefault((c + 1, r + 1), []).append((c, r + 1))
        if not padded[r + 1, c]:
            edges.setdefault((c, r + 1), []).append((c, r))
    r = int(np.argmax(mask.any(1)))
    start = at = (int(np.argmax(mask[r])), r)
    path, before = [], None
    while True:
        ways = edges[at]
        # where two corners touch, turn right, so that the path keeps to its own region
        step = ways[0] if len(ways) == 1 or before is None else max(ways, key=lambda w: -((w[0] - at[0]) * (at[1] - before[1]) - (w[1] - at[1]) * (at[0] - before[0])))
        ways.remove(step)
        if before is None or (step[0] - at[0], step[1] - at[1]) != (at[0] - before[0], at[1] - before[1]):
            path.append(at)
        before, at = at, step
        if at == start:
            return path


def consensus(polygons, users: list, tools: list[int], height: int, width: int, least_area: float = 0.001):
    """(tool, area share, outline) of every region that more than half of the users (rounded down) filled.

    A pixel takes the tool most users gave it (ties: the lowest); regions up to ``least_area`` of the image are dropped.
    """
    names = sorted(set(users), key=str)
    kinds = sorted(set(tools))
    votes = np.zeros((len(kinds), height, width), np.int32)
    for name in names:
        mine = np.zeros((len(kinds), height, width), bool)
        for p, u, t in zip(polygons, users, tools, strict=True):
            if u == name:
                mine[kinds.index(t)] |= fill(np.asarray(p, float), height, width)
        votes += mine
    best = votes.argmax(0)
    positive = votes.sum(0) > len(names) // 2
    out = []
    for k, tool in enumerate(kinds):
        labels = regions(positive & (best == k))
        for n in range(1, labels.max() + 1):
            region = labels == n
            area = region.sum() / (height * width)
            if area > least_area:
                out.append((tool, float(area), outline(region)))
    return out


def shoelace(points: np.ndarray) -> float:
    """Area of a polygon."""
    x, y = points[:, 0], points[:, 1]
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)
