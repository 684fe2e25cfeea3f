"""Clustering of the marks of one subject. Every function takes points in a fixed order and is deterministic."""

from __future__ import annotations

import numpy as np


def pairwise(points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows."""
    square = (points**2).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))


def ward(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (i, j, height, size) by Ward's criterion; new node n + step; ties go to the lowest indices.

    Nearest-neighbour chain: quadratic time and memory.
    """
    n = len(points)
    if n < 2:
        return []
    d = pairwise(points) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, chain, raw = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        i, j = min(a, b), max(a, b)
        raw.append((i, j, float(np.sqrt(d[i, j]))))
        total = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        d[i], d[:, i] = new, new
        d[i, i], alive[j] = np.inf, False
        size[i] += size[j]
    # the chain finds merges out of order: sort by height and rename the nodes
    label, merges, counts = {i: i for i in range(n)}, [], {i: 1 for i in range(n)}
    for step, (i, j, h) in enumerate(sorted(raw, key=lambda m: m[2])):
        a, b = sorted((_find(label, i), _find(label, j)))
        counts[n + step] = counts[a] + counts[b]
        merges.append((a, b, h, counts[n + step]))
        label[n + step] = n + step
        label[a] = label[b] = n + step
    return merges


def in_turn(work, jobs: int, shared) -> list:
    """Results of ``work(shared, job)`` for all jobs, one after the other."""
    return [work(shared, k) for k in range(jobs)]


def ward_rows(points: np.ndarray, run=in_turn, tile: int = 256, whole: int = 3000, axes: int = 12) -> list[tuple[int, int, float, int]]:
    """Merges of ``ward(pairwise(points))``, children before parents, without the square matrix in memory.

    Two clusters that are each other's nearest merge whatever happens elsewhere, so clusters are put into tiles by their
    mean row's coordinates on a few orthonormal axes, and merged within a tile as long as nothing outside can be nearer:
    a distance on the axes is never more than the full one. This is repeated with new tiles, larger ones where few
    could merge, until one tile holds all. Rows are made from the points in pieces; equal points merge first. Time
    grows with the square of the points, memory in proportion to them. ``run`` does the jobs of a round, see ``in_turn``.
    """
    n = len(points)
    spots, at, count = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    at, merges, nodes, size = at.ravel(), [], np.full(len(spots), -1), np.zeros(len(spots))
    for i in range(n):
        s = at[i]
        if nodes[s] >= 0:
            merges.append((*sorted((int(nodes[s]), i)), 0.0, int(size[s]) + 1))
        nodes[s] = i if nodes[s] < 0 else n + len(merges) - 1
        size[s] += 1
    own, low = np.arange(len(spots)), _on_axes(spots, count, axes, run) if len(spots) > whole else np.zeros((len(spots), 1))
    while len(nodes) > 1:
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(nodes) + 1))
        middle = np.add.reduceat(low[order] * count[order, None], starts[:-1], axis=0) / size[:, None]
        tiles = _tiles(middle, min(whole, tile * len(spots) // len(nodes)) if len(nodes) > whole else len(nodes))
        boxes = np.array([[middle[t].min(0), middle[t].max(0)] for t in tiles]), np.array([size[t].min() for t in tiles])
        into, before = np.arange(len(nodes)), len(nodes)
        for t, found in zip(tiles, run(_merges_of_tile, len(tiles), (spots, count, order, starts, size, middle, tiles, boxes)), strict=True):
            for a, b, h in found:
                a, b = t[a], t[b]
                i, j = sorted((int(nodes[a]), int(nodes[b])))
                size[a], into[b] = size[a] + size[b], a
                merges.append((i, j, h, int(size[a])))
                nodes[a] = n + len(merges) - 1
        while (into[into] != into).any():
            into = into[into]
        kept, number = np.unique(into, return_inverse=True)
        own, nodes, size = number.ravel()[own], nodes[kept], size[kept]
        if len(nodes) > 0.75 * before:
            tile, whole = tile * 2, max(whole, tile * 2)
    return merges


def _merges_of_tile(shared, k: int) -> list[tuple[int, int, float]]:
    """Merges within tile ``k``, by places in it."""
    spots, count, order, starts, size, middle, tiles, boxes = shared
    inside = [order[starts[c] : starts[c + 1]] for c in tiles[k]]
    gaps = _squares(spots, count, np.concatenate(inside), np.cumsum([0, *map(len, inside[:-1])]), size[tiles[k]])
    return _nearest_merges(gaps, size[tiles[k]], *_outside(k, tiles, boxes, middle, size))


def _distances(some: np.ndarray, rows: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Distances of ``some`` (down) to ``rows`` (across); ``room`` is two flat arrays to work in."""
    shape = len(some), len(rows)
    total, gap = np.empty((2, *shape)) if room is None else room[:, : shape[0] * shape[1]].reshape(2, *shape)
    for k in range(rows.shape[1]):
        to = gap if k else total
        np.subtract(rows[:, k], some[:, k, None], out=to)
        to *= to
        if k:
            total += gap
    return np.sqrt(total, out=total)


def _on_axes(spots: np.ndarray, count: np.ndarray, axes: int, run) -> np.ndarray:
    """Coordinates of all spots' rows (of distances to all marks) on orthonormal axes fitted to some of the rows."""
    n, root = len(spots), np.sqrt(count)
    some = _distances(spots[np.linspace(0, n - 1, 64).astype(int)], spots)
    mean = some.mean(0)
    _, _, vt = np.linalg.svd((some - mean) * root, full_matrices=False)
    parts = np.array_split(np.arange(n), max(1, n // 2000))
    return np.concatenate(run(_part_on_axes, len(parts), (spots, mean, np.ascontiguousarray((vt[:axes] * root).T), parts)))


def _part_on_axes(shared, k: int) -> np.ndarray:
    spots, mean, to, parts = shared
    rows, out, step = spots[parts[k]], np.zeros((len(parts[k]), to.shape[1])), 1000
    for i in range(0, len(rows), 64):
        for a in range(0, len(spots), step):
            out[i : i + 64] += (_distances(rows[i : i + 64], spots[a : a + step]) - mean[a : a + step]) @ to[a : a + step]
    return out


def _tiles(middle: np.ndarray, most: int) -> list[np.ndarray]:
    """Places cut at the median of the widest coordinate until no part has more than ``most``."""
    out, stack = [], [np.arange(len(middle))]
    while stack:
        part = stack.pop()
        if len(part) <= most:
            out.append(part)
            continue
        part = part[np.argsort(middle[part, np.argmax(np.ptp(middle[part], axis=0))], kind="stable")]
        stack += [np.sort(part[len(part) // 2 :]), np.sort(part[: len(part) // 2])]
    return out


def _squares(spots: np.ndarray, count: np.ndarray, inside: np.ndarray, starts: np.ndarray, size: np.ndarray, block: int = 1024) -> np.ndarray:
    """Squared distances between the mean rows of clusters whose spots lie one after the other in ``inside``."""
    m, n, share = len(starts), len(spots), count[inside] / np.repeat(size, np.diff([*starts, len(inside)]))
    rows, step = np.asfortranarray(spots[inside]), max(1, 60_000 // len(inside))
    gram, means, room = np.zeros((m, m)), np.empty((block, m)), np.empty((2, len(inside) * step))
    for k in range(0, n, block):
        end = min(k + block, n)
        for a in range(k, end, step):
            b = min(a + step, end)
            far = _distances(spots[a:b], rows, room)
            if len(inside) > m:
                far *= share
                np.add.reduceat(far, starts, axis=1, out=means[a - k : b - k])
            else:
                means[a - k : b - k] = far
        part = means[: end - k]
        part -= part.mean(1)[:, None]
        part *= np.sqrt(count[k:end])[:, None]
        gram += part.T @ part
    own = np.diag(gram)
    return np.maximum(own[:, None] + own - 2 * gram, 0)


def _outside(k: int, tiles: list[np.ndarray], boxes, middle: np.ndarray, size: np.ndarray, near: int = 30):
    """For the clusters of tile ``k``, what Ward's distances are at least: to each cluster of near tiles (with its size), and to all others."""
    (edges, least), mine = boxes, tiles[k]
    at, s = middle[mine], size[mine, None]
    others = np.delete(np.arange(len(tiles)), k)
    reach = np.maximum(np.maximum(edges[others, 0] - edges[k, 1], edges[k, 0] - edges[others, 1]), 0)
    others = others[np.argsort((reach**2).sum(1) * least[others], kind="stable")]
    rest, far = others[near:], np.full(len(mine), np.inf)
    for some in (rest[i : i + 200] for i in range(0, len(rest), 200)):
        gap = np.maximum(np.maximum(edges[some, 0] - at[:, None], at[:, None] - edges[some, 1]), 0)
        far = np.minimum(far, ((gap**2).sum(2) * 2 * s * least[some] / (s + least[some])).min(1))
    by = np.concatenate([tiles[o] for o in others[:near]]) if len(others) else np.zeros(0, int)
    a, b, w = at - at.mean(0), middle[by] - at.mean(0), size[by]
    square = np.maximum((a**2).sum(1)[:, None] * (1 - 1e-9) + (b**2).sum(1) * (1 - 1e-9) - 2 * a @ b.T, 0)
    return square * 2 * s * w / (s + w), w, far * (1 - 1e-9)


def _nearest_merges(gaps: np.ndarray, size: np.ndarray, bound: np.ndarray, weight: np.ndarray, far: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j into i, height) of each other's nearest, as long as ``bound`` and ``far`` keep everything outside farther."""
    size, far = size.copy(), far.copy()
    d = gaps * 2 * size[:, None] * size / (size[:, None] + size)
    np.fill_diagonal(d, np.inf)
    limit, out = np.minimum(bound.min(1, initial=np.inf), far), []
    near = d.argmin(1)
    while True:
        i = np.nonzero((near[near] == np.arange(len(d))) & (np.arange(len(d)) < near))[0]
        h = d[i, near[i]]
        i = i[np.isfinite(h) & (h <= limit[i]) & (h <= limit[near[i]])]
        if not len(i):
            return out
        gone = np.concatenate([i, near[i]])
        for a, b in zip(i, near[i], strict=True):
            h, sa, sb = d[a, b], size[a], size[b]
            out.append((int(a), int(b), float(np.sqrt(h))))
            new = ((sa + size) * d[a] + (sb + size) * d[b] - size * h) / (sa + sb + size)
            new[[a, b]] = np.inf
            d[a], d[:, a] = new, new
            d[b], d[:, b] = np.inf, np.inf
            bound[a] = ((sa + weight) * bound[a] + (sb + weight) * bound[b] - weight * h) / (sa + sb + weight)
            far[a], size[a] = min(far[a], far[b]), sa + sb
            limit[a] = min(bound[a].min(initial=np.inf), far[a])
        again = np.nonzero(np.isin(near, gone))[0]
        near[again] = d[again].argmin(1)


def _find(label: dict[int, int], i: int) -> int:
    while label[i] != i:
        i = label[i]
    return i


def cut_by_user(merges, users: list) -> list[list[int]]:
    """Clusters of leaves from a dendrogram, no user twice in one.

    Two open children merge if they share no user; otherwise both are closed. A child beside a closed one is
    closed too, and nothing above closed nodes merges.
    """
    n = len(users)
    nodes: dict[int, list[int] | None] = {i: [i] for i in range(n)}
    closed: list[list[int]] = []
    for step, (a, b, _, _) in enumerate(merges):
        x, y = nodes.pop(a), nodes.pop(b)
        if x is not None and y is not None and not {users[i] for i in x} & {users[i] for i in y}:
            nodes[n + step] = x + y
            continue
        closed += [c for c in (x, y) if c is not None]
        nodes[n + step] = None
    closed += [c for c in nodes.values() if c is not None]
    return sorted((sorted(c) for c in closed), key=lambda c: c[0])


def agglomerate(points: np.ndarray, users: list, rows: bool = True, merges=None) -> list[list[int]]:
    """Clusters of marks without a user twice; marks that are all by different users are one cluster.

    With ``rows``, linkage runs on the rows of the distance matrix, else on the points. ``merges`` are those of
    ``ward_rows`` if they are known already.
    """
    if len(points) == 0:
        return []
    if len(set(users)) == len(users):
        return [list(range(len(users)))]
    if merges is None:
        merges = ward(pairwise(points) if rows else points)
    return cut_by_user(merges, users)


def components(n: int, edges) -> list[list[int]]:
    """Connected components by union-find, each sorted, in order of their first node."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def friends(points: np.ndarray, within: float) -> list[list[int]]:
    """Friends of friends: components of points at most ``within`` apart."""
    return components(len(points), zip(*np.nonzero(np.triu(pairwise(points) <= within, 1)), strict=True))


def dbscan(points: np.ndarray, within: float, least: int) -> np.ndarray:
    """Labels from 0, -1 for noise. Border points join the first cluster that reaches them."""
    near = pairwise(points) <= within
    core, labels, k = near.sum(1) >= least, np.full(len(points), -1), 0
    for i in range(len(points)):
        if not core[i] or labels[i] >= 0:
            continue
        stack = [i]
        labels[i] = k
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.nonzero(near[j] & (labels < 0))[0]:
                    labels[m] = k
                    stack.append(int(m))
        k += 1
    return labels


def divisive_dbscan(points: np.ndarray, users: list, start: float = 400.0, tolerance: float = 0.01) -> list[list[int]]:
    """Halves the radius by bisection until clusters have no user twice; applied again within those that still do."""

    def split(members: list[int], high: float) -> list[list[int]]:
        if len({users[i] for i in members}) == len(members):
            return [members]
        low, best = 0.0, [[i] for i in members]
        while high - low > tolerance:
            mid = (low + high) / 2
            parts = [[members[i] for i in c] for c in friends(points[members], mid)]
            good = [c for c in parts if len({users[i] for i in c}) == len(c)]
            if len(good) == len(parts):
                low, best = mid, parts
            else:
                high = mid
        return best

    parts = friends(points, start) if len(points) else []
    return sorted((sorted(c) for p in parts for c in split(p, start)), key=lambda c: c[0])


def kmeans(points: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Labels of k-means from farthest-first seeds (the first is the point nearest to the mean)."""
    centres = [int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))]
    while len(centres) < k:
        gap = ((points[:, None] - points[centres][None]) ** 2).sum(2).min(1)
        centres.append(int(np.argmax(gap)))
    c, labels = points[centres], None
    for _ in range(rounds):
        new = ((points[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        c = np.array([points[labels == i].mean(0) if (labels == i).any() else c[i] for i in range(k)])
    return labels


def divisive_kmeans(points: np.ndarray, users: list) -> list[list[int]]:
    """More and more means until a cluster has no user twice; that one is taken out, the rest divided again."""
    left, out = list(range(len(points))), []
    while left:
        for k in range(1, len(left) + 1):
            labels = kmeans(points[left], k)
            parts = [[left[i] for i in np.nonzero(labels == c)[0]] for c in range(k)]
            good = [p for p in parts if p and len({users[i] for i in p}) == len(p)]
            if good:
                break
        out += good
        taken = {i for p in good for i in p}
        left = [i for i in left if i not in taken]
    return sorted((sorted(c) for c in out), key=lambda c: c[0])


def medoids(points: np.ndarray, users: list, k: int, rounds: int = 100) -> list[list[int]]:
    """k-medoids in which two marks of one user never share a medoid's distance: it is infinite between them."""
    d = pairwise(points)
    same = np.array([[a == b for b in users] for a in users]) & ~np.eye(len(users), dtype=bool)
    d = np.where(same, 1e12, d)
    centres = [int(np.argmin(d.sum(1)))]
    while len(centres) < min(k, len(points)):
        centres.append(int(np.argmax(d[:, centres].min(1))))
    for _ in range(rounds):
        labels = d[:, centres].argmin(1)
        new = []
        for c in range(len(centres)):
            inside = np.nonzero(labels == c)[0]
            new.append(int(inside[np.argmin(d[np.ix_(inside, inside)].sum(1))]) if len(inside) else centres[c])
        if new == centres:
            break
        centres = new
    groups = [sorted(np.nonzero(labels == c)[0].tolist()) for c in range(len(centres))]
    return sorted((g for g in groups if g), key=lambda g: g[0])


def merge_split_clicks(clusters: list[list[int]], points: np.ndarray, users: list, within: float = 20.0, least: int = 2) -> list[list[int]]:
    """Merges the nearest two clusters that share at most one user, again and again; of a shared user the first mark stays.

    Ends when no two clusters can be merged. Each cluster knows its nearest partner among those after it; after a merge
    only the partners that it touches are looked for again.
    """
    clusters = [list(c) for c in clusters]
    n, places = len(clusters), np.arange(len(clusters))
    names = [{users[a] for a in c} for c in clusters]
    where: dict = {}
    for k, own in enumerate(names):
        for u in own:
            where.setdefault(u, set()).add(k)
    centre = np.array([np.median(points[c], axis=0)[:2] for c in clusters]).reshape(n, -1)
    able, gap, partner = np.array([len(c) >= least for c in clusters], bool), np.full(n, np.inf), np.full(n, -1)

    def gaps(i: int) -> np.ndarray:
        """Distances from ``i`` to all clusters that it can be merged with, infinite to the others."""
        d = np.hypot(*(centre[i] - centre).T)
        shared = np.bincount([k for u in names[i] for k in where[u]], minlength=n)
        return np.where(able & able[i] & (shared <= 1) & (d <= within) & (places != i), d, np.inf)

    def seek(i: int, d: np.ndarray) -> None:
        after = d[i + 1 :]
        k = int(after.argmin()) if len(after) else -1
        gap[i], partner[i] = (after[k], i + 1 + k) if k >= 0 and after[k] < np.inf else (np.inf, -1)

    for i in range(n):
        seek(i, gaps(i))
    while n and gap.min() < np.inf:
        i = int(gap.argmin())
        j = int(partner[i])
        clusters[i] += [a for a in clusters[j] if users[a] not in names[i]]
        for u in names[j]:
            where[u].discard(j)
            where[u].add(i)
        names[i] |= names[j]
        centre[i], able[j], gap[j], partner[j] = np.median(points[clusters[i]], axis=0)[:2], False, np.inf, -1
        clusters[j] = []
        touched = np.nonzero((partner == i) | (partner == j))[0]
        d = gaps(i)
        seek(i, d)
        nearer = (places < i) & ((d < gap) | ((d == gap) & (d < np.inf) & (i < partner)))
        gap[nearer], partner[nearer] = d[nearer], i
        for k in touched:
            if k != i:
                seek(int(k), gaps(int(k)))
    return [c for c in clusters if c]


def cliques(n: int, edges) -> list[list[int]]:
    """Maximal cliques (Bron and Kerbosch with pivots), sorted."""
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out: list[list[int]] = []

    def grow(r: set[int], p: set[int], x: set[int]) -> None:
        if not p and not x:
            out.append(sorted(r))
            return
        pivot = max(p | x, key=lambda v: (len(near[v] & p), -v))
        for v in sorted(p - near[pivot]):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(range(n)), set())
    return sorted(out)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the hull, counter-clockwise from the lowest (x, y); monotone chain."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hesse(lines: np.ndarray) -> np.ndarray:
    """(signed distance from the origin, angle) of lines (x1, y1, x2, y2); a vertical line has the angle pi / 2."""
    x1, y1, x2, y2 = lines.T
    dx, dy = x2 - x1, y2 - y1
    length = np.hypot(dx, dy)
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(length > 0, (x2 * y1 - y2 * x1) / length, np.hypot(x1, y1))
    return np.column_stack([away, np.arctan2(np.abs(dy), np.abs(dx))])


def principal(points: np.ndarray, k: int = 2) -> np.ndarray:
    """Coordinates on the first ``k`` principal axes (signs are arbitrary)."""
    centred = points - points.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    return centred @ vt[:k].T
