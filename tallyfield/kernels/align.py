"""Alignment of transcriptions of one line and votes on its characters."""

from __future__ import annotations

import numpy as np

from .cluster import components

# Codes of a gap inside a text, outside it, of too few voters, and of disagreement.
GAP, OUTSIDE, FEW, DISAGREE = (chr(c) for c in (24, 25, 26, 27))


def _scores(profile: list[dict[str, int]], text: str) -> np.ndarray:
    total = max(sum(profile[0].values()), 1) if profile else 1
    out = np.zeros((len(profile), len(text)))
    for ch in set(text):
        low, up = ch.lower(), ch.upper()
        at = [j for j, x in enumerate(text) if x == ch]
        out[:, at] = np.array([(c.get(ch, 0) + 0.5 * (c.get(low, 0) + c.get(up, 0))) / total for c in profile]).reshape(-1, 1)
    return out


def align(texts: list[str], open_gap: float = 0.85, extend: float = 0.1) -> list[str]:
    """Texts padded with gaps to one length: longest first, each aligned to the growing profile with affine gaps.

    Removing the gaps gives each text back. Equal texts stay equal; an empty text becomes gaps.
    """
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), texts[i], i))
    rows: dict[int, str] = {}
    for i in order:
        if not rows:
            rows[i] = texts[i]
            continue
        twin = next((j for j in rows if texts[j] == texts[i]), None)
        if twin is not None:
            rows[i] = rows[twin]
            continue
        width = len(next(iter(rows.values())))
        profile: list[dict[str, int]] = [{} for _ in range(width)]
        for row in rows.values():
            for c, ch in enumerate(row):
                profile[c][ch] = profile[c].get(ch, 0) + 1
        path = _path(_scores(profile, texts[i]), open_gap, extend)
        mine, grown = [], {j: [] for j in rows}
        for a, b in path:
            mine.append(texts[i][b] if b is not None else GAP)
            for j, row in rows.items():
                grown[j].append(row[a] if a is not None else GAP)
        rows = {j: "".join(g) for j, g in grown.items()}
        rows[i] = "".join(mine)
    return [rows[i] for i in range(len(texts))]


def _path(score: np.ndarray, open_gap: float, extend: float) -> list[tuple[int | None, int | None]]:
    """Columns and characters paired along the best alignment with affine gap costs."""
    n, m = score.shape
    low = -1e9
    # states: 0 pair, 1 gap in the text, 2 gap in the profile; plain lists, as single array cells are slow to reach
    pair, up, side = [0.0], [low], [low]
    for j in range(1, m + 1):
        pair.append(low)
        up.append(low)
        side.append(-open_gap - extend * (j - 1))
    back = [[(0, 0, 0 if j == 1 else 2) for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = score[i - 1].tolist()
        p, u, v = [low], [-open_gap - extend * (i - 1)], [low]
        trace = [(0, 0 if i == 1 else 1, 0)]
        for j in range(1, m + 1):
            a, b, c = pair[j - 1], up[j - 1], side[j - 1]
            k0 = 0 if a >= b and a >= c else 1 if b >= c else 2
            p.append((a, b, c)[k0] + row[j - 1] - 0.3)
            a, b, c = pair[j] - open_gap, up[j] - extend, side[j] - open_gap
            k1 = 0 if a >= b and a >= c else 1 if b >= c else 2
            u.append((a, b, c)[k1])
            a, b, c = p[j - 1] - open_gap, u[j - 1] - open_gap, v[j - 1] - extend
            k2 = 0 if a >= b and a >= c else 1 if b >= c else 2
            v.append((a, b, c)[k2])
            trace.append((k0, k1, k2))
        pair, up, side = p, u, v
        back.append(trace)
    last = (pair[m], up[m], side[m])
    i, j, k, out = n, m, max(range(3), key=lambda x: last[x]), []
    while i or j:
        before = back[i][j][k]
        if k == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif k == 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
        k = before
    return out[::-1]


def mark_outside(row: str) -> str:
    """Gaps before the first and behind the last character become the code for outside."""
    inner = row.strip(GAP)
    if not inner:
        return OUTSIDE * len(row)
    before = len(row) - len(row.lstrip(GAP))
    return OUTSIDE * before + inner + OUTSIDE * (len(row) - before - len(inner))


def _decide(votes: dict[str, int], share: float, strict: bool) -> str:
    total = sum(votes.values())
    top = max(sorted(votes), key=lambda c: votes[c])
    part = votes[top] / total
    if part > share if strict else part >= share:
        return top
    options = set(votes)
    if options == {GAP, " "}:
        return GAP if votes[GAP] >= 2 else DISAGREE
    if len(options) == 2 and len({o.lower() for o in options}) == 1:
        return top.upper()
    return DISAGREE


def vote(rows: list[str], share: float = 0.65, weights: list[int] | None = None) -> tuple[str, float]:
    """One character for each column by majority, and the part of columns without disagreement.

    A row counts for as many voters as its weight says, or for one.
    """
    out, weights = [], weights or [1] * len(rows)
    for column in zip(*rows, strict=True):
        counts: dict[str, int] = {}
        for ch, n in zip(column, weights, strict=True):
            counts[ch] = counts.get(ch, 0) + n
        out.append(_decide(counts, share, False))
    return "".join(out), 1 - out.count(DISAGREE) / len(out) if out else 1.0


def vote_inside(rows: list[str], least: int = 3, weights: list[int] | None = None) -> str:
    """Like ``vote`` among those whose text covers the column; fewer than ``least`` voters give a code of their own."""
    out, weights = [], weights or [1] * len(rows)
    for column in zip(*(mark_outside(r) for r in rows), strict=True):
        counts: dict[str, int] = {}
        for ch, n in zip(column, weights, strict=True):
            if ch != OUTSIDE:
                counts[ch] = counts.get(ch, 0) + n
        out.append(FEW if sum(counts.values()) < least else _decide(counts, 0.5, True))
    return "".join(out)


def own_agreement(rows: list[str], which: int) -> float:
    """Share of columns in which all covering texts agree, between the first and last character of one of them."""
    marked = [mark_outside(r) for r in rows]
    inside = [i for i, ch in enumerate(marked[which]) if ch != OUTSIDE]
    if not inside:
        return 1.0
    same = sum(len({r[i] for r in marked} - {OUTSIDE}) == 1 for i in inside)
    return same / len(inside)


def blocks(rows: list[str], least: int = 3, weights: list[int] | None = None) -> list[tuple[int, int]]:
    """(first, last) columns of runs that at least ``least`` texts cover; a last run of one column is dropped."""
    weights = weights or [1] * len(rows)
    covered = [sum(n for ch, n in zip(col, weights, strict=True) if ch != OUTSIDE) >= least for col in zip(*(mark_outside(r) for r in rows), strict=True)]
    out, start = [], None
    for i, c in enumerate([*covered, False]):
        if c and start is None:
            start = i
        elif not c and start is not None:
            out.append((start, i - 1))
            start = None
    if out and out[-1][0] == out[-1][1]:
        out.pop()
    return out


def levenshtein(a: str, b: str) -> int:
    """Edit distance in memory of the shorter text."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def common_substring(a: str, b: str) -> str:
    """The longest run of characters in both; of equally long ones the first in ``a``."""
    best, end, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                if new[j] > best:
                    best, end = new[j], i
        row = new
    return a[end - best : end]


def common_subsequence(texts: list[str]) -> str:
    """A longest common subsequence folded over the texts in turn (exact for two, a lower bound for more)."""
    if not texts:
        return ""
    out = texts[0]
    for text in texts[1:]:
        t = np.zeros((len(out) + 1, len(text) + 1), int)
        for i, x in enumerate(out, 1):
            for j, y in enumerate(text, 1):
                t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
        i, j, kept = len(out), len(text), []
        while i and j:
            if out[i - 1] == text[j - 1]:
                kept.append(out[i - 1])
                i, j = i - 1, j - 1
            elif t[i - 1, j] >= t[i, j - 1]:
                i -= 1
            else:
                j -= 1
        out = "".join(kept[::-1])
    return out


def render(line: str, rows: list[str]) -> str:
    """Accepted text with disagreements spelled out as options and skipped parts as counts."""
    out, i = [], 0
    while i < len(line):
        j = i
        while j < len(line) and line[j] == line[i] and line[i] in (DISAGREE, FEW):
            j += 1
        if line[i] == DISAGREE:
            options = dict.fromkeys(r[i:j].replace(GAP, "").replace(OUTSIDE, "") for r in rows)
            out.append("<disagreement>" + "".join(f"<option>{o}</option>" for o in options) + "</disagreement>")
        elif line[i] == FEW:
            out.append(f"<skip>{j - i}</skip>")
        else:
            out.append("" if line[i] == GAP else line[i])
            j = i + 1
        i = j
    return "".join(out)


def connected(lines: np.ndarray, within: float = 10.0) -> list[list[int]]:
    """Components of more than one line (x1, y1, x2, y2) whose ends lie near each other's segment on average."""
    def gap(p: np.ndarray, line: np.ndarray) -> float:
        a, b = line[:2], line[2:]
        d = b - a
        t = 0.0 if not d.any() else float(np.clip((p - a) @ d / (d @ d), 0, 1))
        return float(np.hypot(*(p - a - t * d)))

    n = len(lines)
    near = [
        (i, j)
        for i in range(n)
        for j in range(i + 1, n)
        if min((gap(lines[i, :2], lines[j]) + gap(lines[i, 2:], lines[j])) / 2, (gap(lines[j, :2], lines[i]) + gap(lines[j, 2:], lines[i])) / 2) < within
    ]
    return [c for c in components(n, near) if len(c) > 1]
