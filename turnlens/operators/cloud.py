"""Word clouds: phrases in sizes by weight, placed along a spiral over a grid of what is occupied.

The heaviest phrase lies in the middle. Each further one takes the first place along a widening spiral where its box meets no
occupied cell. The plane has no edge, so no phrase is left out; the picture is as large as what it holds.

Defined cases: weights below 0 and null weights count as 0; without a weight above 0 all phrases have the least size; equal
weights go in the order of their phrases; no phrases give an empty picture.
"""

from __future__ import annotations

import html
import math
from typing import NamedTuple

import numpy as np

#: Sizes of letters, their width and a line's height in shares of the size, the side of a cell, and the spiral's steps.
LEAST, MOST, WIDE, HIGH, CELL, TURN, GROWTH = 11.0, 40.0, 0.62, 1.2, 3, 0.35, 0.8
#: Steps of the spiral that are tried at once.
STEPS = 256
#: The spiral's points, so far as this process has needed them, and the angle of the next one.
_spiral: list[np.ndarray] = []
_angle = 0.0


class Box(NamedTuple):
    """A placed phrase: its corner, its extent, and the size of its letters."""

    phrase: str
    x: float
    y: float
    width: float
    height: float
    size: float


def _points(block: int) -> np.ndarray:
    """x and y of one block of the spiral's steps."""
    global _angle
    while len(_spiral) <= block:
        found = np.empty((2, STEPS))
        for i in range(STEPS):
            found[:, i] = 1.6 * GROWTH * _angle * math.cos(_angle), GROWTH * _angle * math.sin(_angle)
            _angle += TURN
        _spiral.append(found)
    return _spiral[block]


def layout(phrases: list[tuple[str, float]]) -> list[Box]:
    """The boxes of the phrases, the heaviest first. No two overlap."""
    weigh = lambda w: max(0.0, w or 0.0)
    top = max((weigh(w) for _, w in phrases), default=0.0)
    order = sorted(phrases, key=lambda p: (-weigh(p[1]), p[0]))
    taken = np.empty((4, len(order), 1), np.int64)  # first and last column and row of each box's cells
    out = []
    for n, (phrase, weight) in enumerate(order):
        size = LEAST + (MOST - LEAST) * math.sqrt(weigh(weight) / top) if top else LEAST
        width, height, block = WIDE * size * max(1, len(phrase)), HIGH * size, 0
        while True:
            xs, ys = _points(block) - np.array([[width / 2], [height / 2]])
            left, right, upper, lower = (np.floor(v / CELL).astype(np.int64) for v in (xs, xs + width, ys, ys + height))
            free = ~((left <= taken[1, :n]) & (right >= taken[0, :n]) & (upper <= taken[3, :n]) & (lower >= taken[2, :n])).any(axis=0)
            if free.any():
                break
            block += 1
        k = int(free.argmax())
        taken[:, n, 0] = left[k], right[k], upper[k], lower[k]
        out.append(Box(phrase, float(xs[k]), float(ys[k]), width, height, size))
    return out


def svg(phrases: list[tuple[str, float]], colour: str = "black") -> str:
    """The cloud as inline SVG."""
    boxes = layout(phrases)
    if not boxes:
        return '<svg class="cloud" viewBox="0 0 0 0"></svg>'
    left, top = min(b.x for b in boxes), min(b.y for b in boxes)
    right, bottom = max(b.x + b.width for b in boxes), max(b.y + b.height for b in boxes)
    words = "".join(f'<text x="{b.x:.1f}" y="{b.y + b.size:.1f}" font-size="{b.size:.1f}" textLength="{b.width:.1f}">{html.escape(b.phrase)}</text>' for b in boxes)
    return f'<svg class="cloud" fill="{colour}" font-family="monospace" width="{right - left:.0f}" height="{bottom - top:.0f}" viewBox="{left:.1f} {top:.1f} {right - left:.1f} {bottom - top:.1f}">{words}</svg>'
