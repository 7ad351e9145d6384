"""Geometry of charts, for the few rows that a chart shows.

Everything here takes and gives plain lists; collect only what is drawn.
"""

from __future__ import annotations

from typing import NamedTuple


class Box(NamedTuple):
    x: float
    y: float
    width: float
    height: float


def treemap(sizes: list[float], width: float = 1.0, height: float = 1.0) -> list[Box]:
    """A rectangle for each size, in order, that together fill the area and are as square as rows allow.

    Sizes must be positive and fall. Rows are laid along the shorter side; a size joins the
    row while that makes the row's worst rectangle squarer.
    """
    scale = width * height / sum(sizes) if sizes else 0.0
    areas, free, out, at = [s * scale for s in sizes], Box(0.0, 0.0, width, height), [], 0
    while at < len(areas):
        side = min(free.width, free.height)
        end = at + 1
        while end < len(areas) and _worst(areas[at : end + 1], side) <= _worst(areas[at:end], side):
            end += 1
        row, total, along = areas[at:end], sum(areas[at:end]), 0.0
        depth = total / side
        upright = free.width >= free.height
        for area in row:
            long = area / depth
            out.append(Box(free.x, free.y + along, depth, long) if upright else Box(free.x + along, free.y, long, depth))
            along += long
        free = Box(free.x + depth, free.y, free.width - depth, free.height) if upright else Box(free.x, free.y + depth, free.width, free.height - depth)
        at = end
    return out


def _worst(row: list[float], side: float) -> float:
    """Largest ratio of sides in a row laid along ``side``."""
    depth = sum(row) / side
    return max(max(depth * depth / a, a / (depth * depth)) for a in row)


def spread_labels(places: list[float], least: float, low: float, high: float) -> list[float]:
    """Places of labels on a line, in the order given, at least ``least`` apart and as near to their own as that allows.

    Labels that don't fit between the ends are set evenly.
    """
    order = sorted(range(len(places)), key=lambda k: places[k])
    if len(order) > 1 and least * (len(order) - 1) >= high - low:
        step = (high - low) / (len(order) - 1)
        put = [low + step * k for k in range(len(order))]
    else:
        put = []
        for k in order:
            put.append(max(places[k], put[-1] + least) if put else max(places[k], low))
        for j in range(len(put) - 1, -1, -1):
            put[j] = min(put[j], high if j == len(put) - 1 else put[j + 1] - least)
    out = [0.0] * len(places)
    for j, k in enumerate(order):
        out[k] = put[j]
    return out


def round_axis(low: float, high: float, marks: int = 5) -> list[float]:
    """Round values that cover a range: steps of 1, 2 or 5 times a power of ten."""
    if high <= low:
        return [low]
    raw, power = (high - low) / marks, 1.0
    while power * 10 <= raw:
        power *= 10
    while power > raw:
        power /= 10
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw - 1e-12)
    first = int(low // step)
    out = [round(first * step, 10)]
    while out[-1] < high - 1e-9:
        first += 1
        out.append(round(first * step, 10))
    return out
