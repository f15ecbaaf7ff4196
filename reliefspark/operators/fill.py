"""Bounded hole fill on blocks.

Definition: a cell without value takes the inverse-distance mean of the nearest known cell to the left,
right, top and bottom, each at most ``reach`` cells away; nothing in reach leaves it unknown.  Known
cells never change.

Blocks exchange only their outermost known value per row and column, two numbers per line, so a reach
of many cells does not move whole blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from reliefspark.operators.blocks import BLOCK, exchange


def _last_known(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: position and value of the last known cell (position -1 when there is none)."""
    known = ~np.isnan(z)
    width = z.shape[1]
    position = np.where(known.any(axis=1), width - 1 - np.argmax(known[:, ::-1], axis=1), -1)
    return position.astype(float), z[np.arange(len(z)), position]


def _before(z: np.ndarray, position: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest known cell strictly before every cell of a row; a starting point may lie outside."""
    side = z.shape[1]
    last = np.where(np.isnan(z), -1, np.arange(side))
    last = np.maximum.accumulate(last, axis=1)
    last = np.hstack([np.full((len(z), 1), -1), last[:, :-1]])
    inside = last >= 0
    found = np.where(inside, last, position[:, None])
    values = np.where(inside, np.take_along_axis(z, np.maximum(last, 0), axis=1), value[:, None])
    return np.arange(side)[None, :] - found, values


def fill_holes(blocks: DataFrame, band: str | dict[str, int], reach: int | None = None, side: int = BLOCK, keep: Sequence[str] = (),
               domain: DataFrame | None = None, per_tile: int | None = None, source: str = "blocks") -> DataFrame:
    """``band`` filled for every block given; bands in ``keep`` stay as they are.

    A dict of bands and reaches fills several bands in one exchange.
    ``domain`` (distinct raster_id, brow, bcol) names further blocks to fill, so that tiles come out complete
    even where whole blocks hold no data; each of them costs one empty message.  ``per_tile`` does the same without
    a table of blocks: every block calls up the others of its tile of ``per_tile`` x ``per_tile`` blocks.
    ``source`` tells what ``blocks`` are, see ``exchange``.
    """
    reaches = band if isinstance(band, dict) else {band: reach}
    names, count = list(reaches), len(reaches)
    steps = {n: -(-r // side) for n, r in reaches.items()}
    most = max(steps.values())
    # the four views turn every direction into "look back along the row"
    views = (lambda a: a, lambda a: a[:, ::-1], lambda a: a.T, lambda a: a.T[:, ::-1])
    moves = ((0, 1), (0, -1), (1, 0), (-1, 0))

    present = 1 + 4 * most * count

    def part_of(way: int, step: int, k: int) -> int:
        return 1 + (way * most + step - 1) * count + k

    def send(brow, bcol, arrays):
        yield brow, bcol, 0, np.stack(arrays)
        if per_tile:
            top, left = brow // per_tile * per_tile, bcol // per_tile * per_tile
            for r in range(top, top + per_tile):
                for c in range(left, left + per_tile):
                    if (r, c) != (brow, bcol):
                        yield r, c, present, np.empty(0)
        for k, name in enumerate(names):
            for way, (dr, dc) in enumerate(moves):
                position, value = _last_known(views[way](arrays[k]))
                if (position >= 0).any():
                    for step in range(1, steps[name] + 1):
                        yield brow + dr * step, bcol + dc * step, part_of(way, step, k), np.stack([position, value])

    def filled(z: np.ndarray, parts: dict, k: int) -> np.ndarray:
        reach = reaches[names[k]]
        weighted, weights = [], []
        for way, view in enumerate(views):
            position, value = np.full(side, -np.inf), np.full(side, np.nan)
            for step in range(steps[names[k]], 0, -1):
                part = parts.get(part_of(way, step, k))
                if part is not None:
                    at, found = part.reshape(2, side)
                    use = at >= 0
                    position = np.where(use, at - step * side, position)
                    value = np.where(use, found, value)
            distance, nearest = _before(view(z), position, value)
            near = distance <= reach
            weight = np.where(near, 1.0 / np.where(near, distance, 1.0), 0.0)
            term = np.where(near, np.where(near, nearest, 0.0) / np.where(near, distance, 1.0), 0.0)
            # views are their own inverse up to the order of flip and transpose
            undo = (lambda a: a, lambda a: a[:, ::-1], lambda a: a.T, lambda a: a[:, ::-1].T)[way]
            weights.append(undo(weight))
            weighted.append(undo(term))
        total = ((weights[0] + weights[1]) + weights[2]) + weights[3]
        value_sum = ((weighted[0] + weighted[1]) + weighted[2]) + weighted[3]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(total > 0, value_sum / total, np.nan)
        return np.where(np.isnan(z), mean, z)

    def combine(brow, bcol, parts):
        if 0 not in parts and present not in parts:
            return None
        own = parts.get(0, np.full((count + len(keep)) * side * side, np.nan)).reshape(-1, side, side)
        return {n: filled(own[k], parts, k) for k, n in enumerate(names)} | dict(zip(keep, own[count:]))

    bands = [*names, *keep]
    return exchange(blocks, bands, send, combine, {b: "double" for b in bands}, side, domain, present, source)
