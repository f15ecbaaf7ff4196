"""Halos along one axis go to stretches of blocks."""

import numpy as np
import pytest

from reliefspark.operators import blocks as B

SCHEMA = "raster_id string, brow long, bcol long, z array<double>"


@pytest.mark.parametrize("side,margin", [(50, 200), (50, 54), (50, 10), (250, 300), (4, 9)])
def test_wide_margins_cost_half_the_blocks_again(side, margin):
    length = B.stretch_length(side, margin, 1)
    sent = sum(high - low for at in range(-300, 300) for _, low, high in B.stretches(at, side, margin, length))
    assert sent <= 1.51 * 600 * side  # each block to each block in reach: 1 + 2 * margin / side times


@pytest.mark.parametrize("axis", [0, 1])
@pytest.mark.parametrize("mirror", [False, True])
@pytest.mark.parametrize("margin", [2, 4, 9, 13])
def test_every_block_sees_its_neighbours(spark, axis, mirror, margin, monkeypatch):
    """Lines with gaps, below zero, and longer than a stretch; the mirror image begins at the gap."""
    side, rng = 4, np.random.default_rng(margin)
    places = [(line, at) for line in (-1, 0) for at in range(-30, 30) if at not in (-13, 5, 6, 20)]
    tiles = {p: rng.normal(size=(side, side)) for p in places}
    key = (lambda line, at: (at, line)) if axis == 0 else (lambda line, at: (line, at))
    frame = spark.createDataFrame([("a", *key(*p), v.reshape(-1).tolist()) for p, v in tiles.items()], SCHEMA).repartition(3)

    def kernel(z):
        z = z if axis == 0 else z.T
        total = sum((i + 1.0) * np.nan_to_num(z[i:i + side]) for i in range(2 * margin + 1))
        return {"sum": total if axis == 0 else total.T}

    got = {(r.brow, r.bcol): np.array(r.sum).reshape(side, side) for r in B.with_halo(
        frame, ["z"], kernel, {"sum": "double"}, (margin, 0) if axis == 0 else (0, margin), side, mirror=mirror).collect()}
    assert len(got) == len(places)
    reach = -(-margin // side)
    for line, at in places:
        run = [at]
        while run[0] > at - reach and (line, run[0] - 1) in tiles:
            run.insert(0, run[0] - 1)
        while run[-1] < at + reach and (line, run[-1] + 1) in tiles:
            run.append(run[-1] + 1)
        ordered = [tiles[line, k] if axis == 0 else tiles[line, k].T for k in run]
        if mirror:
            strip = np.concatenate(ordered)
            first = (at - run[0]) * side - margin
            # an end beyond the reach is no border: it is not mirrored there
            pad = np.pad(strip, ((200, 200), (0, 0)), "symmetric")
            window = pad[first + 200:first + 200 + side + 2 * margin]
        else:
            window = np.zeros((side + 2 * margin, side))
            for k in range(at - reach, at + reach + 1):
                if (line, k) in tiles:
                    rows = tiles[line, k] if axis == 0 else tiles[line, k].T
                    for i in range(side):
                        to = (k - at) * side + i + margin
                        if 0 <= to < len(window):
                            window[to] = rows[i]
        want = sum((i + 1.0) * window[i:i + side] for i in range(2 * margin + 1))
        assert got[key(line, at)] == pytest.approx(want if axis == 0 else want.T), (line, at)
