"""Rasters as square blocks, and the one exchange step all neighbourhood operators share.

A raster has two forms.  *Cells* ``(raster_id, row, col, value...)`` are for joins and aggregates.
*Blocks* ``(raster_id, brow, bcol, band...)`` hold ``side * side`` values per row as an array (NULL where
nothing is known) and are for neighbourhood work: shuffling one array per block instead of one row per
cell keeps the sort and the per-row overhead out of the plan.

``exchange`` is the only primitive: every block sends slices to the blocks that need them, one shuffle
groups the slices per target, a numpy kernel combines them.  A group holds one block and its halo, so its
size depends on ``side`` and the radius only, never on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.functions.geo import floor_long

#: divides the nominal tile sides in use (1000, 2000 cells)
BLOCK = 250
KEYS = ("raster_id", "brow", "bcol")
_KEY_SCHEMA = "raster_id string, brow bigint, bcol bigint"
_ARROW = {"double": pa.float64(), "int": pa.int32()}


def _nested(values: np.ndarray, kind: str) -> pa.Array:
    """2-D values -> list array, one list per row; NaN becomes NULL."""
    flat = values.reshape(-1)
    if kind == "double":
        inner = pa.array(flat, type=pa.float64(), mask=np.isnan(flat))
    else:
        inner = pa.array(flat.astype(np.int32), type=pa.int32())
    width = values.shape[1]
    offsets = np.arange(0, (len(values) + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def _unnest(scalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _bands_schema(bands: dict[str, str]) -> str:
    return ", ".join(f"{name} array<{kind}>" for name, kind in bands.items())


def _slotted(cells: DataFrame, values: Sequence[str], side: int) -> DataFrame:
    """Cells with the key of their block and their place in it."""
    return cells.select(
        "raster_id",
        floor_long(F.col("row") / F.lit(side)).alias("brow"),
        floor_long(F.col("col") / F.lit(side)).alias("bcol"),
        (F.pmod(F.col("row"), F.lit(side)) * side + F.pmod(F.col("col"), F.lit(side))).cast("int").alias("slot"),
        *[F.col(v).cast("double").alias(v) for v in values],
    )


def _dense(part: pa.Table, name: str, side: int) -> np.ndarray:
    """A band of the slotted cells of one block; NaN where there is none."""
    dense = np.full(side * side, np.nan)
    dense[part.column("slot").to_numpy()] = part.column(name).to_numpy()
    return dense


def cells_to_blocks(cells: DataFrame, values: Sequence[str], side: int = BLOCK) -> DataFrame:
    """Dense blocks from cells; cells must be unique per (raster_id, row, col)."""
    bands = {v: "double" for v in values}

    def scatter(key, part):
        return pa.table({k: pa.array([v.as_py()]) for k, v in zip(KEYS, key)} | {name: _nested(_dense(part, name, side)[None, :], "double") for name in values})

    return _slotted(cells, values, side).groupBy(*KEYS).applyInArrow(scatter, f"{_KEY_SCHEMA}, {_bands_schema(bands)}")


def blocks_to_cells(blocks: DataFrame, values: Sequence[str], side: int = BLOCK) -> DataFrame:
    """One row per cell with at least one known value."""
    zipped = blocks.select(*KEYS, F.posexplode(F.arrays_zip(*[F.col(v) for v in values])).alias("slot", "v"))
    return zipped.select(
        "raster_id",
        (F.col("brow") * side + F.floor(F.col("slot") / F.lit(side))).cast("bigint").alias("row"),
        (F.col("bcol") * side + F.pmod(F.col("slot"), F.lit(side))).cast("bigint").alias("col"),
        *[F.col(f"v.{v}").alias(v) for v in values],
    ).dropna(how="all", subset=list(values))


def exchange(
    blocks: DataFrame,
    bands: Sequence[str],
    send: Callable[[int, int, list[np.ndarray]], Iterable[tuple[int, int, int, np.ndarray]]],
    combine: Callable[[int, int, dict[int, np.ndarray]], dict[str, np.ndarray] | list[tuple[int, int, dict[str, np.ndarray]]] | None],
    out: dict[str, str],
    side: int = BLOCK,
    called: DataFrame | None = None,
    called_part: int = -1,
    source: str = "blocks",
) -> DataFrame:
    """One round of messages between blocks.

    ``send(brow, bcol, arrays)`` yields ``(target brow, target bcol, part, values)``; ``combine`` gets
    all parts of one target and returns the output bands, or None when the target is no block, or, when the target
    stands for several blocks, a list of (brow, bcol, output bands).
    ``part`` must be unique per target.  Every key of ``called`` (raster_id, brow, bcol; distinct) gets an
    empty message ``called_part``, once, whether or not it is a block.

    ``source`` tells what ``blocks`` are.  'blocks' may lie anywhere and reach Python in batches of Arrow, which hold as
    many of them as the session lets a batch have.  'keyed' ones come out of a join on their key, and 'cells' (as for
    ``cells_to_blocks``) are put together here: both are handed to Python block by block, without a further shuffle.
    """
    message_schema = pa.schema([
        ("raster_id", pa.string()), ("brow", pa.int64()), ("bcol", pa.int64()),
        ("part", pa.int32()), ("payload", pa.list_(pa.float64())),
    ])

    def sent(raster: str, brow: int, bcol: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
        ids, rows, cols, parts, payload = [], [], [], [], [pa.array([], pa.float64())]
        for target_row, target_col, part, values in send(brow, bcol, [a.reshape(side, side) for a in arrays]):
            ids.append(raster)
            rows.append(target_row)
            cols.append(target_col)
            parts.append(part)
            flat = np.ascontiguousarray(values, dtype=np.float64).reshape(-1)
            payload.append(pa.array(flat))
        lengths = np.cumsum([len(p) for p in payload]).astype(np.int32)
        nested = pa.ListArray.from_arrays(pa.array(lengths), pa.concat_arrays(payload))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(rows, pa.int64()), pa.array(cols, pa.int64()),
             pa.array(parts, pa.int32()), nested], schema=message_schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield sent(*(batch.column(j)[i].as_py() for j in range(3)), [_unnest(batch.column(3 + j)[i]) for j in range(len(bands))])

    def emit_one(key, table):
        arrays = [_dense(table, b, side) if source == "cells" else _unnest(table.column(b)[0]) for b in bands]
        return pa.Table.from_batches([sent(*(v.as_py() for v in key), arrays)])

    def receive(key, table):
        raster, brow, bcol = (v.as_py() for v in key)
        payload = table.column("payload")
        parts = {p: _unnest(payload[i]) for i, p in enumerate(table.column("part").to_pylist())}
        result = combine(brow, bcol, parts)
        rows = result if isinstance(result, list) else [] if result is None else [(brow, bcol, result)]
        return pa.table({
            "raster_id": pa.array([raster] * len(rows), pa.string()), "brow": pa.array([r for r, _, _ in rows], pa.int64()),
            "bcol": pa.array([c for _, c, _ in rows], pa.int64()),
            **{name: _nested(np.stack([b[name].reshape(-1) for _, _, b in rows]), kind) if rows else pa.array([], pa.list_(_ARROW[kind])) for name, kind in out.items()}})

    schema = f"{_KEY_SCHEMA}, part int, payload array<double>"
    if source == "blocks":
        messages = blocks.select(*KEYS, *bands).mapInArrow(emit, schema)
    else:
        keyed = _slotted(blocks, bands, side) if source == "cells" else blocks.select(*KEYS, *bands)
        messages = keyed.groupBy(*KEYS).applyInArrow(emit_one, schema)
    if called is not None:
        messages = messages.unionByName(called.select(*KEYS, F.lit(called_part).alias("part"), F.array().cast("array<double>").alias("payload")))
    # an explicit width: adaptive execution sizes partitions by bytes, but a kernel costs per block
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.repartition(width, *KEYS).groupBy(*KEYS).applyInArrow(receive, f"{_KEY_SCHEMA}, {_bands_schema(out)}")


def with_halo(
    blocks: DataFrame,
    bands: Sequence[str],
    kernel: Callable[..., dict[str, np.ndarray]],
    out: dict[str, str],
    halo: tuple[int, int],
    side: int = BLOCK,
    mirror: bool = False,
) -> DataFrame:
    """Apply ``kernel(padded band, ...)`` to every block grown by ``halo`` rows and columns.

    The kernel returns arrays of the unpadded size.  A halo wider than a block reaches further blocks.
    With ``mirror`` (halos along one axis only) the raster goes on beyond its outermost blocks as its mirror image.
    """
    halo_rows, halo_cols = halo
    if mirror and halo_rows and halo_cols:
        raise ValueError("a mirrored halo has one axis")
    if bool(halo_rows) != bool(halo_cols):
        return _with_line(blocks, bands, kernel, out, halo_rows or halo_cols, 0 if halo_rows else 1, side, mirror)
    reach_rows, reach_cols = -(-halo_rows // side), -(-halo_cols // side)
    wide = 2 * reach_cols + 1

    def overlap(offset: int, margin: int) -> tuple[int, int]:
        """Own index range that lies within the margin of the block ``offset`` steps further."""
        return max(0, offset * side - margin), min(side, (offset + 1) * side + margin)

    offsets = [(dr, dc) for dr in range(-reach_rows, reach_rows + 1) for dc in range(-reach_cols, reach_cols + 1)]
    centre = reach_rows * wide + reach_cols

    def send(brow, bcol, arrays):
        for dr, dc in offsets:
            r0, r1 = overlap(dr, halo_rows)
            c0, c1 = overlap(dc, halo_cols)
            if r1 > r0 and c1 > c0:
                part = (dr + reach_rows) * wide + dc + reach_cols
                yield brow + dr, bcol + dc, part, np.stack([a[r0:r1, c0:c1] for a in arrays])

    def combine(brow, bcol, parts):
        if centre not in parts:
            return None
        padded = np.full((len(bands), side + 2 * halo_rows, side + 2 * halo_cols), np.nan)
        for part, values in parts.items():
            dr, dc = part // wide - reach_rows, part % wide - reach_cols
            r0, r1 = overlap(dr, halo_rows)
            c0, c1 = overlap(dc, halo_cols)
            top, left = r0 - dr * side + halo_rows, c0 - dc * side + halo_cols
            padded[:, top:top + r1 - r0, left:left + c1 - c0] = values.reshape(len(bands), r1 - r0, c1 - c0)
        return kernel(*padded)

    return exchange(blocks, bands, send, combine, out, side)


#: bytes of the arrays that a stretch of blocks may hold
STRETCH_BYTES = 32 << 20


def stretch_length(side: int, margin: int, bands: int) -> int:
    """Blocks that share one target of an exchange along one axis: four times the reach, as long as they stay small."""
    reach = -(-margin // side)
    return max(1, min(4 * reach, STRETCH_BYTES // (8 * side * side * bands) - 2 * reach))


def stretches(at: int, side: int, margin: int, length: int) -> list[tuple[int, int, int]]:
    """The stretches of ``length`` blocks that need block ``at`` of their line: (stretch, first own index, end)."""
    reach, found = -(-margin // side), []
    for stretch in range((at - reach) // length, (at + reach) // length + 1):
        low, high = stretch * length * side - margin - at * side, (stretch + 1) * length * side + margin - at * side
        if max(low, 0) < min(high, side):
            found.append((stretch, max(low, 0), min(high, side)))
    return found


def _with_line(blocks: DataFrame, bands: Sequence[str], kernel: Callable[..., dict[str, np.ndarray]], out: dict[str, str], margin: int, axis: int, side: int, mirror: bool) -> DataFrame:
    """``with_halo`` along one axis: neighbours on a line meet in stretches of some blocks.

    Every block is sent to the stretch it belongs to and to those that it reaches into, so margins as wide as several blocks
    cost half as much again as the blocks themselves, not a copy for each block in reach.
    """
    reach, length = -(-margin // side), stretch_length(side, margin, len(bands))

    def cut(a: np.ndarray, low: int, high: int) -> np.ndarray:
        return a[low:high] if axis == 0 else a[:, low:high]

    def send(brow, bcol, arrays):
        at = (brow, bcol)[axis]
        for stretch, low, high in stretches(at, side, margin, length):
            yield (stretch, bcol, at - stretch * length + reach, np.stack([cut(a, low, high) for a in arrays])) if axis == 0 else (
                brow, stretch, at - stretch * length + reach, np.stack([cut(a, low, high) for a in arrays]))

    def combine(brow, bcol, parts):
        stretch = (brow, bcol)[axis]
        size = (length + 2 * reach) * side
        whole = np.full((len(bands), size, side) if axis == 0 else (len(bands), side, size), np.nan)
        for part, values in parts.items():
            at = stretch * length + part - reach
            low, high = next((low, high) for other, low, high in stretches(at, side, margin, length) if other == stretch)
            place = slice(part * side + low, part * side + high)
            if axis == 0:
                whole[:, place] = values.reshape(len(bands), high - low, side)
            else:
                whole[:, :, place] = values.reshape(len(bands), side, high - low)
        found = []
        for part in sorted(parts):
            if not reach <= part < reach + length:
                continue
            start = part * side - margin
            at = np.arange(start, start + side + 2 * margin)
            if mirror:
                # which blocks are the outermost shows in the messages that do not come
                before = next((k for k in range(1, reach + 1) if part - k not in parts), reach + 1)
                behind = next((k for k in range(1, reach + 1) if part + k not in parts), reach + 1)
                low, high = max((part - before + 1) * side, start), min((part + behind) * side, start + len(at))
                while ((at < low) | (at >= high)).any():
                    at = np.where(at < low, 2 * low - 1 - at, at)
                    at = np.where(at >= high, 2 * high - 1 - at, at)
            own = stretch * length + part - reach
            found.append(((own, bcol) if axis == 0 else (brow, own)) + (kernel(*np.take(whole, at, axis + 1)),))
        return found

    return exchange(blocks, bands, send, combine, out, side)


def fill_domain(blocks: DataFrame, domain: DataFrame, bands: Sequence[str], side: int = BLOCK,
                carry: Sequence[str] = ()) -> DataFrame:
    """Blocks for every key of ``domain`` (raster_id, brow, bcol); absent ones are all NULL.

    ``carry`` names bands of the domain itself to keep.
    """
    empty = F.array_repeat(F.lit(None).cast("double"), side * side)
    return domain.join(blocks, list(KEYS), "left").select(
        *KEYS, *carry, *[F.coalesce(F.col(b), empty).alias(b) for b in bands])


def at_cells(rows: DataFrame, blocks: DataFrame, band: str, side: int = BLOCK, salts: int = 8) -> DataFrame:
    """Rows with ``raster_id, row, col`` and, as a further column ``band``, what the blocks say at their cells (NULL: nothing).

    Rows and blocks meet in one sorted stream per (raster, block, salt): a block comes first and is held while its rows
    pass, so no group is collected, however many rows a block has.  The salt deals the rows of a crowded block out over
    ``salts`` tasks; the block itself is sent to each.  No row per cell is ever made.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int").alias("salt")
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own")
    keyed = rows.select(
        F.col("raster_id").cast("string").alias("raster_id"), floor_long(F.col("row") / F.lit(side)).alias("brow"), floor_long(F.col("col") / F.lit(side)).alias("bcol"), salt,
        (F.pmod(F.col("row"), F.lit(side)) * side + F.pmod(F.col("col"), F.lit(side))).cast("int").alias("slot"), own, F.lit(None).cast("array<double>").alias("held"))
    kind = keyed.schema["own"].dataType.simpleString()
    sent = blocks.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).alias("slot"), F.lit(None).cast(kind).alias("own"), F.col(band).alias("held"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, None
        for batch in batches:
            slots, brow, bcol = (batch.column(i).to_numpy() for i in (4, 1, 2))
            raster = batch.column(0)
            out = np.full(len(slots), np.nan)
            starts = [0, *np.flatnonzero(slots < 0).tolist(), len(slots)]
            for a, b in zip(starts[:-1], starts[1:]):
                if a < b and slots[a] < 0:
                    now, values = (raster[a].as_py(), brow[a], bcol[a]), _unnest(batch.column(6)[a])
                if now is not None and a < b:
                    same = pa.compute.equal(raster.slice(a, b - a), now[0]).to_numpy(zero_copy_only=False) & (brow[a:b] == now[1]) & (bcol[a:b] == now[2]) & (slots[a:b] >= 0)
                    out[a:b][same] = values[slots[a:b][same]]
            points = slots >= 0
            if points.any():
                keep = pa.array(points)
                yield pa.RecordBatch.from_arrays([batch.column(5).filter(keep), pa.array(out[points], mask=np.isnan(out[points]))], ["own", "found"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEYS, "salt", "slot"]
    stream = keyed.unionByName(sent).repartition(width, *KEYS, "salt").sortWithinPartitions(*order)
    found = stream.mapInArrow(meet, f"own {kind}, found double")
    return found.select("own.*", F.col("found").alias(band))
