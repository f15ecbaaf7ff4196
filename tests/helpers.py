import numpy as np
import pandas as pd

from reliefspark.operators.blocks import blocks_to_cells, cells_to_blocks


def to_blocks(spark, array, side=16, band="z", raster="r"):
    """Blocks of a 2-D array (NaN = unknown)."""
    rows, cols = np.indices(array.shape)
    frame = pd.DataFrame({"raster_id": raster, "row": rows.ravel().astype("int64"), "col": cols.ravel().astype("int64"), band: array.ravel().astype(float)})
    return cells_to_blocks(spark.createDataFrame(frame), [band], side)


def to_array(blocks, band, shape, side=16):
    out = np.full(shape, np.nan)
    for row, col, value in blocks_to_cells(blocks, [band], side).select("row", "col", band).collect():
        if row < shape[0] and col < shape[1] and value is not None:
            out[row, col] = value
    return out
