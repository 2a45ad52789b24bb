"""Bitmaps of 64-bit digests: small enough to go to every task, and never wrong about a digest that is in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and the largest bitmap (8 KB and 32 MB), as powers of two, and of a region that one group packs.
LEAST, MOST, REGION = 16, 28, 16


def bits_for(many: int) -> int:
    """About 16 places for each digest, up to the largest; a fuller bitmap only lets more strangers through."""
    return min(MOST, max(LEAST, (16 * many).bit_length()))


def _pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    on = np.zeros(1 << REGION, dtype=np.uint8)
    for b in batches:
        on[np.asarray(b.column("place")) & ((1 << REGION) - 1)] = 1
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(on, bitorder="little").tobytes()])],
                                     ["region", "bytes"])


def build(rows: DataFrame, digest: Column, bits: int) -> np.ndarray:
    """Bytes of the bitmap of ``digest`` (a long) over all rows: at most 2**(MOST - 3) bytes, whatever the rows."""
    place = rows.select(digest.bitwiseAND((1 << bits) - 1).alias("place"))
    got = place.groupBy(F.shiftright("place", REGION).alias("region")).applyInArrow(_pack, "region long, bytes binary").collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    step = 1 << (REGION - 3)
    for r in got:
        out[r["region"] * step: (r["region"] + 1) * step] = np.frombuffer(r["bytes"], dtype=np.uint8)
    return out


def has(bitmap: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which digests (uint64) may be in the bitmap; those that are, are."""
    place = (digest & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
