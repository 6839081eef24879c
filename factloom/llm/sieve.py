"""A bitmap of hashes that tells in a scan what a join would drop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sieve:
    """A bitmap of 64-bit hashes by their first bits: what fails it is not among them. At most 16 MB, whatever the batch."""

    def __init__(self, hashes: DataFrame, column: str):
        n = hashes.count()
        self.bits = min(27, max(16, int(16 * n).bit_length()))
        at = F.shiftrightunsigned(F.col(column), 64 - self.bits)
        maps = hashes.select((at / 32768).cast("long").alias("b"), (at % 32768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
        data = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in maps.toLocalIterator():
            data[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.m, np.uint8)[: len(data)]
        self.shared = hashes.sparkSession.sparkContext.broadcast(data.tobytes())

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def hit(self, h: int) -> bool:
        at = h >> (64 - self.bits)
        return bool(self.shared.value[at >> 3] >> (at & 7) & 1)

    def sifted(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose ``column`` passes."""

        def each(batches):
            for b in batches:
                yield b.filter(pa.array(self.hits(b.column(column).to_numpy())))

        return rows.mapInArrow(each, rows.schema)
