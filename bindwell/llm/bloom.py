"""A Bloom filter of bounded size, filled by tasks and broadcast to them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bindwell.llm.text import U64, mix

#: Bits of a segment, the unit in which partial filters are shuffled and merged.
SEGMENT = 1 << 16


def _places(keys: np.ndarray, n_bits: int, n_hashes: int) -> np.ndarray:
    first, second = mix(keys), mix(keys ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return np.stack([(first + U64(k) * second) % U64(n_bits) for k in range(n_hashes)]).astype(np.int64)


class Bloom:
    """Keys are 64-bit hashes. Never says no to a key it holds; the fuller, the more others it lets through."""

    def __init__(self, spark, bits: np.ndarray, n_hashes: int):
        self.shared, self.n_bits, self.n_hashes = spark.sparkContext.broadcast(bits), len(bits) * 8, n_hashes

    @classmethod
    def of(cls, keys: DataFrame, bits_per_key: int = 16, max_bits: int = 1 << 28, n_hashes: int = 4) -> Bloom:
        """A filter of the long column ``key``; at most ``max_bits`` (32 MB) are collected and broadcast."""
        wanted = max(1, keys.count()) * bits_per_key
        n_bits = min(-(-wanted // SEGMENT) * SEGMENT, max(SEGMENT, max_bits // SEGMENT * SEGMENT))

        def sketch(frames):
            for frame in frames:
                hit = np.unique(_places(frame["key"].to_numpy(np.int64).view(U64), n_bits, n_hashes))
                names, first = np.unique(hit >> 16, return_index=True)
                parts = np.split((hit & (SEGMENT - 1)).astype(np.uint16), first[1:])
                yield pd.DataFrame({"segment": names, "hit": [p.tobytes() for p in parts[: len(names)]]})

        def merge(frames):
            held: dict[int, np.ndarray] = {}
            for frame in frames:
                for segment, hit in frame.itertuples(index=False):
                    held.setdefault(segment, np.zeros(SEGMENT, bool))[np.frombuffer(hit, np.uint16)] = True
            for segment, flags in held.items():
                yield pd.DataFrame({"segment": [segment], "bits": [zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)]})

        merged = keys.mapInPandas(sketch, "segment long, hit binary").repartition("segment").mapInPandas(merge, "segment long, bits binary")
        bits = np.zeros(n_bits // 8, np.uint8)
        for row in merged.toLocalIterator():
            part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
            bits[row["segment"] * len(part) : (row["segment"] + 1) * len(part)] = part
        return cls(keys.sparkSession, bits, n_hashes)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of ``keys`` the filter may hold."""
        places, bits = _places(keys, self.n_bits, self.n_hashes), self.shared.value
        return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)

    def destroy(self) -> None:
        self.shared.destroy()
