"""Keys of cached results: typed fields in a fixed order, strings with their length, hashed twice into 128 bits."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ocellus.functions.image import fnv1a, signed


def encode(values: list) -> bytes:
    """Little-endian fields: 8 bytes a number, a byte a flag, length and bytes a string; a null is a mark of its own."""
    out = []
    for v in values:
        if v is None:
            out.append(b"\xff")
        elif isinstance(v, bool):
            out.append(struct.pack("<?", v))
        elif isinstance(v, int):
            out.append(struct.pack("<q", v))
        elif isinstance(v, float):
            out.append(struct.pack("<d", v + 0.0))  # one zero
        else:
            raw = v if isinstance(v, bytes) else str(v).encode()
            out.append(struct.pack("<q", len(raw)) + raw)
    return b"".join(out)


def digest(values: list) -> tuple[int, int]:
    """Two 64-bit halves, from two domains."""
    raw = encode(values)
    return signed(fnv1a(b"\x01" + raw)), signed(fnv1a(b"\x02" + raw))


def with_digest(df: DataFrame, fields: list[str], hi: str = "key_hi", lo: str = "key_lo") -> DataFrame:
    """``df`` with the digest of ``fields``, in this order; only distinct keys need Python if ``df`` holds distinct keys."""
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(keep.index(f)).to_pylist() for f in fields), strict=True)
            keys = [digest(list(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], [*keep, hi, lo])

    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{ddl}, {hi} long, {lo} long")
