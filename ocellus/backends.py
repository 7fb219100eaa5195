"""Where recognition models plug in: any Python object with ``info`` and a call from one image to rows.

A backend is told the deadline and budget of its call; what it raises becomes the frame's status, never the job's end. Its identity is
part of every cache key, so a new revision never meets old results.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from ocellus.functions import digest
from ocellus.functions import image as I


class Cancelled(RuntimeError):
    pass


class Timeout(RuntimeError):
    pass


class BudgetExceeded(RuntimeError):
    pass


#: What an exception of a backend's call is called in its frame's status.
STATUS = {Cancelled: "Cancelled", Timeout: "Timeout", BudgetExceeded: "BudgetExceeded", I.UnsupportedFormat: "UnsupportedFormat", ValueError: "InvalidArgument"}


@dataclass(frozen=True)
class BackendInfo:
    """Who made a result."""

    name: str
    version: str
    model: str = ""
    revision: str = ""
    formats: tuple[str, ...] = ("Gray8",)

    def key(self) -> tuple[int, int]:
        """Digest of the identity, for cache keys."""
        return digest.digest([self.name, self.version, self.model, self.revision])


@dataclass
class Context:
    """A call's limits. A backend calls :meth:`check` between steps."""

    seconds: float | None = None
    budget: int | None = None
    cancelled: Callable[[], bool] = field(default=lambda: False)
    began: float = field(default_factory=time.monotonic)

    def check(self, spent: int = 0) -> None:
        if self.cancelled():
            raise Cancelled("the caller has given up")
        if self.seconds is not None and time.monotonic() - self.began >= self.seconds:
            raise Timeout("the deadline has passed")
        if self.budget is not None and spent > self.budget:
            raise BudgetExceeded("the budget is used up")


class Backend(Protocol):
    info: BackendInfo

    def __call__(self, image: np.ndarray, context: Context) -> Iterable[tuple]: ...


def recognize(frames: DataFrame, backend: Backend, schema: str, seconds: float | None = None, budget: int | None = None) -> DataFrame:
    """Rows of ``schema`` that ``backend`` makes of each frame (source_id, seq, data, width, height, stride, format), with source_id, seq and
    status; a frame whose call fails has one row with its status and nulls. What a budgeted backend has yielded before its limit
    counts, followed by the status."""
    ddl = f"source_id long, seq long, status string, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(ddl))
    width = len(arrow) - 3

    def look(source: int, seq: int, data: bytes, w: int, h: int, stride: int, fmt: str) -> Iterator[tuple]:
        try:
            if fmt not in backend.info.formats:
                raise I.UnsupportedFormat(fmt)
            for row in backend(I.unpack(data, w, h, stride, fmt), Context(seconds, budget)):
                yield (source, seq, "Ok", *row)
        except Exception as e:  # a backend may fail in any way; the frame says so
            name = next((s for kind, s in STATUS.items() if isinstance(e, kind)), "BackendFailure")
            yield (source, seq, name, *[None] * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if rows := list(look(*(c[i].as_py() for c in batch.columns))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return frames.select("source_id", "seq", "data", "width", "height", "stride", "format").mapInArrow(run, ddl)


class TrackerBackend(Protocol):
    info: BackendInfo

    def initialize(self, image: np.ndarray, bounds: tuple[float, float, float, float]) -> bytes: ...

    def update(self, state: bytes, image: np.ndarray) -> tuple[bytes, tuple[float, float, float, float], float]: ...


def follow(frames: DataFrame, backend: TrackerBackend) -> DataFrame:
    """A stream of one target's frames (track_id, seq, x, y, w, h of a start or nulls, data, width, height, stride, format) as its bounds and
    confidence in each. A frame with bounds starts anew; frames before the first start, and replays, give nothing. The session is the
    stream's keyed state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else (None, -1)
        out: list[tuple[Any, ...]] = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.seq <= last:
                continue
            last = int(r.seq)
            image = I.unpack(r.data, r.width, r.height, r.stride, r.format)
            if pd.notna(r.x):
                bounds, sure = (r.x, r.y, r.w, r.h), 1.0
                held = backend.initialize(image, bounds)
            elif held is None:
                continue
            else:
                held, bounds, sure = backend.update(bytes(held), image)
            out.append((key[0], last, *map(float, bounds), float(sure)))
        state.update((held, last))
        yield pd.DataFrame(out, columns=["track_id", "seq", "x", "y", "w", "h", "confidence"])

    return frames.groupBy("track_id").applyInPandasWithState(step, "track_id long, seq long, x double, y double, w double, h double, confidence double", "held binary, last long", "append", GroupStateTimeout.NoTimeout)
