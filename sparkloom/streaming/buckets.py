"""State of many keys at once: keys are dealt into buckets, and a bucket's state is two Arrow tables."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Buckets that keys are dealt into, at least. A task holds one bucket at a time; a stream keeps its number from its first
#: batch on, so one that expects much takes more, of ROWS rows each.
BUCKETS, ROWS = 256, 20_000
STATE = "keys binary, waiting binary"


def number(rows: int) -> int:
    """Buckets for a stream that may hold so many rows: one of them doesn't grow with the stream."""
    return max(BUCKETS, int(rows // ROWS))


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def load(state: GroupState, keys: pa.Schema, waiting: pa.Schema) -> tuple[dict, pa.Table]:
    """A bucket's keys, each with the tuple of its other columns, and the rows that wait."""
    if not state.exists:
        return {}, waiting.empty_table()
    known, held = (pa.ipc.open_stream(x).read_all() for x in state.get)
    key, *rest = values(known.cast(keys))
    return dict(zip(key, zip(*rest))), held.cast(waiting)


def save(state: GroupState, known: dict, keys: pa.Schema, held: pa.Table) -> None:
    """Writes a bucket's state, or takes it away where nothing is left."""
    if not known and not held.num_rows:
        state.remove()
        return
    columns = zip(*((k, *v) for k, v in known.items())) if known else ((),) * len(keys)
    state.update(tuple(map(_packed, (pa.table([pa.array(c, f.type) for c, f in zip(columns, keys)], schema=keys), held))))


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def values(rows: pa.Table) -> list[list]:
    """The columns as lists; numbers and flags hold no nulls."""
    return [c.to_numpy().tolist() for c in rows.columns]


def joined(held: pa.Table, parts: Iterable[pd.DataFrame]) -> pa.Table:
    """The rows that wait, then those that come, in the columns of the first."""
    return pa.concat_tables([held, *(pa.Table.from_pandas(p[held.column_names], held.schema, preserve_index=False) for p in parts if len(p))])
