"""Upload states as a stream: changes told in the order of their times, uploads promoted where room appears.

Both keep keyed state with event-time timers: a row waits until the watermark has passed its time,
so rows that come late or out of order within the delay give the result of the batch form, and
rows that come again change nothing that a repeated row would not change there. Rows without a key
only move the clock. Keys are dealt to a fixed number of states.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.registry import TERMINAL, UPLOAD_STATES

GROUPS = 4096
Fold = Callable[[dict, list], Iterator[tuple]]
CHANGES = "upload_id {}, changed_at timestamp, previous string, status string, allowed boolean"
PROMOTIONS = "subject {}, upload_id long, dataset_id long, promoted_at timestamp"


def told_in_order(
    rows: DataFrame, key: str, at: str, fields: list[str], fold: Fold, schema: str, late: str, groups: int = GROUPS
) -> DataFrame:
    """Rows of ``fold(memory, [time in microseconds, *fields])``, called per key in the order of its arguments.

    ``memory`` is a dict of plain values that the key keeps, and the rows it yields go out with the
    key before them; times among them are microseconds. Nulls sort first. What waits is a key's
    rows within ``late``. Rows without a time, or none after the start of 1970, are dropped, as the
    watermark starts there.

    Keys share a state by their hash, one of ``groups``: a call of Python for each of many small keys would
    take far longer than their rows. A group's state is read and written whole when one of its keys has
    news, so a stream of very many keys wants more of them.
    """
    names = [field.split()[0] for field in schema.split(", ")]
    times = [field.split()[0] for field in schema.split(", ") if field.endswith("timestamp")]
    kind = rows.schema[key].dataType

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, held = json.loads(state.get[0]) if state.exists else ({}, [])
        for frame in frames:
            held += map(list, zip(*(_plain(frame[c]) for c in ("__at", *fields, "__key"))))
        now = state.getCurrentWatermarkMs()
        # A row of the watermark's own millisecond could still be followed by another one.
        ready = [row for row in held if row[0] // 1000 < now]
        held = [row for row in held if row[0] // 1000 >= now]
        out = [(k, *row) for *ordered, k in sorted(ready, key=_nulls_first) for row in fold(memory.setdefault(k, {}), ordered)]
        state.update((json.dumps([memory, held]),))
        if held:
            state.setTimeoutTimestamp(min(row[0] for row in held) // 1000 + 1)
        if out:
            told = pd.DataFrame(out, columns=names)
            yield told.assign(**{c: pd.to_datetime(told[c], unit="us") for c in times})

    timed = rows.where(F.col(at).isNotNull()).withColumn("__at", F.unix_micros(at)).withWatermark(at, late)
    # The condition names the event time too, else it would be pushed below the watermark and stop the clock.
    keyed = timed.where(F.when(F.col(at).isNotNull(), F.col(key)).isNotNull())
    dealt = keyed.withColumns({"__key": F.col(key).cast("string"), "__group": F.pmod(F.xxhash64(key), F.lit(groups))})
    shaped = f"{names[0]} string, {schema.split(', ', 1)[1]}"
    told = dealt.groupBy("__group").applyInPandasWithState(run, shaped, "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn(names[0], F.col(names[0]).cast(kind))


def _plain(column: pd.Series) -> list:
    """Strings, whole numbers and None."""
    values = column.tolist()
    if column.dtype.kind == "i":
        return values
    return [None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in values]


def _nulls_first(row: list) -> list:
    return [(v is not None, v if v is not None else 0) for v in row]


def _change(memory: dict, row: list) -> Iterator[tuple]:
    at, status = row
    previous = memory.get("status")
    memory["status"] = status
    if status != previous:
        place = {name: n for n, name in enumerate(UPLOAD_STATES, 1)}
        onwards = status is not None and place.get(status, 0) > place.get(previous, 0)
        yield at, previous, status, onwards and previous not in TERMINAL


def status_changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``registry.upload_transitions`` of a stream (upload_id, changed_at timestamp, status).

    State: an upload's last status and what waits for the watermark.
    """
    kind = events.schema["upload_id"].dataType.simpleString()
    return told_in_order(events, "upload_id", "changed_at", ["status"], _change, CHANGES.format(kind), late)


def _arrival(memory: dict, row: list) -> Iterator[tuple]:
    at, upload, dataset = row
    waiting, open_ = memory.setdefault("uploads", []), memory.setdefault("datasets", [])
    if upload is not None:
        waiting.append(upload)
    if dataset is not None:
        open_.append(dataset)
    if waiting and open_:
        yield waiting.pop(0), open_.pop(0), at


def promotions(arrivals: DataFrame, late: str = "1 hour") -> DataFrame:
    """The oldest waiting upload of a user takes each dataset as it comes, or as the upload comes.

    ``arrivals`` is a stream (subject, at timestamp, upload_id long, dataset_id long), one of the ids
    null. The result tells which upload got which dataset, and when. State: the user's uploads
    without a dataset or datasets without an upload, whichever there are.
    """
    kind = arrivals.schema["subject"].dataType.simpleString()
    return told_in_order(arrivals, "subject", "at", ["upload_id", "dataset_id"], _arrival, PROMOTIONS.format(kind), late)
