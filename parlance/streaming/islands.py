"""Adjacent segments of one speaker merged as they arrive, with a state of their own for each recording."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ROW = "start_s double, end_s double, speaker string, seg_id long"
_STATE = f"waiting array<struct<{', '.join(c.replace(' ', ':', 1) for c in _ROW.split(', '))}>>, speaker string, first_id long, start_s double, end_s double, n long"


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[3]


def merged_islands(stream: DataFrame, key: str = "audio_id", time: str = "event_time", max_gap: float = 0.5, late: str = "1 hour") -> DataFrame:
    """``key, speaker, seg_id, start_s, end_s, n_merged`` of each island, as ``intervals.merge_adjacent`` has them, once it is closed.

    ``stream`` has ``key, seg_id, speaker, start_s, end_s`` and ``time``: the time of the start, as a timestamp. Rows may come in any
    order, up to ``late``; later ones are left out. A recording's state is its open island and the rows that start
    after the watermark, whose order isn't settled yet. An island closes at a change of speaker, a missing speaker, a longer
    gap, or when the watermark is past all that could still join it. Rows without a time, start or end are left out.
    """
    named = stream.select(F.col(key).cast("string").alias("k"), F.col(time).alias("t"), F.col("start_s").cast("double"), F.col("end_s").cast("double"), "speaker", F.col("seg_id").cast("long"))
    kept = named.filter("t IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)").withWatermark("t", late)

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, speaker, first, start, end, n = state.get if state.exists else ([], None, None, None, None, 0)
        waiting = [tuple(w) for w in waiting or []]
        for pdf in batches:
            waiting += [(float(a), float(b), s if isinstance(s, str) else None, int(i)) for a, b, s, i in zip(pdf["start_s"], pdf["end_s"], pdf["speaker"], pdf["seg_id"])]
        settled = state.getCurrentWatermarkMs() / 1000
        waiting.sort(key=_order)
        out: list[tuple] = []

        def close() -> None:
            nonlocal n
            if n:
                out.append((k[0], speaker, first, start, end, n))
            n = 0

        at = 0
        while at < len(waiting) and waiting[at][0] < settled:
            a, b, s, i = waiting[at]
            if n and s is not None and s == speaker and a - end <= max_gap:
                end, n = max(end, b), n + 1
            else:
                close()
                speaker, first, start, end, n = s, i, a, b, 1
            at += 1
        waiting = waiting[at:]
        if n and not waiting and settled > end + max_gap:  # nothing that may still come can join
            close()
        if n or waiting:
            state.update((waiting, speaker, first, start, end, n))
            ahead = waiting[0][0] if waiting else end + max_gap
            state.setTimeoutTimestamp(max(int(ahead * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "speaker", "seg_id", "start_s", "end_s", "n_merged"], dtype=object)

    schema = "key string, speaker string, seg_id long, start_s double, end_s double, n_merged long"
    out = kept.groupBy("k").applyInPandasWithState(work, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)
