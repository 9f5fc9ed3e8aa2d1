"""Chunked decoding with carried state, and event-time windows, as structured streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "utt_id string, start int, stop int, token int, final boolean"
STATE = "open string"
#: Utterances are spread over so many groups, each with one state for those of them that are not finished.
GROUPS = 1024
#: A frame of an utterance: the utterance's number in its group times so much, plus the frame.
PLACES = 1 << 32
NONE = np.zeros(0, np.int64)


def join_frames(spans: tuple, runs: tuple, frames: tuple) -> tuple[tuple, tuple, tuple]:
    """The spans and open runs after more frames, and the runs that these close.

    ``spans`` (start, stop, end) are the stretches of known frames of all utterances, in order and not touching each other; ``end``
    says that the last frame of the utterance is in it. ``runs`` (start, stop, token) are those of their runs that may go on: at the
    start of a span unless the utterance begins there, and at its stop unless the utterance ends there. ``frames`` (frame, token, end)
    come in any order; those known already are dropped, and so are those behind an end. Closed runs are (start, stop, token, final).
    """
    n = len(spans[0])
    lo, hi, end = (np.concatenate(x) for x in zip(spans, (frames[0], frames[0] + 1, frames[2]), strict=True))
    at = np.lexsort((-hi, lo))
    at = at[hi[at] > np.concatenate(([-1], np.maximum.accumulate(hi[at])[:-1]))]
    ended = np.concatenate(([-1], np.maximum.accumulate(np.where(end[at], hi[at], -1))[:-1]))
    at = at[ended // PLACES != lo[at] // PLACES]
    new = at[at >= n] - n
    lo, hi, end = lo[at], hi[at], end[at]
    first = np.flatnonzero(np.concatenate(([True], lo[1:] != hi[:-1])))
    last = np.append(first[1:], len(lo)) - 1
    lo, hi, end = lo[first], hi[last], end[last]

    a, b, t = (np.concatenate(x) for x in zip(runs, (frames[0][new], frames[0][new] + 1, frames[1][new]), strict=True))
    at = np.argsort(a, kind="stable")
    span = np.searchsorted(lo, a[at], "right") - 1
    at = at[b[at] <= hi[span]]  # the rest is behind an end
    a, b, t = a[at], b[at], t[at]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != b[:-1]) | (t[1:] != t[:-1]))))
    last = np.append(first[1:], len(a)) - 1
    a, b, t = a[first], b[last], t[first]
    span = np.searchsorted(lo, a, "right") - 1
    other = span[1:] != span[:-1]
    begins, ends = lo % PLACES == 0, end
    closed = (np.append(False, ~other) | begins[span]) & (np.append(~other, False) | ends[span])
    final = ends[span] & (b == hi[span])
    rest = ~(begins & ends)
    return (lo[rest], hi[rest], end[rest]), (a[~closed], b[~closed], t[~closed]), (a[closed], b[closed], t[closed], final[closed])


def _read(state: GroupState) -> tuple[list, tuple, tuple]:
    if not state.exists:
        return [], (NONE, NONE, NONE.astype(bool)), (NONE, NONE, NONE)
    names, (lo, hi, end), runs = json.loads(state.get[0])
    return names, (np.array(lo, np.int64), np.array(hi, np.int64), np.array(end, bool)), tuple(np.array(x, np.int64) for x in runs)


def _write(state: GroupState, names: list, spans: tuple, runs: tuple) -> None:
    """Only the utterances that have spans, numbered anew."""
    used = np.unique(spans[0] // PLACES)
    if len(used):
        place = lambda x: (np.searchsorted(used, x // PLACES) * PLACES + x % PLACES).tolist()
        (lo, hi, end), (a, b, t) = spans, runs
        state.update((json.dumps([[names[i] for i in used], [place(lo), place(hi), end.tolist()], [place(a), place(b), t.tolist()]]),))
    elif state.exists:
        state.remove()


def stream_runs(frames: DataFrame, blank: int = 0, groups: int = GROUPS) -> DataFrame:
    """(utt_id, start, stop, token, final): runs of equal labels over frames that come in chunks.

    ``frames`` streams (utt_id, frame, token, is_last), from frame 0 on. A run is emitted as soon as the frames on both sides of it
    are known, so the order of chunks does not matter, and of the frames that came early the state holds their stretches with
    the runs at the edges only. ``is_last`` closes the last run; when all frames before it are known too, the utterance is forgotten.
    Until then frames seen again are dropped. Blanks are not emitted.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, spans, runs = _read(state)
        for pdf in batches:
            if pdf.empty:
                continue
            code, known = pd.factorize(np.concatenate([np.array(names, object), pdf["utt_id"].to_numpy(object)]), use_na_sentinel=False)
            at = code[len(names) :].astype(np.int64) * PLACES + pdf["frame"].astype(np.int64).to_numpy()
            spans, runs, (a, b, t, final) = join_frames(spans, runs, (at, pdf["token"].astype(np.int64).to_numpy(), pdf["is_last"].to_numpy(bool)))
            names = known.tolist()
            shown = t != blank
            a, b = a[shown], b[shown]
            yield pd.DataFrame({"utt_id": known[a // PLACES], "start": a % PLACES, "stop": b % PLACES, "token": t[shown], "final": final[shown]})
        _write(state, names, spans, runs)

    x = frames.where("frame >= 0").withColumns({"is_last": F.coalesce("is_last", F.lit(False)), "_g": F.pmod(F.xxhash64("utt_id"), F.lit(groups))})
    return x.groupBy("_g").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_totals(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; events later than the watermark allows are dropped."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    g = e.groupBy(F.window("t", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n): sessions of events at most ``gap`` apart."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    g = e.groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
