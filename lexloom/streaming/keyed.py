"""Keyed state with expiry: stop strings over pieces of a text, and the memory of conversations.

The session must keep state in RocksDB (``USES_ROCKSDB``); what isn't touched for ``seconds`` expires by the clock, so
that a query goes on until it's stopped, whatever its trigger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

USES_ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def held_back(text: str, stops: Sequence[str]) -> int:
    """Length of the longest end of the text that might be the beginning of a stop string."""
    longest = min(len(text), max(map(len, stops), default=1) - 1)
    return next((n for n in range(longest, 0, -1) if any(s.startswith(text[-n:]) for s in stops)), 0)


def scan(tail: str, text: str, stops: Sequence[str], last: bool) -> tuple[str, str, bool]:
    """(what can be shown, new tail, whether a stop string was met) after text has come behind the tail."""
    whole = tail + text
    at = min((i for s in stops if (i := whole.find(s)) >= 0), default=-1)
    if at >= 0:
        return whole[:at], "", True
    n = 0 if last else held_back(whole, stops)
    return whole[: len(whole) - n], whole[len(whole) - n :], False


class _Scanner(StatefulProcessor):
    def __init__(self, stops: Sequence[str], seconds: int) -> None:
        self.stops, self.seconds = tuple(filter(None, stops)), seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scan", "tail string, stopped boolean", self.seconds * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        tail, stopped = self.state.get() or ("", False)
        found = pd.concat(list(rows)).sort_values("piece")
        shown = []
        for text, last in zip(found["text"], found["last"], strict=True):
            out = ""
            if not stopped:
                out, tail, stopped = scan(tail, text or "", self.stops, bool(last))
            shown.append(out)
        self.state.update((tail, stopped))
        yield pd.DataFrame({"stream_id": [key[0]] * len(shown), "piece": found["piece"].tolist(), "text": shown, "stopped": [stopped] * len(shown)})

    def close(self) -> None:
        pass


def scan_stream(pieces: DataFrame, stops: Sequence[str], seconds: int = 3600) -> DataFrame:
    """stream_id, piece, text and stopped of a stream of (stream_id, piece, text, last): what can be shown of each text so far.

    A text ends before its first stop string, also where that lies across pieces. What might become one is held
    back, and shown with a later piece; a piece with ``last`` shows all. Pieces of a batch are taken in order.
    """
    kind = pieces.schema["stream_id"].dataType.simpleString()
    rows = pieces.select("stream_id", F.col("piece").cast("long").alias("piece"), "text", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("stream_id").transformWithStateInPandas(_Scanner(stops, seconds), f"stream_id {kind}, piece long, text string, stopped boolean", "Append", "ProcessingTime")


class _Memory(StatefulProcessor):
    def __init__(self, n: int, seconds: int) -> None:
        self.n, self.seconds = n, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        turn = "turn long, role string, text string"
        self.asked = handle.getValueState("asked", turn, self.seconds * 1000)
        self.kept = handle.getListState("kept", turn, self.seconds * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        asked, more = self.asked.get(), []
        found = pd.concat(list(rows)).sort_values("turn")
        for r in found.itertuples():
            row = (int(r.turn), r.role, r.text)
            if r.role == "user":
                asked = row
            elif r.role == "assistant":
                if r.ok:
                    more += [asked, row] if asked else [row]
                asked = None
            else:
                more += [asked, row] if asked else [row]
                asked = None
        if more:
            self.kept.appendList(more)
        if asked:
            self.asked.update(asked)
        else:
            self.asked.clear()
        memory = [*self.kept.get(), *([asked] if asked else [])][-self.n :]
        yield pd.DataFrame({"conv_id": [key[0]] * len(memory), "turn": [m[0] for m in memory], "role": [m[1] for m in memory], "text": [m[2] for m in memory]})

    def close(self) -> None:
        pass


def memory_stream(turns: DataFrame, n: int = 6, seconds: int = 3600) -> DataFrame:
    """The last n turns that each conversation of a batch remembers, over a stream of (conv_id, turn, role, text, ok).

    A question stays open until its answer comes, and is remembered only with an answer that succeeded. Turns are
    appended to the state, which is never written anew, and each is forgotten after ``seconds``.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("conv_id").transformWithStateInPandas(_Memory(n, seconds), f"conv_id {kind}, turn long, role string, text string", "Append", "ProcessingTime")
