"""Keyed state for streams: conversation windows.

The turns of a trigger are folded in order. A session's window lives in the state store; memory holds one session's
turns of one trigger, which the source's trigger limit bounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class ConversationWindow(StatefulProcessor):
    """Turns still held and concepts still active per session, with an optional expiry."""

    def __init__(self, max_turns: int, max_tokens: int, keep_last: int, active: int, ttl_ms: int | None) -> None:
        self.max_turns, self.max_tokens, self.keep_last, self.active, self.ttl_ms = max_turns, max_tokens, keep_last, active, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "turns array<long>, tokens array<long>, concepts array<long>"
        self.state = handle.getValueState("window", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("turn_no", kind="stable")
        held = self.state.get() if self.state.exists() else ([], [], [])
        turns, tokens, concepts = (deque(int(v) for v in part) for part in held)
        used = sum(tokens)
        for turn, cost, named in zip(batch["turn_no"].tolist(), batch["token_count"].tolist(), batch["concepts"]):
            while turns and (len(turns) >= self.max_turns or len(turns) > self.keep_last and used + cost > self.max_tokens):
                turns.popleft()
                used -= tokens.popleft()
            turns.append(int(turn))
            tokens.append(int(cost))
            used += int(cost)
            for concept in [] if named is None else named:
                if int(concept) not in concepts:
                    concepts.append(int(concept))
            while len(concepts) > self.active:
                concepts.popleft()
        kept = [list(part) for part in (turns, tokens, concepts)]
        self.state.update(tuple(kept))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [kept[0]], "total_tokens": [used], "concepts": [kept[2]]})

    def close(self) -> None:
        pass


def conversation_windows(
    stream: DataFrame, max_turns: int = 20, max_tokens: int = 4000, keep_last: int = 2, active: int = 10, ttl_ms: int | None = None
) -> DataFrame:
    """Window of every session touched by a trigger: ``(session_id, turns, total_tokens, concepts)``."""
    schema = T.StructType([
        stream.schema["session_id"], T.StructField("turns", T.ArrayType(T.LongType())),
        T.StructField("total_tokens", T.LongType()), T.StructField("concepts", T.ArrayType(T.LongType())),
    ])
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=ConversationWindow(max_turns, max_tokens, keep_last, active, ttl_ms),
        outputStructType=schema, outputMode="Update", timeMode=mode,
    )
