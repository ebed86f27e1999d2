"""Structured Streaming: bounded conversation history, and ingestion with upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import ENTITIES, MESSAGES, SHOWN
from ..sources import sinks


#: Messages that a context shows.
CONTEXT = 3


def bounded_history(messages: DataFrame, key: str = "conv_id", order: str = "turn", most: int = MESSAGES) -> DataFrame:
    """A stream of messages (key, order, role, text) to each conversation's last `most` messages.

    State per conversation is at most `most` messages, whatever comes; each batch emits the
    conversations that changed. Messages without a turn are left out; a null role or text is kept.
    """
    first = lambda r: (r[0], *[(x is not None, x or "") for x in r[1:]])  # noqa: E731  nulls before texts

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, roles, texts = (list(x) for x in state.get) if state.exists else ([], [], [])
        for frame in frames:
            frame = frame[frame[order].notna()]
            new = zip(frame[order].astype("int64"), *[[None if pd.isna(x) else x for x in frame[c]] for c in ("role", "text")], strict=True)
            rows = sorted(set(zip(turns, roles, texts, strict=True)) | set(new), key=first)[-most:]
            turns, roles, texts = ([int(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        state.update((turns, roles, texts))
        yield pd.DataFrame({key: [group[0]], "n": [len(turns)], "last_turn": [turns[-1] if turns else None], "turns": [turns], "texts": [texts]})

    return messages.groupBy(key).applyInPandasWithState(
        update,
        f"{key} bigint, n int, last_turn bigint, turns array<bigint>, texts array<string>",
        "turns array<bigint>, roles array<string>, texts array<string>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


class Conversation(StatefulProcessor):
    """State of a conversation: its last messages and entities, both bounded; see conversation()."""

    def __init__(self, key: str, most: int, entities: int, shown: int):
        self.key, self.most, self.most_entities, self.shown = key, most, entities, shown

    def init(self, handle) -> None:
        self.messages = handle.getListState("messages", "turn bigint, role string, text string")
        self.entities = handle.getListState("entities", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        said = [tuple(x) for x in self.messages.get()]
        known = [x[0] for x in self.entities.get()]
        null = lambda x: None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else x
        new = [(int(r.turn), null(r.role), null(r.text), null(r.entities), null(r.clear)) for frame in rows for r in frame[frame.turn.notna()].itertuples()]
        for turn, role, text, entities, clear in sorted(new, key=lambda r: (r[0], str(r[1]), str(r[2]))):
            if clear:
                said, known = [], []
                continue
            said = [*said, (turn, role, text)][-self.most :]
            for value in entities if entities is not None else []:
                known = known if value in known else [*known, value][-self.most_entities :]
        self.messages.put(said) if said else self.messages.clear()
        self.entities.put([(x,) for x in known]) if known else self.entities.clear()
        cut = lambda t: t if t is None or len(t) <= self.shown else t[: self.shown] + "..."
        lines = [f"{(role or '').capitalize()}: {cut(text) or ''}" for _, role, text in said[-CONTEXT:]]
        last = said[-1][0] if said else None
        yield pd.DataFrame({self.key: [key[0]], "n": pd.array([len(said)], "int32"), "last_turn": pd.array([last], "Int64"), "context": ["\n".join(lines)], "entities": [known]})


def conversation(messages: DataFrame, key: str = "conv_id", most: int = MESSAGES, entities: int = ENTITIES, shown: int = SHOWN) -> DataFrame:
    """A stream of messages (key, turn, role, text, entities array, clear) to what an answer needs of each conversation.

    Gives key, n, last_turn, context (the last three messages as lines) and the last entities, for
    conversations that changed; a row with `clear` empties its conversation. Batches follow each other
    in turns; inside a batch messages come by turn. A message without a turn is left out. Start it inside
    session.session_with(); sinks.upsert by key and retrieval.answer(talk=...) bring it to answers.
    """
    rows = messages.select(key, "turn", "role", "text", "entities", "clear")
    out = f"{key} bigint, n int, last_turn bigint, context string, entities array<string>"
    return rows.groupBy(key).transformWithStateInPandas(Conversation(key, most, entities, shown), out, "Update", "None")


def ingest(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", prune_by: str | None = None, order: str | None = None):
    """A streaming query that upserts each micro-batch into a dataset.

    Later batches win; inside a batch the last row of a key by `order` does, or any without it.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                sinks.upsert(batch.sparkSession, path, rows, key, prune_by, order)
        finally:
            rows.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
