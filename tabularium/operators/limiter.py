"""Request limits decided in parallel: pieces of a key's requests run from assumed states, and only wrong guesses run again."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.lineage import settled

GUESSES = 16  # assumed states of a piece; more only save repairs
REPAIRS = 6  # rounds of repair before the rest of a chain is decided in one stream

State = tuple[int, ...]  # times of the allowed requests that are still remembered, ascending


def allow(times: np.ndarray, remembered: State, limit: int, window: int) -> tuple[np.ndarray, State]:
    """Which of the ascending ``times`` are allowed, and what is remembered after the last of them.

    A request is allowed while fewer than ``limit`` allowed ones are younger than ``window``. Each of the ``limit`` places
    is free again from the first request a whole window later, so the loop visits allowed requests only.
    """
    allowed = np.zeros(len(times), bool)
    if not len(times):
        return allowed, remembered
    again = np.searchsorted(times, times + window, "left")
    free = deque([0] * (limit - len(remembered)))
    free.extend(np.searchsorted(times, np.array(remembered, np.int64) + window, "left").tolist())
    at = -1
    while True:
        at = max(at + 1, free.popleft())
        if at >= len(times):
            break
        allowed[at] = True
        free.append(int(again[at]))
    last = int(times[-1])
    kept = [t for t in (*remembered, *times[allowed][-limit:].tolist()) if last - t < window]
    return allowed, tuple(kept[-limit:])


def _segments(batches: Iterator[pd.DataFrame], piece: str) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Runs of rows of one piece and key, batch by batch, and whether it is another one than before."""
    owner = None
    for batch in batches:
        key, part = batch["__key"].to_numpy(), batch[piece].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) if len(key) else []
        for start, end in zip(starts, [*starts[1:], len(key)]):
            yield batch.iloc[start:end], (part[start], key[start]) != owner
            owner = part[start], key[start]


class Piece:
    """What the driver knows of a partition: its first and last key and the state it ends with if nothing came before."""

    def __init__(self, row) -> None:
        self.part, self.first, self.last = row["part"], row["first"], row["last"]
        self.whole = self.first == self.last  # one key: the end depends on the state at the start
        self.own = tuple(row["own"])
        self.guesses = [tuple(g) for g in row["guesses"]]


def _pieces(rows: DataFrame, limit: int, window: int) -> list[Piece]:
    """One row for each partition: the state of its last key from an empty start, and guesses of the true one.

    The guesses start empty at requests of the partition's last window: a limiter that is always in use often acts as if
    it started at one of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = last = None
        own: State = ()
        tail = np.zeros(0, np.int64)
        for rows_, fresh in _segments(batches, "__part"):
            if part is None:
                part, first = int(rows_["__part"].iloc[0]), rows_["__key"].iloc[0]
            if fresh:
                own, tail, last = (), np.zeros(0, np.int64), rows_["__key"].iloc[0]
            times = rows_["__at"].to_numpy()
            own = allow(times, own, limit, window)[1]
            tail = np.r_[tail, times]
            tail = tail[tail > tail[-1] - window]
        if part is None:
            return
        starts = np.unique(np.linspace(0, len(tail) - 1, GUESSES - 1).astype(int))
        guesses = {allow(tail[s:], (), limit, window)[1] for s in starts} | {own}
        yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "own": [list(own)], "guesses": [[list(g) for g in sorted(guesses)]]})

    found = rows.select("__part", "__key", "__at").mapInPandas(run, "part int, first string, last string, own array<long>, guesses array<array<long>>")
    return sorted((Piece(r) for r in found.collect()), key=lambda p: p.part)


def _run_from(rows: DataFrame, wanted: dict[int, list[State]], limit: int, window: int) -> dict[tuple[int, State], State]:
    """End states of whole partitions from each of the wanted start states; runs that meet go on as one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now = None, {}
        for batch in batches:
            if part is None:
                part = int(batch["__part"].iloc[0])
                now = {state: state for state in wanted.get(part, [])}
            times = batch["__at"].to_numpy()
            after = {state: allow(times, state, limit, window)[1] for state in set(now.values())}
            now = {start: after[state] for start, state in now.items()}
        if now:
            yield pd.DataFrame({"part": part, "start": [list(s) for s in now], "end": [list(e) for e in now.values()]})

    some = rows.where(F.col("__part").isin(list(wanted))).select("__part", "__at")
    found = some.mapInPandas(run, "part int, start array<long>, end array<long>").collect()
    return {(r["part"], tuple(r["start"])): tuple(r["end"]) for r in found}


def _walk(pieces: list[Piece], ends: dict[tuple[int, State], State]) -> tuple[dict[int, State], dict[int, list[State]]]:
    """True start states along the partitions as far as they are known, and the runs still to be made.

    After an unknown end the walk goes on with a guess, so that one round of repair can serve many pieces of a chain.
    """
    starts: dict[int, State] = {}
    wanted: dict[int, list[State]] = {}
    before, state, sure = None, (), True
    for piece in pieces:
        if before is None or piece.first != before.last:
            state, sure = (), True
        if sure:
            starts[piece.part] = state
        if not piece.whole or state == ():
            # an empty start is what the piece was run from; several keys: the last one began inside
            sure, state = sure or not piece.whole, piece.own
        elif (piece.part, state) in ends:
            state = ends[piece.part, state]
        else:
            wanted.setdefault(piece.part, []).append(state)
            sure, state = False, piece.own
        before = piece
    return starts, wanted


def _unsettled(pieces: list[Piece], starts: dict[int, State], ends: dict[tuple[int, State], State]) -> dict[int, int]:
    """Pieces without a known start, and the piece of known start before them, by the number of the latter."""
    heads: dict[int, int] = {}
    before, head = None, None
    for piece in pieces:
        if before is None or piece.first != before.last:
            head = None
        if piece.part in starts:
            state = starts[piece.part]
            head = piece.part if piece.whole and state != () and (piece.part, state) not in ends else None
        if head is not None:
            heads[piece.part] = head
        before = piece
    return heads


def rate_limit(
    events: DataFrame, keys: Sequence[str], limit: int, window_seconds: int, ts: str = "ts", event_id: str = "event_id", parts: int | None = None
) -> DataFrame:
    """``(keys, event_id, allowed)``: allow a request while fewer than ``limit`` allowed ones of its key are younger than the window.

    Requests are ranged by (key, time, id) into pieces of about equal rows (``parts`` of them, else the session's
    number of shuffle partitions), so a busy key is many pieces. A piece that one key fills depends on the state before it: it
    is run from a few assumed states at once, and the driver, which sees a few states a piece, follows the true one from piece to
    piece. Pieces whose true state was not assumed are run again from it; what is left of a key after a bounded number
    of such rounds is decided in one stream with the remembered times as state. Every row is decided once. Null keys are a key;
    requests without a time are allowed and not remembered; equal times go by id.
    """
    window = window_seconds * 1_000_000
    names = [f"`{c}`" for c in (*keys, event_id)]
    at = F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))
    keyed = events.select(*names, F.to_json(F.struct(*[f"`{k}`" for k in keys]), {"ignoreNullFields": "false"}).alias("__key"), at.alias("__at"))
    order = ["__key", "__at", f"`{event_id}`"]
    timed = keyed.where("__at IS NOT NULL")
    ranged = timed.repartitionByRange(*order) if parts is None else timed.repartitionByRange(parts, *order)
    rows = settled(ranged.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    pieces = _pieces(rows, limit, window)
    wanted = {p.part: b.guesses for b, p in zip(pieces, pieces[1:]) if p.whole and p.first == b.last}
    ends: dict[tuple[int, State], State] = {}
    starts: dict[int, State] = {}
    for _ in range(1 + REPAIRS):
        if wanted:
            ends |= _run_from(rows, wanted, limit, window)
        starts, wanted = _walk(pieces, ends)
        if not wanted:
            break
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (*keys, event_id)) + ", allowed boolean"
    columns = [*keys, event_id]
    heads = _unsettled(pieces, starts, ends)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, state = None, ()
        for found, fresh in _segments(batches, "__head"):
            if head != found["__head"].iloc[0]:  # the first key of a piece goes on from the state before it
                head = int(found["__head"].iloc[0])
                state = starts[head]
            elif fresh:
                state = ()
            allowed, state = allow(found["__at"].to_numpy(), state, limit, window)
            yield found[columns].assign(allowed=allowed)

    apart = F.col("__part").isin(list(heads)) if heads else F.lit(False)
    decided = rows.where(~apart).withColumn("__head", F.col("__part")).mapInPandas(decide, schema)
    if heads:
        head = F.element_at(F.create_map(*[F.lit(v) for pair in heads.items() for v in pair]), F.col("__part"))
        left = rows.where(apart).withColumn("__head", head).repartition("__head").sortWithinPartitions("__head", *order)
        decided = decided.unionByName(left.mapInPandas(decide, schema))
    untimed = keyed.where("__at IS NULL").select(*names, F.lit(True).alias("allowed"))
    return decided.unionByName(untimed)
