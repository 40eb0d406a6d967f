"""Structured Streaming jobs: chunked replay, edit streams and autosave."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.export import replay_labels
from ..schema import HISTORY_CAP, UNSET
from ..sources.sinks import save_labels

AUTOSAVE_SECONDS = 0.25


def replay_stream(raw: DataFrame, scan: DataFrame, labels: DataFrame, replay: dict, out: str, checkpoint: str):
    """Label every arriving chunk of raw points; scan and labels are static tables."""

    def each(chunk: DataFrame, epoch: int) -> None:
        done = replay_labels(chunk, scan, labels, **replay)
        # One folder per epoch makes a repeated epoch overwrite itself.
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


class SeenNumbers:
    """Sequence numbers of a session in a map state of pages, one bit a number.

    Numbers asked for in ascending order touch the state once or twice a page, not twice a number.
    """

    PAGE = 4096

    def __init__(self, pages):
        self.pages, self.at, self.bits, self.changed = pages, None, bytearray(), False

    def _turn(self, number: int) -> tuple[int, int]:
        page, place = divmod(number, self.PAGE)
        if page != self.at:
            self.flush()
            held = self.pages.getValue((page,))[0] if self.pages.containsKey((page,)) else bytes(self.PAGE // 8)
            self.at, self.bits = page, bytearray(held)
        return place >> 3, 1 << (place & 7)

    def containsKey(self, key) -> bool:
        byte, bit = self._turn(key[0])
        return bool(self.bits[byte] & bit)

    def updateValue(self, key, value) -> None:
        byte, bit = self._turn(key[0])
        self.bits[byte] |= bit
        self.changed = True

    def flush(self) -> None:
        """Write the open page; another session's pages come next."""
        if self.changed:
            self.pages.updateValue((self.at,), (bytes(self.bits),))
        self.at, self.changed = None, False


class SessionHistory(StatefulProcessor):
    """Per session: allocates ids never used before and resolves undo and redo.

    State is the undo stack (at most ``HISTORY_CAP`` edits), the redo stack, the
    next instance id, and the sequence numbers seen so far, which drop replays.
    A command that comes later than its number says still counts: a late edit takes its place by number on the undo
    stack, so that undo still takes back the newest edit, and leaves what newer edits and undos decided about redo.
    """

    #: Events of a frame that is handed on while the next ones are resolved.
    FRAME = 20_000

    def init(self, handle) -> None:
        self.state = handle.getValueState("history", "undo array<bigint>, redo array<bigint>, next_id bigint")
        self.seen = SeenNumbers(handle.getMapState("seen_pages", "page bigint", "bits binary"))

    def handleInputRows(self, key, rows, timerValues):
        # Four narrow columns are held of a micro-batch, and no more than a frame of what it makes.
        taken = [[f[c].to_numpy() for c in ("edit_seq", "op", "allocate", "high_water")] for f in rows]
        seqs, ops, asks, waters = (np.concatenate(c) for c in zip(*taken))
        del taken
        order = np.argsort(seqs, kind="stable")
        if self.state.exists():
            undo, redo, next_id = self.state.get()
            undo, redo = list(undo), list(redo)
        else:
            undo, redo, next_id = [], [], 0
        out, names = [], ["scan_id", "session_id", "edit_seq", "op", "target_seq", "active", "new_instance_id"]
        newest = max(undo + redo, default=None)
        for i in order:
            seq, op = int(seqs[i]), ops[i]
            if self.seen.containsKey((seq,)):
                continue
            self.seen.updateValue((seq,), (op,))
            target, new_id = seq, UNSET
            active = True
            if op == "undo":
                if not undo:
                    continue
                target, active = undo.pop(), False
                redo.append(target)
            elif op == "redo":
                if not redo:
                    continue
                target = redo.pop()
                undo.append(target)
            else:
                next_id = max(next_id, int(waters[i]) + 1)
                if asks[i]:
                    new_id, next_id = next_id, next_id + 1
                # Above all numbers that the stacks ever held, an edit is not late; only below are they looked through.
                late = newest is not None and newest > seq and max(undo + redo, default=seq) > seq
                newest = seq if newest is None else max(newest, seq)
                bisect.insort(undo, seq)
                undo = undo[-HISTORY_CAP:]
                redo = redo if late else []
            out.append((key[0], key[1], seq, op, target, active, new_id))
            if len(out) == self.FRAME:
                yield pd.DataFrame(out, columns=names)
                out = []
        if isinstance(self.seen, SeenNumbers):
            self.seen.flush()
        self.state.update((undo, redo, next_id))
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


EVENTS = "scan_id string, session_id string, edit_seq bigint, op string, target_seq bigint, active boolean, new_instance_id bigint"


def session_events(commands: DataFrame) -> DataFrame:
    """Stream of (scan_id, session_id, edit_seq, op, allocate, high_water) commands to history events.

    Commands are what people issue, not points, so a session's micro-batch is small.
    """
    return commands.groupBy("scan_id", "session_id").transformWithStateInPandas(
        statefulProcessor=SessionHistory(), outputStructType=EVENTS, outputMode="append", timeMode="none"
    )


def fold_events(base: DataFrame, events: DataFrame, deltas: DataFrame) -> DataFrame:
    """Current labels: an edit's newest event says whether it is active; its latest active delta wins.

    ``deltas`` = (scan_id, session_id, edit_seq, point_id, after_class_id,
    after_instance_id, after_category); -2 in after_instance_id means the id the
    session allocated.
    """
    keys = ["scan_id", "session_id"]
    last = events.groupBy(*keys, "target_seq").agg(F.max_by("active", "edit_seq").alias("active"), F.max("new_instance_id").alias("new_id"))
    live = last.filter("active").select(*keys, F.col("target_seq").alias("edit_seq"), "new_id")
    inst = F.when(F.col("after_instance_id") == -2, F.col("new_id")).otherwise(F.col("after_instance_id")).cast("int")
    rows = deltas.join(live, [*keys, "edit_seq"])
    top = rows.groupBy(*keys, "point_id").agg(
        F.max_by(F.struct(F.col("after_class_id").alias("class_id"), inst.alias("instance_id"), F.col("after_category").alias("category")), "edit_seq").alias("n")
    )
    out = base.join(top, [*keys, "point_id"], "left")
    return out.withColumns({c: F.coalesce(F.col(f"n.{c}"), F.col(c)) for c in ("class_id", "instance_id", "category")}).select(*base.columns)


def edit_stream(commands: DataFrame, log: str, checkpoint: str):
    """Append history events to the log; repeated epochs overwrite their own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return session_events(commands).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)


def autosave(changes: DataFrame, current, root: str, checkpoint: str):
    """Persist ``current()`` after each burst of changes: arrays first, pointer last."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            save_labels(current(), root, version=f"auto_{epoch}", again=True)

    return (
        changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{int(AUTOSAVE_SECONDS * 1000)} milliseconds")
    )
