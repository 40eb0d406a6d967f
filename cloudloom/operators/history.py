"""Undo and redo as a table of marks: edits and marks are only ever appended, and every session has its own history.

Deltas are (scan_id, session_id, edit_seq, point_id, after_*); marks are (scan_id, session_id, edit_seq, at, active), one
row for each time an edit is made, undone or redone.  An edit is active as its latest mark says.  ``at`` numbers the steps;
one step serves any number of sessions, and sessions with equal edit numbers do not touch one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HISTORY_CAP

SESSION = ["scan_id", "session_id"]
EDIT = [*SESSION, "edit_seq"]
STATE = ["class_id", "instance_id", "category"]


def made(deltas: DataFrame, at: int) -> DataFrame:
    """The marks of new edits: active from step ``at`` on."""
    return deltas.select(*EDIT).distinct().select(*EDIT, F.lit(at).cast("bigint").alias("at"), F.lit(True).alias("active"))


def activity(marks: DataFrame) -> DataFrame:
    """(scan_id, session_id, edit_seq, active): the latest mark of each edit."""
    return marks.groupBy(*EDIT).agg(F.max_by("active", "at").alias("active"))


def undo(marks: DataFrame, asked: DataFrame, at: int, cap: int = HISTORY_CAP) -> DataFrame:
    """Marks to append: in each session of ``asked`` the newest active edit among its last ``cap`` becomes inactive.

    A session without such an edit gets no mark; sessions asked for twice count once.
    """
    edits = activity(marks).join(asked.select(*SESSION).distinct(), SESSION, "left_semi")
    newest = Window.partitionBy(*SESSION).orderBy(F.desc("edit_seq"))
    top = edits.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= cap).filter("active").groupBy(*SESSION).agg(F.max("edit_seq").alias("edit_seq"))
    return top.select(*EDIT, F.lit(at).cast("bigint").alias("at"), F.lit(False).alias("active"))


def redo(marks: DataFrame, asked: DataFrame, at: int) -> DataFrame:
    """Marks to append: in each session of ``asked`` what was undone last is active again.

    A new edit clears what was undone before it: only edits undone since the session's newest edit was made can return.
    """
    own = marks.join(asked.select(*SESSION).distinct(), SESSION, "left_semi")
    edits = own.groupBy(*EDIT).agg(F.max_by("active", "at").alias("active"), F.max("at").alias("_last"), F.min("at").alias("_made"))
    newest = edits.groupBy(*SESSION).agg(F.max("_made").alias("_clear"))
    undone = edits.filter("NOT active").join(newest, SESSION).filter(F.col("_last") > F.col("_clear"))
    return undone.groupBy(*SESSION).agg(F.max_by("edit_seq", "_last").alias("edit_seq")).select(*EDIT, F.lit(at).cast("bigint").alias("at"), F.lit(True).alias("active"))


def fold_marks(base: DataFrame, deltas: DataFrame, marks: DataFrame) -> DataFrame:
    """Labels of every session: a point's latest active delta of its session over ``base``, which has a session_id."""
    live = activity(marks).filter("active").select(*EDIT)
    key = [*SESSION, "point_id"]
    after = F.struct(*[F.col(f"after_{c}").alias(c) for c in STATE])
    last = deltas.join(live, EDIT, "left_semi").groupBy(*key).agg(F.max_by(after, "edit_seq").alias("_now"))
    out = base.join(last, key, "left")
    return out.withColumns({c: F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)) for c in STATE}).select(*base.columns)
