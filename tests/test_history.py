import random

import numpy as np
import pandas as pd

from cloudloom.operators import history as hi

DELTA = "scan_id string, session_id string, edit_seq bigint, point_id bigint, after_class_id int, after_instance_id int, after_category int"


def _deltas(spark, rows):
    return spark.createDataFrame([("s", a, e, p, c, c, 0) for a, e, p, c in rows], DELTA)


def test_marks_follow_the_stacks(spark):
    """Random commands of two sessions with equal edit numbers against plain undo and redo stacks."""
    rnd, marks = random.Random(4), None
    stacks, asked = {"a": ([], []), "b": ([], [])}, {}
    for name in "ab":
        asked[name] = spark.createDataFrame([("s", name)] * 2, "scan_id string, session_id string")
    last = {"a": 0, "b": 0}
    plan = [("a", o) for o in "set set undo undo set undo redo redo".split()] + [(rnd.choice("ab"), rnd.choice(["set", "undo", "redo", "undo"])) for _ in range(10)]
    for at, (name, op) in enumerate(plan):
        undo, redo = stacks[name]
        if op == "set":
            seq = last[name] = last[name] + 1
            new = hi.made(_deltas(spark, [(name, seq, p, seq) for p in range(3)]), at)
            undo.append(seq)
            redo.clear()
        elif op == "undo":
            new = hi.undo(marks, asked[name], at)
            if undo:
                redo.append(undo.pop())
        else:
            new = hi.redo(marks, asked[name], at)
            if redo:
                undo.append(redo.pop())
        rows = new.collect()
        assert len(rows) <= 1
        kept = spark.createDataFrame(rows, new.schema)
        marks = kept if marks is None else spark.createDataFrame(marks.collect() + rows, new.schema)
        live = {(r.session_id, r.edit_seq) for r in hi.activity(marks).filter("active").collect()}
        assert live == {(n, e) for n, (u, _) in stacks.items() for e in u}


def test_fold_cap_and_empty(spark):
    base = spark.createDataFrame([("s", n, p, -1, -1, 0, "x") for n in "ab" for p in range(3)], "scan_id string, session_id string, point_id bigint, class_id int, instance_id int, category int, note string")
    deltas = _deltas(spark, [("a", 1, 0, 5), ("a", 2, 0, 6), ("b", 1, 0, 9), ("b", 1, 1, None)])
    marks = hi.made(deltas, 1)
    every = deltas.select("scan_id", "session_id")
    back = marks.unionByName(hi.undo(marks, every.filter("session_id = 'a'"), 2))
    got = {(r.session_id, r.point_id): r.class_id for r in hi.fold_marks(base, deltas, back).collect()}
    assert got == {("a", 0): 5, ("a", 1): -1, ("a", 2): -1, ("b", 0): 9, ("b", 1): None, ("b", 2): -1}
    once = back.unionByName(hi.undo(back, every, 3, cap=1))
    assert {(r.session_id, r.edit_seq) for r in hi.activity(once).filter("active").collect()} == {("a", 1)}
    assert hi.redo(marks, every, 4).count() == 0 and hi.undo(marks.limit(0), every, 4).count() == 0
    assert hi.fold_marks(base, deltas.limit(0), marks.limit(0)).filter("class_id = -1").count() == 6


def test_late_edit_takes_its_place(spark, tmp_path):
    """Edit 2 comes after edit 3: the next undo takes back 3."""
    from cloudloom.streaming.jobs import edit_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cols = "scan_id string, session_id string, edit_seq bigint, op string, allocate boolean, high_water bigint"
    folder, log, place = (str(tmp_path / n) for n in ("in", "log", "ck"))
    for rows in ([(1, "set"), (3, "set")], [(2, "set"), (4, "undo")]):
        spark.createDataFrame([("s", "a", q, o, False, 0) for q, o in rows], cols).coalesce(1).write.mode("append").parquet(folder)
        edit_stream(spark.readStream.schema(cols).parquet(folder), log, place).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(log)
    assert seen.filter("op = 'undo'").select("target_seq").collect() == [(3,)]


class _Pages(dict):
    """A map state that counts what it is asked."""

    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


def test_seen_numbers_touch_the_state_by_pages():
    from cloudloom.streaming.jobs import SeenNumbers

    pages = _Pages()
    seen, known = SeenNumbers(pages), set()
    rnd = np.random.default_rng(4)
    for _ in range(3):
        numbers = np.sort(rnd.integers(-20_000, 20_000, 5_000)).tolist()
        for n in numbers:
            assert seen.containsKey((n,)) == (n in known)
            seen.updateValue((n,), ("set",))
            known.add(n)
        seen.flush()
    assert len(pages) == 10 and pages.calls <= 3 * 3 * 10


def test_history_is_handed_on_in_frames():
    from cloudloom.streaming.jobs import SeenNumbers, SessionHistory

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    def run(frame, *batches):
        job = SessionHistory()
        job.state, job.seen, job.FRAME = Value(), SeenNumbers(_Pages()), frame
        frames = [list(job.handleInputRows(("s", "x"), iter(b), None)) for b in batches]
        assert all(len(f) <= frame for got in frames for f in got)
        return pd.concat([f for got in frames for f in got], ignore_index=True).values.tolist()

    rnd = np.random.default_rng(5)
    ops = rnd.choice(["set", "set", "undo", "redo"], 900)
    made = pd.DataFrame({"edit_seq": rnd.permutation(900), "op": ops, "allocate": rnd.random(900) < 0.3, "high_water": 7})
    first = [made.iloc[:300], made.iloc[300:500]], [made.iloc[400:]]
    got = run(50, *first)
    assert got == run(10_000, *first) and len({r[2] for r in got}) == len(got) > 500
