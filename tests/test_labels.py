import pytest

from cloudloom.operators import labels as lb


@pytest.fixture(scope="module")
def base(spark):
    rows = [("s", i, c, n, 0, p, -1) for i, (c, n, p) in enumerate([(-1, -1, -1), (0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 2), (-1, -1, -1), (2, 3, 3)])]
    return spark.createDataFrame(rows, "scan_id string, point_id bigint, class_id int, instance_id int, category int, preseg_id int, cand_id int")


def _sel(spark, *ids):
    return spark.createDataFrame([("s", i) for i in ids], "scan_id string, point_id bigint")


def _inst(df):
    return [r.instance_id for r in df.orderBy("point_id").collect()]


def test_locked_points_stay_and_ids_are_fresh(spark, base):
    e = lb.reassign(base, _sel(spark, 0, 1, 3), None, 2, protected=[0])
    assert e.new_instance_id == 4 and _inst(e.labels) == [4, 0, 0, 4, 1, 2, -1, 3]
    assert e.counts.first().n_protected == 1
    none = lb.reassign(base, _sel(spark, 1, 2), None, 2, protected=[0])
    assert none.new_instance_id is None and none.delta is None


def test_ids_are_not_reused_after_undo(spark, base):
    e = lb.reassign(base, _sel(spark, 0), None, 2)
    log = lb.undo(lb.append_log(None, e.delta, 1))
    assert _inst(lb.fold_log(base, log)) == _inst(base)
    assert lb.fresh_id(base, log) == 5


def test_redo_is_cleared_by_a_new_edit(spark, base):
    log = lb.append_log(None, lb.set_class(base, _sel(spark, 1), 7).delta, 1)
    log = lb.undo(log)
    log = lb.append_log(log, lb.set_class(base, _sel(spark, 3), 8).delta, 2)
    log = lb.redo(log)
    assert [r.class_id for r in lb.fold_log(base, log).orderBy("point_id").collect()][:4] == [-1, 0, 0, 8]


def test_review_mark_is_one_blob_and_class_label_clears_it(spark, base):
    e = lb.set_category(base, _sel(spark, 1, 3), "excluded_review")
    got = {(r.class_id, r.instance_id, r.category) for r in e.labels.filter("point_id IN (1,3)").collect()}
    assert got == {(-1, 4, 3)}
    back = lb.set_class(e.labels, _sel(spark, 1), 0).labels.filter("point_id=1").first()
    assert back.category == 0
    with pytest.raises(ValueError):
        lb.set_category(base, _sel(spark, 1), "nonsense")


def test_merge_rules(spark, base):
    assert lb.merge_instances(base, 1, 1).delta is None
    assert lb.merge_instances(base, 99, 1).delta is None
    out = lb.merge_instances(base, 2, 0).labels.filter("point_id=5").first()
    assert (out.instance_id, out.class_id) == (0, 0)


def test_session_history_stream(spark, tmp_path):
    from cloudloom.streaming.jobs import edit_stream, fold_events

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ops = [(1, "set", True), (2, "set", False), (3, "undo", False), (4, "undo", False), (5, "redo", False), (6, "set", True), (7, "redo", False)]
    cols = "scan_id string, session_id string, edit_seq bigint, op string, allocate boolean, high_water bigint"
    spark.createDataFrame([("s", "a", q, o, a, 3) for q, o, a in ops], cols).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    q = edit_stream(src, str(tmp_path / "log"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    ev = spark.read.parquet(str(tmp_path / "log")).drop("epoch")
    got = [(r.edit_seq, r.target_seq, r.active, r.new_instance_id) for r in ev.orderBy("edit_seq").collect()]
    assert got == [(1, 1, True, 4), (2, 2, True, -1), (3, 2, False, -1), (4, 1, False, -1), (5, 1, True, -1), (6, 6, True, 5)]
    start = spark.createDataFrame([("s", "a", 9, -1, -1, 0)], "scan_id string, session_id string, point_id bigint, class_id int, instance_id int, category int")
    deltas = spark.createDataFrame([("s", "a", 1, 9, 0, -2, 0), ("s", "a", 2, 9, 1, 7, 0)], "scan_id string, session_id string, edit_seq bigint, point_id bigint, after_class_id int, after_instance_id int, after_category int")
    row = fold_events(start, ev, deltas).first()
    assert (row.class_id, row.instance_id) == (0, 4)
