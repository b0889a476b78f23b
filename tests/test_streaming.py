"""Late rows, repeated rows and restarts of the daily stream."""

from datetime import date, datetime, timedelta

from palimpsest.streaming import daily as S

SCHEMA = "revision_id bigint, timestamp timestamp_ntz, user_text string"
D = datetime(2026, 7, 1, 12)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def counts(spark, folder, out, checkpoint, late="5 days"):
    S.run_daily(S.revision_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1), out, checkpoint, late)
    return {r.day: r.revisions for r in S.latest_counts(spark, out).collect()}


def test_late_rows_and_restarts(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    day = lambda n: D + timedelta(days=n)
    put(spark, folder, [(1, day(0), "a"), (2, day(0), "b"), (1, day(0), "a"), (None, day(0), "c"), (3, None, "c")])
    assert counts(spark, folder, out, checkpoint) == {date(2026, 7, 1): 2}
    put(spark, folder, [(4, day(9), "a"), (2, day(0), "b")])  # the stream starts again from its checkpoint; a repeated delivery
    assert counts(spark, folder, out, checkpoint) == {date(2026, 7, 1): 2, date(2026, 7, 10): 1}
    put(spark, folder, [(5, day(6), "a"), (6, day(0), "late")])  # one within five days of the newest row, one beyond
    got = counts(spark, folder, out, checkpoint)
    assert got == {date(2026, 7, 1): 2, date(2026, 7, 7): 1, date(2026, 7, 10): 1}
    assert counts(spark, folder, out, checkpoint) == got  # nothing new: nothing changes


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, [(1, D, "a"), (2, D, "b")])
    assert counts(spark, folder, out, str(tmp_path / "one")) == counts(spark, folder, out, str(tmp_path / "two")) == {D.date(): 2}
