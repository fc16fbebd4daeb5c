"""All hits start windows, not only a minute's first."""

from ostinato.operators import rescan


def test_later_hits_of_a_minute_are_scanned(spark):
    loud = {*range(500, 520), *range(4500, 4520)}
    rows = [("a", i, 30000 if i in loud else 0) for i in range(7000)]
    got = rescan.demo(spark.createDataFrame(rows, "source_key string, sample_no long, sample int")).collect()
    assert any(r["start_s"] <= 5.2 and r["end_s"] >= 5.0 for r in got)
    assert any(r["start_s"] <= 45.2 and r["end_s"] >= 45.0 for r in got)
