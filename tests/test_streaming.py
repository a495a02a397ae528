"""Event fold (STR-3/STR-7), subscription snapshot (STR-5/STR-6) and the
cancel cut-off (STR-8) on batch inputs; the streaming jobs themselves run in
the registered str_* queries."""

from crawlscope.streaming import pipeline as SP


def test_fold_counts_pages_after_cancel(spark):
    ev = spark.createDataFrame([
        ("a", "started", 1, None, None), ("a", "urls_listed", 2, None, None),
        ("a", "page_completed", 3, None, "success"), ("a", "cancel", 4, None, None),
        ("a", "page_completed", 5, None, "fetch_error"), ("a", "completed", 6, None, None),
        ("b", "started", 1, None, None), ("b", "urls_listed", 2, None, None),
        ("b", "page_completed", 3, None, "no_jsonld"), ("b", "completed", 4, None, None)],
        "scan_id string, type string, seq int, message string, status string")
    got = {r.scan_id: r for r in SP.fold_events(ev).collect()}
    assert got["a"].status == "canceled" and got["a"].completed == 2 and got["a"].failed == 1
    assert got["b"].status == "completed" and got["b"].successful == 0 and got["b"].failed == 0
    snap = SP.subscribe(SP.fold_events(ev), "a").collect()
    assert len(snap) == 1 and snap[0].type == "scan_state" and snap[0].status == "canceled"


def test_claims_after_cancel_dropped(spark):
    reqs = spark.createDataFrame([("a", "u1", 1), ("a", "u2", 9), ("b", "u3", 9)], "scan_id string, url string, seq long")
    ctl = spark.createDataFrame([("a", "cancel", 5, None)], "scan_id string, type string, seq long, message string")
    assert sorted(r.url for r in SP.claimable(reqs, ctl).collect()) == ["u1", "u3"]
