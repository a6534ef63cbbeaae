"""Lifecycle of issues over several audits: verified, reappeared, awaiting, and runs that end and begin again."""

from brandlens.operators import verification as V

AUDITS = [("p", 1, "completed", "2024-01-01", 70.0), ("p", 2, "completed", "2024-02-01", 75.55), ("p", 9, "failed", "2024-02-15", None), ("p", 3, "completed", "2024-03-01", None), ("q", 4, "completed", "2024-01-01", 50.0), ("q", 5, "running", None, None)]
SEEN = [
    (1, "a", "u", "resolved", "2024-01-05"),  # gone in 2, back in 3
    (3, "a", "u", "open", "2024-03-01"),
    (1, "b", None, "resolved", "2024-01-05"),  # still there
    (2, "b", None, "ignored", "2024-02-01"),
    (1, "c", "u", "resolved", "2024-02-03"),  # resolved after audit 2
    (2, "d", "u", "resolved", "2024-02-02"),  # no score of the next audit
    (3, "e", "", "resolved", "2024-03-02"),  # newest audit
    (4, "a", "u", "resolved", "2024-01-02"),  # no completed audit after it
    (1, "f", "u", "open", "2024-01-01"),
    (1, "ab", "c", "resolved", "2024-01-02"),
    (2, "a", "bc", "open", "2024-02-01"),
    (9, "z", "u", "resolved", "2024-02-16"),
    (1, "g", "u", "resolved", None),
]


def frames(spark):
    from pyspark.sql import functions as F

    audits = spark.createDataFrame(AUDITS, "project_id string, audit_id int, status string, completed_at string, health_score double").withColumn("completed_at", F.to_timestamp("completed_at"))
    return audits, spark.createDataFrame(SEEN, "audit_id int, code string, url string, status string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))


def test_lifecycle(spark):
    got = {(r.audit_id, r.code, r.url): (r.state, r.verified_by, r.score_change) for r in V.verification_lifecycle(*frames(spark)).collect()}
    assert got == {
        (1, "a", "u"): ("verified", 2, 5.5),
        (1, "b", None): ("reappeared", 2, 5.5),
        (1, "c", "u"): ("awaiting", None, 5.5),
        (1, "ab", "c"): ("verified", 2, 5.5),
        (1, "g", "u"): ("awaiting", None, 5.5),
        (2, "d", "u"): ("verified", 3, None),
        (3, "e", ""): ("awaiting", None, None),
        (4, "a", "u"): ("awaiting", None, None),
    }


def test_islands(spark):
    got = {(r.project_id, r.code, r.url, r.island): (r.first_audit, r.last_audit, r.audits, r.is_open) for r in V.issue_islands(*frames(spark)).collect()}
    assert got["p", "a", "u", 1] == (1, 1, 1, False) and got["p", "a", "u", 2] == (3, 3, 1, True)
    assert got["p", "b", None, 1] == (1, 2, 2, False) and got["q", "a", "u", 1] == (4, 4, 1, True)
    assert ("p", "z", "u", 1) not in got and len(got) == 11
