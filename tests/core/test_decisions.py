"""Second readings, decisions on candidates, primary metrics, research runs: fixtures with the expected values."""

from pyspark.sql import functions as F

from brandlens.operators import decisions, views

MENTIONS = "run_id int, brand string, sentiment string, strength string, position int, source string"
JUDGED = "run_id int, sequence int, brand_name string, sentiment string, strength string, position int, ranking_is_explicit boolean"


def test_judgements_fill_only_what_is_unknown(spark):
    mentions = [(1, "Acme", "neutral", "unknown", None, "rules"), (1, "Beta", "negative", "weak", 2, "rules"), (2, "Acme", "unknown", "unknown", None, "rules"), (3, "Acme", None, None, None, "rules")]
    judged = [(1, 1, "acme", "mixed", "none", 9, True), (1, 2, "ACME", "positive", "strong", 1, False), (1, 3, "Beta", "positive", "strong", 7, True), (1, 4, "Gamma", "positive", "strong", 1, True), (2, 1, "Acme", "unknown", None, 4, True), (2, 0, None, "positive", "weak", 1, True)]
    rows = decisions.merge_judgements(spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(judged, JUDGED)).collect()
    assert {(r.run_id, r.brand, r.sentiment, r.strength, r.position, r.source) for r in rows} == {
        (1, "Acme", "positive", "strong", None, "llm"), (1, "Beta", "negative", "weak", 2, "rules"), (2, "Acme", "unknown", "unknown", 4, "llm"), (3, "Acme", None, None, None, "rules")
    }


def test_second_reading_is_due(spark):
    rows = [(1, "positive", "strong", True), (1, "neutral", "strong", True), (2, "positive", "strong", True), (3, "positive", "strong", False), (4, "positive", "unknown", True), (5, "positive", "strong", None)]
    found = decisions.needs_interpretation(spark.createDataFrame(rows, "run_id int, sentiment string, strength string, answer_is_list boolean")).collect()
    assert {r.run_id: r.needed for r in found} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_new_claims_speak_of_known_brands(spark):
    schema = "run_id int, subject string, predicate string, object string, confidence double"
    claims = spark.createDataFrame([(1, "Acme", "is", "fast", 0.5)], schema)
    judged = spark.createDataFrame([(1, "ACME", "IS", "Fast", 1.0), (1, "acme", "is", "slow", 1.0), (2, "Acme", "is", "fast", 0.3), (1, "Other", "is", "new", 0.4), (1, None, "is", "x", 0.4)], schema)
    rows = decisions.merge_claims(claims, judged, spark.createDataFrame([("Acme",), ("Acme",)], "brand string")).collect()
    assert sorted(map(tuple, rows)) == [(1, "Acme", "is", "fast", 0.5), (1, "Acme", "is", "slow", 0.9), (2, "Acme", "is", "fast", 0.3)]


def test_candidates(spark):
    rows = [(1, "a", "a.com", "accepted"), (2, "b", None, "new"), (3, "", "c.com", "new"), (4, "d", "own.com", "new"), (5, "e", "taken.com", "new"), (6, "named", "f.com", "rejected"), (7, "g", "g.com", "new"), (8, "h", "g.com", "new"), (9, "g", "i.com", "new"), (10, "a", "a.com", "new"), (11, None, "k.com", None)]
    candidates = spark.createDataFrame([(7, *r) for r in rows], "project_id int, candidate_id int, key string, domain string, status string")
    table = lambda column, *values: spark.createDataFrame([(7, v) for v in values] + [(8, "g")], f"project_id int, {column} string")
    got = decisions.accept_outcomes(candidates, table("key", "named", "named", None), table("domain", "taken.com"), table("domain", "own.com", None)).collect()
    assert {r.candidate_id: r.outcome for r in got} == {
        1: "already_accepted", 2: "domain_missing", 3: "name_empty", 4: "own_domain", 5: "domain_taken", 6: "name_taken", 7: "accepted", 8: "domain_taken", 9: "name_taken", 10: "accepted", 11: "name_empty",
    }
    assert [r.x for r in candidates.orderBy("candidate_id").limit(2).select(decisions.reject_outcome(F.col("status")).alias("x")).collect()] == ["conflict", "rejected"]


def test_primary_metrics(spark):
    schema = "project_id int, period string, sample_size bigint, sufficiency string, score double, mention_rate double, recommendation_rate double, citation_rate double, average_position double, competitive_score double"
    rows = [(1, "current", 9, "low", 50.0, 60.04, 1.0, 2.0, None, None), (1, "previous", 2, "insufficient", None, None, 4.0, None, 3.0, 5.0), (2, "previous", 5, "low", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (3, "current", 0, "insufficient", None, None, None, None, None, None)]
    got = {(r.project_id, r.metric): (r.value, r.change, r.reason) for r in views.primary_metrics(spark.createDataFrame(rows, schema), F.when(F.col("project_id") == 3, 0).otherwise(2)).collect()}
    assert len(got) == 12 and {p for p, _ in got} == {1, 3}
    assert got[1, "score"] == (50.0, None, "Not enough responses in the previous period")
    assert got[1, "recommendation_rate"] == (1.0, -3.0, None) and got[1, "average_position"] == (None, None, views.NO_POSITION) and got[1, "competitive_share"][2] == views.NO_MENTIONS
    assert got[3, "score"][2] == "Not enough responses in the current period" and got[3, "mention_rate"][2] == "Not enough responses in this period" and got[3, "competitive_share"][2] == views.NO_COMPETITORS


def test_research_findings(spark):
    schema = """project_id int, run_id int, agent_name string, status string, created_at int, findings array<struct<key:string,title:string,impact:string,confidence:string,priority_score:double,evidence:map<string,string>>>,
        recommendations array<struct<recommended_action:string,why_now:string,expected_area_of_impact:string>>"""
    two = [("k", "T", "high", "low", 2.0, {"content_gap_id": "g"}), ("", None, None, None, None, None)]
    rows = [(1, 10, "research", "completed", 5, two, [("act", "now", "area")]), (1, 11, "research", "failed", 9, two, None), (1, 12, "strategy", "completed", 9, two, None), (1, 13, "research", "awaiting_approval", 9, [], None), (2, 14, "research", "completed", 1, None, None)]
    found = views.priority_findings(views.latest_research_run(spark.createDataFrame(rows, schema)))
    got = [(r.run_id, r["index"], r.finding_id, r.title, r.area, r.content_gap_id) for r in found.orderBy("index").collect()]
    assert got == [(10, 0, "k", "T", "area", "g"), (10, 1, "10:1", "Finding", None, None)]
    assert [tuple(r) for r in views.covered_gaps(found).collect()] == [(1, "g")]
