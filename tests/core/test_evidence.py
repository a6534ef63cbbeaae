"""Paths and keys of evidence documents of any shape."""

from pyspark.sql import functions as F

from brandlens.operators import evidence, texts


def test_paths_and_keys(spark):
    rows = [
        (1, '{"inputs": {"eligible_responses": 12, "domain_type": "media", "source_relevance": 4}, "top_pages": [{"url": "u"}]}', '{"Acme": 3, "O\'Neil": null}'),
        (2, '{"inputs": {"eligible_responses": "many", "domain_type": null}}', '{"acme": 1}'),
        (3, '{"inputs": null}', '["Acme"]'),
        (4, "{broken", "Acme"),
        (5, None, None),
    ]
    gaps = spark.createDataFrame(rows, "id int, evidence string, competitors string")
    got = {r.id: (r.source_type, r.eligible_responses, r.prompts_citing, r.source_relevance) for r in evidence.gap_facts(gaps).collect()}
    assert got == {1: ("media", 12, 0, 4.0), 2: ("unknown", 0, 0, 0.0), 3: ("unknown", 0, 0, 0.0), 4: ("unknown", 0, 0, 0.0), 5: ("unknown", 0, 0, 0.0)}
    assert [r.id for r in evidence.naming(gaps, "Acme").collect()] == [1]
    assert [r.id for r in evidence.naming(gaps, "O'Neil").collect()] == [1]
    assert gaps.where(evidence.has_key(evidence.as_variant(F.col("competitors")), "gone")).count() == 0


def test_claims_meet_names_without_a_nested_loop(spark):
    answers = spark.createDataFrame([("r", "Acme offers payroll. We like Acme Pay has many users. Nothing here at all."), ("n", None)], "response_id string, text string")
    names = spark.createDataFrame([("Acme",), ("Acme Pay",), ("Globex",)], "name string")
    got = texts.claims(answers, names)
    assert sorted((r.subject, r.sentence_no) for r in got.collect())[0] == ("Acme", 0)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
