"""Projects with competitors of their own: different rivals give different scores, none gives no competitive score."""

from brandlens.operators import competitive, visibility

OBSERVED = "project_id string, run_id int, prompt_id int, completed_at timestamp, brand_mentioned boolean, recommended boolean, brand_citations int, brand_position int, brand_sentiment string, competitors array<string>"


def observed(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = []
    for project in ("p", "q", "none"):
        for run in range(20):
            rivals = (["a"] if run < 12 else []) + (["b"] if run < 4 else [])
            rows.append((project, run, run % 3, at, run < 6, run < 3, int(run < 6), 1 if run < 6 else None, "positive", rivals))
    return spark.createDataFrame(rows, OBSERVED)


def test_each_project_is_held_against_its_own_rivals(spark):
    configured = spark.createDataFrame([("p", "a"), ("q", "b"), ("q", "absent"), ("gone", "a")], "project_id string, entity string")
    got = {r.project_id: r.competitive_score for r in visibility.metric_block(observed(spark), ["project_id"], configured=configured).collect()}
    assert got == {"p": 50.0, "q": 100.0, "none": None}
    table = {(r.project_id, r.entity): (r.mentions, r.share_of_voice) for r in visibility.configured_table(observed(spark), configured).collect()}
    assert table == {("p", "brand"): (6, 33.0), ("p", "a"): (12, 67.0), ("q", "brand"): (6, 60.0), ("q", "b"): (4, 40.0), ("q", "absent"): (0, 0.0), ("none", "brand"): (6, 100.0)}


def test_metrics_of_configured_entities_equal_those_of_unfolded_views(spark):
    from pyspark.sql import functions as F

    responses = observed(spark).select("project_id", F.concat("project_id", F.col("run_id").cast("string")).alias("run_id"), "prompt_id")
    said = [(f"{p}{run}", e, 1 + run % 7, ["strong", "weak", "moderate"][run % 3], ["positive", "negative", "neutral"][run % 3], 1 + run % 2) for p in ("p", "q", "none") for run in range(20) for e in ("brand", "a", "b") if run % (2 + len(e)) == 0]
    mentions = spark.createDataFrame(said, "run_id string, entity string, position int, strength string, sentiment string, citations int")
    configured = spark.createDataFrame([("p", "a"), ("q", "b"), ("q", "absent")], "project_id string, entity string")
    entities = configured.unionByName(spark.createDataFrame([(p, "brand") for p in ("p", "q", "none")], "project_id string, entity string"))
    views = responses.join(entities, "project_id").join(mentions, ["run_id", "entity"], "left")
    views = views.withColumns({"mentioned": F.col("citations").isNotNull(), "recommended": F.coalesce(F.col("strength").isin("moderate", "strong") & (F.col("sentiment") != "negative"), F.lit(False)), "citations": F.coalesce("citations", F.lit(0))})
    want = competitive.entity_metrics(views, ["project_id"])
    got = competitive.configured_entity_metrics(responses, mentions, configured, ["project_id"])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 6


def test_no_rows_and_no_configuration(spark):
    none = spark.createDataFrame([], "project_id string, entity string")
    assert visibility.metric_block(observed(spark).limit(0), ["project_id"], configured=none).count() == 0
    assert {r.competitive_score for r in visibility.metric_block(observed(spark), ["project_id"], configured=none).collect()} == {None}
