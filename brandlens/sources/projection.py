"""Domain tables over the star schema: prompts, runs, citations, mentions, sources.

Every table is a lazy projection of the driver's tables; nothing is written. A tenant is a project (a region).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandlens.functions.ladders import STRENGTHS, folded_sentiment, sentiment_of, strength_of, strength_rank
from brandlens.shared_files import new_shared_folder

#: The moment of analysis; the data end the day before.
NOW = "2001-08-02"
CATEGORIES = {"BUILDING": "comparison", "AUTOMOBILE": "recommendation", "MACHINERY": "pricing", "HOUSEHOLD": "discovery", "FURNITURE": "industry"}
STAGES = ("awareness", "consideration", "decision", "purchase", "retention")
DOMAIN_TYPES = ("company", "media", "review", "community", "directory", "government", "education", "social", "forum", "blog", "research", "other", "unknown")
SENTIMENT_BY = ("positive", "neutral", "negative", "mixed", "unknown")
STRENGTH_BY = ("unknown", "strong", "moderate", "weak", "none")
COMPETITORS = tuple(f"comp{i}" for i in range(5))
BRAND = "brand"


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


#: What the columns of a citation are made of.
RAW_CITATION = ("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")


def _stated(line: Column, domain: Column, page: Column, flag: Column) -> dict[str, Column]:
    """The columns of a citation but its response."""
    kind = domain % 5
    return {
        "position": line,
        "domain_id": domain,
        "page_id": page,
        "is_brand": F.when(kind == 1, (flag == "A") & (line == 1)).when(kind == 2, flag == "A").when(kind == 3, True).when(kind == 4, (flag == "A") & (page % 3 == 0)).otherwise(False),
        "is_competitor": F.when((kind == 0) | (kind == 2), flag == "R").when(kind == 1, flag != "A").otherwise(False),
        "competitor": F.concat(F.lit("comp"), (page % 5).cast("string")),
        "sentiment": pick(page % 5, SENTIMENT_BY),
        "strength": pick(domain % 5, STRENGTH_BY),
    }


def _whole(raw: Column) -> Column:
    """A citation as a struct, of one of its raw columns."""
    return F.named_struct(*[x for k, c in _stated(*[raw[name] for name in RAW_CITATION]).items() for x in (F.lit(k), c)])


class Projection:
    """The domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def now() -> Column:
        return F.lit(NOW).cast("timestamp_ntz")

    def ago(self, days: int) -> Column:
        return self.now() - F.expr(f"INTERVAL '{days}' DAY")

    @cached_property
    def prompts(self) -> DataFrame:
        category = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
        return self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("prompt_id"),
            F.col("n_regionkey").alias("project_id"),
            F.element_at(category, F.col("c_mktsegment")).alias("category"),
            pick(F.col("c_nationkey") % 5, STAGES).alias("funnel_stage"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("prompt_id"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("completed_at"),
            F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
            F.col("o_orderpriority").alias("provider"),
            F.concat(F.col("o_orderpriority"), F.lit("/m"), (F.col("o_orderkey") % 2).cast("string")).alias("model"),
            F.when(F.col("o_orderkey") % 17 != 0, "v1").alias("parser_version"),
        )

    @cached_property
    def eligible(self) -> DataFrame:
        """Completed runs whose response is parsed, with their prompt."""
        return self.runs.where((F.col("status") == "completed") & F.col("parser_version").isNotNull()).join(self.prompts, "prompt_id")

    def eligible_between(self, start: Column, end: Column) -> DataFrame:
        return self.eligible.where((F.col("completed_at") >= start) & (F.col("completed_at") < end))

    @cached_property
    def citations(self) -> DataFrame:
        """Every citation with its relationship flags; the response gives time and project."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("run_id"), *[c.alias(k) for k, c in _stated(*[F.col(c) for c in RAW_CITATION]).items()])

    @cached_property
    def domains(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("domain_id"),
            F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example")).alias("domain"),
            pick(F.col("s_nationkey") % 13, DOMAIN_TYPES).alias("domain_type"),
            (F.col("s_suppkey") % 10 == 0).alias("is_authority"),
        )

    def cited(self, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """Citations of eligible responses, of a half-open time window if one is given."""
        runs = self.eligible if start is None else self.eligible_between(start, end)
        return self.citations.join(runs.select("run_id", "prompt_id", "project_id", "category", "funnel_stage", "provider", F.col("completed_at").alias("cited_at")), "run_id")

    @cached_property
    def observations(self) -> DataFrame:
        """One row for each eligible response: what it says about the brand, and the competitors it mentions.

        Mentions and citations are pre-aggregated to the response before they join it.
        """
        ours, theirs = F.col("is_brand"), F.col("is_competitor")
        per_run = self.citations.where(ours | theirs).groupBy("run_id").agg(
            F.min(F.when(ours & (F.col("position") <= 6), F.col("position"))).alias("brand_position"),
            strength_of(F.max(F.when(ours, strength_rank(F.col("strength"))))).alias("brand_strength"),
            folded_sentiment(F.when(ours, F.col("sentiment"))).alias("brand_sentiment"),
            F.count_if(ours).alias("brand_citations"),
            F.array_sort(F.collect_set(F.when(theirs, F.col("competitor")))).alias("competitors"),
        )
        mentioned = F.coalesce(F.col("brand_citations") > 0, F.lit(False))
        return self.eligible.join(per_run, "run_id", "left").withColumns(
            {
                "brand_mentioned": mentioned,
                "brand_citations": F.coalesce("brand_citations", F.lit(0)),
                "brand_sentiment": F.coalesce("brand_sentiment", F.lit("unknown")),
                "brand_strength": F.coalesce("brand_strength", F.lit("unknown")),
                "recommended": mentioned & F.coalesce(F.col("brand_strength").isin("moderate", "strong") & (F.col("brand_sentiment") != "negative"), F.lit(False)),
                "competitors": F.coalesce("competitors", F.expr("cast(array() AS array<string>)")),
            }
        )

    @cached_property
    def configured(self) -> DataFrame:
        """project_id, entity: the competitors that each project has configured; some projects have none."""
        nation = F.col("n_nationkey")
        return self.table("nation").where((nation % 3 != 0) & (F.col("n_regionkey") != 4)).select(F.col("n_regionkey").alias("project_id"), F.concat(F.lit("comp"), (nation % 7).cast("string")).alias("entity")).distinct()

    @cached_property
    def entity_mentions(self) -> DataFrame:
        """What each response says about each entity that it mentions. Gathered before it joins: one shuffle by response."""
        entity = F.filter(F.array(F.when(F.col("is_brand"), F.lit(BRAND)), F.when(F.col("is_competitor"), F.col("competitor"))), lambda x: x.isNotNull())
        return (
            self.citations.where("is_brand OR is_competitor")
            .repartition("run_id")
            .select("run_id", F.explode(entity).alias("entity"), "position", "strength", "sentiment")
            .groupBy("run_id", "entity")
            .agg(
                F.min(F.when(F.col("position") <= 6, F.col("position"))).alias("position"),
                strength_of(F.max(strength_rank(F.col("strength")))).alias("strength"),
                folded_sentiment(F.col("sentiment")).alias("sentiment"),
                F.count("*").alias("citations"),
            )
        )

    @cached_property
    def entity_views(self) -> DataFrame:
        """Response by entity (the brand and every configured competitor): what the response says about it.

        What a response says is gathered by entity before it joins, and the entities are unfolded after: one shuffle of
        mentions and one of responses, both by response.
        """
        facts = F.struct("entity", F.struct("position", "strength", "sentiment", "citations").alias("v"))
        per_run = self.entity_mentions.groupBy("run_id").agg(F.map_from_entries(F.collect_list(facts)).alias("said"))
        every = self.eligible.join(per_run, "run_id", "left").withColumn("entity", F.explode(F.array(*[F.lit(e) for e in (BRAND, *COMPETITORS)])))
        v = F.try_element_at("said", F.col("entity"))
        return every.select("*", *[v[c].alias(c) for c in ("position", "strength", "sentiment", "citations")]).drop("said").withColumns(
            {"mentioned": F.col("citations").isNotNull(), "recommended": is_recommended(), "citations": F.coalesce("citations", F.lit(0))}
        )


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Gathered(Projection):
    """The same tables over one stored table: every eligible response with all that it cites.

    Citations and responses are shuffled once, to store it, and not again for each table made of them. What holds for a
    response is worked out on its row. Every run_id is on one row.
    """

    #: Citations are compared with all others of their response.
    MOST_CITATIONS = 1000

    def __init__(self, spark: SparkSession, sf_dir: str, responses: DataFrame):
        super().__init__(spark, sf_dir)
        self.responses = responses

    @classmethod
    def of(cls, plain: Projection) -> Projection:
        """``plain`` gathered; or itself if a run_id repeats, since its responses would be counted apart, or a response cites very much."""
        raw = plain.table("lineitem").select(F.col("l_orderkey").alias("run_id"), *RAW_CITATION).where("run_id IS NOT NULL")
        said = raw.repartition("run_id").groupBy("run_id").agg(F.collect_list(F.struct(*RAW_CITATION)).alias("raw"))
        runs = plain.eligible.select("run_id", "prompt_id", "project_id", "category", "funnel_stage", "provider", "completed_at")
        folder = new_shared_folder(plain.spark)
        with _shuffle_files_removed(plain.spark):
            runs.join(said, "run_id", "left").withColumn("rows", F.count("*").over(Window.partitionBy("run_id"))).write.option("compression", "zstd").parquet(folder)
        stored = plain.spark.read.parquet(folder)
        return cls(plain.spark, plain.sf_dir, stored.drop("rows")) if stored.where((F.col("rows") > 1) | (F.size("raw") > cls.MOST_CITATIONS)).isEmpty() else plain

    @cached_property
    def eligible(self) -> DataFrame:
        return self.responses.drop("raw")

    @cached_property
    def _said(self) -> DataFrame:
        """Responses with their citations as an array, null if there is none."""
        return self.responses.withColumn("said", F.transform("raw", _whole)).drop("raw")

    def cited(self, start: Column | None = None, end: Column | None = None, **firsts: Callable[[Column], Column]) -> DataFrame:
        """As ever; ``firsts`` adds columns: whether a citation is the first of its response that has its value, none if that is null."""
        runs = self.responses.where("raw IS NOT NULL")
        if start is not None:
            runs = runs.where((F.col("completed_at") >= start) & (F.col("completed_at") < end))
        values = lambda f: F.transform("raw", lambda c: f(_whole(c)))
        rows = runs.select("*", *[values(f).alias(f"_{k}") for k, f in firsts.items()], F.posexplode("raw").alias("_at", "_c"))
        return rows.select(
            "run_id", *[c.alias(k) for k, c in _stated(*[F.col("_c")[name] for name in RAW_CITATION]).items()], "prompt_id", "project_id", "category", "funnel_stage", "provider", F.col("completed_at").alias("cited_at"),
            *[F.coalesce(F.array_position(F.col(f"_{k}"), F.get(f"_{k}", F.col("_at"))) == F.col("_at") + 1, F.lit(False)).alias(k) for k in firsts],
        )

    @cached_property
    def observations(self) -> DataFrame:
        ours, theirs = F.filter("said", lambda c: c["is_brand"]), F.filter("said", lambda c: c["is_competitor"])
        named = F.array_sort(F.array_distinct(F.array_compact(F.transform(theirs, lambda c: c["competitor"]))))
        rows = self._said.select(*self.eligible.columns, ours.alias("_ours"), F.coalesce(named, F.expr("cast(array() AS array<string>)")).alias("competitors"))
        v = _folded(F.col("_ours"))
        mentioned = F.col("brand_citations") > 0
        return rows.select(*self.eligible.columns, "competitors", *[v[c].alias(f"brand_{c}") for c in ("position", "strength", "sentiment", "citations")]).withColumns(
            {
                "brand_mentioned": mentioned,
                "brand_sentiment": F.coalesce("brand_sentiment", F.lit("unknown")),
                "brand_strength": F.coalesce("brand_strength", F.lit("unknown")),
                "recommended": mentioned & F.coalesce(F.col("brand_strength").isin("moderate", "strong") & (F.col("brand_sentiment") != "negative"), F.lit(False)),
            }
        )

    @cached_property
    def entity_views(self) -> DataFrame:
        every = self._said.withColumn("entity", F.explode(F.array(*[F.lit(e) for e in (BRAND, *COMPETITORS)])))
        own = F.filter("said", lambda c: F.when(F.col("entity") == BRAND, c["is_brand"]).otherwise(c["is_competitor"] & (c["competitor"] == F.col("entity"))))
        v = _folded(F.col("_own"))
        rows = every.select(*self.eligible.columns, "entity", own.alias("_own"))
        views = rows.select(*self.eligible.columns, "entity", *[F.when(v["citations"] > 0, v[c]).alias(c) for c in ("position", "strength", "sentiment", "citations")])
        return views.withColumns({"mentioned": F.col("citations").isNotNull(), "recommended": is_recommended(), "citations": F.coalesce("citations", F.lit(0))})


def _folded(said: Column) -> dict[str, Column]:
    """What a response says of one entity, of the array of its citations that do."""
    has = lambda s: F.coalesce(F.exists(said, lambda c: c["sentiment"] == s), F.lit(False))
    return {
        "position": F.array_min(F.transform(F.filter(said, lambda c: c["position"] <= 6), lambda c: c["position"])),
        "strength": strength_of(F.array_max(F.transform(said, lambda c: strength_rank(c["strength"])))),
        "sentiment": sentiment_of(has),
        "citations": F.coalesce(F.size(said), F.lit(0)).cast("bigint"),
    }


def is_recommended() -> Column:
    """Of a response's view of an entity: mentioned at least moderately and not negatively."""
    return F.col("citations").isNotNull() & F.coalesce(F.col("strength").isin("moderate", "strong") & (F.col("sentiment") != "negative"), F.lit(False))


assert set(STRENGTH_BY) == set(STRENGTHS)

#: The same tables as DuckDB common table expressions.
CTES = """
prompts AS (
  SELECT c_custkey AS prompt_id, n_regionkey AS project_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'comparison' WHEN 'AUTOMOBILE' THEN 'recommendation' WHEN 'MACHINERY' THEN 'pricing' WHEN 'HOUSEHOLD' THEN 'discovery' WHEN 'FURNITURE' THEN 'industry' END AS category,
    CASE c_nationkey % 5 WHEN 0 THEN 'awareness' WHEN 1 THEN 'consideration' WHEN 2 THEN 'decision' WHEN 3 THEN 'purchase' ELSE 'retention' END AS funnel_stage
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS prompt_id, o_orderdate AS completed_at, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
    o_orderpriority AS provider, o_orderpriority || '/m' || (o_orderkey % 2) AS model, CASE WHEN o_orderkey % 17 <> 0 THEN 'v1' END AS parser_version
  FROM orders),
eligible AS (SELECT r.*, p.project_id, p.category, p.funnel_stage FROM runs r JOIN prompts p USING (prompt_id) WHERE status = 'completed' AND parser_version IS NOT NULL),
citations AS (
  SELECT l_orderkey AS run_id, l_linenumber AS position, l_suppkey AS domain_id, l_partkey AS page_id,
    CASE l_suppkey % 5 WHEN 0 THEN false WHEN 1 THEN l_returnflag = 'A' AND l_linenumber = 1 WHEN 2 THEN l_returnflag = 'A' WHEN 3 THEN true ELSE l_returnflag = 'A' AND l_partkey % 3 = 0 END AS is_brand,
    CASE l_suppkey % 5 WHEN 0 THEN l_returnflag = 'R' WHEN 1 THEN l_returnflag <> 'A' WHEN 2 THEN l_returnflag = 'R' ELSE false END AS is_competitor,
    'comp' || (l_partkey % 5) AS competitor,
    CASE l_partkey % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' WHEN 3 THEN 'mixed' ELSE 'unknown' END AS sentiment,
    CASE l_suppkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'strong' WHEN 2 THEN 'moderate' WHEN 3 THEN 'weak' ELSE 'none' END AS strength
  FROM lineitem),
domains AS (
  SELECT s_suppkey AS domain_id, lower(replace(s_name, '#', '-')) || '.example' AS domain,
    CASE s_nationkey % 13 WHEN 0 THEN 'company' WHEN 1 THEN 'media' WHEN 2 THEN 'review' WHEN 3 THEN 'community' WHEN 4 THEN 'directory' WHEN 5 THEN 'government' WHEN 6 THEN 'education' WHEN 7 THEN 'social' WHEN 8 THEN 'forum' WHEN 9 THEN 'blog' WHEN 10 THEN 'research' WHEN 11 THEN 'other' ELSE 'unknown' END AS domain_type,
    s_suppkey % 10 = 0 AS is_authority
  FROM supplier),
configured AS (SELECT DISTINCT n_regionkey AS project_id, 'comp' || (n_nationkey % 7) AS entity FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey <> 4),
cited AS (SELECT c.*, e.prompt_id, e.project_id, e.category, e.funnel_stage, e.provider, e.completed_at AS cited_at FROM citations c JOIN eligible e USING (run_id)),
ranked AS (SELECT *, CASE strength WHEN 'unknown' THEN 0 WHEN 'none' THEN 1 WHEN 'weak' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END AS strength_no FROM citations),
said AS (
  SELECT run_id, entity, min(CASE WHEN position <= 6 THEN position END) AS position, max(strength_no) AS strength_no, count(*) AS citations,
    CASE WHEN bool_or(sentiment = 'mixed') OR (bool_or(sentiment = 'positive') AND bool_or(sentiment = 'negative')) THEN 'mixed' WHEN bool_or(sentiment = 'negative') THEN 'negative' WHEN bool_or(sentiment = 'positive') THEN 'positive' WHEN bool_or(sentiment = 'neutral') THEN 'neutral' ELSE 'unknown' END AS sentiment
  FROM (SELECT *, 'brand' AS entity FROM ranked WHERE is_brand UNION ALL SELECT *, competitor AS entity FROM ranked WHERE is_competitor) GROUP BY run_id, entity),
entities AS (SELECT unnest(['brand', 'comp0', 'comp1', 'comp2', 'comp3', 'comp4']) AS entity),
views AS (
  SELECT e.*, n.entity, s.position, s.strength_no, s.sentiment, s.run_id IS NOT NULL AS mentioned, coalesce(s.citations, 0) AS citations,
    s.run_id IS NOT NULL AND s.strength_no >= 3 AND s.sentiment <> 'negative' AS recommended
  FROM eligible e CROSS JOIN entities n LEFT JOIN said s ON s.run_id = e.run_id AND s.entity = n.entity)
"""
