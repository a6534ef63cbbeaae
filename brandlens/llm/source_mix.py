"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL expressions alone.

Rows of a source form blocks of ``block_rows``. The j-th block of a source with share w of all weights is released in slot
floor((j - 1) / w) and due by slot ceil(j / w). In every slot the released block with the earliest deadline goes next. As
the shares add up to 1, every block goes within its window, so each source that still has blocks is less than one block
away from its share of the slots, however many there are.

Slots are cut into spans that are scheduled side by side in many tasks. No window is longer than a span: a span starts
from what the span before leaves over, which follows from that span's blocks and from how many older ones were waiting when it began.
Those are due before the later span, so for it only their number counts, and the number follows from counts of releases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm.spark_files import with_checkpoint_dir

#: Least slots of a span, rows of a block, sources with a weight of their own, hash buckets a source is ranked in.
CYCLE, BLOCK_ROWS, MAX_SOURCES, BUCKET_DIGITS = 1000, 16, 10_000, 3
#: Weights are whole parts of about 2 to this power in all; blocks of one source that a task lists; steps of an inner fold.
PART_BITS, RANGE, PIECE = 40, 1 << 16, 256


def source_quotas(docs: DataFrame, weights: dict[str | None, float] | None, exponent: float, cycle: int, max_sources: int) -> DataFrame:
    """source_no, source, pooled, n, w, quota: whole slots of one cycle for each source, at least 1, ``cycle`` in all.

    w is the weight itself, not normed. Weights are the given ones, or row counts to the power ``exponent``. Sources beyond the ``max_sources`` with most rows,
    and with given weights all sources not named, share one pool (pooled = true).
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is not None:
        given = F.create_map(*[x for s, w in weights.items() if s is not None for x in (F.lit(s), F.lit(float(w)))]) if any(s is not None for s in weights) else None
        own = F.element_at(given, F.col("source")) if given is not None else F.lit(None).cast("double")
        if None in weights:
            own = F.when(F.col("source").isNull(), F.lit(float(weights[None]))).otherwise(own)
        counts = counts.withColumn("w", own)
    else:
        counts = counts.withColumn("w", F.lit(None).cast("double"))
    top = counts.where(F.col("w").isNotNull()) if weights is not None else counts
    top = top.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(max_sources).select("source", "n", "w", F.lit(False).alias("pooled"))
    # what the named sources leave over, in one row
    left_over = counts.select("n").unionAll(top.select(-F.col("n"))).agg(F.sum("n").alias("n"))
    pool = left_over.where("n > 0").select(F.lit(None).cast("string").alias("source"), "n", F.lit(None).cast("double").alias("w"), F.lit(True).alias("pooled"))
    rest = max(0.0, 1.0 - sum((weights or {}).values()))
    if weights is not None:
        weight = F.when(F.col("pooled"), F.lit(rest)).otherwise(F.col("w"))
    elif exponent == 0.5:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    weighted = top.unionByName(pool).select("source", "pooled", "n", weight.alias("w"))
    # at most max_sources + 1 rows from here on, in one array: largest remainders make the quotas whole
    return docs.sparkSession.sql(f"""
        WITH one AS (
          SELECT array_sort(collect_list(named_struct('pooled', pooled, 'less', -n, 'none', source IS NULL, 'source', source, 'w', w))) AS a FROM {{weighted}}
        ), totals AS (
          SELECT a, size(a) AS many, aggregate(a, CAST(0 AS DOUBLE), (t, x) -> t + coalesce(x.w, CAST(0 AS DOUBLE))) AS total FROM one
        ), shared AS (
          SELECT transform(a, (x, i) -> named_struct('source_no', i + 1, 'x', x, 'share',
                   CASE WHEN total > 0 THEN ({cycle} - many) * coalesce(x.w, CAST(0 AS DOUBLE)) / total ELSE ({cycle} - many) / CAST(many AS DOUBLE) END)) AS s FROM totals
        ), whole AS (
          SELECT s, slice(transform(array_sort(transform(s, x -> named_struct('less', floor(x.share) - x.share, 'source_no', x.source_no))), x -> x.source_no),
                          1, {cycle} - aggregate(s, 0, (t, x) -> t + 1 + CAST(floor(x.share) AS INT))) AS more FROM shared
        ), rows AS (SELECT explode(s) AS r, more FROM whole)
        SELECT r.source_no, r.x.source AS source, r.x.pooled AS pooled, -r.x.less AS n, coalesce(r.x.w, CAST(0 AS DOUBLE)) AS w,
               1 + CAST(floor(r.share) AS INT) + CASE WHEN array_contains(more, r.source_no) THEN 1 ELSE 0 END AS quota
        FROM rows""", weighted=weighted)


def _picks(quotas: str, cycle: str) -> str:
    """SQL: the index that each slot of a cycle goes to, earliest deadline first among the released blocks."""
    return f"""aggregate(
            sequence(0, CAST({cycle} AS INT) - 1),
            named_struct('served', transform({quotas}, x -> 0), 'order', cast(array() AS array<int>)),
            (state, slot) -> transform(
              array(array_min(filter(transform({quotas}, (q, i) ->
                CASE WHEN state.served[i] < q AND (state.served[i] * {cycle}) div q <= slot
                     THEN struct(((state.served[i] + 1) * {cycle} + q - 1) div q AS due, i AS i) END), x -> x IS NOT NULL)).i),
              pick -> named_struct('served', transform(state.served, (c, i) -> c + CASE WHEN i = pick THEN 1 ELSE 0 END),
                                   'order', concat(state.order, array(pick))))[0]
          ).order"""


def cycle_schedule(quotas: DataFrame, cycle: int) -> DataFrame:
    """source_no, block (0-based within the cycle), slot: earliest deadline first among the released blocks."""
    picks = quotas.sparkSession.sql(f"""
        WITH one AS (SELECT transform(array_sort(collect_list(struct(source_no, quota))), x -> x.quota) AS a FROM {{quotas}})
        SELECT {_picks("a", str(cycle))} AS picks FROM one""", quotas=quotas)
    # the schedule has ``cycle`` rows
    return quotas.sparkSession.sql("""
        SELECT source_no, CAST(row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS INT) AS block_in_cycle, slot
        FROM (SELECT posexplode(picks) AS (slot, pick), pick + 1 AS source_no FROM {picks})""", picks=picks)


def weight_parts(quotas: DataFrame, least_span: int, block_rows: int) -> DataFrame:
    """source_no, blocks, parts, whole, start, span: a source has ``parts`` of ``whole`` slots from slot ``start`` on.

    Parts are the weights times a power of 2, rounded to whole numbers: a share is off by 2^-39 for each source at most. Sources without a
    positive weight start when the others have ended and share the slots evenly. ``span`` is longer than every window.
    """
    # at most max_sources + 1 rows in one array
    return quotas.sparkSession.sql(f"""
        WITH one AS (SELECT transform(collect_list(struct(source_no, w, n)), x -> named_struct('source_no', x.source_no, 'blocks', (x.n + {block_rows - 1}) div {block_rows},
                       'w', CASE WHEN x.w > 0 THEN x.w ELSE CAST(0 AS DOUBLE) END)) AS a FROM {{quotas}}),
        summed AS (SELECT a, aggregate(a, CAST(0 AS DOUBLE), (t, x) -> t + x.w) AS total FROM one WHERE size(a) > 0),
        scaled AS (SELECT a, CASE WHEN total >= 1 THEN pow(2D, {PART_BITS} - length(bin(CAST(ceil(total) AS BIGINT))))
                                  WHEN total > 0 THEN pow(2D, {PART_BITS - 1} + length(bin(CAST(floor(least(1 / total, 1e18D)) AS BIGINT)))) ELSE 1D END AS scale FROM summed),
        parted AS (SELECT filter(p, x -> x.weighted) AS a, filter(p, x -> NOT x.weighted) AS late FROM (
                     SELECT transform(a, x -> named_struct('source_no', x.source_no, 'blocks', x.blocks, 'weighted', x.w > 0,
                              'parts', greatest(1L, CAST(floor(x.w * scale + 0.5D) AS BIGINT)))) AS p FROM scaled)),
        whole AS (SELECT *, aggregate(a, 0L, (t, x) -> t + x.parts) AS w FROM parted),
        ended AS (SELECT *, coalesce(array_max(transform(a, x -> (CAST(x.blocks AS DECIMAL(19,0)) * CAST(w AS DECIMAL(14,0)) + x.parts - 1) div x.parts)), 0L) AS end,
                         greatest({least_span}L, size(late) + 2L, coalesce(array_max(transform(a, x -> w div x.parts + 3)), 0L)) AS span FROM whole)
        SELECT r.source_no AS source_no, r.blocks AS blocks, r.parts AS parts, r.whole AS whole, r.start AS start, span FROM (
          SELECT span, explode(concat(
            transform(a, x -> named_struct('source_no', x.source_no, 'blocks', x.blocks, 'parts', x.parts, 'whole', w, 'start', 0L)),
            transform(late, x -> named_struct('source_no', x.source_no, 'blocks', x.blocks, 'parts', 1L, 'whole', CAST(size(late) AS BIGINT), 'start', end)))) AS r FROM ended)""", quotas=quotas)


def whole_schedule(quotas: DataFrame, least_span: int, block_rows: int) -> DataFrame:
    """source_no, block, slot of every block that the sources have, against the weights themselves.

    Work grows with the blocks, not with the slots: a span without any is never made. A task holds the blocks of two spans, where a span has as
    many slots as the longest window: about 1 / (the least share) or ``least_span``.
    """
    spark = quotas.sparkSession
    with_checkpoint_dir(spark)
    ranges = spark.sql(f"SELECT *, explode(sequence(0L, blocks - 1, {RANGE}L)) AS first FROM {{parts}}", parts=weight_parts(quotas, least_span, block_rows)).repartition("source_no", "first")
    released = spark.sql(f"""
        SELECT release div span AS at, release, span, sort_array(collect_list(struct(due, source_no, block))) AS blocks FROM (
          SELECT span, source_no, block, start + (CAST(block AS DECIMAL(19,0)) * CAST(whole AS DECIMAL(14,0))) div parts AS release,
                 start + (CAST(block + 1 AS DECIMAL(19,0)) * CAST(whole AS DECIMAL(14,0)) + parts - 1) div parts AS due
          FROM (SELECT *, explode(sequence(first, least(first + {RANGE - 1}, blocks - 1))) AS block FROM {{ranges}}))
        GROUP BY release, span""", ranges=ranges)
    # read three times below
    spans = spark.sql("SELECT at, span, sort_array(collect_list(struct(release, blocks))) AS events FROM {released} GROUP BY at, span", released=released).checkpoint()
    # of each span how many blocks it releases, and the least of (released in it before r) - r over its releases r
    counted = spark.sql("""
        SELECT at, span, c.n AS n, c.least AS least FROM (
          SELECT at, span, aggregate(events, named_struct('n', 0L, 'least', 9223372036854775807L),
                   (s, e) -> named_struct('n', s.n + size(e.blocks), 'least', least(s.least, s.n - e.release))) AS c FROM {spans})""", spans=spans)
    # three numbers for each span: the blocks that wait as it begins
    waiting = spark.sql("""
        SELECT at, greatest(0L, coalesce(before - at * span - min(before + least) OVER (ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)) AS waiting
        FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before FROM {counted})""", counted=counted)
    steps = spark.sql("""
        WITH both AS (SELECT s.*, w.waiting FROM {spans} s JOIN {waiting} w ON s.at = w.at),
        pairs AS (SELECT c, span, array_sort(collect_list(struct(at, waiting, events))) AS p FROM (SELECT *, explode(array(at, at + 1)) AS c FROM both) GROUP BY c, span),
        joined AS (SELECT c, span, concat(
            array(named_struct('release', (c - 1) * span, 'blocks', CASE WHEN p[0].at = c - 1 AND p[0].waiting > 0
                    THEN array_repeat(named_struct('due', -1L, 'source_no', -1, 'block', -1L), CAST(p[0].waiting AS INT)) ELSE slice(p[0].events[0].blocks, 1, 0) END)),
            flatten(transform(p, x -> x.events))) AS e FROM pairs)
        SELECT c, span, transform(e, (x, i) -> named_struct('release', x.release, 'room', coalesce(get(e, i + 1).release, (c + 1) * span) - x.release, 'blocks', x.blocks)) AS e FROM joined""",
        spans=spans, waiting=waiting)
    # between two releases the waiting blocks go in the order of their deadlines; the outer fold keeps the copied lists short
    one = """transform(array(sort_array(concat(s.ready, e.blocks))), r -> transform(array(CAST(least(CAST(size(r) AS BIGINT), e.room) AS INT)), k -> named_struct(
                'ready', slice(r, k + 1, size(r)), 'out', concat(s.out, array(named_struct('slot', e.release, 'blocks', slice(r, 1, k))))))[0])[0]"""
    return spark.sql(f"""
        WITH cut AS (SELECT c, span, slice(e[0].blocks, 1, 0) AS nothing, transform(sequence(0, (size(e) - 1) div {PIECE}), k -> slice(e, k * {PIECE} + 1, {PIECE})) AS pieces FROM {{steps}}),
        typed AS (SELECT *, slice(array(named_struct('slot', 0L, 'blocks', nothing)), 1, 0) AS none FROM cut),
        folded AS (SELECT c, span, explode(flatten(aggregate(pieces, named_struct('ready', nothing, 'outs', slice(array(none), 1, 0)),
            (o, piece) -> transform(array(aggregate(piece, named_struct('ready', o.ready, 'out', none), (s, e) -> {one})),
                                    d -> named_struct('ready', d.ready, 'outs', concat(o.outs, array(d.out))))[0]).outs)) AS g FROM typed)
        SELECT b.source_no AS source_no, b.block AS block, slot FROM (
          SELECT c, span, g.slot + i AS slot, b FROM folded LATERAL VIEW posexplode(g.blocks) AS i, b)
        WHERE slot >= c * span AND b.source_no >= 0""", steps=steps)


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.5,
    cycle: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """All columns of ``docs`` with mix_source_no, mix_block (0-based in its source), mix_slot and mix_position.

    mix_position orders all rows; after any number of slots, each source that has not ended is less than one block away
    from its share of them. With a given ``cycle`` the pattern repeats after so many slots
    instead, and each source is within one block of its quota of it, which only approximates the weight. Every row has
    exactly one place: when a source ends, the others keep their windows and slots that nothing is released for stay
    empty. Sources of no positive weight come after all others.
    Rows of a source come in the order of md5(doc_id), then doc_id; rows of one id are in no particular order. Null is a
    source like any other, a null id is ordered as an empty one; an empty table gives an empty result; columns named
    like the added ones are replaced. A source is ranked in hash buckets whose counts add up, so no task gets a whole one.
    """
    added = ("mix_source_no", "mix_block", "mix_slot", "mix_position")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    with_checkpoint_dir(docs.sparkSession)
    # a row for each source, read three times below
    quotas = source_quotas(docs.select("source"), weights, exponent, cycle or CYCLE, max_sources).checkpoint()
    pool_no = quotas.where("pooled").select(F.col("pooled").alias("_pooled"), F.col("source_no").alias("_pool"), F.col("quota").alias("_pool_quota"))
    named = quotas.where("NOT pooled").select(F.col("source").alias("_source"), F.col("source_no").alias("_no"), F.col("quota").alias("_quota"))
    # at most max_sources rows and one row: bounded broadcasts
    keyed = (
        docs.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_pooled", F.col("_no").isNull())
        .join(F.broadcast(pool_no), "_pooled", "left")
        .withColumn("mix_source_no", F.coalesce("_no", "_pool"))
        .withColumn("_quota", F.coalesce("_quota", "_pool_quota"))
        .drop("_source", "_no", "_pool", "_pooled", "_pool_quota")
        .withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    )
    counts = keyed.groupBy("mix_source_no", "_bucket").agg(F.count("*").alias("_rows"))
    before = docs.sparkSession.sql("""
        SELECT mix_source_no, _bucket, coalesce(sum(_rows) OVER (PARTITION BY mix_source_no ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before
        FROM {counts}""", counts=counts)
    ranked = docs.sparkSession.sql("SELECT *, row_number() OVER (PARTITION BY mix_source_no, _bucket ORDER BY _hash, doc_id) AS _in_bucket FROM {keyed}", keyed=keyed)
    rank = F.col("_before") + F.col("_in_bucket") - 1
    placed = ranked.join(before, ["mix_source_no", "_bucket"]).withColumn("_rank", rank).withColumn("mix_block", F.expr(f"_rank div {block_rows}"))
    if cycle is None:
        # a row for each block: Spark decides by size
        schedule = whole_schedule(quotas, CYCLE, block_rows).withColumnsRenamed({"source_no": "mix_source_no", "block": "mix_block", "slot": "mix_slot"})
        slotted = placed.join(schedule, ["mix_source_no", "mix_block"])
    else:
        # the schedule has ``cycle`` rows
        schedule = cycle_schedule(quotas, cycle).withColumnsRenamed({"source_no": "mix_source_no", "block_in_cycle": "_block_in_cycle", "slot": "_slot"})
        placed = placed.withColumn("_block_in_cycle", F.expr("CAST(mix_block % _quota AS INT)"))
        slotted = placed.join(F.broadcast(schedule), ["mix_source_no", "_block_in_cycle"]).withColumn("mix_slot", F.expr(f"(mix_block div _quota) * {cycle} + _slot"))
    return slotted.withColumn("mix_position", F.expr(f"mix_slot * {block_rows} + _rank % {block_rows}")).select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


OP1_SQL = f"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source NULLS LAST) AS no,
                    sqrt(CAST(n AS DOUBLE)) * pow(2, {PART_BITS} - length(bin(CAST(ceil(sum(sqrt(CAST(n AS DOUBLE))) OVER ()) AS BIGINT)))) AS w FROM counted),
lists AS (SELECT list(greatest(1, CAST(floor(w + 0.5) AS HUGEINT)) ORDER BY no) AS p, list((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} ORDER BY no) AS n FROM weighted),
whole AS (SELECT p, n, list_sum(p)::HUGEINT AS total FROM lists),
slots AS (
  SELECT CAST(-1 AS HUGEINT) AS slot, CAST(0 AS BIGINT) AS pick, list_transform(p, lambda x: CAST(0 AS BIGINT)) AS served, p, n, total FROM whole
  UNION ALL
  SELECT now, i, list_transform(range(1, len(p) + 1), lambda k: served[k] + CASE WHEN k = i THEN 1 ELSE 0 END), p, n, total
  FROM (SELECT *, list_min(list_filter(list_transform(range(1, len(p) + 1), lambda k:
            CASE WHEN served[k] < n[k] AND (served[k] * total) // p[k] <= now
                 THEN (((served[k] + 1) * total + p[k] - 1) // p[k]) * 100000 + k END), lambda x: x IS NOT NULL)) % 100000 AS i
        FROM (SELECT *, greatest(slot + 1, list_min(list_filter(list_transform(range(1, len(p) + 1), lambda k:
                CASE WHEN served[k] < n[k] THEN (served[k] * total) // p[k] END), lambda x: x IS NOT NULL))) AS now
              FROM slots WHERE list_sum(served) < list_sum(n)))
), schedule AS (
  SELECT pick AS no, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM slots WHERE slot >= 0
), ranked AS (
  SELECT d.doc_id, d.source, t.no, row_number() OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1 AS r
  FROM documents d JOIN weighted t ON d.source IS NOT DISTINCT FROM t.source)
SELECT p.doc_id, p.source, s.block, CAST(s.slot AS BIGINT) AS slot, CAST(s.slot * {BLOCK_ROWS} + p.r % {BLOCK_ROWS} AS BIGINT) AS position
FROM ranked p JOIN schedule s ON s.no = p.no AND s.block = p.r // {BLOCK_ROWS}
"""
