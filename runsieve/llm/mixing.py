"""Operator 1: mix sources to integer target weights by Pfair block scheduling.

Weights q_s are integers with sum Q, one block a slot.  Block i (from 0) of
source s may not run before slot floor(i*Q/q_s) and must have run before slot
ceil((i+1)*Q/q_s).  Earliest-deadline-first over released blocks keeps every
window, so after t slots source s has had more than t*q_s/Q - 1 and fewer than
t*q_s/Q + 1 blocks.  All lags are zero at slot Q, so the schedule has period Q
and only one period is folded; every block's slot follows from its number alone.

Only DataFrame functions are used.  A source's rows are ordered by a seeded hash
and numbered within hash ranges whose offsets come from prefix sums, so a source
that holds most rows is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Rows in a block, and rows that a hash range should hold.
BLOCK_ROWS = 64
RANGE_ROWS = 1_000
SEED = "mix-1"

#: The fold: at each slot, of the sources whose next block is released, the one
#: with the earliest deadline (the first by name on ties) runs.
_FOLD = """
aggregate(
  sequence(0L, q - 1),
  named_struct('done', transform(s, x -> 0L), 'picked', cast(array() AS array<int>)),
  (st, t) -> aggregate(
    array(array_min(filter(
      transform(s, (x, j) -> named_struct(
        'deadline', ((st.done[j] + 1) * q + x.weight - 1) div x.weight,
        'j', j,
        'release', (st.done[j] * q) div x.weight)),
      c -> c.release <= t)).j),
    st,
    (u, j) -> named_struct(
      'done', transform(u.done, (d, i) -> if(i = j, d + 1, d)),
      'picked', concat(u.picked, array(j)))),
  st -> st.picked)
"""


def default_weight(source: Column) -> Column:
    """Production weights of the query: src<i> has 1 + i % 5, any other source 1."""
    number = F.regexp_extract(source, r"^src(\d{1,9})$", 1)
    return F.when(number != "", 1 + F.when(number != "", number).cast("long") % 5).otherwise(F.lit(1)).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """One period for the rows (source, weight, n_rows), as one row; weights below 1 raise.

    Returns q (slots in a period), peers: (source, weight, n_rows, slots, done)
    of every source, where slots are its slots in one period, ascending, and
    done[t] counts those before slot t.
    Sources are few (their names fit a row); their rows are not touched here.
    No sources give no row.
    """
    one = sources.select("source", F.col("weight").cast("long").alias("weight"), "n_rows").groupBy()
    one = one.agg(F.array_sort(F.collect_list(F.struct("source", "weight", "n_rows"))).alias("s"))
    one = one.filter(F.size("s") > 0).withColumn("q", F.expr("aggregate(s, 0L, (t, x) -> t + x.weight)"))
    one = one.filter(F.expr("forall(s, x -> coalesce(x.weight >= 1, false)) or raise_error('weights must be at least 1')"))
    one = one.withColumn("picked", F.expr(_FOLD))
    slots = "filter(transform(picked, (p, t) -> if(p = j, cast(t AS long), NULL)), v -> v IS NOT NULL)"
    done = "transform(sequence(0L, q - 1), t -> cast(size(filter(y.slots, v -> v < t)) AS long))"
    one = one.withColumn("p", F.expr(f"transform(s, (x, j) -> named_struct('x', x, 'slots', {slots}))"))
    return one.select(
        "q",
        F.expr(
            "transform(p, y -> named_struct('source', y.x.source, 'weight', y.x.weight, 'n_rows', y.x.n_rows, "
            f"'slots', y.slots, 'done', {done}))"
        ).alias("peers"),
    )


def mix(
    docs: DataFrame,
    weight=default_weight,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    range_rows: int = RANGE_ROWS,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Place every row of docs in the mixed stream.

    Returns (id, source, source_row, block_no, slot, position, in_mix), one row
    for each row of docs, whatever else docs holds:

    * source_row: the row's number (from 0) within its source, in the order of
      md5(seed:id); repeated ids take neighbouring numbers;
    * block_no = source_row div block_rows; slot: the block's place in the EDF
      schedule that never runs out;
    * position: the row's place (from 0) in the stream once the slots of spent
      sources close up: 0 .. rows - 1, each once;
    * in_mix: every source still had a block at this slot, so that up to here
      no source is a block or more away from its target.

    The columns named in keep follow as they are, each with its own row (other
    than a join by id would have it, also where ids repeat or are null).  A null
    source counts as the source ''.  A null id is hashed as ''.  An empty table
    gives no rows.
    """
    return _placed(docs, weight, id_col, source_col, block_rows, range_rows, seed, keep).select(
        "id", "source", "source_row", "block_no", "slot", "position", "in_mix", *[F.col(f"kept.`{c}`") for c in keep]
    )


def _placed(docs, weight, id_col, source_col, block_rows, range_rows, seed, keep) -> DataFrame:
    """mix() with the kept columns in one struct `kept`."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        *[F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")][: len(keep)],
    )
    ranges = max(1, -(-rows.count() // range_rows))
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("h", h)
    high = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("r", F.shiftright(high * F.lit(ranges), 32).cast("int"))

    per_range = rows.groupBy("source", "r").agg(F.count("*").alias("n"))
    per_range = materialise(per_range, "mix_ranges")
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # ranges, not rows
    offsets = per_range.select("source", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = per_range.groupBy("source").agg(F.sum("n").alias("n_rows"))
    # One row, whatever the number of documents; it reaches the tasks as a value.
    plan = materialise(schedule(totals.withColumn("weight", weight(F.col("source")))), "mix_plan")
    spent = f"""array_min(transform(peers, p -> p.n_rows div {block_rows} div p.weight * q
      + p.slots[cast(p.n_rows div {block_rows} % p.weight AS int)]))"""
    plan = plan.select(F.struct("q", F.expr(spent).alias("first_spent"), "peers").alias("plan")).scalar()

    within = Window.partitionBy("source", "r").orderBy("h", "id")
    numbered = rows.withColumn("k", F.row_number().over(within) - 1)
    out = numbered.join(offsets.hint("merge"), ["source", "r"]).withColumn("plan", plan)
    out = out.withColumn("source_row", F.col("before") + F.col("k"))
    out = out.withColumn("block_no", F.floor(F.col("source_row") / block_rows))
    out = out.withColumn("own", F.expr("filter(plan.peers, p -> p.source = source)[0].slots"))
    turn, place = F.expr("block_no div size(own)"), F.expr("own[cast(block_no % size(own) AS int)]")
    out = out.withColumn("slot", turn * F.col("plan.q") + place)
    # Rows ahead: of each source, its blocks in earlier slots, or all its rows.
    ahead = F.expr(
        f"""aggregate(plan.peers, 0L, (t, p) -> t + least(p.n_rows, {block_rows}L * (
              (slot div plan.q) * p.weight + p.done[cast(slot % plan.q AS int)])))"""
    )
    return out.withColumns({"position": ahead + F.col("source_row") % block_rows, "in_mix": F.col("slot") < F.col("plan.first_spent")})


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, in the order of the mixed stream.

    All columns stay as they are, whatever their names; rows without an id, or
    that repeat one, each have a place of their own.  An empty table stays empty.
    """
    columns = tuple(docs.columns)
    placed = _placed(docs, default_weight, "doc_id", "source", BLOCK_ROWS, RANGE_ROWS, SEED, columns)
    ordered = placed.select("position", "kept").repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*[F.col(f"kept.`{c}`") for c in columns])


#: The same in DuckDB: the schedule of one period by a recursive query.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '')
           ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS source_row
  FROM documents),
w AS (
  SELECT source, count(*) AS n_rows,
         CASE WHEN regexp_full_match(source, 'src[0-9]{{1,9}}')
              THEN 1 + CAST(substr(source, 4) AS BIGINT) % 5 ELSE 1 END AS weight
  FROM d GROUP BY source),
s AS (
  SELECT list({{'weight': weight, 'n_rows': n_rows}} ORDER BY source) AS s,
         CAST(sum(weight) AS BIGINT) AS q, list(source ORDER BY source) AS names FROM w),
fold AS (
  SELECT CAST(-1 AS BIGINT) AS t, -1 AS j, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS done FROM s
  UNION ALL
  SELECT t + 1, pick, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END)
  FROM (
    SELECT t, done, list_aggregate(list_transform(list_filter(range(1, len(done) + 1),
             lambda i: (done[i] * q) // s[i].weight <= t + 1),
             lambda i: {{'d': ((done[i] + 1) * q + s[i].weight - 1) // s[i].weight, 'j': i}}), 'min').j AS pick
    FROM fold, s WHERE t + 1 < q)),
slots AS (
  SELECT names[j] AS source, list(t ORDER BY t) AS slots FROM fold, s WHERE j > 0 GROUP BY 1),
plan AS (SELECT w.*, slots.slots, s.q FROM w JOIN slots USING (source), s),
peers AS (SELECT list({{'weight': weight, 'n_rows': n_rows, 'slots': slots, 'q': q}}) AS peers FROM plan),
placed AS (
  SELECT doc_id, d.source, source_row, source_row // {BLOCK_ROWS} AS block_no,
         (source_row // {BLOCK_ROWS} // plan.weight) * q + slots[source_row // {BLOCK_ROWS} % plan.weight + 1] AS slot, q
  FROM d JOIN plan ON d.source = plan.source),
spent AS (
  SELECT min(n_rows // {BLOCK_ROWS} // weight * q + slots[n_rows // {BLOCK_ROWS} % weight + 1]) AS first_spent FROM plan)
SELECT doc_id, source, source_row, block_no, slot,
       row_number() OVER (ORDER BY slot, source_row) - 1 AS position,
       slot < first_spent AS in_mix
FROM placed, spent
"""
