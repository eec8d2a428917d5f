"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 36-bit hash of its id, its text's digest and its rank among
equal rows.  Tokens are summed by source and hash bucket (12 bits at a time);
the bucket in which a source's budget runs out is refined by the next 12 bits,
and only that bucket's documents are read again.  After three levels the
threshold has full resolution and one comparison per document decides, without
any sort of documents.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somaflow.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVEL_BITS = 12
LEVELS = 3
#: A table of sources up to this many rows (a long, a string and four numbers each) is broadcast.
BROADCAST_SOURCES = 50_000
#: A table of the keys of repeated rows up to this many (a string of 32 bytes each) is broadcast.
BROADCAST_KEYS = 100_000


def row_key(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """A digest of id, source and whole text, nulls apart from empty ones; equal rows share it."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(part(F.col(doc_id)), part(F.col(source)), part(F.col(text))))


def position_hash(key: Column, rank: Column) -> Column:
    """36 bits of md5 over a row's key and its rank among the rows of that key."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), rank.cast("string"))), 1, 9), 16, 10).cast("long")


def _named(docs: DataFrame, columns: list[str], size: Column | None = None) -> DataFrame:
    """_row (the columns, so that none of their names can clash), _source, _key, and _size if given."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("_"))
    return docs.select(row.alias("_row"), F.col("source").alias("_source"), row_key().alias("_key"), *([] if size is None else [size.alias("_size")]))


def _ranked(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` with _hash; rows of one of the ``n`` repeated keys are numbered, in an order that is left open.

    Only those rows are moved.  They are counted by the file that they are read
    from, so that no task gets all rows of a key: a row's rank is its place in
    its file after the rows of all files before.
    """
    if not n:
        return rows.withColumn("_hash", position_hash(F.col("_key"), F.lit(0)))
    small = F.broadcast(keys) if n <= BROADCAST_KEYS else keys
    here = F.col("_key") == F.col("_k")
    single = rows.join(small, here, "left_anti").withColumn("_rank", F.lit(0).cast("long"))
    again = written(rows.join(small, here, "left_semi"), "mix-again").withColumn("_part", F.input_file_name())
    parts = written(again.groupBy("_key", "_part").agg(F.count("*").alias("_n")), "mix-parts")
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    parts = parts.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(F.lit(0)))
    again = again.withColumn("_place", place).join(parts, (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_p")))
    both = single.unionByName(again.withColumn("_rank", F.col("_before") + F.col("_place") - 1).select(*single.columns))
    return both.withColumn("_hash", position_hash(F.col("_key"), F.col("_rank"))).drop("_rank")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words of each source, by water-filling.

    ``sizes`` has (_source, _source_size).  Weights repeat over the sources in
    code-point order, null last.  Sources are met in the order of the level at
    which they reach ``repeats`` times their size; one is full if the budget
    left by those before it, shared by weight, would exceed that.  The window
    spans one row per source, not documents.
    """
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)).cast("long"))
    cap = F.lit(repeats) * F.col("_source_size")
    by_level = Window.orderBy((cap / F.col("_weight")), F.col("_source").isNull(), F.col("_source"))
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = ranked.select(
        "*",
        F.sum("_source_size").over(all_rows).alias("_total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("_used"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_gone"),
        F.sum("_weight").over(all_rows).alias("_weights"),
    ).withColumn("_full", (F.col("_total") - F.col("_used")) * F.col("_weight") > cap * (F.col("_weights") - F.col("_gone")))
    level = filled.select(
        "*",
        F.sum(F.when(F.col("_full"), cap).otherwise(0)).over(all_rows).alias("_capped"),
        F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(all_rows).alias("_open"),
    )
    target = F.when(F.col("_full"), cap.cast("double")).otherwise((F.col("_total") - F.col("_capped")).cast("double") * F.col("_weight") / F.col("_open"))
    return level.select("_source", "_source_size", target.alias("_target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _plan(rows: DataFrame, weights: tuple[int, ...], repeats: int):
    """From rows with _source, _size and _hash, a function that joins each source's numbers and _copies to rows with _source and _hash."""
    shift = LEVEL_BITS * (LEVELS - 1)
    histogram = written(
        rows.groupBy("_source", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").alias("_words")), "mix-histogram"
    )
    sizes = histogram.groupBy("_source").agg(F.sum("_words").alias("_source_size"))
    small = F.broadcast if sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda df: df)

    plan = source_targets(sizes, weights, repeats)
    whole = F.when(F.col("_source_size") > 0, F.least(F.floor(F.col("_target") / F.col("_source_size")), F.lit(repeats))).otherwise(0).cast("long")
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.greatest(F.col("_target") - (F.col("_whole") * F.col("_source_size")).cast("double"), F.lit(0.0)))
    plan = written(plan.withColumn("_low", F.lit(0).cast("long")).withColumn("_below", F.lit(0).cast("long")), "mix-targets")

    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        if level:
            p = small(plan.select(F.col("_source").alias("_s"), F.col("_low").alias("_l")))
            inside = rows.join(p, _same(F.col("_source"), F.col("_s")) & (F.shiftright("_hash", shift + LEVEL_BITS) == F.col("_l")))
            histogram = inside.groupBy("_source", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").alias("_words"))
        running = Window.partitionBy("_source").orderBy("_bucket")
        sums = histogram.select("_source", "_bucket", "_words", (F.sum("_words").over(running) - F.col("_words")).alias("_before")).select(
            F.col("_source").alias("_s"), "_bucket", "_words", "_before"
        )
        # the last bucket that starts within the budget is the boundary; at the last level its
        # documents share one hash and come in whole if that ends nearer to the budget
        met = plan.drop("_words").join(sums, _same(F.col("_source"), F.col("_s"))).where(F.col("_below") + F.col("_before") <= F.col("_rest"))
        edge = met.groupBy("_source", "_source_size", "_target", "_whole", "_rest").agg(
            F.max(F.struct("_bucket", (F.col("_below") + F.col("_before")).alias("_below"), "_words")).alias("_edge")
        )
        plan = edge.select(
            "_source", "_source_size", "_target", "_whole", "_rest",
            F.col("_edge._bucket").alias("_low"), F.col("_edge._below").alias("_below"), F.col("_edge._words").alias("_words"),
        )
        if level == LEVELS - 1:
            nearer = (F.col("_below") + F.col("_words")).cast("double") - F.col("_rest") < F.col("_rest") - F.col("_below").cast("double")
            plan = plan.withColumn("_cut", F.when(nearer, F.col("_low") + 1).otherwise(F.col("_low")))
        plan = written(plan, f"mix-level{level}")

    final = small(plan.select(F.col("_source").alias("_s"), "_source_size", "_target", "_whole", "_cut"))
    copies = F.least(F.col("_whole") + (F.col("_hash") < F.col("_cut")).cast("long"), F.lit(repeats).cast("long"))
    return lambda rows: rows.join(final, _same(F.col("_source"), F.col("_s"))).withColumn("_copies", copies)


def _decided(docs: DataFrame, weights: tuple[int, ...], repeats: int, keep: list[str]):
    """(rows with _row, _source, _size and _hash; the function of their plan; the repeated keys; how many)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(_named(docs, keep, words), "mix-sizes")
    keys = rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_k"))
    keys = written(keys, "mix-repeated")
    n = keys.count()
    rows = _ranked(rows, keys, n)
    rows = written(rows, "mix-ranked") if n else rows
    return rows, _plan(rows, weights, repeats), keys, n


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, keep: list[str] | None = None) -> DataFrame:
    """How often each document is taken so that sources reach their targets.

    Returns the columns ``keep`` (default: doc_id) plus _size, _source_size,
    _target and _copies, one row per input row; clashing names of ``keep`` are
    replaced.  Defined results: a null text has size 0; documents of size 0 are
    taken as their hash says and add nothing; a null source is a source of its
    own; rows that are equal in id, source and text are numbered and may be
    taken differently often, any of them more often; a source without words
    has target 0; an empty table gives no rows.
    """
    names = ["_size", "_source_size", "_target", "_copies"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in names]
    rows, plan, _, _ = _decided(docs, weights, repeats, keep)
    return plan(rows).select("_row.*", *names)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: every document as many times as it is taken, all its columns kept, whatever their names.

    A document's own hash and the small table of sources decide, so that no
    text is moved but those of rows that stand more than once.  Defined results
    are those of ``mix``.
    """
    _, plan, keys, n = _decided(docs, weights, repeats, [])
    taken = plan(_ranked(_named(docs, docs.columns), keys, n)).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken")
    )


def _capped_rounds(rounds: int) -> str:
    """Water-filling the other way round for the oracle: share, cap what is above, share again."""
    step = """, r{n} AS (
  SELECT r.*, r.full OR (tot - sum(CASE WHEN r.full THEN cap ELSE 0 END) OVER ()) * w > cap * (sum(CASE WHEN r.full THEN 0 ELSE w END) OVER ()) AS nfull FROM (SELECT s, ss, w, cap, tot, {full} AS full FROM r{m}) r)"""
    return reduce(lambda text, n: text + step.format(n=n, m=n - 1, full="nfull" if n > 1 else "full0"), range(1, rounds + 1), "")


_PARTS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "text"))
#: The rounds are at most the sources that can be full; the test tables have 20 sources.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(md5({_PARTS}) || '/' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)), 1, 9))::BIGINT AS h
  FROM documents),
z AS (SELECT s, sum(size)::BIGINT AS ss FROM d GROUP BY s),
r0 AS (
  SELECT s, ss, [5, 2, 1][((row_number() OVER (ORDER BY s IS NULL, s) - 1) % 3 + 1)::INT]::BIGINT AS w,
         3 * ss AS cap, sum(ss) OVER ()::BIGINT AS tot, FALSE AS full0 FROM z){_capped_rounds(12)},
t AS (
  SELECT s, ss, CASE WHEN nfull THEN cap::DOUBLE ELSE
    (tot - sum(CASE WHEN nfull THEN cap ELSE 0 END) OVER ())::BIGINT::DOUBLE * w::DOUBLE / (sum(CASE WHEN nfull THEN 0 ELSE w END) OVER ())::BIGINT::DOUBLE END AS target
  FROM r12),
p AS (SELECT *, CASE WHEN ss > 0 THEN least(floor(target / ss), 3)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT s, h, sum(size)::BIGINT AS words FROM d GROUP BY s, h),
c AS (
  SELECT g.s, h, words, (sum(words) OVER (PARTITION BY g.s ORDER BY h) - words)::DOUBLE AS below, greatest(target - (whole * ss)::DOUBLE, 0) AS rest
  FROM g JOIN p ON g.s IS NOT DISTINCT FROM p.s),
e AS (
  SELECT s, max(h) AS edge, arg_max(CASE WHEN below + words - rest < rest - below THEN 1 ELSE 0 END, h) AS more
  FROM c WHERE below <= rest GROUP BY s)
SELECT d.doc_id, d.size, p.ss AS source_size, p.target,
       d.size * least(p.whole + CASE WHEN d.h < e.edge + e.more THEN 1 ELSE 0 END, 3) AS taken
FROM d JOIN p ON d.s IS NOT DISTINCT FROM p.s JOIN e ON d.s IS NOT DISTINCT FROM e.s
"""
