"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stored, table, word_list

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Documents are strung together in runs of about this many, so that no running sum spans a whole source.
RUN_DOCS = 4096
#: Multipliers of the index permutations: primes drawn at random between 2^60 and 2^61, so each is coprime to any number of blocks below 2^60
#: and scattered in its remainder by it.
MULTIPLIERS = (1515665073089002789, 1765927476945937897, 1934600602352824613, 1947095076715992227, 1948607718847358267, 2169642410502133691, 2178702586197354667, 2212553262320489461)


def _number(*parts) -> Column:
    """A number below 2^52 that depends on nothing but the parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """128 bits for a document's id, source and text."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return F.md5(F.concat_ws("\x1f", known(doc_id), known(source), F.coalesce(text, F.lit(""))))


def _running(df: DataFrame, keys: list[str], at: str, n: str, fan: int = 1024) -> DataFrame:
    """df with `before`: the sum of n over the rows of the same keys with a lesser `at`, a number that each row of a key has once.

    Rows are summed in groups of `fan` values of `at` first, so that one task never orders all rows of a hot key.
    """
    rows = df.withColumn("_group", F.floor(F.col(at) / fan))
    sums = rows.groupBy(*keys, "_group").agg(F.sum(n).alias("_n"))
    starts = sums.select(*keys, "_group", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_group")) - F.col("_n")).alias("_start"))
    own = Window.partitionBy(*keys, "_group").orderBy(at)
    return rows.join(starts, [*keys, "_group"]).withColumn("before", F.col("_start") + F.sum(n).over(own) - F.col(n)).drop("_group", "_start")


def _within(points: DataFrame, at: str, intervals: DataFrame, cell: int) -> DataFrame:
    """points with the columns of the interval start <= at < end that holds each; points outside all are left out.

    Intervals and points meet on cells of `cell` places: an equi-join, in which a long interval has many cells.
    """
    cells = intervals.where("start < end").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    met = points.withColumn("_cell", F.floor(F.col(at) / cell)).join(cells, "_cell")
    return met.where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_cell")


def source_table(sizes: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: source, k, words, target, blocks, quota, start, end. sizes: source, words.

    k numbers the sources by code point, null last, and chooses the weight. Targets divide share of all words by weight;
    what is over `most` times a source's words goes to the others. With the sources in order of ceiling by weight the
    capped ones come first, so the scale of the others is the first that its own source's ceiling admits. quota is the
    target in blocks; [start, end) is the quota's place among all slots.
    """
    s = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("k") % len(weights) + 1))
    s = s.withColumn("ceiling", (F.col("words") * most).cast("double")).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    rank = Window.orderBy("ratio", "k")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    left = share * F.sum("words").over(rank.rowsBetween(start, end)) - F.coalesce(F.sum("ceiling").over(rank.rowsBetween(start, -1)), F.lit(0.0))
    s = s.withColumn("scale", left / F.sum("weight").over(rank.rowsBetween(0, end)))
    scale = F.first(F.when(F.col("scale") <= F.col("ratio"), F.col("scale")), True).over(rank.rowsBetween(start, end))
    s = s.withColumn("target", F.least(F.col("weight") * F.coalesce(scale, F.col("ratio")), "ceiling"))
    s = s.withColumn("blocks", F.ceil(F.col("words") / block))
    s = s.withColumn("quota", F.when(F.col("words") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("words") + 0.5), F.col("blocks") * most)).otherwise(0))
    s = s.withColumn("end", F.sum("quota").over(Window.orderBy("k").rowsBetween(start, 0)))
    return s.select("source", "k", "words", "target", "blocks", "quota", (F.col("end") - F.col("quota")).alias("start"), "end")


def block_uses(spark: SparkSession, sources: DataFrame, seed: int = 0) -> DataFrame:
    """k, block, epoch for each block that the mix takes. sources: a stored source_table.

    The output is a row of shards of SHARD_SLOTS blocks. Each shard draws a source for every slot with the quotas'
    probabilities: a multinomial count per source. Draws beyond a source's quota, numbered one after another, go to the
    sources that are short of theirs, so each source ends at its quota. A source's k-th draw takes block
    perm(k mod blocks) in epoch k div blocks, where perm is a permutation of its blocks for this epoch; as quotas are
    at most MAX_REPEATS times the blocks, a block is taken at most once an epoch and MAX_REPEATS times in all.
    Sources stay in tables of a row each; the driver learns the number of slots and of sources.
    """
    slots, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    cell = max(1, slots // max(1, 4 * n_sources))
    points = spark.range(0, slots, 1, max(1, min(-(-slots // SHARD_SLOTS), slots // 50_000 + 1)))
    points = points.select("id", F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.floor(_number(seed, "draw", F.col("id")) / float(1 << 52) * slots).alias("u"))
    draws = _within(points, "u", sources.select("k", "start", "end"), cell).select("id", "shard", "k")

    counts = stored(draws.groupBy("k", "shard").agg(F.count(F.lit(1)).alias("n")), "draws")
    firsts = _running(counts, ["k"], "shard", "n").select("k", "shard", "before")
    turn = F.col("before") + F.row_number().over(Window.partitionBy("k", "shard").orderBy("id")) - 1
    drawn = sources.join(counts.groupBy("k").agg(F.sum("n").alias("drawn")), "k", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    order = Window.orderBy("k")
    over, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    drawn = drawn.select("k", "blocks", "quota", "drawn", (F.sum(over).over(order) - over).alias("spare_from"), (F.sum(short).over(order) - short).alias("start"), F.sum(short).over(order).alias("end"))
    drawn = stored(drawn, "quotas")
    ranked = draws.join(firsts, ["k", "shard"]).select("k", "id", turn.alias("turn")).join(drawn.select("k", "blocks", "quota", "spare_from"), "k")

    kept = ranked.where("turn < quota").select("k", "blocks", "turn")
    spare = ranked.where("turn >= quota").select((F.col("spare_from") + F.col("turn") - F.col("quota")).alias("e"))
    gaps = drawn.select("k", "blocks", "drawn", "start", "end")
    moved = _within(spare, "e", gaps, max(1, cell // 64)).select("k", "blocks", (F.col("drawn") + F.col("e") - F.col("start")).alias("turn"))
    turns = kept.unionByName(moved).withColumn("epoch", F.floor(F.col("turn") / F.col("blocks")).cast("int"))
    return turns.select("k", permuted(F.col("turn") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("k"), F.col("epoch")).alias("block"), "epoch")


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, n < 2^60, chosen by the key: twice affine, with the halves' order turned between.

    Products are taken in 38-digit decimals, which hold them: both factors are below 2^60.
    """
    wide = lambda c: c.cast("decimal(19,0)")

    def affine(x: Column, salt: str) -> Column:
        factor = F.element_at(F.array(*(F.lit(m) for m in MULTIPLIERS)), (_number(salt, *key) % len(MULTIPLIERS) + 1).cast("int")) % n
        return ((wide(x) * wide(factor) + wide(_number(salt + "+", *key) % n)) % wide(n)).cast("long")

    one = affine(i, "a")
    odd_even = F.when(one % 2 == 0, F.floor(one / 2)).otherwise(n - 1 - F.floor(one / 2))
    return affine(odd_even, "b")


def plan_mix(docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = TOTAL_SHARE, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, sources, pieces) for docs with doc_id, source, text.

    keys: doc_id, source, size, row and how many copies there are, for each document; texts are read once for it.
    sources: see source_table. pieces: row, copy, epoch, from, to: the words of a document that the mix takes with each
    drawn block. In a source's token stream documents stand by their row keys, in runs: a run's start comes from the
    runs' sums, a document's from a running sum within its run, so no task orders more than a run, however large a
    source is. Copies of a row stand side by side.
    """
    size, row = n_words(F.col("text")).alias("size"), _row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("row")
    keys = stored(docs.select("doc_id", "source", size, row).groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    all_words = F.col("size") * F.col("copies")
    sources = stored(source_table(keys.groupBy("source").agg(F.sum(all_words).alias("words")), block, weights, share), "sources")

    runs = max(1, keys.count() // RUN_DOCS)
    run = F.shiftright(F.conv(F.substring("row", 1, 8), 16, 10).cast("long") * runs, 32)
    named = sources.select(F.col("source").alias("_s"), "k")
    rows = keys.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_s"))).select("k", "row", "size", "copies", run.alias("run"))
    firsts = _running(rows.groupBy("k", "run").agg(F.sum(all_words).alias("n")), ["k"], "run", "n").select("k", "run", "before")
    at = F.col("before") + F.sum(all_words).over(Window.partitionBy("k", "run").orderBy("row")) - all_words
    placed = rows.join(firsts, ["k", "run"]).select("k", "row", "size", "copies", at.alias("at"))
    placed = placed.select("k", "row", "size", "at", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    spans = placed.select("k", "row", "copy", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    pieces = spans.join(block_uses(docs.sparkSession, sources, seed), ["k", "block"]).select(
        "row", "copy", "epoch",
        (F.greatest(F.col("at"), F.col("block") * block) - F.col("at")).alias("from"),
        (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.col("at")).alias("to"),
    )
    return keys, sources, pieces


def mix(docs: DataFrame, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = TOTAL_SHARE, seed: int = 0) -> DataFrame:
    """The mixed corpus, with the columns of docs: in each epoch, every document with the words that the mix takes of it.

    A document whose blocks are all drawn in an epoch appears with its text as it is; one of which some blocks are
    drawn, with those words, joined by single spaces; else it does not appear. n_chars, where docs has it, follows the
    text. Edge cases: null or empty texts have no words and are never taken; a null source is a source of its own, last
    in order; a row that repeats id, source and text counts as often as it occurs, and all its copies appear with the
    other columns of one of them; documents of equal size or order are told apart by their row keys; columns of docs
    may have any names, as they travel in a struct; long texts are cut where they stand; an empty table gives none.
    """
    keys, _, pieces = plan_mix(docs.select("doc_id", "source", "text"), block, weights, share, seed)
    span = F.struct(F.col("from"), F.col("to"))
    taken = pieces.groupBy("row", "copy", "epoch").agg(F.array_sort(F.collect_list(span)).alias("_spans"), F.sum(F.col("to") - F.col("from")).alias("_taken"))
    taken = taken.join(keys.select("row", "size"), "row").select(F.col("row").alias("_row"), "_spans", (F.col("_taken") == F.col("size")).alias("_whole"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")).withColumn("_row", _row_key(F.col("_doc.doc_id"), F.col("_doc.source"), F.col("_doc.text")))
    repeated = keys.where("copies > 1").select(F.col("row").alias("_row"))
    once = rows.join(repeated, "_row", "left_anti").unionByName(rows.join(repeated, "_row", "left_semi").groupBy("_row").agg(F.first("_doc").alias("_doc")))
    words = word_list(F.col("_doc.text"))
    cut = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice("_words", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
    out = once.join(taken, "_row").withColumn("_words", F.when(~F.col("_whole"), words)).withColumn("_cut", F.when(~F.col("_whole"), cut).otherwise(F.col("_doc.text")))
    doc = F.col("_doc").withField("text", F.col("_cut"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.col("_whole"), F.col("_doc.n_chars")).otherwise(F.length("_cut").cast(docs.schema["n_chars"].dataType)))
    return out.select(doc.alias("_doc")).select("_doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, sources, pieces = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = pieces.groupBy("row", "copy").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    rows = keys.select("doc_id", "source", "size", "row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    named = sources.select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target")
    rows = rows.join(taken, ["row", "copy"], "left").join(named, F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))


def _sql() -> str:
    number = lambda *parts: f"('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:13])::BIGINT"

    def affine(x: str, salt: str) -> str:
        key = ("0", "k", "epoch")
        primes = f"[{', '.join(map(str, MULTIPLIERS))}]"
        return f"((({x})::HUGEINT * ({primes}[{number(f"'{salt}'", *key)} % {len(MULTIPLIERS)} + 1] % blocks) + {number(f"'{salt}+'", *key)} % blocks) % blocks)::BIGINT"

    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws(chr(31), coalesce('=' || doc_id::VARCHAR, ''), coalesce('=' || source, ''), coalesce(text, ''))) AS row
  FROM documents),
docs AS (SELECT *, row_number() OVER (PARTITION BY row) AS copy FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
s1 AS (SELECT *, {list(map(float, WEIGHTS))}[k % {len(WEIGHTS)} + 1]::DOUBLE AS weight, ({MAX_REPEATS} * words)::DOUBLE AS ceiling FROM s0),
s2 AS (
  SELECT *, ({TOTAL_SHARE}::DOUBLE * sum(words) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ceiling / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM s1),
s3 AS (SELECT *, least(weight * (SELECT arg_min(scale, (ceiling / weight, k)) FROM s2 WHERE scale <= ceiling / weight), ceiling) AS target, ceil(words / {BLOCK_WORDS})::BIGINT AS blocks FROM s2),
s4 AS (SELECT *, CASE WHEN words > 0 THEN least(floor(target * blocks / words + 0.5), blocks * {MAX_REPEATS}) ELSE 0 END::BIGINT AS quota FROM s3),
s AS (SELECT *, sum(quota) OVER (ORDER BY k)::BIGINT AS stop FROM s4),
slot AS (SELECT unnest(range(0, (SELECT sum(quota)::BIGINT FROM s))) AS id),
u AS (SELECT id, floor({number("0", "'draw'", "id")} / 4503599627370496.0::DOUBLE * (SELECT sum(quota) FROM s)::DOUBLE)::BIGINT AS u FROM slot),
draw AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS turn FROM u JOIN s ON u >= stop - quota AND u < stop),
q0 AS (SELECT s.k, blocks, quota, count(id) AS drawn FROM s LEFT JOIN draw USING (k) GROUP BY ALL),
q AS (
  SELECT *, sum(greatest(drawn - quota, 0)) OVER (ORDER BY k) - greatest(drawn - quota, 0) AS spare_from,
         sum(greatest(quota - drawn, 0)) OVER (ORDER BY k) AS gap_end, sum(greatest(quota - drawn, 0)) OVER (ORDER BY k) - greatest(quota - drawn, 0) AS gap_start FROM q0),
e AS (SELECT spare_from + turn - quota AS e FROM draw JOIN q USING (k) WHERE turn >= quota),
turns AS (
  SELECT k, blocks, turn FROM draw JOIN q USING (k) WHERE turn < quota
  UNION ALL SELECT k, blocks, drawn + e - gap_start FROM e JOIN q ON e >= gap_start AND e < gap_end),
t AS (SELECT k, blocks, (turn // blocks)::INTEGER AS epoch, turn % blocks AS i FROM turns),
p1 AS (SELECT *, {affine("i", "a")} AS one FROM t),
p2 AS (SELECT *, CASE WHEN one % 2 = 0 THEN one // 2 ELSE blocks - 1 - one // 2 END AS odd_even FROM p1),
uses AS (SELECT k, epoch, {affine("odd_even", "b")} AS block FROM p2),
placed AS (
  SELECT s.k, row, copy, size, sum(size) OVER (PARTITION BY s.k ORDER BY row, copy ROWS UNBOUNDED PRECEDING) - size AS place
  FROM docs JOIN s ON docs.source IS NOT DISTINCT FROM s.source WHERE size > 0),
spans AS (SELECT *, unnest(range((place // {BLOCK_WORDS})::BIGINT, ((place + size - 1) // {BLOCK_WORDS})::BIGINT + 1)) AS block FROM placed),
taken AS (
  SELECT row, copy, sum(least(place + size, (block + 1) * {BLOCK_WORDS}) - greatest(place, block * {BLOCK_WORDS}))::BIGINT AS taken
  FROM spans JOIN uses USING (k, block) GROUP BY row, copy)
SELECT doc_id, size, s.words AS source_size, round(s.target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken
FROM docs JOIN s ON docs.source IS NOT DISTINCT FROM s.source LEFT JOIN taken USING (row, copy)
"""


OP10_SQL = _sql()
