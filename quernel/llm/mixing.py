"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Every source gets a target number of words by water filling. A document of a source would be taken target / size times;
the whole part is certain, and the fractional parts are rounded together: two documents of a source trade probability,
in proportion to their sizes so that the expected words stay exactly the same, until one of them is 0 or 1. The other
goes on to the next trade. Trades happen in chunks of about 32 documents dealt out by hash; a chunk leaves one fractional
document at most, and these residuals are dealt out again, level by level, until a source has one left, which is drawn.
So a source's words miss its target by less than one document's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

_ITEM = "struct<source:string,doc_id:bigint,size:bigint,m:bigint,base:bigint,p:double>"

_FOLD = f"""
aggregate(items, named_struct('cur', cast(null as {_ITEM}), 'done', cast(array() as array<{_ITEM}>)), (a, x) ->
  if(a.cur is null, named_struct('cur', x, 'done', a.done),
    transform(transform(array(named_struct('i', a.cur, 'j', x,
        'up', least(1 - a.cur.p, x.p * x.size / a.cur.size), 'down', least(a.cur.p, (1 - x.p) * x.size / a.cur.size),
        'u', pmod(xxhash64(a.cur.doc_id, a.cur.size, x.doc_id, x.size, SEED), 2147483648) / 2147483648.0D)),
      t -> named_struct('t', t, 'rises', t.u * (t.up + t.down) < t.down)),
      s -> if(if(s.rises, s.t.up >= 1 - s.t.i.p, s.t.down >= s.t.i.p),
        named_struct(
          'cur', named_struct('source', s.t.j.source, 'doc_id', s.t.j.doc_id, 'size', s.t.j.size, 'm', s.t.j.m, 'base', s.t.j.base,
            'p', greatest(0.0D, least(1.0D, s.t.j.p + if(s.rises, -s.t.up, s.t.down) * s.t.i.size / s.t.j.size))),
          'done', concat(a.done, array(named_struct('source', s.t.i.source, 'doc_id', s.t.i.doc_id, 'size', s.t.i.size, 'm', s.t.i.m, 'base', s.t.i.base + if(s.rises, 1L, 0L), 'p', 0.0D)))),
        named_struct(
          'cur', named_struct('source', s.t.i.source, 'doc_id', s.t.i.doc_id, 'size', s.t.i.size, 'm', s.t.i.m, 'base', s.t.i.base,
            'p', greatest(0.0D, least(1.0D, s.t.i.p + if(s.rises, s.t.up, -s.t.down)))),
          'done', concat(a.done, array(named_struct('source', s.t.j.source, 'doc_id', s.t.j.doc_id, 'size', s.t.j.size, 'm', s.t.j.m, 'base', s.t.j.base + if(s.rises, 0L, 1L), 'p', 0.0D))))))[0]))
"""


def words_in(text: str = "text") -> F.Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size and target of a table (source, source_size) with one row for each source.

    Sources in code point order, null last, weigh 1, 2, 3 and so on again. All targets together are all sizes together; none
    is over `most` times its source's size, and what would be is shared again by weight. These are windows over one row
    for each source.
    """
    ranked = sizes.withColumn("w", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    # The first source, from the soonest full on, that its level does not fill: there the water stands.
    leveled = leveled.withColumn("stands", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(F.col("stands") * F.col("w"), F.col("cap"))).alias("target"))


def plan(docs: DataFrame, scratch: Scratch, seed: int = 17, most: float = 3.0, text: str = "text") -> DataFrame:
    """source, doc_id, size, m (rows that repeat these three), copies (of all m together), source_size, target.

    Null and empty texts have size 0 and nothing to take; null sources are a source of their own; rows with one doc_id,
    source and size are one item with m rows. Empty tables give an empty plan. Rounding hashes ids and the seed, so reruns agree.
    """
    items = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), words_in(text).alias("size"))
    items = scratch.keep(items.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")))
    # Tables with a row for each source are written, so that Spark knows their size: small ones are broadcast and no row is dealt
    # by its source, large ones meet the rows in joins that it can split.
    goals = scratch.keep(targets(items.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size")), most))
    share = goals.select(F.col("source").alias("s"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("share"))
    ideal = items.join(share, F.col("source").eqNullSafe(F.col("s"))).withColumn("ideal", F.col("m") * F.col("share"))
    near = F.abs(F.col("ideal") - F.round("ideal")) < 1e-9
    ideal = ideal.withColumn("base", F.when(near, F.round("ideal")).otherwise(F.floor("ideal")).cast("bigint"))
    # Cheap to make again from the written items, so it isn't written itself.
    ideal = ideal.select("source", "doc_id", "size", "m", "base", F.when(near | (F.col("size") == 0), 0.0).otherwise(F.col("ideal") - F.col("base")).alias("p"))
    decided, open_ = ideal.where("p = 0"), ideal.where("p > 0")
    for level in range(64):
        counts = scratch.keep(open_.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n")))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        dealt = open_.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("chunk", F.expr(f"pmod(xxhash64(doc_id, size, {seed}, {level}), ceil(n / 32.0))"))
        chunks = dealt.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("doc_id", "size", F.lit(seed + level)).alias("h"), "doc_id", "size", "source", "m", "base", "p"))).alias("found"))
        chunks = chunks.select(F.expr("transform(found, x -> named_struct('source', x.source, 'doc_id', x.doc_id, 'size', x.size, 'm', x.m, 'base', x.base, 'p', x.p))").alias("items"))
        folded = chunks.select(F.expr(_FOLD.replace("SEED", f"{seed}, {level}")).alias("f"))
        folded = scratch.keep(folded.select(F.explode(F.expr("concat(f.done, array(named_struct('source', f.cur.source, 'doc_id', f.cur.doc_id, 'size', f.cur.size, 'm', f.cur.m, 'base', f.cur.base, 'p', nullif(f.cur.p, 0.0D))))")).alias("x")).select("x.source", "x.doc_id", "x.size", "x.m", "x.base", F.coalesce("x.p", F.lit(0.0)).alias("p")))
        decided, open_ = decided.unionByName(folded.where("p = 0")), folded.where("p > 0")
    last = open_.withColumn("base", F.col("base") + F.expr(f"if(pmod(xxhash64(doc_id, size, {seed}), 2147483648) / 2147483648.0D < p, 1L, 0L)"))
    goals = goals.withColumnRenamed("source", "s")
    return decided.unionByName(last).join(goals, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "size", "m", F.col("base").alias("copies"), "source_size", "target")


def each_row() -> F.Column:
    """Copies of the j-th of m rows: the copies shared out evenly, the rest to the first rows."""
    return (F.floor(F.col("copies") / F.col("m")) + F.when(F.col("j") <= F.col("copies") % F.col("m"), 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, scratch: Scratch, **options: int) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every row."""
    rows = plan(docs, scratch, **options).withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")))
    return rows.select("doc_id", "size", "source_size", "target", (each_row() * F.col("size")).alias("taken"))


#: Rows of one id, source and size that are numbered in one task, about.
TOGETHER = 100_000


def mixed(docs: DataFrame, scratch: Scratch, text: str = "text", **options: int) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns and no others, whatever their names.

    Null and empty texts have no words and are not taken. Rows that repeat an id, source and size share their copies, the first
    of them in the order of the input one more; they are numbered in parts, so that no such group fills a task. An empty table
    gives an empty one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), words_in(text).alias("size"), F.monotonically_increasing_id().alias("place"), row.alias("row"))
    done = scratch.keep(plan(docs, scratch, text=text, **options).where("copies > 0"))
    key = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("source", "doc_id", "size")]
    met = keyed.alias("k").join(done.alias("d"), key).select("k.*", "m", "copies")
    once = met.where("m = 1").select("row", "copies")
    again = done.where("m > 1")
    if again.limit(1).count():
        # Their number within a part, and the parts before it.
        dealt = keyed.alias("k").join(again.alias("d"), key).select("k.*", "m", "copies").withColumn("part", F.pmod(F.xxhash64("place"), F.ceil(F.col("m") / TOGETHER)))
        sizes = dealt.groupBy("source", "doc_id", "size", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source", "doc_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        numbered = dealt.withColumn("j", F.row_number().over(Window.partitionBy("source", "doc_id", "size", "part").orderBy("place")))
        placed = numbered.alias("k").join(offsets.alias("d"), [*key, F.col("k.part") == F.col("d.part")]).select("k.row", "k.copies", "k.m", (F.col("k.j") + F.col("d.before")).alias("j"))
        once = once.unionByName(placed.select("row", each_row().alias("copies")))
    return once.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
