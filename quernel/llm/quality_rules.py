"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

Counts of a text give rates (symbols, repeated lines, repeated windows, long words). For each rate and stratum a cutoff
is picked from a fixed grid: labelled documents that pass the base rules are a holdout, and a cutoff is admissible where
the exact binomial test shows that it rejects less than the allowed share of good documents: with k of n good documents
above it, P(Bin(n, share) <= k) is at most delta divided by the number of all tests (strata x rates x cutoffs), so all
chosen cutoffs hold at once with probability 1 - delta. Rates share the allowed false rejection evenly. Among admissible
cutoffs that reject more bad than good labelled documents, the one with the largest difference wins, ties to the more
lenient; where none is, the rate rejects nothing in that stratum.

That is what the SQL of op4_quality_rules states, and it needs about 1,600 good documents in a stratum. The pipeline takes
the joint cutoffs instead (joint_cutoffs), under the same bound: the bad labels alone put the cutoffs in an order, and the
good ones test the joint rejection of the first 1, 2, ... of them until a test fails, so only strata share delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch

#: Rates and the grid of cutoffs of each, set beforehand and never fitted.
GRIDS: dict[str, list[float]] = {
    "symbol_rate": [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.5],
    "dup_line_rate": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
}

#: Words in 8-word windows that occur twice or more: windows are hashed, and only where hashes repeat are the windows
#: themselves sorted and compared. A list bound by transform(array(...), x -> ...) is made once.
_REPEATED = """
transform(array(words), w -> if(size(w) < 9, 0L,
  if(size(array_distinct(transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))))) = size(w) - 7, 0L,
    transform(array(array_sort(transform(sequence(1, size(w) - 7), i -> named_struct('k', array_join(slice(w, i, 8), ' '), 'p', i)))), s ->
      transform(array(array_sort(transform(filter(s, (x, j) -> (j > 0 and s[greatest(j - 1, 0)].k = x.k) or (j + 1 < size(s) and s[least(j + 1, size(s) - 1)].k = x.k)), x -> x.p))), p ->
        if(size(p) = 0, 0L, aggregate(sequence(0, size(p) - 1), 0L, (n, j) -> n + if(j + 1 = size(p), 8, least(8, p[least(j + 1, size(p) - 1)] - p[j])))))[0])[0])))[0]
"""


#: Buckets of labelled ids that are sent out before texts are counted for the cutoffs.
BUCKETS = 1 << 20


def counted(docs: DataFrame, text: str = "text", stratum: str = "lang", whole: bool = False) -> DataFrame:
    """doc_id, stratum and the counts of every text, and the row itself (a struct) where `whole` is set; null and empty texts have
    no words and no lines."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    line = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        F.transform(F.array(line), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).cast("bigint").alias("d")))[0].alias("lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
        *(["row"] if whole else []),
    )
    # Exploded from an array of one, so that no filter on counts is pushed below them and makes them once more.
    once = counts.select(*(["row"] if whole else []), F.explode(F.array(F.struct(*(c for c in counts.columns if c != "row")))).alias("c")).select("c.*", *(["row"] if whole else []))
    once = once.withColumns({"n_lines": F.col("lines.n"), "n_dup_lines": F.col("lines.n") - F.col("lines.d")}).drop("lines")
    return once.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def labelled_only(docs: DataFrame, labels: DataFrame, text: str, stratum: str) -> DataFrame:
    """doc_id, text and stratum of the documents that may have a label: buckets of the labelled ids are BUCKETS rows at most,
    whatever the input, so they may be broadcast, and no text moves. The join of counts with labels is exact."""
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(BUCKETS)).alias("bucket")
    marks = labels.where("doc_id is not null and quality is not null").select(bucket).distinct()
    return docs.select(F.col("doc_id"), F.col(text), F.col(stratum), bucket).join(F.broadcast(marks), "bucket", "left_semi").drop("bucket")


def rates() -> dict[str, Column]:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_rate": part("n_symbols", "word_chars"), "dup_line_rate": part("n_dup_lines", "n_lines"), "repeat_rate": part("n_repeat_words", "n_words"), "word_length": part("word_chars", "n_words")}


def binomial_tail(k: str, n: str, share: float) -> Column:
    """P(Bin(n, share) <= k), the terms in logarithms by their recurrence; 1 where k >= n * share (not wanted there)."""
    odds = f"ln({share}D / (1 - {share}D))"
    return F.expr(f"""if({k} >= {n} * {share}D, 1.0D, aggregate(sequence(0L, {k}), named_struct('t', 0.0D, 's', 0.0D), (a, i) ->
        transform(array(if(i = 0, {n} * ln(1 - {share}D), a.t + ln(({n} - i + 1) / cast(i as double)) + {odds})), t -> named_struct('t', t, 's', a.s + exp(t)))[0], a -> a.s))""")


def cutoffs(counts: DataFrame, labels: DataFrame, share: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rate, cutoff: the chosen ones. A document with several labels is good if one says so; null labels and
    documents that fail the base rules take no part."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    held = counts.where("not base_failed").join(quality, "doc_id")
    each = held.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), reduce(lambda a, b: a + b, [(c > x).cast("int") for x in GRIDS[r]]).alias("above")) for r, c in rates().items()))).alias("x"))
    bins = each.groupBy("stratum", "x.rate", "x.above").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    grid = F.create_map(*(y for r, g in GRIDS.items() for y in (F.lit(r), F.array(*map(F.lit, g)))))
    # One row for each stratum, rate and bin from here on; a cutoff rejects the bins above it.
    full = bins.select("stratum", "rate").distinct().select("stratum", "rate", F.posexplode(grid[F.col("rate")]).alias("at", "cutoff"))
    sums = full.join(bins.withColumnsRenamed({"stratum": "s", "rate": "r"}), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rate") == F.col("r"))).groupBy("stratum", "rate", "at", "cutoff").agg(
        F.sum("good").alias("n"), F.sum(F.when(F.col("above") > F.col("at"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("above") > F.col("at"), F.col("bad")).otherwise(0)).alias("bad")
    )
    tests = F.count("*").over(Window.partitionBy())
    allowed = share / len(GRIDS)
    chosen = sums.withColumn("tests", tests).where("n > 0 and bad > k").where(binomial_tail("k", "n", allowed) <= F.lit(delta) / F.col("tests"))
    return chosen.groupBy("stratum", "rate").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "cutoff")).alias("best")).select("stratum", "rate", "best.cutoff")


def joint_cutoffs(counts: DataFrame, labels: DataFrame, scratch: Scratch, share: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rate, cutoff: the chosen ones, by fixed-sequence tests of the share that all rates of a stratum reject together.

    The order of cutoffs comes from bad documents only, which are no part of the tests, so each test holds at delta / strata.
    A rate's cutoffs that reject more of them than the next more lenient one come from the most lenient on; rates whose
    cutoffs still to come gain most in one step come first. The first failed test ends a stratum's sequence.
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    held = counts.where("not base_failed").join(quality, "doc_id")
    above = [reduce(lambda a, b: a + b, [(c > x).cast("int") for x in GRIDS[r]]).alias(f"above_{r}") for r, c in rates().items()]
    # At most 10,080 rows a stratum, however many labels.
    bins = scratch.keep(held.select("stratum", "quality", *above).groupBy("stratum", *(f"above_{r}" for r in GRIDS)).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")))
    each = F.array(*(F.struct(F.lit(n).alias("rank"), F.lit(r).alias("rate"), F.lit(i).alias("at"), F.lit(x).alias("cutoff"), (F.col(f"above_{r}") > i).alias("hit")) for n, (r, g) in enumerate(GRIDS.items()) for i, x in enumerate(g)))
    hits = bins.select("*", F.explode(each).alias("x")).select(*bins.columns, "x.*")
    lenient = Window.partitionBy("stratum", "rank").orderBy(F.desc("at"))
    steps = hits.groupBy("stratum", "rank", "rate", "at", "cutoff").agg(F.sum(F.when(F.col("hit"), F.col("bad")).otherwise(0)).alias("all_bad"))
    steps = steps.withColumn("gain", F.col("all_bad") - F.lag("all_bad", 1, 0).over(lenient)).withColumn("reach", F.max("gain").over(lenient.rowsBetween(0, Window.unboundedFollowing))).where("gain > 0")
    steps = steps.withColumn("step", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("reach"), "rank", F.desc("at")))).select("stratum", "rank", "rate", "at", "cutoff", "step")
    # The step at which each bin is first rejected; what a step adds; and the sums up to each step.
    met = hits.where("hit").alias("h").join(steps.alias("o"), F.expr("h.stratum <=> o.stratum and h.rank = o.rank and h.at = o.at"))
    added = met.groupBy("h.stratum", *(f"above_{r}" for r in GRIDS), "good", "bad").agg(F.min("step").alias("step")).groupBy("stratum", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    totals = bins.groupBy("stratum").agg(F.sum("good").alias("n")).withColumn("strata", F.count("*").over(Window.partitionBy()))
    upto = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = added.join(totals.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s"))).withColumns({"k": F.sum("good").over(upto), "gained": F.sum("bad").over(upto)})
    passed = run.withColumn("passed", (F.col("n") > 0) & (binomial_tail("k", "n", share) <= F.lit(delta) / F.col("strata"))).withColumn("passed", F.min("passed").over(upto))
    best = passed.where("passed and gained > k").groupBy("stratum").agg(F.max(F.struct((F.col("gained") - F.col("k")).alias("gain"), (-F.col("step")).alias("step"))).alias("m")).select(F.col("stratum").alias("s"), (-F.col("m.step")).alias("last"))
    return steps.join(best, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("step") <= F.col("last"))).groupBy("stratum", "rate").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, share: float = 0.02, delta: float = 0.05, text: str = "text", stratum: str = "lang", joint: bool = False, whole: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rates that reject (array) of every row; by joint_cutoffs where joint is set;
    with the row itself as the struct `row` where whole is set.

    Each row is judged by its own text, also where rows share an id. Null strata are a stratum of their own; null and empty texts
    fail the base rules; texts are whole, however long; repeated rows give repeated results; other columns are ignored, whatever
    their names; without labels only the base rules reject; an empty table gives an empty result.
    """
    if whole:
        # Rows aren't written with their counts: those that may be labelled are counted for the cutoffs, and all in the pass that
        # judges them.
        counts, every = scratch.keep(counted(labelled_only(docs, labels, text, stratum), text, stratum)), counted(docs, text, stratum, True)
    else:
        # A table of a few numbers a row: the texts are read and cut into words once, for the cutoffs and for the verdicts.
        counts = every = scratch.keep(counted(docs, text, stratum))
    # One row for each stratum, with the cutoff of each rate (none: nothing is above it).
    chosen = joint_cutoffs(counts, labels, scratch, share, delta) if joint else cutoffs(counts, labels, share, delta)
    picked = chosen.groupBy(F.col("stratum").alias("s")).agg(*(F.max(F.when(F.col("rate") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRIDS))
    met = every.join(scratch.keep(picked), F.col("stratum").eqNullSafe(F.col("s")), "left")
    reasons = F.filter(F.array(*(F.when(c > F.col(f"cut_{r}"), F.lit(r)) for r, c in rates().items())), lambda x: x.isNotNull())
    met = met.withColumn("reasons", reasons)
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons", *(["row"] if whole else []))
