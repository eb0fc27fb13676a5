"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is a number of words. Each document has a *rate* of its own, the number of times it should appear:
rate = c * damping(size), at most `cap`, where damping(size) = 4 / (3 + bits of size) lets long documents give up a
little of their share to short ones (one of 20 000 words counts 0.22, one of 100 words 0.4), and c is what makes the
rates of a source's words add up to its target. floor(rate) whole copies are certain, and the rest is the document's
own probability p of one more copy. Documents are ranked by Pareto's order: the odds of a uniform number (a hash of
doc_id and text) over the odds of p. The first of that order are taken. The size of the sample is fixed in words, as
targets are: documents are taken until their words fill what the certain copies leave of the target. (A sample fixed
in documents would miss the target of a small source by the luck of a few long ones.)

The rate is a function of the source and the bits of the size, so c comes from a table of at most 64 rows a source. The
order is never sorted as a whole: two rounds of histograms over the ranking number find, for each source, the slice of
2**-24 of the range in which the target is reached, and only the rows in that slice are put in order. A source with a
third of all rows is thus counted by all tasks (partial sums), and decisions reach the rows as a table of one row for
each source and size class. Rows that tie in rank, doc_id and size are one row of the order, with a count: a part of
them can be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stored, unit_hash, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
_SLICES = 4096
_NEAR_ZERO = 1e-12


def damping(bits: Column) -> Column:
    """The weight of a document in its source by the number of binary digits of its size."""
    return F.lit(4.0) / (bits + 3)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all sizes; a target stops at
    cap times its source's size, and the excess is shared again by weight until none is above. That fixpoint is
    min(weight * x, cap * size) for one x: the sources that are capped are the first by cap * size / weight, as many
    as make the others' common x fit the next one. There is one row per source, so the windows run over sources only.
    """
    if share > cap:
        raise ValueError("sources cannot give more than cap times their size")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("r", cap * F.col("source_size") / F.col("w")).withColumn("pos", F.row_number().over(order))
    every = Window.partitionBy()
    upto = Window.orderBy("r", "pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * cap
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    x = x.withColumn("x", (F.sum("source_size").over(every) * share - before) / left)
    # the first source whose own x does not exceed its r, and all after it, are not capped
    level = F.min(F.when(F.col("x") <= F.col("r"), F.struct("r", "pos", "x"))).over(every)["x"]
    target = F.when(level.isNull(), cap * F.col("source_size")).otherwise(F.least(F.col("w") * level, cap * F.col("source_size")))
    return x.select("source", "source_size", target.cast("double").alias("target"))


def class_rates(classes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """source, bits, source_size, target, copies, p for each size class of each source.

    classes: source, bits, words (above 0). The classes that are capped are a source's first ones, as many as make the
    others' common factor c fit the next one; windows run over the classes of one source, 64 at most.
    """
    x = classes.withColumn("g", damping(F.col("bits"))).withColumn("gw", F.col("g") * F.col("words"))
    order = Window.partitionBy("source").orderBy("bits")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    x = x.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).drop("t")
    x = x.withColumn("c", (F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum("gw").over(after))
    fits = F.when(F.col("c") * F.col("g") <= cap, F.struct("bits", "c"))
    c = F.min(fits).over(Window.partitionBy("source"))["c"]  # null: every class is capped
    rate = F.when(c.isNull(), F.lit(cap)).otherwise(F.greatest(F.least(c * F.col("g"), F.lit(cap)), F.lit(0.0)))
    x = x.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + _NEAR_ZERO).cast("int"))
    return x.select("source", "bits", "words", "source_size", "target", "copies", F.greatest(F.col("rate") - F.col("copies"), F.lit(0.0)).alias("p"))


def _id(doc_id: Column) -> Column:
    """doc_id; null comes last."""
    return F.coalesce(doc_id, F.lit((1 << 63) - 1))


def _rank(p: Column, u: Column) -> Column:
    """Pareto's ranking number q, as q / (1 + q), which lies in 0..1; small is early; null for p = 0."""
    odds = F.when(p <= _NEAR_ZERO, F.lit(None)).otherwise(u / (1 - u) * (1 - p) / p)
    return odds / (1 + odds)


def measures(docs: DataFrame, seed: int) -> list[Column]:
    """doc_id, source, size, bits and u as columns of docs. u is a function of doc_id, text and seed: rows without a doc_id don't share one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = word_count(text)
    key = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.length(F.bin(size)).alias("bits"), unit_hash(key, seed).alias("u")]


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """The measures of every row, stored: the only pass over the texts."""
    return stored(docs.select(*measures(docs, seed)), "mix-sizes")


def cutoffs(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """For each source and size class: source, bits, source_size, target, copies (certain), p (of one more), and edge.

    edge: the last place of the source's order that is taken, (rank, id, size), of the rows that stand there the number
    n, and how many of them are taken, k. A row for size 0 stands for each source.
    """
    classes = rows.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    classes = stored(classes, "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, cap, share)
    rates = class_rates(classes.where("words > 0"), targets, cap)
    none = targets.select("source", F.lit(0).alias("bits"), F.lit(0).cast("long").alias("words"), "source_size", "target", F.lit(0).alias("copies"), F.lit(0.0).alias("p"))
    plan = stored(rates.unionByName(none), "mix-plan")
    wants = plan.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("words"))).alias("want"))
    open_ = plan.where(F.col("p") > _NEAR_ZERO).join(wants.withColumnRenamed("source", "w"), F.col("source").eqNullSafe(F.col("w")))
    open_ = open_.select(F.col("source").alias("s"), F.col("bits").alias("b"), "p", "want")
    at = rows.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.col("bits") == F.col("b")))
    at = at.select("s", _id(F.col("doc_id")).alias("id"), "size", "want", _rank(F.col("p"), F.col("u")).alias("rank"), F.lit(0).cast("long").alias("base"))
    for scale in (_SLICES, _SLICES * _SLICES):
        at, slices = _narrow(at, scale)
    ties = at.groupBy("s", "rank", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.min("want").alias("want"), F.min("base").alias("base"))
    order = Window.partitionBy("s").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    # a row is taken if that brings the words nearer to what is wanted
    k = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("want") - before) / F.col("size") + 0.5))).cast("long")
    edge = ties.withColumn("k", k).where("k > 0").groupBy("s").agg(F.max(F.struct("rank", "id", "size", "n", "k")).alias("e"))
    # where not even the first row of the slice is taken, all that come before the slice are
    start = F.struct((F.col("cell0") / float(_SLICES * _SLICES)).alias("rank"), F.lit(-(1 << 63)).alias("id"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    edges = slices.join(edge, F.col("s0").eqNullSafe(F.col("s")), "left").select("s0", F.coalesce("e", start).alias("edge"))
    out = plan.drop("words").join(edges, F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0").withColumnRenamed("source", "s").withColumnRenamed("bits", "b")
    return stored(out, "mix-cutoffs")


def _narrow(at: DataFrame, scale: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `at` in that slice (of width 1 / scale) in which a source's words reach what is wanted, and the slices.

    base: the source's words before the slice.
    """
    cell = F.floor(F.col("rank") * scale).cast("long")
    sums = at.groupBy("s", cell.alias("cell")).agg(F.sum("size").alias("inside"), F.min("want").alias("want"), F.min("base").alias("base"))
    run = F.col("base") + F.sum("inside").over(Window.partitionBy("s").orderBy("cell"))  # at most _SLICES rows a source
    last = F.max("cell").over(Window.partitionBy("s"))
    reached = sums.withColumn("run", run).withColumn("last", last).where((F.col("run") >= F.col("want")) | (F.col("cell") == F.col("last")))
    best = reached.groupBy("s").agg(F.min(F.struct("cell", (F.col("run") - F.col("inside")).alias("base"))).alias("b"))
    slices = stored(best.select(F.col("s").alias("s0"), F.col("b.cell").alias("cell0"), F.col("b.base").alias("base0")), "mix-slices")
    held = at.join(slices, F.col("s").eqNullSafe(F.col("s0")) & (cell == F.col("cell0")))
    return held.select("s", "id", "size", "want", "rank", F.col("base0").alias("base")), slices


def with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, doc_id, size, bits, u and others) with source_size, target and copies, the number of times the mix takes the row.

    The cut-offs are at most 65 rows per source; Spark broadcasts them if they are below its size limit and splits a hot
    source if not. Where only a part of the rows at a source's edge is taken, those rows, which don't differ in what
    counts, are stored and numbered within their tasks, and the first k of all stay; else rows are passed once.
    """
    x = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bits") * (F.col("size") > 0).cast("int") == F.col("b")), "left")
    rank = _rank(F.col("p"), F.col("u"))
    at, edge = F.struct(rank.alias("rank"), _id(F.col("doc_id")).alias("id"), F.col("size").alias("size")), F.struct("edge.rank", "edge.id", "edge.size")
    ordered = F.col("edge").isNotNull() & rank.isNotNull() & (F.col("size") > 0)
    parted = F.col("edge.k") < F.col("edge.n")
    keep = [c for c in rows.columns if c not in ("u", "bits")]

    def out(df: DataFrame, one: Column) -> DataFrame:
        return df.select(*keep, "source_size", "target", (F.col("copies") + one).cast("int").alias("copies"))

    sure = F.when(ordered, (at <= edge).cast("int")).otherwise(F.lit(0))
    if cuts.where(parted).isEmpty():
        return out(x, sure)
    tied = F.coalesce(ordered & parted & (at == edge), F.lit(False))
    some = stored(x.where(tied).withColumn("_n", F.monotonically_increasing_id()), "mix-ties").withColumn("_task", F.shiftright("_n", 33))
    counts = some.groupBy("s", "_task").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("s").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("s").alias("_s"), F.col("_task").alias("_t"), before.alias("_before"))
    numbered = some.withColumn("_i", F.row_number().over(Window.partitionBy("s", "_task").orderBy("_n")))
    numbered = numbered.join(counts, F.col("s").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    return out(x.where(~tied), sure).unionByName(out(numbered, (F.col("_before") + F.col("_i") <= F.col("edge.k")).cast("int")))


def mix_plan(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies.

    size is the number of words `[^\\x20\\x09-\\x0D]+`; null and empty texts have size 0 and are never taken. A null
    source is a source of its own, after all others. A row's number depends on its doc_id, its text and the seed alone,
    so reruns agree; of rows that repeat both, as many are taken as are needed, whichever. A source's words come within
    half a document of its target. An empty table gives an empty result; other columns are ignored.
    """
    rows = measured(docs, seed)
    return with_copies(rows, cutoffs(rows, weights, cap, share))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with the columns of docs.

    Nulls, empty texts, repeats and empty tables are as in mix_plan: texts without words are left out.
    """
    cuts = cutoffs(measured(docs, seed), weights, cap, share)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, *measures(docs, seed))
    return with_copies(rows, cuts).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
