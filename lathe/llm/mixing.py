"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every source gets a target of words: its weight's share of all words, at most MOST times
its own size, with the excess shared among the others by weight (the level of a water
table). A document of a source then has target / size copies: the whole part at once, the
fraction as a probability. Fractions are rounded by the pivotal method: two meet, and words
move from one to the other at random until one's fraction is 0 or 1; the other goes on.
Words, not fractions, are conserved, so unequal documents may meet, and each one's
expectation stays its fraction. Blocks of BLOCK documents do this side by side, each leaves
one document with a fraction, and these meet in blocks again: a reduction tree of log(n)
levels, one group of about BLOCK rows at a time, also for a source with a third of all rows.

A source's documents longer than its mean go first. The last of them is decided by its
chance, and the words that this gives or takes are drawn from the fractions of the shorter
ones, all alike; then these go. So a source's taken words miss its target by half a short
document at most, unless the shorter ones hold too few words to make up for the last long one.

Chance is a hash of the level and the two documents, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, the last;
repeated rows are told apart and decided each; a document without words moves no words and
is decided by its own chance; a source of no words has target 0; an empty table gives no
rows; extra columns, of any names, are ignored or kept as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import WORD, durable, packed, small

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SEED = 20_240
UNIT = ("size", "doc_id", "salt", "row", "p")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- targets --------------------------------------------------------------------------


def _with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds sums over all rows before each one: inside its range of the order, and over whole ranges before."""
    ranges = durable(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = ranges.groupBy("part").agg(*(F.sum(c).alias(k) for k, c in sums.items())).select("part", *(F.sum(k).over(before).alias(f"{k}_of_ranges") for k in sums))
    out = ranges.select("*", *(F.sum(c).over(inside).alias(f"{k}_in_range") for k, c in sums.items())).join(totals, "part")
    zero = F.lit(0)
    return out.select(*rows.columns, *((F.coalesce(f"{k}_of_ranges", zero) + F.coalesce(f"{k}_in_range", zero)).alias(k) for k in sums))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, from rows of (source, size); one row for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = _with_sums_before(sources, [F.asc_nulls_last("source")], {"place": F.lit(1)})
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    s = s.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("most")).withColumn("r", F.col("most") / F.col("w"))
    # Sources fill in order of most / weight; the level is the first that fills no further source.
    s = durable(_with_sums_before(s, [F.asc("r"), F.asc_nulls_last("source")], {"filled": F.col("most"), "weighed": F.col("w")}), "sources")
    every = s.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    levels = s.join(F.broadcast(every), F.lit(True)).select("r", ((F.col("all_size") - F.col("filled")) / (F.col("all_w") - F.col("weighed"))).alias("level")).where("level <= r")
    level = levels.agg(F.min(F.struct("r", "level")).getField("level").alias("level"))
    return s.join(F.broadcast(level), F.lit(True)).select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


# --- rounding -------------------------------------------------------------------------


def _chance(*of: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *of).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def _meet(level: int):
    """One step of the fold: the carried unit meets the next; one of them is settled."""

    def step(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        room_a, has_a, room_b, has_b = ((1 - c["p"]) * c["size"]), (c["p"] * c["size"]), ((1 - x["p"]) * x["size"]), (x["p"] * x["size"])
        up, down = F.least(room_a, has_b), F.least(has_a, room_b)  # words that can move to the carried one, or from it
        rises = _chance(F.lit(level), c["doc_id"], c["size"], c["salt"], x["doc_id"], x["size"], x["salt"]) * (up + down) < down
        first_settled = F.when(rises, room_a <= has_b).otherwise(has_a <= room_b)
        moved = F.when(rises, up).otherwise(-down)
        left = F.when(first_settled, x["p"] - moved / x["size"]).otherwise(c["p"] + moved / c["size"])
        keep = F.struct(*(F.when(first_settled, x[k]).otherwise(c[k]).alias(k) for k in UNIT[:-1]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"))
        done = F.struct(F.when(first_settled, c["row"]).otherwise(x["row"]).alias("row"), F.when(first_settled == rises, 1).otherwise(0).alias("extra"))
        return F.struct(keep.alias("carry"), F.concat(acc["done"], F.array(done)).alias("done"))

    return step


def _settle(units: DataFrame, level: int, block: int) -> tuple[DataFrame, list[DataFrame], int]:
    """(one undecided unit of each source, tables of (row, extra) decided, next level) of units with sizes."""
    open_, done = units, []
    while True:
        counts = durable(open_.groupBy("source").agg(F.count("*").alias("c")), "counts")
        if (counts.agg(F.max("c")).first()[0] or 0) <= 1:
            return open_, done, level
        n = counts.select(F.col("source").alias("_s"), F.ceil(F.col("c") / block).alias("_n"))
        dealt = open_.join(small(n), F.col("source").eqNullSafe(F.col("_s")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "size", "salt"), F.col("_n")))
        items = F.sort_array(F.collect_list(F.struct(*UNIT)), asc=False)
        blocks = dealt.groupBy("source", "block").agg(items.alias("items"))
        start = F.struct(F.element_at("items", 1).alias("carry"), F.expr("CAST(array() AS array<struct<row: bigint, extra: int>>)").alias("done"))
        r = durable(blocks.select("source", F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, _meet(level)).alias("r")), "level")
        done.append(r.select(F.explode("r.done").alias("d")).select("d.*"))
        open_ = r.select("source", "r.carry.*")
        level += 1


def rounded_copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies of every row of ``sized`` (row, doc_id, source, size)."""
    targets = durable(source_targets(sized, weights, most), "targets")
    # Only rows alike are told apart by their place, so that no other chance depends on how a table is cut.
    like = ("doc_id", "source", "size")
    ties = durable(sized.groupBy(*like).agg(F.count("*").alias("c")).where("c > 1").select(*(F.col(k).alias(f"_{k}") for k in like)), "ties")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    units = sized.join(small(ties), same, "left").select("row", *like, F.when(F.col("_size").isNotNull(), F.col("row")).otherwise(0).alias("salt"))
    means = sized.where("size > 0").groupBy(F.col("source").alias("_source")).agg(F.avg("size").alias("mean"))
    units = units.join(small(targets), units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    units = units.join(small(durable(means, "means")), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    units = durable(units.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)), "units")
    open_ = units.where("p > 0 AND size > 0")
    first, done, level = _settle(open_.where("size > mean").select("source", *UNIT), 0, block)
    up = F.when(_chance(F.lit(-1), F.col("doc_id"), F.col("size"), F.col("salt")) < F.col("p"), 1).otherwise(0)
    first = durable(first.select("source", "row", up.alias("extra"), ((up - F.col("p")) * F.col("size")).alias("given")), "first")
    done.append(first.select("row", "extra"))
    short = open_.where("size <= mean")
    shift = short.groupBy("source").agg(F.sum("size").alias("held")).join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("_s", (F.col("given") / F.col("held")).alias("less"))
    short = short.join(small(durable(shift, "shift")), F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - F.coalesce("less", F.lit(0.0)))))
    last, more, _ = _settle(durable(short.select("source", *UNIT), "short"), level, block)
    done += [*more, last.select("row", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("extra"))]
    done.append(units.where("p > 0 AND size = 0").select("row", up.alias("extra")))
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionByName(d)
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long")
    return units.join(extra.where("extra = 1"), "row", "left").select("row", *like, "source_size", "target", copies.alias("copies"))


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """row, doc_id, source, size, and more, of every row, written once: texts are read one time and rows have fixed numbers."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), *more)
    return durable(own.withColumn("row", F.monotonically_increasing_id()), "sized")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    out = rounded_copies(_numbered(docs), weights, most).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents, each as many times as it has copies; columns stay."""
    rows = _numbered(docs, packed(docs).alias("doc"))
    copies = rounded_copies(rows.select("row", "doc_id", "source", "size"), weights, most).where("copies > 0").select("row", "copies")
    taken = rows.select("row", "doc").join(copies, "row")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc.*")
