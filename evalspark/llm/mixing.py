"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied target / source size times. The whole part
is certain; the fraction is a probability that has to become 0 or 1. Two documents at a
time, the pivotal step moves word mass from one to the other until one of them is whole;
the direction is random with the odds that keep each document's expectation. Because
words are moved, the source's total stays exactly at its target until one last document
per source is left, so taken words miss the target by less than that document's size.

The tree: documents of a source are hashed into blocks of about ``BLOCK``, each block is
folded to decisions and one residual, and the residuals are blocked and folded again.
A source of n documents takes log(n) / log(BLOCK) levels whatever its share of the rows.
Randomness is a hash of the ids, so reruns agree on any layout of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalspark.llm.common import WORD_CLASS, hash_bucket, table
from evalspark.session import cut_lineage

BLOCK = 64
#: Documents of a source from which its last rounding is settled, on average.
SETTLERS = 2048
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = 20240607

UNIT = ["source", "doc_id", "size"]


def text_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(units: DataFrame) -> DataFrame:
    """``(source, source_size, n_units, target)`` from ``(source, size, m)``.

    The weights repeat over the sources by code point, null last. Targets stop at
    MAX_COPIES times the source's size and the excess is shared by weight among the
    others until none is above: target = min(cap, level * weight) with one level for
    all. The windows run over one row per source.
    """
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                          F.count(F.lit(1)).alias("n_units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", MAX_COPIES * F.col("source_size").cast("double"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                         F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(every)
    return (sources.withColumn("share", level["level"] * F.col("weight"))
            .select("source", "source_size", "n_units", F.least("cap", F.coalesce("share", "cap")).alias("target")))


def _chance(*cols: Column) -> Column:
    """Uniform in [0, 1), a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 53)) / float(1 << 53)


def _pivot(acc: Column, x: Column) -> Column:
    """One pivotal step between the block's residual and the next document."""
    a = acc["rest"]
    up = F.least(a["w"] - a["mass"], x["mass"])
    down = F.least(a["mass"], x["w"] - x["mass"])
    moved = F.when(_chance(a["doc_id"], a["size"], x["doc_id"], x["size"]) * (up + down) < down, up).otherwise(-down)
    a_mass, x_mass = a["mass"] + moved, x["mass"] - moved

    def unit(y: Column, mass: Column) -> Column:
        return F.struct(y["doc_id"].alias("doc_id"), y["size"].alias("size"), y["w"].alias("w"), mass.alias("mass"))

    # The one that is whole leaves; of two whole ones the residual leaves.
    whole = F.when(moved >= 0, a["w"] - a["mass"] <= x["mass"]).otherwise(a["mass"] <= x["w"] - x["mass"])
    first = unit(a, F.when(whole, F.when(moved >= 0, a["w"]).otherwise(F.lit(0.0))).otherwise(a_mass))
    second = unit(x, F.when(~whole, F.when(moved >= 0, F.lit(0.0)).otherwise(x["w"])).otherwise(x_mass))
    return F.struct(F.when(whole, second).otherwise(first).alias("rest"),
                    F.concat(acc["done"], F.array(F.when(whole, first).otherwise(second))).alias("done"))


def fold_blocks(open_units: DataFrame) -> DataFrame:
    """``(source, blocks, rest, done)`` per block of ``(source, doc_id, size, w, mass, block, blocks)``.

    Blocks come from a uniform hash of distinct documents, so each holds about BLOCK.
    """
    unit = F.struct("doc_id", "size", "w", "mass")
    blocks = (open_units.groupBy("source", "blocks", "block")
              .agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(SEED), "doc_id", "size").alias("o"), unit.alias("u"))))
                   .alias("items")))
    head = F.element_at("items", 1)["u"]
    start = F.struct(head.alias("rest"), F.slice(F.array(head), 1, 0).alias("done"))
    folded = F.aggregate(F.slice("items", 2, F.size("items")), start, lambda acc, x: _pivot(acc, x["u"]))
    return blocks.select("source", "blocks", folded.alias("f")).select("source", "blocks", "f.rest", "f.done")


def mix_copies(sized: DataFrame) -> DataFrame:
    """Copies per distinct ``(source, doc_id, size)`` of the rows ``(doc_id, source, size)``.

    Returns source, doc_id, size, source_size, target, copies. Rows that agree in all
    three (repeated rows) are one unit and get the same copies. A unit of size 0 gets
    the whole part of its source's ratio, 0 for a source without words.
    """
    units = cut_lineage(sized.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("m")))
    targets = cut_lineage(source_targets(units))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
               .withColumn("base", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
               .withColumn("w", (F.col("size") * F.col("m")).cast("double")))
    most = targets.agg(F.max("n_units").alias("n")).first()["n"] or 0
    live = (planned.where((F.col("part") > 0) & (F.col("w") > 0))
            .select(*UNIT, "w", (F.col("w") * F.col("part")).alias("mass"), F.col("n_units").alias("blocks")))
    decided, level = [], 0
    while most > 1 or level == 0:
        blocks = F.ceil(F.col("blocks") / BLOCK).cast("long")
        live = (live.withColumn("blocks", blocks)
                .withColumn("block", hash_bucket(F.col("blocks"), F.lit(SEED + level), F.col("doc_id"), F.col("size"))))
        folded = cut_lineage(fold_blocks(live))
        decided.append(folded.select("source", F.explode("done").alias("d"))
                       .select("source", "d.doc_id", "d.size", (F.col("d.mass") > 0).cast("long").alias("extra")))
        live = folded.select("source", "rest.doc_id", "rest.size", "rest.w", "rest.mass", "blocks")
        most, level = -(-most // BLOCK), level + 1
    last = live.select(*UNIT, (_chance(F.col("doc_id"), F.col("size")) * F.col("w") < F.col("mass")).cast("long").alias("extra"))
    extras = last
    for d in decided:
        extras = extras.unionByName(d)
    rounded = cut_lineage(_with_extra(planned, extras).withColumn("copies", F.col("base") + F.col("extra"))
                          .select(*UNIT, "source_size", "target", "n_units", "w", "copies"))
    return (_with_extra(rounded, settle(rounded))
            .select(*UNIT, "source_size", "target", (F.col("copies") + F.col("extra")).cast("long").alias("copies")))


def _with_extra(units: DataFrame, extras: DataFrame) -> DataFrame:
    """``units`` with the ``extra`` copies of their key, 0 where there are none."""
    extras = extras.select(*(F.col(c).alias(f"x_{c}") for c in UNIT), F.col("extra").alias("x"))
    same = [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in UNIT]
    return (units.join(extras, same, "left").withColumn("extra", F.coalesce("x", F.lit(0)))
            .drop("x", *(f"x_{c}" for c in UNIT)))


def settle(rounded: DataFrame) -> DataFrame:
    """Single copies to add or drop, as ``(source, doc_id, size, extra)``, that bring each source to its target."""
    gaps = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("w"))).alias("gap"))
    gaps = gaps.withColumnRenamed("source", "s")
    may = F.when(F.col("gap") > 0, F.col("copies") < MAX_COPIES).otherwise(F.col("copies") > 0)
    pool = (rounded.join(gaps, F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("w") > 0) & (F.col("w") <= F.abs("gap")) & may)
            .where(_chance(F.lit("settle"), F.col("doc_id"), F.col("size")) * F.col("n_units") < SETTLERS)
            .groupBy("source", "gap")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("less"), F.xxhash64("doc_id").alias("o"),
                                                      "doc_id", "size"))).alias("items")))
    empty = F.slice(F.transform("items", lambda x: F.struct(x["doc_id"], x["size"])), 1, 0)
    picked = F.aggregate(
        "items", F.struct(F.abs("gap").alias("left"), empty.alias("picks")),
        lambda acc, x: F.when(-x["less"] <= acc["left"], F.struct(
            (acc["left"] + x["less"]).alias("left"),
            F.concat(acc["picks"], F.array(F.struct(x["doc_id"], x["size"]))).alias("picks"))).otherwise(acc))
    return (pool.select("source", F.signum("gap").cast("long").alias("extra"), F.explode(picked["picks"]).alias("p"))
            .select("source", "p.doc_id", "p.size", "extra"))


def with_copies(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, source and size) and the columns of ``mix_copies(sized)``."""
    copies = mix_copies(sized).select(*(F.col(c).alias(f"u_{c}") for c in UNIT), "source_size", "target", "copies")
    same = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in UNIT]
    return docs.join(copies, same).drop(*(f"u_{c}" for c in UNIT))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target, taken, source, copies.

    Null texts have size 0, a null source is a source of its own, repeated rows share
    one decision, an empty table gives an empty result.
    """
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_size(F.col("text")).alias("size")))
    return (with_copies(sized, sized)
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
