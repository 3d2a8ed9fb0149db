"""Region-grounding scores over per-turn sample records (AG-4..AG-9, AG-20, WN-5).

A sample is a row; a *failed* sample (the upstream record was not an object) is a
row whose record struct is NULL. gIoU, bbox_AP and pass rates count failed samples
as 0; cIoU is a corpus ratio that leaves them out of both sums. An empty input
gives 0.0 for every score. All scores are plain aggregate Columns, so a
``groupBy`` computes them with map-side partial aggregation (no hot-group task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.operators.sequence import number_within

DEFAULT_THRESHOLDS = (0.3, 0.5, 0.7, 0.9)


def pass_rate_name(t: float) -> str:
    """Metric name of a pass rate, e.g. ``pass_rate_0.3``."""
    if not 0 < t < 1:
        raise ValueError(f"threshold must be in (0, 1), got {t}")
    return f"pass_rate_{t:.10g}"


def _fields(record: str | None):
    if record is None:
        failed = F.lit(False)
        inter, union, bbox = F.col("intersection"), F.col("union"), F.col("bbox_iou")
    else:
        failed = F.col(record).isNull()
        inter = F.col(f"{record}.intersection")
        union = F.col(f"{record}.union")
        bbox = F.col(f"{record}.bbox_iou")
    inter = F.coalesce(inter.cast("double"), F.lit(0.0))
    union = F.coalesce(union.cast("double"), F.lit(0.0))
    bbox = F.coalesce(bbox.cast("double"), F.lit(0.0))
    return failed, inter, union, bbox


def mask_iou(record: str | None = None) -> Column:
    """Per-sample mask IoU; 0 when the union is not positive or the sample failed."""
    failed, inter, union, _ = _fields(record)
    return F.when(failed | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def giou(record: str | None = None) -> Column:
    return F.coalesce(F.avg(mask_iou(record)), F.lit(0.0))


def ciou(record: str | None = None) -> Column:
    failed, inter, union, _ = _fields(record)
    si = F.sum(F.when(~failed, inter))
    su = F.sum(F.when(~failed, union))
    return F.when(F.coalesce(su, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(si / su)


def bbox_ap(record: str | None = None) -> Column:
    failed, _, _, bbox = _fields(record)
    return F.coalesce(F.avg(F.when(~failed & (bbox > 0.5), 1.0).otherwise(0.0)), F.lit(0.0))


def pass_rate(t: float, record: str | None = None) -> Column:
    pass_rate_name(t)  # validates the threshold
    return F.coalesce(F.avg(F.when(mask_iou(record) > t, 1.0).otherwise(0.0)), F.lit(0.0))


def grounding_metrics(df: DataFrame, by: Sequence[str] = (), record: str | None = None,
                      thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
                      names: str = "wide") -> DataFrame:
    """gIoU, cIoU, bbox_AP and pass rates per ``by`` group, in one pass.

    ``names="wide"`` gives columns ``giou, ciou, bbox_ap, pass_rate_0_3, ...``;
    ``names="long"`` gives rows ``(*by, metric, value)`` with the reference
    metric names (``gIoU``, ``cIoU``, ``bbox_AP``, ``pass_rate_0.3``).
    """
    aggs = [F.count(F.lit(1)).alias("n_samples"),
            giou(record).alias("giou"), ciou(record).alias("ciou"),
            bbox_ap(record).alias("bbox_ap")]
    pr_cols = []
    for t in thresholds:
        name = "pass_rate_" + f"{t:.10g}".replace(".", "_")
        pr_cols.append((pass_rate_name(t), name))
        aggs.append(pass_rate(t, record).alias(name))
    res = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if names == "wide":
        return res
    pairs = [("gIoU", "giou"), ("cIoU", "ciou"), ("bbox_AP", "bbox_ap")] + pr_cols
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
                                for m, c in pairs]))
    return res.select(*by, stack.alias("_m")).select(*by, "_m.metric", "_m.value")


def round_number(df: DataFrame, image_col: str, order: Sequence, out: str = "round") -> DataFrame:
    """WN-5: the k-th occurrence of an image in output order is round k.

    The image id is compared as text, a missing id as ``""``. ``order`` is the
    output order (e.g. shard path, position) and must be unique.
    """
    keyed = df.withColumn("_img", F.coalesce(F.col(image_col).cast("string"), F.lit("")))
    return number_within(keyed, ["_img"], order, out=out).drop("_img")


def per_round_metrics(df: DataFrame, image_col: str, order: Sequence,
                      record: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """AG-8: gIoU and bbox_AP per round (long form, ``metric`` = ``gIoU_R1`` ...)."""
    rounds = round_number(df, image_col, order)
    agg = rounds.groupBy(*by, "round").agg(F.count(F.lit(1)).alias("n_samples"),
                                            giou(record).alias("giou"),
                                            bbox_ap(record).alias("bbox_ap"))
    return agg


def expected_turns(items: DataFrame, turns_col: str = "conversational_turns") -> Column:
    """AG-20 aggregate: total number of turns; a missing list counts 0."""
    c = F.col(turns_col)
    return F.coalesce(F.sum(F.when(c.isNull(), 0).otherwise(F.size(c))), F.lit(0)).cast("long")


def completeness(samples: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """AG-9 per group: ``(*by, expected_turns, n_records, complete)``; a group without samples has 0."""
    counted = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"))
    return (expected.join(counted, list(by), "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)).cast("long"))
            .withColumn("complete", F.col("expected_turns") == F.col("n_records")))


def assert_complete(samples: DataFrame, expected: int) -> DataFrame:
    """AG-9: refuse to score unless the sample count equals the expected turns.

    Raises ``RuntimeError`` on a mismatch or an empty input; returns ``samples``.
    """
    n = samples.count()
    if n == 0:
        raise RuntimeError("nothing to score: the sample table is empty")
    if n != expected:
        raise RuntimeError(
            f"{n} scored samples for {expected} expected turns: an incomplete run is not scored")
    return samples
