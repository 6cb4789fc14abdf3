"""Funnels, pivots, conditional means and weighted scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def funnel(df: DataFrame, **stages: Column) -> DataFrame:
    """All counts of a funnel in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in stages.items()])


def with_and_without(items: DataFrame, facts: DataFrame, fact_key: str) -> DataFrame:
    """Distinct items that have facts, and the rest, as one row."""
    a, b = facts.agg(F.count_distinct(fact_key).alias("with_facts")), items.agg(F.count("*").alias("_all"))
    return a.join(F.broadcast(b), F.lit(True)).select("with_facts", (F.col("_all") - F.col("with_facts")).alias("without_facts"))  # one row each


def status_pivot(parents: DataFrame, children: DataFrame, key: str, child_key: str, status: str, states: Mapping[str, str]) -> DataFrame:
    """Parents with a count for each status (name -> value), zero where there is none; one aggregation."""
    counts = children.groupBy(F.col(child_key).alias("_key")).agg(*[F.count_if(F.col(status) == v).alias(n) for n, v in states.items()])
    return parents.join(counts, F.col(key) == F.col("_key"), "left").drop("_key").fillna(0, list(states))


def letter_bucket(name: Column) -> Column:
    """First letter A-Z in upper case; # for anything else."""
    return F.when(name.rlike("^[A-Za-z]"), F.upper(F.substring(name, 1, 1))).otherwise("#")


def letter_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(letter_bucket(F.col(name)).alias("letter")).agg(F.count("*").alias("cnt"))


def conditional_means(df: DataFrame, group: Sequence[str], ok: Column, metrics: Sequence[str]) -> DataFrame:
    """Means over the good rows with a divisor of at least 1, and the counts of good and all rows."""
    n = F.count_if(ok)
    means = [(F.coalesce(F.sum(F.when(ok, F.col(m))), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias(f"avg_{m}") for m in metrics]
    return df.groupBy(*group).agg(*means, n.alias("ok"), F.count("*").alias("tested"))


def weighted(weights: Mapping[str, float], inverted: Sequence[str] = ()) -> Column:
    """Weighted sum of metric columns; inverted ones count as 1 - x."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * (1 - F.col(name) if name in inverted else F.col(name))
    return out


#: The weights of the composite scores.
STROKE_SCORE = {"coverage": 0.35, "overshoot": 0.15, "stroke_count": 0.20, "topology": 0.30}
HANDWRITING_SCORE = {"baseline_variation": 0.2, "stroke_width_variation": 0.25, "character_consistency": 0.2, "edge_roughness": 0.2, "slant_variation": 0.15}
QUALITY_SCORE = {"ocr_confidence": 0.4, "ocr_correct": 0.3, "smoothness": 0.1, "completeness": 0.1, "aspect_ratio": 0.1}
CHARSET_SCORE = {"charset": 0.4, "consistency": 0.3, "legibility": 0.3}
ASSET_SCORE = {"coverage": 0.6, "style": 0.4}


def baseline_score(variation: Column) -> Column:
    """Piecewise: too even, natural, too uneven."""
    return F.when(variation < 0.02, variation / 0.02 * 0.5).when(variation < 0.1, 0.5 + (variation - 0.02) / 0.08 * 0.5).otherwise(F.greatest(F.lit(0.3), 1.0 - (variation - 0.1) * 2))


def width_score(cv: Column) -> Column:
    return F.when(cv < 0.05, cv / 0.05 * 0.3).when(cv < 0.25, 0.3 + (cv - 0.05) / 0.2 * 0.7).otherwise(F.greatest(F.lit(0.4), 1.0 - (cv - 0.25) * 2))


def variation_coefficient(value: str | Column) -> Column:
    return F.stddev_pop(value) / (F.avg(value) + 1e-6)


def completeness_score(strokes: Column, points: Column) -> Column:
    stroke = F.when(strokes < 1, 0.0).when(strokes > 10, F.greatest(F.lit(0.0), 1 - (strokes - 10) / 20)).otherwise(1.0)
    return F.when(strokes == 0, 0.0).otherwise((stroke + F.least(F.lit(1.0), points / 20)) / 2)


def aspect_score(width: Column, height: Column) -> Column:
    ratio = F.try_divide(width, height)
    return F.when(height == 0, 0.5).when(ratio.between(0.3, 2.0), 1.0).when(ratio.between(0.1, 3.0), 0.7).otherwise(0.3)


def smoothness_score(cv: Column) -> Column:
    return F.when(cv.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - cv / 2))


def ink_step(ratio: Column, ideal: tuple[float, float], acceptable: tuple[float, float]) -> Column:
    """0.8 strictly within the ideal range, 0.5 within the acceptable one, else 0.2."""
    return F.when((ratio > ideal[0]) & (ratio < ideal[1]), 0.8).when((ratio > acceptable[0]) & (ratio < acceptable[1]), 0.5).otherwise(0.2)


def connectivity_score(components: Column, expected: Column) -> Column:
    """1 for one component, falling with their number; 0 for none or as many as expected."""
    return F.when(components == 0, 0.0).when(components <= 3, 1 - (components - 1) / expected).when(components < expected, (expected - components) / expected).otherwise(0.0)


def expected_components(word: Column) -> Column:
    """Letters and the dots of i and j."""
    return F.length(word) + (F.length(word) - F.length(F.translate(word, "ij", "")))


def quality_issues(shapes: Column, width: Column, hole: Column, exclaim: Column, mismatches: Column, low: int = 10, high: int = 15, most: float = 0.225, marks: int = 2) -> Column:
    """One label for each rule that fails."""
    return F.array_compact(
        F.array(
            F.when((shapes < low) | (shapes > high), F.concat(F.lit("shapes="), shapes.cast("string"))),
            F.when(width > most, F.concat(F.lit("width="), F.format_string("%.1f", width * 100), F.lit("%"))),
            F.when(hole, F.lit("l_has_hole")),
            F.when(exclaim != marks, F.concat(F.lit("exclaim_shapes="), exclaim.cast("string"))),
            F.when(F.size(mismatches) > 0, F.concat(F.lit("case_issues="), F.array_join(mismatches, ","))),
        )
    )


def failing_rules(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that an item breaks."""
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("reason"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boolean arrays; 0 where neither has a true."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: (x & y).cast("int")), F.lit(0), lambda s, x: s + x)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: (x | y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(any_ == 0, 0.0).otherwise(both / any_)


def coverage(hits: DataFrame, total: int, covered: str = "cloud_id") -> DataFrame:
    return hits.agg((F.count_distinct(covered) / F.lit(total)).alias("coverage"))


def overlap_excess(hits: DataFrame, shape: str = "shape", covered: str = "cloud_id", allowed: float = 0.25) -> DataFrame:
    """Mean over shapes of the share of their points that other shapes cover too, beyond what is allowed."""
    once = hits.select(shape, covered).distinct()
    owners = once.groupBy(covered).agg(F.count("*").alias("_owners"))
    each = once.join(owners, covered).groupBy(shape).agg(F.greatest(F.lit(0.0), F.count_if(F.col("_owners") > 1) / F.count("*") - allowed).alias("_excess"))
    return each.agg(F.coalesce(F.avg("_excess"), F.lit(0.0)).alias("overlap"))


def adaptive_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    return df.agg(F.percentile(value, F.lit(p)).alias("p"))


def required_share(required: Sequence[str], have: Column) -> tuple[Column, Column]:
    """Share of the required entries that are there, and those that are missing."""
    need = F.array(*[F.lit(c) for c in required])
    missing = F.array_except(need, have)
    return 1 - F.size(missing) / F.lit(len(set(required))), missing


def coverage_and_overshoot(strokes: Column, mask: Column) -> tuple[Column, Column]:
    """Share of the mask that strokes cover, and share of the strokes outside it (both boolean arrays); 0 where there is nothing to share."""
    count = lambda f: F.aggregate(F.zip_with(strokes, mask, lambda s, m: f(s, m).cast("int")), F.lit(0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(count(lambda s, m: s & m), count(lambda s, m: m)), F.lit(0.0)), F.coalesce(F.try_divide(count(lambda s, m: s & ~m), count(lambda s, m: s)), F.lit(0.0))


def roughness_score(roughness: Column) -> Column:
    """Piecewise: too smooth, natural, too rough."""
    return F.when(roughness < 0.01, roughness / 0.01 * 0.3).when(roughness < 0.1, 0.3 + (roughness - 0.01) / 0.09 * 0.7).otherwise(F.greatest(F.lit(0.4), 1.0 - (roughness - 0.1) * 3))


def slant_score(spread: Column) -> Column:
    """Piecewise over the spread of slants in degrees."""
    return F.when(spread < 0.5, spread / 0.5 * 0.3).when(spread < 5, 0.3 + (spread - 0.5) / 4.5 * 0.7).otherwise(F.greatest(F.lit(0.4), 1.0 - (spread - 5) / 10))


def handwriting_scores(text: DataFrame, letters: DataFrame, edges: DataFrame, size: float, margin: int = 20, step: int = 5) -> DataFrame:
    """font and the parts of its handwriting score, with the whole.

    ``text`` has the inked pixels (font, x, y, width) of a rendered line, ``letters`` those of
    single letters (font, letter, x, y), ``edges`` the edge pixels (font, x, y) of a word. What has
    too few pixels to judge gets the scores fixed for that.
    """
    columns = text.groupBy("font", "x").agg(F.max("y").alias("low"), (F.max("y") - F.min("y")).alias("tall"), F.max("width").alias("width"))
    wide = (F.col("x") >= margin) & (F.col("x") < F.col("width") - margin) & ((F.col("x") - margin) % step == 0) & (F.col("tall") > 0)
    lines = columns.groupBy("font").agg(F.count("*").alias("_n"), F.stddev_pop("low").alias("_low"), F.count_if(wide).alias("_wide"), F.stddev_pop(F.when(wide, F.col("tall"))).alias("_dev"), F.avg(F.when(wide, F.col("tall"))).alias("_mean"))
    each = letters.groupBy("font", "letter").agg(F.count("*").alias("n"), F.regr_slope("x", "y").alias("slope"))
    slants = each.groupBy("font").agg(F.count_if(F.col("n") > 0).alias("_letters"), F.count_if((F.col("n") > 10) & F.col("slope").isNotNull()).alias("_tall"), F.stddev_pop(F.when(F.col("n") > 10, F.degrees(F.atan("slope")))).alias("_slant"))
    w = Window.partitionBy("font").orderBy("x", "y")  # the edges of one word
    bends = edges.withColumn("_d2", F.lead("y").over(w) - 2 * F.col("y") + F.lag("y").over(w)).groupBy("font").agg(F.count("*").alias("_edges"), F.stddev_pop("_d2").alias("_rough"))
    rows = lines.join(slants, "font", "left").join(bends, "font", "left")
    parts = {
        "baseline_variation": F.when(F.col("_n") < 10, 0.0).otherwise(baseline_score(F.col("_low") / size)),
        "stroke_width_variation": F.when(F.col("_wide") < 5, 0.0).otherwise(width_score(F.col("_dev") / (F.col("_mean") + 1e-6))),
        "character_consistency": F.when(F.coalesce("_letters", F.lit(0)) < 3, 1.0).otherwise(0.95),
        "edge_roughness": F.when(F.coalesce("_edges", F.lit(0)) < 10, 0.0).when(F.col("_edges") < 20, 0.3).otherwise(roughness_score(F.col("_rough") / size)),
        "slant_variation": F.when(F.coalesce("_tall", F.lit(0)) < 3, 0.3).otherwise(slant_score(F.col("_slant"))),
    }
    return rows.select("font", *[v.alias(k) for k, v in parts.items()]).withColumn("overall", weighted(HANDWRITING_SCORE, ["character_consistency"]))
