"""Scores, intervals, calibration and agreement as aggregates and windows."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """``tp, fp, fn, tn`` for each group."""
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", predicted & actual), ("fp", predicted & ~actual), ("fn", ~predicted & actual), ("tn", ~predicted & ~actual))])


def f_score(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    p, r, b2 = ratio(tp, tp + fp), ratio(tp, tp + fn), beta * beta
    return ratio((1 + b2) * p * r, b2 * p + r)


def scores(counts: DataFrame, *by: str, beta: float = 1.0) -> DataFrame:
    """Micro precision, recall, F, specificity and accuracy over summed counts; 0 where undefined."""
    s = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select(*by, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f_score(tp, fp, fn, beta).alias("f"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def draw_multiplicity(unit: Column, rep: Column) -> Column:
    """How often a replicate draws a unit: a Poisson(1) count from arithmetic on the two
    numbers, so that a resample is the same in every engine and needs no draw table."""
    mixed = F.pmod((unit + 1) * 48271 + (rep + 1) * 69621 + (unit + 1) * (rep + 1) * 16807, F.lit(1_000_003))
    u = mixed / F.lit(1_000_003.0)
    steps, p, total = [], exp(-1.0), 0.0
    for k in range(6):
        total += p
        steps.append((k, total))
        p /= k + 1
    out = F.when(u < steps[0][1], 0)
    for k, limit in steps[1:]:
        out = out.when(u < limit, k)
    return out.otherwise(6)


def bootstrap(counts: DataFrame, reps: int = 200, level: float = 0.95, systems: tuple[str, str] | None = None) -> DataFrame:
    """Point and percentile interval of micro F, resampling whole units.

    ``counts``: ``unit`` (number), ``tp, fp, fn`` (with ``systems`` also ``tp2, fp2,
    fn2``, and the result is the difference of the second system on the same draws).
    Units are expanded by the fixed number of replicates and folded by a map-side
    aggregate, so the shuffle carries one row a task and replicate.
    """
    cols = ["tp", "fp", "fn"] + (["tp2", "fp2", "fn2"] if systems else [])
    r = counts.select("unit", *cols, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    m = draw_multiplicity(F.col("unit"), F.col("rep"))
    s = r.groupBy("rep").agg(*[F.sum(F.col(c) * m).alias(c) for c in cols])
    f = f_score(F.col("tp"), F.col("fp"), F.col("fn"))
    if systems:
        f = f_score(F.col("tp2"), F.col("fp2"), F.col("fn2")) - f
    a = (1 - level) / 2
    return s.select(f.alias("f")).agg(F.expr(f"percentile(f, {a})").alias("lo"), F.expr(f"percentile(f, {1 - a})").alias("hi"), F.avg((F.col("f") <= 0).cast("double")).alias("share_not_better"))


#: Blocks of scores for running sums; as many numbers reach the driver.
BLOCKS = 256


def running(t: DataFrame, by: str, *sums: str, down: bool = False) -> DataFrame:
    """``t`` with ``<c>_upto`` and ``<c>_all`` for each column: its sum up to and including the
    row's place in the order of ``by``, and in all. ``by`` is unique.

    Rows are cut at quantiles of ``by`` into blocks, summed in their block by a window,
    and raised by what the blocks before them hold: no task sorts all rows, and only the
    sums of ``BLOCKS`` blocks meet in one."""
    cuts = t.agg(F.percentile_approx(by, [i / BLOCKS for i in range(1, BLOCKS)], 20 * BLOCKS)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    placed = t.withColumn("_b", F.size(F.filter(bounds, lambda c: c < F.col(by))))
    block = placed.groupBy("_b").agg(*[F.sum(c).alias(c) for c in sums])
    before = W.orderBy(F.col("_b").desc() if down else F.col("_b")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    offsets = block.select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_off") for c in sums], *[F.sum(c).over(every).alias(f"{c}_all") for c in sums])
    inside = W.partitionBy("_b").orderBy(F.col(by).desc() if down else F.col(by)).rowsBetween(W.unboundedPreceding, 0)
    joined = placed.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums}).join(F.broadcast(offsets), "_b")
    return joined.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"{c}_off") for c in sums}).drop("_b", *[f"{c}_off" for c in sums])


def calibration_error(rows: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal mass, the first ones larger by one.

    Bins are cut on counts by distinct confidence, not by sorting all rows in one
    task; rows of one confidence that straddle a cut are shared out in proportion.
    """
    by = rows.groupBy(conf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("double")).alias("c"))
    at = running(by.where(F.col(conf).isNotNull()), conf, "n").withColumnsRenamed({"n_upto": "hi", "n_all": "total"}).withColumn("lo", F.col("hi") - F.col("n"))
    base, extra = F.expr(f"total div {bins}"), F.col("total") % bins
    cut = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumns({"a": F.col("bin") * base + F.least(F.col("bin").cast("long"), extra), "b": (F.col("bin") + 1) * base + F.least((F.col("bin") + 1).cast("long"), extra)})
    share = F.greatest(F.lit(0), F.least("hi", "b") - F.greatest("lo", "a"))
    binned = cut.withColumn("w", share).where("w > 0").groupBy("bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col(conf)).alias("s"), F.sum(F.col("w") * F.col("c") / F.col("n")).alias("c"), F.max("total").alias("total"))
    return binned.agg(F.sum(F.abs(F.col("s") - F.col("c")) / F.col("total")).alias("ece"))


def probability_losses(rows: DataFrame, q: str = "q", y: str = "y", eps: float = 1e-12) -> DataFrame:
    p = F.least(F.greatest(F.col(q), F.lit(eps)), F.lit(1 - eps))
    t = F.col(y).cast("double")
    return rows.agg(F.avg((F.col(q) - t) * (F.col(q) - t)).alias("brier"), F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("log_loss"))


def _by_score(rows: DataFrame, score: Column, good: Column) -> DataFrame:
    """``s, n, g``: rows and good rows for each distinct score; what threshold searches need."""
    return rows.groupBy(score.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("g"))


def risk_coverage(rows: DataFrame, q: str = "q", y: str = "y") -> DataFrame:
    """``conf, coverage, risk`` at each distinct confidence, surest first."""
    conf = F.greatest(F.col(q), 1 - F.col(q))
    t = _by_score(rows, F.round(conf, 9), (F.col(q) >= 0.5) != F.col(y))
    r = running(t.where("s IS NOT NULL"), "s", "n", "g", down=True)
    return r.select(F.col("s").alias("conf"), (F.col("n_upto") / F.col("n_all")).alias("coverage"), (F.col("g_upto") / F.col("n_upto")).alias("risk"), "n")


def coverage_threshold(rows: DataFrame, target: float = 0.98, q: str = "q", y: str = "y") -> DataFrame:
    """The least confidence from which on the verdicts reach the target accuracy; no row if none does."""
    r = risk_coverage(rows, q, y).where(1 - F.col("risk") >= target)
    best = r.agg(F.min(F.struct("conf", "coverage", "risk")).alias("b")).where("b IS NOT NULL")
    return best.select(F.col("b.conf").alias("t"), F.col("b.coverage").alias("coverage"), (1 - F.col("b.risk")).alias("accuracy"))


def best_f1_threshold(rows: DataFrame, q: str = "q", y: str = "y") -> DataFrame:
    """The threshold of the largest F1; of equal ones the smallest."""
    t = _by_score(rows, F.col(q), F.col(y))
    at = running(t.where("s IS NOT NULL"), "s", "n", "g", down=True).select("s", F.col("g_upto").alias("tp"), F.col("n_upto").alias("pos"), F.col("g_all").alias("all"))
    f1 = F.round(f_score(F.col("tp"), F.col("pos") - F.col("tp"), F.col("all") - F.col("tp")), 12)
    best = at.select("s", f1.alias("f1")).agg(F.max_by(F.struct("s", "f1"), F.struct("f1", (-F.col("s")).alias("o"))).alias("b")).where("b IS NOT NULL")
    return best.select(F.col("b.s").alias("threshold"), F.col("b.f1").alias("f1"))


def roc_auc(rows: DataFrame, q: str = "q", y: str = "y") -> DataFrame:
    """The chance that a positive scores above a negative, ties half; by counts of distinct scores."""
    t = _by_score(rows, F.col(q), F.col(y)).withColumn("b", F.col("n") - F.col("g"))
    r = running(t.where("s IS NOT NULL"), "s", "b")
    return r.select("g", "b", (F.col("b_upto") - F.col("b")).alias("below")).agg((F.sum(F.col("g") * (F.col("below") + F.col("b") / 2.0)) / (F.sum("g") * F.sum("b")).cast("double")).alias("auc"))


def specificity_at_recall(rows: DataFrame, recall: float = 0.95, q: str = "q", y: str = "y") -> DataFrame:
    """Specificity at the largest threshold whose recall reaches the target."""
    t = _by_score(rows, F.col(q), F.col(y)).withColumn("b", F.col("n") - F.col("g"))
    r = running(t.where("s IS NOT NULL"), "s", "g", "b", down=True)
    at = r.select("s", (F.col("g_upto") / F.col("g_all")).alias("r"), (1 - F.col("b_upto") / F.col("b_all")).alias("specificity"))
    return at.where(F.col("r") >= recall).agg(F.max_by("specificity", "s").alias("specificity"), F.max("s").alias("threshold"))


def pairwise_kappa(votes: DataFrame) -> DataFrame:
    """Cohen's kappa, agreement and number of common items for each pair of voters.

    ``votes``: ``item, voter, label``. Pairs are counted by label pair with a map-side
    aggregate; the pairs of one item are as many as its voters allow.
    """
    a = votes.select("item", F.col("voter").alias("voter_a"), F.col("label").alias("la"))
    b = votes.select("item", F.col("voter").alias("voter_b"), F.col("label").alias("lb"))
    cells = a.join(b, "item").where("voter_a < voter_b").groupBy("voter_a", "voter_b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    pair = ["voter_a", "voter_b"]
    total = cells.groupBy(*pair).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*pair, F.col("la").alias("l")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*pair, F.col("lb").alias("l")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*pair, "l"]).groupBy(*pair).agg(F.sum(F.col("na") * F.col("nb")).alias("by_chance"))
    po = F.col("same") / F.col("n")
    pe = F.coalesce("by_chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, pair, "left").select(*pair, "n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def adjudicate(votes: DataFrame) -> DataFrame:
    """``item, label, tier, agree, voters``: unanimous, majority (over half) or split, then UNCLEAR."""
    by = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("item").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("agree"), F.sum("n").alias("voters"))
    level = F.when((F.col("agree") == F.col("voters")) & (F.col("voters") > 1), "unanimous").when(F.col("agree") * 2 > F.col("voters"), "majority").otherwise("split")
    return top.select("item", F.when(level != "split", F.col("top")).otherwise("UNCLEAR").alias("label"), level.alias("tier"), "agree", "voters")


def majority_gold(votes: DataFrame, least: int = 2, applicable: bool = False) -> DataFrame:
    """B with ``least`` votes for it, N with that many against, else U; referenced counts
    against, or for it under the applicable reading."""
    b = F.col("label").isin("B", "R") if applicable else F.col("label") == "B"
    n = F.col("label") == "N" if applicable else F.col("label").isin("N", "R")
    counted = votes.groupBy("item").agg(F.count_if(b).alias("nb"), F.count_if(n).alias("nn"))
    return counted.select("item", F.when(F.col("nb") >= least, "B").when(F.col("nn") >= least, "N").otherwise("U").alias("label"))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    z = F.transform(logits, lambda x: x / F.lit(temperature))
    powers = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def mean_nll(rows: DataFrame, logits: str, label: str, temperature: Column | float) -> Column:
    """Mean negative log likelihood, an aggregate expression; ``label`` is the index of the true class."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    z = F.transform(F.col(logits), lambda x: x / t)
    top = F.array_max(z)
    norm = F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return F.avg(F.least(norm - F.element_at(z, F.col(label) + 1), F.lit(-log(1e-12))))


def fit_temperature(rows: DataFrame, logits: str = "logits", label: str = "label", rounds: int = 5, grid: int = 16) -> float:
    """The temperature of least NLL with its logarithm in [-3, 3]: a grid refined round by
    round, each round one pass that folds all temperatures at once."""
    lo, hi = -3.0, 3.0
    for _ in range(rounds):
        steps = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        row = rows.agg(*[mean_nll(rows, logits, label, exp(s)).alias(f"t{i}") for i, s in enumerate(steps)]).first()
        if row is None or row[0] is None:
            return 1.0
        i = min(range(grid + 1), key=lambda k: row[k])
        lo, hi = steps[max(0, i - 1)], steps[min(grid, i + 1)]
    return exp((lo + hi) / 2)
