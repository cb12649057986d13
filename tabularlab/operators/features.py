"""Feature engineering and sampling (BIN1-3, FE1-FE10, SM1-SM6).

Learned parameters (bin edges, encodings, medians, means) are computed on the
training rows by one aggregation and applied by an expression or a join of a
small parameter table; nothing iterates over rows on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularlab.operators.quantiles import exact_quantiles


class DuplicateEdgesError(ValueError):
    pass


def _bin_expr(col: Column, edges: Sequence[float], include_lowest: bool,
              labels: Sequence | None = None) -> Column:
    """(lo, hi] bins numbered 1..len(edges)-1 (or labelled), outside -> null (D7)."""
    expr = None
    for i in range(1, len(edges)):
        lo, hi = edges[i - 1], edges[i]
        cond = (col > lo) & (col <= hi)
        if i == 1 and include_lowest:
            cond = (col >= lo) & (col <= hi)
        val = F.lit(labels[i - 1] if labels else i)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """BIN1: exact, interpolated quantile edges 0, 1/q, ..., 1 (q + 1 numbers on the driver)."""
    probs = [i / q for i in range(q + 1)]
    row = exact_quantiles(df, [], col, probs).first()
    edges = [row[f"q_{i}"] for i in range(q + 1)]
    if len(set(edges)) != len(edges):
        raise DuplicateEdgesError(f"bin edges of {col} are not unique: {edges}")
    return edges


def quantile_bins(df: DataFrame, col: str, q: int, out: str, fit: DataFrame | None = None) -> DataFrame:
    """BIN1: q equal-frequency bins, (lo, hi] with the minimum included; edges
    learned on ``fit`` (default: ``df``)."""
    edges = quantile_edges(fit if fit is not None else df, col, q)
    return df.withColumn(out, _bin_expr(F.col(col), edges, include_lowest=True))


def fixed_bins(df: DataFrame, col: str, edges: Sequence[float], out: str,
               labels: Sequence[str] | None = None) -> DataFrame:
    """BIN2: bins on given edges, (lo, hi]; outside -> null."""
    return df.withColumn(out, _bin_expr(F.col(col), edges, include_lowest=False, labels=labels))


def equal_width_edges(lo: float, hi: float, k: int) -> list[float]:
    """BIN2 helper: k equal-width bins over [lo, hi]; the first edge is lowered a
    little so that the minimum falls in bin 1 (pandas ``cut(bins=k)`` rule)."""
    w = (hi - lo) / k
    edges = [lo + i * w for i in range(k + 1)]
    edges[0] = lo - (hi - lo) * 0.001
    return edges


def bin_indicators(df: DataFrame, bin_col: str, n_bins: int, prefix: str) -> DataFrame:
    """BIN3: one 0/1 column per bin (null bin -> all zeros)."""
    return df.withColumns({f"{prefix}_{i}": F.coalesce((F.col(bin_col) == i).cast("int"), F.lit(0))
                           for i in range(1, n_bins + 1)})


def merge_rare(df: DataFrame, col: str, min_count: int, other: str = "Other", out: str | None = None) -> DataFrame:
    """FE1: categories with fewer than ``min_count`` rows become ``other``."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(counts, col, "left")
    return j.withColumn(out or col, F.when(F.col("_n") >= min_count, F.col(col)).otherwise(F.lit(other))).drop("_n")


def target_mean_encode(df: DataFrame, train_mask: Column, cat: str, target: str, out: str,
                       unseen: str = "null") -> DataFrame:
    """FE2: category -> mean target over the train rows, joined to every row by
    key (not by position).  ``unseen='global'`` falls back to the train mean."""
    train = df.where(train_mask)
    enc = train.groupBy(cat).agg(F.avg(target).alias(out))
    j = df.join(enc, cat, "left")
    if unseen == "global":
        j = j.withColumn(out, F.coalesce(F.col(out), train.agg(F.avg(target)).scalar()))
    return j


def earlier_totals(facts: DataFrame, keys: Sequence[str], period: str, target: str, train_end: int) -> DataFrame:
    """(keys, period, total, n): sum and count of the target over the keys' earlier periods up to ``train_end``.

    Sums are taken per (keys, period) first; the running sums then have one row per key and
    period, however many rows a hot key has."""
    known = F.when(F.col(period) <= train_end, F.col(target))
    sums = facts.groupBy(*keys, period).agg(F.coalesce(F.sum(known), F.lit(0)).alias("_s"), F.count(known).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, period, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("total"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n"))


def ordered_target_means(facts: DataFrame, ids: dict[str, Sequence[str]], period: str, target: str, train_end: int,
                         weight: float = 10.0) -> DataFrame:
    """ML21: ``facts`` with one column per entry of ``ids`` (name -> id columns): the mean of the target over
    the id's earlier training periods, drawn to the overall earlier mean by ``weight`` rows.

    A row never sees its own period or a later one, nor any period behind ``train_end``, so the
    statistic is the same for training and for held-out rows and leaks no target.
    No list of ids is held anywhere: unseen ids get the overall mean."""
    overall = earlier_totals(facts.withColumn("_all", F.lit(1)), ["_all"], period, target, train_end)      # one row per period
    mean = F.coalesce(F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    out = facts.join(overall.select(period, mean.alias("_mean")), period)
    for name, keys in ids.items():
        stats = earlier_totals(facts, keys, period, target, train_end).withColumnsRenamed({"total": "_total", "n": "_n"})
        out = out.join(stats, [*keys, period]) \
            .withColumn(name, (F.col("_total").cast("double") + weight * F.col("_mean")) / (F.col("_n") + weight)).drop("_total", "_n")
    return out.drop("_mean")


def fit_label_encoder(df: DataFrame, col: str) -> DataFrame:
    """FE3: code table (value, code) with codes 0..n-1 in sorted value order.
    The table has one row per distinct value; it is built by a distributed
    row numbering, not a single-partition window."""
    from tabularlab.operators.order import with_row_number
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_row_number(vals, ["value"], "_r").select("value", (F.col("_r") - 1).cast("int").alias("code"))


def apply_label_encoder(df: DataFrame, col: str, codes: DataFrame, out: str, unseen_code: int = 0) -> DataFrame:
    """FE4: codes by key join; unseen values get ``unseen_code`` and a flag."""
    j = df.join(codes.select(F.col("value").alias(col), F.col("code").alias("_code")), col, "left")
    return j.withColumn(f"{out}_unseen", F.col("_code").isNull().cast("int")) \
        .withColumn(out, F.coalesce(F.col("_code"), F.lit(unseen_code))).drop("_code")


def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FE5 parameters: one row with median, mean and sample std of each column
    (medians exact, from the sort-based quantile operator)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    params = df.agg(*aggs)
    for c in cols:
        med = exact_quantiles(df, [], c, [0.5]).select(F.col("q_0").alias(f"{c}__median"))
        params = params.unionByName(med, allowMissingColumns=True)
    return params.agg(*[F.first(x, ignorenulls=True).alias(x) for x in params.columns])


def apply_standardizer(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FE5: fill nulls with the train median + ``_na`` flag, then (x - mean) / std."""
    out = df
    p = params.first().asDict()  # one row of 3 x len(cols) numbers
    for c in cols:
        med, mean, std = p[f"{c}__median"], p[f"{c}__mean"], p[f"{c}__std"]
        out = out.withColumn(f"{c}_na", F.col(c).isNull().cast("int")) \
                 .withColumn(c, (F.coalesce(F.col(c).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(std))
    return out


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FE6: (x - min) / (max - min); min/max from one aggregation job, inlined as literals."""
    mm = df.agg(*[F.min(c).alias(f"{c}__mn") for c in cols], *[F.max(c).alias(f"{c}__mx") for c in cols]).first()
    out = df
    for c in cols:
        mn, mx = F.lit(mm[f"{c}__mn"]).cast("double"), F.lit(mm[f"{c}__mx"]).cast("double")
        out = out.withColumn(f"{c}_scaled", F.try_divide(F.col(c) - mn, mx - mn))
    return out


def parent_aggregate_features(child: DataFrame, parent_key: str, numeric: Sequence[str],
                              categorical: Mapping[str, Sequence[str]] = {}, digits: int = 6,
                              money: Sequence[str] = ()) -> DataFrame:
    """FE7: for each numeric child column count/sum/mean/std/min/max/skew/nunique/mode
    per parent, plus counts where a categorical child column equals a value and
    its mode.
    Skew is the bias-corrected sample skewness (D13); mode ties -> smallest.
    Columns in ``money`` are summed exactly in whole cents."""
    aggs = [F.count(F.lit(1)).alias("n_children")]
    for c in numeric:
        n = F.count(c)
        g1 = F.skewness(c)
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        total = (F.sum(F.round(F.col(c) * 100).cast("bigint")) / 100.0) if c in money else F.sum(c)
        aggs += [total.alias(f"sum_{c}"), F.round(F.avg(c), digits).alias(f"mean_{c}"),
                 F.round(F.stddev_samp(c), digits).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"),
                 F.max(c).alias(f"max_{c}"), F.round(skew, digits).alias(f"skew_{c}"),
                 F.countDistinct(c).alias(f"nunique_{c}")]
    for c, values in categorical.items():
        for v in values:
            aggs.append(F.count_if(F.col(c) == v).alias(f"n_{c}_{v}".replace(" ", "_").replace("-", "_")))
    feats = child.groupBy(parent_key).agg(*aggs)
    for c in [*numeric, *categorical]:
        counts = child.where(F.col(c).isNotNull()).groupBy(parent_key, c).agg(F.count(F.lit(1)).alias("_n"))
        mode = counts.groupBy(parent_key).agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias(f"mode_{c}"))
        feats = feats.join(mode, parent_key, "left")
    return feats


def noise_columns(df: DataFrame, key: str, seed: int, lo: float = 0.0, hi: float = 1.0, like: str | None = None) -> DataFrame:
    """FE8: reproducible noise from a hash of (key, seed): a 0/1 label and an
    independent uniform value in [lo, hi] (or in the range of the column ``like``).
    Each column has a seed of its own, so neither tells anything about the other."""
    from tabularlab.functions.hashing import unit_md5
    if like is not None:
        low, high = df.agg(F.min(like), F.max(like)).first()
        lo, hi = (float(low), float(high)) if low is not None else (lo, hi)
    own = lambda name: unit_md5(F.col(key), seed, name)
    return df.withColumn("noise_label", (own("label") < 0.5).cast("int")) \
             .withColumn("noise_value", F.lit(lo) + own("value") * F.lit(hi - lo))


def dollars_to_units(dollars: Column, price: Column) -> Column:
    """FE10: units = trunc(dollars / price); missing price -> 0."""
    return F.coalesce(F.try_divide(dollars, price).cast("bigint"), F.lit(0))


def head_tail_sample(df: DataFrame, cls: str, order: Sequence[str], n_head: int, n_tail: int,
                     tag: str = "split") -> DataFrame:
    """SM1: first ``n_head`` rows per class -> train, last ``n_tail`` -> valid;
    a row that would be in both stays train (disjoint by construction).
    Both windows end in ``row_number <= n`` filters (WindowGroupLimit runs
    before the shuffle, so a huge class ships only n rows per map task)."""
    w_head = Window.partitionBy(cls).orderBy(*order)  # order: column names (a total order)
    w_tail = Window.partitionBy(cls).orderBy(*_reverse(order))
    head = df.withColumn("_r", F.row_number().over(w_head)).where(F.col("_r") <= n_head).drop("_r") \
        .withColumn(tag, F.lit("train"))
    tail = df.withColumn("_r", F.row_number().over(w_tail)).where(F.col("_r") <= n_tail).drop("_r") \
        .withColumn(tag, F.lit("valid"))
    tail = tail.join(head.select(*df.columns), on=df.columns, how="left_anti")
    return head.unionByName(tail)


def _reverse(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, str):
            out.append(F.col(o).desc())
        else:
            raise TypeError("pass order as column names to reverse it")
    return out


def group_holdout(df: DataFrame, group: str, holdout_groups: DataFrame, tag: str = "split") -> DataFrame:
    """SM2: every row of the chosen groups goes to validation (one left join
    against the distinct chosen groups)."""
    keys = holdout_groups.select(F.col(group), F.lit(True).alias("_held")).distinct()
    j = df.join(keys, group, "left")
    return j.withColumn(tag, F.when(F.col("_held"), F.lit("valid")).otherwise(F.lit("train"))).drop("_held")


class MissingClassError(ValueError):
    pass


def assert_classes_on_both_sides(df: DataFrame, tag: str, cls: str) -> DataFrame:
    """SM2: every class present in the data must appear in each split; returns
    (split, n_rows, n_classes) - one aggregation, a few rows to the driver."""
    per = df.groupBy(tag).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(cls).alias("n_classes"))
    total = df.agg(F.countDistinct(cls)).first()[0]
    rows = per.collect()
    short = [r[tag] for r in rows if r["n_classes"] < total]
    if short or len(rows) < 2:
        raise MissingClassError(f"splits {short or [r[tag] for r in rows]} miss some of the {total} classes of {cls}")
    return per


def hash_split(df: DataFrame, key: str, fraction: float, seed: int = 0, tag: str = "split") -> DataFrame:
    """SM4: stable seeded split: a row is 'test' when a hash of (key, seed) falls
    under ``fraction``.  Same answer on every re-run and every partitioning."""
    from tabularlab.functions.hashing import unit_hash_of
    u = unit_hash_of(df, key, seed)
    return df.withColumn(tag, F.when(u < fraction, F.lit("test")).otherwise(F.lit("train")))


def stratified_folds(df: DataFrame, cls: str, order: Sequence, k: int, out: str = "fold") -> DataFrame:
    """SM5: per class, contiguous k folds under ``order`` (same sizes as ntile per
    class), computed from distributed row numbers so a dominant class is not
    sorted in a single task."""
    from tabularlab.operators.order import folds_within_groups
    return folds_within_groups(df, [cls], order, k, out)


def permute(df: DataFrame, seed: int, key: str, position: str = "position") -> DataFrame:
    """SM6: seeded random permutation: rows ordered by a hash of (key, seed),
    numbered 1..n with distributed row numbers."""
    from tabularlab.functions.hashing import unit_hash_of
    from tabularlab.operators.order import with_row_number
    return with_row_number(df.withColumn("_h", unit_hash_of(df, key, seed)), ["_h", key], position).drop("_h")
