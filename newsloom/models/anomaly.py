"""Isolation-forest anomalies per country and the validation of the method."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.operators.trends import FEATURES, country_day_features
from newsloom.plans.filters import anchor_number
from newsloom.session import work_dir
from newsloom.sources.lookups import with_country_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DAYS = 14
CONTAMINATION = 0.05
FLAG_BELOW = -0.1
TREES = 100
TREE_ROWS = 256


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(train: np.ndarray, seed: list[int], tree_rows: int = TREE_ROWS) -> dict[str, np.ndarray]:
    """One isolation tree over a row sample as a complete binary tree: feature and split per inner node, path per leaf.

    Node k has the children 2k + 1 and 2k + 2. A node that cannot be split sends every row to the left, so that each walk has
    the same number of steps and its path length waits in the leaf at its end. Levels are grown whole.
    """
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(train))
    depth = int(np.ceil(np.log2(max(size, 2))))
    rows = train[rng.choice(len(train), size, replace=False)]
    inner, width = (1 << depth) - 1, train.shape[1]
    draws = rng.random((inner, 2))
    feature, split = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at, stopped, every = np.zeros(size, np.int64), np.full(size, depth), np.arange(size)
    for level in range(depth):
        first, nodes = (1 << level) - 1, np.arange(1 << level)
        own = at - first
        low, high = np.full((len(nodes), width), np.inf), np.full((len(nodes), width), -np.inf)
        np.minimum.at(low, own, rows)
        np.maximum.at(high, own, rows)
        varied = high > low
        number = varied.sum(axis=1)
        picked = np.minimum((draws[first : first + len(nodes), 0] * number).astype(np.int64), np.maximum(number - 1, 0))
        chosen = (varied & (varied.cumsum(axis=1) == picked[:, None] + 1)).argmax(axis=1)
        below, above = low[nodes, chosen], high[nodes, chosen]
        with np.errstate(invalid="ignore"):
            value = below + draws[first : first + len(nodes), 1] * (above - below)
        # Rounding may give the upper end itself, which would leave one side empty.
        value = np.where(value < above, value, below)
        splits = number > 0
        feature[first : first + len(nodes)] = np.where(splits, chosen, 0)
        split[first : first + len(nodes)] = np.where(splits, value, np.inf)
        stopped = np.where(~splits[own] & (stopped == depth), level, stopped)
        at = 2 * at + 1 + (rows[every, feature[at]] > split[at])
    leaf = at - inner
    path = np.zeros(1 << depth)
    path[leaf] = stopped + np.array([_mean_path(n) for n in range(size + 1)])[np.bincount(leaf, minlength=len(path))[leaf]]
    return {"feature": feature, "split": split, "path": path}


def tree_paths(tree: dict[str, np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Path length of every row in a tree: one step down per level for all rows together."""
    inner = len(tree["feature"])
    values, start = np.ascontiguousarray(asked).ravel(), np.arange(len(asked)) * asked.shape[1]
    at = np.zeros(len(asked), np.int64)
    for _ in range(inner.bit_length()):
        above = values.take(start + tree["feature"].take(at)) > tree["split"].take(at)
        at = 2 * at + 1 + above
    return tree["path"].take(at - inner)


def forest_scores(forest: list[dict], asked: np.ndarray, tree_rows: int) -> np.ndarray:
    """Isolation scores in (-1, 0), lower for rows that are easier to set apart."""
    paths = np.zeros(len(asked))
    for tree in forest:
        paths += tree_paths(tree, asked)
    return -(2.0 ** (-paths / len(forest) / max(_mean_path(tree_rows), 1.0)))


def isolation_scores(train: np.ndarray, asked: np.ndarray, seed: int = 42, trees: int = TREES) -> np.ndarray:
    forest = [grow_tree(train, [seed, tree]) for tree in range(trees)]
    return forest_scores(forest, asked, min(TREE_ROWS, len(train)))


def mean_path(n: Column) -> Column:
    """`_mean_path` as a column."""
    more = F.greatest(n, F.lit(3)).cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2.0 * (F.ln(more - 1.0) + float(np.euler_gamma)) - 2.0 * (more - 1.0) / more)


def _drawn(seed: int, *parts) -> Column:
    """A number in [0, 1) that follows from the seed and the parts, the same in every engine that has MD5."""
    text = F.concat_ws(":", F.lit(seed), *(part.cast("string") if isinstance(part, Column) else F.lit(part) for part in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def forest_paths(
    rows: DataFrame, key: str, row: str, columns: Sequence[str], trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42
) -> DataFrame:
    """(key, row, rows_per_tree, mean path length): each key's rows in an isolation forest of its own, in built-in functions alone.

    A tree is not built and then asked: all rows of a key walk it while it grows. On each level a node takes the least and largest
    values of its sampled rows, draws a feature that varies and a split between the two, and its rows step to the child they
    belong in; a node that cannot be split, or has reached the depth, ends the walk. The draws follow from key, tree
    and node, so a task that runs twice grows the same trees. One shuffle by key and tree serves all levels, and a
    partition holds one key's rows: one per day.
    """
    tree = rows.select(key, row, F.array(*(F.round(F.col(c).cast("double"), 9) for c in columns)).alias("f")).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    )
    one = Window.partitionBy(key, "tree")
    ranked = F.row_number().over(one.orderBy(_drawn(seed, F.col(key), F.col("tree"), F.col(row), "row"), row))
    tree = tree.withColumns({"sampled": ranked <= tree_rows, "size": F.least(F.count("*").over(one), F.lit(tree_rows)).cast("int")})
    tree = tree.withColumns({
        "depth": F.ceil(F.log2(F.greatest("size", F.lit(2)).cast("double")) - 1e-9).cast("int"),
        "node": F.lit(1).cast("bigint"), "path": F.lit(None).cast("double"),
    })
    together = Window.partitionBy(key, "tree", "node")
    n = F.count_if("sampled").over(together)
    for level in range(max(1, (tree_rows - 1).bit_length())):
        taken = [F.when(F.col("sampled"), F.col("f")[at]) for at in range(len(columns))]
        tree = tree.withColumns({
            "low": F.array(*(F.min(value).over(together) for value in taken)),
            "high": F.array(*(F.max(value).over(together) for value in taken)),
            "n": n,
        })
        varied = F.filter(F.sequence(F.lit(1), F.lit(len(columns))), lambda at: F.element_at("high", at) > F.element_at("low", at))
        tree = tree.withColumn("varied", varied)
        pick = F.floor(_drawn(seed, F.col(key), F.col("tree"), F.col("node"), "feature") * F.size("varied")).cast("int")
        tree = tree.withColumn("chosen", F.get("varied", pick))
        below, above = F.element_at("low", F.col("chosen")), F.element_at("high", F.col("chosen"))
        value = below + _drawn(seed, F.col(key), F.col("tree"), F.col("node"), "split") * (above - below)
        tree = tree.withColumn("split", F.when(value < above, value).otherwise(below))
        ends = F.col("path").isNull() & (F.col("chosen").isNull() | (F.col("depth") <= level))
        goes = F.col("path").isNull() & ~ends
        step = F.when(goes, 2 * F.col("node") + (F.element_at("f", F.col("chosen")) > F.col("split")).cast("int")).otherwise(F.col("node"))
        tree = tree.withColumns({"node": step, "path": F.when(ends, level + mean_path(F.col("n"))).otherwise(F.col("path"))}).drop(
            "low", "high", "n", "varied", "chosen", "split"
        )
    tree = tree.withColumn("path", F.coalesce("path", F.col("depth") + mean_path(n)))
    return tree.groupBy(key, row).agg(F.max("size").alias("rows_per_tree"), F.avg("path").alias("mean_path"))


def _anchor_scores(features: DataFrame, contamination: float, seed: int) -> DataFrame:
    """Score of each country's newest day: its isolation score less that of the contamination's rank."""
    paths = forest_paths(features, "country_code", "SQLDATE", FEATURES, seed=seed)
    usual = F.greatest(mean_path(F.col("rows_per_tree")), F.lit(1.0))
    scored = paths.withColumn("score", -F.pow(F.lit(2.0), -F.col("mean_path") / usual))
    marked = scored.join(features.select("country_code", "SQLDATE", "is_anchor"), ["country_code", "SQLDATE"])
    newest = F.max(F.when(F.col("is_anchor"), F.col("score")))
    return marked.groupBy("country_code").agg((newest - F.percentile("score", F.lit(contamination))).alias("score"))


def _reason() -> Column:
    """The feature furthest from its mean, in standard deviations, as text."""
    deviations = F.array(
        *(
            F.struct(
                F.abs(F.col(f"z_{name}")).alias("size"),
                F.lit(-at).alias("earlier"),
                F.lit(name.replace("_", " ").capitalize()).alias("name"),
                F.col(f"z_{name}").alias("z"),
            )
            for at, name in enumerate(FEATURES)
        )
    )
    top = F.array_max(deviations)
    return F.concat(
        top["name"],
        F.lit(" "),
        F.format_string("%.1f", F.round(top["size"], 1)),
        F.lit("σ "),
        F.when(top["z"] > 0, "above").otherwise("below"),
        F.lit(" mean"),
    )


def country_anomalies(
    events: DataFrame,
    names: DataFrame,
    days: int = 90,
    anchor: date | None = None,
    contamination: float = CONTAMINATION,
    seed: int = 42,
    min_days: int = MIN_DAYS,
    flag_below: float = FLAG_BELOW,
) -> DataFrame:
    """Score of the newest day of every country with at least `min_days` days; below `flag_below` it is flagged with a reason.

    Forest, means, deviations and the reason are columns; a country has one row per day of the window.
    """
    features = country_day_features(events, days, anchor).fillna(0.0, list(FEATURES))
    marked = features.withColumn("is_anchor", F.col("SQLDATE") == anchor_number(events, 0, anchor))
    stats = marked.groupBy("country_code").agg(
        F.count("*").alias("days"),
        F.bool_or("is_anchor").alias("has_anchor"),
        *(
            column
            for name in FEATURES
            for column in (F.avg(name).alias(f"mean_{name}"), F.stddev_samp(name).alias(f"std_{name}"))
        ),
    ).where((F.col("days") >= min_days) & F.col("has_anchor"))
    scored = _anchor_scores(
        marked.join(stats.select("country_code"), "country_code", "left_semi"), contamination, seed
    )
    newest = marked.where("is_anchor").join(stats, "country_code").join(scored, "country_code")
    for name in FEATURES:
        spread = F.when(F.col(f"std_{name}") > 0, F.col(f"std_{name}")).otherwise(1.0)
        newest = newest.withColumn(f"z_{name}", (F.col(name) - F.col(f"mean_{name}")) / spread)
    flagged = F.col("score") < flag_below
    rows = with_country_names(newest, names, "country_code", "country")
    return rows.select(
        "country_code",
        "country_name",
        "country_display",
        flagged.alias("is_anomaly"),
        F.bround("score", 3).alias("score"),
        F.when(flagged, _reason()).alias("reason"),
    )


# --- validation -----------------------------------------------------------------

EVENT_FEATURES = ("GoldsteinScale", "AvgTone", "NumMentions", "QuadClass", "NumSources")
RATES = (0.03, 0.05, 0.08, 0.10)
SEEDS = (0, 1, 2, 3, 4)
VALIDATION_TREES = 200


def inject_anomalies(events: DataFrame, share: float = 0.05, seed: int = 7) -> DataFrame:
    """Events as normal rows, plus a share of them copied with extreme values."""
    fields = [F.col(c).cast("double").alias(c) for c in EVENT_FEATURES]
    normal = events.select("GLOBALEVENTID", *fields).dropna()

    def drawn(low: float, high: float, salt: int) -> Column:
        part = F.pmod(F.xxhash64("GLOBALEVENTID", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1e6
        return F.lit(low) + part * (high - low)

    # The ranges of the injected values.
    extreme = normal.where(drawn(0.0, 1.0, 0) < share).select(
        "GLOBALEVENTID",
        drawn(-10, -7, 1).alias("GoldsteinScale"),
        drawn(-15, -10, 2).alias("AvgTone"),
        F.floor(drawn(500, 2000, 3)).cast("double").alias("NumMentions"),
        F.lit(4.0).alias("QuadClass"),
        F.floor(drawn(100, 500, 4)).cast("double").alias("NumSources"),
    )
    return normal.withColumn("injected", F.lit(False)).unionByName(extreme.withColumn("injected", F.lit(True)))


TREE_TYPE = "seed int, feature array<bigint>, split array<double>, path array<double>"
#: Range of the hash that decides which rows a tree gets, and how many more rows than needed are looked at.
DRAWS, SPARE = 1 << 40, 4
#: Rows that one task of a validation scores, if there are so many.
ROWS_PER_TASK = 200_000


def draw_tree_rows(rows: DataFrame, total: int, trees: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(tree, rank, features): `tree_rows` of all `total` rows for each of `trees` trees, by hash.

    The trees are split into as many ranges as a row needs copies for every tree to meet SPARE times the rows it takes;
    a row enters one tree of each range, which is a single one for large tables. Only rows of small hash are ranked,
    and each task keeps `tree_rows` per tree before the shuffle, so a tree's group is bounded.
    """
    needed = SPARE * tree_rows * trees
    copies = max(1, min(trees, -(-needed // max(total, 1))))
    share = min(1.0, needed / max(total * copies, 1))
    row = ["GLOBALEVENTID", "injected", *EVENT_FEATURES]
    low, high = (F.floor((F.col("copy") + at) * trees / copies) for at in (0, 1))
    entered = (
        rows.select(*row, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        .withColumn("tree", (low + F.pmod(F.xxhash64("copy", *row), high - low)).cast("int"))
        .withColumn("draw", F.pmod(F.xxhash64("tree", F.lit("draw"), *row), F.lit(DRAWS)))
        .where(F.col("draw") < int(share * DRAWS))
    )
    ranked = F.row_number().over(Window.partitionBy("tree").orderBy("draw", *row))
    return entered.withColumn("rank", ranked).where(F.col("rank") <= tree_rows).select("tree", "rank", *EVENT_FEATURES)


def _grow_forests(rows: DataFrame, total: int, seeds: tuple[int, ...]) -> dict[int, list[dict]]:
    """A forest per seed, each tree grown by one task from its own rows; a tree has some 500 nodes at most."""
    trees, columns = VALIDATION_TREES, list(EVENT_FEATURES)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["tree"].iloc[0])
        seed = seeds[number // trees]
        train = group.sort_values("rank")[columns].to_numpy(float)
        return pd.DataFrame([{"seed": seed, **grow_tree(train, [seed, number % trees])}])

    drawn = draw_tree_rows(rows, total, len(seeds) * trees)
    forests: dict[int, list[dict]] = {seed: [] for seed in seeds}
    for row in drawn.groupBy("tree").applyInPandas(grow, TREE_TYPE).collect():
        tree = {name: np.array(row[name]) for name in ("feature", "split", "path")}
        forests[row["seed"]].append(tree)
    return forests


def score_metrics(
    scored: DataFrame, rates: tuple[float, ...] = RATES, seeds: tuple[int, ...] = SEEDS, accuracy: int = 10_000
) -> DataFrame:
    """Threshold, hits, precision, recall, F1 and score gap per contamination rate and seed.

    `scored` has `injected` and a column `seed_<n>` of scores per seed. A threshold is the score at its rate's rank, to
    one row in `accuracy`; rows below it are flagged. Two aggregations over the rows as they are: the
    thresholds, which are all that reaches the driver, and the counts. No rows give zeros.
    """
    rates = [float(rate) for rate in rates]
    cuts = scored.agg(*(F.percentile_approx(f"seed_{seed}", rates, accuracy).alias(f"seed_{seed}") for seed in seeds)).first()

    def cell(seed: int, at: int) -> Column:
        score = F.col(f"seed_{seed}")
        threshold = F.lit(cuts[f"seed_{seed}"][at] if cuts[f"seed_{seed}"] else None).cast("double")
        gap = F.avg(F.when(~F.col("injected"), score)) - F.avg(F.when(F.col("injected"), score))
        return F.struct(
            F.lit(rates[at]).alias("rate"),
            F.lit(seed).alias("seed"),
            threshold.alias("threshold"),
            F.count_if((score < threshold) & F.col("injected")).alias("hits"),
            F.count_if(score < threshold).alias("flagged"),
            F.count_if("injected").alias("injected"),
            gap.alias("separation_gap"),
        )

    cells = F.array(*(cell(seed, at) for seed in seeds for at in range(len(rates))))
    counts = scored.agg(cells.alias("cells")).select(F.inline("cells"))
    hits = F.col("hits").cast("double")
    counts = counts.withColumn("precision", F.when(F.col("flagged") > 0, hits / F.col("flagged")).otherwise(0.0))
    counts = counts.withColumn("recall", F.when(F.col("injected") > 0, hits / F.col("injected")).otherwise(0.0))
    both = F.col("precision") + F.col("recall")
    return counts.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def validate_anomalies(
    labelled: DataFrame, rates: tuple[float, ...] = RATES, seeds: tuple[int, ...] = SEEDS
) -> DataFrame:
    """Metrics of isolation forests per contamination rate and seed, see `score_metrics`.

    An isolation tree learns from a small row sample by design; each tree draws its own from all rows. Every
    row is scored by all seeds in one pass, whose result is a table in the shared folder.
    """
    spark, columns = labelled.sparkSession, list(EVENT_FEATURES)
    names = [f"seed_{seed}" for seed in seeds]
    total = labelled.count()
    # A row's walk through all trees costs far more than its shuffle, so the rows are spread over all cores first.
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // ROWS_PER_TASK)
    labelled = labelled.select("GLOBALEVENTID", *columns, "injected").repartition(tasks)
    forests = _grow_forests(labelled, total, seeds)
    tree_rows = min(TREE_ROWS, total)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[columns].to_numpy(float)
            scores = {n: forest_scores(forests[seed], asked, tree_rows) for n, seed in zip(names, seeds)}
            yield pd.DataFrame({"injected": batch["injected"], **scores})

    shape = "injected boolean, " + ", ".join(f"{name} double" for name in names)
    folder = work_dir(spark, "scores")
    labelled.select(*columns, "injected").mapInPandas(score, shape).write.parquet(folder)
    return score_metrics(spark.read.schema(shape).parquet(folder), rates, seeds)


def validation_summary(metrics: DataFrame) -> DataFrame:
    """Means per contamination rate over the seeds."""
    return metrics.groupBy("rate").agg(
        F.avg("precision").alias("avg_precision"),
        F.avg("recall").alias("avg_recall"),
        F.avg("f1").alias("avg_f1"),
        F.stddev_pop("f1").alias("f1_std"),
        F.avg("separation_gap").alias("avg_separation_gap"),
    )
