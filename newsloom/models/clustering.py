"""Event clusters from weighted texts, and how good they are."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.functions.text import event_text
from newsloom.plans.filters import EventFilter, select_events
from newsloom.session import work_dir

MIN_CLUSTERS, MAX_CLUSTERS = 2, 20
TEXT_TERMS, URL_TERMS = 1000, 300
TEXT_TOKEN, URL_TOKEN = r"\b\w\w+\b", r"[a-zA-Z]{3,}"


@dataclass(frozen=True)
class Clustering:
    """`clusters` describes each cluster, `members` names the cluster of every event."""

    clusters: DataFrame
    members: DataFrame


def _tokens(texts: DataFrame, pattern: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0)
    return StopWordsRemover(inputCol="words", outputCol="terms").transform(texts.withColumn("words", words))


def tfidf(texts: DataFrame, pattern: str, terms: int) -> PipelineModel | None:
    """Smoothed TF-IDF of distinct texts with their weights; None if no term is left.

    Terms are ranked by weighted frequency and at most `terms` of them, with their
    weights, come to the driver. The fitted stages are then applied row by row.
    """
    words = _tokens(texts, pattern).select("text", "weight", F.explode("terms").alias("term"))
    per_text = words.groupBy("text", "weight", "term").agg(F.count("*").alias("n"))
    ranked = (
        per_text.groupBy("term")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("used"), F.sum("weight").alias("texts"))
        .orderBy(F.desc("used"), "term")
        .limit(terms)
        .collect()
    )
    if not ranked:
        return None
    total = texts.agg(F.sum("weight")).first()[0]
    idf = [math.log((1 + total) / (1 + row["texts"])) + 1 for row in ranked]
    counts = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in ranked], inputCol="terms", outputCol="counts"
    )
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted")
    return PipelineModel([counts, scale, Normalizer(inputCol="weighted", outputCol="features")])


def _points(features: DataFrame) -> DataFrame:
    """Distinct vectors with their summed weight."""
    return features.groupBy("features").agg(F.sum("weight").alias("weight"))


def _fit(features: DataFrame, k: int, seed: int):
    """K-means of distinct weighted vectors, of which there must be at least k."""
    return KMeans(k=k, seed=seed, weightCol="weight", featuresCol="features").fit(features)


def describe(groups: DataFrame) -> DataFrame:
    """Size, mean Goldstein value, leading codes and label per cluster, largest first.

    `groups` are counted events: cluster_id, Actor1CountryCode, Actor2CountryCode, EventRootCode, how many events (n), and
    the sum and number of their Goldstein values (goldstein, rated).
    """
    stats = groups.groupBy("cluster_id").agg(
        F.sum("n").alias("event_count"), (F.sum("goldstein") / F.sum("rated")).alias("avg_goldstein_scale")
    )

    def leading(values, name: str) -> DataFrame:
        used = groups.select("cluster_id", "n", F.explode(values).alias("code")).where(F.col("code") != "")
        counts = used.groupBy("cluster_id", "code").agg(F.sum("n").alias("count"))
        order = Window.partitionBy("cluster_id").orderBy(F.desc("count"), "code")
        top = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
        codes = F.array_sort(F.collect_list(F.struct("rank", "code")))["code"]
        return top.groupBy("cluster_id").agg(codes.alias(name))

    countries = leading(F.array("Actor1CountryCode", "Actor2CountryCode"), "top_country_codes")
    codes = leading(F.array("EventRootCode"), "top_event_codes")
    rows = stats.join(countries, "cluster_id", "left").join(codes, "cluster_id", "left")
    places = F.array_join(F.slice("top_country_codes", 1, 2), "/")
    label = F.concat_ws(" - ", F.nullif(places, F.lit("")), F.concat(F.lit("Event "), F.get("top_event_codes", F.lit(0))))
    return rows.select(
        "cluster_id",
        F.when(label == "", "Mixed Cluster").otherwise(label).alias("label"),
        "event_count",
        "avg_goldstein_scale",
        F.coalesce("top_country_codes", F.array().cast("array<string>")).alias("top_country_codes"),
        F.coalesce("top_event_codes", F.array().cast("array<string>")).alias("top_event_codes"),
    ).orderBy(F.desc("event_count"), "cluster_id")


GROUP = ("Actor1CountryCode", "Actor2CountryCode", "EventRootCode")


def count_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Events per actors, root code and `keys`, with the sum and number of their Goldstein values."""
    return rows.groupBy(*GROUP, *keys).agg(
        F.count("*").alias("n"), F.sum("GoldsteinScale").alias("goldstein"), F.count("GoldsteinScale").alias("rated")
    )


def cluster_events(
    events: DataFrame,
    f: EventFilter,
    n_clusters: int = 5,
    newest: int | None = None,
    places: DataFrame | None = None,
    seed: int = 42,
    terms: int = TEXT_TERMS,
) -> Clustering:
    """Group events by actors, root code and Goldstein bucket.

    Events are read once and counted per actors, code and text; that table, kept in the shared folder, serves the fit, where
    equal texts enter once with their count as weight, and the description. Members get their cluster row by row,
    without a join, when they are asked for. `newest` limits all of it to that many of the latest events, `terms` the
    vocabulary to the most frequent ones.
    """
    spark = events.sparkSession
    rows = select_events(events, f, places)
    if newest is not None:
        rows = rows.orderBy(F.desc("SQLDATE"), F.desc("GLOBALEVENTID")).limit(newest)
    text = event_text(
        F.col("Actor1CountryCode"), F.col("Actor2CountryCode"), F.col("EventRootCode"), F.col("GoldsteinScale")
    )
    rows = rows.select("GLOBALEVENTID", "GoldsteinScale", *GROUP, text.alias("text"))
    counted, folder = count_groups(rows, "text"), work_dir(spark, "clusters")
    counted.write.parquet(folder)
    groups = spark.read.schema(counted.schema).parquet(folder)
    texts = groups.groupBy("text").agg(F.sum("n").cast("double").alias("weight"))
    wanted = max(MIN_CLUSTERS, min(n_clusters, MAX_CLUSTERS))
    stages = tfidf(texts, TEXT_TOKEN, terms)
    model = None
    if stages is not None:
        points = _points(stages.transform(_tokens(texts, TEXT_TOKEN))).persist()
        k = min(wanted, points.limit(wanted).count())
        if k > 1:
            model = _fit(points, k, seed)
        points.unpersist()

    def place(found: DataFrame) -> DataFrame:
        if model is None:
            return found.withColumn("cluster_id", F.lit(0))
        placed = model.transform(stages.transform(_tokens(found, TEXT_TOKEN)))
        return placed.withColumnRenamed("prediction", "cluster_id")

    named = place(texts.select("text")).select(F.col("text").alias("_text"), "cluster_id")
    described = groups.join(named, F.col("text").eqNullSafe(F.col("_text")))
    return Clustering(describe(described), place(rows).select("GLOBALEVENTID", "cluster_id"))


def cluster_quality(
    events: DataFrame,
    f: EventFilter,
    ks: tuple[int, ...] = tuple(range(2, 11)),
    seeds: tuple[int, ...] = (0, 1, 2, 3, 4),
    terms: int = URL_TERMS,
) -> DataFrame:
    """Inertia and silhouette of clusters of source URLs for every k.

    A k that is not below the number of distinct vectors is left out. The best k also gets
    its stability: one minus the mean variation of its ordered
    cluster sizes over several seeds. Only these few figures reach the driver. `terms` limits the vocabulary
    to the most frequent ones.
    """
    rows = select_events(events, f, None, F.col("SOURCEURL").isNotNull())
    texts = rows.groupBy(F.col("SOURCEURL").alias("text")).agg(F.count("*").cast("double").alias("weight"))
    texts = texts.persist()
    stages = tfidf(texts, URL_TOKEN, terms)
    shape = "k int, inertia double, silhouette double, is_best boolean, stability double"
    if stages is None:
        return events.sparkSession.createDataFrame([], shape)
    features = _points(stages.transform(_tokens(texts, URL_TOKEN))).persist()
    vectors = features.limit(max(ks) + 1).count()
    judge = ClusteringEvaluator(weightCol="weight")
    figures = []
    for k in (k for k in ks if k < vectors):
        model = _fit(features, k, 0)
        figures.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(features)))))
    if not figures:
        return events.sparkSession.createDataFrame([], shape)
    best = max(figures, key=lambda figure: figure[2])[0]
    sizes = []
    for seed in seeds:
        grouped = _fit(features, best, seed).transform(features).groupBy("prediction").agg(F.sum("weight").alias("n"))
        ordered = sorted((row["n"] for row in grouped.collect()), reverse=True)
        sizes.append(ordered + [0.0] * (best - len(ordered)))
    variation = []
    for at_rank in zip(*sizes):
        mean = sum(at_rank) / len(at_rank)
        spread = math.sqrt(sum((n - mean) ** 2 for n in at_rank) / len(at_rank))
        variation.append(spread / mean if mean else 0.0)
    stability = 1 - sum(variation) / len(variation)
    features.unpersist()
    texts.unpersist()
    return events.sparkSession.createDataFrame(
        [(k, cost, score, k == best, stability if k == best else None) for k, cost, score in figures], shape
    )
