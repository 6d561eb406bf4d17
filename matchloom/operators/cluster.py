"""Groups of duplicates: equal checksums, leaders of similar images, components of similar videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.components import components
from matchloom.operators.materialize import cut
from matchloom.operators.ranking import ranked
from matchloom.operators.similarity import self_pairs, video_pairs

#: Rounds of leader_groups() before what is left goes to one task a component.
ROUNDS = 30


def exact_groups(files: DataFrame) -> DataFrame:
    """files (path, size, checksum) with equal checksums; group_id is the checksum."""
    return ranked(files.filter(F.col("checksum").isNotNull()).select(F.col("checksum").alias("group_id"), "path", "size"))


def leader_groups(hashes: DataFrame, threshold: int, rounds: int = ROUNDS) -> DataFrame:
    """Greedy leaders in path order: a path that no earlier leader takes is a leader and takes all free paths near it.

    hashes: path, phash, dhash, size; group_id is the leader's path; rows with a null hash are in no group. Equal
    hashes are one class, led by its least path. For threshold > 0 the leaders are the lexicographically first
    maximal independent set of the classes' similarity graph: a round decides all whose earlier neighbours are
    decided. What is open after `rounds` rounds, long chains, is decided by one task a component.
    """
    known = cut(hashes.filter(F.col("phash").isNotNull() & F.col("dhash").isNotNull()).select("path", "phash", "dhash", "size"))
    classes = known.groupBy("phash", "dhash").agg(F.min("path").alias("rep"))
    if threshold > 0:
        classes = cut(classes)
        reps = classes.withColumnRenamed("rep", "path")
        edges = cut(self_pairs(reps, threshold).select(F.col("b").alias("a"), F.col("a").alias("b")))  # b comes before a
        state = _leaders(reps.select(F.col("path").alias("node")), edges, rounds)
        led = edges.join(state.filter("leads").select(F.col("node").alias("b")), "b").groupBy("a").agg(F.min("b").alias("group_id"))
        lead = state.join(led.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("rep"), F.when(F.col("leads"), F.col("node")).otherwise(F.col("group_id")).alias("group_id"))
        classes = classes.join(lead, "rep").select("phash", "dhash", "group_id")
    else:
        classes = classes.withColumnRenamed("rep", "group_id")
    return ranked(known.join(classes, ["phash", "dhash"]).select("group_id", "path", "size"))


def _leaders(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """node, leads. edges (a, b): b comes before a."""
    state = cut(nodes.select("node", F.lit(None).cast("boolean").alias("leads")))
    for _ in range(rounds):
        near = edges.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.bool_or("leads").alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        state = cut(
            state.join(near.withColumnRenamed("a", "node"), "node", "left").select(
                "node",
                F.when(F.col("leads").isNotNull(), F.col("leads"))
                .when(F.coalesce("led", F.lit(False)), F.lit(False))
                .when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
                .alias("leads"),
            )
        )
        if not state.filter(F.col("leads").isNull()).limit(1).count():
            return state
    led = edges.join(state.filter("leads").select(F.col("node").alias("b")), "b").select(F.col("a").alias("node")).distinct().withColumn("_led", F.lit(True))
    state = cut(state.join(led, "node", "left").select("node", F.coalesce("leads", ~F.col("_led")).alias("leads")))
    # the earlier neighbours of open nodes are open or don't lead, so only the edges between open ones matter
    left = state.filter(F.col("leads").isNull()).select("node")
    inner = cut(edges.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi"))
    comp = components(inner.select(F.col("a").alias("u"), F.col("b").alias("v")))
    by_comp = inner.join(comp.withColumnRenamed("node", "a"), "a").groupBy("label")
    done = by_comp.applyInPandas(_loop, "node string, leads boolean")
    alone = left.join(done.select("node"), "node", "left_anti").withColumn("leads", F.lit(True))
    return cut(state.filter(F.col("leads").isNotNull()).unionByName(done).unionByName(alone))


def _loop(pdf):
    """The greedy loop over one component's edges."""
    import pandas as pd

    before: dict[str, list[str]] = {b: [] for b in pdf["b"]}
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        before.setdefault(a, []).append(b)
    leads: dict[str, bool] = {}
    for node in sorted(before, key=lambda p: p.encode()):
        leads[node] = not any(leads[b] for b in before[node])
    return pd.DataFrame({"node": list(leads), "leads": list(leads.values())})


def component_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Connected components of pairs (a, b) over nodes (path, size); group_id is the least path."""
    labels = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return ranked(nodes.join(labels, nodes.path == labels.node).select(F.col("label").alias("group_id"), "path", "size"))


def video_groups(videos: DataFrame, threshold: float) -> DataFrame:
    """videos: path, duration, frames, size."""
    videos = cut(videos)  # derived frames would be worked out twice in a self-join
    return component_groups(videos.select("path", "size"), video_pairs(videos, videos, threshold).filter("a < b"))
