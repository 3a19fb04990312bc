"""Connected components of a table of links: links are contracted batch by batch, then by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import drop, save


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after u and v have been joined."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        label = parent[label]


def contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's links (u, v) as stars around its groups' least nodes."""
    for f in frames:
        nodes, at = np.unique(np.concatenate([f["u"], f["v"]]), return_inverse=True)
        label = merge(np.arange(len(nodes)), at[: len(f)], at[len(f) :])
        member = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"u": nodes[member], "v": nodes[label[member]]})


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (u, v): label is the least node that can be reached.

    Neighbourhoods are never gathered: each step needs a node's least neighbour only, a partial aggregate that is joined
    back. Links go from a node to a lesser one (u > v) and are never turned round: a node's least neighbour is found from
    its links to lesser ones, and every link then moves to that of its v. So a round has a row for each link. Each round is written to the shared folder and
    ends when the links no longer change. Batches of links are contracted to stars on the way, which shortens long chains and so saves rounds.
    """
    spark = links.sparkSession
    pairs = links.where("u <> v").select("u", "v").mapInPandas(contracted, "u long, v long").distinct()
    edges, path = save(pairs, "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        mark = now
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new, new_path = save(small.mapInPandas(contracted, "u long, v long").distinct(), "links")
        drop(spark, path)
        edges, path = new, new_path
