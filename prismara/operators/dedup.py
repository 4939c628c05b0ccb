"""Person deduplication by greedy leader clustering of embeddings with a co-occurrence veto.

A scene's candidates are few (persons of one scene) and each choice depends on the ones before, so a
scene is one group; scenes run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.93  # fixed value: similar from this cosine on


def leaders(vectors: np.ndarray, frames: list[set], scores: np.ndarray, threshold: float) -> np.ndarray:
    """Leader of each row: rows by falling score open a cluster or join the first whose leader is similar and whose frames are all others'."""
    order = np.argsort(-scores, kind="stable")
    leader = np.full(len(scores), -1)
    for place, i in enumerate(order):
        if leader[i] >= 0:
            continue
        leader[i], taken = i, set(frames[i])
        rest = [j for j in order[place + 1 :] if leader[j] < 0]
        if not rest:
            continue
        alike = vectors[rest] @ vectors[i]
        for j, s in zip(rest, alike, strict=True):
            if s >= threshold and not taken & frames[j]:
                leader[j] = i
                taken |= frames[j]
    return leader


def cluster_persons(candidates: DataFrame, scene: str, person: str, score: str, embedding: str, frames: str, threshold: float = THRESHOLD) -> DataFrame:
    """(scene, person, leader) of every candidate with an embedding."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(person, kind="stable")
        found = leaders(np.stack(pdf[embedding].to_numpy()).astype("float64"), [set(x) for x in pdf[frames]], pdf[score].to_numpy(), threshold)
        people = pdf[person].to_numpy()
        return pd.DataFrame({scene: pdf[scene].to_numpy(), person: people, "leader": people[found]})

    kinds = dict(candidates.dtypes)
    rows = candidates.where(F.col(embedding).isNotNull()).select(scene, person, score, embedding, frames)
    return rows.groupBy(scene).applyInPandas(one, f"{scene} {kinds[scene]}, {person} {kinds[person]}, leader {kinds[person]}")


def merge_clusters(clustered: DataFrame, scene: str, person: str, frames: str, score: str, best: list[str]) -> DataFrame:
    """Per cluster: the leader with its own ``score``, of each ``best`` column (a struct that begins with a score) the member's with the highest, and all frames.

    Of equal scores the one of the member that stands first by ``score`` holds.
    """
    mine = F.when(F.col(person) == F.col("leader"), F.col(score))
    tops = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(c)["score"], F.col(score), (-F.col(person)).alias("__p")))).alias(c) for c in best]
    return clustered.groupBy(scene, "leader").agg(F.count(F.lit(1)).alias("members"), F.max(mine).alias(score), *tops, F.array_sort(F.array_distinct(F.flatten(F.collect_list(frames)))).alias(frames))
