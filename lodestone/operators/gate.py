"""The learned gate: features, scoring, losses and training.

Features and scores are column expressions over windows that share one
partitioning. Training is in ``training``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import discount, dot3, length_feature, softmax3, softplus
from .contracts import CHANNELS, label_free
from .normalize import minmax_of
from .decisions import loss_alignment as aligned
from .ranking import average_rank, median_margin, normalized_rank, rank_of, spread

SHORT = [c.removesuffix("_score") for c in CHANNELS]
FEATURES = [*[f"{c}_minmax" for c in SHORT], *[f"{c}_rr" for c in SHORT], *[f"{c}_gap" for c in SHORT], *[f"{a}_{b}_apart" for a, b in combinations(SHORT, 2)], "query_length"]
FEATURES_FIRST = [*CHANNELS, *[f"{c}_nrank" for c in SHORT], *[f"{c}_margin" for c in SHORT], *[f"{c}_gap" for c in SHORT], "rank_spread"]


def _gap(score: str, rank: str, keys) -> Column:
    w = Window.partitionBy(*keys)
    return F.coalesce(F.max(F.when(F.col(rank) == 1, F.col(score))).over(w) - F.max(F.when(F.col(rank) == 2, F.col(score))).over(w), F.lit(0.0))


def features(rows: DataFrame, texts: DataFrame | None = None, keys=("query_id",)) -> DataFrame:
    """``rows`` with the 13 features: normalized scores, reciprocal ranks, top
    gaps, channel differences and query length (0 without ``texts``)."""
    keys = list(keys)
    d = label_free(rows)
    d = d.withColumns({f"{c}_minmax": minmax_of(f"{c}_score", keys, 0.0) for c in SHORT} | {f"__{c}": rank_of(f"{c}_score", keys) for c in SHORT})
    d = d.withColumns({f"{c}_rr": 1.0 / F.col(f"__{c}") for c in SHORT} | {f"{c}_gap": _gap(f"{c}_minmax", f"__{c}", keys) for c in SHORT})
    d = d.withColumns({f"{a}_{b}_apart": F.abs(F.col(f"{a}_minmax") - F.col(f"{b}_minmax")) for a, b in combinations(SHORT, 2)}).drop(*[f"__{c}" for c in SHORT])
    if texts is None:
        return d.withColumn("query_length", F.lit(0.0))
    return d.join(texts.select("query_id", length_feature("text").alias("query_length")), "query_id")


def features_first(rows: DataFrame, keys=("query_id",)) -> DataFrame:
    """The earlier 13 features: scores, normalized ranks, margins to the median,
    top gaps, spread of the ranks."""
    keys = list(keys)
    d = label_free(rows).withColumns({f"__{c}": rank_of(f"{c}_score", keys) for c in SHORT})
    d = d.withColumns({f"{c}_nrank": normalized_rank(f"{c}_score", keys) for c in SHORT} | {f"{c}_margin": median_margin(f"{c}_score", keys) for c in SHORT} | {f"{c}_gap": _gap(f"{c}_score", f"__{c}", keys) for c in SHORT})
    return d.withColumn("rank_spread", spread(*[f"{c}_nrank" for c in SHORT])).drop(*[f"__{c}" for c in SHORT])


def linear_logits(weights, bias, names=FEATURES, source: Callable[[str], Column] = F.col) -> list[Column]:
    """Three logits, features always summed in order."""
    out = []
    for w, b in zip(weights, bias):
        x = F.lit(float(b))
        for n, v in zip(names, w):
            x = x + F.lit(float(v)) * source(n)
        out.append(x)
    return out


def mlp_logits(hidden, hidden_bias, weights, bias, names=FEATURES, source: Callable[[str], Column] = F.col) -> list[Column]:
    units = [F.tanh(x) for x in linear_logits(hidden, hidden_bias, names, source)]
    out = []
    for w, b in zip(weights, bias):
        x = F.lit(float(b))
        for u, v in zip(units, w):
            x = x + F.lit(float(v)) * u
        out.append(x)
    return out


def without(weights, omitted: list[str], names=FEATURES):
    """Weights with the columns of omitted features at zero."""
    return [[0.0 if n in omitted else v for n, v in zip(names, row)] for row in weights]


def predict(feats: DataFrame, weights, bias, level: str = "page", temperature: float = 1.0, keys=("query_id",)) -> DataFrame:
    """(keys, page_id, w_bm25, w_dense, w_visual, score): a page gate reads each
    row's features, a query gate their means over the query."""
    source = F.col if level == "page" else (lambda n: F.avg(n).over(Window.partitionBy(*keys)))
    gate = softmax3(*linear_logits(weights, bias, source=source), temperature=temperature)
    d = feats.withColumns(dict(zip(("w_bm25", "w_dense", "w_visual"), gate)))
    return d.withColumn("score", dot3(*[f"{c}_minmax" for c in SHORT], [F.col(f"w_{c}") for c in SHORT])).select(*keys, "page_id", "w_bm25", "w_dense", "w_visual", "score")


def gate_profile(predictions: DataFrame) -> DataFrame:
    """One row: largest deviation from the simplex, queries whose weights vary."""
    per = predictions.groupBy("query_id").agg(
        F.max(F.abs(F.col("w_bm25") + F.col("w_dense") + F.col("w_visual") - 1.0)).alias("d"),
        (F.count_distinct(F.struct("w_bm25", "w_dense", "w_visual")) > 1).cast("long").alias("varies"),
    )
    return per.agg(F.max("d").alias("simplex_deviation"), F.sum("varies").alias("varying_queries"))


def pairwise_loss(scored: DataFrame, weighted: bool = False, k: int = 10) -> DataFrame:
    """One row (loss, queries): mean over queries of the logistic loss of positive
    over negative pages; with ``weighted``, pairs weigh by their DCG exchange.

    Queries without a pair are left out. Pairs stay inside a query's pool, which
    is bounded by the pool's depth.
    """
    d = scored.withColumn("rank", rank_of("score"))
    cut = F.when(F.col("rank") <= k, discount("rank")).otherwise(0.0)
    d = d.select("query_id", "score", "relevance", cut.alias("cut"))
    pos = d.where("relevance > 0").select("query_id", F.col("score").alias("p"), F.col("cut").alias("pc"))
    neg = d.where("relevance <= 0").select("query_id", F.col("score").alias("n"), F.col("cut").alias("nc"))
    pairs = pos.join(neg, "query_id").select("query_id", softplus(F.col("n") - F.col("p")).alias("loss"), F.abs(F.col("pc") - F.col("nc")).alias("w"))
    value = F.coalesce(F.try_divide(F.sum(F.col("loss") * F.col("w")), F.sum("w")), F.lit(0.0)) if weighted else F.avg("loss")
    return pairs.groupBy("query_id").agg(value.alias("loss")).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("queries"))


def listwise_loss(units: DataFrame) -> DataFrame:
    """One row (loss, queries): softmax cross-entropy of (query_id, score,
    relevance) units, positives sharing the target equally."""
    w = Window.partitionBy("query_id")
    d = units.withColumn("top", F.max("score").over(w)).withColumn("hit", (F.col("relevance") > 0).cast("double"))
    per = d.groupBy("query_id").agg(
        (F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.first("top")).alias("lse"), F.sum(F.col("hit") * F.col("score")).alias("s"), F.sum("hit").alias("n"),
    ).where("n > 0")
    return per.agg(F.avg(F.col("lse") - F.col("s") / F.col("n")).alias("loss"), F.count(F.lit(1)).alias("queries"))


#: Pairs of pages, each under some profiles, that are compared at once.
PAIRS = 1 << 18


def _profile_losses(profiles, k: int):
    """Mean plain and weighted pairwise losses of a query under every profile."""
    weights, names = np.array(profiles, float), ["query_id", "profile", "plain", "weighted"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id")
        (a, b, c), hit = pdf[CHANNELS].to_numpy(float).T, pdf["relevance"].to_numpy(float) > 0
        if hit.all() or not hit.any():
            return pd.DataFrame(columns=names)
        score = weights[:, :1] * a + weights[:, 1:2] * b + weights[:, 2:] * c
        gain, cut = np.zeros(len(hit)), np.empty(score.shape)
        gain[: min(k, len(hit))] = 1 / np.log2(np.arange(2, min(k, len(hit)) + 2))
        np.put_along_axis(cut, np.argsort(-score, axis=1, kind="stable"), np.broadcast_to(gain, score.shape), 1)
        step, plain, weighted = max(1, PAIRS // int(hit.sum() * (~hit).sum())), [], []
        for at in range(0, len(weights), step):
            s, t = score[at : at + step], cut[at : at + step]
            loss = np.logaddexp(0, s[:, None, ~hit] - s[:, hit, None])
            w = np.abs(t[:, hit, None] - t[:, None, ~hit])
            total = w.sum((1, 2))
            plain.append(loss.mean((1, 2)))
            weighted.append(np.divide((loss * w).sum((1, 2)), total, out=np.zeros(len(s)), where=total != 0))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "profile": np.arange(len(weights)), "plain": np.concatenate(plain), "weighted": np.concatenate(weighted)})

    return run


def loss_alignment(rows: DataFrame, profiles, means: DataFrame, k: int = 10) -> DataFrame:
    """(kind, rho, least_profile, gap, gate), one row for the plain and one for the
    weighted pairwise loss, from rows of channels and relevance and the profiles'
    mean ndcg10.

    rho is the rank correlation of loss and nDCG over the profiles, gap what the
    first profile of the least loss lacks to the best nDCG. Losses and means are
    compared to nine digits. A query's pairs are matrices inside its pool, for
    so many profiles together as make PAIRS of them; one row a query and profile
    leaves it.
    """
    d = rows.select("query_id", "page_id", "relevance", *CHANNELS)
    per = d.groupBy("query_id").applyInPandas(_profile_losses(profiles, k), "query_id string, profile int, plain double, weighted double")
    loss = per.groupBy("profile").agg(F.round(F.avg("plain"), 9).alias("plain"), F.round(F.avg("weighted"), 9).alias("weighted"))
    j = loss.join(means.select("profile", F.round("ndcg10", 9).alias("ndcg10")), "profile")
    j = j.select("profile", "ndcg10", F.expr("stack(2, 'plain', plain, 'weighted', weighted) AS (kind, loss)"))
    j = j.withColumn("x", average_rank("loss", ["kind"])).withColumn("y", average_rank("ndcg10", ["kind"]))
    least = F.min(F.struct("loss", "profile", "ndcg10"))
    out = j.groupBy("kind").agg(F.corr("x", "y").alias("rho"), least["profile"].alias("least_profile"), (F.max("ndcg10") - least["ndcg10"]).alias("gap"))
    return out.withColumn("gate", aligned())


def save(weights, bias, settings: dict) -> str:
    """Weights as JSON, bound to a hash of the settings they were trained with."""
    return json.dumps({"weights": np.asarray(weights).tolist(), "bias": np.asarray(bias).tolist(), "settings": _bound(settings)})


def load(text: str, settings: dict) -> tuple[np.ndarray, np.ndarray]:
    held = json.loads(text)
    if held["settings"] != _bound(settings):
        raise ValueError("these weights belong to other settings")
    return np.array(held["weights"]), np.array(held["bias"])


def _bound(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
