"""Per-page weight search by coordinate ascent: inherently sequential, so it
runs per query in a grouped function over that query's pool."""

from __future__ import annotations

from bisect import bisect, bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .contracts import CHANNELS
from .oracle import TOLERANCE, checked

TOP = 10
_SCHEMA = "query_id string, query_profile int, query_ndcg10 double, page_ndcg10 double, changed int, updates int, profiles array<int>"


class _Ranking:
    """Pages in a fixed id order with current scores, kept sorted; nDCG@10 after
    moving one page. Only the ten first of the other pages matter for that, and
    they are among the eleven first of all: a move costs those ten places and,
    once it is made, a search and an insertion in the order."""

    def __init__(self, relevance: np.ndarray, scores: np.ndarray):
        self.gain = (np.exp2(relevance) - 1).tolist()
        k = min(len(relevance), TOP)
        self.discount = (1 / np.log2(np.arange(2, k + 2))).tolist()
        self.ideal = sum(g * d for g, d in zip(sorted(self.gain, reverse=True), self.discount))
        self.scores = scores.tolist()
        # pages come in ascending id order, so their numbers break ties
        self.order = sorted((-s, i) for i, s in enumerate(self.scores))

    def _value(self, pages: list[int]) -> float:
        return min(1.0, max(0.0, sum(self.gain[p] * d for p, d in zip(pages, self.discount)) / self.ideal)) if self.ideal > 0 else 0.0

    def ndcg(self) -> float:
        return self._value([p for _, p in self.order[:TOP]])

    def moved(self, page: int, score: float) -> float:
        """nDCG if ``page`` had this score."""
        first = [x for x in self.order[: TOP + 1] if x[1] != page][:TOP]
        first.insert(bisect(first, (-score, page)), (-score, page))
        return self._value([p for _, p in first[:TOP]])

    def move(self, page: int, score: float) -> None:
        self.order.pop(bisect_left(self.order, (-self.scores[page], page)))
        self.scores[page] = score
        insort(self.order, (-score, page))

    def reaches(self, page: int, best: float) -> bool:
        """Whether moving ``page`` to some score up to ``best`` can change the
        first ten pages."""
        last = self.order[min(len(self.order), TOP) - 1]
        return (-self.scores[page], page) <= last or (-best, page) < last


def _metrics(ranking: _Ranking, relevance: np.ndarray) -> tuple[float, float, float]:
    hits = relevance[[p for _, p in ranking.order]] > 0
    total = hits.sum()
    first = np.flatnonzero(hits[:TOP])
    return ranking.ndcg(), float(hits[:3].sum() / total) if total else 0.0, 1.0 / (first[0] + 1) if len(first) else 0.0


def search(channels: np.ndarray, relevance: np.ndarray, profiles: np.ndarray, sweeps: int = 2) -> tuple[int, float, float, np.ndarray, int]:
    """(query profile, its nDCG, page-level nDCG, profile of each page, updates).
    Pages must come in ascending order of their ids."""
    fused = channels[:, :1] * profiles[:, 0] + channels[:, 1:2] * profiles[:, 1] + channels[:, 2:] * profiles[:, 2]
    best, top = 0, None
    for i in range(len(profiles)):
        now = _metrics(_Ranking(relevance, fused[:, i]), relevance)
        if top is None or next((x > y for x, y in zip(now, top) if abs(x - y) > TOLERANCE), False):
            best, top = i, now
    ranking = _Ranking(relevance, fused[:, best])
    chosen = np.full(len(relevance), best)
    if ranking.ideal <= 0:
        return best, top[0], top[0], chosen, 0
    now, updates = top[0], 0
    rows, highest, start = fused.tolist(), fused.max(1).tolist(), np.argsort(-fused[:, best], kind="stable").tolist()
    for _ in range(sweeps):
        before = updates
        for page in start:
            if not ranking.reaches(page, highest[page]):
                continue
            pick, value = chosen[page], now
            for i, score in enumerate(rows[page]):
                if i != chosen[page] and score != ranking.scores[page] and (v := ranking.moved(page, score)) > value + TOLERANCE:
                    pick, value = i, v
            if pick != chosen[page]:
                chosen[page] = pick
                ranking.move(page, rows[page][pick])
                now, updates = ranking.ndcg(), updates + 1
        if updates == before:
            break
    return best, top[0], now, chosen, updates


def page_oracle(df: DataFrame, profiles, sweeps: int = 2) -> DataFrame:
    """(query_id, query_profile, query_ndcg10, page_ndcg10, changed, updates,
    profiles) from normalized score rows with relevance; profiles counts the use
    of each profile over the pages."""
    weights = np.array(checked(profiles))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id")
        best, base, value, chosen, updates = search(pdf[CHANNELS].to_numpy(float), pdf["relevance"].to_numpy(float), weights, sweeps)
        row = [pdf["query_id"].iloc[0], best, base, value, int((chosen != best).sum()), updates, np.bincount(chosen, minlength=len(weights)).tolist()]
        return pd.DataFrame([row], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return df.select("query_id", "page_id", "relevance", *CHANNELS).groupBy("query_id").applyInPandas(run, _SCHEMA)
