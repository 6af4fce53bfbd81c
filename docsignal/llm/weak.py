"""Expectation-maximisation over counted vote patterns, the label model of the weak-supervision operators.

A pattern holds one vote per rule: 1 for, 0 against, -1 abstains. Its size is bounded by 3 ** rules,
so the model sees counts of patterns and never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class LabelModel:
    prior: float
    right_for: tuple[float, ...]
    right_against: tuple[float, ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """P(positive | votes), votes taken as independent given the class."""
        odds = math.log(self.prior / (1 - self.prior))
        for v, p, q in zip(votes, self.right_for, self.right_against, strict=True):
            if v == 1:
                odds += math.log(p / (1 - q))
            elif v == 0:
                odds += math.log((1 - p) / q)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def fit(patterns: dict[tuple[int, ...], float], n_rules: int, prior: float = 0.5, right: float | tuple[float, ...] = 0.8, floor: float = 0.55, steps: int = 100, tolerance: float = 1e-7, smooth: float = 1.0, fix_prior: bool = False) -> LabelModel:
    """EM. Rules start and stay better than chance (floor), which keeps the two classes from changing places.

    right: where the reliabilities start, for all rules or one by one; it counts as `smooth` votes of
    each. No patterns at all: the starting model.
    """
    start = right if isinstance(right, tuple) else (right,) * n_rules
    model = LabelModel(prior, start, start)
    total = sum(patterns.values())
    if not total:
        return model
    clip = lambda x: min(0.995, max(floor, x))
    for _ in range(steps):
        post = {v: model.posterior(v) for v in patterns}
        weight = sum(n * post[v] for v, n in patterns.items())
        p, q = [], []
        for j in range(n_rules):
            for_pos = sum(n * post[v] for v, n in patterns.items() if v[j] == 1)
            all_pos = sum(n * post[v] for v, n in patterns.items() if v[j] >= 0)
            against_neg = sum(n * (1 - post[v]) for v, n in patterns.items() if v[j] == 0)
            all_neg = sum(n * (1 - post[v]) for v, n in patterns.items() if v[j] >= 0)
            p.append(clip((for_pos + smooth * start[j]) / (all_pos + smooth)))
            q.append(clip((against_neg + smooth * start[j]) / (all_neg + smooth)))
        new = LabelModel(model.prior if fix_prior else min(0.99, max(0.01, weight / total)), tuple(p), tuple(q))
        moved = max(abs(a - b) for a, b in zip((model.prior, *model.right_for, *model.right_against), (new.prior, *new.right_for, *new.right_against), strict=True))
        model = new
        if moved < tolerance:
            break
    return model
