"""Gradient-boosted trees over a bitmask of yes-or-no features, scored by built-in functions.

Fitting sees counts only: for every distinct bitmask the number of positive and negative
examples. There are at most 2**n_features of them, whatever the number of rows. A fitted model
is a list of depth-two trees, which ``score`` writes as CASE expressions over the bitmask.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    bias: float = 0.0
    #: (root bit, bit if set, bit if not set, leaves by 2 * root + inner)
    trees: list[tuple[int, int, int, tuple[float, float, float, float]]] = field(default_factory=list)

    def margin(self, bits: int) -> float:
        total = self.bias
        for root, yes, no, leaves in self.trees:
            r = bits >> root & 1
            total += leaves[2 * r + (bits >> (yes if r else no) & 1)]
        return total

    def probability(self, bits: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(bits)))))

    def score(self, bits: Column) -> Column:
        has = lambda b: bits.bitwiseAND(F.lit(1 << b)) != 0
        total = F.lit(self.bias)
        for root, yes, no, leaves in self.trees:
            upper = F.when(has(yes), leaves[3]).otherwise(leaves[2])
            lower = F.when(has(no), leaves[1]).otherwise(leaves[0])
            total = total + F.when(has(root), upper).otherwise(lower)
        return 1 / (1 + F.exp(-total))


def fit(counts: dict[int, tuple[float, float]], n_features: int, rounds: int = 12, rate: float = 0.5, smooth: float = 1.0) -> Boosted:
    """Newton boosting on the logistic loss; ``counts``: bitmask -> (positives, negatives)."""
    pos, neg = (sum(c[i] for c in counts.values()) for i in (0, 1))
    model = Boosted(math.log((pos + smooth) / (neg + smooth)))
    for _ in range(rounds):
        grad: dict[int, tuple[float, float]] = {}
        for bits, (p, n) in counts.items():
            q = model.probability(bits)
            grad[bits] = (p * (1 - q) - n * q, (p + n) * q * (1 - q))

        def best(keys: list[int]) -> tuple[float, int, float, float]:
            """(gain, bit, leaf if not set, leaf if set)"""
            found = (-1.0, 0, 0.0, 0.0)
            for bit in range(n_features):
                g, h = [0.0, 0.0], [smooth, smooth]
                for k in keys:
                    side = k >> bit & 1
                    g[side] += grad[k][0]
                    h[side] += grad[k][1]
                gain = g[0] ** 2 / h[0] + g[1] ** 2 / h[1]
                if gain > found[0] + 1e-12:
                    found = (gain, bit, rate * g[0] / h[0], rate * g[1] / h[1])
            return found

        split = max(range(n_features), key=lambda b: best([k for k in grad if k >> b & 1])[0] + best([k for k in grad if not k >> b & 1])[0])
        lower, upper = best([k for k in grad if not k >> split & 1]), best([k for k in grad if k >> split & 1])
        model.trees.append((split, upper[1], lower[1], (lower[2], lower[3], upper[2], upper[3])))
    return model


def threshold(model: Boosted, counts: dict[int, tuple[float, float]], precision: float) -> float:
    """The lowest score above which ``counts`` (held out of the fit) reach the precision; 1.1 if none does."""
    rows = sorted(((model.probability(b), p, n) for b, (p, n) in counts.items()), reverse=True)
    cut, pos, neg = 1.1, 0.0, 0.0
    for i, (score, p, n) in enumerate(rows):
        pos, neg = pos + p, neg + n
        tied = i + 1 < len(rows) and rows[i + 1][0] == score
        if not tied and pos > 0 and pos / (pos + neg) >= precision:
            cut = score
    return cut
