"""Ordered rule lists by incremental reduced-error pruning, for numeric features.

For each class in turn, rules are grown on two thirds of the remaining examples (conditions
added by information gain), pruned on the other third (to the longest of the best prefixes, as
the examples vary less than the data), and kept while the pruned rule is
right more often than wrong there. What no rule covers is of the default class. The list is
exported as one SQL CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    label: str
    #: (feature, '<=' or '>=', threshold)
    conditions: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"{f} {op} {t:.6g}D" if "e" not in f"{t:.6g}" else f"{f} {op} {t:.9f}D" for f, op, t in self.conditions)


def _covered(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, t in rule:
        out &= x[:, f] <= t if op == "<=" else x[:, f] >= t
    return out


def _best_cut(v: np.ndarray, y: np.ndarray, base: float) -> tuple[float, str, float]:
    """(gain, operator, threshold) of the best single condition on one feature."""
    at = np.argsort(v, kind="stable")
    v, y = v[at], y[at]
    cut = np.flatnonzero(v[1:] > v[:-1])
    if not len(cut):
        return 0.0, "<=", 0.0
    p_low = np.cumsum(y)[cut].astype(float)
    n_low = cut + 1 - p_low
    p_all, n_all = y.sum(), len(y) - y.sum()
    best = (0.0, "<=", 0.0)
    for op, p, n in (("<=", p_low, n_low), (">=", p_all - p_low, n_all - n_low)):
        gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0.0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), op, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def _grow(x: np.ndarray, y: np.ndarray, most: int = 6) -> list[tuple[int, str, float]]:
    rule: list[tuple[int, str, float]] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and (inside & ~y).any():
        pos = y[inside]
        base = np.log2(pos.sum() / len(pos))
        gain, op, t, f = max(((*_best_cut(x[inside, f], pos, base), f) for f in range(x.shape[1])), key=lambda c: (c[0], -c[3]))
        if gain <= 1e-9:
            break
        rule.append((f, op, t))
        inside = _covered(rule, x)
    return rule


def _worth(rule, x: np.ndarray, y: np.ndarray) -> float:
    c = _covered(rule, x)
    p, n = (c & y).sum(), (c & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: np.ndarray, labels: list[str], names: list[str], order: list[str], seed: int = 5, most_rules: int = 16) -> list[Rule]:
    """The rule list for the classes in ``order``; all other labels are the default's."""
    rng = np.random.default_rng(seed)
    labels = np.array(labels, object)
    out: list[Rule] = []
    left = np.ones(len(labels), bool)
    for label in order:
        while (left & (labels == label)).any() and sum(r.label == label for r in out) < most_rules:
            at = np.flatnonzero(left)
            y = labels[at] == label
            # the split keeps the classes' shares
            grow = np.zeros(len(at), bool)
            for part in (np.flatnonzero(y), np.flatnonzero(~y)):
                part = rng.permutation(part)
                grow[part[: max(1, (2 * len(part)) // 3)]] = True
            rule = _grow(x[at[grow]], y[grow])
            if not rule:
                break
            px, py = x[at[~grow]], y[~grow]
            best = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (_worth(r, px, py), len(r)))
            if _worth(best, px, py) <= 0:
                break
            out.append(Rule(label, tuple((names[f], op, t) for f, op, t in best)))
            left[at] &= ~_covered(best, x[at])
    return out


def select(x: np.ndarray, labels: list[str], names: list[str], orders: list[tuple[str, ...]], held: tuple[np.ndarray, list[str]], seeds: int = 8, default: str = "none") -> list[Rule]:
    """The rule list, over orders of the classes and splits into grow and prune sets, with the fewest errors on held-out examples; then the shortest."""
    lists = [induce(x, labels, names, list(o), seed) for o in orders for seed in range(seeds)]
    errors = [sum(a != b for a, b in zip(apply(r, held[0], names, default), held[1], strict=True)) for r in lists]
    return min(zip(errors, map(len, lists), range(len(lists)), lists, strict=True))[3]


def case_expression(rules: list[Rule], default: str) -> str:
    whens = " ".join(f"WHEN {r.sql()} THEN '{r.label}'" for r in rules)
    return f"CASE {whens} ELSE '{default}' END" if rules else f"'{default}'"


def apply(rules: list[Rule], x: np.ndarray, names: list[str], default: str) -> list[str]:
    """The rules in Python, for tests."""
    out = np.full(len(x), default, object)
    done = np.zeros(len(x), bool)
    for r in rules:
        c = _covered([(names.index(f), op, t) for f, op, t in r.conditions], x) & ~done
        out[c] = r.label
        done |= c
    return list(out)
