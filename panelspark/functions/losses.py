"""Focal loss and its derivatives in the logit, and log loss, as column expressions and, for boosting tasks, on arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.numeric import as_column

FOCAL_EPSILON = 1e-15
LOG_LOSS_EPSILON = 2.220446049250313e-16


def clip_probability(column: Column | str, epsilon: float) -> Column:
    c = as_column(column)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(epsilon)), F.lit(1.0 - epsilon)))


@dataclass(frozen=True)
class FocalLoss:
    """Focal loss with focusing power ``gamma`` and optional positive-class weight ``alpha``."""

    gamma: float = 2.0
    alpha: float | None = None

    def _terms(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class weight, class sign and probability of the true class."""
        p = np.clip(1.0 / (1.0 + np.exp(-margin)), FOCAL_EPSILON, 1.0 - FOCAL_EPSILON)
        weight = 1.0 if self.alpha is None else np.where(y == 1, self.alpha, 1.0 - self.alpha)
        return weight, np.where(y == 1, 1.0, -1.0), np.where(y == 1, p, 1.0 - p)

    def values(self, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
        weight, _, q = self._terms(y, margin)
        return -weight * (1.0 - q) ** self.gamma * np.log(q)

    def derivatives(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative in the margin, as ``gradient`` and ``hessian``."""
        weight, sign, q = self._terms(y, margin)
        g, f, log = self.gamma, 1.0 - q, np.log(q)
        slope = g * q * log - f
        curve = -g * f ** (g - 1.0) * slope + f**g * (g * log + g + 1.0)
        return weight * sign * f**g * slope, weight * curve * q * f

    def start(self, n1: int, n0: int) -> float:
        """Log odds of the best constant probability, on the grid of ``focal_init_score``."""

        def best(p: np.ndarray) -> float:
            margin = np.log(p / (1.0 - p))
            return float(p[np.argmin(n1 * self.values(np.ones(1), margin) + n0 * self.values(np.zeros(1), margin))])

        p = best(np.arange(1, 10_000) / 10_000.0)
        p = best(p + np.arange(-99, 100) / 1_000_000.0)
        return float(np.log(p / (1.0 - p)))

    def _class_weight(self, label: Column) -> Column:
        if self.alpha is None:
            return F.lit(1.0)
        return F.when(label == 1, F.lit(self.alpha)).otherwise(F.lit(1.0 - self.alpha))

    def _sign(self, label: Column) -> Column:
        return F.when(label == 1, F.lit(1.0)).otherwise(F.lit(-1.0))

    def _true_class_probability(self, label: Column, probability: Column | str) -> Column:
        p = clip_probability(probability, FOCAL_EPSILON)
        return F.when(label == 1, p).otherwise(F.lit(1.0) - p)

    def loss(self, label: Column | str, probability: Column | str) -> Column:
        y = as_column(label)
        q = self._true_class_probability(y, probability)
        return -self._class_weight(y) * F.pow(F.lit(1.0) - q, F.lit(self.gamma)) * F.log(q)

    def gradient(self, label: Column | str, probability: Column | str) -> Column:
        """First derivative of the loss in the logit."""
        y = as_column(label)
        q = self._true_class_probability(y, probability)
        slope = F.lit(self.gamma) * q * F.log(q) + q - F.lit(1.0)
        return self._class_weight(y) * self._sign(y) * F.pow(F.lit(1.0) - q, F.lit(self.gamma)) * slope

    def hessian(self, label: Column | str, probability: Column | str) -> Column:
        """Second derivative of the loss in the logit; the two class signs cancel.

        With f = 1-q, the gradient's size is f^g * (g*q*log(q) - f); differentiate in q and
        multiply by dq/dlogit = q*f.
        """
        y = as_column(label)
        g = F.lit(self.gamma)
        q = self._true_class_probability(y, probability)
        f = F.lit(1.0) - q
        from_power = -g * F.pow(f, F.lit(self.gamma - 1.0)) * (g * q * F.log(q) - f)
        from_slope = F.pow(f, g) * (g * F.log(q) + g + F.lit(1.0))
        return self._class_weight(y) * (from_power + from_slope) * q * f


@dataclass(frozen=True)
class LogLoss:
    """Log loss, for boosting tasks."""

    def values(self, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
        return np.logaddexp(0.0, np.where(y == 1, -margin, margin))

    def derivatives(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y, p * (1.0 - p)

    def start(self, n1: int, n0: int) -> float:
        """Log odds of the positive share; 0 if a class is missing."""
        return float(np.log(n1 / n0)) if n1 and n0 else 0.0


def log_loss(label: Column | str, probability: Column | str) -> Column:
    p = clip_probability(probability, LOG_LOSS_EPSILON)
    return -F.when(as_column(label) == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))
