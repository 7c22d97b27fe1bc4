"""Losses as pairs of gradient and hessian columns of (y, prediction)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.scalar import sigmoid, softmax

EPS = 1e-7
Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Loss:
    """gradient and hessian by raw prediction, the constant to start from as an aggregate, and a row's loss.

    ``start`` may be given how many rows each row stands for. ``value`` takes the raw prediction too. It is what early stopping watches, up to terms
    that don't depend on the prediction.
    """

    name: str
    pair: Callable[[Column, Column], Pair]
    start: Callable[..., Column]
    value: Callable[[Column, Column], Column]
    link: str = "identity"

    def response(self, raw: Column) -> Column:
        """The prediction on the target's scale."""
        return {"identity": lambda x: x, "logit": sigmoid, "log": F.exp}[self.link](raw)


def mse(y: Column, p: Column) -> Pair:
    return p - y, F.lit(1.0)


def pseudo_huber(delta: float = 1.0) -> Callable:
    def pair(y: Column, p: Column) -> Pair:
        r = p - y
        s = 1 + (r / delta) * (r / delta)
        return r / F.sqrt(s), F.pow(s, F.lit(-1.5))

    return pair


def log_loss(y: Column, p: Column) -> Pair:
    q = sigmoid(p)
    return q - y, F.greatest(q * (1 - q), F.lit(EPS))


def focal(gamma: float = 2.0, alpha: float = 0.25) -> Callable:
    def pair(y: Column, p: Column) -> Pair:
        q = sigmoid(p)
        pt = F.when(y > 0.5, q).otherwise(1 - q)
        w = F.when(y > 0.5, F.lit(alpha)).otherwise(F.lit(1 - alpha)) * F.pow(1 - pt, F.lit(gamma))
        return w * (q - y), F.greatest(w * q * (1 - q), F.lit(EPS))

    return pair


def quantile(tau: float, delta: float = 1.0) -> Callable:
    """The pinball gradient, smoothed by a sigmoid: -tau far below y, 1 - tau far above."""

    def pair(y: Column, p: Column) -> Pair:
        s = sigmoid((p - y) / delta)
        return s - tau, F.greatest(s * (1 - s) / delta, F.lit(EPS))

    return pair


def mape(y: Column, p: Column) -> Pair:
    w = 1 / F.greatest(F.abs(y), F.lit(1e-3))
    r = (p - y) * w
    s = 1 + r * r
    return r / F.sqrt(s) * w, F.greatest(w * w * F.pow(s, F.lit(-1.5)), F.lit(EPS))


def tweedie(power: float = 1.5) -> Callable:
    """Log link; the expected hessian."""

    def pair(y: Column, p: Column) -> Pair:
        a, b = F.exp((1 - power) * p), F.exp((2 - power) * p)
        return b - y * a, F.greatest(b, F.lit(EPS))

    return pair


def digamma(x: Column) -> Column:
    """By recurrence to x + 6 and the asymptotic series; good to about 1e-10 for positive x."""
    z = x + 6
    shift = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    q = 1 / (z * z)
    return F.ln(z) - 0.5 / z - q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q * F.lit(1 / 240)))) - shift


def beta(phi: float = 10.0) -> Callable:
    """Mean in (0, 1) by the logit link, fixed precision phi."""

    def pair(y: Column, p: Column) -> Pair:
        mu = F.least(F.greatest(sigmoid(p), F.lit(1e-4)), F.lit(1 - 1e-4))
        t = F.least(F.greatest(y, F.lit(1e-4)), F.lit(1 - 1e-4))
        g = -phi * (F.ln(t / (1 - t)) - digamma(mu * phi) + digamma((1 - mu) * phi)) * mu * (1 - mu)
        return g, F.greatest(phi * mu * (1 - mu), F.lit(EPS))

    return pair


def multiclass(label: Column, scores: list[Column]) -> list[Pair]:
    """One pair for each class from the softmax of all scores."""
    return [(q - (label == k).cast("double"), F.greatest(q * (1 - q), F.lit(EPS))) for k, q in enumerate(softmax(scores))]


def mean(y: Column, n: Column | None = None) -> Column:
    return F.avg(y) if n is None else F.sum(y * n) / F.sum(F.when(y.isNotNull(), n))


def ranked(share: float) -> Callable:
    return lambda y, n=None: F.percentile(y, F.lit(share), *([] if n is None else [n]))


def log_odds(y: Column, n: Column | None = None) -> Column:
    m = F.least(F.greatest(mean(y, n), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(m / (1 - m))


def smape(y: Column, p: Column) -> Pair:
    """Symmetric percentage error, smoothed: the scale is the mean size of target and prediction, held fixed."""
    w = 1 / F.greatest((F.abs(y) + F.abs(p)) / 2, F.lit(1e-3))
    r = (p - y) * w
    s = 1 + r * r
    return r / F.sqrt(s) * w, F.greatest(w * w * F.pow(s, F.lit(-1.5)), F.lit(EPS))


def clipped(q: Column) -> Column:
    return F.least(F.greatest(q, F.lit(EPS)), F.lit(1 - EPS))


def log_loss_value(y: Column, p: Column) -> Column:
    q = clipped(sigmoid(p))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def focal_value(gamma: float = 2.0, alpha: float = 0.25) -> Callable:
    def value(y: Column, p: Column) -> Column:
        q = clipped(sigmoid(p))
        pt, a = F.when(y > 0.5, q).otherwise(1 - q), F.when(y > 0.5, F.lit(alpha)).otherwise(F.lit(1 - alpha))
        return -a * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt)

    return value


def pinball(tau: float) -> Callable:
    return lambda y, p: F.greatest(tau * (y - p), (tau - 1) * (y - p))


def tweedie_value(power: float = 1.5) -> Callable:
    return lambda y, p: F.exp((2 - power) * p) / (2 - power) - y * F.exp((1 - power) * p) / (1 - power)


#: Losses of a row; beta's is its squared error on the target's scale, since Spark has no log-gamma function.
LOSSES = {
    "mse": Loss("mse", mse, mean, lambda y, p: (y - p) * (y - p)),
    "pseudo_huber": Loss("pseudo_huber", pseudo_huber(), mean, lambda y, p: F.sqrt(1 + (y - p) * (y - p)) - 1),
    "log_loss": Loss("log_loss", log_loss, log_odds, log_loss_value, "logit"),
    "focal": Loss("focal", focal(), log_odds, focal_value(), "logit"),
    "quantile": Loss("quantile", quantile(0.5), ranked(0.5), pinball(0.5)),
    "quantile_90": Loss("quantile_90", quantile(0.9), ranked(0.9), pinball(0.9)),
    "mape": Loss("mape", mape, ranked(0.5), lambda y, p: F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-3))),
    "smape": Loss("smape", smape, ranked(0.5), lambda y, p: 2 * F.abs(y - p) / F.greatest(F.abs(y) + F.abs(p), F.lit(2e-3))),
    "tweedie": Loss("tweedie", tweedie(), lambda y, n=None: F.ln(F.greatest(mean(y, n), F.lit(1e-6))), tweedie_value(), "log"),
    "beta": Loss("beta", beta(), log_odds, lambda y, p: (y - sigmoid(p)) * (y - sigmoid(p)), "logit"),
}


def entropy2(p: float) -> float:
    return 0.0 if p <= 0 or p >= 1 else -(p * math.log2(p) + (1 - p) * math.log2(1 - p))
