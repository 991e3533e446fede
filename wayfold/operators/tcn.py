"""The dilated causal network of the speed model: geometry from the names of weights, and its forward pass in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Limits of the log-variance, least deviation of an input, the term beside a batch norm's variance.
LOGVAR, LEAST_SD, EPSILON = (-6.0, 4.0), 1e-6, 1e-5
OUTPUTS = ("mu", "logvar", "stationary_logit", "yaw_rate")


@dataclass(frozen=True)
class Geometry:
    """Width of the stem, channels of the blocks, dilations (doubling), width of the kernels."""

    stem: int
    channels: tuple[int, ...]
    dilations: tuple[int, ...]
    kernel: int

    @classmethod
    def of(cls, shapes: dict[str, tuple[int, ...]]) -> Geometry | None:
        """From the shapes of named weights; None if there are no blocks."""
        blocks = sorted(int(m.group(1)) for n in shapes if (m := re.fullmatch(r"blocks\.(\d+)\.conv1\.weight", n)))
        if not blocks:
            return None
        convs = [shapes[f"blocks.{k}.conv1.weight"] for k in blocks]
        return cls(shapes["stem.0.weight"][0], tuple(c[0] for c in convs), tuple(2**k for k in range(len(blocks))), convs[0][2])

    def receptive_field(self) -> int:
        return 1 + 2 * sum((self.kernel - 1) * d for d in self.dilations)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray | None, left: int, right: int, dilation: int = 1) -> np.ndarray:
    """(batch, channels, time) with zeros before and behind it."""
    n = x.shape[2] + left + right - (w.shape[2] - 1) * dilation
    padded = np.pad(x, ((0, 0), (0, 0), (left, right)))
    out = sum(np.matmul(w[None, :, :, i], padded[:, :, i * dilation : i * dilation + n]) for i in range(w.shape[2]))
    return out if b is None else out + b[None, :, None]


class Network:
    """Input norm, a stem of width 7, residual blocks of two causal convolutions, heads over the mean in time and at each step.

    ``weights`` are arrays by the names of a saved state; batch norms apply their running statistics.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        geometry = Geometry.of({k: v.shape for k, v in weights.items()})
        if geometry is None:
            raise ValueError("no blocks among the weights")
        self.w, self.geometry = weights, geometry

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        w = {k: self.w[f"{name}.{k}"][None, :, None] for k in ("weight", "bias", "running_mean", "running_var")}
        return (x - w["running_mean"]) / np.sqrt(w["running_var"] + EPSILON) * w["weight"] + w["bias"]

    def sequence(self, x: np.ndarray) -> np.ndarray:
        if "input_norm.running_mean" in self.w:
            sd = np.maximum(np.sqrt(self.w["input_norm.running_var"]), LEAST_SD)
            x = (x - self.w["input_norm.running_mean"][None, :, None]) / sd[None, :, None]
        x = np.maximum(self._norm(convolved(x, self.w["stem.0.weight"], None, 3, 3), "stem.1"), 0)
        for k, d in enumerate(self.geometry.dilations):
            b, reach = f"blocks.{k}", (self.geometry.kernel - 1) * d
            skip = f"{b}.skip.weight"
            kept = convolved(x, self.w[skip], self.w[f"{b}.skip.bias"], 0, 0) if skip in self.w else x
            y = np.maximum(self._norm(convolved(x, self.w[f"{b}.conv1.weight"], self.w[f"{b}.conv1.bias"], reach, 0, d), f"{b}.bn1"), 0)
            x = np.maximum(self._norm(convolved(y, self.w[f"{b}.conv2.weight"], self.w[f"{b}.conv2.bias"], reach, 0, d), f"{b}.bn2") + kept, 0)
        return x

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """(batch, channels, time) to the four outputs of each window and the speeds and accelerations of its steps."""
        s = self.sequence(np.asarray(x, float))
        pooled = s.mean(axis=2)
        head = lambda n: pooled @ self.w[f"{n}.weight"].T + self.w[f"{n}.bias"]
        step = lambda n: convolved(s, self.w[f"{n}.weight"], self.w[f"{n}.bias"], 0, 0)[:, 0]
        way = head("head_disp")
        return {
            "mu": softplus(way[:, 0]),
            "logvar": np.clip(way[:, 1], *LOGVAR),
            "stationary_logit": head("head_stationary")[:, 0],
            "yaw_rate": head("head_yaw")[:, 0],
            "v_seq": softplus(step("head_v_seq")),
            "a_seq": step("head_a_seq"),
        }


def drawn_weights(seed: int, inputs: int = 6, stem: int = 8, channels: tuple[int, ...] = (8, 8), kernel: int = 3) -> dict[str, np.ndarray]:
    """Weights drawn at random, for networks whose trained ones aren't at hand."""
    rng, w, last = np.random.default_rng(seed), {}, stem

    def conv(name: str, o: int, i: int, k: int, bias: bool = True) -> None:
        w[f"{name}.weight"] = rng.normal(0, (2 / (o * k)) ** 0.5, (o, i, k))
        if bias:
            w[f"{name}.bias"] = rng.normal(0, 0.1, o)

    def norm(name: str, n: int) -> None:
        w.update({f"{name}.weight": rng.uniform(0.5, 1.5, n), f"{name}.bias": rng.normal(0, 0.1, n), f"{name}.running_mean": rng.normal(0, 0.1, n), f"{name}.running_var": rng.uniform(0.5, 1.5, n)})

    w["input_norm.running_mean"], w["input_norm.running_var"] = rng.normal(0, 0.1, inputs), rng.uniform(0.5, 1.5, inputs)
    conv("stem.0", stem, inputs, 7, False)
    norm("stem.1", stem)
    for k, n in enumerate(channels):
        conv(f"blocks.{k}.conv1", n, last, kernel)
        conv(f"blocks.{k}.conv2", n, n, kernel)
        norm(f"blocks.{k}.bn1", n)
        norm(f"blocks.{k}.bn2", n)
        if n != last:
            conv(f"blocks.{k}.skip", n, last, 1)
        last = n
    for name, n in (("head_disp", 2), ("head_stationary", 1), ("head_yaw", 1)):
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(0, 0.3, (n, last)), rng.normal(0, 0.1, n)
    conv("head_v_seq", 1, last, 1)
    conv("head_a_seq", 1, last, 1)
    return w


def infer(windows: DataFrame, keys: list[str], window: str, weights: dict[str, np.ndarray], batch: int = 256) -> DataFrame:
    """``keys, mu, logvar, stationary_logit, yaw_rate`` for windows (arrays of channels), in batches of Arrow rows."""
    import pandas as pd

    kinds, sent = dict(windows.dtypes), windows.sparkSession.sparkContext.broadcast(weights)

    def run(parts):
        net = Network(sent.value)
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                out = net.forward(np.stack([np.stack(list(map(np.asarray, x))) for x in part[window]]))
                yield pd.DataFrame({k: part[k].to_numpy() for k in keys} | {k: out[k] for k in OUTPUTS})

    return windows.select(*keys, window).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + "".join(f", {k} double" for k in OUTPUTS))
