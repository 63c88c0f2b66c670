"""The recognizer's arithmetic: parameter counts, matched sizes, architecture choice, numpy forward."""

from __future__ import annotations

import math

import numpy as np

# Channels of the stem, and the width collapses.
STEM = (1, 32, 64, 128, 256)
STRIDES = ((2, 2), (2, 2), (1, 2), (1, 2))
MODES = ("mean", "concat", "concat_proj", "mean_big")
BLANK_BIAS = -3.0
#: Images of a forward pass: at 1024 x 64 and hidden 384 a process takes about 240 MB, with 32 images 780 MB.
BATCH = 8


def reduced_width(w: int) -> int:
    """Width after the stem: halved four times, rounding up."""
    for _ in STRIDES:
        w = (w + 1) // 2
    return w


def n_frames(h: int) -> int:
    """Frames of a height: halved twice, rounding up."""
    return ((h + 1) // 2 + 1) // 2


def lstm_params(inputs: int, hidden: int, n_classes: int) -> int:
    """Parameters of two bidirectional LSTM layers and the output layer."""
    def layer(x: int) -> int:
        return 2 * 4 * hidden * (x + hidden + 2)

    return layer(inputs) + layer(2 * hidden) + (2 * hidden + 1) * n_classes


def stem_params() -> int:
    return sum(9 * a * b + b + 2 * b for a, b in zip(STEM, STEM[1:]))


def params(n_classes: int, hidden: int, mode: str, img_w: int = 64) -> int:
    """All parameters of the recognizer."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    c, wide = STEM[-1], STEM[-1] * reduced_width(img_w)
    if mode == "concat":
        return stem_params() + lstm_params(wide, hidden, n_classes)
    extra = (wide + 1) * c if mode == "concat_proj" else 0
    return stem_params() + extra + lstm_params(c, hidden, n_classes)


def matched_hidden(n_classes: int, img_w: int, hidden: int = 384) -> int:
    """Hidden size at which ``mean_big`` has as many parameters as ``concat`` at ``hidden``: the positive
    root of 32 x**2 + b x + c = 0, rounded."""
    goal = lstm_params(STEM[-1] * reduced_width(img_w), hidden, n_classes)
    b = 8 * (STEM[-1] + 2) + 16 + 2 * n_classes
    return round((-b + math.sqrt(b * b + 4 * 32 * (goal - n_classes))) / (2 * 32))


def check_hidden(mode: str, hidden: int, n_classes: int, img_w: int = 64) -> None:
    """``mean_big`` must have its matched hidden size."""
    if mode == "mean_big" and hidden != matched_hidden(n_classes, img_w):
        raise ValueError(f"mean_big needs hidden {matched_hidden(n_classes, img_w)}")


def resolve_arch(saved: dict | None, hidden: int | None = None, mode: str | None = None, img_w: int | None = None) -> tuple[int, str, int]:
    """(hidden, mode, img_w): what a checkpoint saved goes before what is asked for, then the defaults;
    a key saved as None counts as saved."""
    saved = saved or {}
    asked = {"lstm_hidden": (hidden, 384), "width_collapse": (mode, "mean"), "img_w": (img_w, 64)}
    return tuple(saved[k] if k in saved else (a if a is not None else d) for k, (a, d) in asked.items())


def init(n_classes: int, hidden: int, mode: str = "mean", img_w: int = 64, seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights; the output bias is zero but for the blank (the last class)."""
    check_hidden(mode, hidden, n_classes, img_w)
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for i, (a, b) in enumerate(zip(STEM, STEM[1:])):
        w[f"conv{i}"], w[f"conv{i}b"] = rng.normal(0, 0.1, (b, a, 3, 3)), np.zeros(b)
        w[f"bn{i}"] = np.stack([np.ones(b), np.zeros(b), np.zeros(b), np.ones(b)])
    c, wide = STEM[-1], STEM[-1] * reduced_width(img_w)
    if mode == "concat_proj":
        w["proj"], w["projb"] = rng.normal(0, 0.05, (c, wide)), np.zeros(c)
    x = wide if mode == "concat" else c
    for layer in range(2):
        for d in "fb":
            w[f"wx{layer}{d}"], w[f"wh{layer}{d}"] = rng.normal(0, 0.05, (4 * hidden, x)), rng.normal(0, 0.05, (4 * hidden, hidden))
            w[f"b{layer}{d}"] = np.zeros((2, 4 * hidden))
        x = 2 * hidden
    w["out"], w["outb"] = rng.normal(0, 0.05, (n_classes, 2 * hidden)), np.zeros(n_classes)
    w["outb"][-1] = BLANK_BIAS
    return w


def _conv(x: np.ndarray, k: np.ndarray, b: np.ndarray, stride: tuple[int, int]) -> np.ndarray:
    n, c, h, w = x.shape
    pad = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    view = np.lib.stride_tricks.sliding_window_view(pad, (3, 3), axis=(2, 3))[:, :, :: stride[0], :: stride[1]]
    return np.einsum("nchwij,ocij->nohw", view, k, optimize=True) + b[:, None, None]


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> np.ndarray:
    def sig(v: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-v))

    n, t, _ = x.shape
    hid = wh.shape[1]
    h, c, out = np.zeros((n, hid)), np.zeros((n, hid)), np.empty((n, t, hid))
    gates = x @ wx.T + b.sum(axis=0)
    for i in range(t):
        g = gates[:, i] + h @ wh.T
        c = sig(g[:, hid : 2 * hid]) * c + sig(g[:, :hid]) * np.tanh(g[:, 2 * hid : 3 * hid])
        h = sig(g[:, 3 * hid :]) * np.tanh(c)
        out[:, i] = h
    return out


def collapse_width(x: np.ndarray, mode: str) -> np.ndarray:
    """(n, c, t, w) to (n, t, features): the mean over the width, or channel-major concatenation."""
    n, c, t, w = x.shape
    if mode in ("mean", "mean_big"):
        return x.mean(axis=3).transpose(0, 2, 1)
    return x.transpose(0, 2, 1, 3).reshape(n, t, c * w)


def forward(weights: dict[str, np.ndarray], images: np.ndarray, mode: str = "mean") -> np.ndarray:
    """Scores (n, frames, classes) of images (n, 1, h, w); evaluation mode of batch normalization."""
    x = images
    for i, s in enumerate(STRIDES):
        x = _conv(x, weights[f"conv{i}"], weights[f"conv{i}b"], s)
        g, b, m, v = weights[f"bn{i}"]
        x = np.maximum(0, (x - m[:, None, None]) / np.sqrt(v[:, None, None] + 1e-5) * g[:, None, None] + b[:, None, None])
    x = collapse_width(x, mode)
    if mode == "concat_proj":
        x = x @ weights["proj"].T + weights["projb"]
    if x.shape[2] != weights["wx0f"].shape[1]:
        raise RuntimeError("the image width doesn't fit the model")
    for layer in range(2):
        f = _lstm(x, weights[f"wx{layer}f"], weights[f"wh{layer}f"], weights[f"b{layer}f"])
        r = _lstm(x[:, ::-1], weights[f"wx{layer}b"], weights[f"wh{layer}b"], weights[f"b{layer}b"])[:, ::-1]
        x = np.concatenate([f, r], axis=2)
    return x @ weights["out"].T + weights["outb"]


def predict(df, image: str, weights: dict[str, np.ndarray], alphabet, h: int, w: int, mode: str = "mean"):
    """``df`` with pred: images read as text by forward and greedy decoding. Weights (of a fixed size) are
    broadcast; ``BATCH`` images go through at once, which bounds a worker's memory."""
    import pandas as pd
    from pyspark.sql import types as T

    from glyphmill.operators.imaging import model_input, unpack

    shared = df.sparkSession.sparkContext.broadcast(weights)
    names, blank = alphabet.chars, alphabet.blank

    def run(batches):
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH]
                ids = forward(shared.value, np.stack([model_input(unpack(i), h, w) for i in part[image]]), mode).argmax(axis=2)
                keep = (ids != blank) & np.concatenate([np.ones((len(ids), 1), bool), ids[:, 1:] != ids[:, :-1]], axis=1)
                yield part.assign(pred=pd.Series(["".join(names[i] for i in r[k]) for r, k in zip(ids, keep)], index=part.index, dtype=object))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("pred", T.StringType())]))
