"""A small byte-level convolutional network, forward and backward, in NumPy.

A text is cut into halves of HALF bytes; a chunk is two neighbouring halves, so
chunks overlap by half and cover the whole text. Filters slide over embedded
bytes, their largest response in each chunk goes through a hidden layer, and
the largest and the mean hidden response over all chunks decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

HALF = 64
WIDTH = 8
STRIDE = 2
EMBED = 6
FILTERS = 32
HIDDEN = 16
PAD = 256  # the symbol beyond the end of a text
ROWS = 1024  # halves convolved at a time


def new_network(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda rows, cols, scale: (rng.standard_normal((rows, cols)) * scale).astype(np.float32)
    return {
        "bytes": normal(PAD + 1, EMBED, 0.5),
        "filters": normal(WIDTH * EMBED, FILTERS, (2 / (WIDTH * EMBED)) ** 0.5 * 2),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS, HIDDEN, (2 / FILTERS) ** 0.5),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(2 * HIDDEN, 1, 0.1)[:, 0],
        "out_bias": np.zeros(1, np.float32),
    }


def halves_of(text: bytes) -> np.ndarray:
    """(halves, HALF + WIDTH - STRIDE) symbols; windows reach into the next half."""
    n = max(1, -(-len(text) // HALF))
    padded = np.full(n * HALF + WIDTH, PAD, np.int32)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, HALF + WIDTH - STRIDE)[::HALF][:n]


def _windows(net: dict, halves: np.ndarray) -> np.ndarray:
    """(halves, positions, WIDTH * EMBED) embedded bytes."""
    embedded = net["bytes"][halves].reshape(len(halves), -1)
    return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def responses(net: dict, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of every filter in every half, and where it is."""
    most, where = np.empty((len(halves), FILTERS), np.float32), np.empty((len(halves), FILTERS), np.int64)
    for s in range(0, len(halves), ROWS):
        windows = _windows(net, halves[s : s + ROWS])
        flat = windows.reshape(-1, WIDTH * EMBED) @ net["filters"]
        shaped = flat.reshape(*windows.shape[:2], FILTERS)
        most[s : s + ROWS] = shaped.max(axis=1)
        where[s : s + ROWS] = shaped.argmax(axis=1) if net.get("learning") else 0
    return most, where


def _chunks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many halves: first and second half of each chunk, and
    the number of chunks of each text."""
    counts = np.maximum(sizes - 1, 1)
    starts = np.cumsum(sizes) - sizes
    first = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=True)])
    second = first + np.repeat(sizes > 1, counts)
    return first, second, counts


def forward(net: dict, most: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
    """Log-odds of each text from the responses of its halves."""
    first, second, counts = _chunks(sizes)
    chunk = np.maximum(most[first], most[second]) + net["filter_bias"]
    active = np.maximum(chunk, 0)
    hidden = np.maximum(active @ net["hidden"] + net["hidden_bias"], 0)
    starts = np.cumsum(counts) - counts
    peak = np.maximum.reduceat(hidden, starts, axis=0)
    mean = np.add.reduceat(hidden, starts, axis=0) / counts[:, None]
    odds = np.concatenate([peak, mean], axis=1) @ net["out"] + net["out_bias"]
    return odds, {"first": first, "second": second, "counts": counts, "active": active, "hidden": hidden, "peak": peak, "mean": mean}


def log_odds(net: dict, texts: Iterable[bytes], budget: int = 16384) -> Iterator[np.ndarray]:
    """Scores of whole texts, in groups of some `budget` halves. Halves are
    convolved ROWS at a time; a text holds FILTERS numbers for each of its own."""
    halves, sizes = [], []
    for text in texts:
        halves.append(halves_of(text))
        sizes.append(len(halves[-1]))
        if sum(sizes) >= budget:
            yield _score(net, halves, sizes)
            halves, sizes = [], []
    if sizes:
        yield _score(net, halves, sizes)


def _score(net: dict, halves: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    return forward(net, responses(net, np.concatenate(halves))[0], np.array(sizes))[0]


def gradients(net: dict, halves: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss. Only the window with the largest response of a
    filter in a chunk passes anything back."""
    most, where = responses(net, halves)
    odds, kept = forward(net, most, sizes)
    score = 1 / (1 + np.exp(-odds))
    d_odds = ((score - labels) / len(labels)).astype(np.float32)
    out, text = {}, np.repeat(np.arange(len(sizes)), kept["counts"])
    out["out"] = np.concatenate([kept["peak"], kept["mean"]], axis=1).T @ d_odds
    out["out_bias"] = d_odds.sum(keepdims=True)
    d_pooled = d_odds[:, None] * net["out"][None, :]
    at_peak = kept["hidden"] == kept["peak"][text]
    d_hidden = at_peak * d_pooled[text, :HIDDEN] + d_pooled[text, HIDDEN:] / kept["counts"][text][:, None]
    d_hidden *= kept["hidden"] > 0
    out["hidden"], out["hidden_bias"] = kept["active"].T @ d_hidden, d_hidden.sum(axis=0)
    d_chunk = (d_hidden @ net["hidden"].T) * (kept["active"] > 0)
    out["filter_bias"] = d_chunk.sum(axis=0)
    ahead = most[kept["first"]] >= most[kept["second"]]
    d_half = np.zeros_like(most)
    d_half[kept["first"]] += d_chunk * ahead  # a half comes first in one chunk at most, and second in one
    d_half[kept["second"]] += d_chunk * ~ahead
    half, filter_ = np.nonzero(d_half)
    at = where[half, filter_][:, None] * STRIDE + np.arange(WIDTH)
    symbols, passed = halves[half[:, None], at], d_half[half, filter_]
    windows = net["bytes"][symbols].reshape(len(half), -1)
    spread = np.zeros((len(half), FILTERS), np.float32)
    spread[np.arange(len(half)), filter_] = passed
    out["filters"] = windows.T @ spread
    d_windows = (passed[:, None] * net["filters"].T[filter_]).reshape(len(half), WIDTH, EMBED)
    out["bytes"] = np.stack([np.bincount(symbols.ravel(), d_windows[:, :, e].ravel(), PAD + 1) for e in range(EMBED)], axis=1).astype(np.float32)
    return out


def train(texts: list[bytes], labels: np.ndarray, steps: int, seed: int, batch: int = 32, rate: float = 6e-3) -> dict[str, np.ndarray]:
    """Adam over `steps` shuffled batches, with a rate that falls to zero."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    halves = [halves_of(t) for t in texts]
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    net["learning"] = True
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, *(rng.permutation(len(texts)) for _ in range(-(-batch // len(texts))))])
        chosen, order = order[:batch], order[batch:]
        slope = gradients(net, np.concatenate([halves[i] for i in chosen]), np.array([len(halves[i]) for i in chosen]), labels[chosen])
        for k, g in slope.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net[k] = (net[k] - rate * (1 - step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    del net["learning"]
    return net
