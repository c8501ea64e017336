"""A byte-level convolutional network in numpy that scores the quality of texts.

Bytes are embedded, filters of six bytes slide over them two bytes at a time,
and their greatest answers in overlapping chunks over the whole text are
averaged and maximised into the inputs of one logistic output.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import computed, quoted

WIDTH, STRIDE = 6, 2
#: Filter positions in half a chunk; a chunk is two halves, and chunks overlap by one.
HALF = 128
#: The network is fitted on so many labelled rows at most, chosen by a hash of
#: their ids, with texts of at most so many bytes.  Scores cover whole texts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 15


@dataclass
class Network:
    embed: np.ndarray  # 256, e
    filters: np.ndarray  # WIDTH, e, f
    bias: np.ndarray  # f
    out: np.ndarray  # 2 f, for the mean and the maximum over chunks
    shift: np.ndarray  # 1


def _bytes(text: str | None) -> np.ndarray:
    """The text's bytes, filled up with zeros to an even number and one filter."""
    raw = (text or "").encode()
    return np.frombuffer(raw + bytes(max(WIDTH - len(raw), len(raw) % STRIDE)), np.uint8)


def _chunks(half_max: np.ndarray) -> np.ndarray:
    return np.maximum(half_max[:-1], half_max[1:]) if len(half_max) > 1 else half_max


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tables(net: Network) -> list[np.ndarray]:
    """What each pair of bytes adds to the filters, by the place of the pair."""
    by_byte = np.einsum("be,wef->wbf", net.embed, net.filters)
    return [(by_byte[k][None, :, :] + by_byte[k + 1][:, None, :]).reshape(1 << 16, -1).astype(np.float32) for k in range(0, WIDTH, 2)]


def score(text: str | None, net: Network, pairs: list[np.ndarray]) -> float:
    """The probability of label 1, from all bytes of the text.

    Long texts are read some thousand positions at a time.
    """
    codes = _bytes(text).view("<u2")
    n = len(codes) - WIDTH // 2 + 1
    halves = []
    step = HALF * 128
    for i in range(0, n, step):
        m = min(step, n - i)
        answer = pairs[0][codes[i : i + m]]
        for k in range(1, WIDTH // 2):
            answer += pairs[k][codes[i + k : i + k + m]]
        halves.append(np.maximum.reduceat(answer, np.arange(0, m, HALF), axis=0))
    chunks = np.maximum(_chunks(np.concatenate(halves)) + net.bias, 0)
    pooled = np.concatenate([chunks.mean(axis=0, dtype=np.float64), chunks.max(axis=0)])
    return float(_sigmoid(pooled @ net.out + net.shift[0]))


def _step(net: Network, raw: np.ndarray, label: float, grad: Network) -> None:
    """Add the gradient of one text's log loss to ``grad``."""
    n = (len(raw) - WIDTH) // STRIDE + 1
    e, f = net.embed.shape[1], len(net.bias)
    seen = net.embed[raw].ravel()
    windows = np.lib.stride_tricks.as_strided(seen, (n, WIDTH * e), (STRIDE * e * 4, 4))
    answer = windows @ net.filters.reshape(WIDTH * e, f)
    starts = np.arange(0, n, HALF)
    size = len(starts) * HALF
    filled = np.full((size, f), -np.inf, np.float32)
    filled[:n] = answer
    halves = filled.reshape(len(starts), HALF, f)
    where = halves.argmax(axis=1)
    top = np.take_along_axis(halves, where[:, None, :], axis=1)[:, 0]
    where = where + starts[:, None]
    if len(top) > 1:
        right = top[1:] > top[:-1]
        where, top = np.where(right, where[1:], where[:-1]), np.maximum(top[1:], top[:-1])
    chunk = np.maximum(top + net.bias, 0)
    greatest = chunk.argmax(axis=0)
    pooled = np.concatenate([chunk.mean(axis=0), chunk[greatest, np.arange(f)]])
    d = _sigmoid(pooled @ net.out + net.shift[0]) - label
    grad.out += d * pooled
    grad.shift += d
    back = np.tile(d * net.out[:f] / len(chunk), (len(chunk), 1))
    back[greatest, np.arange(f)] += d * net.out[f:]
    back *= chunk > 0
    grad.bias += back.sum(axis=0)
    which, of = np.nonzero(back)
    g = back[which, of]
    spots = where[which, of] * STRIDE
    for k in range(WIDTH):
        b = raw[spots + k]
        np.add.at(grad.filters[k].T, of, g[:, None] * net.embed[b])
        np.add.at(grad.embed, b, g[:, None] * net.filters[k].T[of])


def train(
    texts: list[str | None], labels: list[int], filters: int = 16, width: int = 8, epochs: int = 6, batch: int = 16, rate: float = 0.01
) -> Network:
    """Fit by Adam from a fixed start; no texts give one that answers one half."""
    rng = np.random.default_rng(7)
    net = Network(
        rng.normal(0, 0.5, (256, width)).astype(np.float32),
        rng.normal(0, 0.3, (WIDTH, width, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.1, 2 * filters).astype(np.float32),
        np.zeros(1, np.float32),
    )
    names = [f.name for f in fields(Network)]
    empty = lambda: Network(*(np.zeros_like(getattr(net, k)) for k in names))
    first, second, t = empty(), empty(), 0
    raws = [_bytes(x) for x in texts]
    if not raws:
        net.out[:] = 0
        return net
    share = min(max(float(np.mean(labels)), 0.01), 0.99)
    net.shift[:] = np.log(share / (1 - share))
    for epoch in range(epochs):
        order = rng.permutation(len(raws))
        for i in range(0, len(order), batch):
            part, grad = order[i : i + batch], empty()
            for j in part:
                _step(net, raws[j], float(labels[j]), grad)
            t += 1
            now = rate * 0.6**epoch
            for k in names:
                g = getattr(grad, k) / len(part)
                m, v = getattr(first, k), getattr(second, k)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, k)[...] -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
    **options,
) -> Network:
    """Train on a bounded sample of the labelled rows.

    Rows with a null key, text or label are left out, as are texts over
    ``most_bytes``; of the others the ``rows`` first by a hash of their key
    are read (two keys with the same hash and repeated rows: by text).
    """
    marks = labels.select(quoted(key).alias("key"), quoted(label).cast("int").alias("label")).dropna().distinct()
    texts = df.select(quoted(key).alias("key"), quoted(text).alias("text")).where(
        F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)
    )
    order = F.xxhash64(F.col("key").cast("string"))
    sizes = texts.select("key").join(marks, "key").orderBy(order, "key", "label").limit(rows)
    picked = texts.join(F.broadcast(sizes.distinct()), "key").limit(2 * rows).collect()
    picked.sort(key=lambda r: (str(r["key"]), r["text"], r["label"]))
    return train([r["text"] for r in picked], [r["label"] for r in picked], **options)


def scored(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``row`` and ``score``, 0 to 1, of every whole text.

    Null and empty texts are scored as six zero bytes; repeated rows get the
    same score; the row's other columns play no part.
    """
    shared = df.sparkSession.sparkContext.broadcast((net, tables(net)))

    def compute(texts):
        net, pairs = shared.value
        return [[score(t, net, pairs) for t in texts]]

    return computed(df, [text], "score double", compute)
