"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's maximum over a window, rectified, feeds a softmax layer.  The network
is trained with numpy on the driver from a bounded sample of labelled windows
(``SampleBounds``) and applied to all windows of all texts, end to end, in
batches: tables of byte pairs replace products, so a window costs a few lookups
per byte.  A document's probabilities are the means over its windows, weighted
by their bytes.

* predicts from the text only; a label, source or id is never an input.
* text that is null or has no letter: ``und`` with score 0.
* no labelled rows at all: every document is ``und`` with score 0.
* the score lies in [0, 1]; equal texts get equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import decoded, slices, steps, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# Windows evaluated at once; their table rows stay in a core's cache.
_BATCH = 48


@dataclass(frozen=True)
class SampleBounds:
    """Bounds of the training sample: rows in all, windows per row.

    Every label is learned, each from about the same number of rows; where that
    would be fewer than ``least``, the sample holds ``least`` rows of each.
    """

    rows: int = 4000
    windows: int = 4
    least: int = 16


@dataclass(frozen=True)
class Network:
    """``bytes_[w]``: (width, 256, filters) for each width; ``dense``: (features, languages)."""

    languages: tuple[str, ...]
    bytes_: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """First pair of bytes of all widths side by side, and what follows them per width."""
        pairs = [(w[0][:, None, :] + w[1][None, :, :]).reshape(-1, FILTERS) for w in self.bytes_]
        rest = [w[2] if len(w) == 3 else (w[2][:, None, :] + w[3][None, :, :]).reshape(-1, FILTERS) if len(w) == 4 else None for w in self.bytes_]
        return np.concatenate(pairs, axis=1), rest


def features(net: Network, tables, windows: np.ndarray) -> np.ndarray:
    """Maximum of every filter over each window; ``windows`` is (n, WINDOW) bytes."""
    first, rest = tables
    out = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
    for at in range(0, len(windows), _BATCH):
        x = windows[at : at + _BATCH]
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        value = first[pair]
        for k, width in enumerate(WIDTHS):
            v = value[:, : WINDOW - width + 1, k * FILTERS : (k + 1) * FILTERS]
            if width > 2:
                v = v + rest[k][x[:, 2:] if width == 3 else pair[:, 2:]]
            out[at : at + _BATCH, k * FILTERS : (k + 1) * FILTERS] = v.max(axis=1)
    return np.maximum(out + net.bias, 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, tables, windows: np.ndarray) -> np.ndarray:
    # Not by BLAS, whose sums depend on the size of the batch: equal texts get equal scores.
    z = np.einsum("nf,fl->nl", features(net, tables, windows).astype(np.float64), net.dense.astype(np.float64))
    return _softmax(z + net.offset)


def windows_of(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts end to end, the text each belongs to, and its bytes."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts_], np.int64)
    cells = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts_), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts_)), counts)
    size = np.full(len(cells), WINDOW, np.float64)
    for i, n in enumerate(counts.cumsum().tolist()):
        if counts[i]:
            size[n - 1] = len(texts_[i]) - (counts[i] - 1) * WINDOW
    return cells, owner, size


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the class-balanced cross entropy; filters get gradients at their maxima only."""
    rng = np.random.default_rng(seed)
    n_feat = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(n_feat, np.float32), rng.normal(0, 0.1, (n_feat, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    weight = 1.0 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    weight = weight / weight[labels].mean()
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick], labels[pick]
            best, where = [], []
            for w, p in zip(WIDTHS, params):
                span = WINDOW - w + 1
                v = sum(p[k][x[:, k : k + span]] for k in range(w))
                a = v.argmax(axis=1)
                where.append(a)
                best.append(np.take_along_axis(v, a[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(best, axis=1) + params[-3]
            feat = np.maximum(raw, 0)
            prob = _softmax(feat @ params[-2] + params[-1])
            prob[np.arange(len(y)), y] -= 1
            d = (prob * weight[y][:, None] / len(y)).astype(np.float32)
            back = (d @ params[-2].T) * (raw > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[i])
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), b.shape)
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(x, where[i] + k, axis=1), f), b)
                grads.append(g)
            grads += [back.sum(axis=0), feat.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, m, s in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Network(tuple(languages), tuple(params[: len(WIDTHS)]), params[-3], params[-2], params[-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the checksum of its id is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, bounds: SampleBounds, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training windows, their labels and the languages; what reaches the driver is bounded.

    A weighted sample without replacement, languages equally often where they
    have enough rows: the rows with the smallest exponential keys of each.
    """
    known = docs.filter(~held_out(id_col) & F.col(lang).isNotNull() & (F.octet_length(texts(text)) > 0))
    counts = {r["l"]: r["n"] for r in known.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), []
    each = max(bounds.least, bounds.rows // len(languages))
    raw = texts(text)
    at = lambda i: F.substr(raw, F.pmod(F.xxhash64(id_col, F.lit(i)), F.greatest(F.octet_length(raw) - WINDOW + 1, F.lit(1))).cast("int") + 1, F.lit(WINDOW))
    key = -F.log((F.pmod(F.xxhash64(id_col, F.lit("key")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)) * F.create_map(*[F.lit(v) for x in languages for v in (x, float(counts[x]))])[F.col(lang)]
    # About twice the bound passes this test, whatever the size of the table, so that tasks send few rows.
    near = known.select(F.col(lang).alias("l"), key.alias("k"), F.col(id_col).cast("string").alias("i"),
                        F.array(*[at(i) for i in range(bounds.windows)]).alias("w")).filter(F.col("k") <= 2.0 * each)
    best = Window.partitionBy("l").orderBy("k", "i", "w")
    picked = sorted(near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= each).collect(), key=lambda r: (r["k"], r["l"], r["r"]))
    rows = [(bytes(w), r["l"]) for r in picked for w in dict.fromkeys(map(bytes, r["w"]))]
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(11)
    # A quarter of the windows is cut short, so that short texts are known, too.
    cut = [w if rng.random() < 0.75 else w[: int(rng.integers(16, WINDOW))] for w, _ in rows]
    cells = np.frombuffer(b"".join(w + bytes(WINDOW - len(w)) for w in cut), np.uint8).reshape(-1, WINDOW)
    return cells, np.array([number[x] for _, x in rows], np.int64), languages


def fit(docs: DataFrame, bounds: SampleBounds = SampleBounds(), id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    windows, labels, languages = sample(docs, bounds, id_col, text, lang)
    return train(windows, labels, languages) if languages else None


def predict_texts(net: Network, tables, raws: list[bytes]) -> list[tuple[str, float]]:
    out = [(UNKNOWN, 0.0)] * len(raws)
    some = [i for i, r in enumerate(raws) if _LETTER.search(decoded(r))]
    cells, owner, size = windows_of([raws[i] for i in some])
    if not len(cells):
        return out
    p = probabilities(net, tables, cells) * size[:, None]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    total = np.add.reduceat(p, first, axis=0)
    total /= total.sum(axis=1, keepdims=True)
    for i, row in zip(some, total):
        best = int(row.argmax())
        out[i] = (net.languages[best], float(row[best]))
    return out


def predict(docs: DataFrame, net: Network | None, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its probability to every row."""
    kept = [f for f in docs.schema if f.name not in (lang_out, score_out)]
    if net is None:
        return docs.select(*(f"`{f.name}`" for f in kept), F.lit(UNKNOWN).alias(lang_out), F.lit(0.0).alias(score_out))

    def run(batches):
        tables = net.tables()
        for batch in slices(batches):
            found = [r for (column,) in steps([batch.select(["_cw_text"])], 64) for r in predict_texts(net, tables, column)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())],
                [*(f.name for f in kept), lang_out, score_out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return (docs.select(*(f"`{f.name}`" for f in kept), texts(text).alias("_cw_text"))
            .mapInArrow(run, f"{schema}, `{lang_out}` string, `{score_out}` double"))
