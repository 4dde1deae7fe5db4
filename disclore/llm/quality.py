"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Line features are shares of character kinds, lengths and repetition, with the
same features of the lines before and after; the chain adds how likely good and bad follow each other.
Only documents are labelled, so the lines' states are latent: a good document's lines are all good, a bad one has
at least one bad line. The field starts from lines that carry their document's label and then climbs the likelihood
of what the labels say about the lines, so a bad document may keep good lines and the chain learns how stretches of
good and bad follow each other. Forward-backward gives each line's probability of being good; their mean weighted by
line length is the document's quality, and a logistic curve calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices, _texts
from .common import free_names, small_batches, sole_cache
from .training import labelled_sample, logistic, platt_shift, remainder, sigmoid
from .toxicity import thinned

N_LINE = 12
#: Lines of a chain in training, where longer texts are several chains with one label, and cells of a group of chains.
TRAIN_LINES, GROUP_LINES = 256, 20_000


def _kinds() -> np.ndarray:
    """Row b: which kinds byte b is of (letter, capital, digit, blank, stop, bracket or quote, bar, other sign)."""
    out = np.zeros((256, 8), np.float64)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalpha():
            out[b, 0] = 1
            out[b, 1] = "A" <= c <= "Z"
        elif c.isdigit():
            out[b, 2] = 1
        elif b <= 32:
            out[b, 3] = 1
        else:
            out[b, 4 if c in ".,;:?-'" else 5 if c in '()[]{}"' else 6 if c in "|\\/_=<>~^" else 7] = 1
    return out


KINDS = _kinds()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, byte lengths) of a text's lines; blank lines are left out, except that a text without others keeps one."""
    lines = [x for x in text.split("\n") if x.strip()] or [text[:1]]
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([max(1, len(x)) for x in raw])
    data = np.frombuffer(b"".join(x or b" " for x in raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    share = np.empty((len(lines), 8))
    for k in range(8):
        share[:, k] = np.add.reduceat(KINDS[:, k][data], starts)
    share /= size[:, None]
    words = np.empty((len(lines), 4))
    before = None
    for k, x in enumerate(raw):
        w = x.split()
        n = max(1, len(w))
        words[k] = sum(map(eq, w, islice(w, 1, None))) / n, len(set(w)) / n ** 0.9, min(30.0, len(x) / n) / 10, x == before
        before = x
    return np.column_stack([share, words]), size.astype(np.float64)


def chain_features(x: np.ndarray) -> np.ndarray:
    """A line's features with those of its neighbours (its own again at the ends), and a constant."""
    return np.column_stack([x, np.vstack([x[:1], x[:-1]]), np.vstack([x[1:], x[-1:]]), np.ones(len(x))])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    edges: np.ndarray  # [from, to] log potentials of bad (0) and good (1)
    curve: tuple[float, float]
    shift: float


def marginals(u: np.ndarray, edges: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(line is good), P(edge from, to) and the logarithm of the sum over all labellings, for chains side by side.

    u: [chains, lines], the log odds of good; length: lines of each chain, descending; beyond them nothing counts.
    """
    n, t = u.shape
    alive = [int((length > k).sum()) for k in range(t)]
    a = np.zeros((n, t, 2))
    b = np.zeros((n, t, 2))
    a[:, 0, 1] = u[:, 0]
    taken = np.zeros(n)
    for k in range(1, t):
        m = alive[k]
        p = a[:m, k - 1]
        a[:m, k, 0] = np.logaddexp(p[:, 0] + edges[0, 0], p[:, 1] + edges[1, 0])
        a[:m, k, 1] = np.logaddexp(p[:, 0] + edges[0, 1], p[:, 1] + edges[1, 1]) + u[:m, k]
        top = a[:m, k].max(1)
        taken[:m] += top
        a[:m, k] -= top[:, None]
    for k in range(t - 2, -1, -1):
        m = alive[k + 1]
        q0, q1 = b[:m, k + 1, 0], b[:m, k + 1, 1] + u[:m, k + 1]
        b[:m, k, 0] = np.logaddexp(edges[0, 0] + q0, edges[0, 1] + q1)
        b[:m, k, 1] = np.logaddexp(edges[1, 0] + q0, edges[1, 1] + q1)
        b[:m, k] -= b[:m, k].max(1, keepdims=True)
    good = sigmoid((a + b)[:, :, 1] - (a + b)[:, :, 0])
    pair = a[:, :-1, :, None] + edges[None, None] + (b[:, 1:] + np.stack([np.zeros((n, t - 1)), u[:, 1:]], 2))[:, :, None, :] if t > 1 else np.zeros((n, 0, 2, 2))
    if t > 1:
        pair = np.exp(pair - pair.max((2, 3), keepdims=True))
        pair /= pair.sum((2, 3), keepdims=True)
    return good, pair, taken + np.logaddexp(*a[np.arange(n), length - 1].T)


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lengths descending, padded arrays) of chains of rows."""
    length = np.array([len(c) for c in chains])
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(chains), length.max(), *chains[0].shape[1:]))
    for k, i in enumerate(order):
        out[k, : length[i]] = chains[i]
    return order, length[order], out


def quality_of(chains: list[np.ndarray], sizes: list[np.ndarray], model: Model) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities; chains are taken in groups of like length."""
    out = np.zeros(len(chains))
    order = np.argsort([-len(c) for c in chains], kind="stable")
    at = 0
    while at < len(order):
        longest = len(chains[order[at]])
        group = order[at : at + max(1, min(512, 400_000 // longest))]
        at += len(group)
        u = [((chains[i] - model.mean) / model.scale) @ model.unary for i in group]
        _, length, padded = _padded(u)
        good = marginals(padded, model.edges, length)[0]
        for k, i in enumerate(group):  # they are in order already: lengths descend
            w = sizes[i]
            out[i] = (good[k, : len(w)] * w).sum() / w.sum()
    return out


def _groups(chains: list[np.ndarray], labels: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Chains of like length side by side: (lengths, labels, weights, mask, features, documents). A document counts once
    however long it is, and both labels count alike."""
    share = {v: 0.5 / max(1, (labels == v).sum()) for v in (0, 1)}
    rows = [(c[k : k + TRAIN_LINES], int(v), share[int(v)] / len(c), d) for d, (c, v) in enumerate(zip(chains, labels)) for k in range(0, len(c), TRAIN_LINES)]
    rows.sort(key=lambda r: -len(r[0]))
    out, at = [], 0
    while at < len(rows):
        part = rows[at : at + max(1, GROUP_LINES // len(rows[at][0]))]
        at += len(part)
        _, length, x = _padded([r[0] for r in part])
        out.append((length, np.array([r[1] for r in part]), np.array([r[2] for r in part]), np.arange(x.shape[1])[None] < length[:, None], x.astype(np.float32), np.array([r[3] for r in part])))
    return out


def _slopes(groups: list[tuple[np.ndarray, ...]], w: np.ndarray, edges: np.ndarray, latent: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood: what the labels say about lines and edges less what the field expects.

    That a bad document is not good throughout holds once for all its chains, so the chance that all its lines are good
    is the product over them.
    """
    seen, whole = [], np.zeros(1 + max(int(g[5].max()) for g in groups))
    for length, _, _, mask, x, of in groups:
        u = (x @ w.astype(np.float32)).astype(np.float64) * mask
        good, pair, total = marginals(u, edges, length)
        np.add.at(whole, of, u.sum(1) + (length - 1) * edges[1, 1] - total)
        seen.append((good, pair))
    slope, linked_slope = 0.0, 0.0
    for (length, label, weight, mask, x, of), (good, pair) in zip(groups, seen):
        told, linked = np.repeat(label[:, None], good.shape[1], 1).astype(float), np.zeros_like(pair)
        linked[label == 0, :, 0, 0] = linked[label == 1, :, 1, 1] = 1
        if latent:  # a bad document: any labelling but the one that is good throughout
            all_good = np.exp(np.minimum(whole[of], 0))[:, None]
            rest, bad = np.maximum(1 - all_good, 1e-6), label == 0
            told[bad] = np.clip((good - all_good) / rest, 0, 1)[bad]
            both = pair.copy()
            both[:, :, 1, 1] = np.maximum(both[:, :, 1, 1] - all_good, 0)
            linked[bad] = (both / rest[:, :, None, None])[bad]
        off = (told - good) * mask * weight[:, None]
        real = mask[:, 1:] * weight[:, None]
        slope = slope + np.einsum("nt,ntf->f", off, x)
        linked_slope = linked_slope + ((linked - pair) * real[:, :, None, None]).sum((0, 1))
    return slope, linked_slope


def fit(sample: list[tuple[str, int]], cut: float = 0.3, steps: int = 120, l2: float = 1e-3) -> Model:
    """Train on (text, label) pairs: the field on even rows, the curve on odd ones. Without both labels all score 1."""
    sample = sorted(thinned(sample), key=lambda r: r[1])  # so that every part has both labels
    made = [line_features(t) for t, _ in sample]
    y = np.array([v for _, v in sample])
    width = 3 * N_LINE + 1
    if len(set(y[::2].tolist())) < 2 or len(set(y[1::2].tolist())) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), (0.0, 30.0), 0.0)
    chains = [chain_features(x) for x, _ in made]
    flat = np.vstack(chains[::2])
    mean, scale = flat.mean(0), flat.std(0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    groups = _groups([(c - mean) / scale for c in chains[::2]], y[::2])
    w, edges = np.zeros(width), np.zeros((2, 2))
    for latent in (False, True):
        moment = [np.zeros(width + 4), np.zeros(width + 4)]
        for step in range(1, (steps if not latent else steps // 2) + 1):  # Adam
            slope, linked = _slopes(groups, w, edges, latent)
            g = np.concatenate([slope - l2 * w, (linked - 0.005 * edges).ravel()])
            moment[0] = 0.9 * moment[0] + 0.1 * g
            moment[1] = 0.99 * moment[1] + 0.01 * g * g
            move = (0.02 if latent else 0.1) * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
            w, edges = w + move[:width], edges + move[width:].reshape(2, 2)
    model = Model(mean, scale, w, edges, (1.0, 0.0), 0.0)
    q = quality_of(chains[1::2], [s for _, s in made[1::2]], model)
    curve = logistic(_logit(q)[:, None], y[1::2])
    shift = platt_shift(_logit(q) * curve[0] + curve[1], y[1::2], cut)
    return Model(mean, scale, w, edges, (float(curve[0]), float(curve[1])), shift)


def line_quality(text: str, model: Model) -> np.ndarray:
    """P(line is good) of a text's lines (``line_features`` tells which those are)."""
    u = ((chain_features(line_features(text)[0]) - model.mean) / model.scale) @ model.unary
    return marginals(u[None], model.edges, np.array([len(u)]))[0][0]


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, cut: float = 0.3) -> DataFrame:
    """id, score in [0, 1], predicted (1 from ``cut`` on); with ``keep``, those columns too (the last
    two get a _ before their names where these are taken). No shuffle.

    Null, empty and blank texts score 0. Null ids and repeated rows stay as they are.
    """
    cols = [id_col, *(c for c in keep or [] if c != id_col)]
    made = free_names(["score", "predicted"], cols)
    src = small_batches(docs).select(docs[text_col].cast("string").alias("_text"), *[docs[c] for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]) + f", {made[0]} double, {made[1]} int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("quality")
        for batch in batches:
            for part in _slices(batch):
                s = np.zeros(part.num_rows)
                where, chains, sizes = [], [], []
                for k, t in enumerate(_texts(part.column(0))):
                    if t and t.strip():
                        x, size = line_features(t)
                        where.append(k)
                        chains.append(chain_features(x))
                        sizes.append(size)
                if where:
                    s[where] = sigmoid(_logit(quality_of(chains, sizes, model)) * model.curve[0] + model.curve[1] + model.shift)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*cols, *made])

    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2000, 2000), folds: int = 5, held: int = 0, cut: float = 0.3) -> Model:
    """A model of at most so many labelled bad and good documents (see ``labelled_sample``)."""
    return fit(labelled_sample(docs, labels, "quality", folds, held, per_class), cut)


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scores(docs, train(docs, labels, cut=cut), cut=cut)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
