"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on windows of ordinary texts, and
both end in the same third one, trained on other ordinary texts. A window is compressed with each; the bytes that
the toxic dictionary saves are its gain. A document's features are the sum of the gains of its windows that reach a
threshold, and the number of its windows; a logistic curve turns them into log odds.

A window is some neighbouring words. A match shorter than ``DMER`` bytes, the length of the segments that the
dictionaries are trained on, tells nothing, so a window that has no ``DMER`` bytes in common with what only the
toxic dictionary holds gains nothing. Most of a toxic text is ordinary language, so its windows are purified by the
compression distance itself: the toxic texts are parted in ``FOLDS`` parts; dictionaries of each part alone, of
several sizes, judge the windows of the others, and a window stays if enough parts give it a gain that nearly no
ordinary window has. So what stays recurs in several parts. The next round's dictionaries are trained on what stays.

How much ordinary language the third dictionary should hold depends on how many labelled texts there are: with few
of them, a large one holds the very words that tell toxic texts. So there are ``TEAMS``: one of three members with
small third dictionaries and windows of one word, and one with a large third dictionary and windows of two. Within a
member, how rare a gain has to be, the dictionary's size and the threshold are chosen by the likelihood of texts
judged by the dictionaries of the other parts (ordinary texts, which are in no dictionary, by all of them in turn); so
is the team, whose log odds are the mean of its members'. The trained dictionaries serve as content, without
their entropy tables, so that only matches tell them apart; a carrier stands around each window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices, _texts
from .common import free_names, small_batches, sole_cache
from .minhash import shingles
from .training import labelled_sample, logistic, platt_shift, remainder, sigmoid

#: Windows that a cache holds at most, and characters of a window that is kept: text without blanks is one window.
MAX_CACHE, LONG = 200_000, 64
#: Characters of texts whose bytes are looked at together.
AT_ONCE = 500_000
LEVEL = 9
#: Parts of the toxic texts, and rounds of purification at most.
FOLDS, ROUNDS = 4, 3
#: Segment and d-mer length of the dictionary training.
SEGMENT, DMER = 24, 6
#: Ordinary windows by which a gain is judged, thresholds that are tried, and windows that are added to a text's number
#: of them, so that a text of few words is judged like one of some.
BACKGROUND, THRESHOLDS, PRIOR = 10_000, range(1, 9), 50
#: What a false alarm weighs against a miss where the cut is placed; and the mean log likelihood from which on a team is
#: taken without trying the next one.
ALARM, ENOUGH = 2.0, -0.05


@dataclass(frozen=True)
class Team:
    """How members are trained: words of a window, sizes of the third dictionaries (one member each), of the first round's
    and the later rounds' dictionaries, the shares of ordinary windows of which one is to be exceeded, and how many parts
    have to agree in the first and in later rounds."""

    words: int
    bases: tuple[int, ...]
    first: tuple[int, ...]
    later: tuple[int, ...]
    rares: tuple[float, ...]
    votes: tuple[int, int]


TEAMS = (Team(2, (65_536,), (16_384,), (1024, 2048, 4096), (0.998, 0.99), (1, 3)), Team(1, (4096, 5120, 6144), (8192, 65_536), (1024, 2048, 4096), (0.98, 0.97), (2, 3)))
MARKS = ".,;:!?|\"'()[]{}#$%&*"
#: They stand before and after every window, and end both dictionaries: the first so that a short window's own
#: bytes count in a compressed block, the second as zstandard looks for no match in a block's last bytes.
CARRIER, TAIL = b"\x01=0123456789-window-to-be-compared-9876543210=\x01", b"\x02|what-ends-each-window|\x02"
#: The end of both dictionaries; the fill keeps their marks apart, and the last bytes, which are not indexed, free.
FRAME = b"\x03" * 8 + CARRIER + b"\x04" * 8 + TAIL + b"\x05" * 32


@dataclass(frozen=True)
class Member:
    toxic: bytes
    ordinary: bytes
    base: bytes
    threshold: int
    weights: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    """All that scoring needs; a few hundred KB at most."""

    members: tuple[Member, ...]
    shift: float
    window_words: int


def windows(text: str, k: int) -> list[str]:
    """The text's windows of ``k`` words in lower case, without marks at the words' ends."""
    words = [x for w in text.lower().split() if (x := w.strip(MARKS))]
    return words if k == 1 else [" ".join(words[i : i + k]) for i in range(0, len(words), k)]


def packed(w: list[str]) -> bytes:
    """Windows as one value: a list of short strings takes several times their bytes. They hold no line ends."""
    return "\n".join(w).encode("utf-8", "surrogatepass")


def unpacked(doc: bytes) -> list[str]:
    return doc.decode("utf-8", "surrogatepass").split("\n") if doc else []


class Kept(dict):
    """Window -> number, for as many windows as memory allows."""

    def keep(self, window: str, n):
        if len(window) <= LONG:
            if len(self) >= MAX_CACHE:
                self.clear()
            self[window] = n
        return n


class Lengths(Kept):
    """Window -> its compressed length with a dictionary."""

    def __init__(self, dictionary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_LAZY2, window_log=18, hash_log=18, chain_log=18, search_log=8, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress

    def length(self, window: str) -> int:
        return len(self.compress(CARRIER + f" {window} ".encode("utf-8", "surrogatepass") + TAIL))

    def __missing__(self, window: str) -> int:
        return self.keep(window, self.length(window))


class Gains(Kept):
    """Window -> bytes that the toxic dictionary (``toxic``, then ``base``) saves against the ordinary one, which is
    given as a function; 0 where ``toxic`` holds no ``DMER`` bytes of the window."""

    def __init__(self, toxic: bytes, base: bytes, ordinary: Callable[[str], int]):
        self.toxic, self.ordinary = Lengths(toxic + base).length, ordinary
        self.apart = {toxic[i : i + DMER] for i in range(len(toxic) - DMER + 1)}.isdisjoint

    def gain(self, window: str) -> int:
        raw = f" {window} ".encode("utf-8", "surrogatepass")
        if self.apart([raw[i : i + DMER] for i in range(len(raw) - DMER + 1)]):
            return 0
        return max(0, self.ordinary(window) - self.toxic(window))

    def __missing__(self, window: str) -> int:
        return self.keep(window, self.gain(window))


def dmers(data: bytes) -> np.ndarray:
    """The ``DMER`` bytes from each place on, as numbers."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(x) - DMER + 1)
    return sum((x[i : i + n] << np.uint64(8 * i) for i in range(DMER)), np.zeros(n, np.uint64))


def hashed(x: np.ndarray, bits: int = 32) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint32)


class TeamGains(Kept):
    """Window -> what it adds to the sum of each member; () where it adds nothing to any."""

    def __init__(self, members: tuple[Member, ...]):
        self.parts = [(Gains(m.toxic, m.base, Lengths(m.ordinary + m.base).length).gain, m.threshold) for m in members]
        known = np.unique(np.concatenate([dmers(m.toxic) for m in members]))
        self.known, self.marks = known, np.zeros(1 << 16, bool)
        self.marks[hashed(known, 16)] = True

    def __missing__(self, window: str) -> tuple[int, ...]:
        gains = tuple(g if (g := gain(window)) >= threshold else 0 for gain, threshold in self.parts)
        return self.keep(window, gains if any(gains) else ())

    def sums(self, docs: list[list[str]]) -> np.ndarray:
        """Of each document and member. Windows without ``DMER`` bytes of a member's dictionary are told from all bytes at
        once: a table of hashes first, then the numbers themselves."""
        out = np.zeros((len(docs), len(self.parts)))
        flat = [w for d in docs for w in d]
        raw = [w.encode("utf-8", "surrogatepass") for w in flat]
        data = b" \n " + b" \n ".join(raw) + b" \n "
        found = dmers(data)
        at = np.flatnonzero(self.marks[hashed(found, 16)])
        at = at[np.isin(found[at], self.known)]
        starts = np.cumsum([2, *(len(r) + 3 for r in raw)])
        of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        for i in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
            if 0 <= i < len(flat) and (g := self[flat[i]]):
                out[of[i]] += g
        return out


def features(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logarithms of the summed gains and of the number of windows, and a constant."""
    return np.column_stack([np.log1p(sums), np.log(np.asarray(n) + PRIOR), np.ones(len(n))])


def log_odds(gains: TeamGains, model: Model, docs: list[list[str]]) -> np.ndarray:
    """Of texts, given by their windows; some texts at a time, as numbers take several times their bytes."""
    parts, at = [], 0
    sizes = [sum(map(len, d)) for d in docs]
    while at < len(docs):
        end, total = at, 0
        while end < len(docs) and (end == at or total + sizes[end] <= AT_ONCE):
            total += sizes[end]
            end += 1
        parts.append(gains.sums(docs[at:end]))
        at = end
    sums = np.concatenate(parts) if parts else np.zeros((0, len(model.members)))
    n = np.array([len(d) for d in docs], float)
    return np.mean([features(sums[:, j], n) @ np.array(m.weights) for j, m in enumerate(model.members)], 0) + model.shift


def thinned(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies: of texts that share their least or greatest shingle the first stays."""
    seen, out = set(), []
    for text, y in sample:
        s = shingles(text, 5)
        if len(s) and s[0] not in seen and s[-1] not in seen:
            out.append((text, y))
            seen.update((s[0], s[-1]))
    return out


def train_dictionary(samples: Iterable[str], size: int) -> bytes:
    """A zstandard dictionary of the windows; their plain text where there are too few to train on."""
    raw = [f" {s} ".encode("utf-8", "surrogatepass") for s in samples]
    try:
        return zstandard.train_dictionary(size, raw, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(raw))[-size:] or b" " * 8


def _flat(docs: list[bytes]) -> Iterator[str]:
    return (w for d in docs for w in unpacked(d))


def _member(toxic: list[bytes], ordinary: list[bytes], team: Team, base_bytes: int) -> tuple[float, Member, np.ndarray]:
    """(mean log likelihood, member, log odds of the toxic texts, then of the ordinary ones that are in no dictionary), all
    by texts that the judging dictionaries do not hold."""
    shared, against, apart = ordinary[0::2], ordinary[1::4], ordinary[3::4]
    base = train_dictionary(_flat(shared), base_bytes) + FRAME  # training ends early when little recurs
    step = max(1, sum(d.count(b"\n") + 1 for d in apart) // BACKGROUND)
    background = list(islice(_flat(apart), 0, None, step))
    controls = {size: (own := train_dictionary(_flat(against), size), Lengths(own + base).__getitem__) for size in {*team.first, *team.later}}

    def judge(kept: list[bytes], parts: list[int], size: int) -> Gains:
        held = [d for i, d in enumerate(kept) if i % FOLDS in parts]
        return Gains(train_dictionary(_flat(held if any(held) else [d for i, d in enumerate(toxic) if i % FOLDS in parts]), size), base, controls[size][1])

    def voted(kept: list[bytes], p: int, sizes: tuple[int, ...], rares: tuple[float, ...]) -> dict[float, list[set[str]]]:
        """For each rarity and each other part, the windows with a gain that so many ordinary windows do not have."""
        out = {r: [set() for _ in range(FOLDS)] for r in rares}
        for size in sizes:
            gains = judge(kept, [p], size)
            usual = [gains[w] for w in background]
            least = {r: float(np.quantile(usual, r)) for r in rares}
            lowest = min(least.values())
            for i, d in enumerate(toxic):
                if i % FOLDS != p:
                    for w in unpacked(d):
                        if (g := gains[w]) > lowest:
                            for r in rares:
                                if g > least[r]:
                                    out[r][i % FOLDS].add(w)
        return out

    first = [voted(toxic, p, team.first, team.rares) for p in range(FOLDS)]
    y = np.array([1] * len(toxic) + [0] * len(apart))
    side = np.where(y == 1, 0.5 / len(toxic), 0.5 / len(apart))
    n = np.array([d.count(b"\n") + 1 for d in [*toxic, *apart]], float)
    best = None
    for rare in team.rares:
        kept = toxic
        for r in range(ROUNDS):
            votes = [(v if r == 0 else voted(kept, p, team.later, (rare,)))[rare] for p, v in enumerate(first)]
            tally = [Counter(w for v in votes for w in v[h]) for h in range(FOLDS)]
            after = [packed([w for w in unpacked(d) if tally[i % FOLDS][w] >= team.votes[r > 0]]) for i, d in enumerate(toxic)]
            if after == kept:
                break
            kept = after
        for size in team.later:
            seen: list = [None] * len(y)
            for h in range(FOLDS):
                gains = judge(kept, [p for p in range(FOLDS) if p != h], size)
                for part, at in ((toxic, 0), (apart, len(toxic))):
                    for i in range(h, len(part), FOLDS):
                        seen[at + i] = np.array([g for g in map(gains.__getitem__, unpacked(part[i])) if g], np.int64)
            for threshold in THRESHOLDS:
                x = features(np.array([g[g >= threshold].sum() for g in seen], float), n)
                weights = logistic(x[:, :2], y)
                z = x @ weights
                p = sigmoid(z)
                like = float((side * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum())
                if best is None or like > best[0]:
                    best = (like, threshold, weights, z, size, kept)
    like, threshold, weights, z, size, kept = best
    final = train_dictionary(_flat(kept if any(kept) else toxic), size)
    return like, Member(final, controls[size][0], base, threshold, tuple(weights.tolist())), z


def fit(sample: list[tuple[str, int]], cut: float = 0.7, teams: tuple[Team, ...] = TEAMS) -> Model:
    """Train on (text, label) pairs; with fewer than four toxic or six ordinary texts every document scores 0.

    The sample may be as long as its budget allows, so its windows stay packed, gains are told one judge after
    the other, and caches are bounded.
    """
    sample = thinned(sample)
    if sum(v for _, v in sample) < FOLDS or sum(1 - v for _, v in sample) < 6:
        return Model((Member(b" " * 8, b" " * 8, b"", 1 << 20, (0.0, 0.0, -30.0)),), 0.0, teams[0].words)
    best = None
    for team in teams:
        parts: tuple[list[bytes], list[bytes]] = ([], [])
        for t, v in sample:
            parts[1 - v].append(packed(windows(t, team.words)))
        toxic, ordinary = parts
        found = [_member(toxic, ordinary, team, b) for b in team.bases]
        z = np.mean([f[2] for f in found], 0)
        y = np.array([1] * len(toxic) + [0] * (len(z) - len(toxic)))
        p = sigmoid(z)
        like = float(np.mean([np.log(p[y == 1] + 1e-12).mean(), np.log(1 - p[y == 0] + 1e-12).mean()]))
        if best is None or like > best[0]:
            best = (like, Model(tuple(f[1] for f in found), platt_shift(z, y, cut, ALARM), team.words))
        if like > ENOUGH:
            break
    return best[1]


_gains: dict[Model, TeamGains] = {}


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, cut: float = 0.7) -> DataFrame:
    """id, score in [0, 1], predicted (1 from ``cut`` on); with ``keep``, those columns too (the last
    two get a _ before their names where these are taken). No shuffle.

    Null and empty texts have no windows and score by that. Null ids and repeated rows stay as they are.
    """
    cols = [id_col, *(c for c in keep or [] if c != id_col)]
    made = free_names(["score", "predicted"], cols)
    src = small_batches(docs).select(docs[text_col].cast("string").alias("_text"), *[docs[c] for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]) + f", {made[0]} double, {made[1]} int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("toxicity", _gains)
        if model not in _gains:
            _gains.clear()
            _gains[model] = TeamGains(model.members)
        gains = _gains[model]
        for batch in batches:
            for part in _slices(batch):
                s = sigmoid(log_odds(gains, model, [windows(t or "", model.window_words) for t in _texts(part.column(0))]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*cols, *made])

    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (3000, 1500), folds: int = 3, held: int = 1, cut: float = 0.7) -> Model:
    """A model of at most so many labelled ordinary and toxic documents (see ``labelled_sample``)."""
    return fit(labelled_sample(docs, labels, "toxic", folds, held, per_class), cut)


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scores(docs, train(docs, labels, cut=cut), cut=cut)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
