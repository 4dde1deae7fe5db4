"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of the texts go into a trie. Every node stands for a prefix, by which it is found, and holds
one state: the last token of that prefix's encoding and the ancestor where that token starts. A node's state
follows from its ancestors' (a vocabulary token ends the prefix's encoding iff it and the last token before it
are what BPE makes of the two together). Only ancestors where such a token can start are asked for, so the trie
has nodes for those alone, filled depth first, ancestors before the nodes below, and a prefix that many words
share is encoded once. A word's ids are read off by walking the links back from its leaf.

The vocabulary is a ``tokenizers`` JSON file of the word-end kind: NFC, lower case, a split by pattern,
byte-level symbols, a suffix on each word's last symbol. Its path is a parameter and the file is read on
the executors. Tries and caches of runs between blanks live in the Python worker and are bounded; they start anew when full.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, sole_cache

MAX_PAIRS = 400_000
MAX_NODES = 500_000
MAX_WORDS = 400_000
#: bytes of a word; in longer ones the prefixes would take the square of the length, so they stay out of the trie
MAX_DEPTH = 128
PIECE_CHARS = 1 << 20
_BREAK = re.compile(r"[ \n]")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordTrieBpe:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a BPE vocabulary with a word-end suffix, no decoder and no post-processor is needed")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.symbols = byte_symbols()

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of joining two tokens; for each token its two halves and the rank that makes it (symbols: none, -1)
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made = [-1] * len(self.names)
        for r, (a, b) in enumerate(merges):
            ia, ib, ic = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[ia << 32 | ib] = r
            if ic not in self.halves:
                self.halves[ic] = (ia, ib)
                self.made[ic] = r
        #: tokens by their bytes, those within words and those that end them; the most bytes of a token with the same last three
        code = {c: b for b, c in enumerate(self.symbols)}
        self.inner: dict[bytes, int] = {}
        self.ends: dict[bytes, int] = {}
        self.inner_reach: dict[bytes, int] = {}
        self.ends_reach: dict[bytes, int] = {}
        for t, i in self.vocab.items():
            core = t.removesuffix(self.suffix)
            if core and all(c in code for c in core):
                tokens, reach = (self.inner, self.inner_reach) if core == t else (self.ends, self.ends_reach)
                raw = bytes([code[c] for c in core])
                tokens[raw] = i
                reach[raw[-3:]] = max(reach.get(raw[-3:], 2), len(raw))
        self.longest = max(map(len, chain(self.inner, self.ends)))
        #: the share of the bounds on caches that is used
        self.share = 1.0
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        #: ids of runs between blanks, and those of the generation before: runs in use move on, the rest go
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        """An empty trie: by prefix, the last token << 32 and the depth at which that token starts."""
        self.nodes: dict[bytes, int] = {}
        if len(self._pairs) > MAX_PAIRS * self.share:
            self._pairs.clear()

    # -- which tokens may follow each other -----------------------------------------------------------------
    def merged(self, symbols: list[int]) -> list[int]:
        """Plain BPE: join the pair of lowest rank, the leftmost of equals, until none is left."""
        ids = list(symbols)
        while len(ids) > 1:
            best = min((self.rank.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 40:
                break
            i = best[1]
            a, b = ids[i], ids[i + 1]
            joined, out, k = self.vocab[self.names[a] + self.names[b]], [], 0
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == a and ids[k + 1] == b:
                    out.append(joined)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _symbols_of(self, token: int) -> list[int]:
        if token not in self.halves:
            return [token]
        a, b = self.halves[token]
        return self._symbols_of(a) + self._symbols_of(b)

    def whole(self, token: int) -> bool:
        """Whether BPE turns the token's own symbols into the token."""
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self.merged(self._symbols_of(token)) == [token]
        return ok

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves a boundary between tokens a and b when their symbols stand side by side.

        Walks the two tokens' merge trees along the boundary from the latest merge down; a join across the
        boundary that ranks before the merge undone last would have come first. b has to be whole.
        """
        key = a << 32 | b
        ok = self._pairs.get(key)
        if ok is not None:
            return ok
        rank, made, halves = self.rank.get, self.made, self.halves
        limit, ok = 1 << 40, self.whole(b)
        while ok:
            r = rank(a << 32 | b)
            if r is not None and r < limit:
                ok = False
                break
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # a's merge is the later one: undo it; an equal rank across would have to come before
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]
        if len(self._pairs) > MAX_PAIRS * self.share:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    # -- the trie -------------------------------------------------------------------------------------------
    def insert(self, runs: list[str]) -> None:
        """Give the cache the ids of runs of text without blanks, which are in sorted order, so that their words go
        down the trie depth first. Runs of the generation before move on."""
        cache, older, words, ids_of = self.cache, self.older, self.words, self._word
        for run in runs:
            if run in cache:  # a repeat, or a word of a run before
                continue
            known = older.get(run)
            if known is None:
                if run.isalpha():
                    known = ids_of(run.encode("utf-8"))
                else:
                    parts = []
                    for word in words(run):
                        ids = cache.get(word) or older.get(word)
                        if ids is None:
                            ids = cache[word] = ids_of(word.encode("utf-8"))
                        parts.append(ids)
                    known = b"".join(parts)
            cache[run] = known

    def _word(self, raw: bytes) -> bytes:
        """The ids of a word. Its leaf, with the word-end suffix, comes here once, so it is not kept."""
        n = len(raw)
        if n > MAX_DEPTH:
            return self._long(raw)
        ends, pairs, nodes = self.ends, self._pairs, self.nodes
        for k in range(max(0, n - self.ends_reach.get(raw[-3:], 2)), n):
            token = ends.get(raw[k:])
            if token is None:
                continue
            if not k:
                if self.whole(token):
                    return token.to_bytes(4, "little")
                continue
            before = raw[:k]
            state = nodes.get(before)
            if state is None:
                state = self._node(before)
            ok = pairs.get(state >> 32 << 32 | token)
            if self.follows(state >> 32, token) if ok is None else ok:
                break
        else:
            raise ValueError(f"no encoding of {raw!r}")
        ids = [token, state >> 32]
        while k := state & 0xFFFFFFFF:
            state = nodes[raw[:k]]
            ids.append(state >> 32)
        ids.reverse()
        return array("I", ids).tobytes()

    def _node(self, prefix: bytes) -> int:
        """The state of a new node, and so of the ancestors that it needs."""
        inner, pairs, nodes, n = self.inner, self._pairs, self.nodes, len(prefix)
        for k in range(max(0, n - self.inner_reach.get(prefix[-3:], 2)), n):
            token = inner.get(prefix[k:])
            if token is None:
                continue
            if not k:
                if self.whole(token):
                    break
                continue
            before = prefix[:k]
            state = nodes.get(before)
            if state is None:
                state = self._node(before)
            ok = pairs.get(state >> 32 << 32 | token)
            if self.follows(state >> 32, token) if ok is None else ok:
                break
        else:
            raise ValueError(f"no encoding of {prefix!r}")
        state = nodes[prefix] = token << 32 | k
        return state

    def _long(self, raw: bytes) -> bytes:
        """The ids of a long word: the states of all of its prefixes, from left to right, in arrays of its own."""
        last, start, n = array("i", [-1]), array("i", [0]), len(raw)
        for d in range(1, n + 1):
            tokens, near = self.inner if d < n else self.ends, start[-1]  # the last token mostly extends the one before, or is a shorter one
            for k in chain((near,), range(d - 1, near, -1), range(near - 1, max(0, d - self.longest) - 1, -1)):
                token = tokens.get(raw[k:d])
                if token is not None and (self.follows(last[k], token) if k else self.whole(token)):
                    break
            else:
                raise ValueError(f"no encoding of {raw[:d]!r}")
            last.append(token)
            start.append(k)
        ids, d = [], n
        while d:
            ids.append(last[d])
            d = start[d]
        ids.reverse()
        return array("I", ids).tobytes()

    # -- texts ----------------------------------------------------------------------------------------------
    def _plain(self, text: str) -> list[bytes]:
        out, at = [], 0
        while at < len(text):  # in pieces that start with white space, so that no word or composition is cut
            to = at + PIECE_CHARS
            if to < len(text):
                m = _BREAK.search(text, to)
                to = m.start() if m else len(text)
            piece = text[at:to]
            at = to
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # no final sigma: characters are lowered one by one
            piece = piece.lower()
            # no word of the pattern spans a blank; U+001C..1F are blanks to split(), not to the pattern
            words = self.words(piece) if any(x in piece for x in _SEPARATORS) else piece.split()
            cache = self.cache
            ids = list(map(cache.get, words))
            if None in ids:
                if len(cache) > MAX_WORDS * self.share:
                    self.older, self.cache = cache, {}
                    cache = self.cache
                if len(self.nodes) > MAX_NODES * self.share:
                    self._reset()
                new = [k for k, x in enumerate(ids) if x is None]
                self.insert(sorted([words[k] for k in new]))
                for k in new:
                    ids[k] = cache[words[k]]
            out.append(b"".join(ids))
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self.special_split is None or not any(x in text for x in self.special):
            return b"".join(self._plain(text))
        out = []
        for k, part in enumerate(self.special_split(text)):
            out += [int(self.special[part]).to_bytes(4, "little")] if k % 2 else self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, WordTrieBpe] = {}


def load(path: str, share: float = 1.0) -> WordTrieBpe:
    """The encoder of a file, once per Python worker; its caches take ``share`` of their bounds at most."""
    sole_cache("bpe", _loaded)
    if path not in _loaded:
        _loaded[path] = WordTrieBpe(path)
    _loaded[path].share = share
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``.

    Null and empty texts give no ids; null ids and repeated rows stay as they are; other columns are dropped.
    No shuffle: each task encodes its own rows.
    """
    src = small_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                ids = [bpe.encode(t) for t in _texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[id_col, "ids", "n_tokens"])

    return src.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``encode`` to id and ``text``: the tokens' strings joined by blanks, special ones too; null ids stay null."""
    src = encoded.select(id_col, "ids")

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests: id, n_tokens, ids_sha256, decoded_sha256."""
    src = small_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                n, a, b = [], [], []
                for t in _texts(part.column(1)):
                    ids = bpe.encode(t)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)
