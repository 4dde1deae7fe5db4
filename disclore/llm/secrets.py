"""Secret scans: candidate strings, judged by a random forest.

Candidates are long runs of key characters with a digit among them, whatever of 8 or more characters without blanks
is assigned to a telling name by = or :, in quotes or not, passwords in addresses, and blocks of private keys. A
random forest removes the false ones by the candidate's length, character transitions and shares, how much of it
dictionary words cover, path and address signs, and the words before and after it. The dictionary is a list of
words that is given (the queries take the whole words of a public vocabulary file). The forest is trained on
labelled findings: made-up keys of common shapes, and made-up strings that look alike (digests of files and
commits, identifiers, paths, addresses, numbers, names, references). The findings are made from a seed, so training
is the same everywhere.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices, _texts
from .common import free_names, small_batches, sole_cache

CANDIDATE = re.compile(r"[A-Za-z0-9_+/.=@:\-]{12,}")
DIGIT = re.compile(r"[0-9]")
SPLIT_NAME = re.compile(r"^([A-Za-z][A-Za-z0-9_.\-]{1,40}?)\s*[=:]{1,2}(?!/)(.{8,})$")
SIGN = re.compile(r"[=:]{1,3}>?")
NAME = re.compile(r"([A-Za-z][\w.\-]*)[\"'`\])]*[ \t]*$")
VALUE = re.compile(r"""[ \t]*(?:(["'`])((?:\\\S?|(?!\1)[^\s\\])*)(\1?)|([^\s"'`]\S*))""")
#: Where a value without quotes ends before the next blank: at the next name, at a closing quote, at a closing tag.
VALUE_END = re.compile(r"""[&;,](?=["'`]?[A-Za-z_][\w.\-]*["'`]?[=:])|["'`](?=[>,;)\]}:]|$)|</""")
OPENED = {")": "(", "]": "[", "}": "{", ">": "<"}
NAME_AND_SIGN = re.compile(r"[A-Za-z][\w.\-]*[=:]{1,3}")
NAME_SPAN, LEAST = 64, 8
LOGIN = re.compile(r"://[^\s/:@]*:([^\s/@]{6,})@")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
BLOCK_LINE = re.compile(r"\s*[A-Za-z0-9+/=]{16,}[ \t\r]*(?=\n|$)")
#: A value with a digit that is told after a strong name, without a sign between.
TOLD = re.compile(r"(password|passwd|pwd|passphrase|secret|token)[ \t]+(?:is|was)?[ \t]*[\"'`]?((?=[^\s\"'`]*[0-9])[^\s\"'`]{8,})", re.I)
BESIDE = 32
MARK = "[REDACTED]"
#: Names that announce a secret, and common words that identifiers are made of.
TELLING = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "api", "private", "access", "akia")
#: Names of what is public although it looks random.
PUBLIC = ("commit", "sha", "md5", "checksum", "digest", "hash", "revision", "rev", "etag", "integrity", "crc", "fingerprint", "uuid", "guid", "build", "version", "tree", "blob", "merge", "object")
DICTIONARY = ("account", "address", "batch", "build", "cache", "check", "class", "client", "code", "config", "content", "count", "data", "date", "default", "document", "error", "event", "example", "false", "field", "file", "format", "group", "handler", "http", "image", "index", "input", "item", "label", "length", "level", "license", "line", "list", "mail", "main", "manager", "message", "method", "model", "module", "name", "node", "number", "object", "option", "order", "output", "page", "param", "path", "point", "process", "project", "query", "record", "release", "report", "request", "result", "return", "sample", "schema", "search", "server", "service", "session", "source", "spark", "start", "state", "status", "stream", "string", "system", "table", "task", "test", "text", "time", "title", "true", "type", "update", "user", "value", "version", "view", "window", "write", "tion", "ing", "the", "and", "ment")
#: Names whose values may be phrases, and common pairs of letters, by which words are told from random letters.
STRONG = ("secret", "password", "passwd", "pwd", "token", "credential")
PAIRS = frozenset("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ll ri ro li io ic ne me co ta ma ce ch om ec qu ui ir pt na bl ab il la di ss".split())
#: Ordinary words: values of telling names in prose, and the parts of phrases.
ORDINARY = ("required", "optional", "incorrect", "important", "undefined", "something", "different", "available", "information", "management", "understanding", "development", "everything", "necessary", "protected", "encrypted", "disabled", "expired", "Alexander", "Elizabeth", "ordinary", "question", "following", "together", "children", "mountain", "government", "interesting", "restricted", "unlimited")
SHORT = ("correct", "horse", "battery", "staple", "river", "stone", "green", "window", "paper", "tiger", "cloud", "silver", "apple", "garden", "north", "summer", "candle", "orange", "forest", "bridge", "rocket", "violin")
_KINDS = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}


def whole_words(vocabulary: str, least: int = 4) -> frozenset[str]:
    """The words of letters that end a word in a ``tokenizers`` vocabulary file, from ``least`` letters on."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    return frozenset(w for t in model["vocab"] if t.endswith(end) and len(w := t.removesuffix(end)) >= least and w.isascii() and w.isalpha() and w.islower())


def covered(value: str, words: frozenset[str]) -> int:
    """Letters of the value that words cover, the longest word at each place first."""
    total = 0
    for run in re.findall(r"[a-z]{3,}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
        at = 0
        while at < len(run):
            for k in range(min(len(run), at + 16), at + 2, -1):
                if run[at:k] in words:
                    total += k - at
                    at = k
                    break
            else:
                at += 1
    return total


def split_candidate(text: str, start: int, end: int) -> tuple[int, int, str, str]:
    """(start, end, name, words before) of the value in a candidate run: ``name=value`` runs are split, end marks dropped."""
    run = text[start:end].rstrip(".:=-@/") or text[start:end]
    before = text[max(0, start - BESIDE) : start]
    m = SPLIT_NAME.match(run)
    if m:
        return start + m.start(2), start + len(run), m.group(1).lower(), before.lower()
    return start, start + len(run), "", before.lower()


def marked_values(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Passwords in addresses, values with a digit right after a strong name, and blocks of private keys up to their end line
    (without one, up to the last key line)."""
    low = text.lower()
    for m in TOLD.finditer(text) if any(t in low for t in ("passw", "pwd", "passphrase", "secret", "token")) else ():
        if not SIGN.search(m[2]):
            s, e = m.start(2), _trimmed(text, *m.span(2))
            if e - s >= LEAST:
                yield s, e, m[1].lower(), text[max(0, s - BESIDE) : s].lower()
    for m in LOGIN.finditer(text):
        yield *m.span(1), "password", text[max(0, m.start() - BESIDE) : m.start()].lower()
    ends = BLOCK_END.finditer(text)  # both ends are looked for once, however many blocks begin
    end, starts, at = next(ends, None), list(BLOCK.finditer(text)), 0
    for m, stop in zip(starts, [*starts[1:], None]):
        if m.start() < at:
            continue
        while end and end.start() < m.end():
            end = next(ends, None)
        at = m.end()
        if end and not (stop and stop.start() < end.start()):
            at = end.end()
        else:
            while line := BLOCK_LINE.match(text, at):
                at = line.end()
        yield m.start(), at, "private key", text[max(0, m.start() - BESIDE) : m.start()].lower()


def _trimmed(text: str, s: int, e: int) -> int:
    """Where text[s:e] ends without the marks that close a sentence, and brackets that it does not open."""
    opens: dict[str, int] = {}
    while e > s:
        c = text[e - 1]
        if c in OPENED:
            if c not in opens:
                opens[c] = text.find(OPENED[c], s, e)
            if 0 <= opens[c] < e:
                break
        elif c not in ".,;:\"'`":
            break
        e -= 1
    return e


def _ended(text: str, s: int, e: int) -> int:
    """Where a value without quotes in text[s:e] ends."""
    end = VALUE_END.search(text[s:e])
    return _trimmed(text, s, s + end.start() if end else e)


def assigned_values(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, words before) of the values of telling names.

    A quoted value ends at its quote, another one before a blank or the next name, less the marks that close a
    sentence. Telling names within a value have values of their own, each up to the next such name, so that all values of a
    text together are at most twice as long as it.
    """
    inner, outer_end, at = None, 0, 0

    def within(s: int, name: str, e: int) -> tuple[int, int, str, str]:
        if text[s : s + 1] in ("'", '"', "`") and s < e:
            s, quote = s + 1, text[s]
            close = text.find(quote, s, e)
            e = close if close >= 0 else _trimmed(text, s, e)
        else:
            e = _ended(text, s, e)
        return s, e, name, text[max(0, s - BESIDE) : s].lower()

    while sign := SIGN.search(text, at):
        at = sign.end()
        from_ = max(0, sign.start() - NAME_SPAN)
        near = text[from_ : sign.start()].lower()
        if not any(t in near for t in TELLING):
            continue
        m = NAME.search(text, from_, sign.start())
        if not m or not any(t in m[1].lower() for t in TELLING) or text.startswith("//", at):
            continue
        if sign.start() < outer_end:
            if inner and (c := within(*inner, max(inner[0], m.start(1))))[1] - c[0] >= LEAST:
                yield c
            inner = (at, m[1].lower())
            continue
        if inner and (c := within(*inner, outer_end))[1] - c[0] >= LEAST:
            yield c
        inner = None
        v = VALUE.match(text, at)
        if not v:
            continue
        s, e = v.span(2) if v[1] else v.span(4)
        if not v[3]:
            e = _trimmed(text, s, e) if v[1] else _ended(text, s, e)
        outer_end = e
        if e - s >= LEAST:
            yield s, e, m[1].lower(), text[max(0, s - BESIDE) : s].lower()
    if inner and (c := within(*inner, outer_end))[1] - c[0] >= LEAST:
        yield c


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Runs, assigned and marked values, each place once; they may overlap. A run that is a name and the start of its
    assigned value is left to that value."""
    assigned = sorted(assigned_values(text), key=lambda c: c[:2])
    starts, at, seen = [c[0] for c in assigned], 0, set()
    for m in CANDIDATE.finditer(text):
        s, e, name, before = split_candidate(text, m.start(), m.end())
        if e - s >= 8 and (DIGIT.search(text, s, e) or any(t in name for t in TELLING)):
            while at < len(starts) and starts[at] <= s:
                at += 1
            if not name and at < len(starts) and starts[at] < e <= assigned[at][1] and NAME_AND_SIGN.fullmatch(text, s, starts[at]):
                continue
            seen.add((s, e))
            yield s, e, name, before
    for c in [*assigned, *marked_values(text)]:
        if c[:2] not in seen:
            seen.add(c[:2])
            yield c


def candidate_features(value: str, name: str, before: str, after: str, dictionary: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [_KINDS.get(c, 3) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    moves = Counter(zip(kinds, kinds[1:]))
    steps = max(1, n - 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    words, then = re.findall(r"[a-z0-9]+", before)[-2:], re.findall(r"[a-z]+", after)[:2]
    assigned = bool(name) or bool(re.search(r"[=:]\s*[\"']?$", before))
    near = any(t in w for w in [*words, name] for t in TELLING)
    hexed = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    return [
        float(n), *share, entropy, entropy / math.log2(n + 1), sum(c for (a, b), c in moves.items() if a != b) / steps,
        (moves[0, 2] + moves[2, 0]) / steps, (moves[1, 2] + moves[2, 1]) / steps, (moves[0, 1] + moves[1, 0]) / steps,
        hexed, covered(value, dictionary) / n, float(value.count("/")), float("@" in value or "://" in value), float(value.count(".")),
        float(value.count("-") + value.count("_")), float(assigned), float(near), max(len(x) for x in re.split(r"[^0-9]", value)) / n,
        float(len(set(value))), float(value.isupper() and value.isalnum()),
        sum(value[i : i + 2].lower() in PAIRS for i in range(n - 1)) / steps, float(any(t in w for w in [*words[-1:], name] for t in STRONG)),
        float(any(w.startswith(PUBLIC) for w in [*words, name] if w)), float(any(t in w for w in then for t in (*TELLING, *PUBLIC))),
        float(hexed == 1 and n in (32, 40, 56, 64, 96, 128)), float("PRIVATE KEY-----" in value),
    ]


Finding = tuple[str, str, str, str, int]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[Finding]:
    """(value, name, words before, words after, 1 for a secret) made from a seed."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    hexed, alnum, upper, lowered = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase
    word = lambda: rng.choice(DICTIONARY)
    prose = lambda: " ".join(pick("etaoinshrdlu", rng.randint(2, 8)) for _ in range(3)) + " "
    secret_name = lambda: rng.choice(("api_key", "token", "secret", "password", "auth_token", "access_key", "client_secret", "private_key", "passwd"))
    out = []
    for _ in range(n):
        kind = rng.randrange(8)
        named = kind in (1, 2, 3, 6) or rng.random() < 0.4
        value = (
            lambda: "AKIA" + pick(upper, 16), lambda: pick(hexed, 40), lambda: pick(hexed, rng.choice((18, 32, 64))), lambda: pick(alnum, rng.randint(16, 44)),
            lambda: rng.choice(("ghp_", "gho_", "xoxb-", "sk-", "sk_live_")) + pick(alnum, rng.randint(20, 40)) if rng.random() < 0.7 else f"xox{rng.choice('abpr')}-{pick(string.digits, rng.randint(10, 13))}-{pick(string.digits, rng.randint(10, 13))}-{pick(rng.choice((alnum, lowered)), rng.randint(16, 32))}", lambda: "AIza" + pick(alnum + "-_", 35), lambda: pick(alnum + "!@#", rng.randint(10, 20)).replace("!", "1"), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum + "-_", 40) + "." + pick(alnum + "-_", 30),
        )[kind]()
        style = rng.randrange(3)
        name, before = (secret_name(), prose()) if named and style == 0 else ("", prose() + secret_name() + rng.choice((' = "', ": ", "=", ' is "'))) if named else ("", prose())
        out.append((value, name, before, rng.choice(("", " ", '"\n', " ")) + prose(), 1))
        kind = rng.randrange(12)
        value = (
            lambda: f"{pick('etaoinsr', rng.randint(3, 7))}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: pick(string.digits, rng.choice((12, 13, 16))), lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"20{pick(string.digits, 2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(10, 23)}:{pick('012345', 2)}:00",
            lambda: "-".join(pick(hexed, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(word() for _ in range(rng.randint(2, 5))) + str(rng.randint(0, 99)) + rng.choice((".py", ".html", "")), lambda: f"https://www.{word()}{rng.randint(1, 99)}.example.org/{word()}/{rng.randint(1, 9999)}", lambda: "_".join(word() for _ in range(rng.randint(2, 4))) + f"_{rng.randint(0, 999)}",
            lambda: word().title() + word().title() + word().title() + str(rng.randint(0, 9)), lambda: pick("etaoinshrdlucm", rng.randint(12, 24)) + rng.choice(("", "1", "2.")), lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word()}.{rng.randint(1, 9)}", lambda: f"+{rng.randint(1, 99)}-{pick(string.digits, 3)}-{pick(string.digits, 4)}-{pick(string.digits, 3)}",
        )[kind]()
        before = prose() + rng.choice(("", "", "see ", "file: ", "id = ", "commit ", "version: ", "path="))
        out.append((value, rng.choice(("", "", word())), before, prose(), 0))
        if rng.random() < 0.5:  # digests and commits, named before or after, in hex or base64
            told = rng.choice(PUBLIC)
            digest = pick(rng.choice((hexed, hexed, hexed.upper())), rng.choice((32, 40, 40, 64, 64, 96, 128))) if rng.random() < 0.8 else pick(alnum + "+/", rng.choice((43, 64, 86))) + "="
            told += rng.choice(("", "", "1", "256", "512", "sum", "_id"))
            place = rng.randrange(3)
            out.append((digest, told if place == 0 else "", prose() + (told + rng.choice((" ", ": ", " = ", ":", " (")) if place == 1 else ""), f" {told} " if place == 2 else " " + prose(), 0))
        if rng.random() < 0.1:  # public keys are no secrets
            told = rng.choice(("ssh-rsa ", "ssh-ed25519 ", "ssh-dss ", "ecdsa-sha2-nistp256 "))
            out.append(("AAAA" + rng.choice(("B3NzaC1yc2EAAAADAQAB", "C3NzaC1lZDI1NTE5AAAA", "B3NzaC1kc3MAAACB", "E2VjZHNhLXNoYTItbmlz")) + pick(alnum + "+/", rng.choice((44, 90, 300, 350))) + rng.choice(("", "=", "==")), "", prose() + told, " " + word() + "@" + word() + rng.choice(("", "\n")), 0))
        if rng.random() < 0.1:
            out.append((pick(alnum + "+/", 64), "", pick(alnum + "+/", 31) + "\n", "\n" + pick(alnum + "+/", 31), 0))
            kind = rng.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
            out.append((f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randint(1, 26))) + rng.choice((f"\n-----END {kind}PRIVATE KEY-----", "")), "private key", prose(), "", 1))
        if rng.random() < 0.2:
            out.append((pick("x*0", 1) * rng.randint(8, 20) + rng.choice(("", "1")), secret_name(), prose(), "", 0))
            out.append((pick(hexed, rng.choice((7, 12))) + "0" * rng.randint(2, 6), "", prose() + "commit ", prose(), 0))
    return out + _assigned_findings(n, random.Random(seed + 1))


def _assigned_findings(n: int, rng: random.Random) -> list[Finding]:
    """Values of telling names: phrases, letters alone, short keys and special signs; against words, references and code."""
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    lower, letters, alnum = string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits
    strong = lambda: rng.choice(("password", "secret", "passwd", "db_password", "client_secret", "token", "auth_token", "pwd", "credential"))
    weak = lambda: rng.choice(("key", "api", "access", "author", "private", "auth", "keywords", "api_version", "access_level", "monkey"))
    word = lambda: rng.choice((*ORDINARY, *(w for w in DICTIONARY if len(w) > 3)))
    sign = lambda: rng.choice((": ", " = ", "=", ': "', ' = "', ":"))
    start = rng.randrange
    out = []
    for _ in range(n):
        name = strong() if rng.random() < 0.8 else rng.choice(("api_key", "access_key", "private_key", "apikey"))
        k = rng.randrange(8)
        value = (
            lambda: rng.choice("-_.").join(rng.choice((*SHORT, pick("etaoinsrhldcu", rng.randint(4, 8)))) for _ in range(rng.randint(3, 5))), lambda: pick(lower, rng.randint(10, 24)), lambda: (lower * 2)[(i := start(26)) : i + rng.randint(10, 20)],
            lambda: pick(alnum, rng.randint(8, 15)), lambda: pick(alnum + "!@#$%&*^?+", rng.randint(8, 24)), lambda: rng.choice(SHORT).title() + pick("!#$%&@", 1) + pick(string.digits, rng.randint(2, 4)) + rng.choice(("", "!", "$")) + pick(letters, 3), lambda: pick(letters, rng.randint(10, 24)), lambda: "".join(rng.choice(SHORT) + pick(string.digits, rng.randint(1, 4)) for _ in range(2)),
        )[k]()
        if k in (0, 7):
            name = strong()
        out.append((value, name, f"{pick(lower, 5)} {name}{sign()}", rng.choice(("", '"', "\n", " and")), 1))
        name = strong() if rng.random() < 0.5 else weak()
        k = rng.randrange(8)
        value = (
            lambda: rng.choice((str, str.title, str.upper))(word() + rng.choice(("", "", "s", "ing"))), lambda: word().title(), lambda: rng.choice(("${%s}", "<your-%s>", "{{%s}}", "YOUR_%s", "$%s", "<%s>", "%%%s%%", "[%s]"))  % rng.choice((name, name.upper())), lambda: rng.choice(("get", "read", "load", "make")) + word().title() + rng.choice(("()", "(self)", "(user)", "(config).value")),
            lambda: f"os.environ['{name.upper()}']" if rng.random() < 0.5 else f"{word()}.{word()}.{name}", lambda: f"https://www.{word()}.example.org/{word()}", lambda: pick("x*.-", 1) * rng.randint(8, 20), lambda: f"{word()}-{word()}" if name in STRONG else f"{word()}-{word()}-{word()}",
        )[k]()
        if len(value) >= LEAST:
            out.append((value, name, f"{pick(lower, 5)} {name}{sign()}", rng.choice(("", '"', "\n", " and")), 0))
    return out


class Forest:
    """Random forest: bootstrap samples, a random subset of features at each split, Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 11, leaf: int = 4, seed: int = 11, dictionary: frozenset[str] = frozenset()):
        self.n_trees, self.depth, self.leaf, self.seed, self.dictionary = trees, depth, leaf, seed, dictionary
        #: for each tree the arrays of its nodes: feature (-1: a leaf), cut, left, right, share of secrets
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[rows], y[rows], 0, nodes, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, float(y.mean())))
        if depth == self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = None
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            left = np.arange(1, len(t))
            ones = np.cumsum(t)[:-1]
            p, q = ones / left, (t.sum() - ones) / (len(t) - left)
            impurity = left * p * (1 - p) + (len(t) - left) * q * (1 - q)
            impurity[(v[1:] == v[:-1]) | (left < self.leaf) | (len(t) - left < self.leaf)] = np.inf
            k = int(impurity.argmin())
            if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0]):
                best = (impurity[k], int(f), (v[k] + v[k + 1]) / 2)
        if best is None:
            return at
        _, f, cut = best
        low = x[:, f] <= cut
        a = self._grow(x[low], y[low], depth + 1, nodes, rng)
        b = self._grow(x[~low], y[~low], depth + 1, nodes, rng)
        nodes[at] = (f, cut, a, b, nodes[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, a, b, p in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, a[at], b[at]), at)
            total += p[at]
        return total / max(1, len(self.trees))


def train(findings: list[Finding] | None = None, dictionary: frozenset[str] = frozenset(DICTIONARY)) -> Forest:
    """A forest of labelled findings: (value, name, words before, words after, label)."""
    findings = labelled_findings() if findings is None else findings
    x = np.array([candidate_features(*f[:4], dictionary) for f in findings])
    return Forest(dictionary=dictionary).fit(x, np.array([f[4] for f in findings], np.float64))


def scan_all(texts: list[str | None], forest: Forest, cut: float = 0.5) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """(number of candidates, findings as (start, length, score)) of each text, in order; those that overlap are one.
    The candidates of all texts are judged together."""
    found = [list(candidates(t or "")) for t in texts]
    x = [candidate_features(t[s:e], name, before, t[e : e + BESIDE].lower(), forest.dictionary) for t, c in zip(texts, found) for s, e, name, before in c]
    p = iter(forest.predict(np.array(x)).tolist() if x else ())
    all_out = []
    for c in found:
        out: list[tuple[int, int, float]] = []
        for s, e, q in sorted((s, e, q) for (s, e, _, _), q in zip(c, p) if q >= cut):
            if out and s < sum(out[-1][:2]):
                a, k, r = out[-1]
                out[-1] = (a, max(k, e - a), max(r, q))
            else:
                out.append((s, e - s, q))
        all_out.append((len(c), out))
    return all_out


def scan(text: str | None, forest: Forest, cut: float = 0.5) -> tuple[int, list[tuple[int, int, float]]]:
    return scan_all([text], forest, cut)[0]


def redact(text: str | None, findings: list[tuple[int, int, float]]) -> str | None:
    if not findings:
        return text
    out, at = [], 0
    for s, n, _ in findings:
        out += [text[at:s], MARK]
        at = s + n
    return "".join([*out, text[at:]])


FINDINGS = "array<struct<start:bigint,length:bigint,score:double,sha256:string>>"


def scans(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, cut: float = 0.5, with_text: bool = False) -> DataFrame:
    """One row a document: id, n_candidates, n_findings, findings (place, score and digest, never the secret),
    and with ``with_text`` the text with each finding replaced by a mark. No shuffle.

    Null and empty texts have no findings (a null text stays null). Null ids and repeated rows stay. Places
    count characters from 0. Result names that kept columns have get a _ before them.
    """
    cols = [id_col, *(c for c in keep or [] if c != id_col)]
    src = small_batches(docs).select(docs[text_col].cast("string").alias("_text"), *[docs[c] for c in cols])
    names = free_names(["n_candidates", "n_findings", "findings", *["redacted"] * with_text], cols)
    kinds = ["bigint", "bigint", FINDINGS, "string"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]), *(f"{n} {k}" for n, k in zip(names, kinds))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("sha256", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("secrets")
        for batch in batches:
            for part in _slices(batch):
                n, rows, texts = [], [], []
                whole = list(_texts(part.column(0)))
                for t, (count, found) in zip(whole, scan_all(whole, forest, cut)):
                    n.append(count)
                    rows.append([{"start": s, "length": k, "score": q, "sha256": hashlib.sha256(t[s : s + k].encode("utf-8", "surrogatepass")).hexdigest()} for s, k, q in found])
                    if with_text:
                        texts.append(redact(t, found))
                made = [pa.array(n, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, kind), *([pa.array(texts, pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*cols, *names])

    return src.mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, forest: Forest, cut: float = 0.5) -> DataFrame:
    """The documents with their findings replaced and n_chars counted anew where the text changed."""
    order = docs.columns
    out = scans(docs, forest, keep=[c for c in order if c != "text"], cut=cut, with_text=True)
    _, n_findings, _, redacted = out.columns[-4:]
    out = out.withColumnRenamed(redacted, "text")
    if "n_chars" in order:
        out = out.withColumn("n_chars", F.when(F.col(n_findings) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*order)
