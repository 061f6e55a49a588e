"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The patterns are the base. The field tags the tokens around every place that
could hold a secret as begin, inside or outside, from the token's shape, the words
and marks next to it and features of the whole file, and Viterbi's algorithm gives
the best tags. Such a place is a token of MIN_TOKEN characters with a digit, one of
LONG_TOKEN characters, or one that follows a colon, an equals sign or a word like
"key"; a chain falls apart between these places, as everything far from them is
outside.

It is trained here. The base's matches are its labels: of the documents of
MAX_CHARS characters at most, SAMPLE_DOCS with a base match and SAMPLE_DOCS with
digits but without a match, by a hash of the text, of which SAMPLE_CHAINS chains
each are learnt. A chain is learnt as it is, and with its neighbours hidden, so that
shape counts by itself. As the base knows few forms, MADE more chains come from each
place of a secret: in the words that stand there, with a secret of another alphabet,
length and build after another naming word, or with something else in its place that
looks like one (a date, a number, an address, a commit, an image, a colour, a word)
after a word of its own, as often. Documents without a match
may hold secrets that the base misses; so a first field, which has not seen them,
leaves out those of their chains in which it finds one. Spans of the field that
touch a base span are dropped.

Defined results: a null text counts as empty and has no spans; a field that saw
no base match adds none; a text of any length is scanned whole, in time linear in
it; of tag sequences that tie the one of lower tags counts; repeated rows give
repeated rows and an empty table none; only the id and the text are read, whatever
other columns are named.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import in_parts

#: The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")

#: The base in one expression, to tell documents with a match apart.
ANY_BASE = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"
    r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
)
SAMPLE_DOCS, MAX_CHARS, SAMPLE_CHAINS = 600, 20_000, 4000
#: Chains made for a place of a secret, more of them in a sample of fewer texts; tokens of a chain learnt together.
MADE, CHAIN = 4, 12
MIN_TOKEN, LONG_TOKEN = 6, 20
BEFORE, AFTER = 6, 3
EPOCHS, RATE, RIDGE = 70, 0.1, 1e-3
OUT, BEGIN, INSIDE = 0, 1, 2
#: Added after training to every token's weight for beginning a secret: one that is missed is worse than a false alarm.
LEAN = 1.4
#: Alphabets, naming words and what stands between word and secret, for made chains.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    _DIGITS + "ABCDEF",
    _DIGITS + _LOWER,
    _DIGITS + _LOWER + _LOWER.upper(),
    _DIGITS + _LOWER + _LOWER.upper() + "+/",
    _DIGITS + _LOWER + _LOWER.upper() + "_-",
    _DIGITS + _LOWER.upper(),
)
NAMES = (
    "credentials", "passphrase", "client_secret", "access_token", "auth_key", "signature", "session_key", "login_pass",
    "Authorization: Token", "x-auth-key", "refresh_token", "signing key", "service_secret",
)
BETWEEN = (" = ", ": ", "=", " ", ' = "', ': "', " => '", "='", " is ")

# tried at the start of a token only, and never twice at one character
_PLACE = re.compile(
    r"(?<![A-Za-z0-9+/_.@-])(?:[A-Za-z+/_.@-]*+[0-9][A-Za-z0-9+/_.@-]*+|[A-Za-z+/_.@-]{20,}+)|(?<=[:=])\s?[\"']?[A-Za-z0-9+/_.@-]++"
)
_NAMED = re.compile(
    r"(?i)(?:pass|pwd|secret|token|key|auth|cred|bearer|basic|signature)[a-z_-]{0,16}[\"']?([\s:=>\"']{1,6})([A-Za-z0-9+/_.@-]{6,})"
)
_TOKEN = re.compile(r"[A-Za-z0-9+/_.@-]+|[^\sA-Za-z0-9+/_.@-]")
_KEYWORD = re.compile(r"(?i)pass|pwd|secret|token|key|auth|cred|bearer|private|signature")

_CONSONANTS = re.compile(r"(?i)[bcdfghjklmnpqrstvwxz]+")
_VOWELS = re.compile(r"(?i)[aeiouy]")
_CASES = re.compile(r"(?<=[a-z])[A-Z]")

Span = tuple[int, int, int]  # start, place in KINDS, end
Chain = tuple[list[list[str]], list[bool], list[int]]  # feature names, whether a token may be a secret, tags


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Of the base's matches, what is the secret itself: the training labels."""
    parts = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return parts + [(s, e) for s, kind, e in base_spans(text) if kind]


def _places(text: str) -> list[tuple[int, int]]:
    """Where a secret may stand, by start. A plain word that follows a naming word without a mark is no such place."""
    found = {m.span(2) for m in _NAMED.finditer(text) if m[1].strip() or not (m[2].isalpha() and m[2][1:].islower())}
    for m in _PLACE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in " \t\n\r\"'":
            start += 1
        if end - start >= MIN_TOKEN:
            found.add((start, end))
    return sorted(found)


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets around the places that may be secrets; stretches that meet are one."""
    out: list[list[tuple[int, int]]] = []
    reach = -1
    for start, end in _places(text):
        low = max(start - 80, 0)
        before = [t.span() for t in _TOKEN.finditer(text, low, start)]
        if low and before and not text[low - 1].isspace():
            before = before[1:]  # the cut may have split it
        after = [t.span() for t in _TOKEN.finditer(text, start, min(end + 60, len(text)))][: AFTER + 1]
        after[-1] = _TOKEN.match(text, after[-1][0]).span()  # whole, beyond the 60 characters too
        tokens = [*before[-BEFORE:], *after]
        if tokens[0][0] < reach:
            out[-1] += [t for t in tokens if t[0] >= reach]
        else:
            out.append(tokens)
        reach = max(reach, tokens[-1][1])
    return out


def _shape(token: str) -> list[str]:
    if not token[0].isalnum() and len(token) == 1:
        return ["mark " + token]
    n = len(token)
    digits, lower = sum(c.isdigit() for c in token), sum(c.islower() for c in token)
    upper = sum(c.isupper() for c in token)
    kinds = "0" * (digits > 0) + "a" * (lower > 0) + "A" * (upper > 0) + "." * (digits + lower + upper < n)
    turns = sum(a.isalpha() != b.isalpha() for a, b in zip(token, token[1:], strict=False))
    names = [
        "kinds " + kinds,
        f"length {min(n // 4, 12)}",
        f"kinds {kinds} length {min(n // 8, 6)}",
        f"turns {min(8 * turns // n, 7)}",
        f"digits {min(8 * digits // n, 7)}",
        f"distinct {min(8 * len(set(token)) // n, 8)}",
        f"hex {min(n // 8, 5)}" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token) else f"no hex {min(n // 12, 5)}",
        "mail" if "@" in token else "no mail",
        f"dots {min(token.count('.'), 3)}",
        f"dashes {min(token.count('-'), 4)}",
        f"slashes {min(token.count('/'), 3)}",
        f"hundreds {min(n // 100, 5)}",
        f"letters in a row that no word has {min(max(map(len, _CONSONANTS.findall(token)), default=0) // 2, 4)}",
        f"vowels {8 * len(_VOWELS.findall(token)) // max(lower + upper, 1)} of {'few' if lower + upper < 8 else 'many'}",
        f"changes of case {min(8 * len(_CASES.findall(token)) // n, 5)}",
    ]
    if digits and n - digits and n >= 12:
        names.append("long mixture")
    return names


def _word(token: str) -> str:
    """A neighbour as a feature: marks and short words themselves, other tokens by what they are made of."""
    if len(token) == 1:
        return token
    if len(token) <= 24 and token.replace("_", "").replace("-", "").isalpha():
        return token.lower()
    return "number" if token.isdigit() else "mixture"


def features(text: str, tokens: list[tuple[int, int]], hide: bool = False) -> list[list[str]]:
    """The feature names of each token. hide: without neighbours."""
    strings = [text[a:b] for a, b in tokens]
    keyed = [bool(_KEYWORD.search(s)) and len(s) < 24 for s in strings]
    near = ["", "", *map(_word, strings), ""]
    file = [
        "file " + "".join("y" if mark in text else "n" for mark in ("=", "{", ";", "@")),
        f"file length {min(len(text).bit_length() // 3, 7)}",
    ]
    out = []
    for i, s in enumerate(strings):
        names = ["bias", *_shape(s), *file]
        if not hide:
            close = any(keyed[max(i - 4, 0) : i])
            glued = text[max(tokens[i][0] - 80, 0) : tokens[i][0]].rpartition(" ")[2].rpartition("\n")[2]
            names += [
                "key near" if close else "no key near",
                f"before {near[i + 1]}",
                f"second before {near[i]}",
                f"after {near[i + 3]}",
                f"before {near[i + 1]} after {near[i]}",
                "in an address" if "://" in glued or "www." in glued else "in no address",
                "glued to a mark" if glued[-1:] in _MARKS else "glued to none",
            ]
            if close and len(s) >= MIN_TOKEN:
                names.append("key near a long token" + " with digits" * any(c.isdigit() for c in s))
        out.append(names)
    return out


_MARKS = tuple("#?&,;/")


def possible(text: str, tokens: list[tuple[int, int]]) -> list[bool]:
    """Words of fewer characters are no secrets; marks may go on with one."""
    return [b - a >= MIN_TOKEN or text[a:b] == "=" for a, b in tokens]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of the features by tag, and of the transitions. Inside follows begin or inside."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.index, self.weights, self.moves = index, weights, moves

    @classmethod
    def train(cls, chains: list[Chain], epochs: int = EPOCHS) -> Field | None:
        """None for chains without secrets."""
        if not any(any(tags) for _, _, tags in chains):
            return None
        seen_names = Counter(name for names, _, _ in chains for each in names for name in each)
        index = {"": 0} | {name: k for k, name in enumerate((x for x, c in seen_names.items() if c > 1), 1)}
        n, t = len(chains), max(len(tags) for _, _, tags in chains)
        width = max(len(each) for names, _, _ in chains for each in names)
        x = np.zeros((n, t, width), dtype=np.int64)
        y = np.zeros((n, t), dtype=np.int64)
        barred = np.full((n, t), True)
        real = np.zeros((n, t), dtype=bool)
        for k, (names, may, tags) in enumerate(chains):
            for i, each in enumerate(names):
                x[k, i, : len(each)] = [index.get(name, 0) for name in each]
                y[k, i], barred[k, i], real[k, i] = tags[i], not may[i], True
        gold = np.eye(3)[y] * real[..., None]
        flat = x[real].ravel()
        w, a = np.zeros((len(index), 3)), np.zeros((3, 3))
        seen = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
        for step in range(1, epochs + 1):
            s = np.zeros((n, t, 3))
            s[real] = w[flat].reshape(-1, width, 3).sum(axis=1)
            unary, pair = cls._expected(s, a, barred, real)
            diff = np.repeat((gold - unary)[real], width, axis=0)
            gw = np.stack([np.bincount(flat, diff[:, k], len(index)) for k in range(3)], axis=1)
            gw[0] = 0
            ga = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1)) - pair
            for p, g, m, v in ((w, gw / n - RIDGE * w, seen[0], seen[1]), (a, ga / n - RIDGE * a, seen[2], seen[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[index["bias"], BEGIN] += LEAN
        return cls(index, w, a)

    @staticmethod
    def _allowed(a: np.ndarray) -> np.ndarray:
        a = a.copy()
        a[OUT, INSIDE] = -1e4
        return a

    @classmethod
    def _expected(cls, s, a, barred, real) -> tuple[np.ndarray, np.ndarray]:
        """Expected tags of each token and expected transitions for scores s, by forward and backward sums."""
        s[barred, 1:] = -1e4
        a = cls._allowed(a)
        s[:, 0, INSIDE] = -1e4
        t = s.shape[1]
        f, b = [s[:, 0]], [np.zeros_like(s[:, 0])]
        for i in range(1, t):
            f.append(s[:, i] + _lse(f[-1][:, :, None] + a, 1))
        for i in range(t - 1, 0, -1):
            b.append(_lse(a + (s[:, i] + b[-1])[:, None, :], 2))
        b.reverse()
        z = _lse(f[-1], 1)
        unary = np.exp(np.stack(f, 1) + np.stack(b, 1) - z[:, None, None]) * real[..., None]
        pair = np.zeros((3, 3))
        for i in range(1, t):
            p = np.exp(f[i - 1][:, :, None] + a + (s[:, i] + b[i])[:, None, :] - z[:, None, None])
            pair += (p * real[:, i, None, None]).sum(0)
        return unary, pair

    def decode(self, names: list[list[str]], may: list[bool]) -> list[int]:
        """Viterbi: the best tags."""
        x = [[self.index.get(name, 0) for name in each] for each in names]
        a = self._allowed(self.moves)
        s = np.array([self.weights[each].sum(axis=0) for each in x])
        s[~np.array(may), 1:] = -1e4
        best, back = s[0] + np.array([0, 0, -1e4]), []
        for row in s[1:]:
            total = best[:, None] + a
            back.append(total.argmax(axis=0))
            best = row + total.max(axis=0)
        tags = [int(best.argmax())]
        for came in reversed(back):
            tags.append(int(came[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for tokens in stretches(text):
            tags = self.decode(features(text, tokens), possible(text, tokens))
            for (a, b), tag in zip(tokens, tags, strict=True):
                if tag == BEGIN:
                    out.append((a, b))
                elif tag == INSIDE and out:
                    out[-1] = (out[-1][0], b)
        return out


def _tagged(text: str, tokens: list[tuple[int, int]], parts: list[tuple[int, int]]) -> tuple[list[bool], list[int]]:
    may, tags, of = possible(text, tokens), [], None
    for (a, b), could in zip(tokens, may, strict=True):
        part = next((p for p in parts if a < p[1] and p[0] < b), None) if could else None
        tags.append(OUT if part is None else INSIDE if part == of else BEGIN)
        of = part
    return may, tags


def _drawn(rng: np.random.Generator, alphabet: str, low: int, high: int) -> str:
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(low, high)))


def _secret(rng: np.random.Generator) -> tuple[str, str]:
    """What stands before a secret, and the secret: named ones may be short, others are long."""
    alphabet = ALPHABETS[max(rng.integers(-2, len(ALPHABETS)), 0)]
    letters = _LOWER + _LOWER.upper()
    named = rng.random() < 0.55
    name = NAMES[rng.integers(len(NAMES))] + BETWEEN[rng.integers(len(BETWEEN))] if named else ""
    build = rng.integers(12 if named else 7)
    if build == 0:  # parts with dots
        return name, ".".join(_drawn(rng, ALPHABETS[4], 16, 60) for _ in range(rng.integers(2, 4)))
    if build == 1:  # a maker's prefix
        return name, _drawn(rng, letters, 2, 5) + "_-."[rng.integers(3)] + _drawn(rng, ALPHABETS[2], 20, 44)
    if build == 2:  # a maker's prefix of parts
        return name, "_-"[rng.integers(2)].join([_drawn(rng, _LOWER, 2, 5), _drawn(rng, ALPHABETS[1], 3, 13), _drawn(rng, ALPHABETS[2], 20, 40)])
    if build == 3 and not named:  # in an address
        user = f"{_drawn(rng, _LOWER, 3, 9)}://{_drawn(rng, _LOWER, 3, 9)}:"
        return user, f"{_drawn(rng, ALPHABETS[2], 6, 20)}@{_drawn(rng, _LOWER, 2, 9)}.{_drawn(rng, _LOWER, 3, 9)}.{_drawn(rng, _LOWER, 2, 4)}"
    if build <= 6:
        return name, _drawn(rng, alphabet, 24, (50, 130)[rng.integers(2)]) + "=" * int(rng.integers(3) * ("+" in alphabet))
    if build <= 8:  # a word with digits, as people choose it
        return name, _drawn(rng, _LOWER, 4, 9) + _drawn(rng, _DIGITS, 2, 5) + _drawn(rng, ALPHABETS[2], 0, 5)
    if build == 9:
        return name, _drawn(rng, _LOWER, 8, 14)
    if build == 10:
        return name, _drawn(rng, letters, 8, 40)
    return name, _drawn(rng, ALPHABETS[2], 8, 24)


def _other(rng: np.random.Generator, words: list[str]) -> str:
    """What looks like a secret and is none, after the words that stand before such a thing."""
    n = lambda low, high: str(rng.integers(low, high))
    word = lambda: _drawn(rng, _LOWER, 3, 12)
    draw = lambda alphabet, low, high: _drawn(rng, alphabet, low, high)
    lead = lambda *names: names[rng.integers(len(names))] + (" ", ": ", " is ", " ")[rng.integers(4)]
    hexes, upper = _DIGITS + "abcdef", _DIGITS + _LOWER.upper()
    seen = lambda: words[rng.integers(len(words))] if words else word()
    name = lambda: (NAMES[rng.integers(len(NAMES))], "password", "key", "the key", "secret", "the token")[rng.integers(6)]
    link = lambda: (*BETWEEN, " ", " ", " ", " of ", " for ", " to ", " ")[rng.integers(len(BETWEEN) + 7)]
    return (
        lambda: f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}:{n(10, 60)}:{n(10, 60)}Z",
        lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 90)}-{word()}{n(1, 9)}",
        lambda: f"https://www.{word()}.com/{n(2000, 2030)}/{word()}-{word()}{n(1, 99)}.html",
        lambda: f"https://{word()}.{word()}.org/{word()}?{word()[: rng.integers(1, 9)]}={draw(ALPHABETS[4], 8, 24)}",
        lambda: f"http://www.{word()}.com/{word()}?{word()[: rng.integers(1, 4)]}={draw(ALPHABETS[2], 8, 16)}",
        lambda: f"https://{word()}.com/{word()}/{draw(ALPHABETS[2], 8, 28)}/{word()}",
        lambda: f"{n(900, 999)}-{n(1, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}",
        lambda: f"{word()}.{n(10, 99)}@{word()}{n(0, 9)}.example.com",
        lambda: f"{n(100000, 999999)}-{word()[:1].upper()}{n(1, 9)}",
        lambda: n(10**9, 10**16),
        lambda: ".".join(n(0, 256) for _ in range(4)),
        lambda: f"+{n(1, 99)} ({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}",
        lambda: lead("revision", "changeset", "merge", "fixed in", "see", "commits") + draw(hexes, 7, 20),
        lambda: f"url(data:{word()}/{word()[:4]};base64,{draw(ALPHABETS[3], 60, 600)}",
        lambda: f"src=\"data:{word()}/{word()[:4]};base64,{draw(ALPHABETS[3], 60, 600)}\"",
        lambda: lead("shipment", "consignment", "waybill", "tracking number", "booking", "invoice") + draw(upper, 10, 22),
        lambda: lead("order", "ticket", "case", "reference", "article no.", "part") + f"{draw(_LOWER.upper(), 1, 5)}-{n(100, 99999)}-{draw(upper, 2, 6)}",
        lambda: f"{word()}: #{draw(hexes, 6, 7)};",
        lambda: lead("id", "device", "object", "uuid") + "-".join(draw(hexes, k, k + 1) for k in (8, 4, 4, 4, 12)),
        lambda: f"doi:10.{n(1000, 9999)}/{word()}.{n(2000, 2030)}.{n(100, 99999)}",
        lambda: f"/{word()}/{word()}/{word()}{n(1, 99)}/{word()}_{n(1, 99)}.{word()[:3]}",
        lambda: f"{word()}/{word()}-{word()}-{word()}-{word()}",
        lambda: f"{name()}{link()}{seen()} {seen()}",
        lambda: f"{name()}{link()}{seen()} {seen()}",
        lambda: f"{name()} {seen()} {seen()}",
        lambda: f"{name()} {seen()} {name()} {seen()}",
        lambda: f"{seen()}: {seen()}, {seen()} = {seen()}",
    )[rng.integers(27)]()


def _chain(text: str, tokens: list[tuple[int, int]], parts: list[tuple[int, int]]) -> Iterator[Chain]:
    """One chain with its neighbours and one without them, cut to CHAIN tokens."""
    may, tags = _tagged(text, tokens, parts)
    for hide in (False, True):
        names = features(text, tokens, hide)
        for at in range(0, len(tokens), CHAIN):
            cut = tags[at : at + CHAIN]
            yield names[at : at + CHAIN], may[at : at + CHAIN], [BEGIN if cut[0] else OUT, *cut[1:]]


def chains(text: str, made: int = MADE) -> Iterator[Chain]:
    """What is learnt from a text: its own chains, and the ones made in place of its secrets."""
    parts = secret_parts(text)
    rng = np.random.default_rng(len(text))
    pick = lambda among: among[rng.integers(len(among))]
    for tokens in stretches(text):
        yield from _chain(text, tokens, parts)
        for start, end in [p for p in parts if any(a <= p[0] < b for a, b in tokens)][:1]:
            left = text[max(start - 120, 0) : start].split()[:-3]
            words = [w for w in left if len(w) >= MIN_TOKEN and w.isalpha()]
            for k in range(made):
                lead = " ".join(left) + " "
                if k % 2:
                    value, span = _other(rng, words), []
                else:
                    name, value = _secret(rng)
                    lead += name
                    span = [(len(lead), len(lead) + len(value))]
                whole = lead + value + text[end : end + 60]
                for around in stretches(whole):
                    yield from _chain(whole, around, span)


def fit(docs: DataFrame) -> Field | None:
    """A field trained on the base's matches in a bounded sample of docs (doc_id, text)."""
    short = docs.select("text").where((F.length("text") <= MAX_CHARS) & F.col("text").rlike("[0-9]"))
    found: list[list[Chain]] = []
    for telling in (F.col("text").rlike(ANY_BASE), ~F.col("text").rlike(ANY_BASE)):
        # the hashes first: of the texts, only the chosen ones leave their tasks
        hashed = short.where(telling).withColumn("h", F.xxhash64("text"))
        cut = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
        chosen = hashed.where(F.col("h") <= cut).groupBy("h").agg(F.min("text").alias("text")) if cut is not None else hashed.limit(0)
        texts = [r["text"] for r in sorted(chosen.collect(), key=lambda r: r["h"])]
        made = max(MADE, SAMPLE_CHAINS // (2 * max(len(texts), 1)))
        found.append(list(islice((c for text in texts for c in chains(text, made)), SAMPLE_CHAINS)))
    first = Field.train(found[0], EPOCHS // 2)
    if first is None:
        return None
    return Field.train(found[0] + [c for c in found[1] if not any(first.decode(*c[:2]))], EPOCHS)


def scan(text: str, field: Field | None) -> list[Span]:
    found = base_spans(text)
    if field is not None:
        ends = [e for _, _, e in found]
        top = list(accumulate(ends, max))
        # of the base spans that begin before a span's end, the one that reaches furthest
        before = lambda b: bisect_left(found, (b,))
        added = [(a, 3, b) for a, b in field.spans(text) if not before(b) or top[before(b) - 1] <= a]
        found = sorted([*found, *added])
    return found


def secret_spans(docs: DataFrame, text: Column) -> Column:
    """Array of (kind, start, end) in code points, by start, then as KINDS lists them."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text")))

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = sent.value
        for texts in in_parts(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t or "", field)] for t in texts]
            yield pd.Series(rows, dtype=object)

    return find(text)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans for every row of docs."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.select("doc_id", secret_spans(rows, F.col("text")).alias("spans"))


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    if text is None or not len(spans):
        return text
    out, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by [SECRET] and n_chars to match; columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text")))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = sent.value
        for texts in in_parts(batches):
            found = ([{"start": s, "end": e} for s, _, e in scan(t or "", field)] for t in texts)
            yield pd.Series([redact(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)

    changed = docs.withColumn("text", clean(docs["text"]))
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed
