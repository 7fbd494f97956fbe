"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole segments of at most MOST_TOKENS tokens and MOST_CHARACTERS characters as each type: their shape at
several grains, digit counts, checksums, the words before them, what touches their edges, and which label follows which. Its
weights maximise the penalised likelihood of labelled sentences (forward and backward recursions over all segmentations);
a dynamic program then chooses boundaries and types together. The tables label no spans, so a seeded generator makes the
sentences up: entities in many forms, with and without words that announce them, among dates, versions, amounts, failing
checksums and other look-alikes.

Segments lie within a line, hold no white space but single spaces, no lone word but in spelled-out addresses and upper-case
groups of four letters, and at least four digits, a sign or word for "at", or five colons or hyphens (pairs of a
hardware address); everything else is outside. What no segment covers parts a line, so lines are decoded near such signs alone.

Base spans stay whatever the field says; it adds segments that overlap none of them. Spans count code points, end
exclusive. Base matches of a kind are leftmost and don't overlap; one that fails its check is dropped without another try.
Of equal scores the label that comes first wins (outside before the types), then the shorter segment. A null or empty text
has no spans; equal rows each get theirs; an empty table gives an empty result; other columns are ignored. Very long texts
are read whole, in time in proportion to their length; memory is bounded by the longest line.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

BASE = ("email", "ip", "card", "phone")
TYPES = (*BASE, "iban", "national_id", "mac")
MOST_TOKENS, MOST_CHARACTERS = 24, 80  # of a segment

EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, place of the kind in TYPES, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """An address starts at the first character of the run that precedes its '@', or where the last address ended."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LEFT:
            start -= 1
        done = max(done, at + 1) if start == at else done
        if start < at and (m := EMAIL_RIGHT.match(text, at)):
            yield start, 0, m.end()
            done = m.end()
        elif start < at:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- segments --------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: Near what segments can be: each holds one of these.
TRIGGER = re.compile(r"[0-9@]|\b(?:at|dot)\b(?=\s?[)\]}>])|\bdot\b|(?<![^\W_])[a-f]{2}[:-][a-f]{2}[:-]", re.I)
AROUND = 100  # characters on either side of a trigger that are looked at
CUES = {
    "email": set("email mail contact write correo courriel".split()),
    "ip": set("ip host address server adresse".split()),
    "card": set("card visa mastercard payment credit tarjeta karte carte".split()),
    "phone": set("phone call tel telephone mobile cell fax sms whatsapp dial ring telefon teléfono téléphone".split()),
    "iban": set("iban account bank konto cuenta compte".split()),
    "national_id": set("ssn social security id identity".split()),
    "mac": set("mac device interface hardware ethernet".split()),
}
SPELLED = ("at", "dot")
HEX_PAIRS = re.compile(r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}")
IBAN_FORM = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
AREA = re.compile(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}")
NAME = re.compile(r"[^\W_]+(?:[._%+-][^\W_]+)*")
AT = re.compile(r"\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s", re.I)
DOT = re.compile(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", re.I)


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def described(segment: str) -> list[str]:
    """Features of a segment by itself."""
    digits = NOT_DIGIT.sub("", segment)
    tokens = TOKEN.findall(segment)
    exact = "".join(f"9{min(len(t), 7)}" if t[0] in "0123456789" else ("A" if t.isupper() else "a") if t[0].isalpha() else t for t in tokens)
    plain = DOT.sub(".", AT.sub("@", segment))
    spelled = plain != segment
    # Where letters and digits mix freely their order says nothing.
    mixed = "iban" if IBAN_FORM.fullmatch(segment) else "pairs" if HEX_PAIRS.fullmatch(segment) else ""
    exact = mixed or exact
    coarse = mixed or (NAME.sub("w", plain) if "@" in plain else re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", segment)))
    out = ["any", f"exact {exact}", f"coarse {coarse[:30]}", f"digits {min(len(digits), 20)}", "marks " + "".join(sorted({c for c in segment if not c.isalnum()}))]
    if coarse == "w@w":
        out.append("address " + ("domain" if re.search(r"@.*[.][^\W\d_]{2,}$", plain) else "none") + (" spelled" if spelled else ""))
    if 13 <= len(digits) <= 19 and not segment.strip("0123456789 -"):
        out.append(f"luhn {luhn(digits)}")
    if mixed == "iban":
        out.append(f"iban {iban_holds(segment)}")
    if DOTTED.fullmatch(segment):
        out.append(f"octets {all(int(x) < 256 for x in segment.split('.'))}")
    if AREA.fullmatch(segment):
        out.append(f"area {segment[:3] not in ('000', '666') and segment[0] != '9' and segment[4:6] != '00'}")
    if mixed == "pairs":
        out.append(f"pairs {len({segment[i] for i in range(2, 17, 3)}) == 1}")
    if len(digits) == len(segment):
        out.append("bare")
    if segment[0] in "+(0" and len(digits) >= 8:
        out.append(f"starts {segment[0]} {8 <= len(digits) <= 15}")
    return out


def left_features(tokens: list[str], i: int) -> list[str]:
    """Features of what is before a segment that starts at token i."""
    words: list[str] = []
    k = i - 1
    while k >= 0 and len(words) < 4 and i - k < 14:
        if tokens[k][0].isalpha():
            words.append(tokens[k].lower())
        k -= 1
    out = [f"cue {kind} {'near' if any(w in cues for w in words[:2]) else 'far'}" for kind, cues in CUES.items() if not cues.isdisjoint(words)]
    if i and tokens[i - 1] in "([{<#$\u20ac\u00a3/=:\"'":
        out.append(f"after {tokens[i - 1]}")
    if i >= 2 and tokens[i - 1] in ".-:/,+ " and tokens[i - 2][-1].isalnum():
        out.append(f"follows {tokens[i - 1]} {'number' if tokens[i - 2][-1].isdigit() else 'word'}")
    return out


def right_features(tokens: list[str], j: int) -> list[str]:
    """Features of what is after a segment that ends before token j."""
    out = []
    if j < len(tokens) and tokens[j] in "%$\u20ac\u00a3/)":
        out.append(f"before {tokens[j]}")
    if j + 1 < len(tokens) and tokens[j] in ".-:/, " and tokens[j + 1][0].isalnum():
        out.append(f"goes on {tokens[j]} {'number' if tokens[j + 1][0].isdigit() else 'word'}")
    if DOT.match("".join(tokens[j : j + 5])):
        out.append("goes on dot")
    return out


def candidates(tokens: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, text) of the segments that the field scores, by end and then start."""
    out, n = [], len(tokens)
    for i, t in enumerate(tokens):
        if not (t[0].isalnum() or t in "+(") or i and (tokens[i - 1][-1].isalnum() or tokens[i - 1] in "_@"):
            continue
        segment, digits, at, pairs = "", 0, False, 0
        for j in range(i, min(n, i + MOST_TOKENS)):
            t = tokens[j]
            if t[0].isspace() and t != " " or len(segment) + len(t) > MOST_CHARACTERS:
                break
            if t[0].isalpha():
                if j > i and tokens[j - 1] == " " and (j + 1 == n or tokens[j + 1][0].isspace()):
                    before = tokens[j - 2].lower()
                    if not (t.lower() in SPELLED or before in SPELLED or before in "@.)]}>" or t.isupper() and len(t) <= 4):
                        break
                at = at or j > i and t.lower() == "at"
            elif t[0] in "0123456789":
                digits += len(t)
            elif t == "@":
                at = True
            elif t in ":-":
                pairs += 1
            segment += t
            if (digits >= 4 or at or pairs >= 5) and t[-1].isalnum() and (j + 1 == n or not (tokens[j + 1][0].isalnum() or tokens[j + 1] in "_@")):
                out.append((i, j + 1, segment))
    return sorted(out, key=lambda x: (x[1], x[0]))


def regions(text: str) -> Iterator[tuple[int, list[str]]]:
    """(start, tokens) of the stretches of a line near triggers: AROUND characters to either side, from the start of a word, joined where they meet."""
    spans: list[tuple[int, int]] = []
    a = b = 0  # of the current line
    for m in TRIGGER.finditer(text):
        at = m.start()
        if at >= b:
            yield from ((x, TOKEN.findall(text, x, y)) for x, y in spans)
            spans = []
            a = text.rfind("\n", 0, at) + 1
            b = text.find("\n", at)
            b = len(text) if b < 0 else b
        x, y = max(a, at - AROUND), min(b, m.end() + AROUND)
        while x > a and not text[x - 1].isspace() and at - x < 4 * AROUND:
            x -= 1
        while y < b and not text[y].isspace() and y - at < 4 * AROUND:
            y += 1
        if spans and x <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(y, spans[-1][1])
        else:
            spans.append((x, y))
    yield from ((x, TOKEN.findall(text, x, y)) for x, y in spans)


# --- the field -------------------------------------------------------------------------------------------------------


class Field:
    """Weights by feature and type, and scores of one label after another (outside is label 0, type k label k + 1)."""

    def __init__(self, weights: dict[str, np.ndarray], follow: np.ndarray):
        self.weights, self.follow = weights, follow.tolist()
        self.zero = np.zeros(len(TYPES))
        self.seen: dict[str, np.ndarray] = {}

    def added(self, features: Iterable[str]) -> np.ndarray:
        out = self.zero
        for f in features:
            if (w := self.weights.get(f)) is not None:
                out = out + w
        return out

    def alone(self, segment: str) -> np.ndarray:
        """Scores of a segment as each type by its own features; segments are short, so a count bounds what is kept."""
        if (s := self.seen.get(segment)) is None:
            if len(self.seen) >= 50_000:
                self.seen.clear()
            s = self.seen[segment] = self.added(described(segment))
        return s

    def scores(self, tokens: list[str]) -> list[tuple[int, int, list[float]]]:
        """(start, end, score as each type) of all candidates."""
        left: dict[int, np.ndarray] = {}
        right: dict[int, np.ndarray] = {}
        out = []
        for i, j, segment in candidates(tokens):
            if i not in left:
                left[i] = self.added(left_features(tokens, i))
            if j not in right:
                right[j] = self.added(right_features(tokens, j))
            out.append((i, j, (self.alone(segment) + left[i] + right[j]).tolist()))
        return out

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best sequence of segments, the rest outside: (start, end, type) in tokens."""
        by_end: dict[int, list] = defaultdict(list)
        for i, j, s in self.scores(tokens):
            by_end[j].append((i, s))
        if not by_end:
            return []
        follow = self.follow
        #: By position the last labels that are possible there: score, start of the last segment, label before it.
        best: list[dict[int, tuple[float, int, int]]] = [{0: (0.0, 0, 0)}]

        def into(at: int, label: int) -> tuple[float, int]:
            return max((s + follow[before][label], -before) for before, (s, _, _) in best[at].items())

        for j in range(1, len(tokens) + 1):
            s, before = into(j - 1, 0)
            here = {0: (s, j - 1, -before)}
            for i, scores in by_end.get(j, ()):
                for k, x in enumerate(scores):
                    s, before = into(i, k + 1)
                    if k + 1 not in here or s + x >= here[k + 1][0]:
                        here[k + 1] = s + x, i, -before
            best.append(here)
        out, j = [], len(tokens)
        label = max(best[j], key=lambda y: (best[j][y][0], -y))
        while j:
            _, i, before = best[j][label]
            if label:
                out.append((i, j, label - 1))
            j, label = i, before
        return out[::-1]


@dataclass
class Lattice:
    """Labelled sentences as arrays: their lengths, the longest first, candidates (sentence, start, end, true type or -1) by end, and the places of features."""

    lengths: np.ndarray
    segments: np.ndarray
    names: list[str]
    of_segment: np.ndarray  # by use of a feature: its segment, then its place in names
    of_feature: np.ndarray
    followed: np.ndarray  # how often one label follows another in the truth


def lattice(sentences: list[tuple[str, list[tuple[int, int, str]]]], least: int = 3) -> Lattice:
    """Sentences are texts with (start, end, type) in characters; features of fewer than least segments are left out. A true span that is no candidate is an error."""
    place: dict[str, int] = {}
    lengths, segments, uses = [], [], []
    followed = np.zeros((len(TYPES) + 1, len(TYPES) + 1))
    split = sorted(((TOKEN.findall(text), text, spans_) for text, spans_ in sentences), key=lambda x: -len(x[0]))
    for n, (tokens, text, spans_) in enumerate(split):
        starts = [0]
        for t in tokens:
            starts.append(starts[-1] + len(t))
        truth = {(a, b): TYPES.index(k) for a, b, k in spans_}
        lengths.append(len(tokens))
        gold = {}
        for i, j, segment in candidates(tokens):
            k = truth.get((starts[i], starts[j]), -1)
            if k >= 0:
                gold[i] = j, k
            features = [*described(segment), *left_features(tokens, i), *right_features(tokens, j)]
            uses.append([place.setdefault(f, len(place)) for f in features])
            segments.append((n, i, j, k))
        if len(gold) != len(truth):
            raise ValueError(f"a span of {text!r} is no candidate")
        at = before = 0
        while at < len(tokens):
            at, label = (gold[at][0], gold[at][1] + 1) if at in gold else (at + 1, 0)
            followed[before, label] += 1
            before = label
    order = sorted(range(len(segments)), key=lambda x: segments[x][2])
    held = np.array([segments[x] for x in order], dtype=np.int64)
    flat = [uses[x] for x in order]
    of_segment, of_feature = np.repeat(np.arange(len(flat)), [len(u) for u in flat]), np.concatenate([np.array(u) for u in flat])
    # What few segments have tells little of others. The first feature is one that all have.
    common = np.bincount(of_feature) >= least
    kept = common[of_feature]
    names = [f for f, c in zip(place, common, strict=True) if c]
    return Lattice(np.array(lengths), held, names, of_segment[kept], (np.cumsum(common) - 1)[of_feature[kept]], followed)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(data: Lattice, weights: np.ndarray, follow: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, its gradients by weights and follow, log normalisers by sentence), by forward and backward recursions over all sentences at once."""
    count, longest, labels = len(data.lengths), int(data.lengths.max()), len(TYPES) + 1
    n, i, j, k = data.segments.T
    score = np.add.reduceat(weights[data.of_feature], np.flatnonzero(np.r_[True, np.diff(data.of_segment) > 0]))
    ahead = np.full((count, longest + 1, labels), -np.inf)  # by the last label
    into = np.full((count, longest + 1, labels), -np.inf)  # by the label that starts here
    ahead[:, 0, 0] = 0.0
    ends = np.searchsorted(j, np.arange(longest + 2))
    alive = (data.lengths[:, None] > np.arange(longest)).sum(0)  # sentences that go on at a position
    for t in range(longest):
        m = slice(alive[t])
        into[m, t] = log_sum(ahead[m, t, :, None] + follow, 1)
        ahead[m, t + 1, 0] = into[m, t, 0]
        here = slice(ends[t + 1], ends[t + 2])
        np.logaddexp.at(ahead[:, t + 1, 1:], n[here], into[n[here], i[here], 1:] + score[here])
    every = np.arange(count)
    total = log_sum(ahead[every, data.lengths], 1)
    behind = np.full((count, longest + 1, labels), -np.inf)
    start = np.full((count, longest + 1, labels), -np.inf)
    behind[every, data.lengths] = 0.0
    by_start = np.argsort(i, kind="stable")
    starts = np.searchsorted(i[by_start], np.arange(longest + 2))
    moves = np.zeros((labels, labels))
    for t in range(longest - 1, -1, -1):
        m = slice(alive[t])
        start[m, t, 0] = behind[m, t + 1, 0]
        here = by_start[starts[t] : starts[t + 1]]
        np.logaddexp.at(start[:, t, 1:], n[here], score[here] + behind[n[here], j[here], 1:])
        step = follow + start[m, t, None, :]
        behind[m, t] = log_sum(step, 2)
        moves += np.exp(ahead[m, t, :, None] + step - total[m, None, None]).sum(0)
    chance = np.exp(into[n, i, 1:] + score + behind[n, j, 1:] - total[n, None])
    true = k >= 0
    value = score[np.flatnonzero(true), k[true]].sum() + (data.followed * follow).sum() - total.sum()
    residue = -chance
    residue[np.flatnonzero(true), k[true]] += 1
    by_feature = np.argsort(data.of_feature, kind="stable")
    gradient = np.add.reduceat(residue[data.of_segment[by_feature]], np.searchsorted(data.of_feature[by_feature], np.arange(len(data.names))))
    return float(value), gradient, data.followed - moves, total


def fitted(data: Lattice, rounds: int = 50, penalty: float = 0.2, rate: float = 0.2) -> Field:
    """The field that maximises the likelihood less penalty / 2 times the weights' squares, by steps of bounded size along averaged gradients."""
    weights, follow = np.zeros((len(data.names), len(TYPES))), np.zeros((len(TYPES) + 1, len(TYPES) + 1))
    state = [[x, np.zeros_like(x), np.zeros_like(x)] for x in (weights, follow)]
    for step in range(1, rounds + 1):
        _, *gradients, _ = likelihood(data, weights, follow)
        for s, g in zip(state, gradients, strict=True):
            g = g - penalty * s[0]
            s[1], s[2] = 0.9 * s[1] + 0.1 * g, 0.99 * s[2] + 0.01 * g * g
            pace = rate if step < 0.7 * rounds else rate / 4
            s[0] = s[0] + pace * (s[1] / (1 - 0.9**step)) / (np.sqrt(s[2] / (1 - 0.99**step)) + 1e-8)
        weights, follow = state[0][0], state[1][0]
    return Field({f: w for f, w in zip(data.names, weights, strict=True) if np.abs(w).max() > 1e-3}, follow)


# --- sentences to learn from -----------------------------------------------------------------------------------------


class Maker:
    """Makes sentences up, with the spans of their entities."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, least: int = 1) -> str:
        return "".join(self.r.choice("abcdefghijklmnoprstuvwyéñü") for _ in range(self.r.randint(least, 9)))

    def email(self) -> str:
        r, w = self.r, lambda: "".join(self.r.choice("abcdefghiklmnorstu") for _ in range(self.r.randint(1, 8)))
        name = w() + r.choice(["", "." + w(), "_" + w(), self.d(2), "." + self.d(2)])
        host, end = w() + r.choice(["", "-" + w()]), r.choice(["com", "org", "net", "de", "co.uk", "example.net"])
        if r.random() < 0.45:
            return f"{name}@{host}.{end}"
        at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", "."), ("(at)", "."), (" @ ", " . "), (" AT ", " DOT ")])
        return name.replace("_", "") + at + host + dot + end.replace(".", dot)

    def card(self) -> str:
        body = self.r.choice("3456") + self.d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return self.r.choice([" ", "-", ""]).join(body[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> tuple[str, bool]:
        """(number, whether only a word before it tells that it is one)."""
        d, r = self.d, self.r
        clear = [f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(6)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(11)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}"]
        told = [f"0{d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(10)}", f"{d(10)}", f"0{d(3)}/{d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(6)}", f"{d(3)} {d(2)} {d(2)} {d(2)}"]
        return (r.choice(told), True) if r.random() < 0.5 else (r.choice(clear), False)

    def iban(self, right: bool = True) -> str:
        country, size = self.r.choice([("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14), ("IT", 23)])
        bank = self.d(size)
        if self.r.random() < 0.4:
            at, n = self.r.choice([(0, 4), (0, 4), (self.r.randrange(size - 4), self.r.randint(1, 4))])
            bank = bank[:at] + "".join(self.r.choice("ABCDEFGHKLMNPRSTUVWX") for _ in range(n)) + bank[at + n :]
        digits = "".join(str(int(c, 36)) for c in bank + country + "00")
        check = 98 - int(digits) % 97
        s = f"{country}{check if right else (check + 7) % 97:02d}{bank}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.r.random() < 0.5 else s

    def national_id(self) -> str:
        return f"{self.r.choice([self.r.randint(1, 665), self.r.randint(667, 899)]):03d}-{self.r.randint(1, 99):02d}-{self.d(4)}"

    def mac(self) -> str:
        s = self.r.choice(":-").join(f"{self.r.randint(0, 255):02x}" for _ in range(6))
        return s.upper() if self.r.random() < 0.4 else s

    def ip(self) -> str:
        return ".".join(str(self.r.randint(0, 255)) for _ in range(4))

    def other(self) -> str:
        """Something that looks like an entity and is none."""
        d, r = self.d, self.r
        bad = d(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return r.choice(
            [
                f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.0{r.randint(1, 9)}.20{d(2)}", f"{r.randint(1, 12)}/{r.randint(10, 28)}/19{d(2)}", f"20{d(2)}0{r.randint(1, 9)}{r.randint(10, 28)}",
                f"{r.randint(300, 999)}.{d(3)}.{d(3)}.{d(3)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}", d(r.randint(1, 9)), d(r.randint(9, 13)), d(r.randint(17, 26)), bad,
                " ".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{d(3)}-{d(2)}-{d(4)}-{d(3)}", f"000-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"ZZ{d(2)} {d(4)} {d(4)}", self.iban(False), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
                f"{d(2)}.{d(4)}, -{d(1)}.{d(4)}", f"{d(1)},{d(3)},{d(3)}", f"{d(4)}-{d(4)}", f"{d(4)} {d(4)}", f"{d(2)} {d(3)} {d(3)}", f"@{self.word(3)}", f"{self.word()} @ {d(2)}", f"{self.word()}@{self.word()}", f"({d(4)})", f"pp. {d(3)}-{d(3)}", f"{d(4)}/{d(2)}",
                "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40]))), f"meet at {self.word(3)}", f"at {self.word(3)} dot", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"0{d(4)} {d(6)}", f"{d(3)} {d(3)} {d(4)}", f"{d(1)}e{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"#{d(6)}", f"${d(4)}.{d(2)}", f"{d(5)}-{d(4)}",
            ]
        )

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, spans_ = self.r, "", []
        cued = {k: sorted(v) for k, v in CUES.items()}
        for _ in range(r.randint(1, 4)):
            out += "".join(self.word() + r.choice([" ", " ", " ", ", "]) for _ in range(r.randint(0, 5)))
            if r.random() < 0.55:
                kind = r.choice(TYPES)
                entity, told = self.phone() if kind == "phone" else (getattr(self, kind)(), False)
                if told or r.random() < 0.4:
                    cue = r.choice(cued[kind])
                    out += r.choice([str.lower, str.capitalize, str.upper])(cue) + r.choice([" ", ": ", " is ", " no. ", " number ", "=", " number is ", ":"])
                spans_.append((len(out), len(out) + len(entity), kind))
                out += entity
            else:
                if r.random() < 0.12:
                    out += r.choice(cued[r.choice(["card", "iban", "email", "ip"])]) + " "
                out += self.other()
            out += r.choice([" ", " ", " ", ". ", ", ", ") ", "\" ", "; "])
        return (out + self.word()).rstrip(), spans_


@lru_cache(maxsize=4)
def trained(sentences: int = 600, seed: int = 10) -> Field:
    """The field fitted to sentences that the generator makes up; always the same."""
    maker = Maker(seed)
    return fitted(lattice([maker.sentence() for _ in range(sentences)]))


# --- texts -----------------------------------------------------------------------------------------------------------


def spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind."""
    if not TRIGGER.search(text):
        return [], []
    base = sorted(base_spans(text))
    taken = sorted((a, b) for a, _, b in base)
    added = []
    for at, tokens in regions(text):
        starts = [at]
        for t in tokens:
            starts.append(starts[-1] + len(t))
        added += [(starts[i], k, starts[j]) for i, j, k in field.decode(tokens)]
    i, out, reach = 0, [], 0
    for a, k, b in added:  # both are by start; reach is the last end of the base spans that start before b
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((a, k, b))
    return base, sorted(base + out)


def listed(found: list[Span]) -> str:
    return ",".join(f"{TYPES[k]}:{a}:{b}" for a, k, b in found)


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    field = trained()

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(batch: pa.RecordBatch) -> dict:
            found = [spans(t.as_py() or "", field) for t in batch.column(1)]
            counts = {f"n_{k}": pa.array([sum(s[1] == i for s in b) for b, _ in found], type=pa.int64()) for i, k in enumerate(BASE)}
            digests = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
            return {"doc_id": batch.column(0), **counts, "base_sha256": digests, "spans": [listed(a) for _, a in found]}

        return f

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
