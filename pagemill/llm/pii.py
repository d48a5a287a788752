"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field then reads the stretches of text that
could hold more: runs of digit groups, and addresses spelled out with "at" and
"dot". A stretch is a row of units; every segment of at most ``SPAN`` units is a
candidate for each type, scored by features of the whole span (digits, grouping,
check digit, range of parts, cue words before it, what it touches). A dynamic
program over units picks boundaries and types together; each span that meets no base
span is added. Weights are trained here, by the field's likelihood on made-up
sentences; documents and labels play no part.

The field reads no spelled-out address whose local part or a label is beyond 64 or 63
characters (what mail allows), and no group of over 19 digits; an entity has 7 digits or
more. Runs of any length are read a unit at a time, so memory follows the spans found.

Defined results: a null text is empty; offsets are code points, ends exclusive;
repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")

# --- base patterns (fixed values) -------------------------------------------------
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match begins with its run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")  # nothing follows, so nothing is given back
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain``: tried at each @, from the start of the run before it."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The pattern's spans of each kind; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not re.search("[0-9]", text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the field --------------------------------------------------------------------
#: Units that one entity can span.
SPAN = 12
LABELS = ("none", *KINDS)
_GROUP = re.compile(r"[0-9]+")
#: What may stand between two groups of a run, and digits of a group.
_BETWEEN, LONGEST = re.compile(r"[ ().+/-]{1,3}").fullmatch, 19
#: Digits of an entity.
FEWEST = 7
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at | @ ?|@ )[A-Za-z0-9-]{1,63}"
    r"(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9])"
)
_CUES = {
    "phone": re.compile(r"(?:phone|tel|telefon|teléfono|téléphone|call|mobile|cell|fax|dial|sms|whatsapp|reach)\W{0,4}(?:\w{1,4}\W{1,3}){0,2}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\W{0,4}(?:\w{1,6}\W{1,3}){0,2}$", re.I),
    "ip": re.compile(r"(?:\bip|host|server|address|addr|gateway|ping)\W{0,4}(?:\w{1,4}\W{1,3}){0,2}$", re.I),
    "email": re.compile(r"(?:mail|contact|write|reach|courriel|correo)\W{0,4}(?:\w{1,4}\W{1,3}){0,2}$", re.I),
    "other": re.compile(r"(?:isbn|order|invoice|version|ref|serial|date|tracking|page|pages|no|nr|id)\W{0,4}(?:\w{1,4}\W{1,3}){0,1}$", re.I),
}


def digit_units(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, first, last) of the digit groups that the field reads, run by run, one at a time.

    A run is groups of at most ``LONGEST`` digits with 1 to 3 marks between; letters
    touch neither its first group's start nor its last one's end. A group's signs
    before it, two at most where it is the first, are its own.
    """
    size, held, end, run = len(text), None, 0, False
    letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z"
    for m in _GROUP.finditer(text):
        a, b = m.span()
        if b - a > LONGEST:
            linked = fits = False
        else:
            linked = held is not None and a - end <= 3 and _BETWEEN(text[end:a]) is not None
            fits = linked or a == 0 or not letter(text[a - 1])
        if held is not None and not linked:
            yield (*held, run, True)
            held, run = None, False
        if not fits:
            continue
        closes = b < size and letter(text[b])
        if closes:  # it cannot end a run, nor can a letter stand inside one
            if held is not None:
                yield (*held, run, True)
                held, run = None, False
            continue
        start, least = a, end if linked else max(end, a - 2)
        while start > least and text[start - 1] in "+(":
            start -= 1
        if linked:
            yield (*held, run, False)
        run, held, end = not linked, (start, b), b
    if held is not None:
        yield (*held, run, True)


def spelled(text: str) -> list[tuple[int, int]]:
    """Addresses that may be spelled out."""
    if "@" in text or " at " in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        return [m.span() for m in _SPELLED.finditer(text)]
    return []


def stretches(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """What the field reads of a short text, whole: (kind of stretch, its units as code-point spans)."""
    out = [("spelled", [x]) for x in spelled(text)]
    for a, b, first, _ in digit_units(text):
        if first:
            out.append(("digits", []))
        out[-1][1].append((a, b))
    return [(way, units) for way, units in out if way == "spelled" or (units[-1][1] - units[0][0] >= FEWEST and sum(b - a for a, b in units) >= FEWEST)]


def features(text: str, way: str, units: list[tuple[int, int]], i: int, j: int, label: str) -> list[str] | None:
    """Names of the whole-span features of units i to j as ``label``; None where the type cannot be."""
    a, b = units[i][0], units[j - 1][1]
    if label == "none":
        return [f"none {way}", f"none length {min(b - a, 9)}"] if j == i + 1 else None
    before = text[max(0, a - 24) : a]
    if (way == "spelled") != (label == "email"):
        return None
    out = [label, *(f"{label} after {k}" for k, cue in _CUES.items() if cue.search(before))]
    span = text[a:b]
    if label == "email":
        bracket = bool(re.search(r"[\[({<]", span))
        dots = len(re.findall(r"\bdot\b|\.", span, re.I))
        out += [f"email bracket {bracket}", f"email dots {min(dots, 3)}", f"email spelled dot {bool(re.search(r'dot', span, re.I))}", f"email last {min(len(re.split(r'[^A-Za-z0-9]+', span)[-1]), 5)}"]
        return out
    digits = _digits(span)
    n = len(digits)
    if not 7 <= n <= 19 or (label == "phone" and n > 15) or (label == "card" and n < 13) or (label == "ip" and n > 12):
        return None
    groups = re.findall("[0-9]+", span)
    marks = "".join(sorted(set(re.sub("[0-9]", "", span)))).replace("(", "p").replace(")", "").replace("+", "")
    out += [f"{label} digits {n}", f"{label} groups {min(len(groups), 6)}", f"{label} marks {marks}"]
    out.append(f"{label} shape {'-'.join(str(len(g)) for g in groups[:6])}")
    out.append(f"{label} plus {span[0] == '+'}")
    out.append(f"{label} whole {i == 0 and j == len(units)}")
    if label == "card":
        out.append(f"card check {luhn(digits)} {n in (13, 15, 16, 19)}")
    if label == "ip":
        out.append(f"ip parts {len(groups) == 4 and all(map(_small, groups))} {set(re.sub('[0-9]', '', span)) == {'.'}}")
    if label == "phone":
        out.append(f"phone year {bool(re.match(r'(?:19|20)[0-9][0-9][-./]', span))}")
        out.append(f"phone parens {span.startswith('(') or span.startswith('+')}")
    return out


def segments(text: str, way: str, units: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
    """All candidates (from unit, to unit, label, features)."""
    out = []
    for i in range(len(units)):
        for j in range(i + 1, min(len(units), i + SPAN) + 1):
            for y, label in enumerate(LABELS):
                if (f := features(text, way, units, i, j, label)) is not None:
                    out.append((i, j, y, f))
    return out


def decode(n: int, scored: list[tuple[int, int, int, float]], moves: np.ndarray) -> list[tuple[int, int, int]]:
    """The best row of segments that covers n units, by score and the moves between labels."""
    best = np.full((n + 1, len(LABELS)), -np.inf)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j, y, s in sorted(scored, key=lambda x: x[1]):
        before = best[i] + moves[:, y]
        k = int(np.argmax(before))
        if before[k] + s > best[j, y]:
            best[j, y] = before[k] + s
            back[j, y] = (i, k)
    out, at, y = [], n, int(np.argmax(best[n]))
    while at:
        i, k = back[at, y]
        out.append((i, at, y))
        at, y = i, k
    return out[::-1]


# --- training ---------------------------------------------------------------------
def _made_up(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence, and the spans in it that are personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = rng.choice

    def card() -> str:
        n = pick((13, 15, 16, 16, 16, 19))
        body = pick("3456") + d(n - 2)
        return next(body + x for x in "0123456789" if luhn(body + x))

    def grouped(x: str, mark: str) -> str:
        return mark.join(x[i : i + 4] for i in range(0, len(x), 4))

    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    host = lambda: f"{word()}{pick((' dot ', ' (dot) ', '[dot]', '.'))}{pick(('com', 'org', 'net', 'de'))}"
    good = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}", ("call ", "phone ", "tel: ", "at ", "", "reach me on ")),
        ("phone", lambda: pick("-. ").join((d(3), d(3), d(4))), ("call ", "phone: ", "tel ", "mobile ", "fax ", "telefon ")),
        ("phone", lambda: f"1 ({d(3)}) {d(3)}-{d(4)}", ("call ", "dial ", "tel. ", "")),
        ("phone", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", ("call ", "", "tel ")),
        ("card", lambda: grouped(card(), pick(("-", " ", "/", "."))), ("card ", "visa ", "paid with ", "", "credit card no ")),
        ("card", card, ("card ", "", "visa: ")),
        ("ip", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), ("host ", "from ", "ip ", "")),
        ("email", lambda: f"{word()}{pick((' at ', ' (at) ', '[at]', ' [at] ', ' @ '))}{word()} dot {pick(('com', 'org', 'net'))}", ("mail ", "contact ", "write to ", "")),
        ("email", lambda: f"{word()}{pick((' (at) ', '[at]', ' [at] ', ' @ '))}{host()}", ("mail ", "contact ", "write to ", "")),
    ]
    bad = [
        lambda: f"20{d(2)}-{d(2)}-{d(2)}",
        lambda: f"{d(2)}/{d(2)}/19{d(2)}",
        lambda: "order " + d(rng.randint(7, 12)),
        lambda: "invoice " + d(4) + "-" + d(6),
        lambda: f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: d(rng.randint(7, 12)),
        lambda: next(x for x in (d(16) for _ in range(99)) if not luhn(x)),
        lambda: "card " + next(x for x in (d(16) for _ in range(99)) if not luhn(x)),
        lambda: ".".join(d(3) for _ in range(3)),
        lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(2)}",
        lambda: f"pages {d(3)}-{d(3)}",
        lambda: f"from 19{d(2)}-20{d(2)}",
        lambda: f"{d(1)} {d(3)} {d(3)} {d(3)}",
        lambda: f"{word()} at {word()}.{word()}",
        lambda: f"{word()} at {word()}.com",
        lambda: f"({d(3)}) {d(4)}",
        lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 8))),
        lambda: f"{d(4)}.{d(4)}.{d(4)}",
    ]
    text, spans = word() + " ", []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.5:
            kind, make, cues = pick(good)
            text += pick(cues)
            x = make()
            spans.append((kind, len(text), len(text) + len(x)))
            text += x
        else:
            text += pick(bad)()
        text += pick((" ", ", ", ". ")) + word() + " " + word() + " "
    return text, spans


class _Sentences:
    """Candidates of all training stretches in flat arrays, so that one step of the dynamic program takes all stretches at once.

    A node is a place between two units; those of a stretch lie in a row.
    """

    def __init__(self, stretches_of: list[tuple[int, list[tuple[int, int, int, list[int], bool]]]]):
        units = np.array([n for n, _ in stretches_of], np.int64)
        self.first = np.cumsum(units + 1) - (units + 1)
        self.last = self.first + units
        rows = [(s, i, j, y, gold) for s, (_, found) in enumerate(stretches_of) for i, j, y, _, gold in found]
        self.s, i, j, self.y, gold = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.begin, self.end, self.gold = self.first[self.s] + i, self.first[self.s] + j, gold.astype(bool)
        features = [f for _, found in stretches_of for _, _, _, f, _ in found]
        self.count = np.array([len(f) for f in features], np.int64)
        self.feature = np.array([x for f in features for x in f], np.int64)
        self.by_end = [np.flatnonzero(j == t) for t in range(1, int(units.max()) + 1)]
        self.by_begin = [np.flatnonzero(i == t) for t in range(int(units.max()) - 1, -1, -1)]
        # the labels that follow one another in the truth
        order = np.flatnonzero(self.gold)
        order = order[np.lexsort((self.end[order], self.s[order]))]
        before = np.r_[0, self.y[order][:-1]]
        before[self.begin[order] == self.first[self.s[order]]] = 0
        self.true_moves = np.zeros((len(LABELS),) * 2)
        np.add.at(self.true_moves, (before, self.y[order]), 1)

    def likelihood(self, w: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the truth, and its slopes by the weights and by the moves."""
        k, y = len(LABELS), self.y
        score = np.add.reduceat(w[self.feature], np.cumsum(self.count) - self.count)
        ahead, behind = (np.full((int(self.last[-1]) + 1, k), -np.inf) for _ in range(2))
        ahead[self.first, 0], behind[self.last] = 0.0, 0.0
        into = moves.T[y]  # a row a candidate: from each label into its own
        for at in self.by_end:
            np.logaddexp.at(ahead, (self.end[at], y[at]), np.logaddexp.reduce(ahead[self.begin[at]] + into[at], axis=1) + score[at])
        for at in self.by_begin:
            np.logaddexp.at(behind, self.begin[at], into[at] + (score[at] + behind[self.end[at], y[at]])[:, None])
        z = np.logaddexp.reduce(ahead[self.last], axis=1)
        p = np.exp(ahead[self.begin] + into + (score + behind[self.end, y] - z[self.s])[:, None])
        slope = np.bincount(self.feature, np.repeat(self.gold - p.sum(1), self.count), len(w))
        expected = np.zeros((k, k))
        np.add.at(expected.T, y, p)
        value = float(score[self.gold].sum() + (self.true_moves * moves).sum() - z.sum())
        return value, slope, self.true_moves - expected


def made_up_data(sentences: int) -> tuple[_Sentences, dict[str, int]]:
    """Candidates of made-up sentences, and the number of each feature."""
    rng, data, names = random.Random(11), [], {}
    for _ in range(sentences):
        text, spans = _made_up(rng)
        truth = {(a, b): LABELS.index(k) for k, a, b in spans}
        for way, units in stretches(text):
            found = segments(text, way, units)
            gold = {(i, j): y for i in range(len(units)) for j in range(i + 1, len(units) + 1) if (y := truth.get((units[i][0], units[j - 1][1]))) and any(s[:3] == (i, j, y) for s in found)}
            inside = {u for i, j in gold for u in range(i, j)}
            gold |= {(u, u + 1): 0 for u in range(len(units)) if u not in inside}
            data.append((len(units), [(i, j, y, [names.setdefault(f, len(names)) for f in fs], gold.get((i, j)) == y) for i, j, y, fs in found]))
    return _Sentences(data), names


@lru_cache(1)
def trained(sentences: int = 700, rounds: int = 60) -> Field:
    """The field, by gradient ascent on the log likelihood."""
    data, names = made_up_data(sentences)
    size, k = len(names), len(LABELS)
    w, g2 = np.zeros(size + k * k), np.full(size + k * k, 1e-6)
    for _ in range(rounds):
        _, slope, moves = data.likelihood(w[:size], w[size:].reshape(k, k))
        grad = np.r_[slope, moves.ravel()] - 2e-4 * len(data.first) * w
        g2 += grad**2
        w += 0.5 * grad / np.sqrt(g2)
    return Field({f: float(w[i]) for f, i in names.items()}, w[size:].reshape(k, k))


#: Units after which the dynamic program gives out what is settled.
SETTLE = 2048
#: Patterns of spans whose scores are remembered.
PATTERNS = 20_000
_TO_ZERO = str.maketrans("123456789", "000000000")
_NO_MARKS = str.maketrans("", "", " ().+/-")
_DOUBLED = bytes.maketrans(b"0123456789", bytes([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]))
_SINGLE = bytes.maketrans(b"0123456789", bytes(range(10)))


def _checks(span: str) -> bool:
    """``luhn`` of the digits of a span of the field."""
    digits = span.translate(_NO_MARKS).encode()[::-1]
    return (sum(digits[::2].translate(_SINGLE)) + sum(digits[1::2].translate(_DOUBLED))) % 10 == 0


_LETTER = re.compile("[A-Za-z]").search


class Field:
    """The trained field: weights of features, moves between labels."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.into = moves.T.tolist()
        self.whole = [[self.weight(f"{label} whole {x}") for x in (False, True)] for label in LABELS]
        self.known: dict[str, list[tuple[int, float, float, str]]] = {}

    def weight(self, feature: str) -> float:
        return self.weights.get(feature, -0.5)

    def pattern(self, text: str) -> list[tuple[int, float, float, str]]:
        """(label, score, score where the test holds, test) of the types that a span of this pattern can be, by all that
        its digits' values don't change; the test is the one that they do."""
        if (out := self.known.get(text)) is None:
            out, groups, n = [], _GROUP.findall(text), text.count("0")
            for y, label in enumerate(LABELS):
                names = None if label in ("none", "email") else features(text, "digits", [(0, len(text))], 0, 1, label)
                if names is None:
                    continue
                fixed = sum(self.weight(f) for f in names if f.split(" ")[1:2] not in (["after"], ["whole"], ["check"], ["parts"], ["year"]))
                name, test = {
                    "card": (f"card check {{}} {n in (13, 15, 16, 19)}", "check"),
                    "ip": (f"ip parts {{}} {set(text) == {'0', '.'}}", "parts" if len(groups) == 4 else ""),
                    "phone": ("phone year {}", "year" if re.match("0000[-./]", text) else ""),
                }[label]
                no, yes = (fixed + self.weight(name.format(x)) for x in (False, True))
                out.append((y, no, yes, test))
            if len(self.known) >= PATTERNS:
                self.known.clear()
            self.known[text] = out
        return out

    def scored(self, span: str, cued: dict[int, float], whole: bool) -> list[tuple[int, float]]:
        """(label, score) of a digit span as every type it can be; ``cued``: what the words before it add to each."""
        out = []
        for y, no, yes, test in self.pattern(span.translate(_TO_ZERO)):
            if test == "check":
                holds = _checks(span)
            elif test == "parts":
                holds = all(map(_small, _GROUP.findall(span)))
            else:
                holds = test == "year" and span[:2] in ("19", "20")
            out.append((y, (yes if holds else no) + self.whole[y][whole] + cued.get(y, 0.0)))
        return out

    def cued(self, text: str, at: int) -> dict[int, float]:
        """What the words before a span add to each type."""
        before = text[max(0, at - 24) : at]
        if not _LETTER(before):
            return {}
        held = [k for k, cue in _CUES.items() if cue.search(before)]
        return {y: sum(self.weight(f"{label} after {k}") for k in held) for y, label in enumerate(LABELS)} if held else {}

    def addresses(self, text: str) -> list[tuple[int, int]]:
        """Spelled-out addresses: stretches of one unit."""
        out = []
        for unit in spelled(text):
            found = [(i, j, y, sum(map(self.weight, fs))) for i, j, y, fs in segments(text, "spelled", [unit])]
            out += [unit for _, _, y in decode(1, found, self.moves) if y]
        return out

    def numbers(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(label, start, end) of the entities in runs of digit groups, as ``decode`` over all of a run's candidates would find them.

        Units come one at a time; candidates are scored as they are made, and only the
        last ``SPAN`` units' scores are kept. Every ``SETTLE`` units, the part of the
        path that all live paths share is given out and forgotten.
        """
        labels = range(len(LABELS))
        none = [self.weight("none digits") + self.weight(f"none length {n}") for n in range(10)]
        low = float("-inf")
        for a, b, first, last in digit_units(text):
            if first:
                t, row = 0, [0.0] + [low] * (len(LABELS) - 1)
                starts, ends, back = {}, {}, {}
                #: Of the units that an entity can begin at: place, start, digits before, score and label it is entered from, cues.
                live: list[tuple[int, int, int, list[float], list[int], dict[int, float]]] = []
                total = 0
            starts[t], ends[t] = a, b
            came, reached = [], []
            for into in self.into:
                k = 0
                top = row[0] + into[0]
                for x in labels:
                    if row[x] + into[x] > top:
                        k, top = x, row[x] + into[x]
                came.append(k)
                reached.append(top)
            live.append((t, a, total, reached, came, self.cued(text, a)))
            total += b - a - text.count("+", a, b) - text.count("(", a, b)
            while len(live) > SPAN or (len(live) > 1 and total - live[0][2] > LONGEST):
                live.pop(0)
            row = [low] * len(LABELS)
            t += 1
            for i, start, before, reach, via, cued in live:
                n = total - before
                found = self.scored(text[start:b], cued, i == 0 and last) if FEWEST <= n <= LONGEST else ()
                if i == t - 1:
                    found = [(0, none[min(b - a, 9)]), *found]
                for y, s in found:
                    if reach[y] + s > row[y]:
                        row[y] = reach[y] + s
                        back[t, y] = (i, via[y])
            if last:
                yield from self._path(back, (t, max(labels, key=lambda k, row=row: row[k])), starts, ends)
            elif t % SETTLE == 0:
                # nodes that a later segment can begin at
                node = self._shared(back, [(j, y) for j in range(t + 1 - SPAN, t + 1) for y in labels if (j, y) in back])
                if node and node in back:
                    yield from self._path(back, node, starts, ends)
                    # the path up to there is told: a node without a way back ends a path
                    back = {at: x for at, x in back.items() if at[0] > node[0]}
                    starts, ends = ({k: x for k, x in old.items() if k >= min(node[0], t - SPAN)} for old in (starts, ends))

    @staticmethod
    def _shared(back: dict, nodes: list[tuple[int, int]]) -> tuple[int, int] | None:
        """The last node that the paths to all of ``nodes`` go through."""
        live = set(nodes)
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            if far not in back:
                return None
            live.add(back[far])
        return next(iter(live), None)

    @staticmethod
    def _path(back: dict, node: tuple[int, int], spans: dict[int, int], ends: dict[int, int]) -> list[tuple[int, int, int]]:
        out = []
        while node in back:
            before = back[node]
            if node[1]:
                out.append((node[1], spans[before[0]], ends[node[0] - 1]))
            node = before
        return out[::-1]


class _Taken:
    """Spans, to ask whether another meets one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], field: Field) -> list[tuple[str, int, int]]:
    """Spans that the field finds and no base span touches."""
    taken = _Taken([s for spans in base.values() for s in spans])
    mails = [(a, b) for a, b in field.addresses(text) if not taken.meets(a, b)]
    own = _Taken(mails)
    found = [(LABELS[y], a, b) for y, a, b in field.numbers(text) if not taken.meets(a, b) and not own.meets(a, b)]
    return [*(("email", a, b) for a, b in mails), *found]


def find(text: str, field: Field) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans sorted by kind as listed, then start)."""
    base = base_spans(text)
    every = [(k, a, b) for k in KINDS for a, b in base[k]]
    if re.search(r"[0-9]| at | @|@ |[\[({<] ?(?:at|AT|@)", text):
        every += added_spans(text, base, field)
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (joined spans) and spans of every row."""
    model = trained()  # some hundreds of weights, sent with the tasks

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base, every = find(text, model)
                for c, k in zip(cols, KINDS, strict=False):
                    c.append(len(base[k]))
                cols[4].append(joined([(k, a, z) for k in KINDS for a, z in base[k]]))
                cols[5].append(joined(every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def base_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redacted(text: str, model) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans count as the first."""
    _, every = find(text, model)
    out, at = [], 0
    for kind, a, b in sorted(every, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced, and ``n_chars``, where there is one, counted anew."""
    model = trained()

    @F.arrow_udf("string")
    def clean(text):
        return pa.array([t if t is None else redacted(t, model) for t in text.to_pylist()], pa.string())

    out = docs.withColumn("text", clean("text"))
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out
