"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans, which always stay. The field reads what the patterns leave: stretches around digits, @ and
written-out signs. A stretch is a sequence of units (letters, digits, blanks, single signs); a segmentation labels
runs of up to MOST_UNITS units as email, ip, card or phone and leaves the rest unlabelled. Every candidate segment is
scored as a whole (length, groups, checksum, separators, neighbours), and dynamic programming finds the best
boundaries and types together. Weights maximise the conditional likelihood of segmentations of at most
SAMPLE stretches per kind whose labels are the base spans, together with variants that the patterns do not know: written-out
addresses and phone numbers without a plus sign. A segment is added when it beats leaving it unlabelled by MARGIN.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docaudit.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
MOST_UNITS = 24
#: Characters of a candidate segment.
MOST_CHARS = 80
SAMPLE, ROUNDS, MARGIN = 40, 50, 2.0

Span = tuple[str, int, int]

# The base patterns. The look-behind skips starts that cannot match, so runs are read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start: leftmost, non-overlapping per kind, failing matches dropped."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if domain and start < at:
            found.append(("email", start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return found


# --- the field ---------------------------------------------------------------------------------------------------

_UNIT = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|.", re.DOTALL)
_AT = re.compile(r"@|[\[({][aA][tT][\])}]")
_DOT = re.compile(r"\.|[\[({][dD][oO][tT][\])}]")
#: Every candidate segment holds one of these, but for digits that are further apart: digits in groups, at least 7 in all.
_TRIGGER = re.compile(r"[0-9](?:[^\w\n]{0,3}[0-9]){6,}+|[0-9]{3,}|" + _AT.pattern + r"|[\[({][dD][oO][tT][\])}]")
#: What shows that an address or a number goes on beyond a segment.
_ON = re.compile(r"[ \t]?(?:@|[\[({](?:[aA][tT]|[dD][oO][tT])[\])}])|\.\w|[ .()/-]{0,2}[0-9]")
_FROM = re.compile(r"(?:(?:@|[\[({](?:[aA][tT]|[dD][oO][tT])[\])}])[ \t]?|\w[._%+-]|[0-9][ .()/-]{0,2})\Z")
_GROUPS = re.compile(r"[0-9]+")


def _grade(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def segment_features(s: str, before: str, after: str) -> list[str]:
    """Names of the whole-span features of a candidate segment and what stands before and after it."""
    groups = [len(g) for g in _GROUPS.findall(s)]
    digits = sum(groups)
    letters = sum(c.isalpha() for c in s)
    ats = list(_AT.finditer(s))
    names = [
        f"digits={_grade(digits, 1, 4, 7, 8, 10, 11, 13, 16, 20)}", f"letters={_grade(letters, 1, 3, 8)}", f"groups={_grade(len(groups), 1, 2, 3, 4, 5, 7)}",
        f"ats={min(len(ats), 2)}", f"blank={' ' in s or chr(9) in s}", f"first={_shape(s[0])}", f"last={_shape(s[-1])}",
        f"before={_shape(before[-1:])}", f"after={_shape(after[:1])}", f"from={_FROM.search(before) is not None}", f"on={_ON.match(after) is not None}",
    ]
    if len(ats) == 1:
        host = s[ats[0].end() :].strip()
        names.append(f"host={bool(_DOT.search(host)) and host[-1:].isalnum()}")
        user, plain_host = s[: ats[0].start()].strip(), _DOT.sub(".", host).replace(" . ", ".")
        names.append(f"user={user != ''}+{any(c.isspace() for c in user)}+{any(c.isspace() for c in plain_host)}+{ats[0][0] == '@'}")
    if 13 <= digits <= 19 and not letters:
        names.append(f"luhn={luhn(_only_digits(s))}")
    if s.count(".") == 3 and len(groups) == 4 and not letters:
        names.append(f"octets={all(map(_octet, _GROUPS.findall(s)))}")
    if not letters and not ats:
        names += [f"paren={'(' in s}", f"balanced={s.count('(') == s.count(')')}", f"dash={_grade(s.count('-'), 1, 2, 3)}", f"points={_grade(s.count('.'), 1, 3, 4)}"]
        names.append("sizes=" + "-".join(map(str, groups[-3:])) if len(groups) <= 5 and max(groups, default=0) <= 6 else "sizes=other")
        names.append(f"signs={any(not c.isdigit() and c not in ' +().-/' for c in s)}")
        names.append(f"even={len(set(groups)) == 1 and len(groups) > 1}")
    return names


def _shape(c: str) -> str:
    if not c:
        return "edge"
    if c.isalpha():
        return "a"
    if c.isdigit():
        return "9"
    return "_" if c.isspace() else c if c in "+(-.@:=\"'/" else "?"


@dataclass
class Stretch:
    """Units of a stretch with the candidate segments that end at every unit: (first unit, feature names)."""

    text: str
    offsets: list[int]
    ending: list[list[tuple[int, list[str]]]] = field(default_factory=list)


def stretch(text: str, low: int, high: int) -> Stretch:
    cut = [m.start() for m in _UNIT.finditer(text, low, high)] + [high]
    made = Stretch(text, cut)
    for last in range(len(cut) - 1):
        here: list[tuple[int, list[str]]] = []
        end = cut[last + 1]
        if text[end - 1].isalnum():
            for first in range(last, max(-1, last - MOST_UNITS), -1):
                s = text[cut[first] : end]
                if len(s) > MOST_CHARS:
                    break
                if (s[0].isalnum() or s[0] in "+(") and (_AT.search(s) or sum(c.isdigit() for c in s) >= 7):
                    here.append((first, segment_features(s, text[max(0, cut[first] - 6) : cut[first]], text[end : end + 6])))
        made.ending.append(here)
    return made


def stretches(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bounds around triggers outside the taken spans, on one line each; overlapping ones are joined.

    A stretch reaches as far on both sides of a trigger as a segment that holds it can."""
    if not _TRIGGER.search(text):
        return []
    out: list[tuple[int, int]] = []
    reached = 0
    for start, end in [*sorted(taken), (len(text), len(text))]:
        for m in _TRIGGER.finditer(text, reached, start) if reached < start else ():
            low, high = m.span()
            floor = max(reached, low - MOST_CHARS, text.rfind("\n", max(0, low - MOST_CHARS), low) + 1)
            line = text.find("\n", high, high + MOST_CHARS)
            ceiling = min(start, high + MOST_CHARS, line if line >= 0 else len(text))
            left = [u.start() for u in _UNIT.finditer(text, floor, low)]
            low = left[-MOST_UNITS] if len(left) >= MOST_UNITS else floor
            right = [u.end() for u in _UNIT.finditer(text, high, ceiling)]
            high = right[MOST_UNITS - 1] if len(right) >= MOST_UNITS else ceiling
            if out and low <= out[-1][1] and out[-1][0] >= reached:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        reached = max(reached, end)
    return out


class SemiMarkov:
    """Weights by (kind, feature); leaving a unit unlabelled scores 0."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((len(KINDS), 0))

    def _rows(self, s: Stretch, grow: bool) -> list[list[tuple[int, list[int]]]]:
        number = lambda n: self.index.setdefault(n, len(self.index)) if grow else self.index.get(n, -1)
        return [[(first, [i for n in names if (i := number(n)) >= 0]) for first, names in here] for here in s.ending]

    def fit(self, data: list[tuple[Stretch, list[tuple[str, int, int]]]], rounds: int = ROUNDS, step: float = 0.5, decay: float = 0.01) -> None:
        """Adagrad on the conditional log-likelihood of the gold segments (kind, first unit, last unit)."""
        examples = [_packed(self._rows(s, True), gold) for s, gold in data]
        self.weights = np.zeros((len(KINDS), len(self.index)))
        history = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            gradient = -decay * self.weights
            for example in examples:
                self._add(example, gradient)
            history += gradient**2
            self.weights += step * gradient / np.sqrt(history)

    def _add(self, example: tuple, gradient: np.ndarray) -> None:
        """Add gold minus expected features; expectations come from the forward and backward sums."""
        n, first, last, ids, begin, gold = example
        if not len(first):
            return
        score = np.add.reduceat(self.weights[:, ids], begin, axis=1)
        total = np.logaddexp.reduce(score, 0)
        ends = np.searchsorted(last, np.arange(n + 1))
        by_first = np.argsort(first, kind="stable")
        starts = np.searchsorted(first[by_first], np.arange(n + 1))
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(n):
            c = slice(ends[j], ends[j + 1])
            forward[j + 1] = np.logaddexp.reduce(np.append(forward[first[c]] + total[c], forward[j]))
        for i in range(n - 1, -1, -1):
            c = by_first[starts[i] : starts[i + 1]]
            backward[i] = np.logaddexp.reduce(np.append(backward[last[c] + 1] + total[c], backward[i + 1]))
        share = gold - np.exp(forward[first] + score + backward[last + 1] - forward[n])
        sizes = np.diff(np.append(begin, len(ids)))
        for kind in range(len(KINDS)):
            np.add.at(gradient[kind], ids, np.repeat(share[kind], sizes))

    def decode(self, s: Stretch, margin: float = MARGIN) -> list[Span]:
        """The best segmentation; positions are those of the text."""
        best = [0.0]
        back: list[tuple[int, int] | None] = [None]
        for j, here in enumerate(self._rows(s, False)):
            top, how = best[j], None
            for first, ids in here:
                v = self.weights[:, ids].sum(1)
                kind = int(v.argmax())
                if (total := best[first] + float(v[kind]) - margin) > top:
                    top, how = total, (first, kind)
            best.append(top)
            back.append(how)
        found, j = [], len(best) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                first, kind = back[j]
                found.append((KINDS[kind], s.offsets[first], s.offsets[j]))
                j = first
        return found[::-1]


def _packed(ending: list[list[tuple[int, list[int]]]], gold: list[tuple[str, int, int]]) -> tuple:
    """Candidates of an example as arrays, ordered by their last unit."""
    flat = [(f, j, ids) for j, here in enumerate(ending) for f, ids in here]
    first, last = np.array([c[0] for c in flat], np.int64), np.array([c[1] for c in flat], np.int64)
    begin = np.concatenate([[0], np.cumsum([len(c[2]) for c in flat])])[:-1].astype(np.int64)
    right = np.zeros((len(KINDS), len(flat)))
    for kind, f, j in gold:
        right[KINDS.index(kind), np.flatnonzero((first == f) & (last == j))] = 1
    return len(ending), first, last, np.array([i for c in flat for i in c[2]], np.int64), begin, right


def variants(text: str, kind: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Texts in which the span is written as the patterns do not know it."""
    s = text[start:end]
    if kind == "email":
        user, _, host = s.partition("@")
        forms = [f"{user} (at) {host}", f"{user}[at]{host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}(at){host.replace('.', '(dot)')}"]
        forms += [f"{user} {{at}} {host.replace('.', ' {dot} ')}", f"{user} (At) {host}"]
    elif kind == "phone":
        groups = re.findall(r"[0-9]+", s)
        local = groups[1:] if len(groups) > 2 and len(groups[0]) <= 3 else groups
        forms = ["-".join(local), "00" + " ".join(groups), ".".join(local)] if len(local) > 1 else []
        if len(local) == 3:
            forms.append(f"({local[0]}) {local[1]}-{local[2]}")
        pairs = re.findall(r"[0-9]{2}", f"{'':0>{sum(map(len, local)) % 2}}" + "".join(local))
        forms += [" ".join(pairs), ".".join(pairs), "-".join(pairs), f"00{groups[0][:3]} {' '.join(pairs)}"]
    else:
        forms = []
    for form in forms:
        yield text[:start] + form + text[end:], start, start + len(form)


#: Digits in groups that are no phone number.
_PLAIN = (
    "on 12.05.2024 10:30 we met", "at 2024-05-12 10:30:45 it ran", "rows 10 20 30 40 50 60 70 of it", "prices 12, 34, 56, 78, 90 and more",
    "1, 2, 3, 4, 5, 6, 7, 8, 9", "from 2019 to 2024, 345 of 678", "05/12/2024, 06/12/2024", "3.11.2.14.55 of 1.2.3.4.5.6.7.8",
)


def _open(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Bounds of the base spans that the field leaves out: not of four octets with a fifth group behind them."""
    return [(a, b) for kind, a, b in base if kind != "ip" or not re.match(r"\.[0-9]", text[b : b + 2])]


def _example(text: str, spans: list[Span]) -> tuple[Stretch, list[tuple[str, int, int]]]:
    s = stretch(text, 0, len(text))
    at = {o: i for i, o in enumerate(s.offsets)}
    gold = [(k, at[a], at[b] - 1) for k, a, b in spans if a in at and b in at and b > a]
    # Gold segments of two kinds that overlap cannot be one segmentation: the first kind counts.
    kept: list[tuple[str, int, int]] = []
    for g in gold:
        if all(g[2] < k[1] or g[1] > k[2] for k in kept) and any(f == g[1] for f, _ in s.ending[g[2]]):
            kept.append(g)
    return s, kept


def _snippets(docs: DataFrame, sample: int) -> list[tuple[str, list[Span]]]:
    """At most ``sample`` snippets per kind, and as many without personal data, chosen by a hash of doc_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                spans = base_spans(text)
                for kind in KINDS:
                    for _, a, b in [s for s in spans if s[0] == kind][:1]:
                        if b - a <= 80:
                            rows.append((doc_id, kind, text[max(0, a - 60) : b + 60]))
                bounds = stretches(text, _open(text, spans))
                if bounds:
                    rows.append((doc_id, "none", text[bounds[0][0] : bounds[0][1]][:400]))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "snippet"]).astype({"doc_id": "Int64"})

    found = texts(docs).mapInPandas(run, "doc_id long, kind string, snippet string")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("doc_id"), "doc_id", "snippet")
    chosen = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).orderBy("kind", "n").collect()
    return [(r["snippet"], base_spans(r["snippet"])) for r in chosen]


def fit(docs: DataFrame, sample: int = SAMPLE) -> SemiMarkov:
    """Train on a bounded sample of snippets; without any the field adds nothing."""
    data = []
    for turn, (text, spans) in enumerate(_snippets(docs, sample)):
        data.append((text, spans))
        for kind, start, end in spans[:1]:
            for i, (other, a, b) in enumerate(variants(text, kind, start, end)):
                # In turn within its text, alone, and at the end of a sentence.
                if (turn + i) % 3:
                    lead, tail = ("", "") if (turn + i) % 3 == 1 else ("a, ", ".")
                    data.append((lead + other[a:b] + tail, [(kind, len(lead), len(lead) + b - a)]))
                    continue
                shift = b - end
                moved = [(k, x + shift * (x >= end), y + shift * (x >= end)) for k, x, y in spans if y <= start or x >= end]
                data.append((other, sorted([(kind, a, b), *moved], key=lambda s: s[1])))
    data += [(text, []) for text in _PLAIN] if data else []
    model = SemiMarkov()
    # A text with a span that is no candidate segment would teach the wrong thing.
    examples = [e for text, spans in data if len((e := _example(text, spans))[1]) == len(spans)]
    if examples:
        model.fit(examples)
    return model


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind and start."""
    base = base_spans(text)
    more = [s for low, high in stretches(text, _open(text, base)) for s in model.decode(stretch(text, low, high))] if model.index else []
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Null text counts as empty and has no spans. Texts are read whole. Positions count code points, ends are exclusive.
    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base, every = all_spans(text, model)
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out

    return texts(docs).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
