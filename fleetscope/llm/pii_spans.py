"""Personal data: fixed patterns, and a semi-Markov CRF that adds further spans.

The CRF scores whole candidate segments of a region around digits and at-signs.
Its dynamic programme chooses boundaries and types together; an entity has at
most ``LONGEST`` tokens.  Weights are fitted by maximum conditional likelihood
on 800 labelled sentences generated from a fixed seed (no labelled text with
personal data is at hand): entities of nine types and look-alikes such as
versions, dates, order, item and part numbers.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import whole_text

BASE = ("email", "ip", "card", "phone")
TYPES = (*BASE, "ssn", "iban", "document", "address", "name")
LONGEST = 24

LOCAL_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_PAIR = re.compile(r"[0-9][\x20-]?[0-9]")

Span = tuple[int, int, int]  # start, rank of the type, end


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, at-sign and dotted host: each at-sign is tried with the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_RUN:
            start -= 1
        host = HOST.match(text, at) if start < at else None
        if host:
            free = host.end()
            yield start, 0, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind; failing matches are dropped without a retry."""
    spans = list(_emails(text))
    if DIGIT_PAIR.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    elif "." in text:  # an address of one-digit parts has no two adjacent digits
        for m in IP.finditer(text):
            spans.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
SEED = re.compile(r"[0-9@]")
BLANK = frozenset(" \t\n\x0b\x0c\r")

SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "email_words": re.compile(r"[A-Za-z0-9._-]+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    "card": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}"),
    "phone_plus": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]+\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"),
    "phone_local": re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "document": re.compile(r"[A-Z]{1,2}[0-9]{6,8}[A-Z]?"),
    "address": re.compile(r"[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square|St|Rd|Ave|Blvd)"),
    "name": re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+){0,2}"),
}
OWNER = {
    "email": 0, "email_words": 0, "ip": 1, "card": 2, "phone_plus": 3, "phone_local": 3, "ssn": 4, "iban": 5,
    "document": 6, "address": 7, "name": 8,
}
CUES = {
    "mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "phone": 3,
    "tel": 3, "call": 3, "mobile": 3, "fax": 3, "ssn": 4, "social": 4, "iban": 5, "account": 5, "bank": 5,
    "passport": 6, "licence": 6, "license": 6, "permit": 6, "lives": 7, "residence": 7, "home": 7, "deliver": 7,
    "patient": 8, "signed": 8, "sincerely": 8, "attn": 8,
}


def _iban_valid(text: str) -> bool:
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


SIGNS = (("A", re.compile(r"[A-Z]+")), ("a", re.compile(r"[a-z]+")), ("0", re.compile(r"[0-9]+")))


def signature(span: str) -> str:
    """The span with each run of capitals, small letters or digits as one sign."""
    for sign, run in SIGNS:
        span = run.sub(sign, span)
    return span


def segment_features(text: str, start: int, end: int) -> list[tuple[int, tuple[str, ...]]]:
    """(type, features) of the whole span for every type whose shape it has."""
    span, found = text[start:end], []
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    cue = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])
    for shape, pattern in SHAPES.items():
        if not pattern.fullmatch(span):
            continue
        kind = OWNER[shape]
        features = [shape, f"form {signature(span)}", f"length {min((end - start) // 4, 8)}"]
        if left.isalnum() or right.isalnum() or left in "-./" or right in "-/":
            features.append("cut")
        digits = digits_of(span)
        if kind == 2:
            features.append("luhn" if luhn(digits) else "not_luhn")
        if kind == 1:
            features.append("octets" if all(int(p) <= 255 for p in span.split(".")) else "not_octets")
        if kind == 5:
            features.append("mod97" if _iban_valid(span) else "not_mod97")
        if kind == 3 and not 9 <= len(digits) <= 15:
            features.append("odd_length")
        if kind == 4 and (digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000"):
            features.append("not_issued")
        cued = {CUES[word.lower()] for word in cue[-3:] if word.lower() in CUES}
        features.append("own_cue" if kind in cued else "other_cue" if cued else "no_cue")
        found.append((kind, tuple(features)))
    return found


def _lattice(text: str, start: int, end: int) -> tuple[list[int], list[list[tuple[int, int, tuple[str, ...]]]]]:
    """Token boundaries of a region, and for each boundary the entity segments that end there."""
    cuts = [start] + [m.end() for m in TOKEN.finditer(text, start, end)]
    ending: list[list[tuple[int, int, tuple[str, ...]]]] = [[] for _ in cuts]
    for i in range(len(cuts) - 1):
        first = text[cuts[i]]
        if not (first.isascii() and first.isalnum() or first in "+(._%-"):
            continue
        for j in range(i + 1, min(len(cuts), i + 1 + LONGEST)):
            last = text[cuts[j] - 1]
            if cuts[j] - cuts[i] >= 7 and (last.isascii() and last.isalnum() or last == "-"):
                for kind, features in segment_features(text, cuts[i], cuts[j]):
                    ending[j].append((i, kind, features))
    return cuts, ending


def _score(weights: dict[tuple[int, str], float], kind: int, features: tuple[str, ...]) -> float:
    return sum(weights.get((kind, f), 0.0) for f in (*features, "bias"))


def decode(weights: dict[tuple[int, str], float], text: str, start: int, end: int) -> list[Span]:
    """The best segmentation's entities; a token outside entities scores 0, ties go to fewer entities."""
    cuts, ending = _lattice(text, start, end)
    if not any(ending):
        return []
    best, back = [0.0] * len(cuts), [(0, -1)] * len(cuts)
    for j in range(1, len(cuts)):
        best[j], back[j] = best[j - 1], (j - 1, -1)
        for i, kind, features in ending[j]:
            score = best[i] + _score(weights, kind, features)
            if score > best[j]:
                best[j], back[j] = score, (i, kind)
    spans, j = [], len(cuts) - 1
    while j:
        i, kind = back[j]
        if kind >= 0:
            spans.append((cuts[i], kind, cuts[j]))
        j = i
    return spans[::-1]


def _add(a: float, b: float) -> float:
    low, high = min(a, b), max(a, b)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


def _gradient(weights, lattice, gold):
    """Observed less expected feature counts of one sentence, by the forward-backward sums over segments."""
    cuts, ending = lattice
    n = len(cuts)
    ahead, behind = [-math.inf] * n, [-math.inf] * n
    ahead[0], behind[n - 1] = 0.0, 0.0
    scored = [[(i, kind, f, _score(weights, kind, f)) for i, kind, f in segments] for segments in ending]
    for j in range(1, n):
        ahead[j] = ahead[j - 1]
        for i, _, _, s in scored[j]:
            ahead[j] = _add(ahead[j], ahead[i] + s)
    for j in range(n - 1, 0, -1):
        behind[j - 1] = _add(behind[j - 1], behind[j])
        for i, _, _, s in scored[j]:
            behind[i] = _add(behind[i], behind[j] + s)
    for j in range(1, n):
        for i, kind, features, s in scored[j]:
            change = ((cuts[i], kind, cuts[j]) in gold) - math.exp(ahead[i] + s + behind[j] - ahead[n - 1])
            for f in (*features, "bias"):
                yield (kind, f), change


def training_sentences(n: int = 800, seed: int = 7) -> list[tuple[str, set[Span]]]:
    """Generated sentences with entities and look-alikes (versions, dates, order numbers)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(3, 8)))

    def with_luhn(k: int) -> str:
        body = "4" + digits(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban() -> str:
        body = "DE00" + digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"DE{check:02d}{body[4:]}"

    def grouped(text: str, sep: str) -> str:
        return sep.join(text[i : i + 4] for i in range(0, len(text), 4))

    makers = [
        (0, "mail", lambda: f"{name()}.{name()}@{name()}.com"),
        (0, "contact", lambda: f"{name()} [at] {name()} [dot] org"),
        (1, "host", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))),
        (2, "card", lambda: grouped(with_luhn(16), rng.choice(["", " ", "-"]))),
        (3, "phone", lambda: f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}"),
        (3, "call", lambda: rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])),
        (4, "ssn", lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        (5, "iban", lambda: grouped(iban(), rng.choice(["", " "]))),
        (5, "account", lambda: grouped("GB00" + "".join(rng.choice("BCLNRW") for _ in range(4)) + digits(14), " ")),
        (6, "passport", lambda: rng.choice("CLPX") + digits(rng.choice([7, 8]))),
        (6, "licence", lambda: "".join(rng.choice("ABKM") for _ in range(2)) + digits(6) + rng.choice(["", "T"])),
        (7, "lives", lambda: f"{rng.randint(1, 2000)} {name().title()} {rng.choice(['Street', 'Road', 'Avenue', 'Lane', 'Court'])}"),
        (8, "signed", lambda: f"{rng.choice(['Mr', 'Mrs.', 'Ms', 'Dr.', 'Prof.'])} {name().title()} {name().title()}"),
        (8, "patient", lambda: f"{rng.choice(['Mr.', 'Ms.', 'Dr'])} {name().title()}"),
        (-1, "item", lambda: "".join(rng.choice("ABKM") for _ in range(2)) + digits(6)),
        (-1, "route", lambda: f"{rng.randint(1, 99)} {name().title()} {name().title()} {rng.choice(['trains', 'buses', 'Goals'])}"),
        (-1, "version", lambda: f"{rng.randint(300, 999)}.{rng.randint(1, 99)}.{rng.randint(1, 99)}.{rng.randint(1, 9)}"),
        (-1, "order", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}"),
        (-1, "on", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"),
        (-1, "part", lambda: f"{digits(2)}-{digits(3)}-{digits(2)}-{digits(4)}/{digits(3)}-{digits(2)}-{digits(4)}"),
    ]
    sentences = []
    for _ in range(n):
        kind, cue, make = rng.choice(makers)
        before = " ".join(name() for _ in range(2)) + " " + (cue if rng.random() < 0.6 else name()) + rng.choice([" ", ": "])
        entity = make()
        sentences.append((f"{before}{entity} {name()}", {(len(before), kind, len(before) + len(entity))} if kind >= 0 else set()))
    return sentences


@lru_cache(maxsize=1)
def trained_weights(epochs: int = 25, rate: float = 0.15, shrink: float = 0.01) -> dict[tuple[int, str], float]:
    """Weights after gradient ascent on the regularised conditional likelihood; the same on every run."""
    data = [(_lattice(text, 0, len(text)), gold) for text, gold in training_sentences()]
    data = [(lattice, gold) for lattice, gold in data if any(lattice[1])]
    weights: dict[tuple[int, str], float] = {}
    for _ in range(epochs):
        for lattice, gold in data:
            for feature, change in list(_gradient(weights, lattice, gold)):
                weights[feature] = (1 - rate * shrink) * weights.get(feature, 0.0) + rate * change
    return weights


BRACKETED_AT = re.compile(r"[\[(]at[\])]", re.I)
#: The longest candidate from every start, so that those which begin inside another count too.
IBAN_FROM = re.compile(rf"(?=({SHAPES['iban'].pattern}))")
IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
#: Longest candidates with words of letters only: addresses and names after a title.
WORDED = tuple(re.compile(rf"(?<![A-Za-z0-9]){SHAPES[shape].pattern}") for shape in ("address", "name"))
WORDED_HINT = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]|[0-9][A-Za-z]? [A-Z]")


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words with a digit or an at-sign, joined over single blanks."""
    start = end = -1
    pos = 0
    while m := SEED.search(text, pos):
        left = right = m.start()
        while left > max(end, 0) and text[left - 1] not in BLANK:
            left -= 1
        while right < len(text) and text[right] not in BLANK:
            right += 1
        if start >= 0 and left - end > 1:
            yield start, end
            start = left
        elif start < 0:
            start = left
        end = pos = right
    if start >= 0:
        yield start, end


def _tokens_before(text: str, pos: int, n: int) -> int:
    """Start of the ``n`` tokens before ``pos``."""
    kind = lambda c: c.isascii() and (1 if c.isalpha() else 2 if c.isdigit() else 0)
    while n and pos:
        pos -= 1
        this = kind(text[pos])
        while this and pos and kind(text[pos - 1]) == this:
            pos -= 1
        n -= 1
    return pos


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint regions that hold every candidate whole.

    Words without digit or at-sign are inside a candidate in few shapes only:
    account numbers, street addresses and names after a title, whose longest
    extents are joined, and mail addresses around a bracketed "at", where a
    region reaches ``LONGEST`` tokens to both sides.
    """
    found = list(_stretches(text))
    if IBAN_START.search(text):
        found += [m.span(1) for m in IBAN_FROM.finditer(text)]
    if WORDED_HINT.search(text):
        found += [m.span() for shape in WORDED for m in shape.finditer(text)]
    for m in BRACKETED_AT.finditer(text):
        end = m.end()
        for token in islice(TOKEN.finditer(text, end), LONGEST):
            end = token.end()
        found.append((_tokens_before(text, m.start(), LONGEST), end))
    start = end = -1
    for left, right in sorted(found):
        if left >= end:
            if start >= 0:
                yield start, end
            start, end = left, right
        end = max(end, right)
    if start >= 0:
        yield start, end


def crf_spans(weights: dict[tuple[int, str], float], text: str, base: list[Span]) -> list[Span]:
    """CRF entities that overlap no base span."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in sorted(base):  # merged, so that one look-up tells whether a span meets any
        if starts and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    added: list[Span] = []
    for start, end in regions(text):
        i = bisect_right(starts, start) - 1
        if end - start < 7 or i >= 0 and end <= ends[i]:
            continue
        for span in decode(weights, text, start, end):
            i = bisect_right(starts, span[2] - 1) - 1
            if i < 0 or ends[i] <= span[0]:
                added.append(span)
    return added


SPAN = "struct<start:int,rank:int,end:int>"


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``spans`` (arrays of start, rank in ``TYPES``, end; code points).

    ``spans`` holds the base spans and those the CRF adds.  A null text counts
    as empty.  Rows never interact: repeated rows each get a row, an empty
    table gives none.  The weights (some dozens) go to the tasks with the code.
    """
    weights = trained_weights()
    rows = df.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"start": s, "rank": r, "end": e} for s, r, e in spans]
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                bases, alls = [], []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text)
                    bases.append(named(base))
                    alls.append(named(sorted(base + crf_spans(weights, text, base))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(bases, arrow_spans), pa.array(alls, arrow_spans)],
                    names=["__id", "base", "spans"],
                )

    return rows.mapInArrow(scan, f"__id {kind}, base array<{SPAN}>, spans array<{SPAN}>").withColumnRenamed("__id", id_col)


def text_of(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(name) for name in TYPES])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
