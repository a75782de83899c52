"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Patterns find mail addresses, IP addresses, card numbers and phone numbers of the usual forms, leftmost and without
overlap per kind. They are written so that a run of characters is read once, whatever its length.

The field reads the pieces (runs of letters or digits, single marks) around every digit, ``@`` and bracketed ``at``:
pieces further than ``REACH`` characters from all of these are outside by definition. A piece is described by word
shapes, its own and those of its neighbours, and by the gap before it; labels are outside or begin / inside of a kind.
It is trained by maximum likelihood on a small labelled table (`examples`): sentences made by a fixed rule from
templates, with digits drawn from a seed. Tasks decode many windows together by Viterbi in numpy. A found span counts
if its kind's check holds (digits of a phone, Luhn for a card, parts of an IP address) and no pattern's span overlaps
it. So the field adds spans and never moves those of the patterns.

Offsets are code points, ends are exclusive. A null or empty text has no spans. Every row is judged alone: ties and
repeated rows repeat results. Rows travel as a struct, their columns cannot clash.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.common import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
REACH = 40
Span = tuple[str, int, int]

# Fixed patterns of the four kinds. A run that cannot be the start of a match is consumed whole.
_email = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_ip = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_digit.findall(text))


def patterns(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _email.finditer(text) if m[1]]
    if not _digit.search(text):
        return found
    for m in _ip.finditer(text):
        if m[1] and all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _only_digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= len(_only_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# Sentences of the labelled table; {email} and the like are filled by `_fill` and labelled, {no_...} are filled only.
TEMPLATES = (
    "please write to {email} today", "mail: {email}.", "contact {email} or {email}", "{email}", "reach me at {email} soon",
    "call {phone} now", "tel. {phone}", "phone: {phone}, ask for me", "fax {phone} or mobile {phone}", "{phone}",
    "my number is {phone}.", "ring ({phone}) after six", "call {phone} or write {email}",
    "card {card} expires soon", "paid with {card}.", "card number: {card}", "{card}", "visa {card}, thanks",
    "server at {ip} is down", "from {ip} to {ip}", "ip: {ip}", "{ip}", "host [{ip}] answered",
    "the meeting is at {no_time} on {no_date}", "version {no_version} of the library", "License, Version {no_version}.",
    "it cost {no_price} in {no_year}", "chapter {no_small}, page {no_small}", "key = \"{no_hex}\"", "token = \"{no_hex}\"",
    "password={no_hex}", "{no_key} is the id", "commit {no_hex} fixed it", "between {no_year} and {no_year}",
    "order no. {no_order} was sent", "isbn {no_isbn}", "about {no_big} people", "ratio {no_decimal} at best",
    "look at it (at home) again", "score {no_small}:{no_small}", "a | {no_small} | {no_small} | b", "{no_long}",
    "id {no_long}, number {no_order}", "on {no_date} at {no_time}", "{no_date}", "pages {no_small}-{no_small}",
    "{no_small} {no_small} {no_small} {no_small} {no_small}", "user@home said {no_small}", "lines {no_big}, {no_big}",
)


def _fill(kind: str, draw: random.Random) -> str:
    def n(digits: int) -> str:
        return "".join(str(draw.randrange(10)) for _ in range(digits))

    def word(least: int = 3) -> str:
        return "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randrange(least, 9)))

    if kind == "email":
        at = draw.choice([" (at) ", " [at] ", "(at)", "[at]", " at ", "@", " {at} "])
        dot = draw.choice([" (dot) ", " [dot] ", "(dot)", "[dot]", " dot ", "."]) if at != "@" else " [dot] "
        return f"{word()}{draw.choice(['.', '', '_'])}{word()}{at}{word()}{dot}{draw.choice(['com', 'org', 'net', 'de'])}"
    if kind == "phone":
        return draw.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}",
                            f"0{n(3)}/{n(7)}", f"0{n(2)} {n(4)} {n(4)}", f"00{n(2)} {n(3)} {n(3)} {n(4)}", f"({n(3)}){n(3)}-{n(4)}",
                            f"0{n(4)} {n(6)}", f"{n(3)} {n(3)} {n(4)}"])
    if kind == "card":
        body = draw.choice(["34", "37"]) + n(12)
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = draw.choice([" ", "-", ""])
        long = "4" + n(14)
        long += next(d for d in "0123456789" if luhn(long + d))
        return draw.choice([mark.join((body[:4], body[4:10], body[10:])),
                            ".".join((long[:4], long[4:8], long[8:12], long[12:])),
                            " - ".join((long[:4], long[4:8], long[8:12], long[12:]))])
    if kind == "ip":
        part = lambda: draw.choice([f"{draw.randrange(4096, 65536):x}", f"{draw.randrange(1, 4096):x}"])
        return draw.choice([":".join(part() for _ in range(8)), f"2001:db8::{part()}", f"fe80::{part()}:{part()}:{part()}",
                            f"{part()}:{part()}::{part()}"])
    fills = {
        "no_time": f"{draw.randrange(24)}:{n(2)}", "no_date": draw.choice([f"20{n(2)}-0{draw.randrange(1, 10)}-1{n(1)}",
                                                                            f"1{n(1)}.0{draw.randrange(1, 10)}.20{n(2)}",
                                                                            f"0{draw.randrange(1, 10)}/1{n(1)}/19{n(2)}"]),
        "no_version": draw.choice([f"{n(1)}.{n(1)}", f"{n(1)}.{n(2)}.{n(1)}", n(1)]), "no_price": f"${n(3)}.{n(2)}",
        "no_year": f"{draw.choice(['19', '20'])}{n(2)}", "no_small": n(draw.randrange(1, 4)),
        "no_hex": "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice([18, 32, 40]))),
        "no_key": "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ23456789") for _ in range(16)),
        "no_order": n(draw.randrange(5, 9)), "no_isbn": f"978-{n(1)}-{n(3)}-{n(5)}-{n(1)}",
        "no_big": f"{n(2)},{n(3)},{n(3)}", "no_decimal": f"{n(1)}.{n(4)}", "no_long": n(draw.choice([12, 14, 16, 20])),
    }
    return fills[kind]


def examples(copies: int = 6, seed: int = 4) -> list[tuple[str, list[Span]]]:
    """The labelled table: texts and their spans, ``copies`` of every template."""
    draw = random.Random(seed)
    rows = []
    for _ in range(copies):
        for template in TEMPLATES:
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", template):
                if part[:1] == "{":
                    kind = part[1:-1]
                    filled = _fill(kind, draw)
                    if not kind.startswith("no_"):
                        spans.append((kind, len(text), len(text) + len(filled)))
                    part = filled
                text += part
            rows.append((text, spans))
    return rows


_piece = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|\w")
_hit = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]|\bat\b(?=[^.]{1,30}\bdot\b)", re.IGNORECASE)
_cues = frozenset(("at", "dot", "com", "org", "net", "de", "tel", "phone", "call", "fax", "mobile", "card", "visa", "ip",
                   "host", "server", "number", "mail", "isbn", "version", "page", "pages", "order"))
_hex = frozenset("abcdefABCDEF")
_longest_cue = 8


def _shape(piece: str) -> str:
    if piece[0] in "0123456789":
        n = len(piece)
        return f"d{n}" if n <= 4 else "d5-8" if n <= 8 else "d9-12" if n <= 12 else "d13-16" if n <= 16 else "d+"
    if piece[0].isalpha():
        if len(piece) <= _longest_cue and piece.lower() in _cues:
            return piece.lower()
        size = min(len(piece), 5)
        if size < 5 and _hex.issuperset(piece):
            return f"h{size}"
        return ("X" if piece.isupper() else "x" if piece.islower() else "Xx") + ("" if size > 2 else str(size))
    return piece


Window = tuple[list[int], list[int], list[str]]


def _window(text: str, start: int, end: int) -> Window:
    """Starts, ends and features of the pieces in a part of a text."""
    starts, ends, shapes = [], [], []
    last = None
    for m in _piece.finditer(text, start, end):
        gap = "|" if last is None else "" if m.start() == last else "_" if m.start() == last + 1 else "__"
        last = m.end()
        starts.append(m.start())
        ends.append(last)
        shapes.append(gap + _shape(m[0]))
    return starts, ends, shapes


def _features(shapes: list[str]) -> list[tuple[str, ...]]:
    around = ["<<", "<", *shapes, ">", ">>"]
    return [tuple(around[i : i + 5]) for i in range(len(shapes))]


def _expand(five: tuple[str, ...]) -> list[str]:
    """A piece's features: shapes from two before to two after, with their gaps, and neighbours joined."""
    a, b, c, d, e = five
    return [f"0{c}", f"-1{b}", f"+1{d}", f"-2{a}", f"+2{e}", f"-{b}/{c}", f"+{c}/{d}", f"={b}/{c}/{d}", f"-2{a}/{b}/{c}",
            f"+2{c}/{d}/{e}", "bias"]


LABELS = ("O", *(f"{side}-{kind}" for kind in KINDS for side in "BI"))


@dataclass
class Field:
    """Weights of the field: a row per feature, and those between labels. Its size is that of the labelled table."""

    index: dict[str, int]
    weights: np.ndarray
    between: np.ndarray
    _cache: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict, repr=False)

    def emission(self, five: tuple[str, ...]) -> np.ndarray:
        found = self._cache.get(five)
        if found is None:
            if len(self._cache) > 200_000:
                self._cache.clear()
            at = [self.index[name] for name in _expand(five) if name in self.index]
            found = self._cache[five] = self.weights[at].sum(0)
        return found

    def decode(self, windows: list[list[tuple[str, ...]]]) -> list[list[int]]:
        """Best labels of each window. Windows of like length go through Viterbi together."""
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        labels: list[list[int]] = [[] for _ in windows]
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * len(windows[order[end]]) <= 1 << 17:
                end += 1
            self._viterbi([windows[i] for i in order[start:end]], order[start:end], labels)
            start = end
        return labels

    def _viterbi(self, batch: list[list[tuple[str, ...]]], at: list[int], out: list[list[int]]) -> None:
        lengths = np.array([len(w) for w in batch])
        steps, size = int(lengths.max()), len(LABELS)
        scores = np.zeros((len(batch), steps, size))
        for row, window in enumerate(batch):
            for step, five in enumerate(window):
                scores[row, step] = self.emission(five)
        back = np.zeros((len(batch), steps, size), np.int8)
        best = scores[:, 0] + self.between[0]  # before the window is outside
        for step in range(1, steps):
            paths = best[:, :, None] + self.between
            back[:, step] = paths.argmax(1)
            live = (lengths > step)[:, None]
            best = np.where(live, paths.max(1) + scores[:, step], best)
        last = best.argmax(1)
        for row, place in enumerate(at):
            label, path = int(last[row]), []
            for step in range(lengths[row] - 1, -1, -1):
                path.append(label)
                label = int(back[row, step, label])
            out[place] = path[::-1]


def train(rows: list[tuple[str, list[Span]]] | None = None, rounds: int = 60, ridge: float = 0.02,
          rate: float = 0.2) -> Field:
    """Maximum likelihood by gradient steps; all sentences are one padded batch."""
    rows = examples() if rows is None else rows
    index: dict[str, int] = {}
    sentences = []
    for text, spans in rows:
        starts, _, shapes = _window(text, 0, len(text))
        if not starts:
            continue
        labels = []
        for start in starts:
            inside = [(kind, start == first) for kind, first, end in spans if first <= start < end]
            labels.append(LABELS.index(("B-" if inside[0][1] else "I-") + inside[0][0]) if inside else 0)
        sentences.append(([[index.setdefault(n, len(index)) for n in _expand(f)] for f in _features(shapes)], labels))
    size, steps, width = len(LABELS), max(len(y) for _, y in sentences), len(_expand(("",) * 5))
    ids = np.full((len(sentences), steps, width), len(index))
    gold = np.zeros((len(sentences), steps), np.int64)
    live = np.zeros((len(sentences), steps), bool)
    for row, (x, y) in enumerate(sentences):
        ids[row, : len(y)], gold[row, : len(y)], live[row, : len(y)] = x, y, True
    weights, between = np.zeros((len(index) + 1, size)), np.zeros((size, size))
    moments = [np.zeros_like(weights), np.zeros_like(between)]
    hot = np.eye(size)[gold] * live[:, :, None]
    pairs = np.einsum("bsi,bsj->ij", hot[:, :-1], hot[:, 1:]) + np.outer(np.eye(size)[0], hot[:, 0].sum(0))
    for _ in range(rounds):
        emit = weights[ids].sum(2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + between[0]
        for s in range(1, steps):
            step = np.logaddexp.reduce(forward[:, s - 1, :, None] + between, 1) + emit[:, s]
            forward[:, s] = np.where(live[:, s, None], step, forward[:, s - 1])
        for s in range(steps - 2, -1, -1):
            step = np.logaddexp.reduce(between + (emit[:, s + 1] + backward[:, s + 1])[:, None, :], 2)
            backward[:, s] = np.where(live[:, s + 1, None], step, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], 1)[:, None]
        share = np.exp(forward + backward - total[:, :, None]) * live[:, :, None]
        joint = np.exp(forward[:, :-1, :, None] + between + (emit + backward)[:, 1:, None, :] - total[:, :, None, None])
        expected = (joint * live[:, 1:, None, None]).sum((0, 1)) + np.outer(np.eye(size)[0], share[:, 0].sum(0))
        miss = (hot - share).reshape(-1, size)
        slope = np.stack([np.bincount(ids.ravel(), np.repeat(miss[:, label], width), len(weights))
                          for label in range(size)], 1)
        slope[-1] = 0
        for value, gradient, moment in ((weights, slope - ridge * weights, moments[0]),
                                        (between, pairs - expected - ridge * between, moments[1])):
            moment += gradient**2
            value += rate * gradient / np.sqrt(moment + 1e-6)
    return Field(index, weights[:-1], between)


_v6 = re.compile(r"(?=(?:[0-9a-fA-F]*:){2})[0-9a-fA-F:]{4,45}")


def _holds(kind: str, piece: str) -> bool:
    if "\n" in piece:
        return False
    digits = _only_digits(piece)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z@:]", piece)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", piece)
    if kind == "ip":
        parts = [p for p in piece.split(":") if p]
        return bool(_v6.fullmatch(piece)) and 2 <= len(parts) <= 8 and max(map(len, parts)) <= 4 and (
            len(parts) == 8 or "::" in piece)
    return bool(re.search(r"@|\bat\b", piece, re.IGNORECASE)) and bool(re.search(r"\.|\bdot\b", piece, re.IGNORECASE)) \
        and len(piece) <= 100 and not re.search(r"[,;|!?]", piece)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    start = end = -1
    for m in _hit.finditer(text):
        if end >= 0 and m.start() - REACH <= end:
            end = m.end() + REACH
            continue
        if end >= 0:
            yield start, min(end, len(text))
        start, end = max(0, m.start() - REACH), m.end() + REACH
    if end >= 0:
        yield start, min(end, len(text))


def find(texts: list[str | None], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """Per text the patterns' spans and all spans, by kind and start."""
    base = [patterns(text) if text else [] for text in texts]
    places, pieces, windows = [], [], []
    for row, text in enumerate(texts):
        for start, end in _windows(text) if text else ():
            starts, ends, shapes = _window(text, start, end)
            if starts:
                places.append(row)
                pieces.append((starts, ends))
                windows.append(_features(shapes))
    added: list[list[Span]] = [[] for _ in texts]
    for row, (starts, ends), labels in zip(places, pieces, model.decode(windows), strict=True):
        step = 0
        while step < len(labels):
            if not labels[step]:
                step += 1
                continue
            kind, first = LABELS[labels[step]][2:], step
            step += 1
            while step < len(labels) and LABELS[labels[step]] == f"I-{kind}":
                step += 1
            start, end = starts[first], ends[step - 1]
            if _holds(kind, texts[row][start:end]) and not any(a < end and start < b for _, a, b in base[row] + added[row]):
                added[row].append((kind, start, end))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return [(own, sorted(own + more, key=lambda s: (order[s[0]], s[1]))) for own, more in zip(base, added, strict=True)]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))
_arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect(docs: DataFrame, text: str = "text", model: Field | None = None) -> DataFrame:
    """Every row as ``row``, with its ``base`` spans, all ``spans``, and ``redacted``: each span named, as in [email]."""
    model = train() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                found = find(texts, model)
                rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in side] for side in pair] for pair in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], _arrow_span),
                     pa.array([r[1] for r in rows], _arrow_span),
                     pa.array([redact(t, pair[1]) for t, pair in zip(texts, found, strict=True)], pa.string())],
                    ["row", "base", "spans", "redacted"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("base", SPAN), T.StructField("spans", SPAN),
                           T.StructField("redacted", T.StringType())])
    return rows.mapInArrow(run, schema)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets. Spans of two kinds that overlap become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
