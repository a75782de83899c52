"""URL filters: all glob rules run at once over every URL, as bits of one Shift-And automaton.

A URL's canonical form is ``.`` + host (A-Z in lower case) + path, without scheme, query and fragment. In a glob ``*``
stands for any characters but ``/``, ``**`` for any characters; all others stand for themselves. A host rule (host, path)
is the glob ``*.host/path**``: it fits its host, all subdomains, and every path that starts with its own.

Every glob is a row of bits: a start, then one bit per byte. A step shifts all bits by one, over the borders of
64-bit words, keeps those whose byte has come, and keeps bits in front of a star where they are. The bits of start are in no
byte's mask, so nothing runs from one glob into the next. A task takes the URLs of a batch together, one byte of
each per step, and packs of at most ``PACK_BITS`` bits one after the other, so masks stay small however many rules there are.

Of the host rules that fit, the longest decides, then of other globs the one with the most literal characters;
where two are equally long, one that blocks. A URL that none fits gets the default verdict.

A null URL, or one without ``://``, has an empty host and path. Rows that repeat a URL are judged alike. An empty table gives no
rows. Columns of the input cannot clash: rows travel as one struct. Nothing is shuffled; only the URL is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bits that are simulated together; masks of a pack take 512 times its bytes.
PACK_BITS = 8_192
# With fewer URLs left, the rest of each is read alone, its bits in one integer.
FEW_URLS = 8

# The rules of the registered query.
HOST_RULES = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"),
              (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))
# What no host rule decides: words that hosts of unwanted pages carry, and paths without an article.
GLOBS = ((BLOCK, "*casino**"), (BLOCK, "*poker**"), (BLOCK, "*-bets.**"), (BLOCK, "*porn**"), (BLOCK, "*.adult-**"),
         (BLOCK, "*-pills.**"), (BLOCK, "*.spam-**"), (BLOCK, "**/cgi-bin/**"), (BLOCK, "**/wp-login.php"),
         (BLOCK, "*/cart/*/checkout**"))


def tokens(glob: str) -> list[int | str]:
    """Bytes and stars of a glob; a run of stars is the widest of them."""
    found: list[int | str] = []
    for piece in re.findall(r"\*+|[^*]+", glob):
        if piece[0] == "*":
            found.append("*" if piece == "*" else "**")
        else:
            found += piece.encode()
    return found


@dataclass
class Pack:
    """Globs as bits: where each ends, and per byte the bits that it lets in and those that it leaves where they are."""

    globs: list[str]
    bits: int = 0
    start: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    enter: list[list[int]] = field(default_factory=lambda: [[] for _ in range(256)])
    stay: list[list[int]] = field(default_factory=lambda: [[] for _ in range(256)])

    def __post_init__(self):
        for glob in self.globs:
            self.start.append(self.bits)
            for token in tokens(glob):
                if isinstance(token, int):
                    self.bits += 1
                    self.enter[token].append(self.bits)
                else:
                    for byte in range(256):
                        if token == "**" or byte != 0x2F:
                            self.stay[byte].append(self.bits)
            self.last.append(self.bits)
            self.bits += 1

    def _words(self, places: list[int]) -> np.ndarray:
        row = np.zeros(-(-self.bits // 64), np.uint64)
        at = np.array(places, np.int64)
        np.bitwise_or.at(row, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        return row

    @cached_property
    def masks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (self._words(self.start), np.stack([self._words(p) for p in self.enter]),
                np.stack([self._words(p) for p in self.stay]))

    @cached_property
    def integers(self) -> tuple[list[int], list[int]]:
        return tuple([int.from_bytes(row.tobytes(), "little") for row in masks] for masks in self.masks[1:])

    def run(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which globs fit which URLs. URLs are stretches of ``flat``, the longest first."""
        start, enter, stay = self.masks
        state = np.tile(start, (len(starts), 1))
        live, step = len(starts), 0
        longest = int(lengths[0]) if live else 0
        while step < longest:
            live = int(np.searchsorted(-lengths[:live], -step))  # those longer than ``step``
            if live < FEW_URLS:
                break
            byte, bits = flat[starts[:live] + step], state[:live]
            moved = bits << np.uint64(1)
            moved[:, 1:] |= bits[:, :-1] >> np.uint64(63)
            state[:live] = (moved & enter[byte]) | (bits & stay[byte])
            step += 1
        if step < longest:
            enters, stays = self.integers
            for row in range(live):
                bits = int.from_bytes(state[row].tobytes(), "little")
                for byte in flat[starts[row] + step:starts[row] + lengths[row]].tobytes():
                    bits = ((bits << 1) & enters[byte]) | (bits & stays[byte])
                state[row] = np.frombuffer(bits.to_bytes(8 * state.shape[1], "little"), np.uint64)
        last = np.array(self.last, np.int64)
        return ((state[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


@dataclass
class Filters:
    """Rules in the order in which they decide."""

    rules: tuple[tuple[str, str, str], ...] = HOST_RULES
    globs: tuple[tuple[str, str], ...] = GLOBS
    default: str = ALLOW

    @cached_property
    def ordered(self) -> list[tuple[str, str | None, str]]:
        """(verdict, name of the host rule or null, glob)."""
        hosts = sorted(self.rules, key=lambda r: (-len(r[1] + r[2]), r[0] != BLOCK, r[1], r[2]))
        others = sorted(self.globs, key=lambda g: (-len(g[1].replace("*", "")), g[0] != BLOCK, g[1]))
        return [(v, host + path, f"*.{host}{path}**") for v, host, path in hosts] + [(v, None, g) for v, g in others]

    @cached_property
    def packs(self) -> list[tuple[int, Pack]]:
        """Packs and the place of their first rule. A glob of more than ``PACK_BITS`` is a pack of its own."""
        found, held, bits, first = [], [], 0, 0
        for at, (_, _, glob) in enumerate(self.ordered):
            size = len(tokens(glob)) + 1
            if held and bits + size > PACK_BITS:
                found.append((first, Pack(held)))
                held, bits, first = [], 0, at
            held.append(glob)
            bits += size
        return found + ([(first, Pack(held))] if held else [])

    def first(self, urls: list[bytes]) -> np.ndarray:
        """Place of the rule that decides each URL; -1 if none fits."""
        lengths = np.array([len(u) for u in urls], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(urls), np.uint8)
        order = np.argsort(-lengths, kind="stable")
        best = np.full(len(urls), -1)
        for first, pack in self.packs:
            fits = pack.run(flat, starts[order], lengths[order])
            new = np.where(fits.any(1), first + fits.argmax(1), -1)
            best[order] = np.where(best[order] >= 0, best[order], new)
        return best


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the module's first lines define them."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, filters: Filters = Filters(), url: str = "url") -> DataFrame:
    """Every row as ``row``, with ``host``, ``path``, the host rule that decides (or null) and the ``verdict``."""
    host, path = parts(F.col(url))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = filters.ordered
        names = [name for _, name, _ in rules] + [None]
        verdicts = [verdict for verdict, _, _ in rules] + [filters.default]
        for batch in batches:
            urls = [f".{host}{path}".encode() for host, path in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = filters.first(urls)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[at] for at in found], pa.string()),
                 pa.array([verdicts[at] for at in found], pa.string())], ["row", "host", "path", "rule", "verdict"])

    schema = T.StructType([rows.schema["row"], *[T.StructField(name, T.StringType()) for name in (
        "host", "path", "rule", "verdict")]])
    return rows.mapInArrow(run, schema)
