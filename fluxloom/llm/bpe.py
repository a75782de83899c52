"""Byte-level BPE with one global shuffle of distinct words.

Texts are cut into pre-tokens once and packed. Rows are dealt once into blocks of about ``block_bytes`` of text by a
hash of key and text. A block lists its distinct
pre-tokens, cut into parts by a hash of the word; the same part of all blocks meets in one task, which encodes every
distinct word once. The ids go back to their blocks, where every document is put together from its pre-tokens'
positions. Only the blocks' distinct words and their ids travel, as compressed lists: a word that is everywhere is a
row per block, not per occurrence. The two uses of the blocks read the same shuffle files.

The ranks are read from a file on the driver (its path is a parameter) and broadcast: a vocabulary has a fixed size
(checked: `MAX_RANKS`). Every match of the pattern is encoded by itself, by the byte pair merges of tiktoken, without
special tokens. Decoding takes each id's bytes from the table of tokens; an id that is not in the table raises.

A null text counts as empty: no ids, no bytes. Texts are encoded whole, in one row. Repeated rows repeat results. Rows travel as a
struct, their columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.common import slices, texts_of

BLOCK_BYTES = 6 << 20
# Words of a block that share a part, about.
PART_WORDS = 4096
MAX_RANKS = 1 << 20
# Documents decoded at a time.
DECODE_ROWS = 256


class Vocabulary:
    """Token bytes by rank, and the pattern of pre-tokens. Workers build the encoder once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_RANKS:
            raise ValueError(f"more than {MAX_RANKS} tokens")
        self.ranks, self.pattern = ranks, pattern

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    @property
    def words(self):
        if "_words" not in self.__dict__:
            import regex

            self._words = regex.compile(self.pattern)
        return self._words

    def encode_word(self, word: str) -> list[int]:
        if "_encoding" not in self.__dict__:
            import tiktoken

            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding._encode_single_piece(word.encode("utf-8", "surrogatepass"))

    @property
    def tokens(self) -> np.ndarray:
        """Bytes by id; None where there is no token."""
        if "_tokens" not in self.__dict__:
            self._tokens = np.full(max(self.ranks.values(), default=-1) + 1, None, object)
            for token, rank in self.ranks.items():
                self._tokens[rank] = token
        return self._tokens


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Reads a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return Vocabulary(ranks, pattern)


def _pack_text(pieces: list[str], text: str) -> bytes:
    """Pieces of a text joined by a character that the text has not, which stands first."""
    mark = next(c for c in map(chr, range(0x110000)) if c not in text)
    return zstandard.compress((mark + mark.join(pieces)).encode("utf-8", "surrogatepass"), 3) if pieces else b""


def _pieces(packed: bytes) -> list[str]:
    if not packed:
        return []
    text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
    return text[1:].split(text[0])


def _by_part(words, parts: int) -> dict[int, list[str]]:
    """Words by part, sorted: both sides of the exchange order them so."""
    found: dict[int, list[str]] = {}
    for word in words:
        found.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % parts, []).append(word)
    return {part: sorted(found[part]) for part in sorted(found)}


def _ids_of(words: list[str], vocab: Vocabulary, known: dict[str, list[int]]) -> bytes:
    ids = []
    for word in words:
        found = known.get(word)
        if found is None:
            found = known[word] = vocab.encode_word(word)
        ids.append(found)
    flat = np.array([i for own in ids for i in own], np.uint32)
    counts = np.array([len(ids), *map(len, ids)], np.uint32)
    return zstandard.compress(np.concatenate((counts, flat)).tobytes(), 3)


def encode(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row without its text as ``row``, with its ``ids``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = max(1, ceil(total / block_bytes))
    # Distinct words grow more slowly than the text, so this many parts keep a task's share of them bounded.
    parts = max(16, ceil(total / (PART_WORDS * 256)))
    shared = spark.sparkContext.broadcast(vocab)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int").alias("block"),
        F.struct(*others).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [_pack_text(vocab.words.findall(t), t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())],
                                                 ["block", "row", "pieces"])

    schema = T.StructType([rows.schema["block"], rows.schema["row"], T.StructField("pieces", T.BinaryType())])
    dealt = rows.mapInArrow(cut, schema).repartition(blocks, "block")

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[str]] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0), batch.column(2), strict=True):
                held.setdefault(block.as_py(), set()).update(_pieces(packed.as_py()))
        for block in sorted(held):
            rows = _by_part(held.pop(block), parts)
            yield pa.record_batch({
                "part": pa.array(list(rows), pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                "words": pa.array([_pack_text(words, "".join(words)) for words in rows.values()], pa.binary())})

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, at, known = shared.value, None, {}
        for batch in batches:
            out = []
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if part != at:  # rows are sorted by part
                    at, known = part, {}
                out.append(_ids_of(_pieces(packed.as_py()), vocab, known))
            yield pa.record_batch({"part": batch.column(0), "block": batch.column(1), "ids": pa.array(out, pa.binary())})

    def put_together(docs: pa.Table, found: pa.Table) -> pa.Table:
        places: dict[str, int] = {}
        rows = [np.array([places.setdefault(w, len(places)) for w in _pieces(packed.as_py())], np.int32)
                for packed in docs.column("pieces")]
        counts, starts = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        packed = dict(zip(found.column("part").to_pylist(), found.column("ids").to_pylist(), strict=True))
        flat, total = [], 0
        for part, words in _by_part(places, parts).items():
            numbers = np.frombuffer(zstandard.decompress(packed[part]), np.uint32)
            own, ids = numbers[1 : numbers[0] + 1], numbers[numbers[0] + 1 :]
            at = np.array([places[w] for w in words])
            counts[at], starts[at] = own, total + np.cumsum(own) - own
            flat.append(ids)
            total += len(ids)
        ids = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        lists = []
        for row in rows:
            n = counts[row]
            ends = np.cumsum(n)
            lists.append(ids[np.repeat(starts[row] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return pa.table({"row": docs.column("row"), "ids": pa.array(lists, pa.list_(pa.int32()))})

    words = dealt.mapInArrow(list_words, "part int, block int, words binary")
    coded = words.repartition("part").sortWithinPartitions("part").mapInArrow(encode_words, "part int, block int, ids binary")
    schema = T.StructType([dealt.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return dealt.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(put_together, schema)


def decode(coded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every row with its ids and the ``bytes`` that they stand for."""
    shared = coded.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and flat.min() < 0:
                    raise ValueError("negative ids")
                pieces = tokens[flat].tolist()
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                out = [b"".join(pieces[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())],
                                                 ["row", "ids", "bytes"])

    schema = T.StructType([coded.schema["row"], coded.schema["ids"], T.StructField("bytes", T.BinaryType())])
    return coded.select("row", "ids").mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    """A vocabulary of the public tokenizers that are installed beside Python."""
    import public_tokenizers

    return vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)
