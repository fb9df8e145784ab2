"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string is known from the last token of each of its prefixes: the
last token t of a prefix is the only one whose start lies at a prefix whose own last token
may stand before t, that is, whose two tokens joined are encoded as those two again. So
an append only computes the new prefixes, and an edit only those from the edit on until
the old and the new tokens meet at the same place.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, texts_of


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes one piece of bytes at a time; holds no text. Ids are the tokens' ranks."""

    PAIRS, PIECES = 1_000_000, 600_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Tokens that their own bytes are encoded as; others can only stand for a whole piece.
        self.sound = {b: r for b, r in ranks.items() if self.merge(b) == [r]}
        #: By the last two bytes (one, for a single byte), how long sound tokens with that end can be, shortest first.
        ends: dict[bytes, set[int]] = {}
        for b in self.sound:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {end: tuple(sorted(sizes)) for end, sizes in ends.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the neighbouring parts of lowest rank, the leftmost first, until none can be joined."""
        get, none = self.ranks.get, 1 << 62
        parts = [piece[i:i + 1] for i in range(len(piece))]
        joined = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while joined and (rank := min(joined)) < none:
            i = joined.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Appends to ``last`` the last token of each further prefix of ``piece``, up to ``stop`` bytes."""
        sound, lengths, pairs = self.sound, self.lengths, self.pairs
        for end in range(len(last) + 1, (len(piece) if stop is None else stop) + 1):
            one = lengths.get(piece[end - 1:end], ())
            for size in one + lengths.get(piece[end - 2:end], ()) if end > 1 else one:
                start = end - size
                if start < 0:
                    continue
                token = sound.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    ok = pairs.get((last[start - 1], token))
                    if not (self.may_follow(last[start - 1], token) if ok is None else ok):
                        continue
                last.append(token)  # no other token fits, so the order of the sizes does not matter
                break
            else:
                raise ValueError(f"no token ends at byte {end}; the ranks lack single bytes")
        return last

    def path(self, last: list[int]) -> list[int]:
        """The tokens of the whole prefix, from the back."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int]]:
        """Bytes and last tokens after replacing ``removed`` bytes at ``at``; prefixes before the edit are kept,
        and those after it from where as many last tokens as the longest token has bytes agree with the old ones."""
        new = piece[:at] + inserted + piece[at + removed:]
        out, shift, same = list(last[:at]), len(inserted) - removed, 0
        while len(out) < len(new):
            self.extend(new, out, len(out) + 1)
            old = len(out) - shift
            same = same + 1 if len(out) > at + len(inserted) and old > 0 and last[old - 1] == out[-1] and len(
                self.tokens[out[-1]]) <= len(out) - at - len(inserted) else 0
            if same >= self.longest:
                return new, out + last[old:]
        return new, out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token stands for itself, as in the common libraries."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.path(self.extend(piece, []))


class TextEncoder:
    """Splits texts by the pattern and encodes each piece; pieces met before are kept, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.find = PrefixEncoder(ranks), regex.compile(pattern).findall
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = outer.encoder.encode(piece.encode("utf-8", "surrogatepass"))
                if len(self) >= PrefixEncoder.PIECES:
                    self.clear()
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    self[piece] = packed
                return packed

        self.pieces = Pieces()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=1)
def coder_of(ranks_path: str, pattern: str) -> TextEncoder:
    """One encoder per Python process: a task goes on with the pieces that earlier tasks have met."""
    return TextEncoder(read_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, digests of the ids and of the bytes they decode to, and the ids if asked for.

    Null texts count as empty (no tokens). ``ranks_path`` is read by each task from where
    the vocabulary is installed on every machine. Repeated rows and null doc_ids give a
    row each.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                packed = [coder.encode_packed(t) for t in texts_of(part.column(1))]
                cols = [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([sha256(p).hexdigest() for p in packed]),
                        pa.array([sha256(coder.decode_packed(p)).hexdigest() for p in packed])]
                yield pa.record_batch(cols + [pa.array(packed, pa.binary())] * keep_ids,
                                      [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
