"""Byte-level BPE by prefix dynamic programming (operator 13).

Merging by rank has two properties. A prefix of an encoding is the encoding of its own bytes, so each byte prefix of a piece has one
last token; and a row of tokens is an encoding if each two neighbours are. So the last token of a prefix is the one token that ends
there and fits behind the last token of the prefix before it, and nothing that was found changes when bytes are appended."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are split into pieces in blocks of about so many code points, each ending between a character and the blank after it.
BLOCK = 1 << 20
#: Pieces of about so many code points are looked up together.
GROUP = 2 << 20
#: Pieces (beside those of two groups) and, twice as many, pairs of tokens that a worker remembers; beyond that it forgets what it has not met lately.
REMEMBERED = 1 << 17
#: Pieces of more code points are not remembered.
LONG = 100
#: Rank files are read by the driver and sent to the tasks; larger ones are refused.
RANKS_BYTES = 64 << 20
#: Rows of about so many bytes are worked on at a time.
SLICE = 4 << 20


class Vocabulary:
    """Tokens by rank, as tiktoken's files have them (a line: the token in base64, a blank, its rank); ids are the ranks.

    All 256 single bytes must be tokens, and a token of more bytes must arise by merging two of lower rank; else ValueError."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}
        self.token = {rank: token for token, rank in self.ranks.items()}
        if len(self.token) < len(self.ranks) or any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("ranks must differ, and every single byte must have one")
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        # what tokens end with: a token's rank, or -1 for what is none itself
        self.ends = dict.fromkeys((token[i:] for token in self.ranks for i in range(1, len(token))), -1) | self.ranks
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.token}
        self.made = {rank: -1 if len(token) == 1 else rank for rank, token in self.token.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.token):
            token = self.token[rank]
            if len(token) > 1:
                cuts = [(self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)) for k in range(1, len(token))]
                own = [(a, b) for a, b in cuts if self.made[a] < rank and self.made[b] < rank and self.fits(a, b, rank)]
                if len(own) != 1:
                    raise ValueError(f"token {rank} does not arise by merging two tokens of lower rank")
                self.parts[rank] = own[0]
        self.lengths = np.zeros(max(self.token) + 1, np.int64)
        self.lengths[list(self.token)] = [len(t) for t in self.token.values()]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def fits(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether the bytes of tokens a and b, merged by rank (up to `limit`), end up as these two.

        Goes back in time: of the two tokens at the seam the later made is taken apart. They were neighbours until that merge, so a merge
        of the two over the seam must not come before it; of equal ranks the left one comes first."""
        while True:
            over = self.ranks.get(self.token[a] + self.token[b])
            if over is not None and over < limit:
                return False
            if self.made[a] > self.made[b]:
                limit, a = a, self.parts[a][1]
            elif self.made[b] >= 0:
                limit, b = b + 1, self.parts[b][0]
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        """fits(), remembered."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= 2 * REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.fits(a, b)
        return found

    def extended(self, data: bytes, last: list[int], until: int) -> None:
        """Appends the last tokens of the prefixes of data that are longer than len(last) bytes, up to `until` bytes."""
        ends, pairs = self.ends, self.pairs
        for end in range(len(last) + 1, until + 1):
            found, begin = [], end - 1
            while begin >= 0 and (rank := ends.get(data[begin:end])) is not None:
                if rank >= 0:
                    found.append((begin, rank))
                begin -= 1
            while True:
                begin, rank = found.pop()
                if not begin:
                    break
                pair = (last[begin - 1], rank)
                fits = pairs.get(pair)
                if self.follows(*pair) if fits is None else fits:
                    break
            last.append(rank)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's tokens as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            begin = 0
            while begin < len(text):
                cut = _CUT.search(text, begin + BLOCK) if len(text) - begin > BLOCK else None
                end = cut.start() + 1 if cut else len(text)
                held.append((k, self.pattern.findall(text, begin, end)))
                size += end - begin
                begin = end
                if size >= GROUP:
                    self._packed(held, out)
                    held, size = [], 0
        self._packed(held, out)
        return [b"".join(parts) for parts in out]

    def _packed(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        """Appends the ids of each list of pieces to its text's. Pieces met for the first time go in order of their bytes, so that each is an
        edit of the one before, whose table it shares up to where they differ."""
        met = set().union(*(pieces for _, pieces in held))
        if 2 * len(self.pieces) > REMEMBERED:
            self.before, self.pieces = self.pieces, {}  # what is met again comes along
        new = met - self.pieces.keys()
        for piece in new & self.before.keys():
            self.pieces[piece] = self.before[piece]
        table = PrefixTokens(self)
        for piece in sorted(new - self.before.keys()):
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is None:
                table.become(data)
                self.pieces[piece] = b"".join([self.packed[t] for t in table.tokens()])
            else:
                self.pieces[piece] = self.packed[rank]
        for k, pieces in held:
            out[k].append(b"".join([self.pieces[p] for p in pieces]))
        for piece in met:
            if len(piece) > LONG:
                del self.pieces[piece]

    def bytes_of(self, ids: bytes) -> bytes:
        """What the tokens stand for; an id that is no token is an error."""
        return b"".join([self.token[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def edited(self, text: str, ids: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
        """The text with `new` in place of the code points start to end, and its tokens: those before the blank that comes before the
        edit and those from a blank after it stay."""
        before = _CUT_BEFORE.search(text, 0, start)
        first = before.start() + 1 if before else 0
        cut = _CUT.search(text, end)
        after = cut.start() + 1 if cut else len(text)
        places = np.append(0, np.cumsum(self.lengths[np.frombuffer(ids, "<u4")]))
        i, j = np.searchsorted(places, [len(text[:first].encode()), len(text[:after].encode())])
        return text[:start] + new + text[end:], ids[: 4 * i] + self.ids([text[first:start] + new + text[end:after]])[0] + ids[4 * j :]


#: Between a character and a blank a piece always ends, whatever stands before and after; so pieces on both sides are found separately.
_CUT, _CUT_BEFORE = regex.compile(r"\S(?=\s)"), regex.compile(r"(?r)\S(?=\s)")


class PrefixTokens:
    """One piece with the last token of each of its byte prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extended(self.data, self.last, len(self.data))

    def become(self, data: bytes) -> None:
        """Other bytes in place of all; what both begin with stays."""
        same = next((i for i, (x, y) in enumerate(zip(self.data, data, strict=False)) if x != y), min(len(self.data), len(data)))
        del self.last[same:]
        self.data = data
        self.vocabulary.extended(data, self.last, len(data))

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Puts `new` in place of the bytes start to end. Prefixes up to start stay; later ones are found again until as many in a row as the
        longest token has bytes end as before: from there on all do."""
        before, self.data = self.last, self.data[:start] + new + self.data[end:]
        self.last = before[:start]
        by, sure = len(new) - (end - start), self.vocabulary.longest
        self.vocabulary.extended(self.data, self.last, start + len(new))
        while (at := len(self.last)) < len(self.data):
            self.vocabulary.extended(self.data, self.last, min(at + sure, len(self.data)))
            if self.last[at:] == before[at - by : at - by + sure]:
                self.last += before[len(self.last) - by :]

    def tokens(self) -> list[int]:
        """The encoding, read from its end."""
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


@lru_cache(maxsize=4)
def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    """Built once in each worker."""
    return Vocabulary(lines, pattern)


def read_ranks(path: str) -> bytes:
    """A rank file, read by the driver; tasks get its bytes, so they need no file of their own."""
    with open(path, "rb") as f:
        lines = f.read(RANKS_BYTES + 1)
    if len(lines) > RANKS_BYTES:
        raise ValueError(f"{path} has over {RANKS_BYTES} bytes")
    return lines


def _mapped(df: DataFrame, carried: tuple[str, ...], inputs: tuple[str, ...], outputs: dict[str, str], lines: bytes, pattern: str, make) -> DataFrame:
    """`carried` as a struct `row`, and the columns that make(vocabulary, *columns of inputs) gives for some rows at a time."""
    source = df.select(F.struct(*[F.col(c) for c in carried]).alias("row"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(inputs)])
    kinds = [{"binary": (pa.large_binary(), pa.binary()), "string": (pa.large_string(), pa.string()), "long": (pa.int64(), pa.int64())}[kind] for kind in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(lines, pattern)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                first, size, rows = at, 0, []
                while at < batch.num_rows and size < SLICE:
                    rows.append([batch.column(i + 1)[at].as_py() for i in range(len(inputs))])
                    size += sum(len(x) for x in rows[-1] if isinstance(x, bytes | str))
                    at += 1
                columns = [pa.array(c, kind).cast(small) for c, (kind, small) in zip(make(vocabulary, *map(list, zip(*rows, strict=True))), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *columns], ["row", *outputs])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in outputs.items()))


def encode(docs: DataFrame, *carried: str, ranks: bytes, pattern: str) -> DataFrame:
    """(row, n_tokens, ids): `carried` columns as a struct, and the tokens of the whole text, packed as little-endian unsigned 32-bit
    integers (numpy.frombuffer(ids, "<u4")).

    Each match of the pattern is encoded by itself, without special tokens. A null or empty text has no tokens. Rows are encoded one
    by one, so repeated rows, null ids and other columns do no harm; an empty table gives none. A text's ids must stay below 2 GB."""

    def make(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[list, ...]:
        ids = vocabulary.ids([t or "" for t in texts])
        return [len(x) // 4 for x in ids], ids

    return _mapped(docs, carried, ("text",), {"n_tokens": "long", "ids": "binary"}, ranks, pattern, make)


def decode(encoded: DataFrame, *carried: str, ranks: bytes, pattern: str) -> DataFrame:
    """(row, data): `carried` columns as a struct, and the bytes that the packed `ids` stand for (null: none)."""
    return _mapped(encoded, carried, ("ids",), {"data": "binary"}, ranks, pattern, lambda vocabulary, ids: ([vocabulary.bytes_of(x or b"") for x in ids],))


def reencode(edits: DataFrame, *carried: str, ranks: bytes, pattern: str) -> DataFrame:
    """(row, text, ids): for rows with text, ids, start, end and new, the text with `new` in place of its code points start (from 0) to end,
    and its tokens. Only the stretch between the blanks around the edit is encoded again. Nulls are empty, or 0."""

    def one(vocabulary: Vocabulary, text: str | None, ids: bytes | None, start: int | None, end: int | None, new: str | None) -> tuple[str, bytes]:
        text, start = text or "", start or 0
        return vocabulary.edited(text, ids or b"", min(start, len(text)), min(max(start, end or 0), len(text)), new or "")

    def make(vocabulary: Vocabulary, *columns: list) -> Iterator[tuple]:
        return zip(*[one(vocabulary, *row) for row in zip(*columns, strict=True)], strict=True)

    return _mapped(edits, carried, ("text", "ids", "start", "end", "new"), {"text": "string", "ids": "binary"}, ranks, pattern, make)
