"""Fill-in-the-middle transformation of texts held as ropes (operator 12)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units of a text: a word with the blanks before it, or blanks that no word follows.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Units of a leaf.
LEAF = 256


@dataclass(slots=True)
class Rope:
    """A leaf with bytes, or two subtrees; both keep how many units and code points they have."""

    units: int
    chars: int
    data: bytes = b""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(data: bytes) -> Rope:
    return Rope(sum(1 for _ in UNIT.finditer(data)), len(data.decode()), data)


def concat(*ropes: Rope) -> Rope:
    """One rope after another."""
    whole = EMPTY
    for r in ropes:
        if whole.chars and r.chars:
            whole = Rope(whole.units + r.units, whole.chars + r.chars, left=whole, right=r)
        elif r.chars:
            whole = r
    return whole


def balanced(leaves: list[Rope]) -> Rope:
    while len(leaves) > 1:
        leaves = [concat(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def split(rope: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The first `rank` units or chars, and the rest. Units are counted within leaves, so a cut by chars may start a unit anew."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if rope.left is None:
        if by == "units":
            at = next(islice(UNIT.finditer(rope.data), rank - 1, None)).end()
        else:
            at = len(rope.data.decode()[:rank].encode())
        return leaf(rope.data[:at]), leaf(rope.data[at:])
    before = getattr(rope.left, by)
    if rank <= before:
        a, b = split(rope.left, rank, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - before, by)
    return concat(rope.left, a), b


def leaves(rope: Rope) -> Iterator[bytes]:
    todo = [rope]
    while todo:
        r = todo.pop()
        if r.left is None:
            yield r.data
        else:
            todo += [r.right, r.left]


def whole(rope: Rope) -> bytes:
    return b"".join(leaves(rope))


def ropes(data: np.ndarray, at: np.ndarray, wanted: Callable[[int, int], bool]) -> Iterator[tuple[int, int, Rope | None]]:
    """(text, units, rope) of each of many texts; a rope only where wanted(text, units)."""
    _, end, first = B.words(data, at, B.BLANKS)
    lead = (data & 0xC0) != 0x80
    for t in range(len(at) - 1):
        a, b = int(at[t]), int(at[t + 1])
        words = int(first[t + 1] - first[t])
        units = words + (b > a and bool(B.BLANKS[data[b - 1]]))
        if not wanted(t, units):
            yield t, units, None
            continue
        cuts = np.append(end[first[t] + LEAF - 1 : first[t + 1] : LEAF], b)
        cuts = np.append(a, cuts[np.append(True, np.diff(cuts) > 0)]) if b > a else np.array([a])
        own, n = [], len(cuts) - 1
        chars = np.add.reduceat(lead[:b], cuts[:-1], dtype=np.int64).tolist() if n else []
        for i in range(n):
            own.append(Rope(min(LEAF, units - i * LEAF) if i < n - 1 else units - i * LEAF, chars[i], data[cuts[i] : cuts[i + 1]].tobytes()))
        yield t, units, balanced(own)


def _numbers(seed: int, doc_id: object) -> list[int]:
    """The first four groups of eight hexadecimal digits of a hash of seed and doc_id (null: nothing after the colon)."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(rope: Rope, first: int, second: int, spm: bool) -> tuple[Rope, int, int]:
    """The rope cut behind `first` and `second` units and put together with sentinels; code points of the prefix and of the middle."""
    rest, suffix = split(rope, second, "units")
    prefix, middle = split(rest, first, "units")
    p, s, m = (concat(Rope(1, 3, mark), part) for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    return concat(s, p, m) if spm else concat(p, s, m), prefix.chars, middle.chars


def restored(rope: Rope, text: str, spm: bool) -> Rope:
    """The inverse: cuts at the sentinels of the whole text (`text` is the rope's). The parts hold none, and none arises at a seam, so
    the first of each is the one set."""
    marks = [x.decode() for x in ((SUFFIX, PREFIX, MIDDLE) if spm else (PREFIX, SUFFIX, MIDDLE))]
    second = text.index(marks[1])
    third = text.index(marks[2], second)
    parts = []
    for begin, end in ((0, second), (second, third), (third, len(text))):
        own, rope = split(rope, end - begin, "chars")
        parts.append(split(own, 3, "chars")[1])
    return concat(parts[1], parts[2], parts[0]) if spm else concat(parts[0], parts[2], parts[1])


def _texts(df: DataFrame, carried: tuple[str, ...], text: str, more: tuple[str, ...], schema: str, columns: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, pa.Array]]) -> DataFrame:
    source = df.select(F.struct(*[F.col(c) for c in carried]).alias("row"), F.col(text).alias("text"), *[F.col(c) for c in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                made = columns(part, data, at)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], ["row", *made])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, {schema}")


def fill_in_middle(docs: DataFrame, *carried: str, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): `carried` columns as a struct, the number of units of the text, the form
    and the text in that form.

    Units are matched from the left, see UNIT. Hashes of seed and doc_id choose the two cuts, whether the text is transformed (in
    `percent` of 100 cases) and whether its suffix comes first (spm, in `spm_percent` of these) or its prefix (psm). A text that is null, empty
    or holds a sentinel stays plain; prefix_chars and middle_chars are null there, and a null text's output is empty. Rows are
    handled one by one: repeated rows get the same form, rows without doc_id share one hash, other columns only travel in `row`. An
    empty table gives none. A text is one row of a task; it must stay below 2 GB."""
    marks = re.compile(b"|".join((PREFIX, SUFFIX, MIDDLE)))

    def columns(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
        ids = part.column(2).to_pylist()
        h = [_numbers(seed, x) for x in ids]
        raw = data.tobytes()
        plain = lambda t: at[t] == at[t + 1] or h[t][2] % 100 >= percent or marks.search(raw, at[t], at[t + 1]) is not None
        n, form, chars, out = [], [], [], []
        for t, units, rope in ropes(data, at, lambda t, _: not plain(t)):
            n.append(units)
            if rope is None:
                form.append("plain")
                chars.append((None, None))
                out.append(raw[at[t] : at[t + 1]])
                continue
            first, second = sorted((h[t][0] % (units + 1), h[t][1] % (units + 1)))
            spm = h[t][3] % 100 < spm_percent
            made, *own = rearranged(rope, first, second, spm)
            form.append("spm" if spm else "psm")
            chars.append(own)
            out.append(whole(made))
        long = lambda x: pa.array(x, pa.int64())
        return {"n": long(n), "form": pa.array(form, pa.string()), "prefix_chars": long([x for x, _ in chars]), "middle_chars": long([x for _, x in chars]), "output": pa.array(out, pa.binary()).cast(pa.string())}

    return _texts(docs, carried, "text", ("doc_id",), "n long, form string, prefix_chars long, middle_chars long, output string", columns)


def restore(made: DataFrame, *carried: str) -> DataFrame:
    """(row, restored): `carried` columns as a struct, and the text from `output` and `form` alone. A null output is empty."""

    def columns(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
        form = part.column(2).to_pylist()
        out = []
        for t, _, rope in ropes(data, at, lambda t, _: form[t] in ("psm", "spm")):
            raw = data[at[t] : at[t + 1]].tobytes()
            out.append(raw if rope is None else whole(restored(rope, raw.decode(), form[t] == "spm")))
        return {"restored": pa.array(out, pa.binary()).cast(pa.string())}

    return _texts(made, carried, "output", ("form",), "restored string", columns)
