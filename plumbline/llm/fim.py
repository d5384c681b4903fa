"""Fill-in-middle transformation over an indexable skip list.

A text is cut into tokens. A skip list over them carries two widths on every lane: how many tokens a step passes and
how many code points. Descending to a token rank adds up both, so the code point at which a cut falls is found
in logarithmic steps without walking the text. Prefix, middle and suffix are then put in the order of the form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import carried, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
PLAIN_FROM = 50  # of 100: share of the texts that are rearranged
SPM_BELOW = 80  # of 100: share of the rearranged ones whose suffix comes first
FAN = 16  # nodes of a lane that one node of the next lane passes


def token_widths(points: np.ndarray) -> np.ndarray:
    """Code points of every token: white space before a run of other characters belongs to it, white space at the end stands alone."""
    if not len(points):
        return np.zeros(0, np.int64)
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.append(np.flatnonzero(white[1:] & ~white[:-1]) + 1, len(points))
    return np.diff(ends, prepend=0)


class SkipList:
    """Lanes of nodes over unit widths; the lowest lane has one node for each token, each lane above one for FAN nodes."""

    def __init__(self, widths: np.ndarray, fan: int = FAN):
        self.units, self.points = [np.ones(len(widths), np.int64)], [np.asarray(widths, np.int64)]
        while len(self.units[-1]) > fan:
            starts = np.arange(0, len(self.units[-1]), fan)
            self.units.append(np.add.reduceat(self.units[-1], starts))
            self.points.append(np.add.reduceat(self.points[-1], starts))
        self.fan = fan

    def __len__(self) -> int:
        return len(self.units[0])

    def offset(self, rank: int) -> int:
        """Code points before the token of that rank; the rank behind the last token gives the length of the text."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        node = units = points = 0
        for lane in range(len(self.units) - 1, -1, -1):
            unit, point = self.units[lane], self.points[lane]
            while node < len(unit) and units + unit[node] <= rank:
                units, points, node = units + int(unit[node]), points + int(point[node]), node + 1
            node *= self.fan
        return points


@dataclass(frozen=True)
class Transformed:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform(name: str, text: str | None, seed: int = SEED) -> Transformed:
    """The text in the form that the hash of seed and name says."""
    text = text or ""
    tokens = SkipList(token_widths(np.frombuffer(text.encode("utf-32-le"), "<u4")))
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
        return Transformed(n, "plain", None, None, text)
    low, high = (tokens.offset(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SPM_BELOW:
        return Transformed(n, "spm", len(prefix), len(middle), "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Transformed(n, "psm", len(prefix), len(middle), "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def original(output: str, form: str) -> str:
    """The text before the transformation, from its output and form alone; the parts hold no marker, so the first of each is the one set."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, rest = output.removeprefix(first).split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, *carry: str, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The columns ``carry`` of every document with n (tokens), form, prefix_chars, middle_chars and ``output``, the rearranged text.

    ``id_col`` and ``seed`` decide form and cuts; a null id has the empty name. A null or empty text has no tokens and stays
    plain, as does one that holds a marker; both lengths are then null. Whole texts are read, one at a time. Repeated rows get equal
    outputs; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [transform(n or "", t, seed) for n, t in zip(part.column("name").to_pylist(), part.column("text").to_pylist())]
                made = [pa.array([getattr(x, c) for x in found], kind) for c, kind in FIELDS.items()]
                yield pa.record_batch([*(part.column(c) for c in names), *made], names=[*names, *FIELDS])

    columns, kinds, names = carried(docs, carry)
    rows = docs.select(docs[id_col].cast("string").alias("name"), "text", *columns)
    return rows.mapInArrow(run, kinds + "n long, form string, prefix_chars long, middle_chars long, output string").withColumnsRenamed(names)


FIELDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def restore(transformed: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` with ``restored``, the text rebuilt from the columns output and form; a null output counts as empty, a null form as plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "output"):
                texts = [original(o or "", f or "plain") for o, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist())]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "restored"])

    columns, kinds, names = carried(transformed, carry)
    return transformed.select("output", "form", *columns).mapInArrow(run, kinds + "restored string").withColumnsRenamed(names)
