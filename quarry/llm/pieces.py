"""Space-separated pieces of a text column as codes into the distinct pieces of a slice."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

SLICE_BYTES = 5 << 20


@dataclass(frozen=True)
class Pieces:
    """Rows [first, first + rows) of a column: the pieces of row k are codes[ends[k]:ends[k + 1]]."""
    first: int
    rows: int
    ends: np.ndarray
    codes: np.ndarray
    distinct: pa.Array


def objects(values: pa.Array) -> list:
    """The values as Python objects (bytes of a binary array, str of a string array)."""
    return values.to_numpy(zero_copy_only=False).tolist()


def split_column(column: pa.Array, prepare: Callable[[pa.Array], pa.Array] | None = None,
                 limit: int = SLICE_BYTES) -> Iterator[Pieces]:
    """Cut texts (null as empty) at ASCII white space, about ``limit`` bytes at a time.

    ``prepare`` is applied to the texts of a slice first. Empty pieces may stand at the ends
    of a text; callers give them no weight.
    """
    column = column.cast(pa.string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    grown = np.concatenate([[0], np.cumsum(sizes.astype("i8"))])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(grown, grown[at] + limit, "right")) - 1)
        texts = pc.fill_null(column.slice(at, end - at), "")
        lists = pc.ascii_split_whitespace(prepare(texts) if prepare else texts)
        coded = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_numpy().astype("i8")
        yield Pieces(at, end - at, ends - ends[0], coded.indices.to_numpy(zero_copy_only=False),
                     coded.dictionary)
        at = end
    pa.default_memory_pool().release_unused()


def known_values(distinct: list[bytes], known: dict, make: Callable[[list[bytes]], dict], most: int) -> list:
    """The value of each distinct piece; ``known`` keeps up to ``most`` answers, others are made anew."""
    got = list(map(known.get, distinct))
    new = [p for p, v in zip(distinct, got) if v is None]
    if new:
        made = make(new)
        got = [made[p] if v is None else v for p, v in zip(distinct, got)]
        if len(known) + len(made) <= most:
            known.update(made)
    return got


def hashed_rows(column: pa.Array, known: dict[bytes, int], hash64: Callable[[bytes], int], most: int,
                prepare: Callable[[pa.Array], pa.Array] | None = None) -> Iterator[np.ndarray]:
    """Per row, the non-zero 64-bit hashes of its pieces in order (0: the piece does not count)."""
    for part in split_column(column, prepare):
        distinct = objects(part.distinct.cast(pa.binary()))
        values = np.array(known_values(distinct, known, lambda new: {p: hash64(p) for p in new}, most), "u8")
        each = values[part.codes] if len(values) else np.empty(0, "u8")
        counts = each != 0
        ends = np.concatenate([[0], np.cumsum(counts)])[part.ends]
        each = each[counts]
        for k in range(part.rows):
            yield each[ends[k]:ends[k + 1]]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
