"""Alignment of two tokenizers' ids by the byte offsets at which their tokens end.

Both tokenizers read the same bytes, so a token is a byte range and each id sequence an
increasing array of end offsets. Offsets where both arrays have an end cut the text into
groups; the tokens that end there are linked. The arrays are compared at the current index
shift with steps that double, so one-to-one stretches are jumped; where they part, the two
sides move on locally until they meet again, and the shift is updated.

A text is cut into units, each a space with what follows up to the next cut. A cut is made
only before a space that stands between two non-space characters, of which the second is no
white space: tokenizer A (byte-level) starts a new pre-token there, and no piece of tokenizer
B holds its space mark after another character, so no token of either crosses a cut. Units
repeat, so a worker encodes and aligns each once and keeps the answer in a bounded table;
unknown units are encoded many in a row, and once the table is full, whenever they come,
with the same result. ``tests/llm`` compares this with whole texts.

Linked id pairs are counted over the corpus. Of two tokens that end together one's bytes are
a suffix of the other's, so there are fewer pairs than bytes in both vocabularies (under a
million for the usual sizes): the table of pair counts is bounded whatever the corpus, and is
broadcast to score each document's links.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte
for byte, have no tokens (zeros, empty digest); special tokens' strings inside texts are plain
text; rows without an id and repeated rows are documents of their own; an empty table gives
an empty result; other columns are ignored; a long text yields its units in slices.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pieces import objects
from quarry.llm.skew import materialise, text_batches, worker_cache

KNOWN_UNITS = 150_000  # units kept per worker
SLICE = 4 << 20  # bytes of text handled at a time
STRETCH = 1 << 15  # characters of unknown units encoded in one call
#: what a unit may start with for a cut before it: certainly no white space
_START = "^[!-~\u00a1-\u167f\u2010-\u2027\u2030-\u205e\u3001-\U0010ffff]"

Unit = tuple[int, int, int, bytes, bytes]  # tokens of A and B, groups, the groups as text, linked pairs


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i] == b[j], by diagonal run skipping; a and b increase strictly."""
    n, m, al, bl = len(a), len(b), a.tolist(), b.tolist()
    starts, shifts, sizes = [], [], []
    i = j = 0
    while i < n and j < m:
        x, y = al[i], bl[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:  # a stretch at shift j - i: look 1, 2, 4, ... ends ahead
            run, step = 1, 1
            while i + run < n and j + run < m:
                if step < 8:
                    if al[i + run] != bl[j + run]:
                        break
                    run, step = run + 1, step + 1
                    continue
                part = a[i + run:i + run + step]
                other = b[j + run:j + run + len(part)]
                same = part[:len(other)] == other
                if not same.all():
                    run += int(same.argmin())
                    break
                run, step = run + len(same), 2 * step
            starts.append(i)
            shifts.append(j - i)
            sizes.append(run)
            i, j = i + run, j + run
    size = np.array(sizes, "i8")
    before = np.cumsum(size) - size
    at = np.repeat(np.array(starts, "i8") - before, size) + np.arange(int(size.sum()))
    return at, at + np.repeat(np.array(shifts, "i8"), size)


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairEncoder:
    """Both tokenizers of a worker, and what it knows of units."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.base = self.b.vocab_size()
        self.b_bytes = [self._piece_bytes(k) for k in range(self.base)]
        self.a_size, self.b_size = (np.fromiter(map(len, t), "i8", len(t)) for t in (self.a_bytes, self.b_bytes))
        self.names = [b"%d" % k for k in range(max(len(self.a_bytes), self.base))]
        self.known: dict[bytes, Unit | None] = {}

    def _piece_bytes(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def _ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text that starts with a space (which B adds itself); None if the bytes do not come back."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1) if len(text) > 1 else []
        data = text.encode()
        if b"".join([self.a_bytes[k] for k in a]) != data or b"".join([self.b_bytes[k] for k in b]) != data:
            return None
        return a, b

    def align(self, text: str, cuts: list[int] | None = None) -> list[Unit] | None:
        """The units of a text that starts with a space: ``cuts`` are their byte ends (default: one unit)."""
        ids = self._ids(text)
        if ids is None:
            return None
        a, b = ids
        i, j = common_ends(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        ends = np.cumsum(self.a_size[a])[i]
        cuts = cuts or [int(ends[-1])]
        at = np.searchsorted(ends, cuts)
        if at[-1] >= len(ends) or (ends[at] != cuts).any():
            return None
        pairs = (np.array(a, "i8")[i] * self.base + np.array(b, "i8")[j]).astype("<i8")
        left, right, last = (i + 1).tolist(), (j + 1).tolist(), (at + 1).tolist()
        out, names = [], self.names
        g = x = y = 0
        for end in last:
            x0, y0, first, said = x, y, g, []
            while g < end:
                u, v = left[g], right[g]
                said.append(b",".join([names[k] for k in a[x:u]]) + b"|" + b",".join([names[k] for k in b[y:v]]))
                x, y, g = u, v, g + 1
            out.append((x - x0, y - y0, g - first, b";".join(said), pairs[first:g].tobytes()))
        return out

    def units(self, pieces: list[bytes]) -> list[Unit | None]:
        """The unit of each piece (a unit without its first space); None where the bytes do not come back."""
        got = [self.known.get(p, 0) for p in pieces]
        missing = [k for k, v in enumerate(got) if v == 0]
        made: dict[bytes, Unit | None] = {}
        run: list[bytes] = []
        size = 0
        for p in [pieces[k] for k in missing] + [None]:
            if p is None or size > STRETCH:
                made.update(self._stretch(run))
                run, size = [], 0
            if p is not None:
                word = p[:1] and (33 <= p[0] <= 126 or 0xC3 <= p[0] <= 0xDF or 0xE4 <= p[0] <= 0xED)
                if not word or p.endswith(b" "):  # white space could join its neighbours in a row
                    made.update(self._stretch([p]))
                else:
                    run.append(p)
                    size += len(p) + 1
        if len(self.known) + len(made) <= KNOWN_UNITS:
            self.known.update(made)
        for k in missing:
            got[k] = made[pieces[k]]
        return got

    def _stretch(self, run: list[bytes]) -> dict[bytes, Unit | None]:
        """Units of pieces encoded in a row; one by one if some do not come back byte for byte."""
        if not run:
            return {}
        cuts = np.cumsum([len(p) + 1 for p in run]).tolist()
        units = self.align((b" " + b" ".join(run)).decode(), cuts)
        if units is None and len(run) > 1:
            return {p: u for part in run for p, u in self._stretch([part]).items()}
        return dict(zip(run, units or [None]))


def pair_encoder(a_path: str, b_path: str) -> PairEncoder:
    """One per worker process and pair of files."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoders = worker_cache("align_encoders", dict)
    if (a_path, b_path) not in encoders:
        encoders[a_path, b_path] = PairEncoder(a_path, b_path)
    return encoders[a_path, b_path]


Row = tuple[int, int, int, bytes, np.ndarray]


def aligned_texts(texts: pa.Array, enc: PairEncoder) -> Iterator[tuple[int, Row | None]]:
    """(row, its tokens of A and B, groups, groups as text, linked pairs) for each non-empty text of a column."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")
    grown, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(grown, grown[at] + SLICE, "right")) - 1)
        rows = at + np.flatnonzero(sizes[at:end])
        at = end
        if len(rows):
            yield from _aligned_slice(texts.take(pa.array(rows)), rows, enc)


def _aligned_slice(texts: pa.Array, rows: np.ndarray, enc: PairEncoder) -> Iterator[tuple[int, Row | None]]:
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy().astype("i8")
    ends = ends - ends[0]
    starts = pc.match_substring_regex(coded.dictionary, _START).to_numpy(zero_copy_only=False)[codes]
    empty = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0)[codes]
    joined = ~starts
    joined[1:] |= empty[:-1]
    joined[ends[:-1]] = False  # a text's first piece starts a unit in any case
    upto = np.concatenate([[0], np.cumsum(joined)])[ends]
    plain = upto[1:] == upto[:-1]

    used = np.unique(codes[np.repeat(plain, np.diff(ends))])
    units: list[Unit | None] = [None] * len(coded.dictionary)
    pieces = objects(coded.dictionary.take(pa.array(used)).cast(pa.binary()))
    for k, unit in zip(used.tolist(), enc.units(pieces)):
        units[k] = unit
    table = _table(units)
    for k in range(len(rows)):
        if plain[k]:
            row = _joined(table, codes[ends[k]:ends[k + 1]])
        else:
            row = _joined(_table(enc.units(cut := glued_units(texts[k].as_py()))), np.arange(len(cut)))
        if row is None:  # some unit did not come back; the whole text decides
            whole = enc.align(" " + texts[k].as_py())
            row = whole and (*whole[0][:4], np.frombuffer(whole[0][4], "<i8"))
        yield int(rows[k]), row
    pa.default_memory_pool().release_unused()


def glued_units(text: str) -> list[bytes]:
    """The units of a text (each without its first space) where cuts are not all before a word."""
    import re
    start, out, after_empty = re.compile(_START), [], False
    for p in text.split(" "):
        if out and (after_empty or not start.match(p)):
            out[-1] += " " + p
        else:
            out.append(p)
        after_empty = not p
    return [p.encode() for p in out]


def _table(units: list[Unit | None]):
    known = [u or (0, 0, 0, b"", b"") for u in units]
    counts = np.array([u[:3] for u in known], "i8").reshape(-1, 3)
    size = np.fromiter((len(u[4]) // 8 for u in known), "i8", len(known))
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    return (counts, np.array([u is None for u in units], bool), [u[3] for u in known], size, begin,
            np.frombuffer(b"".join([u[4] for u in known]), "<i8"))


def _joined(table, codes: np.ndarray) -> Row | None:
    counts, bad, said, size, begin, pairs = table
    if bad[codes].any():
        return None
    n = size[codes]
    before = np.cumsum(n) - n
    at = np.repeat(begin[codes] - before, n) + np.arange(int(n.sum()))
    return (*counts[codes].sum(axis=0).tolist(), b";".join([said[c] for c in codes.tolist()]), pairs[at])


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): links holds a pair code (A id * size of B + B id) each."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]

    def batch_of(ids: pa.Array, got: list[Row | None]) -> pa.RecordBatch:
        kept = [r or (0, 0, 0, None, np.empty(0, "<i8")) for r in got]
        offsets = np.concatenate([[0], np.cumsum([len(r[4]) for r in kept])]).astype("i4")
        links = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[4] for r in kept])))
        said = ["" if r[3] is None else hashlib.sha256(r[3]).hexdigest() for r in kept]
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array([r[k] for r in kept], pa.int64()) for k in range(3)), pa.array(said, pa.string()), links], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pair_encoder(a_path, b_path)
        for batch in batches:
            ids, got, first, size = batch.column("doc_id"), [], 0, 0
            found = aligned_texts(batch.column("text").cast(pa.string()), enc)
            row, value = next(found, (None, None))
            for k in range(batch.num_rows):  # rows without text stand between
                got.append(value if row == k else None)
                if row == k:
                    size += 0 if value is None else len(value[4]) + len(value[3]) // 8
                    row, value = next(found, (None, None))
                if size >= 1 << 20:
                    yield batch_of(ids.slice(first, len(got)), got)
                    got, first, size = [], k + 1, 0
            if got:
                yield batch_of(ids.slice(first, len(got)), got)

    rows = text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def pair_counts(rows: DataFrame, base: int) -> DataFrame:
    """(pair, count, best): corpus-wide links of each id pair, and whether no pair of its B id has more."""
    counts = materialise(rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("count")), "pair-counts")
    top = counts.groupBy((F.col("pair") % base).alias("_b")).agg(F.max("count").alias("_top"))
    return (counts.withColumn("_b", F.col("pair") % base).join(top, "_b")
            .select("pair", "count", (F.col("count") == F.col("_top")).cast("long").alias("best")))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: token, group and link counts, link scores by corpus-wide counts, digest of the groups."""
    from sentencepiece import SentencePieceProcessor
    base = SentencePieceProcessor(model_file=b_path).vocab_size()
    rows = materialise(aligned_rows(docs, a_path, b_path, id_col, text_col)
                       .withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")
    pairs = materialise(pair_counts(rows, base), "pair-scores")
    sums = (rows.select("_row", F.explode("links").alias("pair")).join(F.broadcast(pairs), "pair")
            .groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")))
    return rows.select("_row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256").join(
        sums, "_row", "left").select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
