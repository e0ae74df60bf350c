"""Alignment of two tokenizers against whole-text encoding and a plain walk over the ends."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import token_alignment as al

P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
DOCS = "doc_id long, text string, links string, pair long, _row long"  # clashing extra columns


@pytest.fixture(scope="module")
def enc():
    return al.PairEncoder(A, B)


def brute(enc, text):
    """(ids of A, ids of B, groups, linked pairs) of a whole text by comparing all ends; None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    a = enc.a.encode(" " + text, add_special_tokens=False).ids
    b = enc.b.encode(text)
    if b"".join(enc.a_bytes[k] for k in a) != data or b"".join(enc.b_bytes[k] for k in b) != data:
        return None
    ends_a, ends_b = np.cumsum([len(enc.a_bytes[k]) for k in a]).tolist(), np.cumsum([len(enc.b_bytes[k]) for k in b]).tolist()
    at_b = {e: j for j, e in enumerate(ends_b)}
    groups, pairs, x, y = [], [], 0, 0
    for i, e in enumerate(ends_a):
        if e in at_b:
            j = at_b[e]
            groups.append((a[x:i + 1], b[y:j + 1]))
            pairs.append((a[i], b[j]))
            x, y = i + 1, j + 1
    return a, b, groups, pairs


def brute_report(enc, rows):
    whole = [(i, brute(enc, t)) for i, t in rows]
    count = Counter(p for _, w in whole if w for p in w[3])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, w in whole:
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in w[2])
        out.append((i, len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(count[p] == top[p[1]] for p in w[3]),
                    sum(count[p] for p in w[3]), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\nb", "a \n b\n\n", "\n\n a", "\t\ttab  \t x", "x y  z",
       "　wide 　 space", "café naïve", "café é", "日本語 テキスト", "🙂🙂 👍🏽 x", "<|endoftext|> stop", "</s> <s> <unk> <0x41>",
       "lower▁one eighth block", "it's we'll I'D 'quoted' can't", "1234567 12,345.67", "a" * 300, "-" * 50 + " " + "=" * 70, "x\r\ny\r\n z",
       "don't  stop", "nul\u0000byte", "﻿bom", "e​zero width", "́lead mark", "word ́ mark", "a b   c"]


def test_report_equals_whole_text_encoding(spark, enc):
    rng = random.Random(6)
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:40]
    parts = [t for t in ODD if t] + real[:5] + [" ", "  ", "\n", " \n "]
    mixed = ["".join(rng.choices(parts, k=rng.randint(2, 6)))[:4_000] for _ in range(60)]
    rows = list(enumerate(ODD + real + mixed)) + [(None, "no id"), (3, "same id"), (3, "same id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in al.alignment_report(df, A, B).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert got == brute_report(enc, rows)
    assert sum(1 for r in got if r[1]) > 100  # most texts have tokens
    assert al.alignment_report(df.limit(0), A, B).count() == 0


def test_common_ends_equals_a_plain_walk():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([0, 1, 5, 40, 400])
        a = sorted(rng.sample(range(1, 3 * n + 2), n))
        b = sorted(set(a[:n // 2]) | set(rng.sample(range(1, 3 * n + 2), n // 3))) if rng.random() < .7 else list(a)
        i, j = al.common_ends(np.array(a, "i8"), np.array(b, "i8"))
        at = {e: k for k, e in enumerate(b)}
        assert list(zip(i.tolist(), j.tolist())) == [(k, at[e]) for k, e in enumerate(a) if e in at]


def test_long_text_and_small_slices_give_the_same(enc, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(500)]
    text = " ".join(rng.choices(words, k=20_000)) + "\n  end  "
    texts = pa.array(["one two", text, None, "three"])
    whole = brute(enc, text)
    for slice_, stretch, known in ((al.SLICE, al.STRETCH, al.KNOWN_UNITS), (1_000, 50, 0)):
        monkeypatch.setattr(al, "SLICE", slice_)
        monkeypatch.setattr(al, "STRETCH", stretch)
        monkeypatch.setattr(al, "KNOWN_UNITS", known)
        enc.known.clear()
        got = dict(al.aligned_texts(texts, enc))
        assert sorted(got) == [0, 1, 3]
        n_a, n_b, n_groups, said, pairs = got[1]
        assert (n_a, n_b, n_groups) == (len(whole[0]), len(whole[1]), len(whole[2]))
        assert pairs.tolist() == [a * enc.base + b for a, b in whole[3]]


def test_byte_letters_cover_every_byte_once():
    assert sorted(al.byte_letters().values()) == list(range(256))


def test_pair_table_is_bounded_by_the_vocabularies(enc):
    """Of two tokens that end together one is a suffix of the other, and each has few suffixes."""
    assert sum(map(len, enc.a_bytes)) + sum(map(len, enc.b_bytes)) < 1_000_000
