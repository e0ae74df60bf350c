"""Prefix trie of conversations and Hamming trie of fingerprints, against brute force."""
import hashlib
import random
import zlib

import numpy as np
from xxhash import xxh64_intdigest

from quarry.llm import hamming_trie, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, name string"  # clashing extra columns


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def brute_trie(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} by plain dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members}

    def below(p):
        return [p] + [x for q in kids[p] for x in below(q)]

    out = {}
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


def report(df, **options):
    got = prefix_trie.trie_report(df, **options).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
            for r in got}


def conversations(seed, convs=50, longest=14):
    rng = random.Random(seed)
    said = [(rng.choice(["user", "assistant"]), "wört " * rng.randint(0, 3)) for _ in range(3)]
    rows = []
    for c in rng.sample(range(200), convs):
        for turn in range(rng.choice([1, 2, 3, 9, longest])):
            rows.append((c, turn, *rng.choice(said)))
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(12)]  # one common conversation
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force_over_shard_sizes(spark):
    rows = conversations(1)
    want = brute_trie(rows)
    for band, width, most in ((64, 256, 1000), (4, 3, 2)):  # many cuts, spilling queues
        assert report(turns(spark, rows), band=band, width=width, most=most) == want


def test_trie_defined_cases(spark):
    rows = [(1, None, None, None), (1, None, "user", "a"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "x"),
            (2, 5, "b", "t"), (2, 5, "a", "t"), (2, 5, "a", "s"), (5, 0, "user", "long " * 50_000), (6, 0, "user", "é"), (11, 1, "", "")]
    assert report(turns(spark, rows)) == brute_trie(rows)
    assert report(turns(spark, [])) == {}
    lone = [(7, k, "user", "x") for k in range(5)]  # its family's first is absent, all its turns may be skipped
    assert report(turns(spark, lone)) == brute_trie(lone)


def test_long_conversation_crosses_bands(spark):
    rows = [(5, k, "user", f"{k % 7}") for k in range(130)] + [(10, k, "user", f"{k % 7}") for k in range(100)]
    assert report(turns(spark, rows), band=16) == brute_trie(rows)


def test_forward_queue_spills_and_gives_every_message():
    rng, queue, sent = random.Random(2), prefix_trie.ForwardQueue(most=5), {}
    nodes = [(d, c) for d in range(6) for c in range(8)]
    for _ in range(300):
        d, c = rng.choice(nodes)
        queue.send(d, c, 1, d + c)
        n, s = sent.get((d, c), (0, 0))
        sent[d, c] = (n + 1, s + d + c)
    assert queue.runs
    for d, c in sorted(nodes, key=lambda x: (-x[0], x[1])):
        assert queue.take(d, c) == sent.get((d, c), (0, 0))
    queue.close()


def test_end_digests_join_parts_of_any_size(spark):
    ends = spark.range(500).selectExpr("7L as conv_id", "2L as depth", "id * 3 as member").unionByName(
        spark.createDataFrame([(9, 1, 9)], "conv_id long, depth long, member long"))
    want = hashlib.sha256(",".join(str(3 * k) for k in range(500)).encode()).hexdigest()
    got = {tuple(r) for r in prefix_trie.end_digests(ends, chunk=20).collect()}
    assert got == {(7, 2, want), (9, 1, hashlib.sha256(b"9").hexdigest())}


# ------------------------------------------------------------------ fingerprints

DOCS = "doc_id long, text string, fp string, rep string"


def brute_print(text):
    words = [w for w in _lower(text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_components(prints, budget=2):
    """{id: component} of [(id, print)] by comparing all pairs; an id may stand twice."""
    label = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for i, x in prints:
            for j, y in prints:
                if i != j and (x ^ y).bit_count() <= budget and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    return label


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}É" for k in range(30)] + ["Be", "of"]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 60]))
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\t".join(copy) if rng.random() < .2 else " ".join(copy).upper().replace("É", "É"))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (None, "alone"), (903, texts[0]), (903, texts[0])]
    rng.shuffle(rows)
    want = brute_components([(i, brute_print(t)) for i, t in rows if i is not None])
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    for most in (1024, 4):  # one task, and a trie split over tasks
        got = hamming_trie.simhash_groups(df, most=most).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{brute_print(t):016x}") for i, t in rows}
        assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert hamming_trie.simhash_groups(df.limit(0)).count() == 0


def test_an_id_on_two_texts_joins_their_groups(spark):
    df = spark.createDataFrame([(1, "one two three", "", ""), (2, "four five six seven", "", ""), (2, "one two three", "", "")], DOCS)
    assert {r.component_id for r in hamming_trie.simhash_groups(df).collect()} == {1}


def test_walk_finds_all_pairs_between_subtries():
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for c in centres:
        for _ in range(120):
            x = c
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    own = np.array(values, "u8")
    i, j = hamming_trie.walk(own, len(own), 0, 2)
    want = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if (values[a] ^ values[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    left, right = [v for v in values if v >> 62 == 0], [v for v in values if v >> 62 == 1]
    both = np.array(left + right, "u8")
    i, j = hamming_trie.walk(both, len(left), 2, 2)
    assert set(zip(i.tolist(), j.tolist())) == {(a, len(left) + b) for a, x in enumerate(left) for b, y in enumerate(right)
                                               if (x ^ y).bit_count() <= 2}


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(5_000)).encode()
    whole = hamming_trie.simhash(text)
    monkeypatch.setattr(hamming_trie, "PART", 100)
    assert hamming_trie.simhash(text) == whole == brute_print(text.decode())
