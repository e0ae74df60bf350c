"""Defined cases and brute-force comparisons of the training-data operators."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import (
    chat_trees, decontaminate, exact_dedup, near_dup, packing, secret_scan, skew, token_ids, toxicity, unit_dedup,
    url_rules,
)
from quarry.llm.components import components

DOCS = "doc_id long, text string, _n long, _text string, comp string"  # clashing extra columns


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], DOCS)


def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "alpha beta")]


# ------------------------------------------------------------------ helpers

def test_salted_join_splits_a_hot_key(spark):
    left = spark.range(6000).select((F.when(F.col("id") < 4000, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = skew.salted_join(left, right, ["k"], [F.col("id")], "n", 6000)
    assert out.count() == 6000 and out.where("k = 0").select("n").distinct().collect()[0][0] == 4000
    assert skew.salted_join(left, right.limit(0), ["k"], [F.col("id")], "n", 0, how="left").count() == 6000


def test_bitmap_keeps_every_member(spark):
    a = spark.range(5000).withColumn("k", F.md5(F.col("id").cast("string")))
    b = a.where("id % 50 = 0")
    bitmap = skew.key_bitmap(b, "k")
    inside, outside = skew.maybe_in(a, "k", bitmap), skew.maybe_in(a, "k", bitmap, invert=True)
    assert b.join(inside, "k", "left_anti").count() == 0
    assert inside.count() + outside.count() == 5000 and inside.count() < 200


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(600)] + [(7, 7), (900, 901)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {i: 0 for i in range(41)} | {200 + i: 100 for i in range(600)} | {100: 100, 900: 900, 901: 900}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ exact copies

@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups_odd_rows(spark, keep):
    got = sorted(exact_dedup.exact_groups(docs(spark, ODD), keep=keep)
                 .select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    best = {"min": min, "max": max}[keep]
    want = []
    for i, t in ODD:
        same = [j for j, u in ODD if (u or "") == (t or "")]
        top = best(j for j in same if j is not None)
        want.append((i, top, len(same), i == top))
    assert [tuple(r) for r in got] == sorted(want, key=str)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_groups_with_colliding_hash(spark):
    rows = [(i, "ab"[i % 2] * (1 + i % 3)) for i in range(60)]
    weak = exact_dedup.exact_groups(docs(spark, rows), digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 4, "0")))
    strong = exact_dedup.exact_groups(docs(spark, rows))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(weak.select(cols).collect()) == sorted(strong.select(cols).collect())


def test_drop_copies_keeps_columns_and_one_row(spark):
    out = exact_dedup.drop_copies(docs(spark, ODD))
    assert out.columns == ["doc_id", "text", "_n", "_text", "comp"]
    assert sorted((r[0], r[1]) for r in out.collect()) == [(1, None), (3, "  \n\t "), (4, "alpha beta")]


# ------------------------------------------------------------------ secrets

def test_secret_positions(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    text = f"é password = 'hunter22x' {key} and deadbeef00112233445566778899aabb token=token:abcdef"
    row = secret_scan.secret_report(docs(spark, [(1, text), (2, None), (3, "token=abc")])).orderBy("doc_id").collect()
    at = text.index("password")
    assert row[0]["n_assign"] == 1 and row[0]["n_access"] == 1 and row[0]["n_hex"] == 1
    a, k, h = (text.index(x) for x in ("password", key, "deadbeef"))
    base = f"assign:{at}:{text.index('x' + chr(39)) + 1},access:{k}:{k + 20},hex:{h}:{h + 32}"
    assert a == at and row[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert row[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and row[1]["spans"] == "" == row[2]["spans"]


def test_entropy_windows_equal_direct_computation(spark):
    rng = random.Random(5)
    cls = secret_scan.ENTROPY_CLASSES[1]
    values = ["".join(rng.choice(cls.alphabet[: rng.choice([4, 12, 64])]) for _ in range(rng.randint(20, 70))) for _ in range(60)]
    values.append("aB3" * 5 + "".join(rng.sample(cls.alphabet, 25)) + "c" * 30)

    def bits(s):
        p = np.array([s.count(c) for c in set(s)]) / len(s)
        return float(-(p * np.log2(p)).sum())

    got = spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", secret_scan.hot_stretch(F.col("v"), cls).alias("h")).collect()
    for r in got:
        hits = [i for i in range(len(r["v"]) - cls.window + 1) if bits(r["v"][i:i + cls.window]) >= cls.bits - 1e-9]
        assert (r["h"]["first"], r["h"]["last"]) == ((hits[0], hits[-1]) if hits else (None, None))


def test_allowed_candidates_are_suppressed(spark):
    rows = [(1, "x" + "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8" + "EXAMPLE"), (2, "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"), (3, "abcdefghijklmnopqrstuvwxyz")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_report(docs(spark, rows)).collect()}
    assert got[1] == "" and got[3] == "" and got[2].startswith("entropy_base64:0:")


# ------------------------------------------------------------------ conversations

def test_reply_trees_choose_the_best_branch(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9),
            (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", None, 0.2), (2, 1, 99, None, "\\l</turn>\n### x", 1.0),
            (None, 1, None, "user", "no tree", None), (1, 2, 1, "assistant", "bad", 0.1)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = chat_trees.chosen_paths(nodes)
    got = {(r["tree"], r["depth"]): r["node"] for r in paths.collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (1, 3): 4, (1, 4): 5, (2, 1): 1, (None, 1): 1}
    out = {r["tree"]: r for r in chat_trees.format_paths(nodes, paths).select(
        "*", chat_trees.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["t"]] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in out[2]["t"]] == [("", "\\l</turn>\n### x")]
    learned = [out[1]["formatted"][s["start"]:s["end"]] for s in out[1]["loss"]]
    assert learned == ["good", ""]
    assert chat_trees.chosen_paths(nodes, top=2).where("tree = 1").select("path").distinct().count() == 2


def test_long_thread_and_cycle(spark):
    n = 700
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"),
                                  F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    got = chat_trees.chosen_paths(nodes)
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [(i, i + 1) for i in range(n)]
    loop = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "tree long, node long, parent long, score double")
    with pytest.raises(ValueError):
        chat_trees.chosen_paths(loop)


def test_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", "s")]
    nodes = chat_trees.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_trees.format_paths(nodes, chat_trees.chosen_paths(nodes)).first()["formatted"]
    assert out == "### system\ns</turn>\n### user\na</turn>\n### user\na</turn>\n### assistant\nb</turn>\n"
    empty = chat_trees.linear_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat_trees.chosen_paths(empty).count() == 0


def test_messages_of_equal_and_null_turns_stay(spark):
    rows = [(1, 1, "user", "second"), (1, 1, "user", "first"), (1, 0, "user", "q"), (1, 1, "assistant", "third"),
            (1, None, "system", "same"), (1, None, "system", "same"), (1, None, "system", "other"), (1, -5, "user", None),
            (None, 3, "user", "a"), (None, 3, "user", "b")]
    nodes = chat_trees.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_trees.format_paths(nodes, chat_trees.chosen_paths(nodes))
    got = {r["tree"]: [t["text"] for t in r["t"]]
           for r in out.select("tree", chat_trees.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: ["other", "same", "same", "", "q", "third", "first", "second"], None: ["a", "b"]}


@pytest.mark.parametrize("text", ["\\", "\\l", "\\h##", "### ", "####", "</turn>", "</</turn>turn>", "\\n", "a\\s###</turn>\n"])
def test_escape_round_trip(spark, text):
    e, u = spark.createDataFrame([(text,)], "t string").select(
        chat_trees.escape(F.col("t")).alias("e"), chat_trees.unescape(chat_trees.escape(F.col("t"))).alias("u")).first()
    assert u == text and "###" not in e and "</turn>" not in e


# ------------------------------------------------------------------ urls

def test_url_parts_and_base_rules(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/x?q=/y#z"), (2, "https://a.example.com/en/"), (3, "https://x.net/es/1"),
            (4, "https://x.net/de/1"), (5, "nothing"), (6, None), (7, "http://host?x"), (None, "http://com/"), (8, "http://notexample.com/EN/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, none).collect()}
    assert got == {1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"),
                   3: ("x.net", "/es/1", "net/es/", "block"), 4: ("x.net", "/de/1", None, "allow"), 5: ("", "", None, "allow"),
                   6: ("", "", None, "allow"), 7: ("host", "", None, "allow"), None: ("com", "/", "com/", "allow"),
                   8: ("notexample.com", "/EN/", "com/", "allow")}


def test_mined_rules_are_found_and_matched(spark):
    pages = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}.org/{'ads' if i % 8 == 0 else 'news'}/{i}") for i in range(400)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(0, 400)]
    out = url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                               spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert got == {i: "block" if i % 8 == 0 else "allow" for i in range(400)}
    assert {r[0] for r in out.where("verdict = 'block'").select("mined_rule").collect()} == {"path=ads"}


def test_rule_of_five_tokens_is_kept(spark):
    bit = lambda i, k, a, b: a if i >> k & 1 else b
    pages = [(i, f"http://site.org/{bit(i, 0, 'a', 'x')}/{bit(i, 1, 'b', 'y')}/{bit(i, 2, 'c', 'z')}/"
                 f"p.{bit(i, 3, 'php', 'html')}?{bit(i, 4, 'q', 'r')}=1") for i in range(800)]
    labels = [(i, 1, int(i % 32 == 31)) for i in range(800)]
    out = url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                               spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == set(range(31, 800, 32))


# ------------------------------------------------------------------ tokens and packing

TEXTS = [None, "", "\x0b\x0c a\x1cb\x85c\u2028d\xa0e", "it's DON'T 'S <|endoftext|>x ÉCOLE é \u0301a İSTANBUL ΣΑΣ 10000 ½ ﬁ",
         "a\u0301 \u0301b 'T\t's 'll H\u0331 h\u0331.", "x... y.,! z?! é. ½. 3.5, \"q.\" (r),", "A" * 5000, "word " * 9000]


def test_token_files_equal_whole_text_encoding(spark, scratch):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabulary())
    rows = [(None, "no id")] + list(enumerate(TEXTS)) + [(99, "same"), (99, "same")]
    out = scratch + "/ids"
    token_ids.write_token_files(docs(spark, rows).repartition(3), out, vocabulary(), end_id=1, files=4)
    got = sorted((tuple(r) for r in token_ids.token_index(spark, out).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_ids.read_token_rows(spark, out, ["n_tokens"], F.col("doc_id") == 99).count() == 2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabulary())
    rng = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(rng.choices(["the", "cat", "sat", "on", "mat"], k=rng.randint(1, 90)))) for k in range(150)]
    placed = packing.pack_documents(docs(spark, rows), vocabulary(), capacity=128, end_id=2, with_ids=True).cache()
    got = placed.toPandas()
    for i, t in rows:
        mine = got[got.doc_id == i].sort_values("start")
        ids = [x for part in mine.ids for x in part]
        assert ids == whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (mine.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(mine.ids, mine.ids_crc32))
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 128
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    assert used.sum() / (128 * len(used)) > 0.85
    seqs = packing.sequences(placed, 128).toPandas()
    assert set(seqs.ids.map(len)) <= {128} | {2 ** k for k in range(8)}
    assert packing.pack_documents(docs(spark, []), vocabulary()).count() == 0


def test_plan_places_every_piece_near_the_bound():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 300, 64)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    plan = packing.plan_sequences(sizes, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * sizes).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.02 * max((sizes * demand).sum() / 64, demand[sizes > 32].sum()) + 2


# ------------------------------------------------------------------ repeated passages

def test_repeated_passage_inside_lines(spark):
    passage = " ".join(f"Sentence number {w} goes on and on here." for w in "abcdefghij")
    rows = [(1, "Own words first. " + passage), (2, "Something else and " + passage + " tail words"), (3, "A clean text. Short."),
            (4, "Short. Another one."), (5, None), (6, "")]
    out = {r["doc_id"]: r for r in unit_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert out[2]["n_removed"] == 9 and out[2]["text"].endswith("tail words") and "number b" not in out[2]["text"]
    whole = dict(rows)[2]
    assert [whole[s["start"]:s["end"]].strip() for s in out[2]["spans"]][0] == "Sentence number b goes on and on here."
    assert all(out[k]["n_removed"] == 0 and out[k]["text"] == dict(rows)[k] for k in (1, 3, 4, 5, 6))


@pytest.mark.parametrize("between", ["\n", "\n\n", "\r\n", "\r\n\r\n", " \n \n", "\n...\n"])
def test_run_goes_over_blank_lines(spark, between):
    paragraphs = [" ".join(f"{name}{k}" for k in range(25)) + "." for name in ("alpha", "beta", "gamma")]
    passage = between.join(paragraphs)
    rows = [(1, passage), (2, f"Own words.{between}{passage}{between}Other words."),
            (3, between.join([paragraphs[0], "Words in between.", paragraphs[1]]))]
    out = {r["doc_id"]: r for r in unit_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert {i: r["n_removed"] for i, r in out.items()} == {1: 0, 2: 3, 3: 2}  # repeated paragraphs, however short
    assert out[3]["text"].split() == f"{between}Words in between.{between}".split()
    assert out[2]["removed_words"] == 75 and out[2]["text"].split() == f"Own words.{between * 4}Other words.".split()


def test_repeats_odd_rows(spark):
    long = "One two three four five six seven eight nine ten. " * 1 + "Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. Twenty-one two three four five six seven eight nine thirty."
    rows = [(None, long), (1, long), (2, long), (2, long)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in unit_dedup.repeat_report(docs(spark, rows)).collect()), key=str)
    assert got == [(1, 0), (2, 1), (2, 1), (None, 1)]  # one whole line of three sentences
    assert unit_dedup.repeat_report(docs(spark, [])).count() == 0


def test_short_paragraphs_and_texts_without_blanks(spark):
    paragraph = " ".join(f"word{k}" for k in range(25)) + "."
    chinese = "这是一个没有空格的句子" * 3
    rows = [(1, f"First own.\n{paragraph}"), (2, f"{paragraph}\nSecond own."), (3, f"Third own.\n\n{paragraph.upper()}  \nTail."),
            (4, chinese + "\n自己的"), (5, "开头\n" + chinese), (6, "Same line"), (7, "same  LINE"), (8, "Same line and more"), (9, "!!!\n...\n")]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in unit_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got[2] == (1, "\nSecond own.") and got[3] == (1, "Third own.\n\n\nTail.") and got[5] == (1, "开头\n") and got[7] == (1, "")
    assert all(got[k] == (0, dict(rows)[k]) for k in (1, 4, 6, 8, 9))


def test_columns_named_like_the_added_ones_are_replaced(spark):
    df = spark.createDataFrame([(1, "a line", "x", 5, "b"), (2, "a line", "y", 6, "c")], "doc_id long, text string, spans string, n_removed int, _bucket string")
    out = unit_dedup.remove_repeats(df)
    assert sorted(out.columns) == ["_bucket", "doc_id", "n_removed", "removed_words", "spans", "text"]
    assert {(r["doc_id"], r["n_removed"], r["_bucket"]) for r in out.collect()} == {(1, 0, "b"), (2, 1, "c")}


def _brute_repeats(rows, min_chars=150):
    """{doc: ordered spans} by plain loops over ``text_units``."""
    units = [(norm, doc, start, line, place, end, whole) for doc, text in rows
             for norm, line, place, start, end, _, whole in unit_dedup.text_units(text)]
    first = {}
    for norm, doc, start, *_ in units:
        first[norm] = min(first.get(norm, (doc, start)), (doc, start))
    out = {}
    for doc, _ in rows:
        later = [u for u in units if u[1] == doc and first[u[0]] != (doc, u[2])]
        lines = [u for u in later if u[4] < 0]
        runs = []
        for u in sorted((u for u in later if u[4] >= 0), key=lambda u: u[4]):
            if runs and u[4] - runs[-1][-1][4] == 1:
                runs[-1].append(u)
            else:
                runs.append([u])
        covered = {u[3] for u in lines}
        kept = [u for run in runs for u in run if u[3] not in covered and (u[6] or sum(x[5] - x[2] for x in run) >= min_chars)]
        out[doc] = sorted((u[2], u[5]) for u in lines + kept)
    return out


def test_removed_spans_equal_plain_loops(spark):
    rng = random.Random(12)
    sentences = [" ".join(rng.choices("one two three four five six seven".split(), k=rng.randint(1, 9))) + rng.choice([".", "!", ""]) for _ in range(25)]
    rows = [(d, "\n".join(" ".join(rng.choices(sentences, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 6)))) for d in range(60)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"] or []] for r in unit_dedup.remove_repeats(docs(spark, rows), min_chars=60).collect()}
    assert got == _brute_repeats(rows, 60)


# ------------------------------------------------------------------ near copies

def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append((i, {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            both = len(s & u)
            if s and u and 100 * both >= percent * (len(s) + len(u) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [256, 12])
def test_near_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(k, edited(rng, base, rng.randrange(0, 7))) for k in range(90)]
    rows += [(1000 + k, " ".join(f"z{rng.randrange(300)}" for _ in range(60))) for k in range(30)]
    rows += [(2000, None), (2001, " "), (2002, "two words"), (2003, "TWO\tWords"), (2004, "a b c d"), (2005, "a b c d")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs(spark, rows), k=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_groups_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "x y z u v w"), (4, "x y z u v w"), (5, "q")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_groups(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)], key=str)
    assert near_dup.near_groups(docs(spark, [])).count() == 0
    assert near_dup.drop_near_copies(docs(spark, rows)).columns == ["doc_id", "text", "_n", "_text", "comp"]


# ------------------------------------------------------------------ benchmark

def test_leaks_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 70)))) for k in range(40)] + [(40, None), (41, ""), (42, "tiny item")]
    rows, want = [], set()
    for k in range(120):
        words = [word() for _ in range(rng.randint(5, 400))]
        if k % 4 == 0:
            item = items[k % 40][1].split()
            if k % 8 == 0 and len(item) > 52:
                item[len(item) // 2] = "changed"  # one word of many: still above 0.8
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
            want.add((k, k % 40))
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "a tiny item here")]
    want.add((502, 42))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    several = decontaminate.find_leaks(docs(spark, rows), bench, block_items=10)
    assert {(r["doc_id"], r["item_id"]) for r in several.collect()} == want
    left = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert {r[0] for r in left.select("doc_id").collect()} == {i for i, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_similarity_is_plain_for_repeated_items_and_equal_over_passes(spark):
    item = [f"w{k}x{k * 7 % 13}" for k in range(59)]
    changed = item[:30] + ["changed"] + item[31:]
    other = [f"o{k}y{k * 5 % 11}" for k in range(40)]
    shared = item[:20] + [f"s{k}" for k in range(39)]  # 16 shingles in common with the item
    bench = spark.createDataFrame(
        [(k, " ".join(item).upper() if k % 2 else " ".join(item)) for k in range(10)]
        + [(10, " ".join(shared)), (11, " ".join(other))], "item_id long, text string")
    rows = [(1, " ".join(["a", "b", *changed, "c"])), (2, " ".join(shared)), (3, " ".join(other[:38]))]
    found = [{(r["doc_id"], r["item_id"]): (r["first_word"], round(r["similarity"], 12)) for r in
              decontaminate.find_leaks(docs(spark, rows), bench, block_items=n).collect()} for n in (5_000, 4)]
    assert found[0] == found[1]
    assert {k for k in found[0] if k[0] == 1} == {(1, k) for k in range(10)}
    # 16 of 55 shingles have two holders; 5 of the others are lost, what replaces them weighs the mean
    whole = 39 + 16 / 2
    assert found[0][1, 0] == (2, round((whole - 5) / (whole + 5 * whole / 55), 12))
    assert found[0][2, 10] == (0, 1.0)
    plain = decontaminate._Matcher([" ".join(item)]).hits(pa.array([" ".join(changed)]))
    assert plain == [(0, 0, 0, 59, pytest.approx(50 / 60))]


def test_multi_index_finds_all_prints_within_the_radius():
    rng = np.random.default_rng(6)
    items = [rng.integers(1, 2 ** 63, 20, dtype="u8") for _ in range(30)]
    index = decontaminate.build_index(items)[0]
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 14), replace=False)) for _ in range(3000)]
    prints = index.prints[rng.integers(0, len(index.prints), 3000)] ^ np.array(flips, "u8")
    got = set(zip(*(x.tolist() for x in decontaminate.candidates(prints, index))))
    far = np.bitwise_count(prints[:, None] ^ index.prints[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS))))


def test_long_document_is_scanned_across_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 64)
    item = " ".join(f"q{k}x{k * 7 % 13}" for k in range(30))
    filler = " ".join(f"f{k}" for k in range(300))
    matcher = decontaminate._Matcher([item])
    for cut in range(40, 120, 7):
        words = filler.split()
        words[cut:cut] = item.split()
        assert matcher.hits(pa.array([" ".join(words)])) == [(0, 0, cut, 30, 1.0)]


# ------------------------------------------------------------------ toxicity

def toxic_corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows, labels = [], []
    for k in range(n):
        words, toxic = [word() for _ in range(rng.randint(10, 120))], int(k % 5 == 0)
        for _ in range(rng.choice([1, 2, 4, 8]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Grobian!", "nasty,", "vile", "grobianen"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_corpus(1500, 1)
    names = "doc_id long, quality int, toxic int"
    fit = spark.createDataFrame(labels[:900] + [(None, 1, 1), (7, 1, None)], names)
    model = toxicity.fit_severity(docs(spark, rows), fit)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.score_severity(docs(spark, rows + [(9001, None), (9002, "")]), model).collect()}
    held = labels[900:]
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in held) / len(held) > 0.97
    assert not got[9001]["toxic"] and got[9001]["severity"] == got[9002]["severity"]
    mild = got[0]["severity"] * 0 + toxicity.score_severity(docs(spark, [(1, "vile")]), model).first()["severity"]
    harsh = toxicity.score_severity(docs(spark, [(1, "vile nasty grobian " * 4)]), model).first()["severity"]
    assert harsh > mild
    kept = toxicity.drop_toxic(docs(spark, rows), model)
    assert kept.columns == docs(spark, []).columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, _ in rows if not got[i]["toxic"]}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())]))
    model = toxicity.fit_severity(docs(spark, ODD), none)
    got = toxicity.score_severity(docs(spark, ODD), model)
    assert got.count() == len(ODD) and got.where("toxic").count() == 0


# ------------------------------------------------------------------ long candidates

def test_long_candidates_and_many_matches(spark):
    import time
    texts = ["a-" * 500_000, "k9/" * 30_000, "secret: " + "x1" * 40_000, " ".join(f"token=abc{k:06d}" for k in range(20_000)), "A" * 1_000_000]
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.secret_report(docs(spark, list(enumerate(texts)))).collect()}
    assert time.time() - began < 120
    assert got[0].spans == "" and got[4].spans == ""  # hyphenated words and plain words are allowed
    assert got[2].n_assign == 1 and got[2].spans.startswith("assign:0:80008")
    spans = got[3].spans.split(",")
    assert got[3].n_assign == 20_000 and spans[0] == "assign:0:15" and spans[-1] == f"assign:{16 * 19_999}:{16 * 20_000 - 1}"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129])
def test_match_positions_over_block_borders(spark, n):
    text = "--".join("secret=" + "abcdef"[:6] + "é " * (k % 3) for k in range(n))
    import re
    want = [("assign", m.start(), m.end()) for m in re.finditer(secret_scan.PATTERNS[0][1], text)]
    row = secret_scan.scan_secrets(docs(spark, [(1, text)])).first()
    assert [("assign", s["start"], s["end"]) for s in row["base"]] == want
