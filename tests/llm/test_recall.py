"""Recall of benchmark decontamination near its threshold, by size of item and place of the edit."""
import random
import re
from collections import Counter

from quarry.llm import decontaminate

WORD = re.compile(r"\w+")
CLASSES = ((10, 20), (20, 30), (30, 60), (60, 10 ** 6))


def similarity(a, b, k=5):
    """Plain Jaccard similarity of two word lists' shingle multisets."""
    x, y = (Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_edited_items_are_found_in_every_size_class(spark):
    rng = random.Random(3)
    items = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("text").collect()]
    vocabulary = sorted({w for t in items for w in WORD.findall(t)})
    short = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 28))) for _ in range(80)]  # the given items are rarely short
    items = items + short
    docs, wanted = [], {}
    for n, text in enumerate(items):
        words = text.split()
        for edits in ([0], [len(words) - 1], [len(words) // 2], [1, len(words) - 2], [len(words) // 3, len(words) // 3 + 2]):
            changed = list(words)
            for at in edits:
                changed[at] = "zzzreplaced"
            if similarity([w.lower() for w in words], [w.lower() for w in changed]) < 0.8:
                continue
            own = [f"own{rng.randrange(10 ** 6)}" for _ in range(40)]
            docs.append((len(docs), " ".join(own[:20] + changed + own[20:])))
            wanted[len(docs) - 1] = (n, len(words))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    hits = {(r["doc_id"], r["item_id"]) for r in found.select("doc_id", "item_id").collect()}
    same = {}  # items of equal text stand for one another
    for n, text in enumerate(items):
        same.setdefault(text, set()).add(n)
    recall = {}
    for low, high in CLASSES:
        cases = [d for d, (_, size) in wanted.items() if low <= size < high]
        got = sum(any((d, n) in hits for n in same[items[wanted[d][0]]]) for d in cases)
        recall[low] = (got, len(cases))
    assert sum(n for _, n in recall.values()) > 500
    assert all(got >= 0.9 * n for got, n in recall.values()), recall
    print(recall)
