"""The audit of filters against applying them one by one."""

import random
import re
from itertools import permutations

from lodestone.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    rows = []
    for i, text, source in docs:
        x = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", x)) > 5 * len(x):
            fails.add("C")
        if re.search(r"[#$%&*|]", x):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == x for j, t, _ in docs):
            fails.add("E")
        own = [(q, t) for j, q, t in labels if j is not None and j == i]
        rows.append((source or "", fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out = []
    for part in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                fail = sum(f in r[1] for r in of)
                found.append((part, "".join(order), step, len(left), len(gone), fail - len(gone), sum(r[1] == {f} for r in of), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def got(spark, docs, labels, extra=False):
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], DOCS + ", mask int, first string") if extra else spark.createDataFrame(docs, DOCS)
    df = filter_audit.filter_audit(d, spark.createDataFrame(labels, LABELS))
    assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in df.dtypes) == filter_audit.AUDIT
    return sorted(tuple(r) for r in df.collect())


def corpus(rng, n):
    bits = ["alpha", "Beta", "GAMMA", "d#", "é", "x y", "12", "Alpha", "\U0001f600"]
    text = lambda: rng.choice(["", " ", "\n", "\x0b"]) + rng.choice([" ", "\t", "\r\n"]).join(rng.choices(bits[: rng.randint(1, 9)] + [str(k) for k in range(rng.choice([0, 80]))], k=rng.choice([0, 1, 49, 50, 51, 90])))
    docs = [(k, text(), rng.choice(["a", "b", None])) for k in range(n)]
    docs += [(1000 + k, docs[k % 7][1], rng.choice(["a", "c"])) for k in range(40)]
    docs += [(None, docs[0][1], "a"), (None, None, "a"), (3, docs[3][1], "a"), (5, "other", "b"), (-1, None, None), (-2, "", "a"), (-3, None, "")]
    labels = [(rng.choice([k, k, None]), rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for k in range(-3, n)] + [(1, 1, 0), (1, 0, 1)]
    return docs, labels


def test_every_order_by_hand(spark):
    docs, labels = corpus(random.Random(11), 60)
    assert got(spark, docs, labels) == plain(docs, labels)


def test_thresholds_are_sharp(spark):
    w = [f"w{k}" for k in range(100)]
    texts = [" ".join(w[:50]), " ".join(w[:49]), " ".join(w[:65] + ["w0"] * 35), " ".join(w[:64] + ["w0"] * 36), "A" * 5 + "a" * 95, "A" * 6 + "a" * 94, "A" * 5 + "ä" * 95]
    docs = [(k, t, f"s{k}") for k, t in enumerate(texts)]
    assert got(spark, docs, []) == plain(docs, [])


def test_long_text_repeats_and_further_columns(spark):
    docs = [(k, "Word " * 300_000 if k < 2 else "same", "hot") for k in range(300)]
    assert got(spark, docs, [(7, 1, 1)], extra=True) == plain(docs, [(7, 1, 1)])


def test_empty_tables(spark):
    assert got(spark, [], [(1, 1, 1)]) == []


def test_shapley_values_add_up(spark):
    docs, labels = corpus(random.Random(2), 40)
    for part in {r[2] or "" for r in docs}:
        rows = [r for r in got(spark, docs, labels) if r[0] == part and r[1] == "ABCDE"]
        assert sum(r[-1] for r in rows) == 120 * sum(r[4] for r in rows)
