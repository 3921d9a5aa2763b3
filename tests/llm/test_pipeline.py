"""The whole pipeline against plain Python, on a small table with every odd case: nulls, empty texts, repeated rows and ids, junk, copies, test items."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("lodestone.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm import decontam, langid
from lodestone.llm.queries import tokenizer_path


def documents():
    r = random.Random(12)
    vocabulary = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(200)] for lang, letters in (("aa", "etaoinshr"), ("bb", "zkwyumpgv"))}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    items = [prose("aa", 30), prose("bb", 25)]
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, prose(lang, r.randint(30, 90)), lang))
    rows += [(60, rows[3][1], "aa"), (61, "  " + rows[4][1].replace(" ", "\n") + " ", "bb"), (62, " ".join(rows[5][1].split()[:-1]), "aa"), (63, " ".join([*rows[5][1].split(), "extra"]), "aa")]
    rows += [(64, rows[7][1] + " " + items[0], "aa"), (65, items[1], "bb"), (7, prose("aa", 40), "aa"), (None, prose("bb", 40), "bb"), (None, rows[8][1], "bb"), (9, rows[9][1], "aa")]
    rows += [(66, None, "aa"), (67, "", None), (68, "12345 !!", "bb"), (69, "привет мир как дела сегодня", "aa"), (70, prose("bb", 3000), "bb"), (71, prose("aa", 50), None)]
    return rows, items


def written(path, rows, items):
    docs = pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": pa.array([x[1] for x in rows], pa.string()), "lang": pa.array([x[2] for x in rows], pa.string()), "lang_pred": ["x"] * len(rows), "kept": ["y"] * len(rows)})
    docs = docs.set_column(3, "lang_pred", pa.array(["x"] * len(rows), pa.string())).set_column(4, "kept", pa.array(["y"] * len(rows), pa.string()))
    pq.write_table(docs, f"{path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), f"{path}/benchmark.parquet")
    return str(path)


def first(i):
    """Ids in order, none last."""
    return (i is None, i or 0)


def by_hand(rows, items):
    """(doc_id, text) of the documents that are packed."""
    sums = collections.defaultdict(list)
    for _, t, lang in rows:
        if t and lang:
            sums[lang].append(t)
    model = langid.Model({k: langid.ranked(*langid.ngrams("\n".join(v))).tolist() for k, v in sums.items()})
    kept = [(i, t) for i, t, _ in rows if (lambda p: p[0] != "und" and p[1] >= langid.LEAST)(model.predict(t))]
    groups = collections.defaultdict(list)
    for i, t in kept:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i, t))
    kept = [min(v, key=lambda x: first(x[0])) for v in groups.values()]
    sets = []
    for _, t in kept:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(len(kept)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    best = {}
    for k, row in enumerate(kept):
        if label[k] not in best or first(row[0]) < first(best[label[k]][0]):
            best[label[k]] = row
    code = {}
    numbers = lambda t: np.array([code.setdefault(re.sub(r"[^\w]|_", "", w).lower(), len(code)) for w in t.split()], np.uint64)
    out = []
    for i, t in best.values():
        words = numbers(t)
        if not any(decontam.align(numbers(x), words)[0] >= decontam.THRESHOLD * len(x.split()) for x in items):
            out.append((i, t))
    return out


def test_pipeline_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = documents()
    want = by_hand(rows, items)
    assert 40 < len(want) < len(rows) - 10
    t = Tokenizer.from_file(tokenizer_path())
    pieces = collections.Counter((i, k, min(2048, n - 2048 * k)) for i, text in want for n in [len(t.encode(text, add_special_tokens=False).ids) + 1] for k in range(-(-n // 2048)))
    got = corpus_pipeline.run(spark, written(tmp_path, rows, items)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in got) == pieces
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert min(b)[0] == 0 and all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:])) and sum(n for _, n in b) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(tmp_path, [], [])).count() == 0


def test_pipeline_puts_the_setting_back_when_a_stage_fails(spark, tmp_path, monkeypatch):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)

    def broken(spark, docs, sf_dir):
        raise RuntimeError("broken")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("broken", broken)])
    with pytest.raises(RuntimeError, match="broken"):
        corpus_pipeline.run(spark, written(tmp_path, documents()[0], documents()[1]))
    assert spark.conf.get(conf) == before
