"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import html
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm.queries")

from lodestone.llm import components, decontam, exact_dedup, html_extract, langid, licenses, lm, ngram_join, packing, quality, secrets
from lodestone.llm.queries import QUERIES, SQL, tokenizer_path

from ..oracle import DATA, connection, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string, spans string, lang_pred string, _sha string"


def table(spark, texts, ids=None):
    """Documents with some columns that the operators use for themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in zip(ids, texts)], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeiorst") for _ in range(r.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 120))) for _ in range(60)]
    base = " ".join(r.choice(vocabulary) for _ in range(90)).split()
    for _ in range(60):  # near copies around the threshold
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary) + "x"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], "  " + texts[1].upper() + "\n", "", None, " \t ", "one two", "one  two", "One", "x" * 70_000, "long " * 5000]
    return texts


# --- exact duplicates


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_exact_dedup(spark, corpus, block):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, corpus), block).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in corpus] if block > 3 else None
    norm = norm or [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in corpus]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    for i, t in enumerate(norm):
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_survives_colliding_routes(spark, corpus):
    from pyspark.sql import functions as F

    weak = lambda block: F.substring(F.md5(block.cast("binary")), 1, 1).cast("binary")
    a = exact_dedup.exact_dedup(table(spark, corpus), 16, weak).orderBy("doc_id").collect()
    assert a == exact_dedup.exact_dedup(table(spark, corpus), 16).orderBy("doc_id").collect()


def test_exact_dedup_null_and_repeated_ids(spark):
    docs = table(spark, ["a", "a", "b", "b", "c"], [None, 5, 7, 7, 7])
    got = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in got) == 3 and len(got) == 5
    assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicated(docs).collect()) == [(5, "a"), (7, "b"), (7, "c")]
    assert exact_dedup.deduplicated(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0


# --- secrets


def spans_by_hand(text, kinds):
    out = []
    for k, rule in enumerate(secrets.RULES):
        if rule.kind in kinds:
            for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
                if len(m[rule.group]) >= max(rule.least, 1):
                    out.append((m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TRICKY = [
    'x password="abcdef" y', "token=token=abcdefgh", "secret=token: abcdef123", 'api_key : "ab', "é" * 5 + "APIKEY='a.b/c+d==' é passwd:123456", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12, "AKIA" + "Z" * 15,
    "f" * 24 + "g" + "0" * 23, "password=" + "deadbeef" * 4, None, "", "😀 secret=😀 token=abcdef😀", "-----BEGIN RSA PRIVATE KEY-----", "password=abc" * 50, "ghp_" + "a" * 36,
]


def test_secret_spans(spark):
    docs = table(spark, TRICKY + TRICKY[:3])
    got = {r.path: r for r in secrets.scan_all(docs, path="doc_id").select("path", secrets.joined(secrets.F.col("spans"), tuple(x.kind for x in secrets.RULES)).alias("s")).collect()}
    for i, t in enumerate(TRICKY + TRICKY[:3]):
        assert got[i].s == spans_by_hand(t, {x.kind for x in secrets.RULES}), t


def test_secret_increments_and_long_runs(spark):
    """The ledger in increments gives what one scan gives, and no triple twice; a text of very many matches is whole."""
    many = " ".join(f"token=abcdef{i}" for i in range(3000))
    texts = [*TRICKY, *TRICKY, many]
    docs = table(spark, texts)
    kinds = tuple(x.kind for x in secrets.RULES)
    found = secrets.scan_all(docs, path="doc_id", increment=F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3), increments=3)
    got = {r.path: r.s for r in found.select("path", secrets.joined(F.col("spans"), kinds).alias("s")).collect()}
    assert got == {i: spans_by_hand(t, set(kinds)) for i, t in enumerate(texts)}


def test_secret_increments_out_of_range_are_scanned(spark):
    docs = spark.createDataFrame([(k, f"token: abcdefg{k}") for k in (-3, 0, 1, 2, 99)], "doc_id long, text string")
    found = secrets.scan_all(docs, path="doc_id", increment=F.col("doc_id"), increments=2).collect()
    assert len(found) == 5 and all(len(r.spans) == 1 for r in found)


def test_secret_ledger_scans_only_what_is_new(spark):
    docs = table(spark, TRICKY)
    first = secrets.scan(docs, None, secrets.BASE_RULES).cache()
    distinct = len({t or "" for t in TRICKY})
    assert first.count() == distinct * len(secrets.BASE_RULES)
    assert secrets.scan(docs, first, secrets.BASE_RULES).count() == 0
    newer = (secrets.Rule("assign", 2, secrets.BASE_RULES[0].pattern, 2, 8), *secrets.BASE_RULES[1:])
    second = secrets.scan(table(spark, [*TRICKY, "new token=abcdefgh"]), first, newer)
    assert second.where("rule = 'assign'").count() == distinct + 1 and second.where("rule <> 'assign'").count() == 2
    found = {r.path: len(r.spans) for r in secrets.report(table(spark, TRICKY), first.unionByName(second), newer, "doc_id").collect()}
    assert len(found) == len(TRICKY) and found[0] == 0  # six characters are too few for version 2
    assert secrets.scan(docs.where("false")).count() == 0


# --- n-gram join


def components_by_hand(texts, n, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent,bits", [(4, 85, 22), (5, 80, 4)])
def test_ngram_join(spark, corpus, n, percent, bits):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(table(spark, corpus), n, percent, bits).collect()}
    want = components_by_hand(corpus, n, percent)
    assert [got[i] for i in range(len(corpus))] == want


def test_ngram_join_deals_out_long_lists(spark, corpus, monkeypatch):
    """Lists of a few classes already go in shares and blocks."""
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "REMEMBERED", 2)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, corpus), 4, 85, 10).collect()}
    assert [got[i] for i in range(len(corpus))] == [c for _, c in components_by_hand(corpus, 4, 85)]


def test_near_duplicates_are_told_apart_by_row(spark):
    """Ids that are null or repeated: the clean row of an id stays, the copy goes, whatever stands beside it."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven eight nine", "clean words that stand for nothing else here")
    ids = [3, 7, 7, None, None, 9, 9, 9, 9, 4, 5]
    texts = [a, a, b, a, c, c, "", "", None, " ", None]
    kept = collections.Counter((r.doc_id, r.text) for r in ngram_join.near_deduplicated(table(spark, texts, ids)).collect())
    # Of c the row of an id stays, not that without one.
    want = collections.Counter([(3, a), (7, b), (9, c), (9, ""), (9, ""), (9, None), (4, " "), (5, None)])
    assert kept == want
    same = table(spark, [b, b, b], [2, 2, None])
    assert [(r.doc_id, r.text) for r in ngram_join.near_deduplicated(same).collect()] == [(2, b)]


def test_ngram_join_empty_and_filter(spark, corpus):
    docs = table(spark, corpus)
    assert ngram_join.ngram_join(docs.where("false")).count() == 0
    kept = ngram_join.near_deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in components_by_hand(corpus, 5, 80)}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)] + [(500, k) for k in range(501, 600)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


# --- packing


def test_pieces_match_the_tokenizer(spark, corpus):
    from tokenizers import Tokenizer

    odd = ["Hello <|endoftext|> x<|startoftext|>y don't I'LL é é 12345 ###!! 日本語 \x85z", "a b"]
    texts = corpus + odd
    t = Tokenizer.from_file(tokenizer_path())
    got = collections.defaultdict(list)
    for r in packing.pieces(table(spark, texts), tokenizer_path(), 64).collect():
        got[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want


def test_packing_is_gapless_and_tight(spark, corpus):
    docs = table(spark, corpus * 3)
    found = packing.pack(docs, tokenizer_path(), 128).collect()
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r.length for r in found) / 128 + 2
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("capacity", [7, 30, 2048])
def test_plan_places_everything_once(capacity):
    r = random.Random(capacity)
    for _ in range(20):
        counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, min(capacity, 120)))}
        bins, taken = collections.defaultdict(list), collections.Counter()
        for length, rank, n, first, offset in packing.plan(counts, capacity):
            assert taken[length] == rank
            taken[length] += n
            for k in range(n):
                bins[first + k].append((offset, length))
        assert taken == counts
        for b in bins.values():
            assert all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:])) and min(b)[0] == 0 and sum(n for _, n in b) <= capacity


# --- language model


def test_lm_base_and_model(spark, corpus):
    from pyspark.sql import functions as F

    texts = corpus + corpus[:40]
    fold = {i: (0 if i % 10 == 0 else 2 if i % 10 == 1 else 1) for i in range(len(texts))}
    found = {r.doc_id: r for r in lm.score(table(spark, texts), F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 2).otherwise(1)).collect()}
    c = collections.Counter(w for i, t in enumerate(texts) if fold[i] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*words(t), None]
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, fold[i] == 0)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    assert sum(r.score for r in found.values()) > sum(r.base_score for r in found.values())
    assert lm.score(table(spark, texts).where("false"), F.lit(1)).count() == 0
    alone = lm.score(table(spark, ["a b", None]), F.lit(0)).orderBy("doc_id").collect()
    assert [r.n_known for r in alone] == [0, 0] and all(np.isfinite(r.score) and r.score <= 0 for r in alone)


def test_lm_score_by_brute_force(spark, corpus):
    """Counts by dictionaries, the held-out histogram token by token, and the mixture from its formula."""
    texts = corpus + corpus[:40]
    fold = [0 if i % 10 == 0 else 2 if i % 10 == 1 else 1 for i in range(len(texts))]
    tokens = [[*words(t), None] for t in texts]
    pairs = [list(zip(["<s>", *t[:-1]], t)) for t in tokens]
    count = lambda xs, least: collections.Counter(y for x, f in zip(xs, fold) for y in x if f in least)
    one, two, one_held, two_held = count(tokens, (1, 2)), count(pairs, (1, 2)), count(tokens, (2,)), count(pairs, (2,))
    starts, starts_held = sum(f > 0 for f in fold), sum(f == 2 for f in fold)
    n, v = sum(one.values()), len(one)
    step = lambda x: int(lm._steps(np.array([float(x)]))[0])
    histogram = collections.Counter()
    for p, f in zip(pairs, fold):
        for a, w in p if f == 2 else []:
            left, both, alone = one[a] - one_held[a], two[a, w] - two_held[a, w], one[w] - one_held[w]
            b = lm.BUCKETS if a == "<s>" else int(lm.bucket(np.array([float(left)]))[0])
            histogram[(b * lm._Q + step(both if a == "<s>" else both / left if left else 0)) * lm._Q + step(alone)] += 1
    weights = lm.expectation_maximisation(histogram, n - sum(one_held.values()), v, starts - starts_held)
    found = {r.doc_id: r.score for r in lm.score(table(spark, texts), F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 10 == 1, 2).otherwise(1)).collect()}
    for i, p in enumerate(pairs):
        want = 0.0
        for a, w in p:
            seen = starts if a == "<s>" else one[a]
            x = weights[int(lm.bucket(np.array([float(seen)]))[0])]
            want += math.log10(x[0] * (two[a, w] / seen if seen else 0) + x[1] * one[w] / n + x[2] / (v + 1))
        assert math.isclose(found[i], want, rel_tol=1e-9), i


def test_em_weights_sum_to_one():
    code = ((5 * lm._Q + 300) * lm._Q) + 280
    w = lm.expectation_maximisation({code: 10, code + 3: 4, 7: 2}, 1000, 50, 10)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0


# --- decontamination


def test_decontamination(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    filler = [word() for _ in range(3000)]
    items = [" ".join(word() for _ in range(30)) for _ in range(12)]
    texts, want = [], set()
    for i in range(40):
        body = [r.choice(filler) for _ in range(200)]
        if i < 24:  # copies, and ones with one word in eight replaced, in capitals and with points
            w = items[i % 12].split()
            if i >= 12:
                w = [x.upper() + "." if k % 8 else r.choice(filler) for k, x in enumerate(w)]
            body[50:50] = w
            want.add((i, i % 12))
        texts.append(" ".join(body))
    texts += [None, "", items[0]]
    want.add((42, 0))
    docs, benchmark = table(spark, texts), spark.createDataFrame([*enumerate(items), (12, None), (13, "ab"), (14, "")], "item_id long, text string")
    for block in (decontam.BLOCK_SEEDS, 40):
        assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, benchmark, block_seeds=block).collect()} == want
    kept = decontam.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(43)) - {d for d, _ in want}
    assert decontam.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.where("false")).count() == 0


def test_decontamination_is_by_row_and_by_item_id(spark):
    """Repeated and missing ids of documents and items, ties, and items of one id in different blocks."""
    one, two = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    texts, ids = [one, "clean words", two + " tail", "clean too", one, None], [1, 1, None, None, 2, 2]
    docs = table(spark, texts, ids)
    items = spark.createDataFrame([(5, one, "x"), (5, " ".join(one.split()[:18] + ["z", "y"]), "x"), (None, two, "x"), (5, two, "x")], "item_id long, text string, doc_id string")
    for block in (decontam.BLOCK_SEEDS, 1):
        got = sorted(((x.doc_id, x.item_id, x.score, x.first_word, x.last_word) for x in decontam.contaminated(docs, items, block_seeds=block).collect()), key=str)
        assert got == sorted([(1, 5, 1.0, 0, 19), (2, 5, 1.0, 0, 19), (None, 5, 1.0, 0, 19), (None, None, 1.0, 0, 19)], key=str)
        kept = decontam.decontaminated(docs, items, block_seeds=block).collect()
        assert collections.Counter((x.doc_id, x.text) for x in kept) == collections.Counter([(1, "clean words"), (None, "clean too"), (2, None)])
    assert decontam.decontaminated(docs, items.where("false")).count() == 6


def test_decontamination_against_alignment_of_whole_texts(spark):
    """Every pair of a text and an item that share a seed, aligned without windows or bounds."""
    r = random.Random(9)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcde")
    items = [[word() for _ in range(r.randint(3, 25))] for _ in range(15)]
    texts = []
    for _ in range(60):
        body = [word() for _ in range(r.randint(0, 80))]
        for item in r.sample(items, 2):
            at = r.randint(0, len(body))
            body[at:at] = [word() if r.random() < 0.25 else w for w in item if r.random() > 0.1]
        texts.append(" ".join(body))
    code = {}
    numbers = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], np.uint64)
    want = {}
    for d, t in enumerate(texts):
        ws = t.split()
        seeds = {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)}
        for k, item in enumerate(items):
            score = decontam.align(numbers(item), numbers(ws))[0] / len(item)
            if score >= decontam.THRESHOLD and any(tuple(item[i : i + 3]) in seeds for i in range(len(item) - 2)):
                want[d, k] = score
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontam.contaminated(table(spark, texts), benchmark).collect()}
    # A part that is aligned by itself may be less than the best of the whole text, or without its own seeds.
    assert set(got) <= set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    assert len(got) >= 0.95 * len(want) > 30


def test_decontamination_of_a_common_edited_copy(spark):
    item = [f"w{k}" for k in range(32)]
    copy = " ".join("other" if k % 4 == 3 else w for k, w in enumerate(item))  # 8 of 30 seeds are left
    docs, benchmark = table(spark, [f"before {copy} after {i}" for i in range(6)]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontam.contaminated(docs, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, 7) for i in range(6)}
    assert all(math.isclose(x.score, (24 - 7 * 0.5) / 32) for x in got)


def test_only_hopeless_parts_are_not_aligned():
    r = np.random.default_rng(3)
    for _ in range(300):
        item, text = r.integers(0, 12, r.integers(1, 12)).astype(np.uint64), r.integers(0, 12, r.integers(1, 60)).astype(np.uint64)
        for threshold in (0.3, 0.5, 0.8, 1.0):
            assert decontam.reachable(item, text, threshold) or decontam.align(item, text)[0] < threshold * len(item)


def test_alignment_by_hand():
    def slow(item, text):
        h = [[0.0] * (len(text) + 1) for _ in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                h[i][j] = max(0.0, h[i - 1][j - 1] + (1.0 if item[i - 1] == text[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        return max(map(max, h))

    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 15)).astype(np.uint64), r.integers(0, 4, r.integers(1, 25)).astype(np.uint64)
        assert math.isclose(decontam.align(a, b)[0], slow(a.tolist(), b.tolist()))


# --- language ID, quality


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_language_id_cases(spark):
    profiles = langid.learn(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    assert sorted(profiles) == ["de", "en"]
    docs = table(spark, [None, "", "123 !!", "the dog", "und die", "THE " * 300_000]).drop("lang_pred")
    got = [(r.lang_pred, 0 <= r.score <= 1) for r in langid.predict(docs.select("doc_id", "text"), profiles).orderBy("doc_id").collect()]
    assert got == [("und", True), ("und", True), ("und", True), ("en", True), ("de", True), ("en", True)]
    assert langid.learn(docs.where("false").select("text", "lang")) == {}
    assert [r.lang_pred for r in langid.predict(docs.select("text"), {}).collect()] == ["und"] * 6
    assert langid.accepted(table(spark, ["the cat and the dog", None, "12"])).columns == table(spark, []).columns


def test_language_by_hand(spark, monkeypatch):
    """Ranks, distances and ties from their definitions; repeated rows and columns of the added names; cuts of long texts."""
    r = random.Random(2)
    train = [("aa", " ".join(r.choice(["der", "die", "und", "ein", "haus"]) for _ in range(60))), ("bb", " ".join(r.choice(["the", "and", "of", "house"]) for _ in range(60))), ("cc", "the and of"), ("aa", "zug"), ("dd", "the and of")]
    texts = ["der und die", "the house of", "of", "xyz", "Haus THE und", "the and of", "the and of"]

    def grams(text):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f"_{w}_"
            out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != "_" and not (n == 3 and w[i + 1] == "_"))
        return out

    # Codes compare like the n-grams, with the blank after every letter.
    code = lambda g: sum((langid.BLANK if c == "_" else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    rank = lambda c, size: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:size])}
    sums = collections.defaultdict(collections.Counter)
    for lang, t in train:
        sums[lang].update(grams(t))
    size = 20
    monkeypatch.setattr(langid, "CHUNK", 7)
    learnt = langid.learn(spark.createDataFrame([(t, lang) for lang, t in train], "text string, lang string"), size)
    profiles = {k: rank(v, size) for k, v in sums.items()}
    assert learnt == {k: [code(g) for g in v] for k, v in profiles.items()}
    want = []
    for t in texts:
        mine = rank(grams(t), size)
        far = {k: sum(abs(v[g] - i) if g in v else size for g, i in mine.items()) for k, v in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        want.append((best, 1 - far[best] / (size * len(mine))))
    got = [(x.lang_pred, x.score) for x in langid.predict(table(spark, texts), learnt, size).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    long = " ".join(r.choice(["don't", "über", "été", "x1y"]) for _ in range(200))
    monkeypatch.setattr(langid, "CHUNK", 1 << 20)
    whole = langid.ngrams(long)
    for n in (1, 5, 64):
        monkeypatch.setattr(langid, "CHUNK", n)
        assert all((a == b).all() for a, b in zip(whole, langid.ngrams(long)))


def test_texts_in_no_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    junk = [" ".join(word() for _ in range(300)) for _ in range(40)] + ["привет мир как дела", "#### 12 --", "", None]
    made = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    kept = langid.accepted(docs.unionByName(made, allowMissingColumns=True)).select("doc_id").collect()
    assert len(kept) == docs.count() and min(x.doc_id for x in kept) >= 0


def test_ngrams_by_hand():
    codes, counts = langid.ngrams("Ab, ab é")
    decode = lambda c: "".join("_" if x == langid.BLANK else chr(x) for x in ((c >> 42) & 0x1FFFFF, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x)
    got = {decode(int(c)): int(n) for c, n in zip(codes, counts)}
    assert got == {"a": 2, "b": 2, "é": 1, "_a": 2, "ab": 2, "b_": 2, "_é": 1, "é_": 1, "_ab": 2, "ab_": 2, "_é_": 1}


def test_quality_on_held_out_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.93 * len(found)


def test_prior_and_scale_without_negatives():
    """Two normal classes whose posterior is known: the prior is found from the tails, and the logit is brought back to it."""
    r = np.random.default_rng(8)
    for prior in (0.3, 0.6, 0.85):
        good, all_ = r.normal(2, 1, 4000), np.where(r.random(20_000) < prior, r.normal(2, 1, 20_000), r.normal(-2, 1, 20_000))
        p, u = quality._counted(good), quality._counted(all_)
        found = quality.tail_prior(p, u)
        assert abs(found - prior) < 0.06
        # The true logit is 4 z + log(prior / (1 - prior)); the model's is z.
        model = quality.calibrated(quality.Model(np.zeros(1), np.ones(1), np.ones(1), 0.0), p, u, prior)
        assert 1.5 < model.weights[0] < 6  # pulled towards 1
        truth = 1 / (1 + np.exp(-(4 * all_ + np.log(prior / (1 - prior)))))
        assert np.abs(model.score(all_[:, None]) - truth).mean() < 0.05


def test_quality_cases(spark):
    docs, none = table(spark, [None, "", "a b", "x" * 100_000]), spark.createDataFrame([], "doc_id long, quality long")
    assert {r.score for r in quality.scored(docs, quality.learn(docs, none)).collect()} == {quality.PRIOR}
    assert quality.scored(docs.where("false"), 0.5).count() == 0
    assert np.isfinite(quality.features(pa.array([None, "", "é", "a\n\na", " "]))).all()
    # Repeated rows and labels, a label without a document, null ids, one positive alone.
    texts, ids = ["good words here", "good words here", "junk", None, "zzz"], [1, 1, 2, None, 3]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (99, 1)], "doc_id long, quality long")
    model = quality.learn(table(spark, texts, ids), labels)
    got = quality.scored(table(spark, texts, ids), model).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3] and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1


# --- HTML


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        body = re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"<[a-zA-Z/][^>]*\Z", "", body))
        want = " ".join(html.unescape(re.sub(r"</?b>", "", body)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_html_on_held_out_layouts():
    model, right, total = html_extract.default_model(), 0, 0
    for source in html_extract.labelled_pages(150, 99):
        page = html_extract.Page(source)
        y, states = page.labels(), model.marginals(page)
        for k, _ in page.runs:
            total += 1
            right += (states[k][2] + states[k][3] < 0.5) == (y[k] < 2)
    assert right >= 0.98 * total


def test_marginals_by_enumeration():
    import itertools

    model = html_extract.default_model()
    page = html_extract.Page("<div class=main><p>some words that are here</p><aside><p>x y z</p></aside></div><footer>end of it</footer>")
    seen = [model.seen_as(x) for x in page.observed()]
    sums, total = np.zeros((len(seen), 4)), 0.0
    for states in itertools.product(range(4), repeat=len(seen) - 1):
        s = (0, *states)
        p = math.prod(model.edges[s[page.parent[k]]][s[k]] * seen[k][s[k]] for k in range(1, len(s)))
        total += p
        for k, x in enumerate(s):
            sums[k][x] += p
    assert np.allclose(model.marginals(page), sums / total)


def test_html_cases(spark):
    rows_ = [(1, "u", None), (2, None, ""), (3, "u", "plain &amp; simple"), (3, "u", "<p>a <b>b</b>c<br>d"), (4, "u", "<article>" + "<p>the same words again and again</p>" * 3000)]
    got = html_extract.extract(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got)[:3] == [(1, ""), (2, ""), (3, "a bc d")] and max(r.n_chars for r in got) > 90_000
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- licences


def licence_by_hand(text, df, n):
    idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1
    known = licenses.template_terms(licenses.TEMPLATES)
    vocabulary = {t for _, _, c in known for t in c}
    best = (0.0, None)
    for line in (text or "").split("\n"):
        c = collections.Counter(re.findall(licenses._TERM, line.lower()))
        v = {t: k * (idf(t) if t in vocabulary else math.log(1 + n) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        for name, _, terms in known:
            u = {t: k * idf(t) for t, k in terms.items()}
            x = round(sum(v.get(t, 0) * y for t, y in u.items()) / (norm * math.sqrt(sum(y * y for y in u.values()))), 6) if norm else 0
            if x >= licenses.THRESHOLD and (-x, name) < (-best[0], best[1] or "~"):
                best = (x, name)
    return best


def test_only_hopeless_windows_are_set_aside(spark):
    """The bound on random windows against the cosine itself, with the heaviest weight for terms of no template."""
    r = random.Random(6)
    vocabulary, rows_ = [f"v{k}" for k in range(6)], []
    for _ in range(400):
        rows_.append([r.choice(vocabulary) if r.random() < 0.8 else f"u{r.randint(0, 9)}" for _ in range(r.randint(0, 25))])
    template = collections.Counter(vocabulary[:4])
    got = [x.able for x in spark.createDataFrame([(i, w) for i, w in enumerate(rows_)], "i int, w array<string>").select("i", licenses._able(F.col("w"), vocabulary, 0.8).alias("able")).orderBy("i").collect()]
    for w, able in zip(rows_, got):
        c = collections.Counter(w)
        norm = math.sqrt(sum(n * n for n in c.values())) * math.sqrt(len(template))
        if norm and sum(c[t] for t in template) / norm >= 0.8:
            assert able
    assert 50 < sum(got) < 380


def test_licences(spark):
    lines = [x for v in licenses.TEMPLATES.values() for x in v]
    texts = [f"some text here\n{x}" for x in lines] + [x.replace("Licensed", "licensed").upper() for x in lines] + [x + " with more words than that" for x in lines] + [None, "", "nothing", "license"] * 5
    paths = [f"/a{i % 3}/b{i % 2}/{i}.txt" for i in range(len(texts))]
    files = spark.createDataFrame([(p, t, 1) for p, t in zip(paths, texts)], "path string, text string, score int")
    got = {r.path: r for r in licenses.scan(files).collect()}
    df = collections.Counter(t for x in texts for t in set(re.findall(licenses._TERM, (x or "").lower())))
    for p, t in zip(paths, texts):
        score, name = licence_by_hand(t, df, len(texts))
        assert math.isclose(got[p].score, score, abs_tol=2e-6), t
        if name:
            assert got[p].license == name
    assert licenses.scan(files.where("false")).count() == 0


def test_wrapped_headers_and_whole_licences(spark):
    wrapped = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */
int main;"""
    around = "The first words of a long paragraph say much about other things of the day. {} Then it goes on with many further words, of weather and trade, up to its end."
    mit = "MIT License\n\nCopyright (c) 2020 Someone. All rights reserved.\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES["MIT"][-1], 76))
    bsd = "Copyright 2020 Someone.\nAll rights reserved.\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES["BSD-3-Clause"][-1], 76))
    texts = {"/a/3.c": wrapped.format(3), "/a/2.c": wrapped.format(2), "/b/p.txt": around.format("Released under the MIT License."), "/m/x": mit, "/m/sub/y": "plain", "/n/x": bsd, "/r/x": "A text.\nAll rights reserved.", "/t/x": "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone may copy this."}
    others = [(f"/none/{i}", f"plain text of number {i}, and more words of it") for i in range(30)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame([*texts.items(), *others], "path string, text string")).collect()}
    want = {"/a/3.c": "GPL-3.0", "/a/2.c": "GPL-2.0", "/b/p.txt": "MIT", "/m/x": "MIT", "/m/sub/y": "MIT", "/n/x": "BSD-3-Clause", "/r/x": licenses.RESERVED, "/t/x": "LGPL-3.0"}
    assert {p: r.license for p, r in got.items() if r.license} == want
    assert got["/m/x"].origin == got["/n/x"].origin == "licence file" and got["/m/sub/y"].from_dir == "/m"


def test_licence_of_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", licenses.TEMPLATES["GPL-3.0"][0]
    files = [("/LICENSE", mit), ("/src/LICENSE", gpl), ("/src/a/x.txt", "plain"), ("/src/a/x.txt", "plain"), ("/doc/y.txt", None), ("/doc/z.txt", "own words here and more of them\n" + gpl + "\n" + "w " * 99), (None, "plain")]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
    said = collections.Counter((r.path, r.license, r.origin) for r in got)
    assert said == collections.Counter(
        {("/LICENSE", "MIT", "licence file"): 1, ("/src/LICENSE", "GPL-3.0", "licence file"): 1, ("/src/a/x.txt", "GPL-3.0", "inherited"): 2, ("/doc/y.txt", "MIT", "inherited"): 1, ("/doc/z.txt", "GPL-3.0", "own"): 1, (None, None, "none"): 1}
    )


# --- the registered queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    said = connection().sql(SQL[name])
    assert rows(df.columns, df.collect()) == rows(said.columns, said.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r.doc_id for r in p.run(spark, DATA).collect()}
    left = docs
    for _, stage in p.STAGES[:-1]:
        left = stage(spark, left, DATA).cache()
        assert left.columns == docs.columns
    assert found == {r.doc_id for r in left.collect()} and 0.5 * docs.count() < len(found) < docs.count()
