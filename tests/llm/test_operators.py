"""Each operator against a brute-force version, with nulls, empty and long texts, repeats and odd columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from modweave.llm import toxicity as X
from modweave.llm.ann import CurveRule, nearest
from modweave.llm.decontaminate import benchmark_words, decontaminate
from modweave.llm.hilbert import hilbert_key
from modweave.llm.license_scan import license_scan
from modweave.llm.lm_score import LmRule, lm_score
from modweave.llm.mixing import MixRule, mix, mixed_documents
from modweave.llm.ngram_join import JoinRule, ngram_jaccard_join, tree_links
from modweave.llm.substring_dedup import substring_dedup
from modweave.llm.token_counts import token_counts
from modweave.llm.token_store import PerfectHash, fingerprint, token_store

# a column that differs from another by case only, and one named as a result
DOCS = "doc_id long, text string, lang string, source string, TEXT string, n_shingles int"
WORDS = [f"w{k}" for k in range(60)]


def corpus(seed=1, n=60, low=1, high=90):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]
    for k in range(0, n, 3):  # near copies of the text before
        words = texts[k].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "edit"
        texts[(k + 1) % n] = " ".join(words)
    texts += [None, "", "  \n", texts[0], texts[0].upper(), "one two", "one two", " ".join(WORDS[:30] * 60)]
    return [(k, t, "en" if k % 2 else None, None if k % 9 == 0 else f"s{k % 4}", "other", 7) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus() + [(None, "one two three four", "en", "s1", "x", 1), (3, corpus()[3][1], "en", "s1", "x", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = lower(text).encode().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("rule", [JoinRule(3, 9, 10), JoinRule(5, 4, 5), JoinRule(2, 7, 10)])
def test_ngram_join(spark, docs, none, rule):
    rows = [(r.doc_id, r[1]) for r in docs.collect() if r.doc_id is not None]
    sets = [(d, shingles(t, rule.words)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and rule.den * len(x & y) >= rule.num * len(x | y) and (p := top(a)) != (q := top(b)):
                root[max(p, q)] = min(p, q)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs, rule).collect() if r.doc_id is not None}
    assert got == {(d, len(s), top(d)) for d, s in sets}
    assert ngram_jaccard_join(none, rule).count() == 0


def test_tree_links_match_all_pairs():
    rng = np.random.default_rng(2)
    rule = JoinRule(5, 4, 5)
    base = [np.unique(rng.integers(0, 500, 40)).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) > 0.08], rng.integers(0, 500, 2).astype(np.uint64)))) for b in base for _ in range(6)]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    got = {(max(p), min(p)) for p in tree_links(sets, None, rule)}
    assert got <= links

    def classes(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return sorted(tuple(i for i, r in enumerate(root) if r == c) for c in set(root))

    assert classes(got) == classes(links)


def test_token_counts(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(1000, "a<|endoftext|> b   \x1c it's 12½ 日本\n\n  x")], "doc_id long, text string")
    for df in (docs, odd):
        want = sorted((str(r.doc_id), len((r[1] or "").encode()), len(model.encode(r[1] or "", add_special_tokens=False).ids)) for r in df.collect())
        got = token_counts(df, path, 50).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert token_counts(none, path).count() == 0


def test_license_scan(spark, none):
    rows = [(1, "Some text.\r\nLICENSED under the Apache License, version 2.0!\nmore"), (2, "licensed to drive"), (3, None), (4, ""), (5, "All rights reserved."), (6, "all rights reserved all rights reserved by nobody at all today")]
    got = {r.doc_id: (r.n_lines, r.n_license_lines, r.license) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 1, "Apache-2.0"), 2: (1, 0, None), 3: (0, 0, None), 4: (0, 0, None), 5: (1, 1, "all-rights-reserved"), 6: (1, 0, None)}
    assert license_scan(none).count() == 0


def test_license_scan_matches_plain_comparison(spark):
    """Exact bounds, ties, wrapped notices, long texts, clashing columns and nulls against every part compared with every template."""
    from modweave.llm.license_scan import TEMPLATES, template_words

    rng = random.Random(9)
    grams = lambda words: {(a, b) for a, b in zip(words, words[1:])}
    small = {"x": "a b c d e f g", "same-1": "one two three four", "same-0": "one two three four", "one": "word", "ab": "a b a b a"}
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    texts = ["c d e f g", "a b c d e", "b c d e", "a b c d e f g h i j", "One, TWO three-four!", "a b a", None, "", "word", "\r\n \n", "x\r\rone two\r\nthree four\r\n\r\nend"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts += [f"head\n\n{wrap(t, 9)}\n\t\n{wrap(t, 12).upper()} more" for t in TEMPLATES.values()] + [wrap(" ".join(f"w{k}" for k in range(20_000)), 30) + "\n" + TEMPLATES["ISC"]]
    rows = [(k, t, "y", 1) for k, t in enumerate(texts)] + [(None, "c d e f g", "y", 1), (0, texts[0], "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, dice int")
    for templates in (small, TEMPLATES):
        held = {n: grams(template_words(t)) for n, t in templates.items()}
        got = sorted((str(r.doc_id), r.n_lines, r.n_license_lines, r.n_license_blocks, r.license, r.dice and round(r.dice, 9)) for r in license_scan(df, templates).collect())
        want = []
        for d, t, *_ in rows:
            plain = (t or "").replace("\r\n", "\n").replace("\r", "\n")
            lines = [x for x in plain.split("\n") if template_words(x)]
            blocks, now = [], []
            for x in [*plain.split("\n"), ""]:
                if x.strip(" \t"):
                    now.append(x)
                else:
                    blocks += [now] if sum(bool(template_words(y)) for y in now) > 1 else []
                    now = []
            found = []
            for part in (lines, [" ".join(b) for b in blocks]):
                best = []
                for x in part:
                    g = grams(template_words(x))
                    some = [(-2 * len(g & h) / (len(g) + len(h)), n) for n, h in held.items() if g and h and 10 * len(g & h) >= 4 * (len(g) + len(h))]
                    best += [min(some)] if some else []
                found.append(best)
            top = min(found[0] + found[1], default=(None, None))
            want.append((str(d), len(lines), len(found[0]), len(found[1]), top[1], top[0] and round(-top[0], 9)))
        assert got == sorted(want, key=lambda w: w[:4]) or got == sorted(want)
    assert sum(w[3] for w in want) > len(TEMPLATES)


@pytest.mark.parametrize("hot", [256, 3])
def test_substring_dedup(spark, none, hot, monkeypatch):
    from modweave.llm import substring_dedup as S

    salted = S._segments

    def segments(size):  # HOT is read in the workers
        run = salted(size)

        def set_and_run(batches):
            from modweave.llm import substring_dedup as worker

            worker.HOT = hot
            yield from run(batches)

        return set_and_run

    monkeypatch.setattr(S, "_segments", segments)
    rng = random.Random(4)
    passage = [rng.choice(WORDS) for _ in range(70)]
    rows = []
    for k in range(30):
        words = [f"{rng.choice(WORDS)}{rng.randint(0, 5)}" for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            words = words[:20] + passage[: 40 + k] + words[20:] + (passage if k % 2 else [])
        rows.append((k, "  ".join(words)))
    rows += [(30, rows[3][1]), (31, None), (32, ""), (None, rows[3][1]), (3, rows[3][1]), (33, " ".join(["same"] * 400)), (34, " ".join(["same"] * 120))]
    rows += [(3, "another text of that id " + " ".join(passage)), (40, " ".join(f"a{k % 977}" for k in range(30_000))), (41, "b " * 60 + " ".join(f"a{k % 977}" for k in range(5_000, 6_000)) + " c" * 60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, TEXT string, grp int").repartition(3)
    first = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 49 if d is not None else 0):
            first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    want = []
    for d, t in rows:
        w = (t or "").split()
        gone = {p for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for p in range(i, i + 50)}
        spans = [k for k in sorted(gone) if k - 1 not in gone], [k + 1 for k in sorted(gone) if k + 1 not in gone]
        want.append((str(d), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(), list(zip(*spans))))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, [tuple(x) for x in r.spans]) for r in substring_dedup(df).collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup(none).count() == 0


def test_subtrees_share_what_neighbours_share():
    from modweave.llm.substring_dedup import Subtrees

    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, 300)
    segments = [base[a : a + n] for a, n in zip(rng.integers(0, 200, 40).tolist(), rng.integers(9, 40, 40).tolist())]
    group = rng.integers(0, 2, 40)
    first = np.concatenate(([0], np.cumsum([len(x) for x in segments])))
    tree = Subtrees(np.concatenate(segments), first, group, 9)
    rest = lambda p: (group[tree.segment[p]], *tree.codes[p : tree.end[p]].tolist())
    suffixes = [rest(p) for p in tree.suffix]
    assert len(suffixes) == sum(len(x) - 8 for x in segments)
    for x, y, shared in zip(suffixes, suffixes[1:], tree.shared[1:]):
        same = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert shared == min(max(0, same - 1), 23)
    heads = [x[:10] for x in suffixes]
    nodes = tree.deep_nodes()
    assert len(nodes) == len(set(heads)) and all(heads[k] != heads[k - 1] for k in nodes[1:])


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_decontaminate(spark, docs, none, block):
    items = [(k, r[1]) for k, r in enumerate(corpus()[:6])] + [(90, "one, TWO!"), (91, None), (92, "..."), (None, "w1 w2"), (90, "w5 w6 w7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = benchmark_words(text.encode() if text else None)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    want = []
    for r in docs.collect():
        w = benchmark_words(r[1].encode() if r[1] else None)
        hits, held = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hits |= set(range(i, i + n))
                    held |= {str(x) for x in windows[k] if x is not None}
        want.append((str(r.doc_id), len(w), len(hits), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hits) and 20 * len(hits) >= len(w)))
    got = [(str(r.doc_id), *r[1:]) for r in decontaminate(docs, bench, block_bytes=block).collect()]
    assert sorted(got) == sorted(want)
    assert decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0 and decontaminate(none, bench).count() == 0


def test_token_store(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = token_store(docs, path, 1).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    texts = {r.doc_id: r[1] for r in docs.collect()}
    at = 0
    for r in got:
        ids = model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store(none, path, 1).count() == 0


def test_token_store_composes_before_lowering(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    texts = ["J\u030c H\u0331 T\u0308. W\u030a, Y\u030a!", "xJ\u030cx PLAIN Word. \u00c9TE\u0301", "after"]
    got = token_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 1).orderBy("start").collect()
    at = 0
    for r in got:
        ids = model.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_store_of_another_kind_of_model(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, text = Tokenizer.from_file(path), "Two  words, and\n more"
    rows = token_store(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), path, 1).orderBy("start").collect()
    ids = model.encode(text, add_special_tokens=False).ids + [1]
    assert [(r.start, r.n_tokens) for r in rows] == [(0, len(ids)), (len(ids), 1)] and rows[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_in_any_script_and_case():
    from modweave.llm.token_store import WordIds, by_words, id_kind

    assert by_words(public_tokenizers.path("word_bpe_49k.json")) and not by_words(public_tokenizers.path("byte_bpe_50k.json"))

    path = public_tokenizers.path("word_bpe_49k.json")
    model, rng = Tokenizer.from_file(path), random.Random(11)
    letters = [*"abJHTWYjhtwyXK.,;:!?|*$%&#<>-'1", "\u030c", "\u0331", "\u0308", "\u030a", "\u0338", "\u00c9", "\u03a3", "\u0130", "\u212a", "\u65e5", "\u00df", "\u00e9", "\u00f7", "\u00aa", "<|endoftext|>"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(30_000)]
    kind = id_kind(path, 1)
    known = WordIds(kind)
    for part in (words[:20_000], words[10_000:]):  # the second knows some of the words
        got, lengths = known.texts(pa.array(part), model)
        want = [e.ids for e in model.encode_batch_fast(part, add_special_tokens=False)]
        assert lengths.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]
    known.LIMIT = 10
    assert known.texts(pa.array([None, "", " a b ", "a"]), model)[1].tolist() == [0, 0, 2, 1]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    p = PerfectHash.build(keys)
    assert sorted(p.number(keys).tolist()) == list(range(len(keys))) and p.size == len(keys)
    assert PerfectHash.build(keys[:0]).size == 0 and len(set(fingerprint(keys).tolist())) > 4990


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 40))]
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vilea", "vileb"]))
        rows.append((k, " ".join(words), "en" if k % 2 else "fr"))
    df = spark.createDataFrame(rows + [(900, None, None), (901, "", "xx"), (None, "w1", "en"), (5, rows[5][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = X.toxicity(df, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    test = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in test) >= 0.97 * len(test)
    kept = X.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id % 4 != 0 and doc_id < 400").count() >= 298
    assert X.toxicity(none, labels).count() == 0 and {r.predicted for r in X.toxicity(df, labels.where("toxic = 0")).collect()} == {0}


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Before, rows of more than 65,536 bytes, and those beyond a sample, weren't fitted on."""
    from pyspark.sql import functions as F

    rng = random.Random(16)
    long = lambda: " ".join(rng.choice(WORDS) for _ in range(18_000))
    rows = [(k, long() + " vilea vileb" if k % 3 == 0 else " ".join(rng.choice(WORDS) for _ in range(30))) for k in range(60)]
    assert min(len(t) for k, t in rows if k % 3 == 0) > 65_536
    df = spark.createDataFrame([(k, t, "en") for k, t in rows] + [(100 + k, f"{t} vilea", "en") for k, t in rows if k % 3], "doc_id long, text string, lang string")
    got = X.toxicity(df, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id < 100)

    few = [(k, f"{rng.choice(WORDS)} {'vilea' if k % 4 == 0 else 'fine'} {rng.choice(WORDS)}") for k in range(600)]
    df = spark.createDataFrame([(k, t, "en") for k, t in few], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")
    rule = X.CnnRule(chunk=60)
    trained, met = (X.training_rows(df, labels, r, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) for r in (rule, X.CnnRule(chunk=60, sent=0)))
    assert trained.collect() == met.collect()
    train = [k for k, _ in few if zlib.crc32(str(k).encode()) % 3 != 1]
    assert sorted(r.text for r in trained.collect()) == sorted(few[k][1] for k in train) and trained.select("chunk").distinct().count() == -(-len(train) // 60)
    seen = X._summed(trained.select("chunk", "toxic", "text").mapInArrow(X._texts_with(rule), X._SUMS))
    ids = X.word_buckets(pa.array(["vilea fine"]), 0, rule.buckets)[0]
    assert [seen[1][ids[0, 0]], seen[0][ids[1, 0]]] == [sum(k % 4 == 0 for k in train), sum(k % 4 != 0 for k in train)]
    got = {r.doc_id: (r.score, r.predicted) for r in X.toxicity(df, labels, rule).collect()}
    assert all(p == (k % 4 == 0) for k, (_, p) in got.items())
    assert got == {r.doc_id: (r.score, r.predicted) for r in X.toxicity(df, labels, rule).collect()}


def test_mix(spark, docs, none):
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r, s in ((r, r.target) for r in rows):
        by.setdefault((r.source_size, s), []).append(r)
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    assert all(t <= 2 * s and abs(sum(r.taken for r in g) - t) <= max(r.size for r in g) for (s, t), g in by.items())
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    numbered = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert mixed_documents(numbered).count() == sum(r.taken // r.size for r in mix(numbered).collect() if r.taken)
    assert mixed_documents(docs).columns == docs.columns and mix(none).count() == 0


def test_every_pass_has_its_position(spark, tmp_path):
    from modweave.llm.token_store import Shard

    rows = [(k, " ".join(["w"] * (1 + k % 7)), "a" if k % 4 == 0 else "b") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rule = MixRule()
    got = mix(df, rule).collect()
    source = {k: s for k, _, s in rows}
    late, want = {"a": 0.5, "b": -0.5}, []
    for s in "ab":
        begun = 0
        for r in sorted((r for r in got if source[r.doc_id] == s), key=lambda r: (int((h := hashlib.md5(str(r.doc_id).encode()).hexdigest())[:8], 16) % rule.buckets, h)):
            done = [(begun + k * r.source_size) / r.target for k in range(2) if begun + r.size / 2 + k * r.source_size < r.target]
            a = late[s]
            # the position at which the source's schedule has given this much
            at = [float(np.sqrt((1 - a) ** 2 + 4 * a * min(1.0, d)) - (1 - a)) / (2 * a) for d in done]
            assert np.allclose(r.positions, at) and r.taken == len(at) * r.size and (r.position is None) == (not at)
            want += [(p, r.doc_id) for p in at]
            begun += r.size
    want.sort()
    assert max(len(r.positions) for r in got) == 2
    placed = mixed_documents(df, rule, position="at").collect()
    assert [r.doc_id for r in placed] == [d for _, d in want] and np.allclose([r["at"] for r in placed], [p for p, _ in want])
    # the first pass of the one source still runs when the other's second has begun
    assert [r.doc_id for r in mixed_documents(df, rule).collect()] == [d for _, d in want]
    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_store(mixed_documents(df, rule, position="at").repartition(3), path, 1, str(tmp_path), position="at").orderBy("start").collect()
    assert [r.doc_id for r in store] == [d for _, d in want]
    at = np.concatenate([Shard(str(f)).positions for f in tmp_path.glob("*.tok")])
    assert np.allclose(np.sort(at), [p for p, _ in want])


def test_hilbert_and_nearest(spark):
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_key(grid, 3)
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).tolist() == [1] * 511
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (None, [1.0] * 8), (480, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, rule=CurveRule(block=64, reach=1.0)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = y @ y[q]
        s[50:90] = s[40]
        want = sorted((k for k in range(300) if k != q), key=lambda k: (-s[k], k))[:20]
        assert [k for k, _ in got[q]] == want and np.allclose([v for _, v in got[q]], s[want])
    assert sorted(got) == list(range(0, 300, 20))
    near = nearest(df, rule=CurveRule(block=32)).collect()
    assert np.mean([r.vec_id in dict(got[r.query_id]) for r in near]) >= 0.9
    few = nearest(df.where("vec_id < 5")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, k) for k in range(1, 5)] and nearest(df.where("false")).count() == 0


def test_reach_follows_from_the_data(spark):
    """Where neighbours lie together a query meets few rows, at the recall asked for."""
    from modweave.llm import ann

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 24))).astype(np.float32)
    y = x.astype(np.float64)
    df = spark.createDataFrame([(k, v.tolist(), 1.5) for k, v in enumerate(x)], "vec_id long, embedding array<float>, score double").repartition(4)
    seen = []
    was = ann.measured_reach
    ann.measured_reach = lambda *a: seen.append(was(*a)) or seen[-1]
    try:
        got: dict = {}
        for r in nearest(df, rule=CurveRule(block=128, recall=0.95)).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        ann.measured_reach = was
    hits = []
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.93 and seen[0] * 2 < 0.2 * 3000


def test_blocks_of_a_query_do_not_grow_with_the_table(spark, monkeypatch):
    """Before, blocks had one size whatever the table's, so of a share of all rows came answers that grew with its square."""
    from modweave.llm import ann

    x = np.random.default_rng(17).normal(size=(2000, 8)).astype(np.float32)
    y = x.astype(np.float64)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    made, was = [], ann._search

    def counted(top, near):
        def run(batches):
            for batch in was(top, near)(batches):
                total.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(ann, "_search", counted)
    for count in (400, 2000):
        total = spark.sparkContext.accumulator(0)
        got = {}
        for r in nearest(rows.where(f"vec_id < {count}"), rule=CurveRule(block=25, reach=0.25, curves=4)).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        made.append(total.value)
        hits = [len(got[q] & set(np.argsort(-(y[:count] @ y[q]))[:21].tolist())) for q in got]
        assert len(got) == count // 20 and np.mean(hits) >= 16
    assert 0 < made[1] <= 6 * made[0]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def brute_lm(rows, rule):
    """Base and model scores of (doc_id, text) rows by plain counting; counts are rounded as the rule says."""
    tokens = [lower(t).encode().split() + [None] for _, t in rows]
    counts, pairs, texts = {}, {}, 0
    for (d, _), ts in zip(rows, tokens):
        if not held(d):
            texts += 1
            for a, b in zip(["start", *ts], ts):
                counts[b] = counts.get(b, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    level = lambda n, base: int(np.floor(np.log(n) / np.log(base) + 1e-9)) + 1
    down = lambda n, base: base ** (level(n, base) - 1) if n else 0.0
    out = []
    for (d, _), ts in zip(rows, tokens):
        base = sum(np.log10((counts.get(t, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        score = 0.0
        for a, b in zip(["start", *ts], ts):
            alone = (down(counts.get(b, 0), rule.word_base) + 0.1) / (total + 0.1 * (distinct + 1))
            seen = texts if a == "start" else rule.word_base ** level(counts[a], rule.word_base) if a in counts else 0.0
            score += np.log10(min(1.0, (down(pairs.get((a, b), 0), rule.pair_base) * (seen > 0) + rule.strength * alone) / (seen + rule.strength)))
        out.append((str(d), held(d), len(ts), sum(t in counts for t in ts), total, round(float(base), 6), round(float(score), 6)))
    return sorted(out)


# one part and slice, or many of both
@pytest.mark.parametrize("rule", [LmRule(bits=64), LmRule(bits=64, part_keys=40, slice_bytes=500)])
def test_lm_score(spark, docs, none, rule):
    long = spark.createDataFrame([(2000, " ".join(f"{w}{k % 700}" for k in range(20_000) for w in WORDS[:2])), (2001, "\u00c9t\u00e9 \U0001f600 W1"), (2002, "x" * 70_000)], "doc_id long, text string")
    for table in (docs, long):
        rows = [(r[0], r[1]) for r in table.collect()]
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_score(table, rule).collect())
        want = brute_lm(rows, rule)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-4)
    assert lm_score(none).count() == 0


def test_lm_score_of_batches_cut_by_bytes(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    plain = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_score(docs, LmRule(bits=64)).collect())
    spark.conf.set(key, "2k")
    try:
        assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_score(docs, LmRule(bits=64)).collect()) == plain
    finally:
        spark.conf.set(key, before)


def test_lm_score_probes_a_key_of_many_slices_once(monkeypatch):
    """Before, each slice's keys were probed by themselves, and every batch began a slice, so the work grew with slices times parts."""
    from modweave.llm import lm_score as L

    rule, deal = LmRule(), L.Deal(1, 32)
    keys, counts = np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919), np.arange(1, 2001, dtype=np.uint64)
    words = L._keyed([(None, 0, 0, L._pack(np.diff(keys, prepend=np.uint64(0))), L._pack(counts))])
    row = next(L._build(rule, deal)(iter([words]))).to_pylist()[0]
    shape = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("size", pa.int64()), ("top", pa.int32()), ("bits", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
    sent = [{k: row.get(k) for k in shape.names}]
    own = [keys[s::40] + np.uint64(s % 3 == 0) for s in range(40)] + [keys[:500]] * 40
    sent += [{"slice": s, "part": 0, "kind": 0, "keys": L._pack(np.diff(k, prepend=np.uint64(0)))} for s, k in enumerate(own)]
    probed, was = [], L.Filter.levels
    monkeypatch.setattr(L.Filter, "levels", lambda self, k: probed.append(len(k)) or was(self, k))
    got = {r["slice"]: r for b in L._look_up(rule, deal)(iter([pa.RecordBatch.from_pylist(sent, shape)])) for r in b.to_pylist()}
    assert len(probed) == 1 and probed[0] == len(np.unique(np.concatenate(own)))
    level = dict(zip(keys.tolist(), rule.level(counts, rule.word_base).tolist()))
    for s, k in enumerate(own):
        assert L._unpack(got[s]["counts"]).tolist() == [x // 7919 if x % 7919 == 0 else 0 for x in k.tolist()]
        assert s % 3 == 0 and s < 40 or all(a >= level[x] for a, x in zip(L._unpack(got[s]["keys"]).tolist(), k.tolist()))
    texts = pa.array(["a b"] * 7 + [None, "x" * 100] + ["c d e"] * 6)
    for width in (1, 4, 15):
        cut = L._cut((pa.RecordBatch.from_arrays([texts[k : k + width]], ["text"]) for k in range(0, 15, width)), 30)
        assert [b.column(0).to_pylist() for b in cut] == [["a b"] * 7 + [None], ["x" * 100], ["c d e"] * 5, ["c d e"]]


def test_lm_score_without_training_rows(spark):
    alone = [d for d in range(200) if held(d)]
    got = lm_score(spark.createDataFrame([(d, "w1 w2") for d in alone], "doc_id long, text string")).collect()
    assert len(got) == len(alone) and all((r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and np.isfinite(r.score) for r in got)


def test_lm_chance_hits_are_few(spark, docs):
    """With the registered bits an entry, scores differ from exact ones by little."""
    rows = [(r.doc_id, r[1]) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_score(docs).collect())
    want = sorted((w[0], w[2], w[6]) for w in brute_lm(rows, LmRule()))
    off = np.array([abs(g[2] - w[2]) / w[1] for g, w in zip(got, want)])
    assert np.mean(off) < 0.03


def test_lm_pairs_seen_once_count(spark):
    texts = [" ".join(f"v{k * 50 + j}" for j in range(50)) for k in range(20)]
    rows = list(enumerate(texts)) + [(20 + k, " ".join(reversed(t.split()))) for k, t in enumerate(texts)]
    held_out = [r for r in rows if r[0] >= 20 and held(r[0])]
    df = spark.createDataFrame([r for r in rows if r[0] < 20] + held_out, "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score(df).collect()}
    # the same words in the other order were never seen as pairs
    assert held_out and all(got[d] + 1 < got[d - 20] for d, _ in held_out if not held(d - 20))


def test_lm_filter_and_packing():
    from modweave.llm.lm_score import Deal, Filter, _pack, _unpack

    full = Filter(np.full(64, 255, np.uint8), 512, LmRule(), 7)
    assert full.levels(np.arange(5, dtype=np.uint64)).tolist() == [7] * 5
    rng = np.random.default_rng(3)
    keys, levels = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)), None
    levels = rng.integers(1, 9, len(keys))
    built = Filter.build(keys, levels, LmRule())
    assert (built.levels(keys) >= levels).all() and (built.levels(keys) > levels).mean() < 0.02
    assert (built.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) | np.uint64(1 << 63)) > 0).mean() < 0.02
    for deal, kind, top in ((Deal(7, 33), 1, 33), (Deal(1, 33), 0, 63), (Deal(1000, 60), 1, 60)):
        keys = np.unique(rng.integers(0, 1 << top, 5000).astype(np.uint64))
        back = [deal.keys(raw, part, kind) for part, _, raw in deal.pieces(keys, kind)]
        assert np.array_equal(np.concatenate(back), keys)
    big = np.array([0, 255, 256, (1 << 64) - 1], np.uint64)
    assert np.array_equal(_unpack(_pack(big)), big) and len(_unpack(_pack(big[:0]))) == 0


def test_lm_probabilities_sum_below_one():
    from modweave.llm.lm_score import _END, _START, Deal, Model, _pair_keys, log_probabilities

    rng, rule = np.random.default_rng(5), LmRule()
    vocabulary = np.append(rng.integers(1, 1 << 60, 40).astype(np.uint64), _END)
    stream = vocabulary[rng.zipf(1.3, 5000) % 41]
    deal = Deal(1, 40)
    words, n = np.unique(stream, return_counts=True)
    for before in (*words[:5], _START):
        follow = stream[1:][stream[:-1] == before] if before != _START else stream[:90]
        keys, m = np.unique(_pair_keys(np.full(len(follow), before), follow, 40), return_counts=True)
        held = dict(zip(keys.tolist(), rule.level(m, rule.pair_base).tolist()))
        asked = np.unique(_pair_keys(np.full(len(words), before), words, 40))
        model = Model(rule, deal, None, 5000, len(words), 90)
        p = 10 ** log_probabilities(words, np.full(len(words), before), (rule.level(n, rule.word_base), np.array([held.get(k, 0) for k in asked.tolist()])), model)
        assert 0.3 < p.sum() <= 1.0


def test_words_and_hashes():
    from modweave.llm.words import byte_slices, find_words

    rng = random.Random(2)
    texts = [None, "", " \t\n ", *("".join(rng.choice(["a", "B", "z1", "\u00e9", "\u3000", " ", "\n", "\x0b", "\x1c", "long" * 9, "\x00"]) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    column = pa.array(texts)
    for rows in (slice(0, None), slice(5, 40), slice(7, 7), slice(1, 2)):
        found, plain = find_words(column[rows]), [(t or "").encode().split() for t in texts[rows]]
        flat = [w for ws in plain for w in ws]
        assert found.counts().tolist() == [len(ws) for ws in plain]
        assert [found.data[a:b] for a, b in zip(found.start, found.end)] == flat
        for hashes, key in ((found.hashes(), lambda w: w), (found.hashes(lower=True), lambda w: w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))), (found.hashes(most=4), lambda w: w[:4])):
            seen = {}
            assert all(seen.setdefault(key(w), h) == h for w, h in zip(flat, hashes.tolist())) and len(set(seen.values())) == len(seen)
    assert [i for s in byte_slices(column, 100) for i in range(s.start, s.stop)] == list(range(len(texts)))


def test_near_copies_of_one_family_in_blocks(spark, monkeypatch):
    """A family beyond a block is cut, and no link is lost."""
    from modweave.llm import ngram_join as J

    monkeypatch.setattr(J, "BLOCK", 300)
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(80)]
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"x{rng.randint(0, 9)}"
        rows.append((k, " ".join(words), "clash"))
    rows += [(100 + k, " ".join(rng.choice(WORDS) for _ in range(50)), "clash") for k in range(10)]
    rule = JoinRule(3, 9, 10)
    sets = {d: shingles(t, 3) for d, t, _ in rows}
    root = {d: d for d in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]) and (p := top(a)) != (q := top(b)):
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), rule).collect()}
    assert got == {d: top(d) for d in sets} and len(set(got.values())) < 45


def test_very_long_texts_and_clashing_names(spark):
    """One text of 200,000 words beside short, empty and null ones, in tables whose other columns are named as results."""
    long = " ".join(f"w{(k * k) % 5003}" for k in range(200_000))
    rows = [(1, long, "en", "s", 1, 2.0), (2, long + " end", "en", "s", 1, 2.0), (3, "", "en", None, 1, 2.0), (4, None, None, "s", 1, 2.0), (5, "one two three", "fr", "t", 1, 2.0), (25, "w1 w4 w9", "fr", "t", 1, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score double")
    joined = {r.doc_id: r.component_id for r in ngram_jaccard_join(df, JoinRule(3, 9, 10)).collect()}
    assert joined == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 25: 25}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df).collect()}
    assert cut[1] == (200_000, 0) and cut[2] == (200_001, 200_000) and cut[4] == (0, 0)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts[1] == len(model.encode(long).ids) and counts[3] == counts[4] == 0
    bench = spark.createDataFrame([(7, " ".join(long.split()[500:530]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate(df, bench).collect()}
    assert hits[1] >= 30 and hits[1] == hits[2] and hits[5] == 0
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (25, 1, 0)], "doc_id long, toxic int, predicted int")
    assert X.toxicity(df, labels).count() == 6 and X.without_toxic(df, labels).columns == df.columns
    assert sum(r.taken for r in mix(df).collect()) > 0 and mixed_documents(df).columns == df.columns
    store = {r.doc_id: r.n_tokens for r in token_store(df, public_tokenizers.path("word_bpe_49k.json"), 1).collect()}
    assert store[1] + len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("end", add_special_tokens=False).ids) == store[2] and store[4] == 1
    scores = {r.doc_id: r.n_tokens for r in lm_score(df).collect()}
    assert scores == {1: 200_001, 2: 200_002, 3: 1, 4: 1, 5: 4, 25: 4}
