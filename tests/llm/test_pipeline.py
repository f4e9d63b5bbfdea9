"""Each stage of the corpus pipeline against a brute-force version of its decisions, and all of them in a row."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

WORDS = [f"w{k}" for k in range(300)]
#: A clashing name, and a column that no stage knows.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, position int"


def some(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    texts = [some(rng, rng.randint(20, 80)) for _ in range(60)]
    item = some(rng, 30)
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(60 + k, t + " end") for k, t in enumerate(texts[:8])]  # near copies
    rows += [(70, texts[9]), (71, texts[9]), (72, None), (73, ""), (74, " \n "), (75, "two words"), (76, "two words")]
    rows += [(80, item), (None, some(rng, 10) + " " + item), (None, some(rng, 40)), (None, None)]
    rows += [(90, some(rng, 50)), (90, texts[10]), (91, texts[11]), (91, texts[11]), (92, "long " + some(rng, 30_000))]
    rows += [(7, some(rng, 40)), (12, texts[12]), (12, texts[12] + " tail")]  # ids that occur twice
    rows = [(d, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", 1, "other", k) for k, (d, t) in enumerate(rows)]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows[0], COLUMNS)
    plain = spark.createDataFrame([(*r[:5], r[6]) for r in rows[0]], COLUMNS.replace("TEXT string, ", ""))
    plain.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[1]), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder


def keyed(rows):
    return sorted(((str(r[0]), str(r[1])) for r in rows))


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_toxicity_stage(spark, tables):
    from modweave.llm.toxicity import THRESHOLD, toxicity

    docs, folder = tables
    plain = spark.createDataFrame([r[:5] for r in docs.collect()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = P.drop_toxic(spark, docs, folder).collect()
    told = [(r.doc_id, r.score, r.threshold, r.rejected) for r in toxicity(plain, labels).collect()]
    assert all(rejected == (score >= threshold) for _, score, threshold, rejected in told) and THRESHOLD == 0.7
    gone = sorted(str(d) for d, _, _, rejected in told if rejected)
    assert sorted([str(r.doc_id) for r in kept] + gone) == sorted(str(r.doc_id) for r in plain.collect())
    assert P.drop_toxic(spark, docs, folder).columns == docs.columns and P.drop_toxic(spark, docs.where("false"), folder).count() == 0


def test_near_copy_stage(spark, rows, tables):
    docs, folder = tables
    own = [(r[0], r[1], shingles(r[1])) for r in rows[0]]
    root = list(range(len(own)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, a) in enumerate(own):
        for j in range(i):
            if a and own[j][2] and 5 * len(a & own[j][2]) >= 4 * len(a | own[j][2]):
                root[top(i)] = top(j)
    kept = P.drop_near_copies(spark, docs, folder).collect()
    left = [(r[0], r[1]) for r in kept]
    for i, (d, t, s) in enumerate(own):
        if d is None or not s:
            assert left.count((d, t)) == sum((d, t) == x[:2] for x in own)
    by: dict = {}
    for i, (d, t, s) in enumerate(own):
        if d is not None and s:
            by.setdefault(top(i), []).append((d, t))
    for group in by.values():
        stay = [x for x in left if x in group]
        assert len(stay) == 1 and stay[0][0] == min(d for d, _ in group), group
    assert P.drop_near_copies(spark, docs, folder).columns == docs.columns and P.drop_near_copies(spark, docs.where("false"), folder).count() == 0


def test_decontamination_stage(spark, rows, tables):
    docs, folder = tables
    item = rows[1].split()
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}

    def bad(text):
        w = (text or "").lower().split()
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = P.drop_contaminated(spark, docs, folder).collect()
    want = [r for r in rows[0] if not bad(r[1])]
    assert len(want) == len(rows[0]) - 2 and keyed(kept) == keyed(want)
    assert P.drop_contaminated(spark, docs.where("false"), folder).count() == 0


def test_mixing_stage(spark, rows, tables):
    docs, folder = tables
    got = P.mix_sources(spark, docs, folder).collect()
    assert [r[P.POSITION] for r in got] == sorted(r[P.POSITION] for r in got)
    size: dict = {}
    for r in rows[0]:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    weight = {s: w for s, w in zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2, 3])}
    target, left, open_ = dict.fromkeys(size, 0.0), min(1.5 * sum(size.values()), 2.0 * sum(size.values())), set(size)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 2 * size[s]}
        for s in full or open_:
            more = 2 * size[s] - target[s] if full else share * weight[s]
            target[s], left = target[s] + more, left - more
        open_ -= full
        if not full:
            break
    for s in size:
        taken = [(r[0], r[1]) for r in got if r.source == s]
        largest = max(len((r[1] or "").split()) for r in rows[0] if r[3] == s)
        assert abs(sum(len(t.split()) for _, t in taken) - target[s]) <= largest
        for x in set(taken):
            assert taken.count(x) <= 2 * sum(x == (r[0], r[1]) for r in rows[0] if r[3] == s)
    # rows without id and rows that share an id are rows of their own
    assert any(r[0] is None for r in got) and len({r[1] for r in got if r[0] == 90}) == 2
    assert P.mix_sources(spark, docs.where("false"), folder).count() == 0


def test_token_stage_and_whole_run(spark, rows, tables):
    docs, folder = tables
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = P.mix_sources(spark, docs.drop("position"), folder)
    placed = sorted(((r[P.POSITION], r[0], r[1]) for r in mixed.collect()), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    got = P.write_tokens(spark, mixed, folder).orderBy("start").collect()
    assert len(got) == len(placed)
    ids = [model.encode(t, add_special_tokens=False).ids + [1] for _, _, t in placed]
    start = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    assert [r.start for r in got] == start[:-1].tolist() and [r.doc_id for r in got] == [d for _, d, _ in placed]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert P.write_tokens(spark, mixed.where("false"), folder).count() == 0
    # the run is its stages, one after the other
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        now = spark.createDataFrame(now.collect(), now.schema)
        now = stage(spark, now, folder)
    want = sorted(map(str, now.collect()))
    assert want and sorted(map(str, P.run(spark, folder).collect())) == want
