"""The pipeline, stage by stage, against plain Python that calls no operator; and its odd cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import decontaminate, exact_dedup, mixing, quality, simhash
from readloom.llm.queries import tokenizer_path

MASK = (1 << 64) - 1


def plain_score(text, table, bias):
    """Mean of the numbers of all words and 3- to 5-grams in <word>, one by one."""
    top, words, found = 64 - quality.BITS, (text or "").split(), []
    for i, w in enumerate(words):
        w = " again " if i and words[i - 1] == w else w
        found.append(xxhash.xxh64_intdigest(w) >> top)
        for n in quality.GRAMS:
            line = f"<{w}>"
            for i in range(len(line) - n + 1):
                h = n
                for c in line[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & MASK
                    h ^= h >> 29
                found.append(h >> top)
    z = bias + (sum(float(table[x]) for x in found) / len(found) if found else 0.0)
    return 1 / (1 + math.exp(-z))


def plain_similar(rows):
    """The rows that stay of (doc_id, text, ...): the least id of each group of five-word similarity 0.8."""
    words = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (r[1] or "").split()] for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, i)
        best[root[i]] = min(best.get(root[i], key), key)
    return [rows[k[2]] for k in best.values()]


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split()


def plain_clean(rows, bench):
    def shingles(text):
        w = plain_words(text)
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    items = [s for s in map(shingles, bench) if s]
    return [r for r in rows if not any(len(s & own) >= 0.8 * len(s) - 1e-9 for own in [shingles(r[1])] for s in items)]


def plain_mix(rows):
    """Counter of (doc_id, text) from (doc_id, text, source)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = lambda r: len((r[1] or "").split())
    sizes = {s: sum(map(size, by[s])) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    out = Counter()
    for s in names:
        whole = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        part, upto = target[s] - whole * sizes[s], 0
        digest = lambda r: int(hashlib.md5(f"7:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        for r in sorted(by[s], key=digest):
            upto += size(r)
            out[r[0], r[1]] += whole + (size(r) > 0 and upto - size(r) / 2 <= part)
    return out


def plain_tokens(rows):
    from tokenizers import Tokenizer

    t, out, at = Tokenizer.from_file(tokenizer_path()), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    table, bias = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for doc_id, text, _ in rows:
        assert scores[doc_id] == pytest.approx(plain_score(text, table, bias), rel=1e-4)
    rows = [r for r in rows if plain_score(r[1], table, bias) >= 0.3]
    mixed = plain_mix(plain_clean(plain_similar(rows), [r.text for r in bench.collect()]))
    want = plain_tokens([k for k, n in mixed.items() for _ in range(n)])
    got = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, n long, all long, kept_id long, found_id long, mixed_id long, rejected_id long, kept_row long, draw long, size long"


@pytest.fixture(scope="module")
def odd(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "One two three four five six", "a"), (5, "one two three four five six", "b"),
        (5, "one two three four five six", "b"), (5, "of the same id but a wholly different text", "b"), (6, long_, "b"), (None, "no id here at all but words", "c"),
        (None, "another text without an id of its own", "c"), (7, "the passage of the benchmark that leaks stands here", None), (8, "x<|endoftext|>y 日本 \x1f z", None),
    ]
    return spark.createDataFrame([(*r[:2], "en", r[2], 0, *[9] * 9) for r in rows], ODD)


def bag(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "passage of the benchmark that leaks"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got, none = stage(spark, odd, str(tmp_path)), stage(spark, odd.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == got.columns
        if k < 4:
            assert got.columns == odd.columns and got.schema == odd.schema
        if k == 0:
            assert bag(got) == bag(odd)  # one class of labels alone: nothing to tell good from bad by
        if k == 1:
            assert bag(got) == Counter(r[:2] for r in plain_similar(rows))
        if k == 2:
            assert bag(got) == Counter(r[:2] for r in rows if r[0] != 7)
        if k == 3:
            assert {x: n for x, n in bag(got).items() if (x[1] or "").split()} == {x: n for x, n in plain_mix(rows).items() if n and (x[1] or "").split()}
        if k == 4:
            assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain_tokens([r[:2] for r in rows])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_exact_copies(spark, odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    texts = Counter("".join((r.text or "").split()) for r in odd.collect())
    assert Counter("".join((r.text or "").split()) for r in kept.collect()) == Counter(dict.fromkeys(texts, 1))
    two = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, "c"), (2, "a   b")], "doc_id long, text string")
    assert bag(exact_dedup.drop_exact_copies(two)) in (Counter([(2, "a   b"), (None, "c")]),)
    assert [(r.doc_id, r.kept) for r in exact_dedup.exact_groups(two).where("kept").orderBy("doc_id").collect()] == [(None, True), (2, True)]


def test_mixed_copies_part(spark):
    """Rows equal in id and text are cut as finely as others; the mix meets its target."""
    df = spark.createDataFrame([(None, "one two three", "hot")] * 500 + [(i, "some words", "cold") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mixed(df).collect()
    for s in ("hot", "cold"):
        part = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 3
    assert Counter(r.text for r in mixing.repeat_rows(df).collect()) == Counter({"one two three": sum(r.repeats for r in rows if r.source == "hot"), "some words": sum(r.repeats for r in rows if r.source == "cold")})


def test_scratch_is_deleted(spark, data):
    from readloom.llm import common

    mark = common.scratch_mark()
    corpus_pipeline.run(spark, data)
    assert common.scratch_mark() - mark == 1
    assert simhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert decontaminate.drop_contaminated(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 1


def test_blocks_of_items(spark, odd):
    bench = spark.createDataFrame([(i, f"passage {i} of the benchmark that leaks") for i in range(9)] + [(9, "passage of the benchmark that leaks")], "item_id long, text string")
    assert bag(decontaminate.drop_contaminated(odd, bench, block_chars=60)) == bag(odd.where(~F.col("doc_id").eqNullSafe(7)))


def family(copies, seed=3):
    """Near copies of one text, most pairs of them about as similar as the wanted 0.8, and texts that share a passage only."""
    r = np.random.default_rng(seed)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(9)]
    docs = []
    for i in range(copies):
        copy = list(base)
        for at in r.choice(120, r.integers(1, 4), replace=False):
            copy[at] = f"x{i}y{at}"
        docs.append((i, " ".join(copy)))
    docs += [(1000 + i, " ".join([f"o{i}w{k}" for k in range(20)] + passage)) for i in range(20)]
    return docs


def test_near_dedup_in_rounds(spark, monkeypatch):
    """The last pairs made in many rounds lose no link; no table of the stage is left but what its result reads."""
    from readloom.llm import common, similar

    docs = family(12)
    monkeypatch.setattr(similar, "REPS", 1)
    monkeypatch.setattr(similar, "FIRST", 1)
    monkeypatch.setattr(similar, "SHARE", 0.0)
    monkeypatch.setattr(similar, "SAMPLE", 1)  # so that the passage is not known as common, and its list is long
    monkeypatch.setattr(similar, "PAIRS", 500)
    monkeypatch.setattr(similar, "PAIRS_A_KIND", 0)
    rounds, counted = [], similar.rounds_of
    monkeypatch.setattr(similar, "rounds_of", lambda *a: rounds.append(counted(*a)) or rounds[-1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    mark = common.scratch_mark()
    got = simhash.drop_near_duplicates(df)
    assert common.scratch_mark() - mark <= 2  # the table with row keys, and the rows kept
    assert bag(got) == Counter(plain_similar(docs)) and rounds[0] > 1


def test_near_dedup_pairs_in_proportion(spark):
    """Each kind meets a fixed number of others first, however long the lists and however many it is in."""
    from readloom.llm import similar

    rows = [(key, kind, 100) for kind in range(200) for key in range(kind % 7, 40)]
    pairs = similar.least_neighbours(spark.createDataFrame(rows, "key long, kind long, n int")).where("a <> b").distinct()
    assert 200 - similar.FIRST <= pairs.count() <= 200 * similar.FIRST


def test_common_shingles_of_a_share(spark, monkeypatch):
    """What is known as common grows with the table; of too many, the most frequent ones stay."""
    from readloom.llm import similar

    df = spark.createDataFrame([(i, f"a{i % 8} b c d e f{i}") for i in range(4000)], f"{similar.ROW} long, text string")
    monkeypatch.setattr(similar, "SAMPLE", 4)
    keys, often = similar.common_shingles(df, 5)
    assert len(keys) == 8 and 250 < often.sum() < 800 and (np.diff(keys.astype(object)) > 0).all()
    monkeypatch.setattr(similar, "COMMON", 5)
    assert len(similar.common_shingles(df, 5)[0]) <= 5


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    """SimHash and vantage-point trees find the pairs within reach, and the stage asks them; the exact steps find the rest."""
    from readloom.llm import similar

    base = [f"b{i}" for i in range(400)]
    docs = [(1, " ".join(base)), (2, " ".join([*base[:-1], "z"])), (3, " ".join(f"o{i}" for i in range(400))), (4, ""), (5, " ".join(base[:380]))]
    df = spark.createDataFrame(docs, f"{similar.ROW} long, text string").select(similar.ROW, similar.ROW, "text").toDF(similar.ROW, "doc_id", "text")
    sets = similar.prefixes(df, 0.8, 5)
    rows = {r.doc_id: r for r in sets.collect()}
    seen, link = [], simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda fps: seen.append(1) or link(fps))
    near = {frozenset((r.a, r.b)) for r in similar.simhash_neighbours(sets, link).collect() if r.a != r.b}
    plain = {frozenset((x.kind, y.kind)) for x in rows.values() for y in rows.values() if x.kind != y.kind and ((x.fp ^ y.fp) & (1 << 64) - 1).bit_count() <= 3}
    assert near <= plain and (near or not plain)
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert bag(got) == Counter(plain_similar(docs)) and seen == [1]
