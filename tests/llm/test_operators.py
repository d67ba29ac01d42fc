"""The ten operators: brute force, exact round trips, held-out accuracy, and odd inputs."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readloom.llm import decontaminate, exact_dedup, html_text, lm_score, mixing, quality, rangecoder, simhash, tokens, url_filter, warc
from readloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, None, "en", None, 0, 7, 1), (2, "", "en", "a", 0, 7, 1), (3, " \n\t", None, "a", 3, 7, 1), (4, "One two three four five six", "en", "a", 0, 7, 1),
        (5, "one two three four five six", "en", "b", 0, 7, 1), (5, "one two three four five six", "en", "b", 0, 7, 1),
        (6, "word " * 40_000, "en", "b", 0, 7, 1), (None, "no id here at all", "en", "c", 0, 7, 1), (7, "onetwothreefourfivesix", "en", "c", 0, 7, 1),
        (8, "x<|endoftext|>y 日本 \x1f z", "en", None, 0, 7, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(odd, spark):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == 10 == len(exact_dedup.exact_groups(odd, content_hash=lambda c: F.lit("same")).collect())
    by = {r.doc_id: r for r in rows}
    assert (by[2].keep_id, by[2].group_size, by[3].kept) == (3, 3, True)
    assert (by[7].keep_id, by[7].group_size) == (5, 3)
    assert by[7].text_sha256 == hashlib.sha256(b"onetwothreefourfivesix").hexdigest()
    clash = exact_dedup.exact_groups(odd, content_hash=lambda c: F.lit("same")).orderBy("doc_id", "text_sha256").collect()
    assert clash == exact_dedup.exact_groups(odd).orderBy("doc_id", "text_sha256").collect()
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A  b") == xxhash.xxh64_intdigest(b"a b", 42)
    words = [f"W{i % 17}É" for i in range(300)]
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).replace("W", "w").encode(), 42) for i in range(298)]
    assert simhash.fingerprint("\t".join(words)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 298)


def brute_roots(points):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= 3:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {p: find(p) for p in points}


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "LEAF", 16)
    r = np.random.default_rng(3)
    points = {int(x) for x in r.integers(0, 2**63, 250)}
    for p in list(points)[:60]:
        points |= {p ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))), p ^ 7 << int(r.integers(60))}
    points = sorted(p & (1 << 63) - 1 for p in points)
    from readloom.llm.components import connected_components

    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {x.node: x.root for x in connected_components(simhash.link_fingerprints(fps)).collect()}
    assert {p: got.get(p, p) for p in points} == brute_roots(points)


def test_simhash_shards_are_dealt_again(spark, monkeypatch):
    """A sample too small for one tree to make shards of the wanted size: they are dealt again until they are, and no link is lost."""
    monkeypatch.setattr(simhash, "SHARD", 10)
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "SAMPLE", 40)
    monkeypatch.setattr(simhash, "MAX_SHARDS", 4)
    levels = []
    deal = simhash._deal_again
    monkeypatch.setattr(simhash, "_deal_again", lambda d, r, k: levels.append(k) or deal(d, r, k))
    r = np.random.default_rng(5)
    points = {int(x) for x in r.integers(0, 2**63, 300)}
    for p in list(points)[:80]:
        points |= {p ^ (1 << int(r.integers(62))) ^ (1 << int(r.integers(62))), p ^ 7 << int(r.integers(60))}
    points |= {5 ^ (1 << int(r.integers(62))) ^ (1 << int(r.integers(62))) for _ in range(120)}  # a ball that cannot be cut
    points = sorted(p & (1 << 63) - 1 for p in points)
    from readloom.llm.components import connected_components

    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {x.node: x.root for x in connected_components(simhash.link_fingerprints(fps)).collect()}
    assert {p: got.get(p, p) for p in points} == brute_roots(points) and max(levels) >= 2


def test_simhash_odd(odd):
    rows = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 10 and by[3] == 1 and by[5] == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 6}


def test_components_chain(spark):
    from readloom.llm.components import connected_components

    chain = spark.range(0, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in connected_components(chain).collect()} == {(i, 0) for i in range(1, 41)}


def test_range_coder():
    r = np.random.default_rng(5)
    blocks = [r.integers(0, 65536, n).astype(np.uint16) for n in (1, 2, 700)] + [np.full(500, 65535, np.uint16), (r.zipf(1.3, 900) % 65536).astype(np.uint16)]
    codes = rangecoder.encode_blocks(blocks)
    for b, d in zip(blocks, rangecoder.decode_blocks(codes, [len(b) for b in blocks]), strict=True):
        assert (b == d).all()
    assert len(codes[3]) < 200


def test_token_file_damage():
    data = tokens.pack_file([1, None, 3], [2, 1, 3], np.array([5, 2, 2, 9, 9, 2], np.uint32))
    ids, lengths, got = tokens.unpack_file(data)
    assert (ids, lengths.tolist(), got.tolist()) == ([1, None, 3], [2, 1, 3], [5, 2, 2, 9, 9, 2])
    with pytest.raises(ValueError):
        tokens.unpack_file(data[:-1] + bytes([data[-1] ^ 1]))


def test_tokens(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = odd.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()
    want, at = [], 0
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens.token_round_trip(odd, tokenizer_path()).collect()), key=lambda x: x[1]) == want
    assert tokens.token_round_trip(odd.limit(0), tokenizer_path()).count() == 0


def fill(sizes, weights, epochs=3.0):
    total, target, left = sum(sizes), [None] * len(sizes), set(range(len(sizes)))
    while left:
        rest = total - sum(t for t in target if t is not None)
        level = rest / sum(weights[i] for i in left)
        over = {i for i in left if level * weights[i] > epochs * sizes[i]}
        if not over:
            for i in left:
                target[i] = level * weights[i]
            return target
        for i in over:
            target[i] = epochs * sizes[i]
        left -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_water_fill(spark, seed):
    r = np.random.default_rng(seed)
    sizes = [int(x) for x in r.choice([0, 1, 5, 40, 900, 20_000], 12)]
    df = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [x.target for x in mixing.water_fill(mixing.cyclic_weights(df)).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, [i % 3 + 1 for i in range(12)]))


def test_mixing(odd, spark, data):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed(odd.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = mixing.mixed(docs).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))
    for source in {r.source for r in found}:
        part = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part)
    assert mixing.repeat_rows(docs).count() == sum(r.repeats for r in found)


def test_url_filter(spark):
    urls = ["http://a.com/x", "HTTP://B.example.COM/en/1?q", "https://www.example.com/en/2#t", "https://x.net/es/9", "https://x.net", "bad", None, "x://com", "http://notcom/en/"] + [f"http://s{i}.net/fr/{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("b.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][:3] == ("x.net", "", None) and got[4][3] == "block"  # mined: net is blocked
    assert got[5] == got[6] == ("", "", None, "allow") and got[8][2] is None and len(got) == len(urls)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_quality(spark, odd):
    r = np.random.default_rng(1)
    good = [" ".join(r.choice(["the", "of", "and", "tion", "other", "then"], 60)) for _ in range(150)]
    bad = [" ".join(r.choice(["BUY!!", "$$$", "###", "click%%"], 60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(3, 1), (999, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    held = [x for x in rows if x.held_out]
    assert {x.doc_id for x in held} == {i for i in range(210) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(x.predicted == int(x.doc_id < 150) == int(x.score >= 0.3) for x in held)
    scored = quality.quality_scores(odd, labels.limit(0)).collect()
    assert len(scored) == 10 and all(x.score == pytest.approx(0.5) for x in scored)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_decontaminate(spark, odd):
    r = np.random.default_rng(2)
    item = [f"w{r.integers(1000)}" for _ in range(40)]
    hurt = list(item)
    hurt[20] = "CHANGED"
    noise = [f"n{r.integers(50)}" for _ in range(4000)]
    docs = [(1, " ".join(noise[:2000] + item + noise[2000:])), (2, ", ".join(noise[:9] + hurt).upper()), (3, " ".join(item[:20])), (4, " ".join(noise)), (5, "tiny item"), (6, "a tiny item more words"), (7, None)]
    bench = [(10, " ".join(item)), (11, "Tiny  item!"), (12, ""), (13, None)]
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(1, 10), (2, 10), (5, 11)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contained_items(d, b, block_chars=100).collect())) == sorted(map(tuple, found.collect()))
    assert decontaminate.contained_items(odd, b.limit(0)).count() == 0 and decontaminate.drop_contaminated(odd, b).columns == odd.columns


def test_lm_scores(spark, odd):
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(list("abcdefg"), n)) for n in r.integers(0, 40, 30)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    words = [(t or "").split() for t in texts]
    per = [grams(w) for w in words]
    every, total = sum(per, Counter()), sum(map(len, words))
    for row in lm_score.lm_scores(df).collect():
        w, own, s = words[row.doc_id], per[row.doc_id], 0.0
        left = lambda g, own=own: every[g] - own[g]
        for i in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else None
                if g and n > 1 and left(g) > 0:
                    s += math.log(left(g) / left(g[:-1]))
                    break
                if g and n > 1:
                    s += math.log(0.4)
                if n == 1:
                    s += math.log(max(left(g), 1) / max(total - len(w), 1))
        assert row.log_score == pytest.approx(s) and row.n_words == len(w)
    assert lm_score.lm_scores(odd).count() == 10 and lm_score.lm_scores(odd.limit(0)).count() == 0


def test_html():
    page = '<body><div class="site-header">S</div><ul class=menu><li>A<li>B</ul><div class="wrap with-sidebar"><main><h1>T &amp; U</h1><p>one<br>two &nbsp;x<p>three <b>bold</b>er<div class="ad">Buy</div><form>f<input></form></main><aside>s</aside></div><div id="comments"><article class="comment">hi</article></div><script>if(a<b)</script><footer>f'
    assert html_text.main_text(page, ("", {}, {})) == "T & U\n\none two x\n\nthree bolder"
    assert html_text.main_text("", ("", {}, {})) == "" and html_text.main_text("<!-- open", ("", {}, {})) == ""
    w = html_text.Wrapper()
    for i in range(5):
        w.align(*html_text.read_page(f"<body><div class=top>Welcome</div><div id=c><h2>t{i}</h2>" + f"<p>word {i} is here and long enough</p>" * (i + 1) + "</div>" + "<p>Bye</p>" * (i > 2)))
    assert "(<div.top> #CONST </>)" in w.expression() and "(<p> #TEXT </>)+" in w.expression()
    assert w.expression().endswith("(<p> #CONST </>)? </>)")
    assert html_text.main_text("<body><div class=top>Welcome</div><div id=c><h2>n</h2><p>x</p></div>", w.decisions()) == "n\n\nx"


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, None), (1, "http://a/b", "<article><p>x</article>"), (2, "bad", "<p>y&#x41;")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect()) == [(1, "", 0), (1, "x", 1), (2, "yA", 2)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "<p>a"), (2, "u\r\nX: y", "<p>a"), (5, None, "<p>a"), (3, "u", None), (4, "u", ""), (None, "u", "<p>a"), (9, "u", "é" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, size string")
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 5), 2: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), 9: ("response", None),
    }
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    records = [warc.make_record(i, "u", f"<html>{i} some words that repeat</html>".encode() * 50, None, warc.digest_of(f"<html>{i} some words that repeat</html>".encode() * 50), "2024-01-01T00:00:00Z") for i in range(200)]
    assert list(warc.unpack_archive(warc.pack_archive(records))) == records


def test_similar_groups(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    r = np.random.default_rng(6)
    base = [f"b{r.integers(9999)}" for _ in range(200)]
    for i in range(40):  # a group of near copies, more than REPS, that differ by far more than 3 bits
        copy = list(base)
        for at in r.choice(200, r.integers(1, 5), replace=False):
            copy[at] = f"x{i}y{at}"
        docs.append((10_000 + i, " ".join(copy)))
    docs += [(20_000, " ".join(base[:100] + [f"z{i}" for i in range(100)])), (20_001, "short one"), (20_002, "short  ONE"), (20_003, "short two")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in ((t or "").lower().split() for _, t in docs)]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    least = {}
    for k, (doc_id, _) in zip(root, docs, strict=True):
        least[k] = min(least.get(k, doc_id), doc_id)
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == sorted(least.values())


def test_similar_rows_without_ids(spark):
    rows = [(None, f"{w} text number {w} of its own and {w} more") for w in ("first", "second", "third")] + [(5, "some five word long text"), (5, "a wholly different text of this id"), (None, "some five word long text")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:5], key=str)


def test_rows_are_judged_by_themselves(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(1)
    good = [" ".join(r.choice(["the", "of", "and", "tion", "other", "then"], 60)) for _ in range(150)]
    bad = [" ".join(r.choice(["BUY!!", "$$$", "###", "click%%"], 60)) for _ in range(60)]
    more = [(None, good[0]), (None, bad[0]), (900, good[1]), (900, bad[1])]
    spark.createDataFrame([(i, int(i < 150)) for i in range(210)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(list(enumerate(good + bad)) + more, "doc_id long, text string")
    kept = Counter((x.doc_id, x.text) for x in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect())
    assert kept == Counter([*enumerate(good), more[0], more[2]])
    bench = spark.createDataFrame([(1, bad[0])], "item_id long, text string")
    rows = [(None, bad[0]), (None, good[0]), (7, bad[0]), (7, good[1])]
    left = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert left.columns == ["doc_id", "text"] and Counter(map(tuple, left.collect())) == Counter([rows[1], rows[3]])


def test_html_copies_are_one_page(spark):
    pages = [f"<body><div class=top>Welcome</div><div id=c><p>page {i} of the host, long enough</p></div>" for i in range(20)]
    pages += ["<body><div class=top>Welcome</div><div id=c><p>copied page of some length</p><blockquote>quoted once</blockquote></div>"] * 6
    pages += ["<article><p>an own page</p><p class=own>own words</p></article>"] * 6
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[0] == "page 0 of the host, long enough" and got[20] == "copied page of some length\n\nquoted once" and got[26] == "an own page\n\nown words"
    w = html_text.Wrapper()
    for p in pages:
        w.align(*html_text.read_page(p))
    assert all(html_text.main_text(p, w.decisions()) == got[i] for i, p in enumerate(pages))


def test_html_places_of_large_host(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:05}")  # noqa: E731 (digits would be folded)
    rows = [(i, "http://h/", f"<body><div class=top>Welcome</div><div id=post-{word(i)}><p>{f'article {i} ' * 20}</p></div><div class=lead><p>tease {i}</p></div>") for i in range(9000)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(f"article {i} article" in got[i] and "Welcome" not in got[i] for i in range(9000))


def test_html_regions_of_main():
    page = f"<main><h1>Title</h1><p>lead</p><article><p>{'long body ' * 50}</p></article><article><p>short</p></article></main>"
    assert html_text.main_text(page, ("", {}, {})) == "\n\n".join(["Title", "lead", ("long body " * 50).strip(), "short"])


def test_url_filter_deep_path(spark):
    urls = [f"https://h{i}.net/{kind}/a/b/c/d/e/f/g/h/{word}" for i in range(20) for kind, word in (("es", "shop"),)] + [f"https://h{i}.com/x/a/b/c/d/e/f/g/h/news" for i in range(20)]
    urls += ["https://q.org/x/a/b/c/d/e/f/g/h/shop", "https://q.org/x/a/b/c/d/e/f/g/h/news"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), min_support=0.3).collect()}
    assert got[40].verdict == "block" and "path9:shop" in got[40].mined and got[41].verdict == "allow"


def test_html_wrapper_alone_decides(spark):
    """No article, no class: what varies at its place is text, what does not is the template, told apart by the order of the elements."""
    pages = [f"<body><div><p>Home Products Contact</p></div><div><p>text {i} of this page alone</p>{'<p>more of it ' + str(i) + '</p>' * (i % 3)}</div><div><p>Imprint</p></div></body>" for i in range(30)]
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got[0] == "text 0 of this page alone\n\nmore of it 0" and not any("Home" in t or "Imprint" in t for t in got.values())
    assert "Home" in html_text.main_text(pages[0], ("", {}, {}))  # without the wrapper


def test_html_against_naive_aligner(spark):
    """Pages of plain nested elements, aligned by plain Python: order where the numbers agree, groups where they do not, constants by place."""
    import re
    import xml.etree.ElementTree as ET

    r = np.random.default_rng(8)
    pages = []
    for i in range(40):
        items = "".join(f"<li>item {r.integers(1000)} of {i}</li>" for _ in range(r.integers(1, 5)))
        pages.append(f"<body><div><p>Top line</p><p>Slogan</p></div><div><div><h2>head {i}</h2><ul>{items}</ul></div><div><p>words {r.integers(10**6)} here</p></div></div><div><p>Bottom</p><p>{'even' if i % 2 else 'odd'} page</p></div></body>")
    trees = [ET.fromstring(p) for p in pages]
    counts = {}

    def count(e, labels):
        for tag in {k.tag for k in e}:
            counts.setdefault(f"{labels}/{tag}", set()).add(sum(k.tag == tag for k in e))
        for k in e:
            count(k, f"{labels}/{k.tag}")

    def texts(e, labels, place):
        out = [(place, e.text)] if e.text else []
        seen = Counter()
        for k in e:
            seen[k.tag] += 1
            own = f"{labels}/{k.tag}"
            out += texts(k, own, (*place, k.tag, seen[k.tag] if len(counts[own]) == 1 and max(counts[own]) > 1 else 0))
        return out

    for t in trees:
        count(t, "/body")
    per = [texts(t, "/body", ()) for t in trees]
    by = {}
    for p in per:
        for place, text in p:
            by.setdefault(place, set()).add(text)
    want = ["\n\n".join(t for place, t in p if len(by[place]) > 1) for p in per]
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)]
    got = {x.page_id: x.text for x in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    main = [re.sub(r"\n\n(even|odd) page$", "", w) for w in want]  # outside the place of most of the varying text
    assert [got[i] for i in range(40)] == main


def test_html_inline_classes_and_forms():
    page = '<body><form><div class=menu>m</div><article><p>Big <span class="related">linked</span> text about <em class="share">market share</em></p></article></form></body>'
    assert html_text.main_text(page, ("", {}, {})) == "Big linked text about market share"
    deep = "<div>" * 60 + "<p>one</p>" + "</div>" * 20 + "<p>two</p>" + "</div>" * 40
    assert html_text.main_text(deep, ("", {}, {})) == "one\n\ntwo"
    blocks, _ = html_text.read_page(deep)
    assert blocks[0].place != blocks[1].place


def test_html_odd_rows(spark):
    long_ = "<article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://h/", long_), (2, "http://h/", None), (None, None, "<p>x"), (2, "http://h/", ""), (3, "http://h/", "<article><p>a</article>"), (3, "http://h/", "<article><p>a</article>")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "page_id long, url string, html string, host string, text string, ordered string")
    got = html_text.extract_text(df).collect()
    assert len(got) == 6 and max(r.n_chars for r in got) == sum(len(f"paragraph {i} of many") for i in range(20_000)) + 2 * 19_999
    assert sorted((r.page_id or 0, r.text) for r in got if r.page_id != 1) == [(0, "x"), (2, ""), (2, ""), (3, "a"), (3, "a")]


def test_url_rules_against_naive_miner(spark):
    """All frequent sets, rules, prunings and verdicts by plain Python over the tokens of each different URL."""
    from itertools import combinations

    r = np.random.default_rng(11)
    urls = []
    for _ in range(160):
        host = f"{r.choice(['www', 'cdn', 'my-shop'])}.site{r.integers(3)}.{r.choice(['net', 'com', 'org'])}"
        urls.append(f"https://{host}/{r.choice(['es', 'fr', 'en', 'x'])}/{r.choice(['news', 'shop', 'item7', 'item8'])}")
    urls += urls[:20] + ["nonsense", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x for x in url_filter.judge_urls(df, min_support=0.08, min_confidence=0.6).collect()}
    parts = {x.page_id: (x.host, x.path) for x in got.values()}

    def tokens(host, path):
        labels = [x for x in host.split(".") if x]
        out = {("tld:" if i == len(labels) - 1 else "host:") + x for i, x in enumerate(labels)}
        out |= {f"word:{w}" for x in labels if "-" in x for w in x.split("-")}
        return frozenset(out | {f"path{i}:" + "".join(np.array(list(x))) .replace("7", "0").replace("8", "0") for i, x in enumerate(y for y in path.split("/") if y)})

    def listed(host, path):
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    kinds = {k: (tokens(*k), listed(*k)) for k in set(parts.values())}
    labelled = [(t, v) for t, v in kinds.values() if v and t]
    total, rules = len(labelled), {}
    for t in {frozenset(c) for t, _ in labelled for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}:
        holds = [v for u, v in labelled if t <= u]
        for v in set(holds):
            if holds.count(v) / total >= 0.08 and holds.count(v) / len(holds) >= 0.6:
                rules[t, v] = (round(holds.count(v) / len(holds), 9), round(holds.count(v) / total, 9))
    kept = {k: c for k, c in rules.items() if not any((k[0] - {x}, k[1]) in rules and rules[k[0] - {x}, k[1]][0] >= c[0] for x in k[0] if len(k[0]) > 1)}
    for i, k in parts.items():
        t, v = kinds[k]
        if v is None:
            fits = [(*c, len(s), sorted(s), w) for (s, w), c in kept.items() if s <= t]
            v = max(fits)[-1] if fits else "allow"
            assert (got[i].mined is None) == (not fits)
        assert got[i].verdict == v, (k, got[i], v)


def test_warc_against_naive(spark):
    """Record types by plain Python: nulls, repeated ids, ties, payloads below the least size."""
    r = np.random.default_rng(12)
    rows = [(None if r.random() < 0.1 else int(r.integers(40)), "http://h/", str(r.choice(["a", "bb", "c" * 3000, "", "dddd"])) if r.random() < 0.9 else None) for _ in range(120)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, key string, first_id long")
    for least in (0, 3):
        want = Counter()
        for page_id, _, html in rows:
            data = (html or "").encode()
            first = max((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None) if len(data) >= least else None
            of = first if first is not None and page_id != first else None
            want[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if of is None else "revisit", of] += 1
        got = warc.archive_round_trip(df.repartition(3), least).collect()
        assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want


def test_warc_dictionary_of_few_records():
    few = [warc.make_record(i, "u", b"<html>the same words again and again</html>" * 9, None, "D", "2024-01-01T00:00:00Z") for i in range(10)]
    data = warc.pack_archive(few)
    assert 0 < int.from_bytes(data[4:8], "little") <= sum(map(len, few)) // 8 and list(warc.unpack_archive(data)) == few
    assert list(warc.unpack_archive(warc.pack_archive([b"x"]))) == [b"x"]


def test_token_ids_that_do_not_fit():
    with pytest.raises(ValueError, match="65536"):
        tokens.pack_file([1], [2], np.array([70_000, 2], np.uint32))


def test_token_pieces_in_any_batches():
    """Random texts of letters, marks, spaces and contractions, cut by the table of pieces, against the library."""
    r = np.random.default_rng(13)
    encode = tokens.Encoder(tokenizer_path(), keep=300)
    texts = ["".join(r.choice(list(" \n'abstmdrevl1.,éß¿"), r.integers(0, 40))) for _ in range(3000)] + ["", "a" * 50, "日本 x", "a\tb", "x<|endoftext|>y"]
    want = [e.ids for e in encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 170):
        ids, counts = encode([t.encode() for t in texts[at : at + 170]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[at : at + 170]


def test_range_coder_block_alone():
    r = np.random.default_rng(14)
    blocks = [(r.zipf(1.2, n) % 50_000).astype(np.uint16) for n in (2048, 2048, 300, 65, 64, 1)]
    codes = rangecoder.encode_blocks(blocks)
    for b, c in zip(blocks, codes, strict=True):
        assert (rangecoder.decode_blocks([c], [len(b)])[0] == b).all()
    with pytest.raises(ValueError):
        rangecoder.encode_blocks([np.zeros(rangecoder.LONGEST + 1, np.uint16)])
