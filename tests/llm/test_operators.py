"""Edge cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import pickle
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pondera.llm import decontamination, exchange, langid, matroska, mixing, near_dup, ngram_lm, quality, repeats, sharding, textkit, urls
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Hello World"), (4, "Hello World"), (None, "no id here"), (5, LONG), (6, "é" * 300), (7, "a b c d e f g")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- text kernels

def test_words_and_hashes():
    t = pa.array(["Ab cd", None, "", "x", "ab  CD"])
    w, b = textkit.words(t)
    assert b.tolist() == [0, 2, 2, 2, 3, 5] and (w[:2] == w[3:]).all()
    big = pa.array([LONG])
    w2, _ = textkit.words(big)
    old, textkit.BLOCK = textkit.BLOCK, 1000
    try:
        assert (textkit.words(big)[0] == w2).all()
    finally:
        textkit.BLOCK = old


def test_sequences_stay_within_rows():
    w, b = textkit.words(pa.array(["a b c", "a b", "", "b c d e"]))
    s, at = textkit.sequences(w, b, 2)
    assert at.tolist() == [0, 2, 3, 3, 6] and s[0] == s[2] and s[1] == s[3] and len(set(s.tolist())) == 4
    names, at = textkit.shingle_sets(*textkit.words(pa.array(["a b c d e a b c d e", "a b", None, "a b c d e"])))
    assert np.diff(at).tolist() == [5, 1, 0, 1]


# ---- 1 URL filters

RULES = [("org", "/", "allow"), ("a.org", "/x/", "block"), ("a.org", "/x/y", "allow"), ("a.org", "/x/y", "block"), (None, "/", "block")]


def test_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, None, "k"), (2, "no scheme", "k"), (3, "http://W.A.org/x/1?q#f", "k"), (4, "https://a.org/x/yz", "k"), (5, "http://ba.org/x/", "k"), (5, "http://ba.org/x/", "k"), (6, "http://org", "k"), (7, "ftp://b.net/x://y", "k"), (8, "http://a.org#f", "k")], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("w.a.org", "/x/1", "a.org/x/", "block"), 4: ("a.org", "/x/yz", "a.org/x/y", "block"), 5: ("ba.org", "/x/", "org/", "allow"), 6: ("org", "", None, "allow"), 7: ("b.net", "/x://y", None, "allow"), 8: ("a.org", "", None, "allow")}
    assert urls.judge(pages, rules).count() == 9
    assert urls.judge(pages, rules.limit(0), default="block").where("verdict = 'block'").count() == 9
    assert urls.judge(pages.limit(0), rules).count() == 0
    long = spark.createDataFrame([("org", "/very/long/path", "block"), ("a.org", "/v", "allow"), ("b.org", "/abc", "allow"), ("org", "/abcde", "block")], "host string, path string, verdict string")
    deep = spark.createDataFrame([(1, "http://a.org/very/long/path/x"), (2, "http://a.org/very"), (3, "http://b.org/abcdef")], "page_id int, url string")
    assert {r.page_id: r.rule for r in urls.judge(deep, long).collect()} == {1: "org/very/long/path", 2: "a.org/v", 3: "b.org/abc"}
    clash = pages.selectExpr("page_id as best", "url as `u``rl.x`", "page_id as key", "page_id as open", "page_id as part", "rule as verdict")
    assert sorted((r["best"], r["part"], r["verdict"]) for r in urls.judge(clash, rules, url="u`rl.x").collect()) == sorted((r.page_id, r.page_id, r.verdict) for r in urls.judge(pages, rules).collect())


def test_urls_against_plain_rules(spark):
    rng = random.Random(3)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com", ""]
    rules = [(rng.choice(hosts[:-1]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4))), rng.choice(["allow", "block"])) for _ in range(30)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    pages = [(i, f"http://{rng.choice(['c.b.a.org', 'b.a.org', 'aorg', 'x.com', 'y.x.com', 'org'])}/{''.join(rng.choice('ab/') for _ in range(rng.randrange(6)))}") for i in range(300)]
    df = urls.judge(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    for r in df.collect():
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))


def test_homepages_of_one_rule_host_are_one_place(spark):
    """The second sweep has a row for each path under a rule host, however many hosts have it."""
    pages = spark.range(10_000).select("id", F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/")).alias("url"))
    rules = spark.createDataFrame([("com", "/", "block"), ("com", "/x", "allow"), ("h7.com", "/", "allow")], "host string, path string, verdict string")
    held, sizes = urls._sweep, []
    try:
        urls._sweep = lambda points, *rest: sizes.append(points.count()) or held(points, *rest)
        got = {r.id: r.verdict for r in urls.judge(pages, rules).collect()}
    finally:
        urls._sweep = held
    assert sizes == [10_000, 2]
    assert got == {i: "allow" if i == 7 else "block" for i in range(10_000)}


# ---- 2 near-dedup

def test_near_dup_edges(spark):
    got = near_dup.near_duplicates(odd(spark).withColumn("n", F.lit("clash"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and [by[i].n_shingles for i in (1, 2, 3, 4, 6, 7)] == [0, 0, 0, 1, 1, 3]
    assert by[None].component_id is None and by[None].kept and all(by[i].kept for i in range(1, 8))
    assert near_dup.near_duplicates(none(spark)).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(odd(spark), percent=70)


def test_near_dup_blocks_lose_no_link(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in docs}
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85, block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets} and len({top(i) for i in sets}) > 1


def test_near_dup_many_near_copies_under_one_id(spark):
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join([*base[:k % 150], f"z{k}", *base[k % 150 + 1:]]) for k in range(1200)]
    one = near_dup.near_duplicates(spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string"))
    assert [tuple(r) for r in one.distinct().collect()] == [(0, 146, 0, True)] and one.count() == 1200
    many = near_dup.near_duplicates(spark.createDataFrame([(f"d{i:05}", t) for i, t in enumerate(texts)], "doc_id string, text string"), fan=100)
    assert many.select("component_id").distinct().collect() == [("d00000",)] and many.where("kept").count() == 1


def test_near_dup_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (7, " ".join([*base, "x"])), (None, " ".join(f"v{i}" for i in range(60))), (None, " ".join(f"v{i}" for i in range(61)))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))) == sorted(map(str, [(None, 56, 7, False), (7, 57, 7, True), (None, 56, None, True), (None, 57, None, True)]))


def test_odd_sketch_counts_flips():
    a = np.sort(textkit.mix(np.arange(1000, dtype=np.uint64)))
    b = np.sort(np.concatenate([a[:900], textkit.mix(np.arange(5000, 5100, dtype=np.uint64))]))
    s = near_dup.odd_sketch(near_dup.minhash(np.concatenate([a, b, a]), np.array([0, 1000, 2000, 3000])))
    far = near_dup._distances(s, s)
    assert far[0, 2] == 0 and 10 < far[0, 1] <= near_dup.max_distance(80)


def test_templated_texts_don_t_meet(spark):
    """Texts that share a template but aren't linked make no pairs, and those that are linked are found among them."""
    rng = random.Random(21)
    template = " ".join(f"t{i}" for i in range(80))
    rows = [(i, template + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(12))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + f" x{i}") for i in range(0, 400, 40)]
    held, sizes = near_dup._to_cells, []
    try:
        near_dup._to_cells = lambda r, block: (lambda out: (sizes.append(out.count()), out)[1])(held(r, block))
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, block=16).collect()
    finally:
        near_dup._to_cells = held
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < 1000 else i - 1000 for i, _ in rows}
    assert sum(sizes) < 400


def test_linked_sets_share_a_rare_shingle():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, 1 << 16).astype(np.uint32)
    shared = type("Shared", (), {"value": counts})
    for size in (1, 2, 7, 40, 300):
        names = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        miss = len(names) - -(-85 * len(names) // 100)
        other = np.sort(np.delete(names, rng.choice(len(names), miss, replace=False)))
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([names.tobytes(), other.tobytes()], pa.binary())], ["node", "names"])
        out = next(near_dup._rarest(shared, 16, 85)(iter([batch]))).to_pydict()
        a = {g for g, n in zip(out["group"], out["node"], strict=True) if n == 1}
        own = {g for g, n, o in zip(out["group"], out["node"], out["own"], strict=True) if n == 2 and o}
        assert a & own and len(a) == miss + 1 and len(own) <= len(a)


# ---- 3 repeats

def test_repeats_edges(spark):
    p = "x" * 49
    rows = [(1, None), (2, ""), (3, "abc" * 40), (3, "abc" * 40), (4, "abc" * 40 + "tail"), (None, "abc" * 40), (5, p), (6, p), (7, "q" * 200), (8, "q" * 50), (9, LONG), (10, "é" * 25 + "head " + LONG[1000:1100])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=300).collect()
    n = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in got)
    assert (3, 120, 0, 0) in n and (4, 124, 120, 1) in n and (0, 120, 0, 0) in n and (6, 49, 0, 0) in n and (7, 200, 0, 0) in n and (8, 50, 50, 1) in n and (10, 155, 100, 1) in n
    assert next(r for r in got if r.doc_id == 4).kept == b"tail" and len(got) == len(rows)
    assert repeats.remove_repeats(none(spark)).count() == 0


@pytest.mark.parametrize("length,chunk,group", [(50, 500, 4096), (50, 1 << 20, 1), (17, 700, 3), (41, 3000, 2), (120, 2000, 5)])
def test_repeats_against_plain(spark, length, chunk, group):
    from test_queries import plain_repeats

    rng = random.Random(length)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randrange(20, 140))) for _ in range(12)] + ["a" * 90, "ab" * 60, "abc" * 50]
    texts = {i: "".join(rng.choice(pool) for _ in range(rng.randrange(6))) for i in range(60)}
    got = repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length=length, chunk_bytes=chunk, group=group, with_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_repeats(texts, length)


def test_repeats_of_ranks_with_many_surroundings(spark):
    from test_queries import plain_repeats

    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh ") for _ in range(60))
    texts = {i: "".join(rng.choice("abcdefgh ") for _ in range(30)) + common[rng.randrange(12) : 60 - rng.randrange(12)] + "".join(rng.choice("ab") for _ in range(30)) for i in range(80)}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), group=4, with_text=False).collect()
    finally:
        spark.conf.set(key, old)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_repeats(texts)


def test_anchors_do_not_depend_on_blocks():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (0, 49, 50, 51, 3000, 20)] + ["x" * 700]
    data, offsets = textkit.utf8(pa.array(texts))
    live = np.array([True] * 6 + [True])
    want = repeats.find_anchors(data, offsets, live, 50)
    old, repeats._BLOCK = repeats._BLOCK, 64
    try:
        got = repeats.find_anchors(data, offsets, live, 50)
    finally:
        repeats._BLOCK = old
    strings = [k for a, b in zip(offsets[:-1], offsets[1:]) for k in range(a, b - 49)]
    for runs in (want, got):
        assert [k for f, n, _ in runs.T.tolist() for k in range(f, f + n)] == strings
        assert all(f + n - 1 <= at <= f + 34 for f, n, at in runs.T.tolist())
    place = {bytes(data[k : k + 50]): at - k for f, n, at in want.T.tolist() for k in range(f, f + n)}
    assert all(place[bytes(data[k : k + 50])] == at - k for runs in (want, got) for f, n, at in runs.T.tolist() for k in range(f, f + n))


# ---- 4 language ID

def train_rows(spark):
    return spark.createDataFrame([("en", "the cat and the dog of the house")] * 3 + [("de", "der hund und die katze des hauses")] * 3 + [("fr", None), (None, "the")], "lang string, text string")


def test_language_edges(spark):
    f = langid.train(train_rows(spark))
    assert f.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "THE CAT and the dog"), (5, "und der hund"), (6, "Ж"), (7, LONG)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), f).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "en", "de"] and got[1].score == 0
    assert got[6].lang_pred in f.languages and got[7].lang_pred in f.languages
    assert langid.train(train_rows(spark).limit(0)) is None
    assert langid.identify(odd(spark), None).select("lang_pred").distinct().collect() == [("und",)]


def test_filters_have_no_false_negatives(spark):
    f = langid.train(train_rows(spark), slots=1 << 12)
    packed, _ = langid.grams(pa.array(["der hund und die katze des hauses"]), f.n)
    assert ((f.masks(packed)[:, 0] & np.uint64(1)) == 1).all()


def test_many_languages(spark):
    rng = random.Random(2)
    rows = [(f"l{i:02}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))) for i in range(70)]
    f = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    got, _ = f.predict(pa.array([t for _, t in rows]))
    assert f.table.shape[1] == 2 and sum(a == b for a, (b, _) in zip(got, rows, strict=True)) >= 60


# ---- 5 LM scoring

def test_lm_edges(spark):
    got = ngram_lm.score_texts(odd(spark)).collect()
    assert len(got) == len(ODD) and sorted(r.n_tokens for r in got)[:3] == [1, 1, 1] and all(np.isfinite(r.score) for r in got)
    assert ngram_lm.score_texts(none(spark)).count() == 0
    alone = ngram_lm.score_texts(odd(spark).where("doc_id = 4"), folds=1, fold=0).first()
    assert (alone.train_tokens, alone.n_known) == (0, 0) and np.isfinite(alone.score)


def test_em_finds_the_mixture():
    # all held-out tokens are bigrams of probability one: the bigram weight must win
    w = ngram_lm.learn_weights(np.array([[3, 0, -80, 1000]]), 100)
    assert w[3, 0] > 0.99 and np.allclose(w.sum(1), 1) and (w[:, 2] > 0).all()
    assert np.allclose(ngram_lm.learn_weights(np.zeros((0, 4), np.int64), 10), 1 / 3)


def test_model_is_a_distribution():
    rows = np.array([[2, -8, -40, 50], [2, ngram_lm.NONE, -40, 30], [2, ngram_lm.NONE, ngram_lm.NONE, 5]])
    w = ngram_lm.learn_weights(rows, 1000)
    loss = lambda v: -sum(n * np.log(v[0] * (0 if a == ngram_lm.NONE else 2 ** (a / 8)) + v[1] * (0 if b == ngram_lm.NONE else 2 ** (b / 8)) + v[2] / 1001) for _, a, b, n in rows)
    grid = [np.array([x, y, 1 - x - y]) for x in np.linspace(0, 1, 41) for y in np.linspace(0, 1 - x, 41) if 1 - x - y > 1e-9]
    assert loss(w[2]) <= min(map(loss, grid)) + 1e-3


def test_chunks_keep_their_bound(spark):
    rows = [(i, "x" * (990 if i % 10 else 5000)) for i in range(70)] + [(70 + i, "y" * 9) for i in range(300)]
    got = exchange.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1000).collect()
    assert all(r.n_bytes <= 1000 or len(r.doc_ids) == 1 for r in got) and sorted(i for r in got for i in r.doc_ids) == list(range(370))


def test_counts_round_trip():
    n = np.array([0, 1, 254, 255, 256, 10**12])
    assert (exchange.unpack_counts(exchange.pack_counts(n)) == n).all() and len(exchange.unpack_counts(exchange.pack_counts(n[:0]))) == 0


# ---- 6 quality

def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words in a row here." if i % 2 else "BAD!!! | | ***") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (50, None), (3, 0)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = quality.classify(docs.union(odd(spark)).withColumn("score", F.lit("clash")), m).collect()
    assert len(got) == 60 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id and r.doc_id >= 40 and r.doc_id < 60)
    x = np.random.default_rng(0).normal(size=(50, len(quality.STATISTICS)))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "stats array<double>").select(m.column(F.col("stats"))).collect()
    assert np.allclose([r[0] for r in df], m.score(x))


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(odd(spark), quality.train(odd(spark), labels)).collect()
    assert {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert quality.classify(odd(spark), quality.train(odd(spark), one)).first().predicted == 1


def test_quality_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.range(2000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("some words. "), F.col("id")).alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    held, seen = quality.fit, []
    try:
        quality.fit = lambda x, y, **o: seen.append(len(x)) or held(x, y, **o)
        quality.train(docs, labels, max_rows=10)
    finally:
        quality.fit = held
    assert seen == [10]


# ---- 7 decontamination

def plain_hits(doc, items, window):
    hit, found = [False] * len(doc), set()
    for i, words in items:
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == words[k : k + n]:
                    hit[j : j + n] = [True] * n
                    found.add(i)
    return sum(hit), found


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_matches_against_plain(spark, group_bytes):
    rng = random.Random(group_bytes)
    word = lambda: rng.choice("abcd")
    items = [(i, [word() for _ in range(rng.randrange(9))]) for i in range(12)]
    docs = [(i, [word() for _ in range(rng.randrange(40))]) for i in range(50)]
    got = decontamination.matches(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), window=4, group_bytes=group_bytes)
    for r in got.collect():
        n, found = plain_hits(dict(docs)[r.doc_id], items, 4)
        assert (r.n_hit, r.hit_items) == (n, sorted(map(str, found)))


def test_automaton_knows_all_runs_and_is_small():
    rng = random.Random(4)
    seqs = [[rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(20)]
    auto = decontamination.SuffixAutomaton()
    for s in seqs:
        auto.add(s)
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(2000):
        r, state = tuple(rng.randrange(6) for _ in range(rng.randrange(1, 7))), 0
        for c in r:
            state = auto.step(state, c) if state >= 0 else -1
        assert (state >= 0) == (r in runs)
    text = {" ".join(f"w{rng.randrange(20_000)}" for _ in range(400)): [str(i)] for i in range(250)}
    assert len(pickle.dumps(decontamination.build(text, 10))) < 15 * sum(map(len, text))


def test_one_word_over_and_over():
    """Work per word is bounded on the most repetitive texts, and the result is that of short ones."""
    text = "la " * 200_000
    items = decontamination.build({text: ["a"], "la la la": ["b"], "x y": ["c"]}, 10)
    names, borders = textkit.words(pa.array([text, "la " * 9, "la " * 10 + "x y z la", "y x"]), textkit.ALNUM)
    hit, found = decontamination.scan(items, names, borders)
    got = [(int(hit[a:b].sum()), sorted(items.ids[k][0] for k in found.get(i, ()))) for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True))]
    assert got == [(200_000, ["a", "b"]), (9, ["b"]), (12, ["a", "b", "c"]), (0, [])]


def test_removed_spans_against_plain(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcde")
    items = [(i, [word() for _ in range(rng.randrange(2, 9))]) for i in range(8)]
    docs = [(i, [word() for _ in range(rng.randrange(40))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame([(i, None if w is None else "-".join(w)) for i, w in docs], "doc_id long, text string")
    for most, share in ((0, 0.0), (5, 0.6), (3, 1.0)):
        got = {r.doc_id: r.text for r in decontamination.remove_spans(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), window=4, max_words=most, max_coverage=share).collect()}
        for i, w in docs:
            if not w:
                assert got[i] == (None if w is None else "")
                continue
            hit = [False] * len(w)
            for _, words in items:
                n = min(4, len(words))
                for k in range(len(words) - n + 1):
                    for j in range(len(w) - n + 1):
                        if w[j : j + n] == words[k : k + n]:
                            hit[j : j + n] = [True] * n
            text, k = "", 0
            while k < len(w):
                e = k
                while e < len(w) and hit[e] == hit[k]:
                    e += 1
                gone = hit[k] and (e - k > most or sum(hit) > share * len(w))
                text += ("" if gone else "-".join(w[k:e])) + ("-" if e < len(w) else "")
                k = e
            assert got[i] == text, (i, w)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "..."), (None, "no ID here")], "item_id long, text string")
    docs = odd(spark).union(spark.createDataFrame([(9, "say: HELLO, World! again")], "doc_id long, text string")).withColumn("n_hit", F.lit("clash"))
    got = decontamination.matches(docs, items).collect()
    assert len(got) == len(ODD) + 1 and sorted(r.doc_id or 0 for r in got if r.n_hit) == [0, 4, 4, 9]
    assert next(r for r in got if r.doc_id is None).hit_items == []
    for g in (1 << 20, 1):
        clash = decontamination.matches(docs.withColumn("_items", F.lit(5)).withColumn("uid", F.lit(6)).withColumn("marks", F.lit(7)).withColumn("a`b.c", F.lit(8)), items, group_bytes=g).where("doc_id = 9").first()
        assert (clash["_items"], clash["uid"], clash["marks"], clash["a`b.c"], clash["hit_items"]) == (5, 6, 7, 8, ["1"])
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 1 - 4
    for words, share, text in ((1, 1.0, "say: ! again"), (2, 0.4, "say: ! again"), (2, 1.0, "say: HELLO, World! again"), (0, 0.0, "say: ! again")):
        cut = decontamination.remove_spans(docs, items, max_words=words, max_coverage=share)
        assert cut.count() == docs.count() and cut.columns == docs.columns and cut.where("doc_id = 9").first().text == text
    assert decontamination.matches(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.matches(none(spark), items).count() == 0


# ---- 8 mixing

def test_water_fill(spark):
    s = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 0, 1.0), (None, 90, 1.0)], "source string, size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(s).collect()}
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 270 and got["b"] == pytest.approx(800)
    assert sum(got.values()) == pytest.approx(1100)
    assert mixing.water_fill(s.limit(0)).count() == 0


def test_mixing_edges(spark):
    docs = odd(spark).withColumn("source", F.when(F.col("doc_id") > 4, "s")).withColumn("size", F.lit("clash"))
    m = mixing.mix(docs)
    assert m.count() == len(ODD) and m.where("copies < 0 or copies > 3").count() == 0
    assert m.where("source is null and source_size is null").count() == 0
    assert sorted(map(str, m.collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.emit(m).count() == m.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id = 1")).first().copies == 0


def test_rows_without_an_id_are_mixed_apart(spark):
    rows = [(None, "a b c d e f g h i j", "x")] * 1000 + [(i, "w " * 10, "y") for i in range(300)] + [(None, f"t{i} u", "y") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs, weights=(1.0, 3.0)).groupBy("source", "target", "source_size").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) < 0.08 * r.target for r in got)
    a, b = (sorted((str(r.doc_id), r.copies) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(3)))
    assert a == b


# ---- 9 Matroska

@pytest.mark.parametrize("n", [1, 64, 255, 256, 257, 2048, 2049, 40_000])
def test_mux_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    raw = matroska.mux(data)
    m = matroska.parse(raw)
    assert matroska.samples(raw, m) == data and len(m.cues) == len(m.clusters) == -(-n // 32768)
    assert [c[2] for c in m.cues] == [at - 12 for _, at in m.clusters] or len(m.cues) >= 1
    assert m.packets[-1].timestamp_ns == (len(m.packets) - 1) * 32_000_000 and m.tracks[1]["codec"] == "A_PCM/INT/LIT"


def e(kind, data, size=None):
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (matroska._size(len(data)) if size is None else size) + data


def test_lacing_groups_and_unknown_sizes():
    xiph = e(matroska.SIMPLE_BLOCK, b"\x81\x00\x05\x02" + b"\x02" + b"\xff\x01" + b"\x03" + b"a" * 256 + b"bbb" + b"cc")
    fixed = e(matroska.SIMPLE_BLOCK, b"\x82\xff\xff\x84" + b"\x01" + b"xxyy")
    ebml = e(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x06" + b"\x02" + b"\x84" + b"\xbe" + b"1234" + b"567" + b"89")
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81\x00\x01\x00zz") + e(matroska.REFERENCE_BLOCK, b"\x01"))
    cluster = e(matroska.CLUSTER, e(matroska.CLUSTER_TIMESTAMP, b"\x0a") + xiph + fixed + ebml + group + e(0xEC, b"void"), b"\x01\xff\xff\xff\xff\xff\xff\xff")
    raw = e(matroska.EBML, e(matroska.DOC_TYPE, b"webm")) + e(matroska.SEGMENT, cluster + e(matroska.CUES, b""), b"\xff")
    m = matroska.parse(raw)
    assert m.doc_type == "webm" and [raw[p.offset : p.offset + p.size] for p in m.packets] == [b"a" * 256, b"bbb", b"cc", b"xx", b"yy", b"1234", b"567", b"89", b"zz"]
    assert [p.timestamp_ns // 10**6 for p in m.packets] == [15, 15, 15, 9, 9, 10, 10, 10, 11] and m.packets[3].key and not m.packets[-1].key and m.packets[3].track == 2


def test_damaged_files(spark):
    good = matroska.mux(b"abc" * 500)
    for cut in range(1, len(good), 97):
        try:
            matroska.parse(good[:cut])
        except matroska.MatroskaError:
            pass
    rows = [("a", good), ("b", b"nonsense"), ("c", None), ("a", good), ("d", b"")]
    got = matroska.packets(spark.createDataFrame(rows, "name string, file binary"), key="name", media="file").collect()
    assert sum(r.name == "a" for r in got) == 12 and all(r.error for r in got if r.name != "a") and len(got) == 15
    stored = matroska.read_back(matroska.store_texts(odd(spark))).collect()
    assert len(stored) == len(ODD) and len({r.media_sha256 for r in stored if r.doc_id == 4}) == 1 and all(r.payload_bytes % 64 == 0 and r.payload_bytes for r in stored)
    assert matroska.read_back(matroska.store_texts(none(spark))).count() == 0


def test_hostile_numbers(spark):
    track = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, e(matroska.TRACK_NUMBER, b"\1") + e(matroska.AUDIO, e(matroska.SAMPLING_FREQUENCY, bytes(8)))))
    block = e(matroska.SIMPLE_BLOCK, b"\x81\x00\x05\x00zz")
    cluster = e(matroska.CLUSTER, e(matroska.CLUSTER_TIMESTAMP, b"\x0a") + block)
    far = e(matroska.SEGMENT, e(matroska.INFO, e(matroska.TIMESTAMP_SCALE, b"\xff" * 8)) + cluster)
    wide = e(matroska.SEGMENT, e(matroska.INFO, e(matroska.TIMESTAMP_SCALE, b"\xff" * 9)) + cluster)
    files = spark.createDataFrame([("far", far), ("wide", wide), ("rate", e(matroska.SEGMENT, track + cluster)), ("empty", e(matroska.SEGMENT, b""))], "name string, file binary")
    got = {r.name: r.error for r in matroska.packets(files, key="name", media="file").collect()}
    assert got["far"] and got["wide"] and got["rate"] is None
    back = matroska.read_back(files.selectExpr("name as doc_id", "1L as n_bytes", "file as media")).collect()
    assert len(back) == 4 and all(r.feature.startswith("error: ") and r.payload_sha256 is None for r in back)


def live(n):
    """A file as it is streamed: neither segment nor clusters have a size."""
    unknown = b"\x01" + b"\xff" * 7
    clusters = b"".join(e(matroska.CLUSTER, e(matroska.CLUSTER_TIMESTAMP, bytes([k])) + e(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + bytes([65 + n + k])), unknown) for k in range(2))
    return e(matroska.EBML, e(matroska.DOC_TYPE, b"webm")) + e(matroska.SEGMENT, clusters, unknown)


def test_joined_live_files_give_all_packets():
    raw = live(0) + live(2) + matroska.mux(b"z" * 10) + live(4)
    m = matroska.parse(raw)
    assert [raw[p.offset : p.offset + p.size] for p in m.packets] == [b"A", b"B", b"C", b"D", b"z" * 10, b"E", b"F"]
    with pytest.raises(matroska.MatroskaError, match="must have a size"):
        matroska.parse(e(matroska.EBML, b"", b"\xff") + live(0))


def test_rates_out_of_range_are_errors(spark):
    def with_rate(raw):
        track = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, e(matroska.TRACK_NUMBER, b"\1") + e(matroska.AUDIO, e(matroska.SAMPLING_FREQUENCY, raw))))
        return e(matroska.SEGMENT, track + e(matroska.CLUSTER, e(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")))

    rates = [5e-324, 1e-300, 0.5, float("nan"), float("inf"), -8000.0, 1e300]
    files = spark.createDataFrame([(i, 3, bytearray(with_rate(struct.pack(">d", r)))) for i, r in enumerate([*rates, 8000.0])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r.feature for r in matroska.read_back(files).collect()}
    assert all(got[i].startswith("error: ") for i in range(len(rates))) and got[len(rates)].startswith("packets=1;")


def test_mutated_files_raise_only_matroska_errors():
    rng = random.Random(11)
    good = [matroska.mux(bytes(rng.randrange(256) for _ in range(3000))), live(0) + live(2)]
    for k in range(1000):
        raw = bytearray(rng.choice(good))
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(min(len(raw), 400) if rng.random() < 0.7 else len(raw))
            kind = rng.randrange(3)
            if kind == 0:
                raw[at] = rng.choice([0, 1, 0xFF, 0x7F, 0x80, rng.randrange(256)])
            elif kind == 1:
                del raw[at : at + rng.randrange(1, 9)]
            else:
                raw[at:at] = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9)))
        try:
            media = matroska.parse(bytes(raw))
            matroska.describe(media, matroska.samples(bytes(raw), media))
            for p in media.packets:
                assert 0 <= p.offset and p.offset + p.size <= len(raw) and abs(p.timestamp_ns) < 1 << 63
        except matroska.MatroskaError:
            pass


def test_stored_form_and_feature_against_a_plain_reader(spark):
    """A reader that knows only this one layout counts what the file must hold."""
    texts = ["", "a", "Hello, world. " * 700, "é" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = {r.doc_id: bytes(r.media) for r in matroska.store_texts(docs).collect()}
    for r in matroska.read_back(matroska.store_texts(docs)).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        frames = -(-len(payload) // 256)
        clusters = -(-len(payload) // (256 * 8 * 16))
        signed = [x - 128 for x in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(signed, signed[1:], strict=False))
        ms = (frames - 1) * 32 + (len(payload) - (frames - 1) * 256) * 1000 // 8000
        assert r.feature == f"packets={frames};clusters={clusters};cues={clusters};ms={ms};mean={sum(signed) * 1000 // len(payload)};power={sum(x * x for x in signed) // len(payload)};crossings={crossings}"


# ---- 10 sharding

def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    t = sharding.fill_table(names, 1009)
    sizes = np.bincount(t)
    assert sizes.max() - sizes.min() <= 1
    u = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, u, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7), (names, 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_sharding_edges(spark):
    docs = odd(spark).withColumn("shard", F.lit("clash"))
    got = sharding.place(docs, shards=5, slots=101).collect()
    assert len(got) == len(ODD) and len({r.shard for r in got if r.doc_id == 4}) == 1 and all(0 <= r.shard < 5 for r in got)
    assert sharding.place(none(spark), shards=5, slots=101).count() == 0


# ---- clashing names

def test_columns_with_clashing_names_stay(spark):
    names = ["best", "at", "copy", "mixed_source", "stats", "_label", "_items", "row", "uid", "node", "comp", "slot_", "a`b", "c.d"]
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    mixed = mixing.mix(docs)
    outs = [langid.identify(docs, langid.train(train_rows(spark))), quality.classify(docs, quality.train(docs, labels)), decontamination.matches(docs, items), decontamination.decontaminate(docs, items), mixed, mixing.emit(mixed), sharding.place(docs, shards=3, slots=11), decontamination.remove_spans(docs, items, max_words=1, max_coverage=1.0)]
    for out in outs:
        assert [c for c in out.columns if c in names] == names
        assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
    assert outs[-1].where("doc_id = 1").first().text == " and the dog"
    assert near_dup.near_duplicates(docs).count() == repeats.remove_repeats(docs).count() == ngram_lm.score_texts(docs).count() == matroska.read_back(matroska.store_texts(docs)).count() == 2
