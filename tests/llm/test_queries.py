"""Registered queries: SQL where there is some, plain versions on a small table otherwise."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from oracle import compare
from pondera.llm import queries as q
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, sf_dir, name):
    compare(q.queries()[name](spark, sf_dir), q.oracle_sql()[name], sf_dir)


def test_near_dup(spark, sf_dir, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = q.op2_near_dup(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), top(i), top(i) == i) for i in sets}


def plain_repeats(texts, n=50):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        own = set()
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if s in seen:
                gone[k : k + n] = b"\1" * n
            own.add(s)
        seen |= own
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op3_repeats(spark, sf_dir).collect()}
    assert got == plain_repeats(texts)


def test_language_id(spark, sf_dir):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = q.op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def test_lm_score(spark, sf_dir, texts):
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    got = q.op5_lm_score(spark, sf_dir).collect()
    for r in got:
        w = [*words(texts[r.doc_id]), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark, sf_dir):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = q.op6_quality(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.85 * len(held)


def test_matroska(spark, sf_dir, texts):
    for r in q.op9_matroska(spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.media_bytes > r.payload_bytes and r.feature.startswith("packets=")


def test_mix_comes_near_its_targets(spark):
    df = q.op8_mixing(spark, "/root/testdata/sf0.1")
    by = df.groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 0.15 * r.target + 1000 for r in by)
    assert df.where("taken > 3 * size").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = c.run(spark, sf_dir)
    assert got.columns == [*docs.columns, "slot", "shard"]
    rows = got.collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id] == r.text for r in rows)
    # near-dedup: of what it keeps, no two are near; whatever it drops is near a kept one's component
    sets = {}
    for i, t in text.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted({r.doc_id for r in rows})
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    leaks = {r.doc_id for r in q.op7_decontaminate(spark, sf_dir).where("contaminated").collect()}
    assert not leaks & set(ids)
    assert len({(r.doc_id, r.slot, r.shard) for r in rows}) == len(ids)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, c.run(spark, sf_dir).collect()))


def test_stages_keep_clean_documents(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, "The one and only text of its kind, with the words that it has.", "en", "s", 9), (2, "12 34", None, None, None), (None, "Und das ist ein ganz anderer Satz mit der und die.", "de", "s", 1), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    a = c.language_id(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in a.collect()) == ["1", "None"]
    b = c.near_dedup(spark, a.union(a), sf_dir)
    assert sorted(str(r.doc_id) for r in b.collect()) == ["1", "None"]
    assert c.decontaminate(spark, b, sf_dir).count() == 2
    assert c.shard(spark, b, sf_dir).columns == [*c.COLUMNS, "slot", "shard"]
    odd = docs.withColumn("lang", F.lit(None).cast("string"))
    assert c.language_id(spark, odd, sf_dir).count() == 4  # nothing to learn from, nothing to reject by


def test_near_dedup_judges_rows(spark, sf_dir):
    import corpus_pipeline as c

    same, other = "one text that stands here with quite a few words of its own", "another text with other words that has nothing to do with it at all"
    rows = [(3, same), (5, same), (5, other), (5, other), (None, other), (7, ""), (7, ""), (None, None), (9, same + " now"), (None, "alone in the world, with no id and no copy of it")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in c.near_dedup(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(3, same), (5, other), (7, ""), (7, ""), (None, None), rows[-1]], key=str)


# ---- plain versions of what SQL can't say

def plain_grams(text, n=5):
    """n-byte strings between blanks of the text, A-Z folded, other ASCII than letters blank."""
    b = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in (text or "").encode())
    b = b" " + b + b" "
    return [b[k : k + n] for k in range(len(b) - n + 1) if b"  " not in b[k : k + n]]


def test_language_id_against_exact_sets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts, total = {}, Counter()
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            g = plain_grams(r.text)
            counts.setdefault(r.lang, Counter()).update(g)
            total[r.lang] += len(g)
    known = {k: {g for g, n in c.items() if n >= 1e-5 * total[k]} for k, c in counts.items()}
    got = {r.doc_id: r for r in q.op4_language_id(spark, sf_dir).collect()}
    for r in docs:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        hits = {k: sum(g in s for g in plain_grams(r.text)) for k, s in known.items()}
        best = max(hits.values())
        if best and sum(n == best for n in hits.values()) == 1:
            assert got[r.doc_id].lang_pred == max(hits, key=hits.get)
            assert got[r.doc_id].score == pytest.approx(best / sum(hits.values()), abs=0.02)


def test_sharding_against_a_slow_table(spark, sf_dir):
    slots, names = 65537, [f"shard-{i}" for i in range(64)]
    orders = []
    for s in names:
        d = hashlib.md5(s.encode()).hexdigest()
        orders.append(iter([(int(d[:8], 16) + j * (int(d[8:16], 16) % (slots - 1) + 1)) % slots for j in range(slots)]))
    table, turn = {}, 0
    while len(table) < slots:
        slot = next(x for x in orders[turn % 64] if x not in table)
        table[slot] = turn % 64
        turn += 1
    for r in q.op10_sharding(spark, sf_dir).collect():
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) % slots and r.shard == table[r.slot]


def test_pipeline_against_plain_stages(spark, sf_dir, texts):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.lang for r in c.language_id(spark, docs, sf_dir).collect()}
    assert set(kept) == {i for i, t in texts.items() if t is not None and any(map(str.isalpha, t))}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(texts[i])) else frozenset() for i in kept}
    part = {i: i for i in kept}
    ids = sorted(kept)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    one = {i for i in ids if part[i] == i}
    leaks = {r.doc_id for r in q.op7_decontaminate(spark, sf_dir).where("contaminated").collect()}
    clean = docs.where(docs.doc_id.isin(sorted(one - leaks)))
    mixed = Counter({r.doc_id: r.copies for r in __import__("pondera.llm.mixing", fromlist=["mix"]).mix(clean).collect()})
    assert Counter(r.doc_id for r in c.run(spark, sf_dir).collect()) == +mixed


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
