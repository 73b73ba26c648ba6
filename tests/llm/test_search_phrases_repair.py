"""Top-k search, phrases and conversation repair against brute force, with odd rows."""

import hashlib
import random
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pondera.llm import conversations, phrases, vector_search
from pondera.llm import queries as q
from pyspark.sql import functions as F

# ---- 11 exact top-k search


def plain_topk(rows, every, k):
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None for x in v) and sum(float(x) * x for x in v) < 2.0**62]
    out = []
    for n, (i, v) in enumerate(fine):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for m, (j, w) in enumerate(fine) if m != n and len(w) == len(v))
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def topk(spark, rows, every=5, **settings):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, v array<bigint>, uid string, block int")
    got = vector_search.nearest(df, F.col("vec_id") % every == 0, **settings)
    assert [f.simpleString() for f in got.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"]
    return sorted(map(tuple, got.collect()), key=str)


def test_topk_is_exact(spark):
    r = random.Random(1)
    heads = [[r.randrange(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.randrange(-6, 7) for x in r.choice(heads)]) for i in range(700)]
    rows += [(1000 + i, heads[0]) for i in range(60)]  # one vector many times, queries among them
    assert topk(spark, rows, k=5, block=64, cells=6) == plain_topk(rows, 5, 5)
    assert topk(spark, rows, k=3, block=4096, cells=1) == plain_topk(rows, 5, 3)


def test_topk_odd_rows(spark):
    big = 2**30
    rows = [(0, [1, 2]), (0, [1, 2]), (0, [2, 1]), (5, [1, 2]), (None, [1, 2]), (None, None), (10, None), (15, [None, 1]), (20, []), (21, []), (25, [big, -big]), (26, [big, big - 1]), (30, [2**62, 1]), (35, [7]), (7, [0, 0]), (-5, [-1, -2])]
    assert topk(spark, rows, k=5, block=4) == plain_topk(rows, 5, 5)
    assert topk(spark, rows[:1], k=5) == [] and topk(spark, [], k=5) == []
    odd = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf")]), (4, None), (5, [None]), (6, [])], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.v for x in odd.select("vec_id", vector_search.whole_vectors(F.col("embedding")).alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_cover_tree_bounds():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-50, 50, (900, 8)), np.repeat(r.integers(-50, 50, (1, 8)), 300, 0)])
    t = vector_search.CoverTree(x)
    assert (t.points == x[t.order]).all() and sorted(t.order) == list(range(len(x)))
    for i in range(len(t.lo)):
        own = t.points[t.lo[i] : t.hi[i]]
        assert ((own - t.heads[i]) ** 2).sum(1).max() <= t.radius[i] ** 2 + 1e-6
        if t.last[i] > t.first[i]:
            assert t.lo[t.first[i]] == t.lo[i] and t.hi[t.last[i] - 1] == t.hi[i]
        else:
            assert t.hi[i] - t.lo[i] <= vector_search.LEAF or t.radius[i] == 0
    a, b = vector_search.CoverTree(x[:100]), vector_search.CoverTree(x[200:])
    most = vector_search.bounds(a.heads[0], a.head_norms[0], a.radius[0], b.heads, b.head_norms, b.radius)
    for j in range(len(most)):
        assert a.products(0, b, j).max() <= most[j]


def test_topk_leaves_pairs_out():
    """Far groups are not met: the search multiplies a small part of all pairs."""
    r = np.random.default_rng(3)
    heads = r.integers(-2000, 2000, (40, 16))
    x = (heads[np.arange(4000) % 40] + r.integers(-9, 9, (4000, 16))).astype(np.int64)
    data, queries = vector_search.CoverTree(x), vector_search.CoverTree(x[::50])
    met, best = [0], vector_search.Best(queries, 6)
    products = vector_search.CoverTree.products
    try:
        vector_search.CoverTree.products = lambda self, i, other, j: (met.__setitem__(0, met[0] + (self.hi[i] - self.lo[i]) * (other.hi[j] - other.lo[j])), products(self, i, other, j))[1]
        best.search(data, np.arange(4000)[data.order])
    finally:
        vector_search.CoverTree.products = products
    want = np.sort(x[::50][queries.order] @ x.T, 1)[:, ::-1][:, :6]
    assert (best.scores == want).all() and met[0] < 0.3 * 4000 * 80


# ---- 12 phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, longest, least, percent, limit):
    n, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), a)
        rows_ = []
        for p, a in good.items():
            if 100 * inside.get(p, 0) >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows_)[:limit], 1)]
    return sorted(out)


def sentences(seed, n):
    r = random.Random(seed)
    common = ["the", "The", "of", "and", "in", "é", "ß", "don't", "日本", "x=1"]
    fixed = ["as a matter of fact", "in the end of the day", "New  York\tCity"]
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(common) if r.random() < 0.8 else f"w{r.randrange(40)}" for _ in range(r.randrange(12))]
        yield "".join(p + r.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", ";", "!"]) for p in parts)


def test_phrases(spark):
    rows = [(lang, t) for k, lang in enumerate(["en", "fr", None, "und", ""]) for t in sentences(k, 150)]
    rows += [("en", None), ("en", ""), (None, None), ("de", " .,;: \t\n"), ("zz", "a a a a a a a a " * 20), ("zz", "A a. " * 10), ("en", "one more " * 3000), ("en", "no break at all " * 50)]
    rows += rows[:200]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "lang string, text string, n int, phrase string").repartition(5)
    for longest, least, percent, limit in ((5, 6, 100, 2000), (3, 4, 70, 7), (2, 9, 100, 3)):
        got = phrases.collocations(df, longest=longest, least=least, percent=percent, limit=limit)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(rows, longest, least, percent, limit)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_long_phrases_of_frequent_pairs_alone_are_not_made(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    rows = [("en", " ".join("as a matter of fact" if r.random() < 0.02 else f"w{r.randrange(30)}" for _ in range(1000))) for _ in range(20)]
    whole, folder = phrases._sum, str(tmp_path)

    def counted(least):
        add = whole(least)

        def run(batches):
            held = list(batches)
            made = sum(pa.ipc.open_stream(block.as_buffer()).read_all().num_rows for b in held for block in b.column("block"))
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(made))
            return add(iter(held))

        return run

    monkeypatch.setattr(phrases, "_sum", counted)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(map(tuple, phrases.collocations(df, least=10).collect())) == plain_phrases(rows, 5, 10, 100, 2000)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) < 8000  # of 900 pairs in each task; the texts have 50,000 longer phrases


def test_names_are_summed_over_blocks_of_any_size(monkeypatch):
    r = np.random.default_rng(5)
    every = np.repeat(r.integers(0, 1 << 64, 500, dtype=np.uint64), r.integers(1, 9, 500))
    r.shuffle(every)
    name, n = np.unique(every, return_counts=True)
    for most in (50, 1 << 22):
        monkeypatch.setattr(phrases, "NAMES", most)
        batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["x"])], ["lang", "text"])
        blocks = [b for some in np.array_split(every, 9) for b in phrases._names(lambda _, some=some: [some], 3)(iter([batch]))]
        found = [x for b in range(3) for got in phrases._frequent(4)(x for x in blocks if x.column("part")[0].as_py() == b) for x in got.column("name").to_pylist()]
        assert np.array_equal(np.sort(np.array(found, np.int64).view(np.uint64)), name[n >= 4])


def test_bitmaps_extend_alike_as_bits_and_lists():
    r = np.random.default_rng(4)
    word = r.choice([-1, 0, 0, 0, 1, 1, 2, 3, 4, 5, 6, 7], 5000)
    go = np.append((word[:-1] >= 0) & (word[1:] >= 0), False) & (r.random(5000) < 0.9)
    want = Counter()
    for i in range(len(word)):
        for k in range(1, 5):
            if i + k < len(word) and go[i : i + k].all():
                want[tuple(word[i : i + k + 1].tolist())] += 1
    for dense in (0.5, 3, 20, 1000):
        got = Counter()
        for last, n, times in phrases.extend(word, go, 5, dense):
            for p, t in zip(last.tolist(), times.tolist(), strict=True):
                key = tuple(word[p - n + 1 : p + 1].tolist())
                assert key not in got
                got[key] = t
        assert got == want


def test_long_texts_are_cut_between_pieces():
    raw = np.frombuffer(b"aaaa bb. " * 50 + b"c" * 100 + b"! d. e", np.uint8)
    parts = [p.tobytes() for p in phrases.blocks_of(raw, 40)]
    assert b"".join(parts) == raw.tobytes() and all(len(p) <= 40 or p.strip(b"!").strip(b" ") == b"c" * 100 for p in parts)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a", "c"]), pa.array(["x y. " * 30, None, "z", "q" * 300])], ["lang", "text"])
    held = list(phrases.shards(iter([batch]), 50))
    assert {lang for lang, _, _ in held} == {"a", "b", "c"} and sum(len(d) for _, d, _ in held) == 150 + 1 + 300


# ---- 13 conversation repair

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """Rows in order of one conversation: faults, cost, audit and the repaired lines, label strings in full."""
    seen, kinds = set(), []
    for _, role, text in rows:
        t = text.rstrip(" \t\n\x0b\f\r")
        kind = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    never = (10**9, "")
    best = {0: (0, "", ()), 3: (0, "", ()), 2: (2, "I", (("assistant", ""),)), 1: (4, "II", (("user", ""), ("assistant", "")))}
    for (_, role, text), kind in reversed(list(zip(rows, kinds, strict=True))):
        new = {}
        for g in range(4):
            c, s, o = best[g]
            found = [(c + 3, "D" + s, o)]
            if kind in ("", "truncated"):
                more = kind == "truncated"
                for y, name, label, cost in ((role[:1], role, "K", 0), ("u", "user", "R", 2), ("a", "assistant", "R", 2)):
                    if (g, y) in STEP:
                        c, s, o = best[STEP[g, y]]
                        found.append((c + cost + more, label + s, ((name, text), *o)))
            new[g] = min(found)
        for _ in range(4):
            for g in range(4):
                for y, name in (("u", "user"), ("a", "assistant")):
                    if (g, y) in STEP:
                        c, s, o = new[STEP[g, y]]
                        new[g] = min(new[g], (c + 2, "I" + s, ((name, ""), *o)))
        best = new
    heads = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = best.get(0, never)
    sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)), cost, audit, sha


def ordered(rows):
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", hashlib.sha256((x[3] or "").encode()).digest())
    by = {}
    for x in sorted(rows, key=key):
        by.setdefault(x[0], []).append((x[1], x[2] or "", x[3] or ""))
    return by


def repaired(spark, rows, **settings):
    df = spark.createDataFrame([(*x, 7, "z") for x in rows], "conv_id long, turn long, role string, text string, part int, h string").repartition(3)
    edited, faults = conversations.repair(df, **settings)
    sums = {r.conv_id: tuple(r)[1:] for r in faults.collect()}
    ends = {r.conv_id: tuple(r)[1:] for r in conversations.digests(edited).collect()}
    assert sums.keys() == ends.keys() and edited.columns == ["conv_id", "place", "edit", "times", "turn", "was", "role", "text"]
    return {c: sums[c] + ends[c] for c in sums}


def test_repair_of_random_conversations(spark):
    r = random.Random(5)
    texts = ["Yes.", "No!", "why?  ", "cut off", "", " \t", "Yes.", "é。", "x. y", None, "end.\n"]
    rows = []
    for c in range(120):
        for t in range(r.randrange(1, 14)):
            rows.append((c if c else None, r.choice([t, t, t, t + 2, None, t - 1]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua", "User"]), r.choice(texts)))
            if r.random() < 0.2:
                rows += [rows[-1]] * r.randrange(1, 4)
    want = {c: plain_repair(own) for c, own in ordered(rows).items()}
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, limit=2) == want  # many segments a conversation


def test_repair_of_a_hot_conversation(spark):
    r = random.Random(6)
    rows = [(1, t // 2, r.choice(["user", "assistant", "system"]), f"{t % 301} {r.choice(['a.', 'b', 'c!'])}") for t in range(3000)] + [(2, 0, "user", "Hi."), (3, None, "user", None)]
    rows += [(4, 1, "user", "again.")] * 500
    want = {c: plain_repair(own) for c, own in ordered(rows).items()}
    assert repaired(spark, rows, limit=64) == want
    assert want[4][6] == "K" + "D" * 499 + "I" and want[3][6] == "D"


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    edited, faults = conversations.repair(none)
    assert edited.count() == faults.count() == conversations.digests(edited).count() == 0
    edited, _ = conversations.repair(spark.createDataFrame([("a", 1, "user", "x" * 200_000 + ".")], none.schema))
    assert [(x.edit, x.role, len(x.text)) for x in edited.orderBy("place").collect()] == [("K", "user", 200_001), ("I", "assistant", 0)]


def test_damage_handles_nulls(spark):
    rows = [(None, None, None, None), (1, None, "user", "a.b!"), (None, 2, None, "x")] + [(c, t, "assistant", "Yes. No?") for c in range(8) for t in range(8)]
    got = q.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got and all(x.role is not None and x.text is not None for x in got)
