"""The training-data operators as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondera.llm import conversations, decontamination, langid, matroska, mixing, near_dup, ngram_lm, phrases, quality, repeats, sharding, urls, vector_search

#: The rules of the URL query (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SHARDS, SLOTS = 64, 65537


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), percent=85)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), length=50, with_text=False)


def id_slice(n: int):
    """crc32 of the id's text modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = langid.train(docs.where(id_slice(4) != 2))
    return langid.identify(docs.select("doc_id", "text"), filters).select("doc_id", (id_slice(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(documents(spark, sf_dir), folds=5, fold=1)
    return scored.withColumn("held_out", id_slice(5) == 1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_slice(3) != 1)
    scored = quality.classify(docs, quality.train(docs, labels))
    return scored.select("doc_id", (id_slice(3) == 1).alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.col("hit_items")
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), decontamination.items_digest(ids).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store_texts(documents(spark, sf_dir)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return sharding.place(docs, shards=SHARDS, slots=SLOTS).select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vector_search.whole_vectors(F.col("embedding")).alias("v"))
    return vector_search.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), longest=5, least=100, percent=100, limit=2000)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults of the repair query; nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("fault"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    edited, faults = conversations.repair(damaged(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    out = every.join(faults, F.col("conv").eqNullSafe(faults["conv_id"]), "left").drop("conv_id")
    audits = conversations.digests(edited)
    out = out.join(audits, F.col("conv").eqNullSafe(audits["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_url_filter, op2_near_dup, op3_repeats, op4_language_id, op5_lm_score, op6_quality, op7_decontaminate, op8_mixing, op9_matroska, op10_sharding, op11_topk, op12_phrases, op13_repair]
    return {f.__name__: f for f in named}


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

SQL_URLS = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_SQL_RULES}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT host, path, arg_max(rhost || rpath, [length(rhost || rpath), length(rhost)]) AS rule, arg_max(rverdict, [length(rhost || rpath), length(rhost)]) AS verdict
        FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON p.host = f.host AND p.path = f.path
"""

SQL_MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             coalesce(doc_id::VARCHAR, md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT source, size, w, (3.0::DOUBLE * size) AS cap, coalesce(sum(3.0::DOUBLE * size) OVER before, 0.0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0.0) AS rest, sum(size) OVER () AS total
      FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT (total - capped)::DOUBLE AS num, rest AS den FROM o WHERE (total - capped) * w / rest <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, size AS source_size, least(cap, coalesce((SELECT num FROM lv) * w / (SELECT den FROM lv), cap))::DOUBLE AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix:' || d.mark), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM r
"""


SQL_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
c AS (SELECT doc_id AS r, doc_id AS c FROM documents UNION SELECT l.y, c.c FROM c JOIN l ON l.x = c.r WHERE c.c < l.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT r, min(c) AS c FROM c GROUP BY r) m ON m.r = d.doc_id
"""
SQL_REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 2 * j + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 500)) AS j FROM d WHERE length(h) >= 100)),
w AS (SELECT doc_id, j + i AS i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, j, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
b AS (SELECT doc_id, i AS lo, i + 50 AS hi, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w JOIN f USING (s) WHERE doc_id > first),
g AS (SELECT *, count(*) FILTER (reach IS NULL OR lo > reach) OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM b),
r AS (SELECT doc_id, k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM r),
t AS (SELECT e.doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

SQL_LEAKS = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM grams JOIN win USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, array_to_string(list_sort(list(k)), ',') AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


SQL_TOPK = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""

SQL_PHRASES = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS c FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, len(w) AS size, x.k, array_to_string(w[1:x.k], ' ') AS head, array_to_string(w[x.k + 1:], ' ') AS tail FROM c, range(1, 5) x(k) WHERE x.k < len(w)),
s AS (SELECT cuts.*, l.c AS l, r.c AS r, n.n, (1000 * a * n.n) // (l.c * r.c) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
      WHERE NOT EXISTS (SELECT 1 FROM c m WHERE m.lang = b.lang AND len(m.w) > b.size AND contains(' ' || m.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * m.a >= 100 * b.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""

#: Weights are text: a cost of nine digits, then the audit.
SQL_REPAIR = r"""
WITH RECURSIVE table_of AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
h AS (SELECT k.*, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(s, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)::BIGINT]))) % 20 AS fault FROM k, table_of),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fault <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail, role[1:1] AS x FROM d),
q AS (SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, right(tail, 1) NOT IN ('.', '!', '?') AS open, lag(x) OVER (PARTITION BY c ORDER BY i) AS before FROM o),
f AS (SELECT *, NOT blank AND NOT again AS stays, NOT blank AND NOT again AND open AS cut FROM q),
counts AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY c),
insertions(g, p, j) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
steps(p, x, to_state) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
arcs AS (SELECT c, i, g, p AS to_state, 3 + 2 * j AS cost, repeat('I', j) || 'D' AS unit FROM f, insertions
         UNION ALL SELECT c, i, g, to_state, 2 * j + cut::INTEGER, repeat('I', j) || 'K' FROM f, insertions JOIN steps USING (p) WHERE stays AND steps.x = f.x
         UNION ALL SELECT c, i, g, to_state, 2 + 2 * j + cut::INTEGER, repeat('I', j) || 'R' FROM f, insertions JOIN steps USING (p) WHERE stays AND steps.x IN ('u', 'a')),
best(c, i, g, v) AS (SELECT c, n + 1, g, '00000000' || v FROM counts, (VALUES (0, '0'), (3, '0'), (2, '2I'), (1, '4II')) e(g, v)
                     UNION ALL SELECT b.c, b.i - 1, a.g, min(lpad((a.cost + b.v[1:9]::INTEGER)::VARCHAR, 9, '0') || a.unit || b.v[10:]) FROM best b JOIN arcs a ON a.c = b.c AND a.i = b.i - 1 AND a.to_state = b.g GROUP BY b.c, b.i, a.g),
chosen AS (SELECT c, v[1:9]::BIGINT AS cost, v[10:] AS audit FROM best WHERE i = 1 AND g = 0),
walk(c, p, i, g, done) AS (SELECT c, 1::BIGINT, 1::BIGINT, 0, NULL::VARCHAR FROM chosen
    UNION ALL SELECT c, p + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN g WHEN 'K' THEN CASE x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN g = 2 THEN 3 ELSE 2 END END,
      CASE WHEN e = 'D' THEN done ELSE coalesce(done || chr(10), '') || CASE WHEN e = 'K' THEN role WHEN g = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END
    FROM (SELECT w.*, audit[w.p:w.p] AS e, f.x, f.role, f.text FROM walk w JOIN chosen USING (c) LEFT JOIN f ON f.c = w.c AND f.i = w.i WHERE w.p <= length(audit))),
whole AS (SELECT c, coalesce(done, '') AS done FROM walk JOIN chosen USING (c) WHERE p = length(audit) + 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(done, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN chosen USING (c) LEFT JOIN whole USING (c)
"""


def shard_sql() -> str:
    table = sharding.fill_table([f"shard-{i}" for i in range(SHARDS)], SLOTS)
    return f"""
WITH d AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT AS n_bytes, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents),
t AS (SELECT string_split('{",".join(map(str, table))}', ',') AS a)
SELECT doc_id, source, n_bytes, slot, a[slot + 1]::INTEGER AS shard FROM d, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": SQL_URLS, "op2_near_dup": SQL_NEAR, "op3_repeats": SQL_REPEATS, "op7_decontaminate": SQL_LEAKS, "op8_mixing": SQL_MIX, "op10_sharding": shard_sql(), "op11_topk": SQL_TOPK, "op12_phrases": SQL_PHRASES, "op13_repair": SQL_REPAIR}
