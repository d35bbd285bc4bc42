"""The registered queries of the text operators; SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    decontaminate,
    hard_negatives,
    html_text,
    licenses,
    near_copies,
    packing,
    periodic,
    pii,
    quality,
    repeats,
    sharding,
    topk,
    url_tree,
)
from vitrine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op1_topk_search", TOPK_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query("op2_pii")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    spans = pii.joined(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_licenses")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"), telling=licenses.TELLING, wrapped=True)


@query("op6_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13
), g AS (
  SELECT i.doc_id, i.s, array_to_string(d.w[i.s : i.s + 12], ' ') AS p FROM i JOIN d USING (doc_id)
), f AS (
  SELECT p, min(doc_id) AS lo FROM g GROUP BY p
), c AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.s, g.s + 13)) AS k FROM g JOIN f USING (p) WHERE f.lo < g.doc_id
), r AS (
  SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(r.ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(
    [z[1] FOR z IN list_zip(d.w, range(1, len(d.w) + 1)) IF NOT list_contains(coalesce(r.ks, []), z[2])], ' '
  )) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


@query("op7_substring_dedup", REPEATS_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digest(repeats.dedup(table(spark, sf, "documents")))


@query("op8_near_copies")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies.classes(table(spark, sf, "documents"))


@query("op9_html_text")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def _url_sql(depth: int = 5, most: int = 20, share: float = 0.05, doubt: float = 0.05, z: float = 1.96) -> str:
    """The rules and the template tree, one group of WITH parts a level."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(url_tree.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    levels = []
    for d in range(depth - 1, -1, -1):
        before = "m" + str(d + 1) if d < depth - 1 else "g"
        levels.append(f"""
w{d} AS MATERIALIZED (SELECT *, array_to_string(segs[1:{d}], '/') AS up, CASE WHEN len(segs) > {d + 1} THEN segs[{d + 1}] END AS child,
  array_to_string(segs[{d + 2}:], '/') AS rest FROM {before}),
c{d} AS MATERIALIZED (SELECT host, up, child, rest, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM w{d} WHERE child IS NOT NULL GROUP BY ALL),
b{d} AS MATERIALIZED (SELECT host, up, child, sum(n) AS nc, sum(l) AS lc, sum(b) AS bc FROM c{d} GROUP BY ALL),
p{d} AS (SELECT host, up, count(*) AS kids, sum(nc) AS na, sum(lc) AS la, sum(bc) AS ba FROM b{d} GROUP BY ALL),
s{d} AS MATERIALIZED (SELECT host, up, rest, sum(n) AS nr FROM c{d} GROUP BY ALL),
z{d} AS MATERIALIZED (SELECT * FROM b{d} JOIN p{d} USING (host, up) JOIN (SELECT host, up, count(*) AS rests FROM s{d} GROUP BY ALL) USING (host, up)),
o{d} AS (SELECT c.host, c.up, c.child, sum(least(c.n / z.nc, s.nr / z.na)) AS common FROM c{d} c JOIN s{d} s USING (host, up, rest)
  JOIN z{d} z ON z.host = c.host AND z.up = c.up AND z.child = c.child GROUP BY ALL),
t{d} AS (SELECT host, up, child FROM z{d} JOIN o{d} USING (host, up, child) WHERE kids > 1
  AND 1 - common <= sqrt(rests / (4 * nc)) + sqrt(ln(1 / {doubt}::DOUBLE) / 2 / nc)
  AND (lc = 0 OR pow(bc - lc * (ba / la), 2) <= {z * z}::DOUBLE * lc * (ba / la) * (1 - ba / la))),
m{d} AS MATERIALIZED (SELECT host, shape, n, l, b, CASE WHEN t.child IS NULL THEN segs
  ELSE list_concat(list_append(segs[1:{d}], '{{*}}'), segs[{d + 2}:]) END AS segs FROM w{d} w LEFT JOIN t{d} t USING (host, up, child))""")
    id_like = "'^([0-9]+|[0-9a-f]{8,}|[^0-9]*[0-9].*)$'"
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_tree.UPPER}', '{url_tree.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r AS MATERIALIZED (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
      CASE WHEN regexp_matches(x, {id_like}) THEN regexp_replace(x, '^[^.]*[0-9][^.]*', '*') ELSE x END) AS starred
  FROM u
), base AS MATERIALIZED (
  SELECT *, array_to_string(segs, '/') AS shape FROM (SELECT page_id, host, path, rule, said,
    CASE WHEN len(starred) > {depth + 1} THEN list_append(starred[1:{depth}], array_to_string(starred[{depth + 1}:], '/')) ELSE starred END AS segs FROM r)
), sh AS MATERIALIZED (
  SELECT host, shape, count(*) AS n, count(said) AS l, (count(*) FILTER (said = 'block'))::DOUBLE AS b, min(segs) AS segs FROM base GROUP BY host, shape
), nodes AS MATERIALIZED (
  SELECT host, shape, n, segs[i + 1] AS child, i, array_to_string(segs[1:i], '/') AS up FROM (SELECT *, unnest(range(len(segs))) AS i FROM sh)
), kid AS (SELECT host, i, up, child, sum(n) AS nk FROM nodes GROUP BY ALL),
rare AS (
  SELECT host, i, up, child FROM kid JOIN (SELECT host, i, up, count(*) AS kids, sum(nk) AS total FROM kid GROUP BY ALL) USING (host, i, up)
  WHERE kids > {most} AND nk < {share}::DOUBLE * total
), named AS (
  SELECT x.host, x.shape, list(CASE WHEN y.child IS NULL THEN x.child ELSE '*' END ORDER BY x.i) AS segs
  FROM nodes x LEFT JOIN rare y USING (host, i, up, child) GROUP BY x.host, x.shape
), g AS MATERIALIZED (SELECT sh.host, sh.shape, n, l, b, coalesce(named.segs, []::VARCHAR[]) AS segs FROM sh LEFT JOIN named USING (host, shape)),
{",".join(levels)},
f AS MATERIALIZED (SELECT *, '/' || array_to_string(segs, '/') AS template FROM m0),
k AS (SELECT host, template, sum(l) AS l, sum(b) AS b FROM f GROUP BY ALL),
h AS (SELECT host, sum(l) AS hl, sum(b) AS hb FROM k GROUP BY host),
q AS (
  SELECT host, template, k.l, round((k.b + 4 * ((hb + 4 * (sum(k.b) OVER () + 1) / (sum(k.l) OVER () + 2)) / (hl + 4))) / (k.l + 4), 6) AS purity
  FROM k JOIN h USING (host)
)
SELECT base.page_id, base.host, base.path, base.rule, f.template, q.purity,
  coalesce(base.said, CASE WHEN q.purity >= 0.5 AND q.l >= 3 THEN 'block' ELSE 'allow' END) AS verdict
FROM base LEFT JOIN f USING (host, shape) LEFT JOIN q ON q.host = f.host AND q.template = f.template
"""


@query("op10_url_filter", _url_sql())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return url_tree.verdicts(table(spark, sf, "pages"))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, half a byte at a time, low half first."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    halves = f"regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g')"
    digits = f"list_transform(list_filter(string_split({halves}, ''), lambda c: c <> ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))"
    step = f"xor(s >> 4, ([{', '.join(map(str, table))}]::BIGINT[])[1 + (xor(s, x) & 15)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda s, x: {step}), 4294967295::BIGINT)"


SHARDS_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32
  FROM documents
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d
), s AS (
  SELECT *, CAST((2 * upto - size) * 8 // (2 * total) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


@query("op11_sharding", SHARDS_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    vectors = hard_negatives.labelled_vectors(rows, label, scale=256)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


PERIODIC_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents
), n AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d
), a AS (
  SELECT *, g % nullif(n, 0) AS a, 1 + (n - g % nullif(n, 0)) // (3 + g % 8) AS p FROM n
), i AS (
  SELECT doc_id, n, h, w, a, p, unnest(range(n)) AS i FROM a
), t AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i
), e AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n
), o AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e
), m AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM o GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length
), b AS (
  SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n_runs, start, length, period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) OVER (
      PARTITION BY doc_id ORDER BY start, period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lines
  FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
), x AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN x USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op13_periodic_runs", PERIODIC_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.find(table(spark, sf, "documents"), exponent=4, least=6, prepare=periodic.plant)
    return periodic.digest(found)
