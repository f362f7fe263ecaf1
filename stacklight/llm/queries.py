"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import warc

    path = warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import tokens

    path = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.token_digests(spark, path)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import quality_model

    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import decontaminate

    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import lm

    scores = lm.train_and_score(table(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import html

    return html.main_texts(table(spark, sf_dir, "pages"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = rules.judged(docs, rules.estimated_order(docs))
    base = F.coalesce(F.col("failed_rule").isin([r.name for r in rules.BASE]), F.lit(False))
    return m.select("doc_id", *rules.CONTRACT, base.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import mixing

    return mixing.mixed(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stacklight.llm import substring

    return substring.without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_tokens, op3_quality, op4_decontaminate, op5_jaccard, op6_lm, op7_html, op8_rules, op9_mixing, op10_substring)}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hex digits are four base32 digits.
_DIGITS = " || ".join(f"'{_BASE32}'[((('0x' || substr(x, {5 * k + 1}, 5))::BIGINT >> {b}) & 31) + 1]" for k in range(8) for b in (15, 10, 5, 0))

OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
r AS (SELECT *, last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM r
"""

def _folded(words: str) -> str:
    """SQL for words in small letters without marks at their ends; those of nothing else stay."""
    low = "replace(lower(x), 'ß', 'ss')"
    bare = f"regexp_replace(regexp_replace({low}, '^[\\p{{P}}\\p{{S}}]+', ''), '[\\p{{P}}\\p{{S}}]+$', '')"
    return f"list_transform({words}, lambda x: CASE WHEN {bare} = '' THEN {low} ELSE {bare} END)"


#: Alignment of every document with every item with which it shares a seed, over the whole document, word by word of the item.
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, {_folded(_WORDS)} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {_folded(_WORDS)} AS w FROM benchmark),
widths AS (SELECT DISTINCT least(3, len(w)) AS k FROM b WHERE len(w) > 0),
dg AS (SELECT DISTINCT row, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' '))) AS g FROM d, widths),
bg AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' '))) AS g FROM b, widths WHERE k = least(3, len(w))),
pairs AS (SELECT DISTINCT row, item FROM dg JOIN bg USING (k, g)),
dw AS (SELECT row, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d WHERE row IN (SELECT row FROM pairs)),
bw AS (SELECT item, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM b),
h(row, item, i, j, v) AS (
  SELECT row, item, 0::BIGINT, j, 0::BIGINT FROM pairs JOIN dw USING (row)
  UNION ALL
  SELECT row, item, i, j, greatest(0, max(t + j) OVER (PARTITION BY row, item ORDER BY j) - j)
  FROM (SELECT h.row, h.item, bw.i, h.j, greatest(0, v - 1, coalesce(lag(v) OVER (PARTITION BY h.row, h.item ORDER BY h.j), 0) + CASE WHEN dw.x = bw.x THEN 1 ELSE -1 END) AS t
        FROM h JOIN dw ON dw.row = h.row AND dw.j = h.j JOIN bw ON bw.item = h.item AND bw.i = h.i + 1)
),
best AS (SELECT row, item, v, j FROM h QUALIFY row_number() OVER (PARTITION BY row, item ORDER BY v DESC, j) = 1)
SELECT doc_id, item_id, v AS matched, v / len(b.w)::DOUBLE AS score, j AS end_word FROM best JOIN d USING (row) JOIN b USING (item) WHERE 2 * v >= len(b.w)
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT row, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM d WHERE len(w) > 0),
sizes AS (SELECT row, count(*) AS n FROM grams GROUP BY row),
shared AS (SELECT x.row AS a, y.row AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.row <> y.row GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(row, root) AS (SELECT row, row FROM d UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.row),
classes AS (SELECT row, min(root) AS class FROM reach GROUP BY row),
numbers AS (SELECT a AS row, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY class) ELSE doc_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS copy_id
FROM d JOIN classes USING (row) LEFT JOIN numbers USING (row)
"""


def _crc32_sql(text: str) -> str:
    """The checksum of a short ASCII text, bit by bit."""
    bits = "list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, xor({c}, {x}))"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT), lambda crc, x: {bits.format(c='crc', x='x')}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _kneser_ney_sql() -> str:
    """The model of order 3 in tables: longest n-grams at each training token, shorter ones by their different words before, discounts, and each token's probability."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = "regexp_extract_all(translate(coalesce(text, ''), " + letters + r"), '[^\x20\x09-\x0D]+')"
    discount = lambda k: f"""d{k} AS (SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN greatest(0.05, least(0.95, 1 - 2 * y * n2 / n1)) ELSE 0.5 END AS e1, CASE WHEN n2 > 0 AND n3 > 0 THEN greatest(0.05, least(2, 2 - 3 * y * n3 / n2)) ELSE 1.0 END AS e2,
 CASE WHEN n3 > 0 AND n4 > 0 THEN greatest(0.05, least(3, 3 - 4 * y * n4 / n3)) ELSE 1.5 END AS e3 FROM (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS y FROM (SELECT count(*) FILTER (n = 1)::DOUBLE AS n1, count(*) FILTER (n = 2)::DOUBLE AS n2, count(*) FILTER (n = 3)::DOUBLE AS n3, count(*) FILTER (n = 4)::DOUBLE AS n4 FROM c{k})))"""  # noqa: E731
    cut = lambda n, k: f"greatest(0, coalesce({n}, 0) - CASE WHEN coalesce({n}, 0) = 0 THEN 0 WHEN {n} = 1 THEN d{k}.e1 WHEN {n} = 2 THEN d{k}.e2 ELSE d{k}.e3 END)"
    kinds = "sum(n) AS follow, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS more"
    step = lambda k, below: f"CASE WHEN h{k}.follow IS NULL THEN {below} ELSE ({cut(f'c{k}.n', k)} + (d{k}.e1 * h{k}.one + d{k}.e2 * h{k}.two + d{k}.e3 * h{k}.more) * {below}) / h{k}.follow END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_crc32_sql("coalesce(doc_id::VARCHAR, 'null')")} % 7 = 2 AS held_out, {words} AS w FROM documents),
t AS (SELECT row, held_out, p, w, lag(w) OVER s AS v, lag(w, 2) OVER s AS u FROM (SELECT row, held_out, unnest(range(0, len(w) + 2)) AS p, unnest(['<s>' || chr(10)] || w || ['</s>' || chr(10)]) AS w FROM docs) WINDOW s AS (PARTITION BY row ORDER BY p)),
seen AS (SELECT u, v, w FROM t WHERE NOT held_out AND p > 0),
words AS (SELECT w, count(*) AS n FROM seen GROUP BY w),
total AS (SELECT coalesce(sum(n), 0)::BIGINT AS tokens, count(*) AS v FROM words),
c3 AS (SELECT u, v, w, count(*) AS n FROM seen WHERE u IS NOT NULL GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS n FROM (SELECT v, w FROM c3 UNION ALL SELECT v, w FROM seen WHERE u IS NULL) GROUP BY ALL),
c1 AS (SELECT w, count(*) AS n FROM c2 GROUP BY w),
{discount(1)}, {discount(2)}, {discount(3)},
h2 AS (SELECT v, {kinds} FROM c2 GROUP BY v), h3 AS (SELECT u, v, {kinds} FROM c3 GROUP BY u, v),
low AS (SELECT greatest(1, sum(n)) AS types, coalesce((max(e1) * count(*) FILTER (n = 1) + max(e2) * count(*) FILTER (n = 2) + max(e3) * count(*) FILTER (n >= 3)) / sum(n), 1) AS gamma FROM c1, d1),
p1 AS (SELECT t.*, words.n AS known, {cut('c1.n', 1)} / low.types + low.gamma / (total.v + 1) AS q FROM t CROSS JOIN d1 CROSS JOIN low CROSS JOIN total LEFT JOIN c1 ON c1.w = t.w LEFT JOIN words ON words.w = t.w WHERE p > 0),
p2 AS (SELECT p1.*, {step(2, 'q')} AS q2 FROM p1 CROSS JOIN d2 LEFT JOIN h2 ON h2.v = p1.v LEFT JOIN c2 ON c2.v = p1.v AND c2.w = p1.w),
p3 AS (SELECT p2.*, {step(3, 'q2')} AS q3 FROM p2 CROSS JOIN d3 LEFT JOIN h3 ON h3.u = p2.u AND h3.v = p2.v LEFT JOIN c3 ON c3.u = p2.u AND c3.v = p2.v AND c3.w = p2.w)
SELECT doc_id, docs.held_out, count(*)::BIGINT AS n_tokens, count(known)::BIGINT AS n_known, max(tokens)::BIGINT AS train_tokens, round(sum(log10((coalesce(known, 0) + 1) / (tokens + total.v + 1))), 6) AS base_score, round(sum(log10(q3)), 6) AS score
FROM docs JOIN p3 USING (row) CROSS JOIN total GROUP BY row, doc_id, docs.held_out
"""


OP6_SQL = _kneser_ney_sql()

def _unescaped(x: str) -> str:
    """SQL for the character references that the pages' articles have; the ampersand last."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&#x27;", "\'\'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    return x


#: What the contract asks of pages like these: one article element, no container in it, and b as the only element within a block.
OP7_SQL = f"""
WITH a AS (SELECT row_number() OVER () AS row, page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS t FROM pages),
blocks AS (SELECT *, list_filter(list_transform(string_split_regex(t, '<[^>]*>'), lambda x: trim(regexp_replace({_unescaped("x")}, '\\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM a)
SELECT page_id, url, array_to_string(b, ' ') AS text, length(array_to_string(b, ' '))::BIGINT AS n_chars FROM blocks
"""

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
triples AS (SELECT row, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d),
found AS (SELECT row, p FROM triples QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
steps AS (SELECT row, least(3, p - lag(p, 1, -9) OVER (PARTITION BY row ORDER BY p)) AS n FROM found),
repeated AS (SELECT row, sum(n)::BIGINT AS n FROM steps GROUP BY row),
lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\\p{{L}}+', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS n_digits,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, len(l) AS n_lines,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*\u2022]'))) AS n_bullets, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '([.][.][.]|\u2026)[\\x20\\x09\\x0D]*$'))) AS n_ellipses
  FROM d JOIN lines USING (row) LEFT JOIN repeated USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 5 * n_marks > n_words OR (n_dup_lines >= 3 AND 20 * n_dup_lines > n_words) OR 2 * n_letters < word_chars OR 2 * n_capitals > n_letters OR 5 * n_digits > word_chars
            OR longest_word > 1000 OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
FROM m
"""

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len({_WORDS})::BIGINT AS size, md5('20|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS ord FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(ord - 1) % 3 + 1] AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, coalesce((SELECT level FROM f WHERE level <= ratio ORDER BY ratio, ord LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM f),
parties AS (SELECT *, (source_size + 63) // 64 AS blocks FROM t),
ranked AS (SELECT ord, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, ord, seat) AS rank FROM (SELECT ord, target, unnest(range(0, blocks * 2)) AS seat FROM parties WHERE target > 0)),
seats AS (SELECT ord, count(*) AS seats FROM ranked WHERE rank <= (SELECT round(sum(target) / 64) FROM t) GROUP BY ord),
q AS (SELECT parties.*, coalesce(seats, 0) AS seats, greatest(1, (blocks + 4095) // 4096) AS shards FROM parties LEFT JOIN seats USING (ord)),
x AS (SELECT row, doc_id, size, q.*, coalesce(sum(size) OVER (PARTITION BY ord ORDER BY u, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
ends AS (SELECT * EXCLUDE (a), unnest([-1, 1]) AS sign, unnest([a, a + size]) AS a FROM x),
b AS (SELECT *, greatest(1, blocks) AS n, least(a // 64, greatest(blocks - 1, 0)) AS blk FROM ends),
j AS (SELECT *, ((blk + 1) * shards - 1) // n AS shard FROM b),
e AS (SELECT *, shard * blocks // shards AS p, (shard + 1) * blocks // shards AS r FROM j),
k AS (SELECT *, greatest(1, r - p) AS length, seats * r // n - seats * p // n AS quota, a - p * 64 AS here, least(r * 64, source_size) - p * 64 AS room FROM e),
g AS (SELECT *, quota % length AS arc, ('0x' || substr(md5('20|shard|' || ord || '|' || shard), 1, 12))::BIGINT % length AS first FROM k),
c AS (SELECT *, CASE WHEN blocks > 0 THEN seats * p // n * 64 + quota // length * here + greatest(0, least(here, (first + arc - length) * 64)) + greatest(0, least(here, (first + arc) * 64, room) - first * 64) ELSE 0 END AS upto FROM g)
SELECT doc_id, size, source_size, round(target, 6) AS target, sum(sign * upto)::BIGINT AS taken FROM c GROUP BY row, doc_id, size, source_size, target
"""

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
spans AS (SELECT row, doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i : i + 49], ' ')))) AS g FROM d),
again AS (SELECT row, p FROM spans QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
each AS (SELECT row, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
marked AS (SELECT e.row, e.p, e.word, max(a.p) OVER (PARTITION BY e.row ORDER BY e.p) AS last FROM each e LEFT JOIN again a ON a.row = e.row AND a.p = e.p),
kept AS (SELECT row, count(*) FILTER (last >= p - 49) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (last IS NULL OR last < p - 49) AS k FROM marked GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""

#: The other operators learn by steps of their own, align, tokenize or read markup; tests/llm holds them against brute force or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op4_decontaminate": OP4_SQL, "op5_jaccard": OP5_SQL, "op6_lm": OP6_SQL, "op7_html": OP7_SQL, "op8_rules": OP8_SQL, "op9_mixing": OP9_SQL, "op10_substring": OP10_SQL}
