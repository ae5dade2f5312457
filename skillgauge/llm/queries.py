"""The operators over whole tables: the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skillgauge.llm import decontaminate, line_dedup, lm_scoring, mixing, near_dup, packing, phrases, pii, quality, quotes, secret_scan, spelling, substrings

_SPACE = r"[^\x20\x09-\x0D]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir), min_words=line_dedup.MIN_WORDS)


def op2_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.duplicate_report(_documents(spark, sf_dir), shingle=4)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination_report(_documents(spark, sf_dir), _benchmark(spark, sf_dir))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(_documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_documents(spark, sf_dir))[0]


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_documents(spark, sf_dir))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_documents(spark, sf_dir))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(_documents(spark, sf_dir))


_SQL_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS l
  FROM documents
),
c AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_exclamations,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM d
),
g AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5
),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS n FROM g),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step FROM h WHERE n > 1),
r AS (SELECT doc_id, sum(step)::BIGINT AS n FROM p GROUP BY doc_id),
j AS (
  SELECT c.*, coalesce(r.n, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 5 * n_lines OR 10 * n_exclamations > 3 * n_words OR word_chars > 20 * n_words) AS kept
FROM j
"""

_SQL_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source
),
f AS (
  SELECT *, (150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER b, 0))::BIGINT AS left_over,
         (100 * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)))::BIGINT AS rest,
         coalesce(sum(w) OVER b, 0)::BIGINT AS used
  FROM s
  WINDOW b AS (ORDER BY 2 * source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
o AS (SELECT used, left_over, rest FROM f WHERE left_over * w < 2 * source_size * rest ORDER BY used LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN o.used IS NULL OR f.used < o.used THEN (2 * f.source_size)::DOUBLE ELSE (f.w * o.left_over)::DOUBLE / o.rest::DOUBLE END AS target
  FROM f LEFT JOIN o ON TRUE
),
x AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source,
       (CASE WHEN source_size = 0 THEN 0
             ELSE (budget // source_size) * size
                  + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END)::BIGINT AS taken
FROM x
"""

_SQL_LINES = rf"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
),
n AS (
  SELECT doc_id, l, list_filter(generate_series(1, len(l)), lambda i: regexp_matches(l[i], '{_SPACE}')) AS w FROM d
),
g AS (
  SELECT doc_id, p, [l[w[p]], l[w[p + 1]], l[w[p + 2]]] AS window3, [w[p], w[p + 1], w[p + 2]] AS spot
  FROM (SELECT doc_id, l, w, unnest(generate_series(1, len(w) - 2)) AS p FROM n WHERE len(w) >= 3)
),
f AS (
  SELECT doc_id, p, spot, row_number() OVER (PARTITION BY window3 ORDER BY doc_id, p) AS nth FROM g
),
r AS (
  SELECT doc_id, list_distinct(flatten(list(spot))) AS gone, count(*) AS copied FROM f WHERE nth > 1 GROUP BY doc_id
)
SELECT n.doc_id, len(w)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(copied, 0)::BIGINT AS n_copied_windows,
       sha256(array_to_string(list_transform(list_filter(generate_series(1, len(l)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: l[i]), chr(10))) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id)
"""

_SQL_PASSAGES = rf"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
),
n AS (
  SELECT doc_id, l, list_filter(generate_series(1, len(l)), lambda i: regexp_matches(l[i], '{_SPACE}')) AS w FROM d
),
g AS (
  SELECT doc_id, p, k, list_transform(w[p:p + k - 1], lambda i: l[i]) AS passage, w[p:p + k - 1] AS spot
  FROM (SELECT doc_id, l, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM n, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)
),
q AS (
  SELECT * FROM g WHERE k = 3 OR list_sum(list_transform(passage, lambda x: len(regexp_extract_all(x, '{_SPACE}')))) >= 50
),
f AS (
  SELECT doc_id, spot, row_number() OVER (PARTITION BY passage ORDER BY doc_id, p) AS nth FROM q
),
r AS (
  SELECT doc_id, list_distinct(flatten(list(spot))) AS gone, count(*) AS copied FROM f WHERE nth > 1 GROUP BY doc_id
)
SELECT n.doc_id, len(w)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(copied, 0)::BIGINT AS n_copied_windows,
       sha256(array_to_string(list_transform(list_filter(generate_series(1, len(l)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: l[i]), chr(10))) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id)
"""

_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SQL_CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}') AS w
  FROM documents
),
b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}') AS w
    FROM benchmark)
  WHERE len(w) > 0
),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)
),
widths AS (SELECT DISTINCT n FROM b),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, widths WHERE len(w) >= n)
),
m AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_SQL_SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM g JOIN m USING (k) WHERE low < doc_id),
a AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') WHEN len(gone) = len(w) THEN ''
                   ELSE array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

_SQL_NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS i FROM d)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2
),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS node, doc_id AS other FROM d
  UNION
  SELECT r.node, l.b FROM r JOIN l ON l.a = r.other
),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

# CRC-32 by half bytes, low half first: what a remainder of each half byte adds (fixed values of the checksum).
_CRC_HALVES = (
    "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
    "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
)
_SQL_SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
),
every AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM every),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(generate_series(1, length(x)), lambda i: instr('0123456789ABCDEF', x[i + 2 * (i % 2) - 1]) - 1)),
         lambda c, v: xor(c >> 4, ({_CRC_HALVES})[xor(c & 15, v) + 1])), 4294967295) AS h FROM bytes
),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words),
keyed AS (SELECT word, n, i, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS rest FROM holes),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM keyed a JOIN keyed b USING (i, head, rest) WHERE a.word <> b.word
  UNION
  SELECT k.word, w.word, w.n FROM keyed k JOIN words w ON w.word = k.head || k.rest
  UNION
  SELECT w.word, k.word, k.n FROM keyed k JOIN words w ON w.word = k.head || k.rest
),
near AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
best AS (SELECT word, other, other_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
formed AS (
  SELECT words.word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word)
),
path AS (
  SELECT word, form AS spot FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT path.word, formed.form FROM path JOIN formed ON formed.word = path.spot WHERE formed.form IS NOT NULL
),
last AS (SELECT path.word, spot AS root FROM path JOIN formed ON formed.word = path.spot WHERE formed.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN last USING (word)
"""

_SQL_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
spots AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM worded, (VALUES (1), (2), (3), (4), (5)) ks(k) WHERE len(w) >= k),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= 100),
listed AS (SELECT *, string_split(phrase, ' ') AS w FROM grams),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, w, f, m, unnest(generate_series(1, k - m + 1)) AS i FROM listed, (VALUES (2), (3), (4)) ms(m) WHERE m < k)
  GROUP BY ALL
),
kept AS (SELECT l.* FROM listed l LEFT JOIN inner_parts p ON p.lang = l.lang AND p.phrase = l.phrase WHERE l.k > 1 AND (p.f IS NULL OR 100 * p.f < 100 * l.f)),
cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS one, array_to_string(w[c + 1:k], ' ') AS two
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM kept)
),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = one JOIN grams y ON y.lang = cuts.lang AND y.phrase = two JOIN totals t ON t.lang = cuts.lang
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op1_repeated_passages": op1_repeated_passages,
    "op2_chat_quotations": op2_chat_quotations,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_personal_data": op7_personal_data,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_scan": op10_secret_scan,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_phrases": op13_phrases,
}
_ORACLES = {"op4_near_dedup": _SQL_NEAR, "op3_substring_dedup": _SQL_SUBSTRINGS, "op1_line_dedup": _SQL_LINES, "op1_repeated_passages": _SQL_PASSAGES, "op5_decontamination": _SQL_CONTAMINATION, "op6_quality_rules": _SQL_QUALITY, "op9_mix_sources": _SQL_MIX, "op12_spelling_variants": _SQL_SPELLING, "op13_phrases": _SQL_PHRASES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
