"""The registered query of each operator of this subpackage, over its whole table, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, fingerprint, language_id, mixing, pieces, quality_rules, sharding, site_quality, toxicity, url_filter
from .common import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(toxicity.training_rows(docs), table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, lexicon)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.train(language_id.training_rows(docs))
    return language_id.identify(docs, trees).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), pieces.PieceTable.load(pieces.default_model()))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no url: their source is the host and source/lang the path."""
    docs = table(spark, sf_dir, "documents")
    return site_quality.rated(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_language_id, op3_quality_rules, op4_fingerprint, op5_bagminhash, op6_url_filter, op7_pieces, op8_site_quality, op9_sharding, op10_mixing)
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('lang:' || lang, 'none') AS s FROM documents),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{_WORD}') AS words FROM d)),
win AS (SELECT rid, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(3) t(j) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
counts AS (SELECT doc_id, s, len(regexp_extract_all(text, '{_WORD}')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
judged AS (SELECT *, (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS lines FROM counts),
rated AS (SELECT j.*, good FROM judged j JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT s FROM rated GROUP BY s HAVING count(*) FILTER (good) >= {quality_rules.least_good()}),
shares AS (SELECT s, good, rule, x FROM rated JOIN strata USING (s), (VALUES ('symbols'), ('repeats'), ('lines')) r(rule), LATERAL (SELECT CASE rule WHEN 'symbols' THEN symbols WHEN 'repeats' THEN repeats ELSE lines END AS x)),
tests AS (SELECT s, rule, g, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS b, count(*) FILTER (good AND x > g) AS kg, count(*) FILTER (NOT good AND x > g) AS kb FROM shares, (VALUES {', '.join(f'({g})' for g in quality_rules.GRID)}) c(g) GROUP BY s, rule, g),
alpha AS (SELECT {quality_rules.LEVEL} / greatest(1, 2 * count(DISTINCT s) * {len(quality_rules.RULES) * len(quality_rules.GRID)}) AS a FROM tests),
tails AS (SELECT *, CASE WHEN kg >= n THEN 1 ELSE list_sum(list_transform(range(0, kg + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK})))) END AS pg,
  CASE WHEN kb = 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, kb), lambda i: exp(lgamma(b + 1) - lgamma(i + 1) - lgamma(b - i + 1) + i * ln({quality_rules.RISK}) + (b - i) * ln(1 - {quality_rules.RISK})))) END AS pb FROM tests),
cutoffs AS (SELECT s, rule, min(g) AS g FROM tails, alpha WHERE pg <= a AND kb > 0 AND pb <= a GROUP BY s, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cutoffs c WHERE c.s = j.s AND CASE c.rule WHEN 'symbols' THEN symbols WHEN 'repeats' THEN repeats ELSE lines END > c.g) AS kept FROM judged j
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_REST}, '^[^/?#]*'), '{_UP}', '{_LOW}')"
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"
_TAIL = f"regexp_extract({_REST}, '^[^/?#]*([^#]*)', 1)"
_NODE = f"CASE WHEN strpos({{u}}, '://') > 0 THEN lower(split_part({{u}}, '://', 1)) || '://' || {_HOST} || CASE WHEN starts_with({_TAIL}, '/') THEN {_TAIL} ELSE '/' || {_TAIL} END END"


def _best(host: str, path: str, what: str) -> str:
    return f"(SELECT {what} FROM rules WHERE ({host} = name OR ends_with({host}, '.' || name)) AND starts_with({path}, prefix) ORDER BY length(rule) DESC, action LIMIT 1)"


_OP6 = rf"""
WITH RECURSIVE rules AS (SELECT action, rule, split_part(rule, '/', 1) AS name, substr(rule, strpos(rule, '/')) AS prefix FROM (VALUES {', '.join(f"('{a}', '{r}')" for a, r in url_filter.RULES)}) v(action, rule)),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(regexp_extract(html, '(?is)^(.*?)(?:<body\b|</head\b|\z)', 1), '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE strpos(url, '://') > 0),
hints AS (SELECT url, trim(replace(CASE
  WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*(?:"[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)') THEN coalesce(nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*"([^"]*)', 1), ''), nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*''([^'']*)', 1), ''), nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*([^\s"''>]+)', 1), ''))
  WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN coalesce(nullif(regexp_extract(tag, '(?is)\bcontent\s*=\s*"[^"]*?\burl\s*=\s*[''"]?([^"'']*)', 1), ''), nullif(regexp_extract(tag, '(?is)\bcontent\s*=\s*''[^'']*?\burl\s*=\s*"?([^"'']*)', 1), '')) END, '&amp;', '&')) AS h FROM tags),
targets AS (SELECT url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN h WHEN starts_with(h, '//') THEN split_part(url, '://', 1) || ':' || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || h WHEN starts_with(h, '?') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || h
  ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({_PATH.format(u='url')}, '(?s)^(.*/)', 1), ''), '/') || h END AS t
  FROM hints WHERE h <> '' AND NOT starts_with(h, '#') AND (contains(h, '://') OR NOT regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:'))),
links AS (SELECT {_NODE.format(u='url')} AS a, {_NODE.format(u='t')} AS b FROM targets),
arcs AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS node, a AS root FROM arcs UNION SELECT b, root FROM reach JOIN arcs ON node = a),
members AS (SELECT node, min(root) AS component, {_HOST.format(u='node')} AS host, {_PATH.format(u='node')} AS path FROM reach GROUP BY node),
acted AS (SELECT component, {_best('host', 'path', 'action')} AS action FROM members),
shared AS (SELECT component, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS verdict FROM acted GROUP BY component),
p AS (SELECT page_id, url, coalesce({_HOST.format(u='url')}, '') AS host, coalesce({_PATH.format(u='url')}, '') AS path FROM pages)
SELECT page_id, p.host, p.path, {_best('p.host', 'p.path', 'rule')} AS rule, coalesce({_best('p.host', 'p.path', 'action')}, s.verdict, 'allow') AS verdict
FROM p LEFT JOIN members m ON m.node = {_NODE.format(u='p.url')} LEFT JOIN shared s USING (component)
"""


def _unit(parts: str, start: int = 1) -> str:
    return f"CAST('0x' || substr(md5({parts}), {start}, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


#: Every row with the key that sharding.row_key gives and its number among rows alike.
_ROWS = "SELECT *, row_number() OVER (PARTITION BY row_key) - 1 AS nth FROM (SELECT doc_id, source, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce('s' || source, 'n') || '|' || md5(coalesce(text, '')) AS row_key FROM documents)"


def _crc_table() -> str:
    """CRC-32 of the sixteen half bytes, by the reflected polynomial."""
    out = range(16)
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 * (c & 1)) for c in out]
    return f"[{', '.join(map(str, out))}]"


#: CRC-32 of the text t, half byte by half byte, the lower half of each byte first.
_CRC = rf"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(t), '(.)(.)', '\2\1', 'g'), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))),
  lambda a, b: xor(a >> 4, {_crc_table()}[(xor(a, b) & 15) + 1])), 4294967295)"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, source, strlen(t) + 1 AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC} END AS text_crc32, '{sharding.SEED}|' || row_key || '|' || nth AS h FROM ({_ROWS})),
hashed AS (SELECT *, {_unit('h')} AS u, {_unit('h', 14)} AS v FROM d),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY u, doc_id, size, text_crc32) - 1 + v) / count(*) OVER (PARTITION BY source) AS f FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, source, u, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * {sharding.SHARDS} // n AS INTEGER) AS shard, pos - (pos * {sharding.SHARDS} // n * n + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""


_OP10 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(t, '{_WORD}')) AS size, '{mixing.SEED}|' || row_key || '|' || nth AS h FROM ({_ROWS})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size + 1)) * 8 + ((size + 1) >> greatest(length(bin(size + 1)) - 3, 0)), {_unit('h')}, doc_id, size) - 1 AS pos FROM d),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM sizes),
tried AS (SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () - {mixing.CAP} * coalesce(sum(source_size) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS unit
  FROM weighed WINDOW o AS (ORDER BY source_size / CAST(w AS DOUBLE), source IS NULL, source), b AS (ORDER BY source_size / CAST(w AS DOUBLE), source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(CAST({mixing.CAP} * source_size AS DOUBLE), coalesce((SELECT arg_min(unit, place) FROM tried WHERE unit * w <= {mixing.CAP} * source_size) * w, CAST({mixing.CAP} * source_size AS DOUBLE))) AS target FROM tried),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate, {_unit(f"'{mixing.SEED}|offset|' || coalesce(source, '')")} AS shift FROM goal)
SELECT doc_id, size, source_size, target, CAST(floor((pos + 1) * rate + shift) - floor(pos * rate + shift) AS BIGINT) * size AS taken
FROM ranked r JOIN rated t ON r.source IS NOT DISTINCT FROM t.source
"""


def oracle_sql() -> dict[str, str]:
    """Operators 1, 2, 4, 5, 7 and 8 learn, hash or decode in ways that SQL lacks; tests hold them against brute force."""
    return {"op3_quality_rules": _OP3, "op6_url_filter": _OP6, "op9_sharding": _OP9, "op10_mixing": _OP10}
