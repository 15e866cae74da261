"""Registered queries of the training-data operators, thin over the operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import (
    curriculum,
    decontaminate,
    embeddings,
    html_text,
    language,
    licenses,
    quality,
    simhash,
    spelling,
    token_counts,
    token_files,
    url_rules,
    whitening,
)
from newsloom.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


#: Words of the decontamination in SQL.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP3_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
    lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT l FROM win),
place AS (
  SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM doc, sizes WHERE len(w) >= l
),
gram AS (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS g FROM place),
hit AS (SELECT doc_id, gram.l, i, item_id FROM gram JOIN win ON gram.g = win.g AND gram.l = win.l),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, l, i FROM hit)) GROUP BY doc_id
),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@register("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@register("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer)
    return token_files.read_tokens(spark, folder, manifest).withColumnRenamed("id", "doc_id")


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumnRenamed("id", "doc_id")


OP4_SQL = """
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents
),
src AS (SELECT source, sum(size) AS s FROM doc GROUP BY source),
cls AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS c FROM src),
wgt AS (SELECT *, CASE c WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM cls),
lvl AS (
  SELECT *, (sum(s) OVER () - 3 * coalesce(sum(s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM wgt
),
goal AS (SELECT source, c, s::BIGINT AS s, least(max(l) OVER () * w, (3 * s)::DOUBLE) AS t FROM lvl),
placed AS (
  SELECT doc.*, c, s, t, floor(t + 0.5)::BIGINT AS d,
    coalesce(sum(size) OVER (PARTITION BY doc.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
  FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, s AS source_size, t AS target,
  (greatest(0, least(size, d - f)) + greatest(0, least(size, d - f - s)) + greatest(0, least(size, d - f - 2 * s)))::BIGINT AS taken,
  CASE WHEN size > 0 AND f < d THEN round(CASE c WHEN 0 THEN 2 * q / (1.5 + sqrt(2.25 - 2 * q)) WHEN 1 THEN q
    ELSE 2 * q / (0.5 + sqrt(0.25 + 2 * q)) END, 9) END AS position
FROM (SELECT *, CASE WHEN f < d THEN f::DOUBLE / d END AS q FROM placed)"""


@register("op4_curriculum", OP4_SQL)
def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.assign(table(spark, sf_dir, "documents"))
    first = F.array_min(F.transform("passes", lambda p: p.position))
    ordered = mixed.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "id")
    position = F.round("position", 9).alias("position")
    return ordered.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", position)


@register("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(language.learning_rows(docs))
    found = language.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), language.held_out("id").alias("held_out"), "lang_pred", "score")


@register("op8_embeddings")
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@register("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.statements())
#: The documents as a tree of files: by source and language, with licence files at both levels.
_PATH_SQL = """'/' || coalesce(source, '') || CASE doc_id % 50 WHEN 0 THEN '/LICENSE-' || doc_id
  WHEN 1 THEN '/' || coalesce(lang, '') || '/LICENSE-' || doc_id
  ELSE '/' || coalesce(lang, '') || '/' || (doc_id % 7) || '/' || doc_id || '.txt' END"""


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _plain(text: str) -> str:
    return f"regexp_replace({_lower(text)}, '{licenses.HOLDER}', '', 'g')"


_LICENSE_WORDS = (
    "list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, 'pl-?v ?([0-9])', 'pl \\1', 'g'), "
    f"'(^|[^a-z0-9])v\\.? ?([0-9])', '\\1 \\2', 'g'), '{licenses.WORD}'), lambda w: regexp_replace(w, '\\.0$', ''))"
)
_SPEAKS = f"lambda l: regexp_matches(l, '{licenses.LINE}')"

OP1_SQL = f"""
WITH f AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS directory, text,
    regexp_matches(path, '{licenses.FILE_NAME}') AS named, {_plain('text')} AS plain
  FROM (SELECT doc_id, {_PATH_SQL} AS path, text FROM documents)
),
lined AS (SELECT doc_id, path, named, plain, string_split(plain, chr(10)) AS lines FROM f WHERE named OR regexp_matches({_lower('text')}, '{licenses.LINE}')),
piece AS (
  SELECT DISTINCT doc_id, path, 0 AS rank, plain AS s FROM lined WHERE named AND regexp_matches(plain, '[a-z0-9]')
  UNION SELECT doc_id, path, 1, unnest(list_filter(list_concat(string_split_regex(plain, '{licenses.BLANK}'), string_split_regex(array_to_string(
    list_transform(lines, lambda l: CASE WHEN regexp_matches(l, '{licenses.COMMENT}') THEN l ELSE '' END), chr(10)), '{licenses.BLANK}')), {_SPEAKS})) FROM lined
  UNION SELECT doc_id, path, 2, unnest(list_filter(CASE WHEN named THEN string_split_regex(plain, '{licenses.SENTENCE}') ELSE lines END, {_SPEAKS})) FROM lined
),
tpl AS (SELECT DISTINCT license, {_plain('statement')} AS s FROM (VALUES {_TEMPLATES}) t(license, statement)),
named_terms AS (
  SELECT license, s, term, 1 + ln(count(*)) AS tf FROM (SELECT license, s, unnest({_LICENSE_WORDS.format('s')}) AS term FROM tpl) GROUP BY ALL
),
idf AS (SELECT term, ln((SELECT count(*) + 1 FROM tpl)::DOUBLE / count(*)) AS idf FROM named_terms GROUP BY term),
nw AS (SELECT license, s AS t, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY license, s)) AS len FROM named_terms JOIN idf USING (term)),
own AS (
  SELECT s, term, 1 + ln(count(*)) AS tf FROM (SELECT s, unnest({_LICENSE_WORDS.format('s')}) AS term FROM (SELECT DISTINCT s FROM piece)) GROUP BY ALL
),
ow AS (
  SELECT s, term, tf * coalesce(idf, {licenses.UNSEEN}) AS w, sqrt(sum((tf * coalesce(idf, {licenses.UNSEEN})) ** 2) OVER (PARTITION BY s)) AS norm
  FROM own LEFT JOIN idf USING (term)
),
near AS (SELECT ow.s, license, round(sum(ow.w * nw.w / len) / any_value(norm), 6) AS sim FROM ow JOIN nw USING (term) GROUP BY ow.s, license, t),
best AS (SELECT s, license, sim FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, license) AS k FROM near) WHERE k = 1),
chosen AS (
  SELECT doc_id, path, license, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY sim < {licenses.THRESHOLD}::DOUBLE,
      CASE WHEN sim >= {licenses.THRESHOLD}::DOUBLE THEN rank END, sim DESC, license) AS k FROM piece JOIN best USING (s)) WHERE k = 1
),
o AS (
  SELECT doc_id, f.path, directory, named, sim, CASE WHEN sim >= {licenses.THRESHOLD}::DOUBLE THEN license END AS own_license
  FROM f LEFT JOIN chosen USING (doc_id)
),
m AS (
  SELECT directory AS above, path AS from_path, own_license AS from_license FROM (
    SELECT *, row_number() OVER (PARTITION BY directory ORDER BY sim DESC, path) AS k FROM o WHERE own_license IS NOT NULL AND named) WHERE k = 1
),
inh AS (
  SELECT directory, from_path, from_license FROM (
    SELECT d.directory, m.*, row_number() OVER (PARTITION BY d.directory ORDER BY length(above) DESC) AS k
    FROM (SELECT DISTINCT directory FROM o) d JOIN m ON d.directory = above OR starts_with(d.directory, above || '/')) WHERE k = 1
)
SELECT doc_id, path, own_license, sim AS similarity, coalesce(own_license, from_license) AS license,
  CASE WHEN own_license IS NOT NULL THEN path ELSE from_path END AS license_from
FROM o LEFT JOIN inh USING (directory)"""


@register("op1_license_scan", OP1_SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.expr(_PATH_SQL).alias("path"), "text")
    return licenses.scan(files, id_column="doc_id").withColumnRenamed("id", "doc_id")


_RULES = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in url_rules.RULES)


_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_HOST = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _address(url: str) -> str:
    """One form of a URL's host, path and query, in SQL."""
    rest = _REST.format(url)
    host = f"regexp_replace({_HOST.format(rest)}, CASE WHEN {url} ILIKE 'https://%' THEN ':443$' ELSE ':80$' END, '')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    parts = f"string_split({path}, '/')"
    open_end = f"CASE WHEN list_last({parts}) IN ('.', '..') THEN [['']] ELSE [] END"
    walked = (
        f"list_reduce(list_concat(list_transform(list_filter({parts}, lambda p: p <> '.'), lambda p: [p]), {open_end}), "
        "lambda done, part: CASE WHEN part[1] = '..' THEN done[1 : greatest(len(done) - 1, 1)] ELSE list_concat(done, part) END)"
    )
    whole = f"CASE WHEN {path} = '' THEN '/' ELSE array_to_string({walked}, '/') END"
    return f"CASE WHEN {host} = '' THEN '' ELSE {host} || {whole} || regexp_extract({rest}, '^[^/?#]*[^?#]*(\\?[^#]*)', 1) END"


def _targets(tag: str, marked: str, value: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all(plain, {_quoted(tag)}), lambda t: regexp_matches(t, {_quoted(marked)})), "
        f"lambda t: regexp_extract(t, {_quoted(value)}, 1))"
    )


_ROOT = "split_part(url, '://', 1) || '://' || regexp_extract(rest, '^[^/?#]*')"

OP2_SQL = f"""
WITH RECURSIVE rules AS (SELECT *, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p FROM (VALUES {_RULES}) t(verdict, rule)),
page AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), {_quoted(url_rules.COMMENT)}, '', 'g') AS plain, {_REST.format('url')} AS rest FROM pages),
split AS (
  SELECT page_id, url, plain, rest, {_HOST.format('rest')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    coalesce({_address('url')}, '') AS node FROM page
),
tag AS (
  SELECT * REPLACE (replace(t, '&amp;', '&') AS t) FROM (SELECT url, rest, path, node, unnest(list_concat(
    {_targets(url_rules.LINK_TAG, url_rules.CANONICAL, url_rules.HREF)},
    {_targets(url_rules.META_TAG, url_rules.REFRESH, url_rules.TARGET)})) AS t FROM split WHERE node <> '') WHERE t <> ''
),
full_url AS (
  SELECT node AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN {_ROOT} || t WHEN starts_with(t, '?') THEN {_ROOT} || path || t
    ELSE {_ROOT} || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || t END AS r FROM tag
),
edge AS (SELECT DISTINCT a, {_address('r')} AS b FROM full_url),
both_ways AS (SELECT a, b FROM edge WHERE b <> '' UNION SELECT b, a FROM edge WHERE b <> ''),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
node_rule AS (
  SELECT node, max_by(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT b AS node FROM reach), rules
  WHERE (regexp_extract(node, '^[^/?#]*') = h OR ends_with(regexp_extract(node, '^[^/?#]*'), '.' || h))
    AND starts_with(regexp_extract(node, '^[^/?#]*([^?#]*)', 1), p) GROUP BY node
),
handed AS (
  SELECT a FROM reach JOIN node_rule ON b = node GROUP BY a
  HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
),
page_rule AS (
  SELECT page_id, max_by(verdict, length(rule)) AS verdict, max_by(rule, length(rule)) AS rule FROM (SELECT DISTINCT page_id, host, path FROM split), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN page_rule USING (page_id) LEFT JOIN handed ON split.node = a"""


@register("op2_url_rules", OP2_SQL)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


_FIGURES = ", ".join(f"{{'figure': '{name}', 'v': {text.replace(' div ', ' // ')}}}" for name, (text, *_) in quality.FIGURES.items())
_MARGIN = " ".join(f"WHEN '{name}' THEN {margin}" for name, (_, margin, _) in quality.FIGURES.items())
_TWO_SIDED = ", ".join(f"'{name}'" for name, (*_, both) in quality.FIGURES.items() if both)

OP12_SQL = f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
),
place AS (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM doc WHERE len(w) > {quality.WINDOW}),
gram AS (SELECT r, i, array_to_string(w[i : i + {quality.WINDOW - 1}], ' ') AS g FROM place),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM gram) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT p)::BIGINT AS c FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY r),
base AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0) AS n_repeat_words
  FROM doc LEFT JOIN repeated USING (r)
),
figure AS (
  SELECT r, lang, source, n_words, f.figure, f.v FROM (SELECT *, unnest([{_FIGURES}]) AS f FROM base)
),
bin AS (
  SELECT *, (v >> greatest(0, length(bin(v)) - {quality.BITS})::INT) << greatest(0, length(bin(v)) - {quality.BITS})::INT AS b FROM figure WHERE n_words > 0
),
grouped AS (
  SELECT 0 AS level, lang, source, figure, b, count(*) AS n FROM bin GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, figure, b, count(*) FROM bin GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, figure, b, count(*) FROM bin GROUP BY ALL
),
reached AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, figure) AS rows,
    sum(n) OVER (PARTITION BY level, lang, source, figure ORDER BY b) AS upto FROM grouped
),
quartile AS (
  SELECT level, lang, source, figure, max(rows) AS rows, min(b) FILTER (4 * upto >= rows) AS q1, min(b) FILTER (4 * upto >= 3 * rows) AS q3
  FROM reached GROUP BY ALL
),
fence AS (
  SELECT level, lang, source, figure, rows, CASE WHEN figure IN ({_TWO_SIDED}) THEN q1 - away END AS low, q3 + away AS high
  FROM (SELECT *, greatest({quality.RANGES} * (q3 - q1), CASE figure {_MARGIN} END) AS away FROM quartile)
),
cut AS (
  SELECT a.lang, a.source, a.figure,
    CASE WHEN a.rows >= {quality.OWN_ROWS} THEN a.low WHEN b.rows >= {quality.OWN_ROWS} THEN b.low ELSE c.low END AS low,
    CASE WHEN a.rows >= {quality.OWN_ROWS} THEN a.high WHEN b.rows >= {quality.OWN_ROWS} THEN b.high ELSE c.high END AS high
  FROM fence a JOIN fence b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.figure = b.figure
    JOIN fence c ON c.level = 2 AND a.figure = c.figure WHERE a.level = 0
),
outside AS (
  SELECT r, count(*) AS c FROM figure f JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang AND f.source IS NOT DISTINCT FROM cut.source
    AND f.figure = cut.figure WHERE v > high OR v < low GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND c IS NULL AS kept
FROM (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS failed FROM base) LEFT JOIN outside USING (r)"""


@register("op12_quality_rules", OP12_SQL)
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened", "explained", "identity_error",
    )
