"""SQL for DuckDB of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from evalspark.llm.common import LOWER, UPPER, WORD
from evalspark.llm.decontaminate import PLAIN_WORD, SHARE
from evalspark.llm.decontaminate import WINDOW as BENCHMARK_WINDOW
from evalspark.llm.filter_audit import FILTERS, LEAST_DISTINCT, LEAST_WORDS, MOST_CAPITALS
from evalspark.llm.quality import CUTOFFS, ERROR, MAX_REPEAT_PERCENT, MIN_WORDS, REPEAT_WINDOW, RISK
from evalspark.llm.quality import RULES as QUALITY_RULES
from evalspark.llm.quality import SYMBOLS
from evalspark.llm.secret_scan import BASE, RULES
from evalspark.llm.substrings import WINDOW

_BLANKS = r"[\x20\x09-\x0D]"


def _plain_words(table: str, key: str) -> str:
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"SELECT {key}, regexp_extract_all({lower}, '{PLAIN_WORD}') AS words FROM {table}"


BENCHMARK = f"""
WITH items AS ({_plain_words("benchmark", "item_id")}),
sized AS (SELECT *, least(len(words), {BENCHMARK_WINDOW}) AS size FROM items WHERE len(words) > 0),
starts AS (SELECT item_id, size, words, unnest(range(1, len(words) - size + 2)) AS pos FROM sized),
grams AS (SELECT DISTINCT item_id, size, array_to_string(words[pos:pos + size - 1], ' ') AS gram FROM starts),
sizes AS (SELECT DISTINCT size FROM grams),
docs AS ({_plain_words("documents", "doc_id")}),
places AS (
  SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS pos FROM docs JOIN sizes ON len(words) >= size),
hits AS (
  SELECT p.doc_id, p.pos, p.size, g.item_id
  FROM places p JOIN grams g ON g.size = p.size AND g.gram = array_to_string(p.words[p.pos:p.pos + p.size - 1], ' ')),
words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(w.n_hit, 0) > 0 AND {SHARE} * coalesce(w.n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN words_hit w ON d.doc_id = w.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

REPEATS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS pos FROM docs),
grams AS (SELECT doc_id, pos, array_to_string(words[pos:pos + {WINDOW} - 1], ' ') AS gram FROM places),
twice AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS place
  FROM grams WHERE gram IN (SELECT gram FROM twice)),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.place) AS kept, count(*) AS n
  FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_RATE = RISK / len(QUALITY_RULES)
_TESTS = " UNION ALL ".join(
    f"SELECT stratum, '{rule}' AS rule, {cut} AS cut, count(*) AS n, count(*) FILTER ({rule} > {cut}) AS k FROM held GROUP BY stratum"
    for rule in QUALITY_RULES
    for cut in CUTOFFS
)
_CUTS = ", ".join(f"min(cut) FILTER (rule = '{rule}') AS {rule}_cut" for rule in QUALITY_RULES)
_REJECTS = " OR ".join(f"coalesce(r.{rule} > c.{rule}_cut, false)" for rule in QUALITY_RULES)
QUALITY = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '{_BLANKS}', '', 'g')) > 0) AS lines
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - {REPEAT_WINDOW} + 2)) AS pos FROM docs),
grams AS (SELECT doc_id, pos, array_to_string(words[pos:pos + {REPEAT_WINDOW} - 1], ' ') AS gram FROM places),
often AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest(range(pos, pos + {REPEAT_WINDOW})) AS place FROM often WHERE n > 1) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, d.stratum, len(d.words) AS n_words,
    length(regexp_replace(d.text, '{_BLANKS}', '', 'g')) AS word_chars,
    length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS n_symbols,
    length(d.text) - length(translate(d.text, '!', '')) AS n_shouts,
    len(d.lines) AS n_lines, len(d.lines) - len(list_distinct(d.lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN repeated r ON d.doc_id = r.doc_id),
ratios AS (
  SELECT *, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN 1000 * n_shouts // n_words ELSE 0 END AS shouts,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counts),
held AS (SELECT * FROM ratios WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS ({_TESTS}),
level AS (SELECT {ERROR} / ({len(QUALITY_RULES)} * greatest(1, count(DISTINCT stratum))) AS level FROM held),
passed AS (
  SELECT stratum, rule, cut FROM tests, level
  WHERE k <= {_RATE} * n AND list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) <= level),
cuts AS (SELECT stratum, {_CUTS} FROM passed GROUP BY stratum)
SELECT r.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR {_REJECTS}) AS kept
FROM ratios r LEFT JOIN cuts c ON r.stratum = c.stratum
"""


def _matches(place: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {place} AS place, string_split_regex(text, '{pattern}') AS between,
    regexp_extract_all(text, '{pattern}') AS match, regexp_extract_all(text, '{pattern}', {rule.group}) AS value, {rule.least} AS least
  FROM docs WHERE regexp_matches(text, '{pattern}')"""


_KINDS = "[" + ", ".join(f"'{rule.kind}'" for rule in RULES) + "]"
_COUNTS = ", ".join(f"CAST(count(*) FILTER (place = {place}) AS BIGINT) AS n_{rule.kind}" for place, rule in enumerate(BASE))
_NO_COUNTS = ", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE)
SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_matches(place, rule) for place, rule in enumerate(RULES))}),
each_match AS (SELECT *, unnest(range(1, len(match) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, place, length(value[i]) AS size, least,
    coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(match[1:i - 1], lambda x: length(x))), 0) AS start, length(match[i]) AS long
  FROM each_match),
named AS (
  SELECT doc_id, place, CAST(start AS BIGINT) AS start, concat_ws(':', {_KINDS}[place + 1], CAST(start AS BIGINT), CAST(start + long AS BIGINT)) AS name
  FROM spans WHERE size >= least),
by_doc AS (
  SELECT doc_id, {_COUNTS}, string_agg(name, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
    string_agg(name, ',' ORDER BY start, place) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, {_NO_COUNTS}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_STEPS = " UNION ALL ".join(
    f"SELECT names, pos + 1 AS step, substr(names, pos + 1, 1) AS name, instr('{FILTERS}', substr(names, pos + 1, 1)) - 1 AS bit, "
    f"{' + '.join([f'(1 << (instr({chr(39)}{FILTERS}{chr(39)}, substr(names, {at}, 1)) - 1))' for at in range(1, pos + 1)]) or '0'} AS earlier "
    f"FROM (SELECT *, {pos} AS pos FROM orders)"
    for pos in range(len(FILTERS))
)
FILTER_AUDIT = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
failing AS (
  SELECT doc_id, part,
    (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM docs),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(string_split('{FILTERS}', '')) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS names FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS ({_STEPS}),
counted AS (
  SELECT part, names, step, name,
    sum(n) FILTER (mask & (earlier | (1 << bit)) = 0) AS kept,
    sum(n) FILTER (mask & (1 << bit) <> 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (mask & (1 << bit) <> 0 AND mask & earlier <> 0) AS redundant,
    sum(n) FILTER (mask = 1 << bit) AS unique_fails,
    sum(good) FILTER (mask & (1 << bit) <> 0 AND mask & earlier = 0) AS good_lost,
    sum(toxic) FILTER (mask & (1 << bit) <> 0 AND mask & earlier = 0) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, names, step, name)
SELECT part, names AS filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, name), 0) AS BIGINT) AS shapley
FROM counted
"""

ORACLE = {
    "op12_exact_dedup": EXACT,
    "op13_filter_interaction_audit": FILTER_AUDIT,
    "op4_benchmark_decontamination": BENCHMARK,
    "op6_substring_dedup": REPEATS,
    "op9_quality_rules": QUALITY,
    "op10_secret_scan": SECRETS,
}
