"""The registered queries in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from quern.functions.tongues import TEXTS

ORACLE: dict[str, str] = {}


def _stats(table: str, numbers: list[str], others: list[str]) -> str:
    parts = []
    for c in [*numbers, *others]:
        figures = f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std" if c in numbers else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, floor((count(*) - count({c})) * 100.0 / count(*) * 100 + 0.5) / 100 AS null_percentage, count(DISTINCT {c}) AS unique_count, {figures} FROM {table}")
    return " UNION ALL ".join(parts)


ORACLE["column_stats_documents"] = _stats("documents", ["doc_id", "n_chars"], ["text", "lang", "source"])
ORACLE["column_stats_lineitem"] = _stats("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "l_shipdate"])
ORACLE["token_estimate_fallback"] = "SELECT CAST(floor(sum(length(text)) * 0.75) AS BIGINT) AS token_estimate FROM documents"
ORACLE["preview_documents"] = "SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 50"

ORACLE["dedup_exact_first"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)"
ORACLE["dedup_exact_last"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY text)"
ORACLE["dedup_exact_subset"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text, lang, source)"
ORACLE["dedup_metrics"] = "SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after, count(*) - count(DISTINCT text) AS exact_removed FROM documents"
_VECTORS = """
vectors AS (
  SELECT vec_id * 10 AS vec_id, embedding::DOUBLE[] AS v, label FROM embeddings
  UNION ALL SELECT vec_id * 10 + 1, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i % 2 = 1 THEN 0.01 ELSE -0.01 END), label FROM embeddings WHERE vec_id % 5 = 0
), near AS (
  SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS s FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95
)"""
ORACLE["dedup_semantic_edges"] = f"WITH {_VECTORS} SELECT a, b, round(s, 4) AS similarity FROM near"
# no vector here is linked with more than one other, so the greedy choice is the smaller of each pair
ORACLE["dedup_semantic"] = f"WITH {_VECTORS} SELECT vec_id, label FROM vectors WHERE vec_id NOT IN (SELECT b FROM near)"

ORACLE["dedup_both"] = ORACLE["dedup_semantic"]
ORACLE["semantic_top10"] = f"""
WITH {_VECTORS}, pairs AS (
  SELECT q.vec_id, d.vec_id AS neighbour, round(list_cosine_similarity(q.v, d.v), 12) AS s FROM vectors q JOIN vectors d ON q.vec_id % 200 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
  SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS INTEGER) AS rank, neighbour, round(s, 4) AS similarity FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""

_NOISY = r"""
noisy AS (
  SELECT doc_id, '  ' || text || CASE doc_id % 5
    WHEN 0 THEN ' ' || chr(9) || '  see https://example.org/a?b=1 now ' || repeat(chr(10), 4)
    WHEN 1 THEN chr(1) || 'x' || chr(7) || ' ' || chr(8203) || 'zero' || chr(173) || ' '
    WHEN 2 THEN ' www.example.org/x ' || chr(9) || '[ref]' ELSE '' END AS text
  FROM documents
)"""
_SPACES = r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_CONTROLS = r"regexp_replace({}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
_ZERO = "translate({}, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), '')"
_URLS = r"regexp_replace(regexp_replace({}, 'https?://[^\s<>\"'']+', '', 'g'), 'www\.[^\s<>\"'']+', '', 'g')"


def _noise(expression: str, where: str = "true") -> str:
    return f"WITH {_NOISY}, done AS (SELECT doc_id, {expression} AS t FROM noisy) SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM done WHERE {where}"


ORACLE["noise_whitespace"] = _noise(_SPACES.format("text"))
ORACLE["noise_control"] = _noise(_CONTROLS.format("text"))
ORACLE["noise_zero_width"] = f"WITH {_NOISY} SELECT doc_id, sha256({_ZERO.format('text')}) AS text_sha256 FROM noisy"
ORACLE["noise_urls"] = _noise(_URLS.format("text"))
ORACLE["noise_custom"] = _noise(r"regexp_replace(regexp_replace(text, '\[ref\]', '', 'g'), '[0-9]+', '', 'g')")
ORACLE["noise_full"] = _noise(_URLS.format(_SPACES.format(_CONTROLS.format(_ZERO.format("nfc_normalize(text)")))))
ORACLE["length_filter"] = _noise("text", "length(t) BETWEEN 500 AND 3000")
ORACLE["noise_metrics"] = f"""
WITH {_NOISY}, done AS (SELECT text, {_SPACES.format(_CONTROLS.format("text"))} AS t FROM noisy)
SELECT CAST(count(*) FILTER (WHERE text LIKE '%<%' AND text LIKE '%>%' AND regexp_matches(text, '<[a-zA-Z/!?]|&[a-zA-Z#]')) AS BIGINT) AS html_stripped, count(*) FILTER (WHERE length(t) < 500) AS rows_removed_by_length,
       floor(avg(abs(length(text) - length(t))) * 100 + 0.5) / 100 AS chars_cleaned_per_row_avg FROM done
"""
ORACLE["noise_strip_html_jvm"] = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM (
  SELECT page_id, CASE WHEN html LIKE '%<%' AND html LIKE '%>%' THEN replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<template\b.*?</template\s*>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') ELSE html END AS t FROM pages)
"""
ORACLE["noise_unicode_nfc"] = "SELECT doc_id, sha256(nfc_normalize(text)) AS text_sha256 FROM documents"
ORACLE["direct_file_url"] = r"SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\.([^./]+)$', 1)) IN ('csv','tsv','json','jsonl','parquet','xlsx','xls','txt','md','pdf','html','docx','zip') AS is_file FROM pages"

_PERSONAL = """
personal AS (
  SELECT doc_id, text || CASE doc_id % 10 WHEN 0 THEN ' 123-45-6789 ' WHEN 1 THEN ' see http://example.org/p?q=1 ' WHEN 2 THEN ' 4111 1111 1111 1111 a.b@example.com ' ELSE '' END AS text FROM documents
)"""
_ENTITIES = {
    "EMAIL": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "SSN": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "URL": r"(?i)https?://[^\s<>\"'']+|www\.[^\s<>\"'']+",
}


def _redacted(entities: list[str], mark: str) -> str:
    t = "text"
    for e in entities:
        t = f"regexp_replace({t}, '{_ENTITIES[e]}', '{mark.format(e)}', 'g')"
    return t


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{e}' END" for e, p in _ENTITIES.items()) + "], lambda x: x IS NOT NULL)"
ORACLE["pii_redact"] = f"WITH {_PERSONAL} SELECT doc_id, sha256({_redacted(list(_ENTITIES), '[REDACTED]')}) AS text_sha256 FROM personal"
ORACLE["pii_redact_by_type"] = f"WITH {_PERSONAL} SELECT doc_id, sha256({_redacted(['EMAIL', 'CREDIT_CARD', 'URL'], '<{}>')}) AS text_sha256 FROM personal"
ORACLE["pii_flag"] = f"WITH {_PERSONAL}, f AS (SELECT doc_id, array_to_string({_FOUND}, ',') AS e FROM personal) SELECT doc_id, e <> '' AS pii_detected, e AS pii_entities FROM f"
ORACLE["pii_remove_row"] = f"WITH {_PERSONAL} SELECT doc_id FROM personal WHERE len({_FOUND}) = 0"


def _chain() -> str:
    names, now = list(_ENTITIES), "personal"
    out = []
    for k, e in enumerate(names):
        out.append(f"c{k} AS (SELECT *, len(regexp_extract_all(text, '{_ENTITIES[e]}')) AS n{k} FROM {now})")
        out.append(f"r{k} AS (SELECT * REPLACE (regexp_replace(text, '{_ENTITIES[e]}', '[REDACTED]', 'g') AS text) FROM c{k})")
        now = f"r{k}"
    total = " + ".join(f"n{k}" for k in range(len(names)))
    each = ", ".join(f"CAST(sum(n{k}) AS BIGINT) AS {e.lower()}_count" for k, e in enumerate(names))
    return f"WITH {_PERSONAL}, {', '.join(out)} SELECT count(*) FILTER (WHERE {total} > 0) AS rows_with_pii, CAST(sum({total}) AS BIGINT) AS total_pii_instances, {each} FROM {now}"


ORACLE["pii_entity_counts"] = _chain()

_WORDS = {
    "de": "'der','die','und','das','ist','nicht','ein','den','mit','von','auf','zu'",
    "en": "'the','and','of','to','is','that','for','with','are','this','was','it'",
    "es": "'el','los','las','que','y','por','con','una','del','para','se','como'",
    "fr": "'le','les','et','des','est','dans','qui','du','une','pour','sur','avec'",
}
_TAGGED = (
    "tagged AS (SELECT doc_id, t, CASE WHEN length(t) >= 20 AND b > 0 THEN CASE " + " ".join(f"WHEN {k} = b THEN '{k}'" for k in _WORDS) + " END ELSE 'unknown' END AS language, CASE WHEN length(t) >= 20 AND b > 0 THEN b / (de + en + es + fr) ELSE 0.0 END AS language_confidence FROM ("
    "SELECT *, greatest(de, en, es, fr) AS b FROM (SELECT doc_id, t, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({v}))) AS {k}" for k, v in _WORDS.items()) + r" FROM (SELECT doc_id, text AS t, regexp_split_to_array(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+') AS w FROM documents))))"
)
ORACLE["lang_tag"] = f"WITH {_TAGGED} SELECT doc_id, language, round(language_confidence, 4) AS language_confidence FROM tagged"
ORACLE["lang_distribution"] = f"WITH {_TAGGED} SELECT language, count(*) AS rows FROM tagged GROUP BY language"
_TEXTS = ", ".join(f"('{name}', '{t.replace(chr(39), chr(39) * 2)}')" for name, t in TEXTS.items())


def _letters(c: str) -> str:
    c = rf"lower(regexp_replace(' ' || {c} || ' ', '[^\p{{L}}\p{{M}}]+', ' ', 'g'))"
    for script, one in (("Han", "一"), ("Hangul", "가"), ("Hiragana", "あ"), ("Katakana", "ア")):
        c = rf"regexp_replace({c}, '\p{{{script}}}', '{one}', 'g')"
    return c


# the statistics are counted from the same sentences here, by SQL
_BY_LETTERS = rf"""
samples(language, sentences) AS (VALUES {_TEXTS}),
plain AS (SELECT language, {_letters('sentences')} AS t FROM samples),
runs AS (SELECT language, substr(t, k, n) AS run FROM (SELECT language, t, unnest(range(1, length(t) + 1)) AS k FROM plain), range(1, 4) r(n) WHERE k + n - 1 <= length(t)),
seen AS (SELECT language, run, count(*) AS c FROM runs WHERE run <> ' ' GROUP BY language, run),
totals AS (SELECT language, sum(c) + 0.5 * (SELECT count(DISTINCT run) FROM seen) AS n FROM seen GROUP BY language),
model AS (
  SELECT v.run, t.language, CAST(floor(1000 * ln((coalesce(s.c, 0) + 0.5) / t.n)) AS BIGINT) AS score
  FROM (SELECT DISTINCT run FROM seen) v CROSS JOIN totals t LEFT JOIN seen s ON s.run = v.run AND s.language = t.language
), docs AS (
  SELECT doc_id, text, CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 20 THEN {_letters('text')} ELSE '' END AS t FROM documents
), characters AS (
  SELECT doc_id, unnest(c) AS x, unnest(c[2:]) AS y, unnest(c[3:]) AS z FROM (SELECT doc_id, string_split(t, '') AS c FROM docs WHERE t <> '')
), said AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, x AS run FROM characters UNION ALL SELECT doc_id, x || y FROM characters WHERE y IS NOT NULL UNION ALL SELECT doc_id, x || y || z FROM characters WHERE z IS NOT NULL
  ) GROUP BY doc_id, run
), scored AS (
  SELECT doc_id, language, sum(c * score) AS s FROM said JOIN model USING (run) GROUP BY doc_id, language
), best AS (
  SELECT doc_id, max(s) AS s, 1 / sum(exp((s - m) / 1000.0)) AS share FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM scored) GROUP BY doc_id
), named AS (
  SELECT d.doc_id, CASE WHEN length(d.t) > 1 THEN coalesce((SELECT min(language) FROM scored x WHERE x.doc_id = d.doc_id AND x.s = b.s), 'ar') ELSE 'unknown' END AS language,
         CASE WHEN length(d.t) > 1 THEN coalesce(b.share, 1.0 / (SELECT count(*) FROM totals)) ELSE 0.0 END AS confidence
  FROM docs d LEFT JOIN best b ON b.doc_id = d.doc_id
)"""
ORACLE["lang_letters_tag"] = f"WITH {_BY_LETTERS} SELECT doc_id, language, round(confidence, 4) AS language_confidence FROM named"
ORACLE["lang_letters_distribution"] = f"WITH {_BY_LETTERS} SELECT language, count(*) AS rows FROM named GROUP BY language"
ORACLE["lang_letters_keep"] = f"WITH {_BY_LETTERS} SELECT doc_id, language FROM named WHERE language IN ('fr', 'es')"
ORACLE["lang_keep_en"] = f"WITH {_TAGGED} SELECT doc_id FROM tagged WHERE language = 'en'"
ORACLE["lang_remove_en"] = f"WITH {_TAGGED} SELECT doc_id FROM tagged WHERE language <> 'en'"


def _scored(source: str) -> str:
    return rf"""
parts AS (
  SELECT doc_id, text, length(text) AS n, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w,
         list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s,
         len(regexp_extract_all(text, '\p{{L}}')) AS a, len(regexp_extract_all(text, '\p{{Lu}}')) AS u
  FROM {source}
), repeats AS (
  SELECT doc_id, max(k) AS m FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(s) AS x FROM parts) GROUP BY doc_id, x) GROUP BY doc_id
), figures AS (
  SELECT p.*, len(w) AS nw, len(list_distinct(w)) / len(w)::DOUBLE AS r, len(s) AS ns, coalesce(m, 0) AS m, a / n::DOUBLE AS sa, u / a::DOUBLE AS su FROM parts p LEFT JOIN repeats USING (doc_id)
), scored AS (
  SELECT doc_id, text, floor(greatest(0.0, least(10.0, (
    1.5 * CASE WHEN n < 10 THEN 1 WHEN n < 50 THEN 4 WHEN n <= 5000 THEN 10 WHEN n <= 20000 THEN 7 ELSE 4 END
    + 2.0 * CASE WHEN nw = 0 THEN 1.0 ELSE least(10.0, r * 12) END
    + 2.0 * CASE WHEN ns <= 1 THEN 7.0 WHEN m > 2 THEN greatest(1.0, 10.0 - 2.0 * (m - 1)) ELSE 10.0 END
    + 1.0 * CASE WHEN sa > 0.6 THEN 10 WHEN sa > 0.4 THEN 7 ELSE 3 END
    + 0.5 * CASE WHEN a = 0 THEN 5 WHEN su BETWEEN 0.02 AND 0.15 THEN 10 WHEN su > 0.5 THEN 3 ELSE 7 END)::DOUBLE / 7.0)) * 100 + 0.5) / 100 AS quality_score,
    concat_ws('; ', CASE WHEN n < 10 THEN 'Very short' WHEN n < 50 THEN 'Short' WHEN n <= 5000 THEN NULL WHEN n <= 20000 THEN 'Long' ELSE 'Very long' END,
      CASE WHEN r < 0.3 THEN 'Low vocabulary diversity' END, CASE WHEN ns > 1 AND m > 2 THEN 'Repeated sentences (' || m || 'x)' END,
      CASE WHEN sa <= 0.4 THEN 'High special char ratio' END, CASE WHEN a > 0 AND su > 0.5 THEN 'Excessive caps' END) AS why
  FROM figures
)"""


_SCORED = _scored("documents")
ORACLE["quality_score"] = f"WITH {_SCORED} SELECT doc_id, quality_score, CASE WHEN why = '' THEN 'Good quality' ELSE why END AS quality_reason FROM scored"
ORACLE["quality_filter"] = f"WITH {_SCORED} SELECT doc_id, quality_score FROM scored WHERE quality_score >= 9.0"
ORACLE["quality_flag"] = f"WITH {_SCORED} SELECT doc_id, quality_score < 9.0 AS quality_flag FROM scored"
ORACLE["quality_distribution"] = f"WITH {_SCORED} SELECT count(*) FILTER (WHERE quality_score < 2) AS bin_0_2, count(*) FILTER (WHERE quality_score >= 2 AND quality_score < 4) AS bin_2_4, count(*) FILTER (WHERE quality_score >= 4 AND quality_score < 6) AS bin_4_6, count(*) FILTER (WHERE quality_score >= 6 AND quality_score < 8) AS bin_6_8, count(*) FILTER (WHERE quality_score >= 8) AS bin_8_10 FROM scored"
ORACLE["quality_summary"] = f"WITH {_SCORED} SELECT floor(avg(quality_score) * 100 + 0.5) / 100 AS mean_quality_score, list_sort(list(quality_score))[count(*) // 2 + 1] AS median_quality_score FROM scored"

_PAIRS = "pairs AS (SELECT conv_id, CASE WHEN count(*) >= 2 THEN coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') ELSE '' END AS i, CASE WHEN count(*) >= 2 THEN coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') ELSE '' END AS o FROM conversations GROUP BY conv_id)"
ORACLE["ft_normalize_sharegpt"] = f"WITH {_PAIRS} SELECT conv_id, i AS instruction, '' AS input, o AS output FROM pairs"
for _name, _format in (("qa", "qa_pairs"), ("raw", "raw_pairs"), ("alpaca", "alpaca")):
    ORACLE[f"ft_normalize_{_name}"] = f"WITH {_PAIRS} SELECT conv_id, i AS instruction, '' AS input, o AS output, '{_format}' AS input_format FROM pairs"
_LINE = "chr(10)"
_TEMPLATES = {
    "llama3": f"'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || {_LINE} || 'Be brief.<|eot_id|><|start_header_id|>user<|end_header_id|>' || {_LINE} || i || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {_LINE} || o || '<|eot_id|>'",
    "llama2": "'<s>[INST] <<SYS>>Be brief.<</SYS>> ' || i || ' [/INST] ' || o || ' </s>'",
    "mistral": rf"'<s>[INST] ' || regexp_replace('Be brief.' || {_LINE} || {_LINE} || i, '^\s+|\s+$', '', 'g') || ' [/INST] ' || o || '</s>'",
    "gemma": f"'<start_of_turn>user' || {_LINE} || 'Be brief.' || {_LINE} || {_LINE} || i || '<end_of_turn>' || {_LINE} || '<start_of_turn>model' || {_LINE} || o || '<end_of_turn>'",
    "alpaca": """'{"instruction":' || to_json(i) || ',"input":"","output":' || to_json(o) || '}'""",
    "sharegpt": """'{"conversations":[{"from":"human","value":' || to_json(i) || '},{"from":"gpt","value":' || to_json(o) || '}]}'""",
    "openai": """'{"messages":[{"role":"system","content":"Be brief."},{"role":"user","content":' || to_json(i) || '},{"role":"assistant","content":' || to_json(o) || '}]}'""",
}
for _name, _expression in _TEMPLATES.items():
    ORACLE[f"ft_format_{_name}"] = f"WITH {_PAIRS} SELECT conv_id, {_expression} AS formatted_text FROM pairs"
_PLAIN = f"'<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || {_LINE} || i || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {_LINE} || o || '<|eot_id|>'"
_TOKENS = rf"{_PAIRS}, tokens AS (SELECT conv_id, {_PLAIN} AS formatted_text, len(regexp_extract_all({_PLAIN}, '\p{{L}}{{1,5}}|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]')) AS t FROM pairs)"
ORACLE["ft_token_filter"] = f"WITH {_TOKENS} SELECT conv_id, t AS token_count FROM tokens WHERE t <= 300"
ORACLE["ft_token_distribution"] = f"WITH {_TOKENS} SELECT round(avg(t), 4) AS avg_token_count, max(t) AS max_token_count, min(t) AS min_token_count, count(*) FILTER (WHERE t <= 512) AS le_512, count(*) FILTER (WHERE t > 512 AND t <= 1024) AS le_1024, count(*) FILTER (WHERE t > 1024 AND t <= 2048) AS le_2048, count(*) FILTER (WHERE t > 2048 AND t <= 4096) AS le_4096, count(*) FILTER (WHERE t > 4096) AS gt_4096 FROM tokens WHERE t <= 4096"
ORACLE["training_config"] = f"WITH {_TOKENS} SELECT count(*) AS total, round(avg(t), 4) AS avg_tokens, CAST(CASE WHEN count(*) > 5000 THEN 3 WHEN count(*) > 1000 THEN 5 ELSE 10 END AS BIGINT) AS epochs, round(count(*) * avg(t) * 3 / 5000 / 3600, 6) AS hours, 'meta-llama/Meta-Llama-3-8B' AS base_model FROM tokens WHERE t <= 4096"
_COUNT = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_RESPONSES = rf"""{_PAIRS}, rated AS (
  SELECT conv_id, {_COUNT.format("i")} < 3 AS a, {_COUNT.format("o")} < 10 AS b, {_COUNT.format("o")} > 2000 AS c,
    regexp_matches(o, '(?i)I cannot|I can not|I''m unable|I am unable|As an AI|As a language model|I don''t have the ability|I am an AI|I''m sorry, but|I apologize, but|is not appropriate') AS d,
    o <> '' AND NOT regexp_matches(o, '[.!?"''”’\]}}>]\s*$') AS e FROM pairs
), responses AS (
  SELECT conv_id, greatest(0.0, 10.0 - CASE WHEN a THEN 5 ELSE 0 END - CASE WHEN b THEN 5 ELSE 0 END - CASE WHEN c THEN 2 ELSE 0 END - CASE WHEN d THEN 8 ELSE 0 END - CASE WHEN e THEN 3 ELSE 0 END)::DOUBLE AS score,
    concat_ws(',', CASE WHEN a THEN 'instruction_too_short' END, CASE WHEN b THEN 'response_too_short' END, CASE WHEN c THEN 'response_too_long' END, CASE WHEN d THEN 'refusal_detected' END, CASE WHEN e THEN 'incomplete_response' END) AS reasons FROM rated
)"""
ORACLE["response_quality_score"] = f"WITH {_RESPONSES} SELECT conv_id, score, reasons FROM responses"
ORACLE["response_quality_filter"] = f"WITH {_RESPONSES} SELECT conv_id FROM responses WHERE score >= 6"

_RANKED = "ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)"
ORACLE["balance_under"] = f"WITH {_RANKED} SELECT doc_id, lang FROM ranked WHERE r <= (SELECT min(n) FROM ranked)"
ORACLE["balance_ratio"] = f"WITH {_RANKED} SELECT doc_id, lang FROM ranked WHERE r <= greatest(1, floor((SELECT min(n) FROM ranked) / 0.5))"
ORACLE["balance_over"] = f"""WITH {_RANKED}, sizes AS (SELECT DISTINCT lang, n, (SELECT max(n) FROM ranked) AS t FROM ranked),
slots AS (SELECT lang, n, unnest(range(1, t - n + 1)) AS s FROM sizes),
drawn AS (SELECT lang, CAST('0x' || substr(sha256('42|' || lang || '|' || s), 1, 15) AS BIGINT) % n + 1 AS r FROM slots)
SELECT doc_id, lang FROM ranked UNION ALL SELECT k.doc_id, k.lang FROM drawn d JOIN ranked k ON k.lang = d.lang AND k.r = d.r"""
ORACLE["train_val_split"] = "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= ceil(n * 0.1 - 1e-9) THEN 'val' ELSE 'train' END AS split FROM x WHERE r <= ceil(n * 0.1 - 1e-9) + floor(n * 0.9 + 1e-9)"
ORACLE["stratified_split"] = """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS n, ceil(sum(n) * 0.1 - 1e-9) AS v FROM c),
f AS (SELECT c.lang, c.n, floor(t.v * c.n / t.n) AS lo, t.v * c.n / t.n - floor(t.v * c.n / t.n) AS rest, t.v FROM c, t),
g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS k, v - sum(lo) OVER () AS more FROM f),
h AS (SELECT lang, n, CAST(lo + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS v FROM g)
SELECT lang, 'val' AS split, v AS rows FROM h WHERE v > 0 UNION ALL SELECT lang, 'train', n - v FROM h
"""
ORACLE["analyze_issues"] = f"""
WITH {_PERSONAL}, r AS (SELECT count(*) AS n, (count(*) - count(DISTINCT text)) / count(*)::DOUBLE AS d, count(*) FILTER (WHERE len({_FOUND}) > 0) / count(*)::DOUBLE AS p, count(*) FILTER (WHERE length(text) < 10) / count(*)::DOUBLE AS s FROM personal)
SELECT CASE WHEN d > 0.1 THEN 'high' ELSE 'medium' END AS severity, 'duplicates' AS type, CAST(floor(n * d + 1e-9) AS BIGINT) AS affected_rows FROM r WHERE d > 0.01
UNION ALL SELECT CASE WHEN p > 0.05 THEN 'high' ELSE 'medium' END, 'pii_detected', CAST(floor(n * p + 1e-9) AS BIGINT) FROM r WHERE p > 0
UNION ALL SELECT 'medium', 'low_quality', CAST(floor(n * s + 1e-9) AS BIGINT) FROM r WHERE s > 0.2
"""
ORACLE["insight_report"] = "SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS rows_removed, CASE WHEN count(*) - count(DISTINCT text) > count(*) * 0.5 THEN 6.5::DOUBLE ELSE 8.5::DOUBLE END AS readiness_score, CASE WHEN count(*) - count(DISTINCT text) > count(*) * 0.5 THEN 'Needs Work' ELSE 'Good' END AS readiness_label FROM documents"
ORACLE["catalog_page"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 5 OFFSET 2"
ORACLE["catalog_counts"] = "SELECT o_custkey, count(*) AS records FROM orders GROUP BY o_custkey"
ORACLE["jobs_recent"] = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS started_on FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50"
ORACLE["pipeline_common_e2e"] = f"""
WITH {_PERSONAL}, kept AS (SELECT * FROM personal WHERE doc_id IN (SELECT min(doc_id) FROM personal GROUP BY text)),
clean AS (SELECT doc_id, {_SPACES.format(_CONTROLS.format(_ZERO.format("nfc_normalize(text)")))} AS text FROM kept),
safe AS (SELECT doc_id, {_redacted(list(_ENTITIES), '[REDACTED]')} AS text FROM clean), {_scored("safe")}
SELECT doc_id, sha256(text) AS text_sha256, quality_score FROM scored WHERE quality_score >= 8.0
"""
ORACLE["pipeline_finetune_e2e"] = f"""
WITH {_TOKENS}, {_RESPONSES.removeprefix(_PAIRS + ", ")},
good AS (SELECT t.* FROM tokens t JOIN responses USING (conv_id) WHERE t.t <= 4096 AND score >= 6),
x AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM good)
SELECT conv_id, formatted_text, t AS token_count, CASE WHEN r <= ceil(n * 0.1 - 1e-9) THEN 'val' ELSE 'train' END AS split FROM x WHERE r <= ceil(n * 0.1 - 1e-9) + floor(n * 0.9 + 1e-9)
"""

_BACK = "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents"
ORACLE["parquet_round_trip"] = _BACK
ORACLE["jsonl_round_trip"] = _BACK
ORACLE["csv_round_trip"] = r"SELECT doc_id, lang, source, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS n_chars FROM documents"
ORACLE["csv_split_round_trip"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation"
ORACLE["text_lines"] = "SELECT row_number() OVER (ORDER BY n_nationkey) AS line_number, n_name AS text FROM nation"
ORACLE["ingest_documents"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")"
ORACLE["dedup_missing_columns"] = "SELECT lang, source, sha256(text) AS text_sha256 FROM (SELECT DISTINCT text, lang, source FROM documents)"
ORACLE["dedup_vector_fallback"] = "SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY text"
ORACLE["sample_values"] = "SELECT row_number() OVER (ORDER BY doc_id) AS place, lang AS value FROM documents WHERE lang IS NOT NULL QUALIFY place <= 5"
ORACLE["auto_category"] = """
WITH n AS (SELECT 1 AS place, 'text' AS category, count(DISTINCT text) AS n FROM documents UNION ALL SELECT 2, 'lang', count(DISTINCT lang) FROM documents UNION ALL SELECT 3, 'source', count(DISTINCT source) FROM documents)
SELECT category FROM n WHERE n BETWEEN 2 AND 50 ORDER BY n, place LIMIT 1
"""

ORACLE["csv_whole_texts"] = ORACLE["tsv_whole_texts"] = ORACLE["json_array_round_trip"] = _BACK
ORACLE["balance_distribution"] = "WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT lang, n AS rows_before, (SELECT min(n) FROM c) AS rows_after FROM c"
ORACLE["augmented_rows"] = "SELECT false AS is_synthetic, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents UNION ALL SELECT true, count(*), CAST(sum(length(text) + 1) AS BIGINT) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL"
ORACLE["longest_columns"] = """
WITH n AS (SELECT 'text' AS "column", avg(length(coalesce(text, ''))) AS n FROM documents UNION ALL SELECT 'lang', avg(length(coalesce(lang, ''))) FROM documents UNION ALL SELECT 'source', avg(length(coalesce(source, ''))) FROM documents)
SELECT row_number() OVER (ORDER BY n DESC) AS place, "column" FROM n
"""
ORACLE["skipped_steps"] = "WITH documents AS (SELECT * FROM main.documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1), " + _TAGGED + " SELECT language, count(*) AS rows, CAST(4 AS BIGINT) AS steps_executed, CAST(2 AS BIGINT) AS steps_skipped FROM tagged GROUP BY language"
