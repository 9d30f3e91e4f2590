"""DuckDB twins of the registered queries (the correctness oracle).

DuckDB's ``\\w``/``\\b`` are ASCII-only, so word classes are spelled out as
``[\\p{L}\\p{N}_]``.  Fixture CTEs mirror ``fixtures.py``.
"""

from __future__ import annotations

from rejoinder.constants import ANNOTATION_COL_MAPPING

W = r"[\p{L}\p{N}_]"
SIMPLE_TOKEN = f"{W}+(?:''{W}+)?"
WORD_OR_PUNCT = f"{W}+(?:''{W}+)?|[^\\p{{L}}\\p{{N}}_\\s]"

RESPONSES = """responses AS (
  SELECT doc_id AS row_id, doc_id // 3 AS message_id, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model,
         lang AS theme, text AS response FROM documents)"""

BASE = """base AS (
  SELECT row_id, message_id, model, theme, trim(response, ' "') AS text FROM responses
  WHERE response IS NOT NULL)"""

CORPUS = """corpus AS (
  SELECT theme, model, row_id, text FROM base
  UNION ALL
  SELECT theme, 'random' AS model,
         arg_min(row_id, md5('42:' || CAST(row_id AS VARCHAR))) AS row_id,
         arg_min(text, md5('42:' || CAST(row_id AS VARCHAR))) AS text
  FROM base WHERE message_id IS NOT NULL GROUP BY theme, message_id)"""

CORPUS_NO_RANDOM = """corpus AS (SELECT theme, model, row_id, text FROM base)"""

TOKS = r"""toks AS (
  SELECT theme, model, row_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t
  FROM corpus)"""

SENTS = r"""sents AS (
  SELECT theme, model, row_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS sent_no
  FROM (SELECT theme, model, row_id,
               list_filter(string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)),
                           lambda s: regexp_matches(s, '\S')) AS ss FROM corpus))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _ratio(num: str, den: str) -> str:
    return f"coalesce(round(CAST({num} AS DOUBLE) / nullif({den}, 0), 6), 0.0)"


ORACLE: dict[str, str] = {}

ORACLE["distinct_ngrams"] = _with(RESPONSES, BASE, CORPUS, TOKS, """g AS (
  SELECT theme, model, 1 AS n, unnest(t) AS gram FROM toks
  UNION ALL
  SELECT theme, model, 2 AS n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks),
d AS (SELECT theme, model, n, count(DISTINCT gram) AS u, count(*) AS tot FROM g GROUP BY theme, model, n)""") + f"""
SELECT c.theme, c.model,
  coalesce((SELECT {_ratio('u', 'tot')} FROM d WHERE d.theme = c.theme AND d.model = c.model AND n = 1), 0.0) AS corpus_distinct_1grams,
  coalesce((SELECT {_ratio('u', 'tot')} FROM d WHERE d.theme = c.theme AND d.model = c.model AND n = 2), 0.0) AS corpus_distinct_2grams
FROM (SELECT DISTINCT theme, model FROM corpus) c"""

ORACLE["response_distinct2"] = _with(RESPONSES, BASE, CORPUS, TOKS, """ng AS (
  SELECT theme, model, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM toks)""") + """
SELECT theme, model,
  round(avg(CASE WHEN len(g) > 0 THEN len(list_distinct(g)) / len(g) ELSE 0.0 END), 6) AS response_distinct_2grams_mean,
  round(stddev_pop(CASE WHEN len(g) > 0 THEN len(list_distinct(g)) / len(g) ELSE 0.0 END), 6) AS response_distinct_2grams_std
FROM ng GROUP BY theme, model"""

ORACLE["text_length"] = _with(RESPONSES, BASE, CORPUS) + """
SELECT theme, model, round(avg(length(text)), 6) AS mean_text_length, count(*) AS n_texts
FROM corpus GROUP BY theme, model"""

_STARTS = f"""starts AS (
  SELECT theme, model, row_id, sent_no,
         list_slice(regexp_extract_all(sentence, '{SIMPLE_TOKEN}'), 1, 3) AS st,
         regexp_extract_all(sentence, '{SIMPLE_TOKEN}') AS words
  FROM sents)"""

ORACLE["sentence_starts"] = _with(RESPONSES, BASE, CORPUS_NO_RANDOM, SENTS, _STARTS) + """
SELECT theme, model, row_id, sent_no, array_to_string(st, ' ') AS start_text FROM starts"""

ORACLE["distinct_sentence_starts"] = _with(RESPONSES, BASE, CORPUS, SENTS, _STARTS) + f"""
SELECT c.theme, c.model,
  coalesce((SELECT {_ratio('count(DISTINCT array_to_string(list_slice(st, 1, 2), chr(32)))', 'count(*)')}
            FROM starts s WHERE s.theme = c.theme AND s.model = c.model AND len(st) >= 2), 0.0)
    AS distinct_2_of_3word_sentence_starts,
  coalesce((SELECT {_ratio('count(DISTINCT array_to_string(st, chr(32)))', 'count(*)')}
            FROM starts s WHERE s.theme = c.theme AND s.model = c.model AND len(st) >= 3), 0.0)
    AS distinct_3_of_3word_sentence_starts
FROM (SELECT DISTINCT theme, model FROM corpus) c"""


def _top(value_expr: str, col: str) -> str:
    return _with(RESPONSES, BASE, CORPUS, SENTS, _STARTS) + f"""
SELECT theme, model, rank, {col}, cnt FROM (
  SELECT theme, model, {col}, cnt,
         row_number() OVER (PARTITION BY theme, model ORDER BY cnt DESC, {col} ASC) AS rank
  FROM (SELECT theme, model, {value_expr} AS {col}, count(*) AS cnt FROM starts GROUP BY ALL))
WHERE rank <= 10"""


ORACLE["top_sentence_starts"] = _top("array_to_string(st, ' ')", "start_text")
ORACLE["top_sentences"] = _top("array_to_string(words, ' ')", "sentence")

ORACLE["sentence_shape"] = _with(RESPONSES, BASE, CORPUS, SENTS) + f"""
, tk AS (SELECT theme, model, regexp_extract_all(sentence, '{WORD_OR_PUNCT}') AS t FROM sents)
SELECT theme, model,
  round(avg(len(t)), 6) AS mean_sentence_length,
  {_ratio("sum(len(list_filter(t, lambda x: x LIKE '%?')))", 'sum(len(t))')} AS pct_questions,
  {_ratio("sum(len(list_filter(t, lambda x: x LIKE '%!')))", 'sum(len(t))')} AS pct_exclamations,
  {_ratio("count_if(t[-1] LIKE '%?')", 'count(*)')} AS pct_question_sentences,
  {_ratio("count_if(t[-1] LIKE '%!')", 'count(*)')} AS pct_exclamation_sentences
FROM tk GROUP BY theme, model"""

# Self-BLEU written directly as leave-one-out windows (EXCLUDE CURRENT ROW) and a
# brute-force closest-length search — an independent formulation of the same metric.
ORACLE["self_bleu"] = _with(RESPONSES, BASE, CORPUS, TOKS, """lens AS (SELECT theme, model, row_id, len(t) AS L FROM toks),
grams AS (
  SELECT theme, model, row_id, n, gram, count(*) AS c FROM (
    SELECT theme, model, row_id, 1 AS n, unnest(t) AS gram FROM toks
    UNION ALL SELECT theme, model, row_id, 2, unnest(list_transform(range(1, len(t) - 0), lambda i: t[i] || ' ' || t[i + 1])) FROM toks
    UNION ALL SELECT theme, model, row_id, 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM toks
    UNION ALL SELECT theme, model, row_id, 4, unnest(list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3])) FROM toks
  ) GROUP BY ALL),
loo AS (
  SELECT theme, model, row_id, n, c,
         coalesce(max(c) OVER (PARTITION BY theme, model, n, gram ORDER BY row_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS mo
  FROM grams),
pd AS (
  SELECT theme, model, row_id,
    sum(CASE WHEN n = 1 THEN least(c, mo) ELSE 0 END) AS num1, sum(CASE WHEN n = 1 THEN c ELSE 0 END) AS tot1,
    sum(CASE WHEN n = 2 THEN least(c, mo) ELSE 0 END) AS num2, sum(CASE WHEN n = 2 THEN c ELSE 0 END) AS tot2,
    sum(CASE WHEN n = 3 THEN least(c, mo) ELSE 0 END) AS num3, sum(CASE WHEN n = 3 THEN c ELSE 0 END) AS tot3,
    sum(CASE WHEN n = 4 THEN least(c, mo) ELSE 0 END) AS num4, sum(CASE WHEN n = 4 THEN c ELSE 0 END) AS tot4
  FROM loo GROUP BY ALL),
ref AS (
  SELECT a.theme, a.model, a.row_id, a.L,
         min({'d': abs(b.L - a.L), 'l': b.L}).l AS r
  FROM lens a JOIN lens b ON a.theme = b.theme AND a.model = b.model AND a.row_id <> b.row_id
  GROUP BY ALL),
sc AS (
  SELECT l.theme, l.model, l.row_id,
    CASE WHEN r.r IS NULL THEN NULL
         WHEN coalesce(pd.num1, 0) = 0 THEN 0.0
         ELSE (CASE WHEN l.L > r.r THEN 1.0 WHEN l.L = 0 THEN 0.0 ELSE exp(1 - r.r / l.L) END) *
              exp(0.25 * ln(CASE WHEN pd.num1 = 0 THEN 0.1 ELSE pd.num1 END / greatest(pd.tot1, 1))
                + 0.25 * ln(CASE WHEN pd.num2 = 0 THEN 0.1 ELSE pd.num2 END / greatest(pd.tot2, 1))
                + 0.25 * ln(CASE WHEN pd.num3 = 0 THEN 0.1 ELSE pd.num3 END / greatest(pd.tot3, 1))
                + 0.25 * ln(CASE WHEN pd.num4 = 0 THEN 0.1 ELSE pd.num4 END / greatest(pd.tot4, 1)))
    END AS b
  FROM lens l LEFT JOIN ref r USING (theme, model, row_id) LEFT JOIN pd USING (theme, model, row_id))""") + """
SELECT theme, model, round(avg(b), 6) AS corpus_self_bleu_mean, round(stddev_pop(b), 6) AS corpus_self_bleu_std
FROM sc GROUP BY theme, model"""

# Max Jaccard by brute force over all pairs of the group.
ORACLE["jaccard_diversity"] = _with(RESPONSES, BASE, CORPUS, TOKS, """ds AS (SELECT theme, model, row_id, list_distinct(t) AS s FROM toks),
pj AS (
  SELECT a.theme, a.model, a.row_id,
         max(CASE WHEN len(a.s) + len(b.s) = 0 THEN 0.0 ELSE
             len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END) AS mj
  FROM ds a LEFT JOIN ds b ON a.theme = b.theme AND a.model = b.model AND a.row_id <> b.row_id
  GROUP BY ALL)""") + """
SELECT theme, model, round(avg(1 - mj), 6) AS corpus_jaccard_diversity_mean,
       round(stddev_pop(1 - mj), 6) AS corpus_jaccard_diversity_std
FROM pj GROUP BY theme, model"""

# --- fixtures (twins of fixtures.py) --------------------------------------------
TAGGED = """tagged AS (
  SELECT doc_id AS row_id, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, lang AS theme,
         CASE WHEN doc_id % 3 <> 0 THEN 'pre<XXX>' || text || '<XXX>post' ELSE text END AS model_output
  FROM documents)"""

PARSED = """parsed AS (
  SELECT *, CASE WHEN model_output IS NULL THEN NULL WHEN len(p) = 1 THEN model_output ELSE p[2] END AS model_counter_speech,
         CASE WHEN model_output IS NULL THEN NULL WHEN len(p) = 1 THEN '' ELSE p[1] || ' ' || array_to_string(p[3:], chr(10)) END
           AS model_strategies
  FROM (SELECT *, string_split(model_output, '<XXX>') AS p FROM tagged))"""

FLAGS = """flags AS (
  SELECT doc_id AS row_id,
    CASE WHEN doc_id % 10 = 1 THEN NULL WHEN (doc_id // 1) % 3 = 0 THEN -1 ELSE 1 END AS strategy_1,
    CASE WHEN doc_id % 10 = 2 THEN NULL WHEN (doc_id // 2) % 3 = 0 THEN -1 ELSE 1 END AS strategy_2,
    CASE WHEN doc_id % 10 = 3 THEN NULL WHEN (doc_id // 3) % 3 = 0 THEN -1 ELSE 1 END AS strategy_3,
    CASE WHEN doc_id % 10 = 4 THEN NULL WHEN (doc_id // 4) % 3 = 0 THEN -1 ELSE 1 END AS strategy_4,
    CAST((doc_id // 2) % 5 AS VARCHAR) AS factual, CAST((doc_id // 3) % 5 AS VARCHAR) AS alternative,
    CAST((doc_id // 4) % 5 AS VARCHAR) AS narrative, CAST((doc_id // 5) % 5 AS VARCHAR) AS critical_thinking,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 2 AS INTEGER) END AS step_2
  FROM documents)"""

OUTPUTS = """outputs AS (
  SELECT p.row_id, p.model, p.theme, p.model_output, p.model_counter_speech, p.model_strategies,
    CASE WHEN p.row_id % 5 = 0 THEN p.model_counter_speech || ' edited' ELSE p.model_counter_speech END
      AS model_counter_speech_corrected,
    CASE WHEN p.row_id % 4 = 0 THEN NULL WHEN p.row_id % 4 = 1 THEN '  "' ELSE p.model_strategies END
      AS model_strategies_corrected,
    f.strategy_1, f.strategy_2, f.strategy_3, f.strategy_4, f.factual, f.alternative, f.narrative,
    f.critical_thinking, f.step_2
  FROM parsed p JOIN flags f USING (row_id))"""

LOADED = """loaded AS (
  SELECT row_id, model, trim(model_output, ' "') AS model_output,
         trim(model_counter_speech, ' "') AS cs, trim(model_counter_speech_corrected, ' "') AS csc,
         trim(model_strategies_corrected, ' "') AS strat,
         strategy_1, strategy_2, strategy_3, strategy_4, step_2,
         CASE WHEN nullif(TRY_CAST(CASE WHEN factual = 'n/a' THEN NULL ELSE factual END AS DOUBLE), 0) IS NULL THEN -1.0 ELSE 1.0 END AS sg1,
         CASE WHEN nullif(TRY_CAST(CASE WHEN alternative = 'n/a' THEN NULL ELSE alternative END AS DOUBLE), 0) IS NULL THEN -1.0 ELSE 1.0 END AS sg2,
         CASE WHEN nullif(TRY_CAST(CASE WHEN narrative = 'n/a' THEN NULL ELSE narrative END AS DOUBLE), 0) IS NULL THEN -1.0 ELSE 1.0 END AS sg3,
         CASE WHEN nullif(TRY_CAST(CASE WHEN critical_thinking = 'n/a' THEN NULL ELSE critical_thinking END AS DOUBLE), 0) IS NULL THEN -1.0 ELSE 1.0 END AS sg4
  FROM outputs)"""

PANEL = """panel AS (
  SELECT user_id AS subject, event_type AS model, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS v
  FROM events GROUP BY ALL),
panel_long AS (
  SELECT 'c_count' AS category, subject, model, CAST(nullif(n % 6, 0) AS DOUBLE) AS score FROM panel
  UNION ALL
  SELECT 'c_value' AS category, subject, model, CAST(nullif(v % 5, 0) AS DOUBLE) AS score FROM panel)"""

PREDICTIONS = """predictions AS (
  SELECT doc_id AS row_id, 'm' || CAST(k AS VARCHAR) AS model, CAST(toxic AS DOUBLE) AS y_true,
         CAST(CASE WHEN doc_id % (k + 5) = 0 THEN 1 - toxic ELSE toxic END AS DOUBLE) AS y_pred
  FROM labels, (SELECT unnest([0, 1, 2]) AS k))"""

OVERLAYS = """lab AS (
  SELECT doc_id AS row_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic,
         CAST(quality AS VARCHAR) || '-' || CAST(toxic AS VARCHAR) AS hate_speech_id FROM labels),
ov AS (
  SELECT 0 AS prio, row_id, quality, CASE WHEN row_id % 2 = 0 THEN NULL ELSE toxic END AS toxic, hate_speech_id
  FROM lab WHERE row_id % 7 = 0
  UNION ALL
  SELECT 1, row_id, CASE WHEN row_id % 5 = 0 THEN NULL ELSE quality END, toxic, hate_speech_id
  FROM lab WHERE row_id % 7 BETWEEN 1 AND 3
  UNION ALL
  SELECT 2, row_id, quality, toxic, CASE WHEN row_id % 4 = 0 THEN NULL ELSE hate_speech_id END
  FROM lab WHERE row_id % 7 >= 4 OR (row_id % 7 = 0 AND row_id % 3 = 0))"""

# erfc(x): Taylor series below 3, continued fraction above — same algorithm as special.py
def _erfc(x: str) -> str:
    ax = f"abs({x})"
    taylor = (f"(1.0 - 2.0 / sqrt(pi()) * list_sum(list_transform(range(0, 81), lambda n: "
              f"(CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END) * pow({ax}, 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1)))))")
    frac = (f"(exp(-{ax} * {ax}) / (sqrt(pi()) * list_reduce(list_concat([{ax}], "
            f"list_transform(range(80, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda f, k: {ax} + (k / 2.0) / f)))")
    pos = f"(CASE WHEN {ax} < 3.0 THEN {taylor} ELSE {frac} END)"
    return f"(CASE WHEN ({x}) >= 0 THEN {pos} ELSE 2.0 - {pos} END)"


def _chi2_sf_even(x: str, df: str) -> str:
    return (f"least(1.0, exp(-({x}) / 2.0) * list_sum(list_transform(range(0, CAST(({df}) // 2 AS BIGINT)), "
            f"lambda i: pow(({x}) / 2.0, i) / exp(lgamma(i + 1)))))")


ORACLE["parse_tagged_output"] = _with(TAGGED, PARSED) + """
SELECT row_id, model_counter_speech, model_strategies FROM parsed"""

ORACLE["union_models"] = _with(TAGGED) + "SELECT row_id, model, theme, model_output FROM tagged"

ORACLE["overlay_merge"] = _with(OVERLAYS, """best AS (
  SELECT row_id,
    arg_max(quality, prio) FILTER (WHERE quality IS NOT NULL) AS quality,
    arg_max(toxic, prio) FILTER (WHERE toxic IS NOT NULL) AS toxic,
    arg_max(hate_speech_id, prio) FILTER (WHERE hate_speech_id IS NOT NULL) AS hate_speech_id
  FROM ov GROUP BY row_id),
merged AS (
  SELECT d.doc_id AS row_id, d.lang AS theme,
         coalesce(b.quality, CASE WHEN d.doc_id % 2 = 0 THEN '0' END, '0') AS quality,
         b.toxic, b.hate_speech_id
  FROM documents d LEFT JOIN best b ON b.row_id = d.doc_id)""") + """
SELECT *, TRY_CAST(split_part(coalesce(hate_speech_id, '0-0'), '-', 1) AS DOUBLE) AS hate_speech_id_message,
          TRY_CAST(split_part(coalesce(hate_speech_id, '0-0'), '-', 2) AS DOUBLE) AS hate_speech_id_response
FROM merged"""

ORACLE["check_disjoint"] = _with(OVERLAYS) + """
SELECT DISTINCT a.row_id FROM ov a JOIN ov b ON a.row_id = b.row_id WHERE a.prio = 0 AND b.prio = 2"""

_SPLIT = """keyed AS (SELECT row_id, md5('42:' || CAST(row_id AS VARCHAR)) AS h FROM responses),
smp AS (SELECT row_id FROM keyed ORDER BY h, row_id LIMIT 50),
parts AS (
  SELECT row_id, 'sample' AS part FROM smp
  UNION ALL
  SELECT row_id, CASE WHEN substr(h, 1, 1) < '8' THEN 'part_1' ELSE 'part_2' END FROM keyed
  WHERE row_id NOT IN (SELECT row_id FROM smp))"""

ORACLE["split_for_annotation"] = _with(RESPONSES, _SPLIT) + "SELECT row_id, part FROM parts"

ORACLE["check_coverage"] = _with(RESPONSES, _SPLIT) + """
SELECT count(*) FILTER (WHERE w.row_id IS NOT NULL) AS n_total,
       count(*) FILTER (WHERE w.row_id IS NOT NULL AND p.row_id IS NOT NULL) AS n_covered,
       count(*) FILTER (WHERE p.row_id IS NULL) AS n_missing,
       count(*) FILTER (WHERE w.row_id IS NULL) AS n_extra
FROM (SELECT DISTINCT row_id FROM responses) w FULL JOIN (SELECT DISTINCT row_id FROM parts) p USING (row_id)"""

_ANN_NULLS = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in [
    "clarity", "factual", "alternative", "narrative", "critical_thinking", "fear_id", "fear_ack",
    "conspiracy_usage", "repetition_harmful", "hate_speech_id", "hate_speech_handling", "conspiracy_handling"])
ORACLE["sample_n"] = _with(RESPONSES) + f"""
SELECT row_id, model, response, {_ANN_NULLS} FROM responses
ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 50"""

ORACLE["random_corpus"] = _with(RESPONSES) + """
SELECT theme, message_id, arg_min(row_id, md5('42:' || CAST(row_id AS VARCHAR))) AS row_id
FROM responses WHERE message_id IS NOT NULL GROUP BY theme, message_id"""

ORACLE["extract_corpus"] = _with(RESPONSES) + """
SELECT row_id, trim(response, ' "') AS response FROM responses
WHERE theme = 'de' AND model = 'm1' AND response IS NOT NULL"""

ORACLE["trim_charset"] = r"""
SELECT doc_id AS row_id, trim(' "' || source || '" ' || chr(10), ' "') AS trimmed,
       regexp_replace(' "' || source || '" ' || chr(10), '^\s+|\s+$', '', 'g') AS stripped
FROM documents"""

ORACLE["split_compound_label"] = """
SELECT row_id, TRY_CAST(split_part(coalesce(label, '0-0'), '-', 1) AS DOUBLE) AS label_message,
       TRY_CAST(split_part(coalesce(label, '0-0'), '-', 2) AS DOUBLE) AS label_response
FROM (SELECT doc_id AS row_id, CASE WHEN doc_id % 5 = 0 THEN NULL
             ELSE CAST(quality AS VARCHAR) || '-' || CAST(toxic AS VARCHAR) END AS label FROM labels)"""

ORACLE["normalize_scores"] = """
WITH r AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 6 = 0 THEN 'n/a' WHEN doc_id % 6 = 1 THEN NULL
                  WHEN doc_id % 6 = 2 THEN '' ELSE CAST(quality + toxic AS VARCHAR) END AS raw FROM labels),
o AS (SELECT *, nullif(TRY_CAST(CASE WHEN raw = 'n/a' THEN NULL ELSE raw END AS DOUBLE), 0) AS ordinal FROM r)
SELECT row_id, ordinal, CASE WHEN raw = 'n/a' THEN NULL ELSE raw END AS nominal,
       CASE WHEN ordinal IS NULL THEN '0' ELSE '1' END AS binary,
       CASE WHEN ordinal IS NULL THEN -1.0 ELSE 1.0 END AS sign, nullif(raw, '') AS raw_or_null
FROM o"""

ORACLE["rename_map"] = "SELECT doc_id AS row_id, a.v AS annotator, " + ", ".join(
    f"CAST((quality + toxic * 2 + {k}) % 4 AS INTEGER) AS {c}" for k, c in enumerate(ANNOTATION_COL_MAPPING.values())) + \
    " FROM labels, (VALUES ('1'), ('2')) AS a(v)"

ORACLE["publish_projection"] = _with(TAGGED, PARSED, FLAGS, OUTPUTS) + """
SELECT 'main' AS export, row_id, model_output, model_strategies, model_counter_speech, model, theme FROM outputs
UNION ALL
SELECT 'experiment', row_id, model_output, model_strategies, model_counter_speech, 'gpt4o', '2' FROM outputs WHERE model = 'm2'"""

ORACLE["distinct_messages"] = """
SELECT lang AS theme, count(DISTINCT text) AS n_distinct_messages FROM documents GROUP BY lang
UNION ALL SELECT 'all', count(DISTINCT text) FROM documents"""

_PCT = "round(100.0 * ({n}) / nullif({d}, 0), 6)"
_F = "(strat IS NOT NULL AND length(strat) > 0)"
_COMPLETE = "(strategy_1 IS NOT NULL AND strategy_2 IS NOT NULL AND strategy_3 IS NOT NULL AND strategy_4 IS NOT NULL)"
_AGREE = "(strategy_1 = sg1 AND strategy_2 = sg2 AND strategy_3 = sg3 AND strategy_4 = sg4)"
ORACLE["schema_report"] = _with(TAGGED, PARSED, FLAGS, OUTPUTS, LOADED) + f"""
SELECT model, n_rows, strategies_specified_pct, separator_present_pct, mean_raw_counterspeech_length,
       mean_counterspeech_length, mean_diff_counter_speech_length, std_diff_counter_speech_length,
       counterspeech_correctly_separated_pct, step_2_specified_pct, strategies_applied_pct,
       round(100.0 * mean_counterspeech_length / nullif(mean_raw_counterspeech_length, 0), 6) AS corrected_vs_reported_length
FROM (
  SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model,
    count(*) AS n_rows,
    {_PCT.format(n="count(*) FILTER (WHERE length(regexp_replace(strat, '^\\s+|\\s+$', '', 'g')) > 0)", d="count(*)")} AS strategies_specified_pct,
    {_PCT.format(n="count(*) FILTER (WHERE contains(model_output, '<XXX>'))", d="count(*)")} AS separator_present_pct,
    round_even(avg(length(cs)), 2) AS mean_raw_counterspeech_length,
    round_even(avg(length(csc)), 2) AS mean_counterspeech_length,
    round_even(avg(coalesce(length(cs), 0) - coalesce(length(csc), 0)) FILTER (WHERE {_F}), 2) AS mean_diff_counter_speech_length,
    round_even(stddev_samp(coalesce(length(cs), 0) - coalesce(length(csc), 0)) FILTER (WHERE {_F}), 2) AS std_diff_counter_speech_length,
    {_PCT.format(n=f"count(*) FILTER (WHERE {_F} AND coalesce(cs, '') = coalesce(csc, ''))", d=f"count(*) FILTER (WHERE {_F})")} AS counterspeech_correctly_separated_pct,
    {_PCT.format(n="count(*) FILTER (WHERE step_2 = 1)", d="count(step_2)")} AS step_2_specified_pct,
    {_PCT.format(n=f"count(*) FILTER (WHERE {_COMPLETE} AND {_AGREE})", d=f"count(*) FILTER (WHERE {_COMPLETE})")} AS strategies_applied_pct
  FROM loaded GROUP BY GROUPING SETS ((model), ()))"""

ORACLE["strategy_counts"] = _with(TAGGED, PARSED, FLAGS, OUTPUTS, LOADED, """lng AS (
  SELECT model, 'strategy_1' AS strategy, strategy_1 AS v FROM loaded UNION ALL
  SELECT model, 'strategy_2', strategy_2 FROM loaded UNION ALL
  SELECT model, 'strategy_3', strategy_3 FROM loaded UNION ALL
  SELECT model, 'strategy_4', strategy_4 FROM loaded)""") + """
SELECT model, strategy, applied, not_applied, unknown,
       round_even(100.0 * applied / nullif(applied + not_applied, 0), 2) AS applied_rel_pct
FROM (
  SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, strategy,
         count(*) FILTER (WHERE v = 1) AS applied, count(*) FILTER (WHERE v = -1) AS not_applied,
         count(*) FILTER (WHERE v IS NULL) AS unknown
  FROM lng GROUP BY GROUPING SETS ((model, strategy), (strategy)))"""

ORACLE["top_strategy_combos"] = _with(TAGGED, PARSED, FLAGS, OUTPUTS, LOADED) + f"""
SELECT model, rank, combination, cnt FROM (
  SELECT model, combination, cnt, row_number() OVER (PARTITION BY model ORDER BY cnt DESC, combination) AS rank
  FROM (
    SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model,
           concat_ws(',', strategy_1, strategy_2, strategy_3, strategy_4) AS combination, count(*) AS cnt
    FROM loaded WHERE {_COMPLETE}
    GROUP BY GROUPING SETS ((model, concat_ws(',', strategy_1, strategy_2, strategy_3, strategy_4)),
                            (concat_ws(',', strategy_1, strategy_2, strategy_3, strategy_4)))))
WHERE rank <= 10"""

ORACLE["strategy_agreement"] = _with(TAGGED, PARSED, FLAGS, OUTPUTS, LOADED) + f"""
SELECT model, count(*) AS n_complete, round(avg(CASE WHEN {_AGREE} THEN 100.0 ELSE 0.0 END), 6) AS agreement_pct
FROM loaded WHERE {_COMPLETE} GROUP BY model"""

ORACLE["notnull_share"] = _with(TAGGED, PARSED, FLAGS, OUTPUTS, """lng AS (
  SELECT model, 'strategy_1' AS "column", strategy_1 AS v FROM outputs UNION ALL
  SELECT model, 'strategy_2', strategy_2 FROM outputs UNION ALL
  SELECT model, 'strategy_3', strategy_3 FROM outputs UNION ALL
  SELECT model, 'strategy_4', strategy_4 FROM outputs UNION ALL
  SELECT model, 'step_2', step_2 FROM outputs)""") + """
SELECT model, "column", count(v) AS n_notnull, count(*) AS n_rows, round(100.0 * count(v) / count(*), 6) AS pct_notnull
FROM lng GROUP BY model, "column\""""

ORACLE["group_mean_median"] = _with(PANEL) + """
SELECT category, model, round(avg(score), 6) AS mean, round(median(score), 6) AS median
FROM panel_long GROUP BY category, model"""

_DESCR = """round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS std,
       min(score) AS min, max(score) AS max, count(score) AS count"""
ORACLE["ordinal_stats"] = _with(PANEL) + f"SELECT category, model, {_DESCR} FROM panel_long GROUP BY category, model"
ORACLE["ordinal_stats_global"] = _with(PANEL) + f"SELECT category, {_DESCR} FROM panel_long GROUP BY category"

ORACLE["nominal_counts"] = """
WITH w AS (SELECT 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, CAST(quality AS VARCHAR) AS quality,
                  CASE WHEN doc_id % 9 = 0 THEN 'n/a' ELSE CAST(toxic AS VARCHAR) END AS toxic FROM labels),
l AS (SELECT model, 'quality' AS "column", quality AS raw FROM w UNION ALL SELECT model, 'toxic', toxic FROM w)
SELECT model, "column", CASE WHEN raw = 'n/a' THEN NULL ELSE raw END AS value, count(*) AS cnt
FROM l WHERE raw IS NOT NULL AND raw <> 'n/a' GROUP BY ALL"""

ORACLE["pivot_scores"] = _with(PANEL) + """
SELECT category, subject,
  first(score) FILTER (WHERE model = 'click') AS click, first(score) FILTER (WHERE model = 'error') AS error,
  first(score) FILTER (WHERE model = 'purchase') AS purchase, first(score) FILTER (WHERE model = 'signup') AS signup,
  first(score) FILTER (WHERE model = 'view') AS "view"
FROM panel_long GROUP BY category, subject"""

_FRIEDMAN = """kk AS (SELECT category, count(DISTINCT model) AS k FROM panel_long GROUP BY category),
complete AS (
  SELECT s.category, s.subject, kk.k FROM (SELECT category, subject, count(score) AS m FROM panel_long GROUP BY ALL) s
  JOIN kk USING (category) WHERE s.m = kk.k),
rows_ AS (SELECT p.*, c.k FROM panel_long p JOIN complete c USING (category, subject) WHERE p.score IS NOT NULL),
ranked AS (
  SELECT category, model, k, rank() OVER (PARTITION BY category, subject ORDER BY score)
         + (count(*) OVER (PARTITION BY category, subject, score) - 1) / 2.0 AS r FROM rows_),
fr AS (
  SELECT category, k, n, ssbn, tt, 1 - tt / (k * (k * k - 1) * n) AS c FROM (
    SELECT category, any_value(k) AS k, sum(rj * rj) AS ssbn FROM (
      SELECT category, model, any_value(k) AS k, sum(r) AS rj FROM ranked GROUP BY ALL) GROUP BY category)
  JOIN (SELECT category, count(*) AS n FROM complete GROUP BY category) USING (category)
  JOIN (SELECT category, sum(t * t * t - t) AS tt FROM (
          SELECT category, subject, score, count(*) AS t FROM rows_ GROUP BY ALL) GROUP BY category) USING (category)
  WHERE n >= 1 AND k >= 3),
fstat AS (
  SELECT category, k, n, CASE WHEN c = 0 THEN NULL ELSE (12.0 / (k * n * (k + 1)) * ssbn - 3 * n * (k + 1)) / c END AS chi
  FROM fr)"""

ORACLE["friedman"] = _with(PANEL, _FRIEDMAN) + f"""
SELECT category, round(chi, 6) AS statistic, round({_chi2_sf_even('chi', 'k - 1')}, 6) AS p_value,
       round(chi / (n * (k - 1)), 6) AS kendall_w, n AS n_subjects, CAST(k AS BIGINT) AS k_models
FROM fstat"""


def _wilcoxon(gated: bool) -> str:
    gate = "AND category IN (SELECT category FROM fstat2 WHERE p < 0.05)" if gated else ""
    return f"""s AS (SELECT category, subject, model, score FROM panel_long WHERE score IS NOT NULL {gate}),
pairs AS (
  SELECT a.category, a.model AS model_1, b.model AS model_2, a.score - b.score AS d
  FROM s a JOIN s b ON a.category = b.category AND a.subject = b.subject AND a.model < b.model),
sup AS (SELECT category, model_1, model_2, count(*) AS support, count(*) FILTER (WHERE d = 0) AS n_zero
        FROM pairs GROUP BY ALL),
hist AS (
  SELECT *, coalesce(sum(t) OVER (PARTITION BY category, model_1, model_2 ORDER BY ad
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS mid
  FROM (SELECT category, model_1, model_2, abs(d) AS ad, count(*) AS t, count(*) FILTER (WHERE d > 0) AS pos
        FROM pairs WHERE d <> 0 GROUP BY ALL)),
sums AS (
  SELECT category, model_1, model_2, sum(pos * mid) AS rp, sum((t - pos) * mid) AS rm, sum(t) AS nr,
         sum(t * t * t - t) AS tt FROM hist GROUP BY ALL),
wt AS (
  SELECT sup.*, least(rp, rm) AS w, rp - rm AS dir, nr, tt,
         (least(rp, rm) - nr * (nr + 1) / 4.0) / sqrt((nr * (nr + 1) * (2 * nr + 1) - 0.5 * tt) / 24.0) AS zc,
         (least(rp, rm) - support * (support + 1) / 4.0) / sqrt(support * (support + 1) * (2 * support + 1) / 24.0) AS zs
  FROM sup LEFT JOIN sums USING (category, model_1, model_2)),
wp AS (SELECT *, CASE WHEN nr IS NULL THEN NULL ELSE {_erfc('abs(zc) / sqrt(2.0)')} END AS p FROM wt),
wb AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, p * count(p) OVER (PARTITION BY category)) END AS pb FROM wp)"""


_WSEL = """SELECT category, model_1, model_2, model_1 || ' vs ' || model_2 AS comparison, round(w, 6) AS w_stat,
       round(zs, 6) AS z_stat, round(zc, 6) AS z_corrected, round(p, 6) AS p_value,
       CASE WHEN p IS NOT NULL THEN 'normal' END AS p_method, round(pb, 6) AS p_bonferroni,
       round(abs(zs) / sqrt(support), 6) AS effect_size, support,
       CASE WHEN p IS NULL THEN NULL WHEN p >= 0.05 THEN 'No significant difference'
            WHEN dir > 0 THEN model_1 ELSE model_2 END AS better_model
FROM wb"""

ORACLE["wilcoxon_pairs"] = _with(PANEL, _wilcoxon(False)) + _WSEL

ORACLE["bonferroni"] = _with(PANEL, _wilcoxon(False)) + """
SELECT category, model_1 || ' vs ' || model_2 AS comparison, round(p, 6) AS p_value,
       round(pb, 6) AS p_adjusted FROM wb"""

ORACLE["significance_report"] = _with(PANEL, _FRIEDMAN, f"""fstat2 AS (
  SELECT category, k, n, chi, {_chi2_sf_even('chi', 'k - 1')} AS p FROM fstat)""",
                                      _wilcoxon(True)) + """
SELECT category, 'Friedman' AS comparison, round(chi, 6) AS statistic, round(p, 6) AS p_value,
       round(chi / (n * (k - 1)), 6) AS effect_size, n AS support, CAST(NULL AS VARCHAR) AS better_model FROM fstat2
UNION ALL
SELECT category, model_1 || ' vs ' || model_2, round(zs, 6), round(pb, 6), round(abs(zs) / sqrt(support), 6), support,
       CASE WHEN p IS NULL THEN NULL WHEN p >= 0.05 THEN 'No significant difference'
            WHEN dir > 0 THEN model_1 ELSE model_2 END
FROM wb"""

ORACLE["paired_predictions"] = _with(PREDICTIONS) + """
SELECT row_id, first(y_true) AS y_true, max(y_pred) FILTER (WHERE model = 'm0') AS m0,
       max(y_pred) FILTER (WHERE model = 'm1') AS m1, max(y_pred) FILTER (WHERE model = 'm2') AS m2
FROM predictions GROUP BY row_id
HAVING count(*) FILTER (WHERE model = 'm0') > 0 AND count(*) FILTER (WHERE model = 'm1') > 0
   AND count(*) FILTER (WHERE model = 'm2') > 0"""

_CONT = """ok AS (SELECT row_id, model, coalesce(y_pred = y_true, false) AS ok FROM predictions),
cont AS (
  SELECT a.model AS model_1, b.model AS model_2,
         count(*) FILTER (WHERE a.ok AND b.ok) AS n11, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS n10,
         count(*) FILTER (WHERE NOT a.ok AND b.ok) AS n01, count(*) FILTER (WHERE NOT a.ok AND NOT b.ok) AS n00
  FROM ok a JOIN ok b ON a.row_id = b.row_id AND a.model < b.model GROUP BY ALL)"""

ORACLE["contingency_pairs"] = _with(PREDICTIONS, _CONT) + "SELECT * FROM cont"

ORACLE["mcnemar_pairs"] = _with(PREDICTIONS, _CONT, """mc AS (
  SELECT *, least(n10, n01) AS statistic,
         least(1.0, 2.0 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i:
           exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2.0))))) AS p
  FROM cont)""") + """
SELECT model_1, model_2, n11, n10, n01, n00, statistic, round(p, 6) AS p_value,
       round(least(1.0, p * count(p) OVER ()), 6) AS p_bonferroni FROM mc"""

ORACLE["binary_prf"] = _with(PREDICTIONS) + """
SELECT model, tp, fp, fn,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1
FROM (SELECT model, count(*) FILTER (WHERE y_true = 1.0 AND y_pred = 1.0) AS tp,
             count(*) FILTER (WHERE y_true <> 1.0 AND y_pred = 1.0) AS fp,
             count(*) FILTER (WHERE y_true = 1.0 AND y_pred <> 1.0) AS fn FROM predictions GROUP BY model)"""

ORACLE["classification_report"] = _with(PREDICTIONS, """labels_ AS (
  SELECT model, y_true AS label FROM predictions UNION SELECT model, y_pred FROM predictions),
per AS (
  SELECT l.model, l.label,
    (SELECT count(*) FROM predictions p WHERE p.model = l.model AND p.y_true = l.label) AS support,
    (SELECT count(*) FROM predictions p WHERE p.model = l.model AND p.y_true = l.label AND p.y_pred = l.label) AS tp,
    (SELECT count(*) FROM predictions p WHERE p.model = l.model AND p.y_pred = l.label) AS npred
  FROM labels_ l),
m AS (
  SELECT *, coalesce(tp / nullif(npred, 0), 0.0) AS pr, coalesce(tp / nullif(support, 0), 0.0) AS rc,
         coalesce(2.0 * tp / nullif(npred + support, 0), 0.0) AS f FROM per)""") + """
SELECT model, CAST(label AS VARCHAR) AS label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM m
UNION ALL
SELECT model, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m GROUP BY model
UNION ALL
SELECT model, 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m GROUP BY model
UNION ALL
SELECT model, 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m GROUP BY model"""


def _alpha(src: str, level: str, values: bool = True) -> str:
    each, named = ((""" array_to_string(list_sort(list(DISTINCT CAST(v AS VARCHAR))), ',') AS "values",
              """, ', dom."values"') if values else ("", ""))
    if level == "nominal":
        d2 = "CASE WHEN x.c = y.c THEN 0.0 ELSE 1.0 END"
        cum = ""
    else:
        d2 = ("pow((CASE WHEN x.cum >= y.cum THEN x.cum - y.cum + y.n_c ELSE y.cum - x.cum + x.n_c END)"
              " - (x.n_c + y.n_c) / 2.0, 2)")
        cum = ", sum(n_c) OVER (PARTITION BY category ORDER BY CAST(c AS DOUBLE)) AS cum"
    return f"""src AS ({src}),
v AS (SELECT category, unit, v FROM src WHERE v IS NOT NULL),
dom AS (SELECT category,{each} count(DISTINCT v) AS n_values FROM v GROUP BY category),
nuc AS (SELECT category, unit, v, count(*) AS n_uc FROM v GROUP BY ALL),
mu AS (SELECT category, unit, sum(n_uc) AS m_u FROM nuc GROUP BY ALL HAVING sum(n_uc) >= 2),
nu AS (SELECT nuc.*, mu.m_u FROM nuc JOIN mu USING (category, unit)),
o AS (SELECT a.category, a.v AS c, b.v AS k,
             sum(a.n_uc * (b.n_uc - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) / (a.m_u - 1)) AS o
      FROM nu a JOIN nu b ON a.category = b.category AND a.unit = b.unit GROUP BY ALL),
nc AS (SELECT category, c, n_c{cum} FROM (SELECT category, c, sum(o) AS n_c FROM o GROUP BY ALL)),
pr AS (SELECT x.category, x.c, y.c AS k, x.n_c, y.n_c AS n_k, {d2} AS d2
       FROM nc x JOIN nc y ON x.category = y.category),
res AS (
  SELECT pr.category, 1 - (n.n - 1) * sum(coalesce(o.o, 0.0) * d2) / nullif(sum(pr.n_c * pr.n_k * d2), 0) AS alpha
  FROM pr LEFT JOIN o ON o.category = pr.category AND o.c = pr.c AND o.k = pr.k
  JOIN (SELECT category, sum(n_c) AS n FROM nc GROUP BY category) n ON n.category = pr.category
  GROUP BY pr.category, n.n)
SELECT dom.category, round(res.alpha, 6) AS alpha, dom.n_values{named}
FROM dom LEFT JOIN res USING (category) WHERE dom.n_values >= 2"""


_ORD_SRC = ("SELECT category, subject AS unit, model AS rater, "
            "nullif(TRY_CAST(CAST(score AS VARCHAR) AS DOUBLE), 0) AS v FROM panel_long")
_NOM_SRC = ("SELECT 'quality' AS category, l.doc_id AS unit, 'r1' AS rater, CAST(l.quality AS VARCHAR) AS v "
            "FROM labels l JOIN documents d USING (doc_id) UNION ALL "
            "SELECT 'quality', l.doc_id, 'r2', CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END "
            "FROM labels l JOIN documents d USING (doc_id)")
_BIN_SRC = ("SELECT category, subject AS unit, model AS rater, "
            "CASE WHEN nullif(score, 0) IS NULL THEN '0' ELSE '1' END AS v FROM panel_long")

ORACLE["alpha_ordinal"] = "WITH " + PANEL + ",\n" + _alpha(_ORD_SRC, "ordinal")
ORACLE["alpha_nominal"] = "WITH " + _alpha(_NOM_SRC, "nominal")
ORACLE["alpha_binary"] = "WITH " + PANEL + ",\n" + _alpha(_BIN_SRC, "nominal")
_MISSING_SRC = ("SELECT l.doc_id AS unit, 'r1' AS rater, CAST(l.quality AS VARCHAR) AS v FROM labels l JOIN documents d USING (doc_id) "
                "UNION ALL SELECT l.doc_id, 'r2', CASE WHEN l.doc_id % 4 <> 0 THEN CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END END "
                "FROM labels l JOIN documents d USING (doc_id)")
ORACLE["alpha_missing_category"] = "\nUNION ALL\n".join(
    f"SELECT * FROM (WITH {_alpha(f'SELECT {name!r} AS category, unit, rater, {v} AS v FROM ({_MISSING_SRC})', 'nominal', False)})"
    for name, v in (("missing: category", "coalesce(v, 'nan')"), ("missing: ignore", "v")))
ORACLE["value_domain"] = "WITH " + PANEL + f""", src AS ({_ORD_SRC})
SELECT category, v AS value, count(*) AS cnt FROM src WHERE v IS NOT NULL GROUP BY ALL"""
ORACLE["alpha_report"] = "\nUNION ALL\n".join(
    f"SELECT *, '{lvl}' AS level FROM ({ORACLE[k]})" for k, lvl in
    [("alpha_ordinal", "ordinal"), ("alpha_nominal", "nominal"), ("alpha_binary", "binary")])

DECORATED = """base AS (
  SELECT lang AS theme, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, doc_id AS row_id, doc_id // 3 AS message_id,
         trim(text || ' #' || source || ' https://x.org/' || CAST(doc_id AS VARCHAR)
              || CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(128512) ELSE '?' END, ' "') AS text
  FROM documents WHERE text IS NOT NULL),
""" + CORPUS

_EMOJI_CLASS = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}" \
               "\\x{1F780}-\\x{1F7FF}\\x{1F800}-\\x{1F8FF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}" \
               "\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{1F1E0}-\\x{1F1FF}]"
HASHTAG_RE = f"#{W}+"
URL_RE = r"https?://\S+"


def _extract_stats(pattern: str, name: str) -> str:
    return _with(DECORATED) + f""", x AS (SELECT theme, model, row_id, regexp_extract_all(text, '{pattern}') AS items FROM corpus)
SELECT a.theme, a.model, a.texts_with_{name}, a.n_{name}, coalesce(b.nd, 0) AS n_distinct_{name} FROM
  (SELECT theme, model, count(*) FILTER (WHERE len(items) > 0) AS texts_with_{name},
          CAST(sum(len(items)) AS BIGINT) AS n_{name} FROM x GROUP BY ALL) a
  LEFT JOIN (SELECT theme, model, count(DISTINCT item) AS nd FROM (SELECT theme, model, unnest(items) AS item FROM x)
             GROUP BY ALL) b USING (theme, model)"""


ORACLE["emoji_stats"] = _extract_stats(_EMOJI_CLASS, "emojis")
ORACLE["hashtag_stats"] = _extract_stats(HASHTAG_RE, "hashtags")
ORACLE["url_stats"] = _extract_stats(URL_RE, "urls")
ORACLE["hashtag_bag"] = _with(DECORATED) + f"""
SELECT theme, model, item, count(*) AS cnt FROM (
  SELECT theme, model, unnest(regexp_extract_all(text, '{HASHTAG_RE}')) AS item FROM corpus) GROUP BY ALL"""

for _key, _pattern in (("emoji_bag", _EMOJI_CLASS), ("url_bag", URL_RE)):
    ORACLE[_key] = _with(DECORATED) + f"""
SELECT theme, model, item, count(*) AS cnt FROM (
  SELECT theme, model, unnest(regexp_extract_all(text, '{_pattern}')) AS item FROM corpus) GROUP BY ALL"""

ORACLE["page_urls"] = f"""
SELECT page_id, len(regexp_extract_all(url, '{URL_RE}')) AS n_urls, array_to_string(regexp_extract_all(url, '{URL_RE}'), ' ') AS urls,
       len(regexp_extract_all(url, '{HASHTAG_RE}')) AS n_hashtags,
       array_to_string(regexp_extract_all(url, '{HASHTAG_RE}'), ' ') AS hashtags
FROM pages"""

ORACLE["ngrams"] = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b,
             list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS tri FROM t)
SELECT doc_id AS row_id, len(b) AS n_bigrams, len(list_distinct(b)) AS n_distinct_bigrams, len(tri) AS n_trigrams,
       tri[1] AS first_trigram, md5(array_to_string(b, chr(1))) AS bigrams_md5,
       md5(array_to_string(tri, chr(1))) AS trigrams_md5 FROM g"""

ORACLE["simple_tokens"] = f"""
SELECT doc_id AS row_id, len(w) AS n_tokens, w[1] AS first_token, w[-1] AS last_token,
       md5(array_to_string(w, chr(1))) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(text, '{SIMPLE_TOKEN}') AS w FROM documents)"""

ORACLE["sentences"] = r"""
SELECT doc_id AS row_id, len(ss) AS n_sentences, coalesce(list_max(list_transform(ss, lambda s: length(s))), 0) AS max_sentence_chars,
       md5(array_to_string(ss, chr(1))) AS sentences_md5
FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)),
                                 lambda s: regexp_matches(s, '\S')) AS ss FROM documents)"""

DIALOGUE = """dialogue AS (
  SELECT conv_id, turn, text AS message, next_text AS response FROM (
    SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

ORACLE["jaccard_pairs"] = _with(DIALOGUE) + r"""
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.0
                                 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS jaccard
FROM (SELECT conv_id, turn,
             list_distinct(list_filter(regexp_split_to_array(message, '\s+'), lambda x: x <> '')) AS a,
             list_distinct(list_filter(regexp_split_to_array(response, '\s+'), lambda x: x <> '')) AS b FROM dialogue)"""

VECTORS = """vectors AS (
  SELECT vec_id, vec_id // 3 AS message_id, 'm' || CAST(vec_id % 3 AS VARCHAR) AS model, label AS theme,
         CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""

_COS = ("CASE WHEN list_dot_product(a.e, a.e) = 0 OR list_dot_product(b.e, b.e) = 0 THEN 0.0 ELSE "
        "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) END")

ORACLE["semantic_max"] = _with(VECTORS) + f"""
SELECT a.theme, a.model, a.vec_id, round(max({_COS}), 6) AS max_sim
FROM vectors a LEFT JOIN vectors b ON a.theme = b.theme AND a.model = b.model AND a.vec_id <> b.vec_id
GROUP BY ALL"""

ORACLE["semantic_max_stats"] = _with(VECTORS) + f"""
SELECT theme, model, round(avg(m), 6) AS semantic_similarity_mean, round(stddev_pop(m), 6) AS semantic_similarity_std,
       count(*) AS n
FROM (SELECT a.theme, a.model, a.vec_id, max({_COS}) AS m
      FROM vectors a LEFT JOIN vectors b ON a.theme = b.theme AND a.model = b.model AND a.vec_id <> b.vec_id
      GROUP BY ALL) GROUP BY ALL"""

ORACLE["semantic_baseline"] = _with(VECTORS) + f""", every AS (SELECT 'all' AS scope, vec_id, e FROM vectors
              UNION ALL SELECT 'theme=' || CAST(theme AS VARCHAR), vec_id, e FROM vectors),
sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, e ORDER BY vec_id) AS rn FROM every) WHERE rn = 1)
SELECT scope, round(avg(m), 6) AS semantic_similarity_mean, round(stddev_pop(m), 6) AS semantic_similarity_std,
       count(*) AS n
FROM (SELECT a.scope, a.vec_id, max({_COS}) AS m
      FROM sc a LEFT JOIN sc b ON a.scope = b.scope AND a.vec_id <> b.vec_id GROUP BY ALL) GROUP BY scope"""

_PAIRS = f"""pl AS (
  SELECT a.message_id, a.model || '_vs_' || b.model AS pair, {_COS} AS similarity
  FROM vectors a JOIN vectors b ON a.message_id = b.message_id AND a.model < b.model)"""

ORACLE["pair_similarity"] = _with(VECTORS, _PAIRS) + """
SELECT message_id, round(first(similarity) FILTER (WHERE pair = 'm0_vs_m1'), 6) AS m0_vs_m1,
       round(first(similarity) FILTER (WHERE pair = 'm0_vs_m2'), 6) AS m0_vs_m2,
       round(first(similarity) FILTER (WHERE pair = 'm1_vs_m2'), 6) AS m1_vs_m2
FROM pl GROUP BY message_id"""

ORACLE["pair_similarity_describe"] = _with(VECTORS, _PAIRS) + """
SELECT pair, count(similarity) AS count, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS std,
       round(min(similarity), 6) AS min, round(quantile_cont(similarity, 0.25), 6) AS p25,
       round(quantile_cont(similarity, 0.5), 6) AS p50, round(quantile_cont(similarity, 0.75), 6) AS p75,
       round(max(similarity), 6) AS max
FROM pl GROUP BY pair"""

# the capital of ß is SS by Unicode's full case mapping, which Spark follows; DuckDB has one letter for it
ENTITIES = _with(DIALOGUE) + f""", items AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS row_id, 'm' || CAST(conv_id % 3 AS VARCHAR) AS model,
         message, response FROM dialogue),
gaz AS (
  SELECT DISTINCT CASE WHEN length(alias) % 2 = 0 THEN 'person' ELSE 'organization' END AS kind, alias
  FROM (SELECT unnest(regexp_extract_all(text, '{SIMPLE_TOKEN}')) AS alias FROM documents)
  WHERE regexp_matches(alias, '^\\p{{Lu}}\\p{{Ll}}+$')
  UNION
  SELECT CASE WHEN length(alias) % 2 = 0 THEN 'person' ELSE 'organization' END, alias
  FROM (SELECT array_to_string(t[1:n], ' ') AS alias
        FROM (SELECT regexp_extract_all(text, '{SIMPLE_TOKEN}') AS t FROM conversations),
             (VALUES (2), (3)) AS k(n) WHERE len(t) >= n)),
adim AS (
  SELECT kind, alias, CASE WHEN length(alias) % 5 = 0 THEN NULL WHEN length(alias) % 5 = 1 THEN upper(replace(alias, 'ß', 'SS'))
                           ELSE lower(alias) END AS canonical FROM gaz WHERE length(alias) % 3 <> 0),
sides AS (
  SELECT row_id, model, 'message' AS side, regexp_extract_all(message, '{SIMPLE_TOKEN}') AS tok FROM items
  UNION ALL SELECT row_id, model, 'response', regexp_extract_all(response, '{SIMPLE_TOKEN}') FROM items),
grams AS (
  SELECT row_id, model, side, g.pos, g.n, g.gram FROM (
    SELECT row_id, model, side, unnest(list_concat(
      list_concat(
      list_transform(range(1, len(tok) + 1), lambda i: {{'pos': i - 1, 'n': 1, 'gram': tok[i]}}),
      list_transform(range(1, len(tok)), lambda i: {{'pos': i - 1, 'n': 2, 'gram': tok[i] || ' ' || tok[i + 1]}})),
      list_transform(range(1, len(tok) - 1), lambda i: {{'pos': i - 1, 'n': 3, 'gram': tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2]}}))) AS g
    FROM sides)),
hits AS (
  SELECT g.*, z.kind, max(n) OVER (PARTITION BY row_id, model, side, pos) AS longest
  FROM grams g JOIN gaz z ON z.alias = g.gram),
mentions AS (
  SELECT row_id, model, side, CAST(pos AS INTEGER) AS pos, kind, gram AS entity
  FROM hits h WHERE n = longest AND NOT EXISTS (
    SELECT 1 FROM hits e WHERE e.row_id = h.row_id AND e.model = h.model AND e.side = h.side AND e.n = e.longest
                           AND e.pos < h.pos AND e.pos + e.n > h.pos)),
norm AS (
  SELECT DISTINCT m.row_id, m.model, m.side, m.kind,
         CASE WHEN a.alias IS NOT NULL THEN a.canonical ELSE m.entity END AS entity
  FROM (SELECT * REPLACE (regexp_replace(entity, '^(?i)the\\s+', '') AS entity) FROM mentions) m LEFT JOIN adim a ON a.kind = m.kind AND a.alias = m.entity),
diff_item AS (
  SELECT r.row_id, r.model, r.kind, r.entity FROM norm r
  WHERE r.side = 'response' AND r.entity IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM norm m WHERE m.side = 'message' AND m.entity IS NOT NULL
                    AND m.row_id = r.row_id AND m.kind = r.kind AND m.entity = r.entity))
"""

ORACLE["entity_extract"] = ENTITIES + "SELECT row_id, model, side, pos, kind, entity FROM mentions"
ORACLE["entity_counts"] = ENTITIES + """
SELECT i.model, i.n_items, coalesce(r.n, 0) AS responses_with_entities
FROM (SELECT model, count(*) AS n_items FROM items GROUP BY model) i
LEFT JOIN (SELECT model, count(DISTINCT row_id) AS n FROM mentions WHERE side = 'response' GROUP BY model) r USING (model)"""
ORACLE["entity_normalize"] = ENTITIES + "SELECT row_id, model, side, kind, entity FROM norm"
ORACLE["strip_article"] = ENTITIES + r"""
SELECT entity, regexp_replace(entity, '^(?i)the\s+', '') AS stripped,
       ltrim(ltrim(entity, 'the'), 'The ') AS stripped_compat
FROM (SELECT DISTINCT entity FROM mentions WHERE kind = 'organization')"""
ORACLE["entity_diff_item"] = ENTITIES + "SELECT * FROM diff_item"
ORACLE["entity_bag"] = ENTITIES + "SELECT model, side, kind, entity, row_id FROM norm WHERE entity IS NOT NULL"
ORACLE["entity_diff_group"] = ENTITIES + """
SELECT r.model, r.kind, r.entity, r.row_id FROM norm r
WHERE r.side = 'response' AND r.entity IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM norm m WHERE m.side = 'message' AND m.entity IS NOT NULL AND m.model = r.model
                  AND m.kind = r.kind AND m.entity = r.entity)"""
ORACLE["entity_frequency"] = ENTITIES + """
SELECT kind, entity, count(*) AS cnt FROM diff_item WHERE model IN ('m0', 'm1', 'm2') GROUP BY ALL"""
ORACLE["entity_universe"] = ENTITIES + "SELECT DISTINCT kind, entity FROM norm WHERE entity IS NOT NULL"

ORACLE["sentiment_counts"] = _with(RESPONSES, BASE, CORPUS) + f""", lex AS (
  SELECT word, length(word) % 5 - 2 AS valence FROM (
    SELECT lower(w) AS word, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(text, '{SIMPLE_TOKEN}')) AS w FROM documents) GROUP BY ALL
    ORDER BY n DESC, word LIMIT 40)),
s AS (
  SELECT theme, model, row_id, sum(valence) AS s FROM (
    SELECT theme, model, row_id, lower(unnest(regexp_extract_all(text, '{SIMPLE_TOKEN}'))) AS word FROM corpus) t
  JOIN lex USING (word) GROUP BY ALL),
sc AS (
  SELECT c.theme, c.model, CAST(coalesce(s.s, 0) AS DOUBLE) / sqrt(coalesce(s.s, 0) * coalesce(s.s, 0) + 15.0) AS compound
  FROM corpus c LEFT JOIN s USING (theme, model, row_id))
SELECT theme, model, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative'
                          ELSE 'neutral' END AS sentiment, count(*) AS cnt
FROM sc GROUP BY ALL"""

ORACLE["build_prompts"] = _with(DIALOGUE) + """
SELECT conv_id, turn, 'system_user_period' AS layout, 2 AS n_messages, 'system,user' AS roles,
       'Write a short counter speech.|Message: ' || message || '.' AS content FROM dialogue
UNION ALL
SELECT conv_id, turn, 'system_user', 2, 'system,user', 'Write a short counter speech.|Message: ' || message FROM dialogue
UNION ALL
SELECT conv_id, turn, 'user_with_prefix', 2, 'user,assistant',
       'Write a short counter speech. Message: ' || message || '|Counter speech:' FROM dialogue"""

_RESP_SQL = _with(RESPONSES) + "SELECT row_id, model, theme, response FROM responses"
ORACLE["io_csv_roundtrip"] = _RESP_SQL
ORACLE["io_csv_semicolon"] = _RESP_SQL
ORACLE["sink_by_theme"] = _with(RESPONSES) + "SELECT row_id, model, theme, response FROM responses"
ORACLE["report_sink"] = ORACLE["strategy_counts"]
ORACLE["parse_nested_list"] = """
SELECT doc_id AS row_id, 3 AS n_items, 4 AS n_total, lang AS second,
       source || ',' || lang || ';;' || CAST(doc_id AS VARCHAR) || ',<null>' AS cells FROM documents"""
ORACLE["model_from_path"] = """
SELECT doc_id AS row_id, CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'llama' ELSE 'mistral' END AS model_label
FROM documents"""


ORACLE["distinct_ngrams_by_model"] = _with(RESPONSES, BASE, """corpus AS (
  SELECT model, row_id, text FROM base
  UNION ALL
  SELECT 'random' AS model, arg_min(row_id, md5('42:' || CAST(row_id AS VARCHAR))) AS row_id,
         arg_min(text, md5('42:' || CAST(row_id AS VARCHAR))) AS text
  FROM base WHERE message_id IS NOT NULL GROUP BY message_id)""", r"""toks AS (
  SELECT model, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM corpus),
g AS (
  SELECT model, 1 AS n, unnest(t) AS gram FROM toks
  UNION ALL
  SELECT model, 2 AS n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks)""") + """
SELECT model,
  coalesce(round(count(DISTINCT gram) FILTER (WHERE n = 1) / nullif(count(*) FILTER (WHERE n = 1), 0), 6), 0.0) AS corpus_distinct_1grams,
  coalesce(round(count(DISTINCT gram) FILTER (WHERE n = 2) / nullif(count(*) FILTER (WHERE n = 2), 0), 6), 0.0) AS corpus_distinct_2grams
FROM g GROUP BY model"""

ORACLE["entity_diff_preview"] = ENTITIES + """
SELECT row_id, kind, entity, row_number() OVER (PARTITION BY row_id ORDER BY kind, entity) AS k
FROM diff_item WHERE row_id IN (SELECT row_id FROM items WHERE model = 'm0' ORDER BY row_id LIMIT 10)"""

ORACLE["split_exact_half"] = _with(RESPONSES, """keyed AS (SELECT row_id, md5('42:' || CAST(row_id AS VARCHAR)) AS h FROM responses),
smp AS (SELECT row_id FROM keyed ORDER BY h, row_id LIMIT 50),
rest AS (SELECT row_id, h, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n
         FROM keyed WHERE row_id NOT IN (SELECT row_id FROM smp))""") + """
SELECT row_id, 'sample' AS part FROM smp
UNION ALL
SELECT row_id, CASE WHEN rn <= round_even(n * 0.5, 0) THEN 'part_1' ELSE 'part_2' END FROM rest"""


def _sparse(rows: str, keys: str, features: int) -> str:
    """CTEs ending in unit(keys, i, x): hashed TF-IDF entries of ``rows`` (keys, text)."""
    return rf"""own AS ({rows}),
tk AS (SELECT {keys}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {features} AS i
       FROM (SELECT {keys}, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM own)),
en AS (SELECT {keys}, i, count(*) AS n FROM tk GROUP BY ALL),
hd AS (SELECT i, count(*) AS held FROM en GROUP BY i),
wt AS (SELECT {keys}, i, n * ln((SELECT count(*) + 1 FROM own) / (held + 1)) AS w FROM en JOIN hd USING (i)),
unit AS (SELECT {keys}, CAST(i AS INTEGER) AS i, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS x FROM wt WHERE w <> 0)"""


ORACLE["embed_text"] = "WITH " + _sparse("SELECT doc_id AS row_id, text FROM documents", "row_id", 1 << 12) + """
SELECT row_id, i, round(x, 5) AS x FROM unit"""

ORACLE["semantic_max_text"] = _with(RESPONSES, BASE, CORPUS_NO_RANDOM, _sparse("SELECT * FROM corpus", "theme, model, row_id", 1 << 14)) + """
, dots AS (SELECT a.theme, a.model, a.row_id, b.row_id AS other, sum(a.x * b.x) AS c
           FROM unit a JOIN unit b ON a.theme = b.theme AND a.model = b.model AND a.i = b.i AND a.row_id <> b.row_id GROUP BY ALL),
best AS (SELECT theme, model, row_id, max(c) AS c FROM dots GROUP BY ALL),
sizes AS (SELECT theme, model, count(*) AS k FROM corpus GROUP BY ALL)
SELECT theme, model, round(avg(m), 6) AS semantic_similarity_mean, round(stddev_pop(m), 6) AS semantic_similarity_std, count(*) AS n
FROM (SELECT c.theme, c.model, CASE WHEN k > 1 THEN coalesce(b.c, 0.0) END AS m
      FROM corpus c JOIN sizes USING (theme, model) LEFT JOIN best b USING (theme, model, row_id)) GROUP BY ALL"""


# --- the whole report: the metrics above over decorated responses, in groups by theme and pooled -------------------
_REPORT_RESPONSES = """responses AS (
  SELECT d.doc_id AS row_id, d.doc_id // 3 AS message_id, 'm' || CAST(d.doc_id % 3 AS VARCHAR) AS model, d.lang AS theme,
         d.text || ' #' || d.source || ' https://x.org/' || CAST(d.doc_id AS VARCHAR)
              || CASE WHEN d.doc_id % 3 = 0 THEN ' ' || chr(128512) ELSE '?' END AS response,
         substr(m.text, 1, 200) AS message
  FROM documents d LEFT JOIN documents m ON m.doc_id = d.doc_id // 3 * 3)"""
_DRAWN = """SELECT {theme} AS theme, 'random' AS model, arg_min(row_id, md5('42:' || CAST(row_id AS VARCHAR))) AS row_id,
         arg_min(text, md5('42:' || CAST(row_id AS VARCHAR))) AS text
  FROM base WHERE message_id IS NOT NULL GROUP BY {by}"""
_REPORT_CORPUS = ("corpus AS (SELECT theme, model, row_id, text FROM base UNION ALL SELECT 'all', model, row_id, text FROM base UNION ALL "
                  + _DRAWN.format(theme="theme", by="theme, message_id") + " UNION ALL " + _DRAWN.format(theme="'all'", by="message_id") + ")")


def _over_report(key: str) -> str:
    return ORACLE[key].replace(RESPONSES, _REPORT_RESPONSES).replace(CORPUS, _REPORT_CORPUS)


def _common(key: str, value: str, name: str) -> str:
    return (f"SELECT theme, model, string_agg({value} || ' (' || CAST(cnt AS VARCHAR) || ')', ' | ' ORDER BY rank) AS {name} "
            f"FROM ({_over_report(key)}) GROUP BY theme, model")


_REPORT_BASE = _with(_REPORT_RESPONSES, BASE, _REPORT_CORPUS)

_REPORT_JACCARD = _REPORT_BASE + r"""
, tk AS (SELECT DISTINCT theme, model, row_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM corpus),
sz AS (SELECT theme, model, row_id, count(*) AS n FROM tk GROUP BY ALL),
pr AS (SELECT a.theme, a.model, a.row_id, b.row_id AS other, count(*) AS shared
       FROM tk a JOIN tk b ON a.theme = b.theme AND a.model = b.model AND a.w = b.w AND a.row_id <> b.row_id GROUP BY ALL),
mj AS (SELECT p.theme, p.model, p.row_id, max(shared / (x.n + y.n - shared)) AS m
       FROM pr p JOIN sz x ON x.theme = p.theme AND x.model = p.model AND x.row_id = p.row_id
                 JOIN sz y ON y.theme = p.theme AND y.model = p.model AND y.row_id = p.other GROUP BY ALL),
k AS (SELECT theme, model, count(*) AS k FROM corpus GROUP BY ALL)
SELECT theme, model, round(avg(d), 6) AS corpus_jaccard_diversity_mean, round(stddev_pop(d), 6) AS corpus_jaccard_diversity_std
FROM (SELECT c.theme, c.model, CASE WHEN k > 1 THEN 1 - coalesce(m, 0.0) END AS d
      FROM corpus c JOIN k USING (theme, model) LEFT JOIN mj USING (theme, model, row_id)) GROUP BY ALL"""

_REPORT_COSINE = _with(_REPORT_RESPONSES, BASE, _REPORT_CORPUS, _sparse("SELECT row_id, text FROM base", "row_id", 1 << 14)) + """
, held AS (SELECT c.theme, c.model, c.row_id, i, x FROM corpus c JOIN unit USING (row_id)),
dots AS (SELECT a.theme, a.model, a.row_id, b.row_id AS other, sum(a.x * b.x) AS c
         FROM held a JOIN held b ON a.theme = b.theme AND a.model = b.model AND a.i = b.i AND a.row_id <> b.row_id GROUP BY ALL),
best AS (SELECT theme, model, row_id, max(c) AS c FROM dots GROUP BY ALL),
k AS (SELECT theme, model, count(*) AS k FROM corpus GROUP BY ALL)
SELECT theme, model, round(avg(m), 6) AS corpus_semantic_similarity_mean, round(stddev_pop(m), 6) AS corpus_semantic_similarity_std
FROM (SELECT c.theme, c.model, CASE WHEN k > 1 THEN coalesce(b.c, 0.0) END AS m
      FROM corpus c JOIN k USING (theme, model) LEFT JOIN best b USING (theme, model, row_id)) GROUP BY ALL"""

_REPORT_ITEMS = _REPORT_BASE + f"""
, x AS (SELECT theme, model, regexp_extract_all(text, '{_EMOJI_CLASS}') AS e, regexp_extract_all(text, '{HASHTAG_RE}') AS h,
               regexp_extract_all(text, '{URL_RE}') AS u FROM corpus)
SELECT theme, model,
  count(*) FILTER (WHERE len(e) > 0) AS texts_with_emojis, count(*) FILTER (WHERE len(h) > 0) AS texts_with_hashtags,
  count(*) FILTER (WHERE len(u) > 0) AS texts_with_urls, CAST(sum(len(e)) AS BIGINT) AS n_emojis,
  CAST(sum(len(h)) AS BIGINT) AS n_hashtags, CAST(sum(len(u)) AS BIGINT) AS n_urls,
  array_to_string(list_sort(list_distinct(flatten(list(e)))), '') AS unique_emojis,
  len(list_distinct(flatten(list(h)))) AS n_distinct_hashtags, len(list_distinct(flatten(list(u)))) AS n_distinct_urls
FROM x GROUP BY theme, model"""

_REPORT_ENTITIES = ENTITIES[:ENTITIES.index(",\nnorm AS (")].replace("""items AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS row_id, 'm' || CAST(conv_id % 3 AS VARCHAR) AS model,
         message, response FROM dialogue)""", f"""{_REPORT_RESPONSES}, {BASE}, {_REPORT_CORPUS},
items AS (SELECT row_id, '' AS model, message, trim(response, ' "') AS response FROM responses)""") + """
, per AS (SELECT row_id, {cells}, count(*) FILTER (WHERE side = 'response') AS any_ FROM mentions GROUP BY row_id)
SELECT theme, model, count(*) FILTER (WHERE any_ > 0) AS responses_with_entities, {sums}
FROM corpus LEFT JOIN per USING (row_id) GROUP BY theme, model""".format(
    cells=", ".join(f"count(*) FILTER (WHERE side = '{s}' AND kind = '{k}') AS {k}s_{s}" for s in ("response", "message") for k in ("person", "organization")),
    sums=", ".join(f"CAST(coalesce(sum({k}s_{s}), 0) AS BIGINT) AS {k}s_{s}" for s in ("response", "message") for k in ("person", "organization")))

_REPORT_SENTIMENT = "SELECT theme, model, " + ", ".join(
    f"CAST(coalesce(sum(cnt) FILTER (WHERE sentiment = '{s}'), 0) AS BIGINT) AS sentiment_{s}" for s in ("positive", "neutral", "negative")) \
    + f" FROM ({_over_report('sentiment_counts')}) GROUP BY theme, model"


def _whole_report(where: str, columns: str) -> str:
    parts = [_over_report(k) for k in ("distinct_ngrams", "self_bleu", "distinct_sentence_starts", "sentence_shape", "text_length", "response_distinct2")]
    parts += [_REPORT_JACCARD, _REPORT_COSINE, _REPORT_ITEMS, _REPORT_ENTITIES, _REPORT_SENTIMENT,
              _common("top_sentence_starts", "start_text", "common_sentence_starts_3"), _common("top_sentences", "sentence", "common_sentences")]
    sql = f"SELECT {columns} FROM ({parts[0]}) AS t0"
    for i, part in enumerate(parts[1:], 1):
        sql += f"\nLEFT JOIN ({part}) AS t{i} USING (theme, model)"
    return f"{sql}\nWHERE {where}"


ORACLE["diversity_report"] = _whole_report("theme <> 'all'", "*")
ORACLE["diversity_report_by_model"] = _whole_report("theme = 'all'", "* EXCLUDE (theme)")
