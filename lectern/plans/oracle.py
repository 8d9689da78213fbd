"""Equivalent DuckDB SQL for the registered queries, written without sharing their logic.

Where the Spark side counts with one regular expression, this side splits and
inspects the pieces; where it merges bounded blocks, this side concatenates.
"""

from __future__ import annotations

# Fixed value: Python's whitespace, as an RE2 class body without the newline.
_WS = (
    r"\t\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_FEATURES = (
    "words", "characters", "sentences", "fk_grade", "equation_count", "example_count",
    "lexical_diversity", "duration_seconds",
)
_ROUNDED = ("fk_grade", "lexical_diversity", "duration_seconds")


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{_WS}\\n]+', ''), '[{_WS}\\n]+$', '')"


def _normalize(x: str) -> str:
    once = f"regexp_replace({x}, '([0-9])[,{_WS}\\n]([0-9])', '\\1\\2', 'g')"
    return f"regexp_replace({once}, '([0-9])[,{_WS}\\n]([0-9])', '\\1\\2', 'g')"


_SYLLABLES = """
list_sum(list_transform(
  list_transform(ws, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')),
  lambda z: CASE WHEN z = '' THEN 0
    WHEN z LIKE '%e' AND len(regexp_extract_all(z, '[aeiouy]+')) > 1
      THEN len(regexp_extract_all(z, '[aeiouy]+')) - 1
    ELSE greatest(1, len(regexp_extract_all(z, '[aeiouy]+'))) END))
"""


def _features(source: str = "documents") -> str:
    """CTEs ending in ``f``: one row per document with all features."""
    return f"""
WITH pieces AS (
  SELECT doc_id, source, lang, text,
         regexp_extract_all(text, '[A-Za-z0-9'']+') AS ws,
         regexp_split_to_array(text, '[.!?\\n]+') AS ps,
         regexp_extract_all(lower(text), '[a-z]+') AS toks
  FROM {source}),
counts AS (
  SELECT doc_id, source, lang,
         len(ws)::BIGINT AS words, length(text)::BIGINT AS characters,
         len(list_filter(ps, lambda s: regexp_matches(s, '[^{_WS}\\n]')))::BIGINT AS sentences,
         coalesce({_SYLLABLES}, 0)::BIGINT AS syllables,
         len(list_filter(ps, lambda s: contains(s, '=')
             AND regexp_matches(replace(s, '=', ''), '[0-9+*/-]')))::BIGINT AS equation_count,
         1::BIGINT AS example_count,
         CASE WHEN len(toks) = 0 THEN 0.0
              ELSE len(list_distinct(toks))::DOUBLE / len(toks) END AS lexical_diversity
  FROM pieces),
f AS (
  SELECT *,
         CASE WHEN words > 0 AND sentences > 0 THEN
           0.39::DOUBLE * (words::DOUBLE / sentences) + 11.8::DOUBLE * (syllables::DOUBLE / words)
           - 15.59::DOUBLE END AS fk_grade,
         60.0::DOUBLE * words / 220.0::DOUBLE AS duration_seconds,
         CASE WHEN words = 0 OR sentences = 0 THEN 'empty_text' END AS error
  FROM counts)
"""


_FEATURE_ROWS = """
SELECT doc_id, source, lang, words, characters, sentences, equation_count, example_count, syllables,
       round(fk_grade, 6) AS fk_grade, round(lexical_diversity, 6) AS lexical_diversity,
       round(duration_seconds, 6) AS duration_seconds, error
FROM f
"""

_CELLS = (
    _features()
    + ", cells AS (SELECT source, lang, "
    + ", ".join(f"avg({f}::DOUBLE) AS {f}" for f in _FEATURES)
    + " FROM f GROUP BY source, lang)"
)

_DELTAS = " UNION ALL ".join(
    f"""SELECT o.source, o.lang, '{f}' AS feature, round(o.{f} - a.{f}, 6) AS delta,
       CASE WHEN a.source IS NULL THEN 'no_anchor' END AS error
FROM cells o LEFT JOIN cells a ON a.source = o.source AND a.lang = 'en' WHERE o.lang <> 'en'"""
    for f in _FEATURES
)

_SMDS = (
    _CELLS
    + ", smds AS ("
    + " UNION ALL ".join(
        f"""SELECT o.lang, '{f}' AS feature, a.n AS n_anchor, o.n AS n,
       CASE WHEN a.n >= 10 AND o.n >= 10 AND a.v + o.v <> 0
            THEN (a.m - o.m) / sqrt((a.v + o.v) / 2) END AS smd,
       CASE WHEN a.n < 10 OR o.n < 10 THEN 'min_units'
            WHEN a.v + o.v = 0 THEN 'zero_pooled_deviation' END AS error
FROM (SELECT lang, count({f}) AS n, avg({f}) AS m, var_samp({f}) AS v FROM cells GROUP BY lang) o,
     (SELECT count({f}) AS n, avg({f}) AS m, var_samp({f}) AS v FROM cells WHERE lang = 'en') a
WHERE o.lang <> 'en'"""
        for f in _FEATURES
    )
    + ")"
)

_GUARD = " UNION ALL ".join(
    f"""SELECT o.source, '{f}' AS feature, a.n AS n_anchor, o.n AS n,
       round(CASE WHEN a.n >= 50 AND o.n >= 50 THEN (a.m - o.m) / sqrt((a.v + o.v) / 2) END, 6) AS smd,
       CASE WHEN a.n < 50 OR o.n < 50 THEN 'min_units' END AS error
FROM (SELECT source, count({f}) AS n, avg({f}) AS m, var_samp({f}) AS v FROM f GROUP BY source) o,
     (SELECT count({f}) AS n, avg({f}) AS m, var_samp({f}) AS v FROM f WHERE source = 'src0') a
WHERE o.source <> 'src0'"""
    for f in ("words", "fk_grade")
)

_VECTOR = ("words", "sentences", "lexical_diversity", "fk_grade")
_COVARIANCE = " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(covar_samp({a}, {b}), 4) AS covariance,
       count(*) AS n FROM f WHERE fk_grade IS NOT NULL"""
    for i, a in enumerate(_VECTOR)
    for b in _VECTOR[i:]
)

# Closed-form inverse of the symmetric 3 x 3 covariance matrix.
_MAHALANOBIS = (
    _CELLS
    + """, m AS (
  SELECT covar_samp(words, words) AS a, covar_samp(words, sentences) AS b,
         covar_samp(words, lexical_diversity) AS c, covar_samp(sentences, sentences) AS d,
         covar_samp(sentences, lexical_diversity) AS e,
         covar_samp(lexical_diversity, lexical_diversity) AS g FROM cells),
i AS (SELECT *, a*(d*g-e*e) - b*(b*g-c*e) + c*(b*e-c*d) AS det FROM m)
SELECT o.source, o.lang, round(sqrt((
    x*x*(d*g-e*e) + y*y*(a*g-c*c) + z*z*(a*d-b*b)
    + 2*x*y*(c*e-b*g) + 2*x*z*(b*e-c*d) + 2*y*z*(b*c-a*e)) / det), 6) AS distance,
  CASE WHEN x IS NULL THEN 'incomplete_vector' END AS error
FROM (SELECT o.source, o.lang, o.words - a.words AS x, o.sentences - a.sentences AS y,
             o.lexical_diversity - a.lexical_diversity AS z
      FROM cells o LEFT JOIN cells a ON a.source = o.source AND a.lang = 'en'
      WHERE o.lang <> 'en') o, i
"""
)

_LINES = """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / l_quantity AS p,
         p_retailprice AS v, o_totalprice AS fc
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)
"""


def _line(value: str, *guards: tuple[str, str]) -> str:
    error = " ".join(f"WHEN {cond} THEN '{code}'" for code, cond in guards)
    return (
        _LINES
        + f"""SELECT l_orderkey, l_linenumber,
       CASE WHEN {' OR '.join(c for _, c in guards)} THEN NULL ELSE {value} END AS expected,
       CASE {error} END AS error FROM lines"""
    )


_NEG, _MARGIN = ("negative_fixed_costs", "fc < 0"), ("non_positive_margin", "p <= v")

_PARTS = """
WITH base AS (
  SELECT *, CASE WHEN p_partkey % 13 = 0 THEN -(p_retailprice * 100.0::DOUBLE)
                 ELSE p_retailprice * 100.0::DOUBLE END AS fc,
         p_retailprice AS p, p_size * 20.0::DOUBLE AS v, p_size - 1.0::DOUBLE AS q,
         p_retailprice * 10.0::DOUBLE AS t,
         CASE WHEN p_partkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slip
  FROM part),
formulas AS (
  SELECT *, fc / nullif(p - v, 0) AS beq, fc / nullif(p - v, 0) * p AS ber,
         (fc + t) / nullif(p - v, 0) AS tpq, fc / nullif(q, 0) + v AS pbq, (p - v) / p AS cmr,
         CASE WHEN fc < 0 THEN 'negative_fixed_costs' WHEN p <= v THEN 'non_positive_margin' END AS e_be,
         CASE WHEN fc < 0 THEN 'negative_fixed_costs' WHEN q <= 0 THEN 'non_positive_quantity' END AS e_pq,
         CASE WHEN p <= v THEN 'non_positive_margin' END AS e_cm
  FROM base)
"""
_PROBLEMS = (
    _PARTS
    + """, problems AS (
  SELECT p_partkey,
    CASE p_partkey % 6 WHEN 0 THEN 'break_even_quantity' WHEN 1 THEN 'break_even_revenue'
      WHEN 2 THEN 'target_profit_quantity' WHEN 3 THEN 'price_for_break_even_quantity'
      WHEN 4 THEN 'contribution_margin_ratio' ELSE 'no_such_validator' END AS validator,
    CASE p_partkey % 6 WHEN 0 THEN beq WHEN 1 THEN ber WHEN 2 THEN tpq WHEN 3 THEN pbq
      WHEN 4 THEN cmr END AS value,
    CASE p_partkey % 6 WHEN 0 THEN e_be WHEN 1 THEN e_be WHEN 2 THEN e_be WHEN 3 THEN e_pq
      WHEN 4 THEN e_cm ELSE 'unknown_validator' END AS error,
    slip
  FROM formulas),
checked AS (
  SELECT p_partkey, validator, coalesce(value, CASE WHEN validator = 'no_such_validator' THEN 0.0 END) + slip AS answer,
         CASE WHEN error IS NULL THEN value END AS expected, error
  FROM problems)
"""
)
_CLOSE = "abs({a} - {b}) <= greatest(1e-6::DOUBLE * greatest(abs({a}), abs({b})), 1e-6::DOUBLE)"

_UNIT_ROWS = (
    _PARTS
    + """, stated AS (
  SELECT 'part_' || p_partkey AS unit_id, 'canonical_problem' AS problem,
         'break_even_quantity' AS validator, beq + slip AS answer, beq AS value, e_be AS error,
         true AS expect_pass FROM formulas
  UNION ALL SELECT 'part_' || p_partkey, 'practice_problem', 'break_even_revenue', ber, ber, e_be, true FROM formulas
  UNION ALL SELECT 'part_' || p_partkey, 'near_transfer', 'target_profit_quantity', tpq, tpq, e_be, true FROM formulas
  UNION ALL SELECT 'part_' || p_partkey, 'far_transfer', 'price_for_break_even_quantity', pbq + slip, pbq, e_pq, true FROM formulas
  UNION ALL SELECT 'part_' || p_partkey, 'misconception_correctly_fails', 'break_even_quantity', fc / p, beq, e_be, false FROM formulas),
audit AS (
  SELECT unit_id, problem, validator, answer, CASE WHEN error IS NULL THEN value END AS expected,
         CASE WHEN error IS NULL THEN """
    + _CLOSE.format(a="answer", b="value")
    + """ END AS passed, error, expect_pass FROM stated),
audited AS (SELECT *, coalesce(passed = expect_pass, false) AS ok FROM audit)
"""
)

_TAIL_DOC = "lpad((doc_id % 1000)::VARCHAR, 3, '0')"
_TRANSCRIPTS = f"""
WITH raw_lines AS (
  SELECT doc_id, source, lang,
         unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
lines AS (
  SELECT doc_id, source, i,
    CASE lang WHEN 'en' THEN 'traditional' WHEN 'fr' THEN 'ai_scaffolding' ELSE 'ai_substitution' END AS condition,
    '1' || {_TAIL_DOC} AS final_answer,
    CASE i % 4 WHEN 0 THEN 'TUTOR' WHEN 2 THEN 'LEARNER' END AS speaker,
    CASE i % 4
      WHEN 0 THEN (CASE WHEN i % 12 = 0 THEN ' Hint: ' ELSE ' ' END)
        || (CASE WHEN i = 4 AND doc_id % 5 = 1 THEN {_TAIL_DOC} || ' it is. ' ELSE '' END)
        || (CASE WHEN i = 4 AND doc_id % 5 = 0 THEN 'It is 1,' || {_TAIL_DOC} || '. ' ELSE '' END)
        || line || (CASE WHEN i % 12 = 4 AND doc_id % 2 = 0 THEN '?' ELSE '' END)
      WHEN 2 THEN ' ' || line
        || (CASE WHEN i >= 6 AND doc_id % 5 <> 2 THEN ' I get 1,' || {_TAIL_DOC} ELSE '' END)
      ELSE line || (CASE WHEN i = 1 AND doc_id % 5 = 1 THEN ' so 1' ELSE '' END) END AS line
  FROM raw_lines),
turns AS (
  SELECT doc_id, any_value(source) AS source, any_value(condition) AS condition,
         any_value(final_answer) AS final_answer, i // 2 AS pos, any_value(speaker) AS speaker,
         {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text
  FROM lines GROUP BY doc_id, i // 2),
attempts AS (
  SELECT doc_id, any_value(source) AS source, any_value(condition) AS condition,
         any_value(final_answer) AS final_answer,
         min(pos) FILTER (speaker = 'LEARNER' AND regexp_matches(text, '[0-9]')) AS first
  FROM turns GROUP BY doc_id),
leaks AS (
  SELECT a.doc_id, a.first, a.source, a.condition,
    CASE WHEN a.first IS NOT NULL THEN contains(
      {_normalize("coalesce(string_agg(t.text, ' ' ORDER BY t.pos) FILTER (t.speaker = 'TUTOR' AND t.pos < a.first), '')")},
      a.final_answer) END AS leaked
  FROM attempts a JOIN turns t USING (doc_id)
  GROUP BY a.doc_id, a.first, a.source, a.condition, a.final_answer),
labels AS (
  SELECT doc_id, pos,
    CASE WHEN lower(text) LIKE 'hint:%' THEN 'hint' WHEN contains(text, '?') THEN 'guiding_question'
         ELSE 'answer_reveal' END AS label
  FROM turns WHERE speaker = 'TUTOR'),
sequences AS (
  SELECT doc_id, list(label ORDER BY pos) AS labels FROM labels GROUP BY doc_id),
policies AS (
  SELECT doc_id, source, condition, leaked,
    CASE condition
      WHEN 'ai_substitution' THEN coalesce(labels[2] = 'answer_reveal', false)
      WHEN 'ai_scaffolding' THEN list_contains(labels, 'guiding_question')
        AND len(list_filter(labels, lambda x: x = 'hint')) >= 2 AND coalesce(NOT leaked, false)
    END AS policy_ok
  FROM leaks JOIN sequences USING (doc_id))
"""

_TAIL_CONV = "lpad((conv_id % 1000)::VARCHAR, 3, '0')"
_TALKS = f"""
WITH talks AS (
  SELECT conv_id, turn AS pos, '1' || {_TAIL_CONV} AS final_answer,
    CASE role WHEN 'user' THEN 'LEARNER' WHEN 'assistant' THEN 'TUTOR' END AS speaker,
    CASE WHEN conv_id % 2 = 0 THEN 'ai_scaffolding' ELSE 'ai_substitution' END AS condition,
    CASE role
      WHEN 'user' THEN text
        || (CASE WHEN turn >= 4 AND conv_id % 5 <> 2 THEN ' I get 1,' || {_TAIL_CONV} ELSE '' END)
      WHEN 'assistant' THEN (CASE WHEN turn % 3 = 1 THEN 'Hint: ' ELSE '' END)
        || (CASE WHEN conv_id % 5 = 1 AND turn >= 2 THEN {_TAIL_CONV} || ' it is. ' ELSE '' END)
        || text || (CASE WHEN turn % 3 = 0 THEN '?' ELSE '' END)
        || (CASE WHEN conv_id % 5 = 0 AND turn <= 2 THEN ' It is 1,' || {_TAIL_CONV} ELSE '' END)
        || (CASE WHEN conv_id % 5 = 1 AND turn <= 2 THEN ' so 1' ELSE '' END)
      ELSE text END AS text
  FROM conversations),
spoken AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS idx
  FROM talks WHERE speaker IS NOT NULL),
firsts AS (
  SELECT conv_id, count(idx) AS n_turns,
         min(idx) FILTER (speaker = 'LEARNER' AND regexp_matches(text, '[0-9]')) AS first
  FROM (SELECT DISTINCT conv_id FROM talks) LEFT JOIN spoken USING (conv_id) GROUP BY conv_id),
tutored AS (
  SELECT conv_id, pos, condition,
    CASE WHEN lower({_strip('text')}) LIKE 'hint:%' THEN 'hint'
         WHEN contains(text, '?') THEN 'guiding_question' ELSE 'answer_reveal' END AS label
  FROM talks WHERE speaker = 'TUTOR')
"""

_FRONTED = """
WITH parts AS (
  SELECT doc_id, text, 'stimulus_id: ' || doc_id || chr(10) || 'unit_id: ' || source || chr(10)
         || 'condition: ' || lang AS ids FROM documents),
known AS (
  SELECT *, ids || chr(10) || 'variant: primary' || chr(10) || 'example_count: 1' || chr(10)
         || 'learner_error_scripted: TRUE' AS meta, chr(10) || text AS rest,
         '---' || chr(10) AS fence FROM parts),
content AS (
  SELECT doc_id, CASE doc_id % 10
    WHEN 0 THEN fence || meta || chr(10) || '---' || rest
    WHEN 1 THEN text
    WHEN 2 THEN fence || meta || rest
    WHEN 3 THEN fence || ids || chr(10) || 'no colon here' || chr(10) || '---' || rest
    WHEN 4 THEN fence || ' ' || chr(10) || '---' || rest
    WHEN 5 THEN fence || meta || chr(10) || 'variant: robustness_1' || chr(10)
      || 'variant: robustness_2' || chr(10) || '---' || rest
    WHEN 6 THEN replace(fence || meta || chr(10) || '---' || rest, chr(10), chr(13) || chr(10))
    WHEN 7 THEN fence || meta || chr(10) || 'unit_id: a:b: c' || chr(10) || '---' || rest
    WHEN 8 THEN ' --- ' || chr(10) || meta || chr(10) || chr(9) || '---  ' || chr(10) || chr(10) || rest
    ELSE fence || chr(10) || chr(10) || '  example_count :  1_000  ' || chr(10) || chr(10) || ids
      || chr(10) || '---' || rest END AS content
  FROM known),
lined AS (
  SELECT doc_id, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines
  FROM content),
""" + f"""
trimmed AS (SELECT *, list_transform(lines, lambda x: {_strip('x')}) AS ts FROM lined),
closed AS (SELECT *, list_position(ts[2:], '---') AS close FROM trimmed),
blocks AS (
  SELECT doc_id, ts[1] = '---' AS opened, close,
    list_filter(ts[2:close], lambda x: x <> '') AS meta,
    regexp_replace(regexp_replace(array_to_string(lines[close + 2:], chr(10)), '^\\n+', ''), '\\n+$', '') AS body
  FROM closed),
coded AS (
  SELECT *, CASE WHEN NOT opened THEN 'missing_opening' WHEN close IS NULL THEN 'missing_closing'
    WHEN len(list_filter(meta, lambda x: NOT contains(x, ':'))) > 0 THEN 'malformed_line'
    WHEN len(meta) = 0 THEN 'empty_front_matter' END AS error FROM blocks),
pairs AS (
  SELECT doc_id, i, {_strip("split_part(line, ':', 1)")} AS key,
         {_strip("line[strpos(line, ':') + 1:]")} AS value
  FROM (SELECT doc_id, unnest(meta) AS line, unnest(range(len(meta))) AS i FROM coded WHERE error IS NULL)),
keyed AS (SELECT doc_id, key, arg_max(value, i) AS value FROM pairs GROUP BY doc_id, key),
wide AS (
  SELECT doc_id,
    max(value) FILTER (key = 'stimulus_id') AS stimulus_id, max(value) FILTER (key = 'unit_id') AS unit_id,
    max(value) FILTER (key = 'condition') AS condition, max(value) FILTER (key = 'variant') AS variant,
    max(try_cast(replace(value, '_', '') AS BIGINT)) FILTER (key = 'example_count') AS example_count,
    bool_or(lower(value) = 'true') FILTER (key = 'learner_error_scripted') AS learner_error_scripted
  FROM keyed GROUP BY doc_id)
SELECT doc_id, error, stimulus_id, unit_id, condition, variant, example_count, learner_error_scripted,
  CASE WHEN error IS NULL THEN length(body)::BIGINT END AS body_chars,
  CASE WHEN error IS NULL THEN md5(body) END AS body_digest
FROM coded LEFT JOIN wide USING (doc_id)
"""

_INDEXED = _features() + """, indexed AS (
  SELECT source || '_' || lang || '_' || doc_id AS stimulus_id, source AS unit_id,
    CASE lang WHEN 'en' THEN 'traditional' WHEN 'fr' THEN 'ai_scaffolding' ELSE 'ai_substitution' END AS condition,
    'stimuli/' || doc_id AS text, 'text' AS modality, round(duration_seconds, 6) AS duration,
    words AS word_count, round(fk_grade, 6) AS readability, equation_count, example_count,
    CASE WHEN doc_id % 3 = 0 THEN 'primary' ELSE 'robustness_' || (doc_id % 3) END AS variant
  FROM f)
"""

ORACLE: dict[str, str] = {
    "text_features": _features() + _FEATURE_ROWS,
    "stream_features": _features() + _FEATURE_ROWS,
    "incremental_anti_load": _features(
        "(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
    )
    + _FEATURE_ROWS,
    "syllable_totals": _features() + "SELECT doc_id, syllables FROM f",
    "word_tokens": "SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9'']+'), ' ') AS tokens FROM documents",
    "word_onsets": """
SELECT doc_id, word_idx, word, round(60.0::DOUBLE * word_idx / 220.0::DOUBLE, 6) AS onset_s
FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS word_idx
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9'']+') AS ws FROM documents))
""",
    "number_normalize": f"""
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT doc_id, {_normalize("replace(text, '. ', ' 1,2,3 4' || chr(9) || '5, 6  7. ')")} AS t FROM documents)
""",
    "word_band_gate": f"""
SELECT doc_id, n_words, n_words BETWEEN 430 * 0.85 AND 430 * 1.15 AS in_band
FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[{_WS}\\n]+'), lambda x: x <> ''))::BIGINT AS n_words
      FROM documents)
""",
    "anchor_deltas": _CELLS + _DELTAS,
    "duration_caliper": _features()
    + """, a AS (SELECT source, avg(duration_seconds) AS d FROM f WHERE lang = 'en' GROUP BY source)
SELECT doc_id, f.source, lang, round(abs(duration_seconds - d) / nullif(d, 0), 6) AS relative_difference,
       0.1::DOUBLE AS tolerance, abs(duration_seconds - d) / nullif(d, 0) <= 0.1 AS passed,
       CASE WHEN d IS NULL THEN 'no_anchor' WHEN d = 0 THEN 'zero_anchor' END AS error
FROM f LEFT JOIN a USING (source) WHERE lang <> 'en'
""",
    "readability_spread": _CELLS
    + """SELECT source, count(fk_grade) AS n_conditions, round(max(fk_grade) - min(fk_grade), 6) AS spread,
       max(fk_grade) - min(fk_grade) > 1.0 AS flagged FROM cells GROUP BY source""",
    "smd_by_feature": _SMDS
    + "SELECT lang, feature, n_anchor, n, round(smd, 6) AS smd, error FROM smds",
    "smd_gate": _SMDS
    + """SELECT lang, count(smd) AS n_features, count(*) FILTER (smd IS NULL) AS n_refused,
       round(max(abs(smd)), 6) AS max_abs_smd, count(smd) > 0 AND coalesce(max(abs(smd)) < 0.1, false) AS matched
       FROM smds GROUP BY lang""",
    "smd_min_units_guard": _features() + _GUARD,
    "feature_covariance": _features() + _COVARIANCE,
    "mahalanobis_to_anchor": _MAHALANOBIS,
    "break_even_quantity": _line("fc / (p - v)", _NEG, _MARGIN),
    "break_even_revenue": _line("fc / (p - v) * p", _NEG, _MARGIN),
    "target_profit_quantity": _line("(fc + fc * 0.5::DOUBLE) / (p - v)", _NEG, _MARGIN),
    "price_for_break_even": _line(
        "fc / (l_quantity - 1) + v", _NEG, ("non_positive_quantity", "l_quantity - 1 <= 0")
    ),
    "contribution_margin_ratio": _line("(p - v) / p", _MARGIN, ("zero_price", "p = 0")),
    "margin_guard_violations": _LINES
    + "SELECT l_orderkey, l_linenumber, p AS price, v AS variable_cost FROM lines WHERE p <= v",
    "numeric_close": _LINES
    + """SELECT l_orderkey, l_linenumber,
       abs(p - v) <= greatest(0.05::DOUBLE * greatest(abs(p), abs(v)), 0.05::DOUBLE) AS close FROM lines""",
    "validator_dispatch": _PROBLEMS + "SELECT p_partkey, validator, expected, error FROM checked",
    "answer_check": _PROBLEMS
    + f"""SELECT p_partkey, validator, answer, expected,
       CASE WHEN error IS NULL THEN {_CLOSE.format(a='answer', b='expected')} END AS passed, error
FROM checked""",
    # Which formula equals price minus cost is stated, not computed.
    "authored_answers": """
WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS numeric, (p_partkey // 2) % 8 AS variant,
    p_retailprice <= p_size * 20 AS loss, p_partkey % 7 = 0 AS slip FROM part)
SELECT p_partkey, CASE WHEN numeric THEN 'contribution_margin_ratio' ELSE 'contribution_margin_expr' END AS validator,
  CASE WHEN numeric AND loss OR NOT numeric AND variant = 5 THEN NULL
       WHEN numeric THEN NOT slip ELSE variant IN (0, 1, 2, 4, 7) END AS passed,
  CASE WHEN numeric AND loss THEN 'non_positive_margin'
       WHEN NOT numeric AND variant = 5 THEN 'bad_formula' END AS error
FROM p""",
    "unit_answer_audit": _UNIT_ROWS
    + "SELECT unit_id, problem, validator, answer, expected, passed, error, ok FROM audited",
    "correctness_gate": _UNIT_ROWS
    + """SELECT problem, count(*) AS n, count(*) FILTER (ok) AS n_correct, count(error) AS n_errors,
       round(avg(ok::INT), 6) AS share,
       avg(ok::INT) >= CASE WHEN problem = 'canonical_problem' THEN 1.0 ELSE 0.99 END AS gate
FROM audited GROUP BY problem""",
    "formula_equivalence": _LINES
    + """, diffs AS (
  SELECT 'margin' AS formula, p - v AS a, -(v - p) AS b FROM lines
  UNION ALL SELECT 'ratio', (p - v) / p, 1 - v / p FROM lines
  UNION ALL SELECT 'quantity', fc / nullif(p - v, 0), fc / p FROM lines
  UNION ALL SELECT 'partial', CASE WHEN p > 1000 THEN p - v END, p - v FROM lines)
SELECT formula, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS points,
  count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS one_sided,
  count(*) FILTER ((a IS NULL) <> (b IS NULL) OR NOT ("""
    + _CLOSE.format(a="a", b="b")
    + """)) AS disagreements,
  count(*) FILTER ((a IS NULL) <> (b IS NULL) OR NOT ("""
    + _CLOSE.format(a="a", b="b")
    + """)) = 0 AS equivalent
FROM diffs GROUP BY formula""",
    "units_scan": _PARTS
    + """SELECT 'part_' || p_partkey AS unit_id, p_type AS domain, p_brand AS concept,
       (p_partkey % 5 + 1)::INT AS difficulty, len(string_split(p_name, ' ')) AS n_prerequisites,
       beq + slip AS reference_answer, fc / p AS wrong_answer, fc AS practice_fixed_costs,
       t AS target_profit, 'price_for_break_even_quantity' AS far_validator FROM formulas""",
    "units_index": _PARTS
    + """SELECT 'part_' || p_partkey AS unit_id, p_type AS domain, p_brand AS concept,
       (p_partkey % 5 + 1)::INT AS difficulty, replace(p_name, ' ', ';') AS prerequisites,
       'break_even_quantity' AS validator_reference, fc AS reference_fixed_costs,
       v AS reference_variable_cost, beq + slip AS reference_answer,
       'price_for_break_even_quantity' AS validator_transfer, q AS transfer_quantity,
       pbq + slip AS transfer_answer FROM formulas""",
    "front_matter_scan": _FRONTED,
    "front_matter_coerce": """
WITH v AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'False' WHEN 2 THEN doc_id::VARCHAR
  WHEN 3 THEN '-' || doc_id WHEN 4 THEN '1_000_' || doc_id WHEN 5 THEN '9999999999999999999' || doc_id
  WHEN 6 THEN source WHEN 7 THEN doc_id || '.0' WHEN 8 THEN '' ELSE '1__' || doc_id END AS raw FROM documents),
c AS (SELECT doc_id, raw, CASE lower(raw) WHEN 'true' THEN true WHEN 'false' THEN false END AS bool_val,
  CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+(_[0-9]+)*') THEN try_cast(replace(raw, '_', '') AS BIGINT) END AS long_val
  FROM v)
SELECT *, CASE WHEN bool_val IS NOT NULL THEN 'bool' WHEN long_val IS NOT NULL THEN 'int' ELSE 'string' END AS kind FROM c
""",
    "stimuli_index": _INDEXED + "SELECT * FROM indexed",
    "key_violations": _INDEXED
    + """SELECT unit_id, condition, variant, count(*) AS n_rows FROM indexed
GROUP BY unit_id, condition, variant HAVING count(*) > 1""",
    "fk_violations": """SELECT doc_id, count(*) AS n_rows FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""",
    "split_turns": _TRANSCRIPTS
    + "SELECT doc_id, pos, speaker, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM turns",
    "leakage_check": _TRANSCRIPTS
    + """SELECT doc_id, leaked, first AS first_attempt_turn_index,
       CASE WHEN first IS NULL THEN 'no_attempt' END AS error FROM leaks""",
    "turn_label_sequence": _TRANSCRIPTS
    + "SELECT doc_id, array_to_string(labels, ',') AS labels FROM sequences",
    "turn_policy_gate": _TRANSCRIPTS + "SELECT doc_id, condition, policy_ok FROM policies",
    "first_attempt": _TALKS
    + """SELECT conv_id, n_turns, first AS first_attempt_turn_index,
       CASE WHEN n_turns = 0 THEN 'no_turns' WHEN first IS NULL THEN 'no_attempt' END AS error FROM firsts""",
    "leakage_turn_table": _TALKS
    + f"""SELECT conv_id, CASE WHEN first IS NOT NULL THEN contains(
         {_normalize("coalesce(string_agg(" + _strip('text') + ", ' ' ORDER BY pos) FILTER (speaker = 'TUTOR' AND idx < first), '')")},
         any_value(final_answer)) END AS leaked, first AS first_attempt_turn_index,
       CASE WHEN n_turns = 0 THEN 'no_turns' WHEN first IS NULL THEN 'no_attempt' END AS error
FROM talks JOIN firsts USING (conv_id) LEFT JOIN (SELECT conv_id, pos, idx FROM spoken) USING (conv_id, pos)
GROUP BY conv_id, first, n_turns""",
    "turn_labels": _TALKS + "SELECT conv_id, pos, label FROM tutored",
    "turn_label_counts": _TALKS
    + """SELECT condition, count(*) FILTER (label = 'guiding_question') AS guiding_question,
       count(*) FILTER (label = 'hint') AS hint, count(*) FILTER (label = 'answer_reveal') AS answer_reveal
FROM tutored GROUP BY condition""",
    "parcel_means": """
SELECT vec_id, (i % 8)::BIGINT AS parcel, round(avg(x::DOUBLE), 6) AS mean_value
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
GROUP BY vec_id, i % 8
""",
    "vector_covariance": """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 8) + 0.0 AS covariance, count(*) AS n
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i
""",
    "decayed_totals": """
WITH r AS (SELECT user_id, value * length(event_type) AS g,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS later FROM events)
SELECT user_id, count(*) AS n_events,
  round(1.0 * pow(0.9::DOUBLE, count(*)) + sum(0.5::DOUBLE * g * pow(0.9::DOUBLE, later)), 6) AS state
FROM r GROUP BY user_id
""",
    "stream_distinct_texts": """
SELECT md5(text) AS digest, min(doc_id) AS doc_id, any_value(length(text)) AS n_chars
FROM documents WHERE text IS NOT NULL GROUP BY md5(text)
UNION ALL
SELECT NULL, doc_id, NULL FROM documents WHERE text IS NULL
""",
    "authored_unit_answers": """
WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || '.0'
    WHEN 1 THEN '12345678901234' || lpad((p_partkey % 100000)::VARCHAR, 5, '0')
    WHEN 2 THEN 'P - V' ELSE p_partkey::VARCHAR END AS answer_text FROM part)
SELECT 'part_' || p_partkey AS unit_id, try_cast(answer_text AS DOUBLE) AS answer, answer_text FROM a
""",
    "feature_map_deltas": """
WITH d AS (SELECT source || '/' || (doc_id % 7) AS unit, * FROM documents),
v AS (SELECT unit, lang, 'chars' AS feature, n_chars::DOUBLE AS x FROM d
  UNION ALL SELECT unit, lang, 'half', n_chars / 2.0::DOUBLE FROM d WHERE doc_id % 3 > 0
  UNION ALL SELECT unit, lang, 'long', (n_chars > 1000)::INT::DOUBLE FROM d WHERE doc_id % 2 = 1
  UNION ALL SELECT unit, lang, 'foreign', 1.5::DOUBLE FROM d WHERE lang <> 'en'),
c AS (SELECT unit, lang, feature, avg(x) AS x FROM v GROUP BY ALL),
a AS (SELECT * FROM c WHERE lang = 'en'),
o AS (SELECT DISTINCT unit, lang FROM d WHERE lang <> 'en')
SELECT c.unit, c.lang, c.feature, round(c.x - a.x, 6) + 0.0 AS delta, NULL::VARCHAR AS error
FROM c JOIN a ON a.unit = c.unit AND a.feature = c.feature WHERE c.lang <> 'en'
UNION ALL
SELECT unit, lang, NULL, NULL, 'no_anchor' FROM o WHERE unit NOT IN (SELECT unit FROM d WHERE lang = 'en')
""",
    "segment_onsets": """
WITH s AS (SELECT doc_id, text, unnest(range((length(text) + 199) // 200)) AS seq FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, seq::INT AS seq,
    len(regexp_extract_all(left(text, seq * 200), '[A-Za-z0-9'']+'))::BIGINT AS words_before,
    len(regexp_extract_all(left(text, seq * 200 + 200), '[A-Za-z0-9'']+'))::BIGINT AS upto FROM s)
SELECT doc_id, seq, words_before, upto - words_before AS n_words,
  CASE WHEN upto > words_before THEN round(60.0::DOUBLE * words_before / 220, 6) END AS onset_s FROM w
""",
    "decayed_trajectories": """
WITH RECURSIVE z AS (SELECT label, avg(embedding[1]::DOUBLE) AS factor FROM embeddings GROUP BY label),
g AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
    coalesce(0.5::DOUBLE * (value * factor), 0) AS x
  FROM events LEFT JOIN z ON user_id % 10 = label),
t AS (SELECT user_id, ts, event_id, step, 0.9::DOUBLE * 1.0 + x AS state FROM g WHERE step = 1
  UNION ALL
  SELECT g.user_id, g.ts, g.event_id, g.step, 0.9::DOUBLE * t.state + g.x
  FROM t JOIN g ON g.user_id = t.user_id AND g.step = t.step + 1)
SELECT user_id, ts, event_id, step, round(state, 6) + 0.0 AS state FROM t
""",
    "scenario_contrasts": """
WITH e AS (SELECT event_type, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events),
m AS (SELECT event_type, 'value' AS feature, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM e GROUP BY 1
  UNION ALL SELECT event_type, 'k', count(k), avg(k), var_samp(k) FROM e GROUP BY 1)
SELECT o.event_type, o.feature, a.n AS n_anchor, o.n AS n,
  round(CASE WHEN a.n >= 10 AND o.n >= 10 THEN (a.m - o.m) / sqrt((a.v + o.v) / 2) END, 6) AS smd,
  CASE WHEN a.n < 10 OR o.n < 10 THEN 'min_units' END AS error
FROM m o JOIN m a ON a.feature = o.feature AND a.event_type = 'click' WHERE o.event_type <> 'click'
""",
}

ORACLE["acceptance_summary"] = (
    _TRANSCRIPTS
    + ","
    + _features().strip().removeprefix("WITH")
    + ","
    + _PROBLEMS.strip().removeprefix("WITH")
    + f""", anchors AS (
  SELECT source, avg(duration_seconds) AS d, avg(fk_grade) AS g FROM f WHERE lang = 'en' GROUP BY source),
measured AS (
  SELECT doc_id, coalesce(abs(duration_seconds - d) / nullif(d, 0) <= 0.1, false) AS caliper_ok,
         abs(fk_grade - g) > 1.0 AS readability_flagged
  FROM f LEFT JOIN anchors USING (source) WHERE lang <> 'en'),
answers AS (
  SELECT p_partkey AS doc_id,
         coalesce(error IS NULL AND {_CLOSE.format(a='answer', b='expected')}, false) AS answers_ok
  FROM checked),
talked AS (
  SELECT doc_id, NOT (condition = 'ai_scaffolding' AND coalesce(leaked, false)) AS no_leak,
         coalesce(policy_ok, true) AS policy_ok
  FROM policies WHERE condition <> 'traditional')
SELECT doc_id, answers_ok, caliper_ok, no_leak, policy_ok, readability_flagged,
  answers_ok AND coalesce(caliper_ok, false) AND coalesce(no_leak, false)
    AND coalesce(policy_ok, false) AS accepted
FROM answers LEFT JOIN measured USING (doc_id) LEFT JOIN talked USING (doc_id)
"""
)

_UNIT_ANSWER = """(SELECT 1000 + (p_partkey - 1) % 1000 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END
  FROM part WHERE p_partkey = doc_id // 8 + 1)::VARCHAR"""
# The same transcripts about their unit's answer: eight documents in a row are one unit.
_UNIT_TALKS = _TRANSCRIPTS.replace(f"'1' || {_TAIL_DOC} AS final_answer", f"{_UNIT_ANSWER} AS final_answer").replace(
    _TAIL_DOC, "lpad((doc_id // 8 % 1000)::VARCHAR, 3, '0')"
)
ORACLE["dialogue_answers"] = (
    _UNIT_TALKS
    + f"""SELECT doc_id AS stimulus_id, 'unit_' || (doc_id // 8) AS unit_id, p.condition, {_UNIT_ANSWER} AS final_answer,
  p.leaked, policy_ok,
  CASE WHEN first IS NULL THEN 'no_attempt' WHEN {_UNIT_ANSWER} IS NULL THEN 'null_answer' END AS error
FROM policies p JOIN leaks l USING (doc_id) WHERE p.condition <> 'traditional'"""
)
ORACLE["unit_acceptance"] = (
    _UNIT_TALKS
    + ","
    + _features().strip().removeprefix("WITH")
    + f""", cells AS (
  SELECT doc_id // 8 AS u, lang = 'en' AS anchor, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS c,
         avg(duration_seconds) AS d, avg(fk_grade) AS g
  FROM f GROUP BY ALL),
matched AS (
  SELECT c.u, bool_and(c.anchor OR coalesce(abs(c.d - a.d) / nullif(a.d, 0) <= 0.1, false)) AS caliper_ok,
         max(c.g) - min(c.g) > 1.0 AS readability_flagged
  FROM cells c LEFT JOIN cells a ON a.u = c.u AND a.anchor GROUP BY c.u),
talked AS (
  SELECT doc_id // 8 AS u, NOT bool_or(condition = 'ai_scaffolding' AND coalesce(leaked, false)) AS no_leak,
         bool_and(coalesce(policy_ok, true)) AS policy_ok
  FROM policies WHERE condition <> 'traditional' GROUP BY 1),
stated AS (
  SELECT p_partkey - 1 AS u, 1000.0 + (p_partkey - 1) % 1000 AS goal, p_size::DOUBLE AS v, p_size + 10.0 AS q,
         CASE WHEN p_partkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS slip FROM part),
answers AS (
  SELECT u, {_CLOSE.format(a="(goal + slip)::DOUBLE", b="((goal - v) * q / q + v)::DOUBLE")} AS answers_ok FROM stated)
SELECT 'unit_' || u AS unit_id, answers_ok, caliper_ok, readability_flagged, no_leak, policy_ok,
  answers_ok AND coalesce(caliper_ok, false) AND coalesce(no_leak, false) AND coalesce(policy_ok, false) AS accepted
FROM answers LEFT JOIN matched USING (u) LEFT JOIN talked USING (u)"""
)
# The inverse by Gauss-Jordan elimination, one step per position, over lists of rows.
ORACLE["vector_mahalanobis"] = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY a.i, b.i),
beside AS (
  SELECT i, list(c ORDER BY j) || list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) AS r
  FROM c GROUP BY i),
steps(k, m) AS (
  SELECT 0::BIGINT, list(r ORDER BY i) FROM beside
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE
    WHEN i = k + 1 THEN list_transform(r, lambda z: z / r[k + 1])
    ELSE list_transform(list_zip(r, m[k + 1]), lambda p: p[1] - p[2] * r[k + 1] / m[k + 1][k + 1]) END)
  FROM steps WHERE k < len(m)),
inverse AS (SELECT list_transform(m, lambda r: r[len(m) + 1:]) AS v FROM steps WHERE k = len(m)),
goal AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(x) AS a FROM x WHERE label = 0 GROUP BY i)),
apart AS (
  SELECT vec_id, label, list_transform(list_zip(embedding, mu), lambda p: p[1]::DOUBLE - p[2]) AS d
  FROM embeddings, goal WHERE label <> 0)
SELECT vec_id, label, NULL::VARCHAR AS error,
  round(sqrt(list_sum(list_transform(v, lambda r, i: d[i] * list_inner_product(r, d)))), 6) AS distance
FROM apart, inverse
"""
