"""Profiles and classification of columns in SQL, for comparison with those in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .operators import classify, profile
from .plans.name_rules import ACTIONS, DIRECT_IDENTIFIERS, NAME_RULES
from .scan_sql import FACTS, RULES, strings

NORMALISED = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(\"column\", '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^\p{L}\p{N}]', '_', 'g'), '_')".replace('\\"', '"')


def whole(name: str) -> str:
    """Whether the value v as a whole is an identifier of the kind."""
    pattern, _, _, text, valid = RULES[name]
    own = re.sub(r"(?<![%\w])d(?!\w)", f"({text})", valid)
    return f"CASE WHEN regexp_full_match(v, '{pattern}') THEN {own} ELSE false END"


def profiles(columns: Iterable[tuple[str, str, str]]) -> str:
    """WITH clauses up to prof, a row for each (table, column, value) of columns."""
    parts = "\n  UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST({v} AS VARCHAR) AS v0 FROM {t}""" for t, c, v in columns)
    entities = list(dict.fromkeys(entity for entity, *_ in FACTS.values()))
    hits = ", ".join(f"{{'r': greatest({', '.join(f'count_if({whole(name)})' for name, (entity, *_) in FACTS.items() if entity == e)}) / nullif(count(v), 0), 'k': {k}, 'e': '{e}'}}" for k, e in enumerate(entities))
    return rf"""
WITH cols AS ({parts}),
val AS (SELECT "table", "column", nullif(trim(v0), '') AS v FROM cols),
sums AS (
  SELECT "table", "column", count(*) AS total, count(v) AS nn, count(DISTINCT v) AS kinds,
    coalesce(round(sum(len(regexp_replace(v, '[^0-9]', '', 'g'))) / sum(len(v)), 4), 0.0) AS digit_ratio, coalesce(round(sum(len(regexp_replace(v, '[^\p{{L}}]', '', 'g'))) / sum(len(v)), 4), 0.0) AS alpha_ratio,
    CASE WHEN count(v) = 0 THEN 'empty' WHEN bool_and(lower(v) IN ({strings(profile.BOOLEAN_WORDS)})) THEN 'boolean'
      WHEN bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}')) THEN 'date'
      WHEN bool_and(regexp_full_match(replace(v, ',', ''), '[+-]?[0-9]+([.][0-9]+)?')) THEN 'numeric' ELSE 'text' END AS inferred_type,
    list_filter([{hits}], lambda h: h.r >= {profile.LEAST_RATIO}) AS hits
  FROM val GROUP BY ALL
),
prof AS (
  SELECT *, kinds / nn AS card, list_sort(list_transform(hits, lambda h: {{'a': -h.r, 'k': h.k, 'e': h.e, 'r': round(h.r, 4)}}))[1] AS best FROM sums
)"""


def classified(columns: Iterable[tuple[str, str, str]], confidence: float | None = None) -> str:
    """WITH clauses up to cls. confidence: what an adjudicator says for every column in the review band, that it is PII."""
    limits = classify.Thresholds()
    rules = [(synonym, entity, category, weight) for synonyms, entity, category, weight in NAME_RULES for synonym in synonyms]
    known = ", ".join(f"({n}, '{s}', {repr(e) if e else 'NULL'}, '{c}', {w}::DECIMAL(12, 8))" for n, (s, e, c, w) in enumerate(rules))
    nudge = "0" if confidence is None else f"CASE WHEN score >= {limits.review} AND score < {limits.pii} THEN {round(limits.nudge * confidence, 8)} ELSE 0 END"
    actions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())
    return rf"""{profiles(columns)},
rule AS (SELECT * FROM (VALUES {known}) AS r(n, synonym, entity, category, weight)),
named AS (
  SELECT p.*, r.synonym, r.entity AS entity0, r.category AS hint0, r.weight AS w_name FROM prof p
  LEFT JOIN (SELECT "table", "column", min(n) AS n FROM prof, rule WHERE contains('_' || {NORMALISED} || '_', '_' || synonym || '_') GROUP BY ALL) USING ("table", "column") LEFT JOIN rule r USING (n)
),
seen AS (
  SELECT *, best.e AS best_entity, best.e = 'DATE_OF_BIRTH' AND coalesce(entity0, '') <> 'DATE_OF_BIRTH' AS weak FROM named
),
hint AS (
  SELECT *, coalesce(NOT weak AND best.r >= {limits.strong_ratio}, false) AS strong,
    coalesce(entity0, CASE WHEN NOT weak AND best.r >= {limits.strong_ratio} THEN best_entity END) AS entity,
    coalesce(hint0, CASE WHEN NOT weak AND best.r >= {limits.strong_ratio} THEN CASE WHEN best_entity IN ({strings(DIRECT_IDENTIFIERS)}) THEN 'PII_DIRECT' ELSE 'PII_QUASI' END END) AS hint
  FROM seen
),
told AS (
  SELECT *,
    CASE WHEN best_entity IS NOT NULL THEN round(CASE WHEN weak THEN 0.15 WHEN strong THEN 0.45 ELSE 0.2 END::DECIMAL(4, 2) * best.r::DECIMAL(8, 4), 4) END AS w_pattern,
    CASE WHEN nn < 20 THEN NULL WHEN card >= 0.95 AND inferred_type = 'text' AND entity IS NOT NULL THEN 'cardinality:unique'
      WHEN card >= 0.95 AND entity IS NULL AND inferred_type IN ('text', 'numeric') THEN 'cardinality:unique_unknown'
      WHEN card <= 0.05 AND hint = 'PII_QUASI' THEN 'cardinality:low_categorical' WHEN card <= 0.02 AND entity IS NULL AND hint IS NULL THEN 'cardinality:low' END AS shape,
    inferred_type = 'numeric' AND entity IS NULL AND hint IS NULL AS plain
  FROM hint
),
sign AS (
  SELECT "table", "column", 'name:' || synonym AS code, w_name::DOUBLE AS weight FROM told WHERE synonym IS NOT NULL
  UNION ALL SELECT "table", "column", CASE WHEN weak THEN 'pattern:date_weak' ELSE 'pattern:' || best_entity END, w_pattern::DOUBLE FROM told WHERE w_pattern IS NOT NULL
  UNION ALL SELECT "table", "column", shape, CASE shape WHEN 'cardinality:unique' THEN 0.15 WHEN 'cardinality:low' THEN -0.15 ELSE 0.1 END FROM told WHERE shape IS NOT NULL
  UNION ALL SELECT "table", "column", 'type:numeric', -0.1 FROM told WHERE plain
),
scored AS (
  SELECT t.*, coalesce(w, 0) AS score FROM told t
  LEFT JOIN (SELECT "table", "column", greatest(least(sum(weight::DECIMAL(14, 8)), 1), 0) AS w FROM sign GROUP BY ALL) USING ("table", "column")
),
moved AS (SELECT *, least(score + {nudge}, 1) AS final, {nudge} <> 0 AS heard FROM scored),
cat AS (
  SELECT *, final >= {limits.review} AND final < {limits.pii} AS review,
    CASE WHEN final >= {limits.pii} THEN coalesce(hint, 'PII_DIRECT')
      WHEN (final >= {limits.review} AND hint IS NOT NULL) OR (final >= {limits.pii * 0.5} AND coalesce(hint IN ('PII_QUASI', 'SENSITIVE'), false)) THEN hint ELSE 'NON_PII' END AS category
  FROM moved
),
cls AS (
  SELECT "table", "column", category, round(final, 4)::DOUBLE AS score, entity AS entity_type, review AS needs_review, CASE category {actions} END AS recommended_action, heard AS llm_adjudicated FROM cat
)
"""


ROLLED_UP = """SELECT "table", count(*) AS columns, CAST(count_if(category IN ('PII_DIRECT', 'SENSITIVE')) AS BIGINT) AS pii_columns, CAST(count_if(needs_review) AS BIGINT) AS review_columns,
  bool_or(needs_review) AS escalates, bool_or(category IN ('PII_DIRECT', 'SENSITIVE')) AS fails FROM cls GROUP BY "table\""""
