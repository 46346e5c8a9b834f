"""Hooks for outside engines. Their answers only ever add findings or nudge scores; what can't be verified is dropped."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify

# Labels an engine may report, and the confidence that its word has.
MODEL_LABELS = ("PERSON_NAME", "ADDRESS", "ORGANIZATION", "DATE_OF_BIRTH")
MODEL_CONFIDENCE = 0.7
SENT_CHARS = 6000
#: Characters that a window of a long text has in common with the one before it: what is named and no longer is whole in one.
OVERLAP = 500
MODEL_FINDINGS = "array<struct<entity_type: string, start: int, end: int, confidence: double, recognizer: string>>"
VERDICT = "table string, column string, is_pii boolean, confidence double, rationale string"


# Words that an adjudicator's answer may use for yes and no.
SAID = dict.fromkeys(("true", "yes", "y", "1"), True) | dict.fromkeys(("false", "no", "n", "0"), False)


def entity_prompt(text: str) -> str:
    """What an engine is asked about a text."""
    return (
        f"List the personal data of these kinds in the text below: {', '.join(MODEL_LABELS)}.\n"
        'Answer with one JSON object and nothing else: {"entities": [{"type": kind, "text": words as they stand in the text}]}. '
        f'Copy the words exactly. If there are none, answer {{"entities": []}}.\n\nText:\n{text}\n'
    )


def column_prompt(summary: str) -> str:
    """What an adjudicator is asked about a column, of which it is told names and statistics only."""
    return (
        f"Does this database column hold personal data? Its profile, without any of its values: {summary}\n"
        'Answer with one JSON object and nothing else: {"is_pii": true or false, "confidence": 0 to 1, "rationale": one sentence}.\n'
    )


def first_object(raw: str) -> dict | None:
    """The JSON object that begins at an answer's first brace, whatever stands around it; None if that one doesn't parse."""
    try:
        return json.JSONDecoder().raw_decode(raw, raw.index("{"))[0]
    except ValueError:
        return None


def truth(value: object) -> bool | None:
    """True or false if the value says so; None for all else, so that a verdict is dropped rather than turned round."""
    return SAID.get(value.strip().lower()) if isinstance(value, str) else bool(value) if isinstance(value, bool | int | float) else None


def share(value: object) -> float:
    """A confidence between 0 and 1; 0.5 for what is no number, 0 for the number that is none."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return 0.5
    return 0.0 if math.isnan(number) else min(1.0, max(0.0, number))


def occurrences(text: str, part: str) -> list[tuple[int, int]]:
    """Spans of all verbatim occurrences that don't overlap; none for a blank part."""
    return [m.span() for m in re.finditer(re.escape(part), text)] if part.strip() else []


def entities(raw: str, text: str, engine: str) -> list[dict]:
    """Every verbatim occurrence of what an answer names, with its span; what the text doesn't hold is dropped."""
    named = (first_object(raw or "") or {}).get("entities")
    known = [(e["type"], str(e.get("text", ""))) for e in named if isinstance(e, dict) and e.get("type") in MODEL_LABELS] if isinstance(named, list) else []
    spans = {at: kind for kind, part in reversed(known) for at in occurrences(text, part)}  # of two kinds for a span the first one named
    return [{"entity_type": kind, "start": a, "end": b, "confidence": MODEL_CONFIDENCE, "recognizer": engine} for (a, b), kind in spans.items()]


def verdict(raw: str) -> tuple[bool, float, str] | None:
    """(is_pii, confidence, rationale), or None if the answer doesn't say whether the column is personal."""
    answer = first_object(raw or "") or {}
    is_pii = truth(answer.get("is_pii"))
    return None if is_pii is None else (is_pii, share(answer.get("confidence", 0.5)), str(answer.get("rationale", ""))[:500])


def windows(text: str) -> list[str]:
    """The whole text in overlapping windows of SENT_CHARS."""
    return [text[k : k + SENT_CHARS] for k in range(0, max(1, len(text) - OVERLAP), SENT_CHARS - OVERLAP)]


def ask_for_entities(text: Column, make: Callable[[], Callable[[str], str]], engine: str) -> Column:
    """Findings of an engine for a text column. make() builds the engine once a worker; any failure of it is no finding.

    A long text is asked about window by window; what is named in any of them is looked up in the whole text.
    """

    @F.pandas_udf(MODEL_FINDINGS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = make()
        for texts in batches:
            out = []
            for t in texts:
                spans: dict[tuple[int, int], dict] = {}
                for part in windows(t) if t else []:
                    try:
                        for e in entities(ask(part), t, engine):
                            spans.setdefault((e["start"], e["end"]), e)
                    except Exception:  # an engine that is away must not stop a scan
                        continue
                out.append(list(spans.values()))
            yield pd.Series(out)

    return run(text)


def ask_for_verdicts(review: DataFrame, make: Callable[[], Callable[[str, str, str], str]]) -> DataFrame:
    """Verdicts for the columns in review (table, column, summary): the only rows an adjudicator ever sees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    v = verdict(ask(r.table, r.column, r.summary))
                except Exception:  # see above
                    v = None
                if v:
                    rows.append((r.table, r.column, *v))
            yield pd.DataFrame(rows, columns=["table", "column", "is_pii", "confidence", "rationale"])

    return review.select("table", "column", "summary").mapInPandas(run, VERDICT)


def adjudicate(profiles: DataFrame, make: Callable[[], Callable[[str, str, str], str]], limits: classify.Thresholds = classify.Thresholds()) -> DataFrame:  # noqa: B008
    """Classifies columns, asks an adjudicator about those in the review band only, and classifies again with what it says.

    The answer is a column beside the profile, so nothing is joined. Every action on the result asks again: persist it, a row for
    each column, if several read it.
    """

    @F.pandas_udf("struct<is_pii: boolean, confidence: double, rationale: string>")
    def said(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        ask = make()
        for review, tables, columns, summaries in batches:
            rows = []
            for wanted, *what in zip(review, tables, columns, summaries, strict=True):
                try:
                    v = verdict(ask(*what)) if wanted else None
                except Exception:  # see above
                    v = None
                rows.append(v or (None, None, None))
            yield pd.DataFrame(rows, columns=["is_pii", "confidence", "rationale"]).astype({"is_pii": "boolean", "confidence": "float64", "rationale": "object"})

    first = classify.classify(profiles, limits=limits)
    asked = first.select(*profiles.columns, said("needs_review", "table", "column", classify.facts()).alias("_verdict"))
    return classify.classify(asked, limits=limits, verdict_col="_verdict")
