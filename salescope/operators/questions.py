"""Classification of question logs: column expressions over a text column.

Every rule is a word list from the fixed values turned into one expression, so a
log of any size is labelled in a single pass without a join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions import fixed_values as fixed
from salescope.functions.text import contains_any, count_contained

_BLANKS = " \t\n\r\f\v"
_KINDS = list(fixed.QUESTION_WORDS)


def _staged(questions: DataFrame, text: str) -> DataFrame:
    """Lowered text and word scores as columns of their own.

    Each is used many times over; as columns they are computed once per row
    instead of being repeated inside every label expression.
    """
    lowered = questions.withColumns(
        {"_lower": F.lower(text), "_clean": F.lower(F.btrim(F.col(text), F.lit(_BLANKS)))}
    )
    scores = F.array(*[count_contained(F.col("_clean"), words) for words in fixed.QUESTION_WORDS.values()])
    return lowered.withColumn("_scores", scores)


def _mentions_column(columns: Sequence[str]) -> Column:
    """A data column by name, in singular or plural."""
    names = [c.lower() for c in columns]
    forms = [f for c in names for f in (c, c[:-1] if c.endswith("s") else c + "s")]
    return contains_any(F.col("_clean"), forms) if forms else F.lit(False)


def _question_type(columns: Sequence[str]) -> Column:
    """The type with most words, by priority on ties; irrelevant without any business sense."""
    best = F.array_max("_scores")
    # The first position of the maximum is the type of highest priority.
    winner = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.array_position("_scores", best) - 1).cast("int"))
    context = contains_any(F.col("_clean"), fixed.CONTEXT_WORDS) | _mentions_column(columns)
    by_words = F.when(best > 0, winner).when(context, "revenue_analysis").otherwise("irrelevant")
    return F.when(F.length("_clean") >= 3, by_words).otherwise("irrelevant")


def _confidence() -> Column:
    """Share of the winning type among all word hits; a ratio of hits to themselves says nothing."""
    hits = F.aggregate("_scores", F.lit(0), lambda total, n: total + n)
    return F.coalesce(F.round(F.array_max("_scores") / F.nullif(hits, F.lit(0)), 4), F.lit(0.0))


def _intent(words: Sequence[str]) -> Column:
    return F.coalesce(contains_any(F.col("_lower"), list(words)), F.lit(False))


def _period_label(text: Column, pattern: str, template: str) -> Column:
    """``template`` with its {n} filled from the first match of ``pattern``."""
    quarters = F.create_map(*[F.lit(x) for pair in fixed.QUARTER_NUMBERS.items() for x in pair])
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece == "{quarter}":
            parts.append(F.try_element_at(quarters, F.lower(F.regexp_extract(text, pattern, 1))))
        elif piece.startswith("{"):
            parts.append(F.regexp_extract(text, pattern, int(piece[1:-1])))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def first_period(text: Column) -> Column:
    """Label of the first period rule that matches; null without one.

    Half years and ranges are tried before a plain year, which would hide them.
    """
    rules = [("(?i)" + p, t) for p, t in fixed.PERIODS]
    return F.coalesce(*[F.when(text.rlike(p), _period_label(text, p, t)) for p, t in rules])


def all_periods(text: Column) -> Column:
    """Labels of every period in the text, in rule order, each once."""

    def labels(pattern: str, template: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda match: _period_label(match, pattern, template))

    listed = F.flatten(F.array(*[labels("(?i)" + p, t) for p, t in fixed.PERIODS]))
    return F.coalesce(F.array_distinct(listed), F.array().cast("array<string>"))


def _matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike("(?i)" + p) for p in patterns])


def _relevance(columns: Sequence[str]) -> Column:
    """Why a question is or is not taken: ``struct<relevant, reason>``."""
    lowered = F.col("_clean")
    spaceless = (F.length(lowered) > 15) & ~F.contains(lowered, F.lit(" "))
    words = sorted({w for c in columns for w in [c.lower(), *[p for p in c.lower().split("_") if len(p) > 2]]})
    named = contains_any(lowered, words) if words else F.lit(False)

    def verdict(relevant: bool, reason: str) -> Column:
        return F.struct(F.lit(relevant).alias("relevant"), F.lit(reason).alias("reason"))

    return (
        F.when(lowered.isNull() | (lowered == ""), verdict(True, "no_question"))
        .when(_matches_any(lowered, fixed.LINK_PATTERNS), verdict(False, "url"))
        .when(spaceless | _matches_any(lowered, fixed.NOISE_PATTERNS), verdict(False, "gibberish"))
        .when(F.length(lowered) < 3, verdict(False, "too_short"))
        .when(contains_any(lowered, fixed.SMALL_TALK), verdict(False, "small_talk"))
        .when(named, verdict(True, "column"))
        .when(contains_any(lowered, fixed.BUSINESS_WORDS), verdict(True, "business_word"))
        .when(_matches_any(lowered, fixed.BUSINESS_PHRASES), verdict(True, "business_phrase"))
        .otherwise(verdict(False, "not_business"))
    )


def _routing_type(text: str) -> Column:
    """Type used to route a question; comparisons and whys count only in long questions."""
    chain = F
    for kind, words in fixed.ROUTING_WORDS.items():
        test = contains_any(F.col("_lower"), words)
        chain = chain.when(test & (F.length(text) > fixed.COMPLEX_MIN_LENGTH) if kind == "complex" else test, kind)
    return chain.otherwise("simple")


Tools = Mapping[str, tuple[int, Sequence[str]]]


def with_tool(name: str, months: int = 0, words: Sequence[str] = (), tools: Tools = fixed.TOOLS) -> Tools:
    """The catalogue with one more tool; the given one is left as it is."""
    return {**tools, name: (months, list(words))}


def _eligible_tools(months: Column | int, tools: Tools) -> Column:
    """Tools a question asks for and the data is long enough for, in catalogue order."""
    available = F.lit(months) if isinstance(months, int) else months
    wanted = [
        F.when((available >= needed) & contains_any(F.col("_lower"), list(words)), F.lit(name))
        for name, (needed, words) in tools.items()
        if words
    ]
    return F.coalesce(F.array_compact(F.array(*wanted)), F.array().cast("array<string>"))


def recommended_tools(kind: Column) -> Column:
    """Base tools and those of the type, without repeats; unknown types count as revenue analysis."""
    lists = F.create_map(
        *[x for k, tools in fixed.TOOLS_BY_TYPE.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in tools]))]
    )
    chosen = F.coalesce(F.try_element_at(lists, kind), F.array(*[F.lit(t) for t in fixed.TOOLS_BY_TYPE["revenue_analysis"]]))
    return F.array_distinct(F.concat(F.array(*[F.lit(t) for t in fixed.BASE_TOOLS]), chosen))


def _keyword_plan() -> Column:
    """Plan from words alone: key figures first, charts last when there is more than that."""
    added = F.array_compact(
        F.array(*[F.when(contains_any(F.col("_lower"), words), F.lit(tool)) for words, tool in fixed.PLAN_WORDS])
    )
    base = F.array(F.lit("compute_kpis"))
    return F.when(F.size(added) > 0, F.concat(base, added, F.array(F.lit("visualization")))).otherwise(base)


def label_questions(
    questions: DataFrame,
    labels: Sequence[str] | None = None,
    columns: Sequence[str] = (),
    months: Column | int = 0,
    tools: Tools = fixed.TOOLS,
    text: str = "text",
) -> DataFrame:
    """The wanted labels of a question log, by default all of them.

    ``columns`` are the data's column names and ``months`` the history available.
    """
    makers = {
        "question_type": lambda: _question_type(columns),
        "confidence": _confidence,
        "period": lambda: first_period(F.col(text)),
        "periods": lambda: all_periods(F.col(text)),
        "forecast_intent": lambda: _intent(fixed.FORECAST_INTENT),
        "risk_intent": lambda: _intent(fixed.RISK_INTENT),
        "relevance": lambda: _relevance(columns),
        "routing_type": lambda: _routing_type(text),
        "tools": lambda: _eligible_tools(months, tools),
        "plan": _keyword_plan,
    }
    made = {label: makers[label]() for label in (labels or makers)}
    return _staged(questions, text).withColumns(made).drop("_lower", "_clean", "_scores")
