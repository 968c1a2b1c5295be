"""Lexical features over the clean text.

The expressions take the folded text, and the keyword tests that are known
already, so that a keyword that several features ask for is looked for once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.config import Lexicon
from custvoice.functions.text import (
    any_keyword,
    has_keyword,
    keyword_points,
    lexical_text,
    live_keywords,
    shortest_keywords,
)

THANKS, APPLAUSE, TRAILING_DOTS = "merci", "bravo", "..."

FEATURE_COLUMNS = (
    "nlp_sentiment_score", "nlp_probable_complaint", "nlp_has_urgency",
    "nlp_has_resiliation_risk", "nlp_sarcasm_hint", "nlp_topics_list", "nlp_topics",
)

Known = Mapping[str, Column]


def _live(lexicon: Lexicon, words) -> list[str]:
    return live_keywords(words, lexicon.fold_keywords)


def asked_keywords(lexicon: Lexicon) -> Counter[str]:
    """How many features look for each keyword in every text."""
    asked = Counter((THANKS, APPLAUSE, TRAILING_DOTS))
    for words in (lexicon.strong_negative, lexicon.weak_negative, lexicon.praise):
        asked.update(_live(lexicon, words))
    any_of = [lexicon.complaint + lexicon.breakdown, lexicon.urgency, lexicon.churn]
    for words in [*any_of, *lexicon.topics.values()]:
        asked.update(shortest_keywords(_live(lexicon, words)))
    return asked


def with_known_keywords(df: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, Known]:
    """Look for keywords that several features share ahead of them."""
    asked = asked_keywords(lexicon)
    text = F.col("_lexical")
    # Columns of their own: tests inside a struct would be inlined, and so repeated.
    shared = {w: f"_known_{i}" for i, (w, times) in enumerate(asked.items()) if times > 1}
    tests = {name: has_keyword(text, word) for word, name in shared.items()}
    return df.withColumns(tests), {w: F.col(name) for w, name in shared.items()}


def sentiment_score(text: Column, lexicon: Lexicon = Lexicon(), known: Known = {}) -> Column:
    """2 per strong and 1 per weak negative word, -1 per word of praise."""
    return (
        keyword_points(text, _live(lexicon, lexicon.strong_negative), 2, known)
        + keyword_points(text, _live(lexicon, lexicon.weak_negative), 1, known)
        + keyword_points(text, _live(lexicon, lexicon.praise), -1, known)
    )


def topics(text: Column, lexicon: Lexicon = Lexicon(), known: Known = {}) -> Column:
    """Names of the topics with a keyword in the text, in the lexicon's order."""
    named = [
        F.when(any_keyword(text, _live(lexicon, words), known), F.lit(name))
        for name, words in lexicon.topics.items()
    ]
    return F.array_compact(F.array(*named))


def sarcasm_hint(text: Column, lexicon: Lexicon = Lexicon(), known: Known = {}) -> Column:
    """Thanks with trailing dots, or thanks or applause next to a strong negative word."""
    angry = any_keyword(text, _live(lexicon, lexicon.strong_negative), known)
    thanks = has_keyword(text, THANKS, known)
    applause = has_keyword(text, APPLAUSE, known)
    dots = has_keyword(text, TRAILING_DOTS, known)
    return (thanks & dots) | ((thanks | applause) & angry)


def has_urgency(text: Column, lexicon: Lexicon = Lexicon(), known: Known = {}) -> Column:
    return any_keyword(text, _live(lexicon, lexicon.urgency), known)


def has_churn_risk(text: Column, lexicon: Lexicon = Lexicon(), known: Known = {}) -> Column:
    return any_keyword(text, _live(lexicon, lexicon.churn), known)


def probable_complaint(
    text: Column, score: Column, lexicon: Lexicon = Lexicon(), known: Known = {}
) -> Column:
    words = _live(lexicon, lexicon.complaint) + _live(lexicon, lexicon.breakdown)
    return (score >= 2) | any_keyword(text, words, known)


def lexical_features(
    df: DataFrame, text_col: str = "text_clean", lexicon: Lexicon = Lexicon()
) -> DataFrame:
    """Add the seven ``nlp_*`` columns.

    The folded text is projected once, on its own, so that the keyword tests
    share it instead of folding the text again for each of them; then come the
    tests that several features share, and then the features.
    """
    if text_col not in df.columns:
        raise ValueError(f"text column '{text_col}' is missing")
    text = F.col("_lexical")
    folded = df.withColumn("_lexical", lexical_text(F.col(text_col)))
    tested, known = with_known_keywords(folded, lexicon)
    scored = tested.withColumns({
        "nlp_sentiment_score": sentiment_score(text, lexicon, known),
        "nlp_has_urgency": has_urgency(text, lexicon, known),
        "nlp_has_resiliation_risk": has_churn_risk(text, lexicon, known),
        "nlp_sarcasm_hint": sarcasm_hint(text, lexicon, known),
        "nlp_topics_list": topics(text, lexicon, known),
    })
    score = F.col("nlp_sentiment_score")
    return scored.withColumns({
        "nlp_probable_complaint": probable_complaint(text, score, lexicon, known),
        "nlp_topics": F.concat_ws(",", F.col("nlp_topics_list")),
    }).select(*[c for c in df.columns if c not in FEATURE_COLUMNS], *FEATURE_COLUMNS)
