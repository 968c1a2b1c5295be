"""Final verdict: the word rules correct the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvoice.functions.text import is_filled
from custvoice.functions.values import priority_name, priority_rank
from custvoice.sources.columns import pad_columns

COMPLAINT_SCORE = 2
SEVERE_SCORE = 3
CHURN_FLOOR = 3  # rank of "high"

# What a missing input column counts as.
INPUT_DEFAULTS = {
    "intent": "other",
    "complaint_type": "none",
    "sentiment": "neutral",
    "sarcasm": False,
    "priority": "none",
    "nlp_sentiment_score": 0,
    "nlp_probable_complaint": False,
    "nlp_has_urgency": False,
    "nlp_has_resiliation_risk": False,
    "nlp_sarcasm_hint": False,
    "nlp_topics": "",
}


def reconcile(df: DataFrame) -> DataFrame:
    """Add ``final_intent, final_complaint_type, final_priority, final_sentiment, final_sarcasm``.

    Reads only the classifier's and the lexical columns, so running it on its
    own output changes nothing.
    """
    padded = pad_columns(df, INPUT_DEFAULTS)
    score = F.col("nlp_sentiment_score")

    # A clearly negative text is a complaint, whatever the classifier said.  The
    # "other" verdict falls to the score alone, any other verdict needs the
    # complaint words as well.
    negative = score >= COMPLAINT_SCORE
    overruled = negative & (F.col("nlp_probable_complaint") | F.col("intent").eqNullSafe("other"))
    verdict = padded.withColumns({
        "final_intent": F.when(overruled, "complaint").otherwise(F.col("intent")),
        "final_sarcasm": F.coalesce(F.col("sarcasm"), F.lit(False)) | F.col("nlp_sarcasm_hint"),
    })

    complaint = F.col("final_intent").eqNullSafe("complaint")
    unspecific = F.col("complaint_type").isin("none", "other_complaint")
    with_topic = unspecific & is_filled(F.col("nlp_topics"))
    rank = priority_rank(F.col("priority"))
    raised = (
        F.when(F.col("nlp_has_resiliation_risk"), F.greatest(rank, F.lit(CHURN_FLOOR)))
        .otherwise(rank)
        + F.col("nlp_has_urgency").cast("int")
        + (score >= SEVERE_SCORE).cast("int")
    )
    mocking = F.col("final_sarcasm") & (F.col("sentiment") == "positive")
    return verdict.withColumns({
        "final_complaint_type": F.when(~complaint, "none")
        .when(with_topic, F.substring_index(F.col("nlp_topics"), ",", 1))
        .otherwise(F.col("complaint_type")),
        "final_sentiment": F.when(mocking, "negative").otherwise(F.col("sentiment")),
        "final_priority": F.when(complaint, priority_name(raised)).otherwise("none"),
    })
