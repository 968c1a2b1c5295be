"""Configuration: which accounts, brand words and word lists an engine run uses."""

from __future__ import annotations

from dataclasses import dataclass, field

from custvoice import fixed_values as fixed


@dataclass(frozen=True)
class Lexicon:
    """Word lists behind the lexical features.

    ``fold_keywords`` folds accents and case in the lists too.  It is off by
    default: texts are folded and the lists are not, so an accented keyword
    never matches and its unaccented twin in the list does the work.
    """

    strong_negative: tuple[str, ...] = fixed.STRONG_NEGATIVE
    weak_negative: tuple[str, ...] = fixed.WEAK_NEGATIVE
    praise: tuple[str, ...] = fixed.PRAISE
    complaint: tuple[str, ...] = fixed.COMPLAINT
    breakdown: tuple[str, ...] = fixed.BREAKDOWN_PHRASES
    urgency: tuple[str, ...] = fixed.URGENCY
    churn: tuple[str, ...] = fixed.CHURN
    topics: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(fixed.TOPICS))
    fold_keywords: bool = False


@dataclass(frozen=True)
class VoiceConfig:
    official_accounts: tuple[str, ...] = fixed.OFFICIAL_ACCOUNTS
    brand_keywords: tuple[str, ...] = fixed.BRAND_KEYWORDS
    lexicon: Lexicon = field(default_factory=Lexicon)
    # The enrichment reads the reply target from this column, the feed from in_reply_to.
    reply_column: str = "in_reply_to_status_id"


DEFAULT = VoiceConfig()
