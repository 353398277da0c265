
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualitySettings:
    min_meaningful_length: int = 3
    max_dismissive_length: int = 50
    meaningful_suffix: str = "_is_meaningful"
    detail_suffix: str = "_response_detail"


@dataclass(frozen=True)
class TextSettings:
    force_phrases: bool = True
    unigram_whitelist: bool = True
    always_drop_unigrams: bool = True
    must_be_phrase: bool = True


@dataclass(frozen=True)
class KeywordSettings:
    use_fuzzy: bool = True
    fuzzy_threshold: float = 0.78
    min_accept_score: float = 0.85
    top_k: int = 3
    column_bonus: float = 0.25
    column_penalty: float = 0.20
    prefer_exact: bool = True
    phrase_first: bool = True
    allow_token_fallback: bool = True
    max_token_match_length: int = 30
    strict_columns: bool = False
    multi_label: bool = True
    delimiter: str = " | "
    include_dismissed: bool = True


@dataclass(frozen=True)
class SemanticSettings:
    similarity_threshold: float = 0.35
    top_k: int = 3
    sentiment_weight: float = 0.15
    delimiter: str = " | "
    bi_top_k: int = 15
    bi_threshold: float = 0.20
    pair_template: str = "{phrase}"


@dataclass(frozen=True)
class SentimentSettings:
    positive_threshold: float = 0.05
    negative_threshold: float = -0.05
    column_weights: dict[str, float] = field(default_factory=dict)
    skip_dismissed: bool = True
    dismissed_value: float | None = None


@dataclass(frozen=True)
class SegmentSettings:
    min_tokens: int = 3
    detect_contrast: bool = True
    fallback_to_whole_text: bool = True


@dataclass(frozen=True)
class SummarySettings:
    net_neutral_low: float = -0.1
    net_neutral_high: float = 0.1
    net_slight: float = 0.2
    net_strong: float = 0.5
    min_majority_pct: float = 0.5


@dataclass(frozen=True)
class FrequencySettings:
    keep_phrases_only: bool = True
    min_token_len: int = 3
    min_freq: int = 2
    display_phrases_with_spaces: bool = True
    use_processed: bool = True


@dataclass(frozen=True)
class AspectSettings:
    use_subtheme: bool = True
    input_mode: str = "pair"
    prompt_template: str = "aspect: {aspect} text: {text}"


@dataclass(frozen=True)
class OutputSettings:
    """Which tables a full job writes."""

    assignments: bool = True
    taxonomy_reports: bool = False
    sentiment: bool = True
    quality_report: bool = True
    null_text_details: bool = False
    audit: bool = False
    segments: bool = False
    segmented_analysis: bool = False
    segment_summary: bool = False
    aspects: bool = False
