"""Every threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # page quality
    min_page_text_length: int = 25
    quality_ocr_threshold: float = 0.35
    fallback_quality_threshold: float = 0.45
    # chunking
    leaf_max_chars: int = 1600
    overlap_ratio: float = 0.10
    cover_page_max: int = 2
    min_section_chars: int = 40
    # embedding requests
    embed_batch: int = 100
    # lexicon
    lexicon_min_terms: int = 8
    feedback_min_score: float = 0.22
    cover_max_pages: int = 3
    # retrieval
    chat_min_score: float = 0.25
    extraction_min_score: float = 0.18
    chat_top_k: int = 8
    extraction_top_k: int = 12
    hybrid_top_k: int = 16
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    # feedback
    finetune_threshold: int = 50
    finetune_epochs: int = 3
    finetune_cost_per_million: float = 3.0
    finetune_max_cost: float = 5.0
    # jobs
    stale_minutes: int = 30
    max_retries: int = 3
    # layout of stored tables
    doc_buckets: int = 256

    @property
    def overlap_chars(self) -> int:
        return max(100, int(self.leaf_max_chars * self.overlap_ratio))


DEFAULT = Config()


@dataclass(frozen=True)
class Limits:
    """Where texts and lists are cut. Every field is None by default and then cuts nothing; a caller whose prompts,
    columns or reports have a given size says so."""

    # lexicon
    cover_chunks: int | None = None
    cover_chars: int | None = None
    mined_terms: int | None = None
    lexicon_terms: int | None = None
    novel_terms: int | None = None
    display_chars: int | None = None
    top_hits: int | None = None
    hit_terms: int | None = None
    query_terms: int | None = None
    # chunks and pages
    parent_chars: int | None = None
    fallback_chars: int | None = None
    title_chars: int | None = None
    table_key_chars: int | None = None
    embed_chars: int | None = None
    block_chars: int | None = None
    # feedback
    value_chars: int | None = None
    comment_chars: int | None = None
    context_chars: int | None = None
    term_value_chars: int | None = None
    term_exact_chars: int | None = None
    term_source_chars: int | None = None
    term_chars: int | None = None
    hint_wrong_chars: int | None = None
    hint_right_chars: int | None = None
    hint_note_chars: int | None = None
    hint_key_chars: int | None = None
    hints: int | None = None
    hint_lookback: int | None = None
    listed_context_chars: int | None = None
    # field table
    merged_values: int | None = None
    merged_chars: int | None = None
    description_chars: int | None = None
    # reports
    problem_fields: int | None = None
    error_codes: int | None = None
    trend_days: int | None = None
    recent_corrections: int | None = None
    note_value_chars: int | None = None
    note_reason_chars: int | None = None
    note_pieces: int | None = None
    note_fields: int | None = None
    notes: int | None = None
    audit_values: int | None = None
    # intake and conversations
    filename_chars: int | None = None
    reference_chars: int | None = None
    error_chars: int | None = None
    followup_chars: int | None = None
    followups: int | None = None
    session_title_chars: int | None = None


UNCUT = Limits()
