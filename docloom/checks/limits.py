"""Sizes of the columns, prompts and reports that the checks compare."""

from docloom.config import Limits

# Column sizes, prompt budgets and lengths of lists.
L = Limits(
    cover_chunks=5, cover_chars=12000, mined_terms=40, lexicon_terms=60, novel_terms=30, display_chars=512, top_hits=6, hit_terms=12, query_terms=6,
    parent_chars=6000, fallback_chars=18000, title_chars=512, table_key_chars=200, embed_chars=9000, block_chars=4000,
    value_chars=2000, comment_chars=1000, context_chars=4000, term_value_chars=120, term_exact_chars=128, term_source_chars=80, term_chars=256,
    hint_wrong_chars=100, hint_right_chars=120, hint_note_chars=200, hint_key_chars=80, hints=8, hint_lookback=100, listed_context_chars=200,
    merged_values=20000, merged_chars=4000, description_chars=20000,
    problem_fields=15, error_codes=8, trend_days=14, recent_corrections=25, note_value_chars=60, note_reason_chars=80, note_pieces=6, note_fields=6, notes=5, audit_values=3,
    filename_chars=255, reference_chars=128, error_chars=2000, followup_chars=200, followups=4, session_title_chars=80,
)
