"""Operator parameters, passed explicitly (no shared mutable state)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RetrievalConfig:
    # retrieval (fixed values: the defaults of the reference behaviour)
    top_k: int = 5
    threshold: float = 0.3
    exact_boost: float = 0.40
    fuzzy_boost: float = 0.28
    fuzzy_min_len: int = 5
    cosine_overfetch: int = 3
    ivf_overfetch: int = 8
    minhash_overfetch: int = 4
    ivf_nprobe: int | None = None
    score_decimals: int = 6
    # synthesis
    max_output_sentences: int = 4
    sentence_cap: int = 2
    min_sentence_chars: int = 8
    relevance_threshold: float = 0.40
    restricted_vocabulary: bool = True
    dedup_threshold: float = 0.7
    # record layout
    text_fields: tuple[str, ...] = field(
        default=("lemma", "term", "title", "name", "content", "text", "definition")
    )
    key_fields: tuple[str, ...] = ("lemma", "id", "term")
    num_buckets: int = 16
    # the largest query matrix that is broadcast; vectors of one block beyond that (bytes)
    max_query_bytes: int = 64 << 20
    block_bytes: int = 32 << 20
    # the largest shortlist of fixed-width rows that a join may broadcast (bytes)
    max_broadcast_bytes: int = 64 << 20
