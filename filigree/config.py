"""Settings with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

_BOUNDS = {
    "chunk_max_chars": (600, 6000),
    "chunk_overlap": (0, 1000),
    "vector_top_k": (5, 100),
    "bm25_top_k": (5, 100),
    "rrf_k": (1, 1000),
    "candidate_pool": (5, 200),
    "rerank_top_k": (1, 20),
    "min_similarity": (0.0, 1.0),
    "max_query_chars": (50, 4000),
    "min_query_chars": (1, 50),
    "embed_batch_size": (1, 2048),
    "embed_max_retries": (0, 10),
    "generation_max_output_tokens": (256, 8000),
}


@dataclass(frozen=True)
class Settings:
    chunk_max_chars: int = 3000
    chunk_overlap: int = 300
    vector_top_k: int = 20
    bm25_top_k: int = 20
    rrf_k: int = 60
    candidate_pool: int = 30
    rerank_top_k: int = 8
    min_similarity: float = 0.35
    max_query_chars: int = 1000
    min_query_chars: int = 3
    embed_batch_size: int = 100
    embed_max_retries: int = 3
    generation_max_output_tokens: int = 6000
    embedding_model: str = "hashing-256"

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in _BOUNDS:
                low, high = _BOUNDS[f.name]
                if not low <= getattr(self, f.name) <= high:
                    raise ValueError(f"{f.name} must be from {low} to {high}")
        if self.chunk_overlap >= self.chunk_max_chars:
            raise ValueError("chunk_overlap must be less than chunk_max_chars")


SETTINGS = Settings()
