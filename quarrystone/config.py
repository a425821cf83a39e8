"""Settings, passed explicitly and never changed in place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the engine. Every operator takes what it needs as arguments; plans take one of these."""

    collection: str = "default_collection"
    embedding_dimensions: int = 64
    chunk_size: int = 450
    chunk_overlap: int = 90
    prepend_metadata: bool = False
    max_tree_levels: int = 2
    cluster_threshold: float = 0.5
    components_by_level: tuple[int, ...] = (10, 2)
    max_clusters: int = 15
    min_cluster_size: int = 3
    top_k: int = 10
    rrf_k: int = 60
    context_tokens: int = 1650
    embedding_batch_size: int = 100
    max_retries: int = 3
    summary_input_chars: int = 400_000
    translation_chars: int = 12_000
    price_per_million_tokens: float = 0.02

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap has to be at least 0 and below chunk_size")
        if self.max_tree_levels < 0 or self.top_k < 0 or not 0 < self.cluster_threshold <= 1:
            raise ValueError("a setting is out of range")

    def components(self, level: int) -> int:
        """Dimensions that a level (from 1) is reduced to; the last setting holds for all further levels."""
        return self.components_by_level[min(level, len(self.components_by_level)) - 1]
