"""Configuration and row types."""

from __future__ import annotations

from dataclasses import dataclass

# Strategies, depths of a search, thresholds of the gates, and how close scores count as equal.
STRATEGIES = ("fixed", "heading", "recursive")
SEARCH_DEFAULTS = {"top_k": 5, "candidate_k": 20}
MIN_COSINE, MIN_RERANK = 0.64, 0.10
RECENCY_BAND = 0.05

#: Metadata every document has; anything else goes into the map ``extra``.
KNOWN_KEYS = ("document_id", "title", "doc_type", "effective_date", "source_url", "filename", "relpath")
DOCUMENT = ", ".join(f"{k} string" for k in KNOWN_KEYS) + ", extra map<string,string>, text string, page_breaks array<struct<start:int,page:int>>"


@dataclass(frozen=True)
class ChunkConfig:
    """How documents are cut: by windows, by headings, or by sections packed up to a size."""

    strategy: str = "recursive"
    chunk_size: int = 800
    overlap: int = 150

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        if self.chunk_size < 1 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("chunk_size is positive, and overlap less than it")

    @property
    def slug(self) -> str:
        return f"{self.strategy}_{self.chunk_size}_{self.overlap}"


# The configurations of a sweep.
SWEEP = (ChunkConfig("fixed", 300, 0), ChunkConfig("recursive", 300, 60), ChunkConfig("recursive", 800, 150), ChunkConfig("recursive", 1600, 200), ChunkConfig("heading", 2000, 0))


@dataclass(frozen=True)
class RetrievalParams:
    """Search settings; thresholds of None mean the defaults, any number (0 too) stands for itself."""

    top_k: int = SEARCH_DEFAULTS["top_k"]
    candidate_k: int = SEARCH_DEFAULTS["candidate_k"]
    rerank: bool = True
    prefer_recent: bool = True
    doc_type: str | None = None
    effective_on_or_after: str | None = None
    min_cosine: float | None = None
    min_rerank: float | None = None

    @property
    def cosine_gate(self) -> float:
        return MIN_COSINE if self.min_cosine is None else self.min_cosine

    @property
    def rerank_gate(self) -> float:
        return MIN_RERANK if self.min_rerank is None else self.min_rerank
