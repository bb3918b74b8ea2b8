"""Options of searches, chunking and agent runs, with their defaults and checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

STRATEGIES = ("vector", "hybrid", "ensemble", "bm25")


@dataclass(frozen=True)
class SearchOptions:
    """k = 0 means the default, as callers of the search API expect."""

    k: int = 5
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    min_similarity: float = 0.0
    keyword_boosting: bool = True
    custom_stop_words: tuple[str, ...] = ()
    metric: str = "cosine"

    @property
    def limit(self) -> int:
        return self.k or 5


@dataclass(frozen=True)
class ChunkOptions:
    chunk_size: int = 512
    chunk_overlap: int = 50
    strategy: str | None = None
    preserve_structure: bool = True
    include_heading_metadata: bool = True
    custom_separators: tuple[str, ...] = ()


@dataclass(frozen=True)
class AgentOptions:
    enable_iterative_refinement: bool = True
    max_iterations: int = 3
    confidence_threshold: float = 0.7
    use_llm: bool = False
    retrieval_strategy: str = "hybrid"
    top_k: int = 5
    llm_model: str = "gpt-4o"
    workspace_context: str = ""
    planner: Callable[[str], dict | str | None] | None = field(default=None, compare=False)


#: Recommended chunk sizes by use.
RECOMMENDED_SIZES = {"qa": 500, "summarization": 2000, "search": 1000}


def check_top_k(top_k: int) -> int:
    """A whole number from 1 to 20."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 20:
        raise ValueError("topK must be an integer between 1 and 20")
    return top_k


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown retrieval strategy {strategy!r}; use one of {', '.join(STRATEGIES)}")
    return strategy
