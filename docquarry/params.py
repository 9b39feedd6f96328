"""Typed job parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass


def _is_int(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


@dataclass(frozen=True)
class ChunkParams:
    size: int = 700
    overlap: int = 100

    def __post_init__(self):
        if not _is_int(self.size) or self.size <= 0:
            raise ValueError("chunk size must be a positive integer")
        if not _is_int(self.overlap) or self.overlap < 0:
            raise ValueError("chunk overlap must be a non-negative integer")
        if self.overlap >= self.size:
            raise ValueError("chunk overlap must be smaller than chunk size")


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class RetrievalParams:
    """Requested values; :meth:`clamped` applies the floor and ceiling rules."""

    top_n: int = 30
    rerank_candidates: int = 30
    rerank_top_k: int = 10
    fusion_threshold: float = 0.15
    mode: str = "auto"

    def clamped(self) -> RetrievalParams:
        top_k = max(1, int(self.rerank_top_k))
        return RetrievalParams(
            top_n=max(1, int(self.top_n)),
            rerank_candidates=max(top_k, int(self.rerank_candidates)),
            rerank_top_k=top_k,
            fusion_threshold=max(0.0, min(1.0, self.fusion_threshold)),
            mode=self.mode,
        )


@dataclass(frozen=True)
class UploadLimits:
    max_documents: int = 3
    max_file_bytes: int = 10 * 1024 * 1024
    max_total_bytes: int = 20 * 1024 * 1024


@dataclass(frozen=True)
class AdmissionLimits:
    max_characters: int = 2000
    max_questions: int = 5


@dataclass(frozen=True)
class EvaluationProfile:
    """Settings of one evaluation run."""

    profile_name: str
    profile_schema_version: int
    qa_data_path: str
    pdf_directory: str
    retrieval_mode: str
    chunk_size: int
    chunk_overlap: int
    retrieval_top_n: int
    fusion_threshold: float
    rerank_candidate_count: int
    rerank_top_k: int
    judge_model: str
    judge_threshold: float
    judge_reasoning_effort: str
    judge_max_retries: int
    judge_max_completion_tokens: int
    judge_request_interval_seconds: float
    judge_retry_base_delay_seconds: float
    judge_retry_max_delay_seconds: float
    judge_retry_jitter_seconds: float
    judge_max_retry_after_seconds: float
    generation_case_interval_seconds: float

    def as_dict(self) -> dict:
        return asdict(self)

    def chunking(self) -> ChunkParams:
        return ChunkParams(self.chunk_size, self.chunk_overlap)

    def retrieval(self) -> RetrievalParams:
        return RetrievalParams(
            self.retrieval_top_n,
            self.rerank_candidate_count,
            self.rerank_top_k,
            self.fusion_threshold,
            self.retrieval_mode,
        ).clamped()
