"""Document retrieval and answer evaluation as Spark table work.

Every operator takes and returns DataFrames.  Knowledge bases, questions and
cases are key columns, so one plan answers all of them at once.
"""

from docquarry.params import (
    AdmissionLimits,
    Bm25Params,
    ChunkParams,
    EvaluationProfile,
    RetrievalParams,
    UploadLimits,
)
from docquarry.session import build_session, scratch_dir, spread

__all__ = [
    "AdmissionLimits",
    "Bm25Params",
    "ChunkParams",
    "EvaluationProfile",
    "RetrievalParams",
    "UploadLimits",
    "build_session",
    "scratch_dir",
    "spread",
]
