"""Settings of an assembly, states, and logging."""

from __future__ import annotations

import enum
import logging
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class AssemblerConfig:
    """Settings of an assembly; without a network file k-mers are embedded by their spectrum. Unknown keys of from_dict raise."""

    max_ntds_per_edge: int = 4096
    kmer_len: int = 64
    alphabet_len: int = 16
    work_queue_low_watermark: int = 4
    work_queue_high_watermark: int = 12
    knn_top_k: int = 40
    seqemb_onnx_path: str | None = None
    subgraph_join_threshold: float = 200.0

    @classmethod
    def from_dict(cls, values: dict) -> AssemblerConfig:
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)


class SequenceType(enum.Enum):
    UNINITIALISED = "uninitialised"
    RNA = "rna"
    DNA = "dna"
    AMINO_ACID = "aa"


class AssemblyState(enum.Enum):
    UNINITIALISED = 0
    IN_PROGRESS = 1
    COMPLETE = 2
    ABORTED = 3
    ERROR = 4


class AssemblySubState(enum.Enum):
    NONE = 0
    READS = 1
    EMBEDDING = 2
    CANDIDATES = 3
    SCORING = 4
    JOINING = 5


_LOG = logging.getLogger("kmerframe")


def log_level() -> str:
    return logging.getLevelName(_LOG.getEffectiveLevel())


def set_log_level(level: str) -> None:
    _LOG.setLevel(level.upper())
