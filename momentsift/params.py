"""Parameters of a search run, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    limit: int = 100
    candidates: int = 500
    sequence_candidates: int = 15_000
    rrf_k: int = 60
    window_sec: float = 10.0
    answer_cosine: float = 0.80
    cap_per_video: int | None = None
    frames_per_interval: int = 8
    default_milestones: int = 4
    box_confidence: float = 0.40
    neighbour_reach: int = 4
    text_reach_frames: int = 120
    repeats: int = 2
    #: Weight of each source; another source weighs 1.
    weights: dict[str, float] = field(default_factory=lambda: {"clip": 1.0, "ocr": 0.45, "ocr_fts": 0.6, "asr": 0.6})


DEFAULT = Params()
#: Time gaps are compared with this tolerance, so exactly one window apart is far enough.
EPSILON = 1e-9
