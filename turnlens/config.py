"""Settings of a detection and explanation run. Immutable: a plan depends on its arguments alone."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

SEED = 2025
CLS, SEP, PAD, MASK = "<cls>", "<sep>", "<pad>", "<mask>"
DA_SEP, SLOT_SEP, USER_MARK, SYSTEM_MARK = "<da_sep>", "<slot_sep>", "<usr>", "<sys>"
#: Which explanation, metric and model choices exist.
EXPLANATIONS = ("stii", "ig", "fs", "none")
METRICS = ("lor", "lsr", "fwlor", "fwlsr", "agg_o", "agg_s")
FUSIONS = ("concat", "max", "average")
ORDERINGS = ("absolute", "prediction")
MODALITIES = ("da", "utt", "dia")


@dataclass(frozen=True)
class Config:
    """``da_k`` and ``utt_k`` are counts of kept features; 0 keeps all that an explanation holds."""

    use_da_value: bool = False
    use_da_turn: bool = True
    da_explanation: str = "fs"
    utt_explanation: str = "fs"
    dia_explanation: str = "none"
    interaction_order: int = 1
    da_k: int = 0
    utt_k: int = 0
    fusion: str = "average"
    random_explanation: bool = False
    ordering: str = "absolute"
    metric: str = "fwlor"
    max_ngram: int = 1
    alpha: float = 0.5
    match_threshold: float = 0.9
    aopc_depth: int = 10
    perturbations: int = 200
    lasso_alpha: float = 0.001
    da_max_len: int = 256
    utt_max_len: int = 128
    dia_max_len: int = 384
    seed: int = SEED

    def __post_init__(self):
        for value, allowed in ((self.da_explanation, EXPLANATIONS), (self.utt_explanation, EXPLANATIONS), (self.dia_explanation, EXPLANATIONS), (self.fusion, FUSIONS), (self.ordering, ORDERINGS), (self.metric, METRICS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")

    def but(self, **changes) -> "Config":
        return replace(self, **changes)

    def key(self, only: tuple[str, ...] = ()) -> str:
        """A short name of exactly these settings, or ``only`` some of them, for artefacts."""
        settings = {k: v for k, v in asdict(self).items() if not only or k in only}
        return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
