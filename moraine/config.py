"""Settings of a retrieval pipeline."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

#: Other names under which a settings file may give them.
ALIASES = {"field_format": "format_strategy", "field_format_template": "format_template", "ncandidates_factor": "candidate_factor", "retrieve_top_k": "top_k", "kmeans_niters": "kmeans_iterations", "max_passages_per_doc_factor": "passages_per_doc", "doc_segmentation": "segmentation"}


@dataclass(frozen=True)
class Config:
    """One flat set of settings; checked when made."""

    dim: int = 128
    nbits: int = 2
    query_maxlen: int = 32
    doc_maxlen: int = 180
    mask_punctuation: bool = True
    task: str = "passage"
    segmentation: str = "none"
    passage_window: int = 180
    passage_stride: int = 90
    passages_per_doc: int = 4
    format_strategy: str = "title_body"
    format_template: str = "<title>{title}</title><body>{body}</body>"
    field_markers: dict = field(default_factory=dict)
    indexed_fields: list = field(default_factory=list)
    index_field_markers: bool = False
    index_special_tokens: bool = True
    nprobe: int = 2
    candidate_factor: int = 4096
    top_k: int = 1000
    nway: int = 64
    top_k_distill: int = 500
    kmeans_iterations: int = 20
    residual_sample: int = 100_000
    beir_doc_maxlen: int = 300
    lotte_doc_maxlen: int = 300
    beir_data_dir: str = "data/beir"
    lotte_data_dir: str = "data/lotte"
    output_dir: str = "experiments"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.nbits not in (1, 2, 4, 8):
            raise ValueError("nbits is 1, 2, 4 or 8")
        if not 0 < self.passage_stride <= self.passage_window:
            raise ValueError("the stride must be positive and at most the window")
        if min(self.dim, self.query_maxlen, self.doc_maxlen, self.nprobe, self.top_k, self.nway) < 1:
            raise ValueError("sizes must be positive")

    @property
    def n_candidates(self) -> int:
        return self.nprobe * self.candidate_factor

    def override(self, **changes) -> Config:
        return replace(self, **changes)

    @classmethod
    def load(cls, path: str) -> Config:
        """From YAML (or JSON where no YAML reader is installed); unknown keys are dropped."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml
        except ImportError:
            data = json.loads(text)
        else:
            data = yaml.safe_load(text)
        known = {f.name for f in fields(cls)}
        return cls(**{name: v for k, v in (data or {}).items() if (name := ALIASES.get(k, k)) in known})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)  # JSON is YAML

    def check_model(self, most: int) -> None:
        """Reject lengths above what the model's tokenizer takes."""
        if max(self.doc_maxlen, self.query_maxlen) > most:
            raise ValueError(f"the model takes at most {most} tokens")
