"""Engine settings: defaults, and a JSON file that overrides them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Work bounds and thresholds (fixed values)."""

    concurrency: int = 6
    requests_per_second: float = 1.0
    retries: int = 4
    backoff_base: float = 0.75
    queue_batch: int = 400
    search_candidates: int = 250
    search_results: int = 200
    semantic_threshold: float = 0.62
    embedding_chars: int = 12000
    chunk_size: int = 2500
    chunk_overlap: int = 250
    fuzzy_enabled: bool = True
    query: str = ""
    keywords: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    allow_offsite: bool = False
    storage_layout: str = "flat"
    ner_engine: str = "regex"

    @staticmethod
    def load(path: str) -> Settings:
        """Settings of a file; unknown keys are left out, and a file that can't be read gives the
        defaults."""
        try:
            found = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return Settings()
        known = {f.name for f in fields(Settings)}
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known} if isinstance(found, dict) else {}
        return replace(Settings(), **own)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
