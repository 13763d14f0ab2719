"""Settings of a memory; YAML or keyword arguments over these defaults, unknown names are an error."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass
class Config:
    mode: str = "load"  # use what is stored; or "add": merge sessions into it; or "force": build anew
    chunk_mode: str = "dialogue"  # or "tokens": windows of title and content
    dialogue_layout: str = "auto"  # or "roles": user and assistant alone; or "speakers": turns of any names
    window_tokens: int = 1200
    window_overlap: int = 100
    merge_threshold: float = 0.85
    top_entities: int = 8
    top_triples: int = 8
    top_chunks: int = 3
    use_summaries: bool = True
    top_summaries: int = 3
    summary_scores: str = "keys"  # or "position": by the order of the summaries alone
    summary_weight: float = 0.3
    temporal: bool = True
    decay_power: float = 0.5
    embedding_dimensions: int = 64
    model: str = "generator"  # names by which prices are found
    query_model: str = "generator"
    concurrency: int = 16  # calls under way at once in a task, for models that answer one prompt at a time
    call_timeout: float | None = None
    call_retries: int = 0
    store_buckets: int = 16  # folders by key that a full version is dealt into
    compact_after: int = 20  # additions after which the segments of a memory are folded into one

    @classmethod
    def parse(cls, path: str | None = None, **given) -> Config:
        found = {}
        if path:
            import yaml

            with open(path, encoding="utf-8") as f:
                found = yaml.safe_load(f) or {}
        found |= given
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found)

    def to_dict(self) -> dict:
        return asdict(self)
