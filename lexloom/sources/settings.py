"""Settings from the environment or a JSON file, with defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """What ingest, retrieval and admission take as parameters."""

    chunk_words: int = 768
    chunk_tokens: int = 768
    chunk_overlap: int = 128
    least_chars: int = 200
    top_k: int = 6
    shown: int = 5
    batch_files: int = 8
    most_requests: int = 8
    window_seconds: int = 3600
    collection: str = "documents"
    language: str = "en"
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _with(settings: Settings, given: Mapping[str, object]) -> Settings:
    kinds = {f.name: type(getattr(settings, f.name)) for f in fields(settings)}
    return replace(settings, **{k: kinds[k](v) for k, v in given.items() if k in kinds and v not in (None, "")})


def from_environment(prefix: str = "LEXLOOM_", environ: Mapping[str, str] | None = None) -> Settings:
    """Variables such as LEXLOOM_TOP_K; those that are missing or empty keep their default."""
    source = os.environ if environ is None else environ
    return _with(Settings(), {k.removeprefix(prefix).lower(): v for k, v in source.items() if k.startswith(prefix)})


def from_json(path: str) -> Settings:
    """Fields of a JSON object; others in it are ignored."""
    with open(path, encoding="utf-8") as file:
        return _with(Settings(), json.load(file))
