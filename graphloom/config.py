"""Typed configuration, read from and written to YAML. Unknown keys are ignored."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any, TypeVar

from graphloom.schema import LANGUAGES, QA_CATEGORIES, SEMANTIC_TYPES

T = TypeVar("T")


def _within(name: str, value: float, low: float | None = None, high: float | None = None) -> None:
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} must lie in [{low}, {high}]: {value}")


def _known(what: str, values: Any, allowed: list[str]) -> None:
    for v in values:
        if v not in allowed:
            raise ValueError(f"{what}: {v} is not one of {allowed}")


# The keys of the configuration files, their defaults and bounds.
@dataclass
class ExtractorConfig:
    languages: list[str] = field(default_factory=lambda: ["python", "java", "typescript", "cpp"])
    exclude: list[str] = field(default_factory=lambda: ["**/vendor/**", "**/node_modules/**", "**/.git/**"])
    out_graph: str = "data/brain/graph"
    max_file_size_mb: int = 5
    max_total_files: int = 100_000
    max_repo_size_mb: int = 10_000
    processing_timeout_seconds: int = 7200

    def __post_init__(self) -> None:
        _known("languages", self.languages, LANGUAGES)
        for name in ("max_file_size_mb", "max_total_files", "max_repo_size_mb"):
            _within(name, getattr(self, name), 1)
        _within("processing_timeout_seconds", self.processing_timeout_seconds, 60)


@dataclass
class BrainConfig:
    node_types: list[str] = field(default_factory=lambda: list(SEMANTIC_TYPES))
    summary_style: str = "concise"
    summary_max_tokens: int = 200
    out_dir: str = "data/brain/summaries"
    use_embeddings: bool = False
    embedding_model: str | None = None

    def __post_init__(self) -> None:
        _known("node_types", self.node_types, SEMANTIC_TYPES)
        _within("summary_max_tokens", self.summary_max_tokens, 50, 500)


@dataclass
class DatasetConfig:
    qa_categories: dict[str, int] = field(default_factory=lambda: dict.fromkeys(QA_CATEGORIES, 250))
    negatives_per_example: int = 2
    out_file: str = "data/dataset/train"
    min_response_tokens: int = 50
    max_response_tokens: int = 500

    def __post_init__(self) -> None:
        _known("qa_categories", self.qa_categories, QA_CATEGORIES)
        _within("negatives_per_example", self.negatives_per_example, 0, 5)
        _within("min_response_tokens", self.min_response_tokens, 10)
        _within("max_response_tokens", self.max_response_tokens, None, 2000)


@dataclass
class TrainingDataConfig:
    """The data half of training: what is read, split and cut to length."""

    dataset_path: str = "data/dataset/train"
    model_max_length: int = 2048
    validation_split: float = 0.1

    def __post_init__(self) -> None:
        _within("model_max_length", self.model_max_length, 512, 4096)
        _within("validation_split", self.validation_split, 0.0, 0.5)


@dataclass
class InferenceConfig:
    host: str = "0.0.0.0"
    port: int = 8000
    max_tokens: int = 512
    temperature: float = 0.3

    def __post_init__(self) -> None:
        _within("port", self.port, 1024, 65535)
        _within("max_tokens", self.max_tokens, 64, 4096)
        _within("temperature", self.temperature, 0.0, 2.0)


def is_trusted_model(name: str, trusted: list[str]) -> bool:
    """Whether a base model may be loaded; the list is the deployment's own."""
    return name in trusted


def load_config(path: str | Path, kind: type[T]) -> T:
    """The config in a YAML file; FileNotFoundError where there is none."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(f"Config file not found: {path}")
    data = yaml.safe_load(Path(path).read_text()) or {}
    names = {f.name for f in fields(kind)}  # type: ignore[arg-type]
    return kind(**{k: v for k, v in data.items() if k in names})


def save_config(config: Any, path: str | Path) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(asdict(config), sort_keys=False))
