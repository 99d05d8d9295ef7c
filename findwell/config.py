"""Settings of indexing, search and ranking, with their defaults and their YAML form."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields

# Limits, sizes and boosts of search and indexing.
DEFAULT_LIMIT, MAX_LIMIT = 10, 100


@dataclass(frozen=True)
class SearchConfig:
    chunk_size: int = 512
    chunk_overlap: int = 50
    candidates: int = 100
    title_boost: float = 3.0
    phrase_boost: float = 1.5
    min_keyword_score: float = 0.0
    min_semantic_score: float = 0.05
    fuzziness: int = 2
    suggest_distance: int = 2
    suggest_frequency: int = 1
    suggestions: int = 3
    dimensions: int = 384
    max_tokens: int = 256
    debounce_ms: int = 400
    vector_search: str = "memory"
    extensions: tuple[str, ...] = (".txt", ".md", ".rst", ".pdf", ".docx", ".xlsx", ".pptx", ".odp", ".ods")


@dataclass(frozen=True)
class RankingConfig:
    """Weights, scores and multipliers of the content-aware ranking. Fixed values."""

    filename_weight: float = 1.5
    content_weight: float = 1.0
    path_weight: float = 0.3
    metadata_weight: float = 0.4
    exact_filename: float = 100.0
    near_exact_filename: float = 95.0
    filename_phrase: float = 90.0
    filename_in_order: float = 90.0
    filename_all_words: float = 80.0
    filename_substring: float = 60.0
    extension: float = 60.0
    filename_prefix: float = 45.0
    occurrence_bonus: float = 10.0
    content_phrase: float = 120.0
    phrase_repeat: float = 5.0
    phrase_repeat_most: float = 20.0
    header: float = 110.0
    content_in_order: float = 90.0
    content_scattered: float = 70.0
    stemming: float = 50.0
    max_tfidf: float = 2.0
    position_multiplier: float = 1.3
    position_share: float = 0.1
    path_exact: float = 40.0
    path_partial: float = 30.0
    path_bonus: float = 10.0
    author: float = 45.0
    tag: float = 40.0
    other_metadata: float = 35.0
    recent_day: float = 1.2
    recent_week: float = 1.1
    recent_month: float = 1.05
    phrase_quality: float = 1.3
    all_words_quality: float = 1.0
    partial_quality: float = 0.7
    tfidf_enabled: bool = True
    position_enabled: bool = True
    recency_enabled: bool = True
    quality_enabled: bool = True
    size_enabled: bool = False


# Metadata fields whose matches count as an author's or a tag's.
AUTHOR_FIELDS = ("author", "creator", "by", "created_by")
TAG_FIELDS = ("tags", "tag", "keywords", "categories", "category")
# Fixed value: the least scores of the command line if there is no configuration.
PLAIN_MIN_SCORE = 0.49


@dataclass(frozen=True)
class Config:
    search: SearchConfig = field(default_factory=SearchConfig)
    ranking: RankingConfig = field(default_factory=RankingConfig)
    directories: tuple[str, ...] = ()
    recursive: bool = True


def _filled(cls, given: dict | None):
    """``cls`` from a mapping: unknown keys are ignored, zeros and nulls of numbers become the default."""
    out = {}
    for f in fields(cls):
        v = (given or {}).get(f.name)
        if v is None or (v == 0 and not isinstance(v, bool) and f.default):
            continue
        out[f.name] = tuple(v) if isinstance(v, list) else v
    return cls(**out)


def expand_path(path: str, base: str = "") -> str:
    """``~`` replaced, relative paths below ``base``."""
    path = os.path.expanduser(path)
    return path if os.path.isabs(path) or not base else os.path.normpath(os.path.join(base, path))


def load_config(path: str) -> Config:
    """Read a YAML file; what it leaves out keeps its default, directories are expanded."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    watch = raw.get("watch") or {}
    base = os.path.dirname(os.path.abspath(path))
    folders = tuple(expand_path(d, base) for d in watch.get("directories") or ())
    return Config(_filled(SearchConfig, raw.get("search")), _filled(RankingConfig, raw.get("ranking")), folders, watch.get("recursive", True))


def save_config(config: Config, path: str) -> None:
    import yaml

    as_lists = lambda d: {k: list(v) if isinstance(v, tuple) else v for k, v in d.items()}
    raw = {"search": as_lists(asdict(config.search)), "ranking": asdict(config.ranking), "watch": {"directories": list(config.directories), "recursive": config.recursive}}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(raw, f, sort_keys=True)


@dataclass(frozen=True)
class SearchQuery:
    """A search with its paging, paths and least scores."""

    query: str
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    keyword: bool = True
    semantic: bool = True
    fuzzy: bool = False
    min_score: float = 0.0
    min_keyword_score: float = 0.0
    min_semantic_score: float = 0.0

    def validated(self) -> "SearchQuery":
        """With a sensible limit and at least one path; an empty query or a negative offset is an error."""
        if not self.query:
            raise ValueError("query cannot be empty")
        if self.offset < 0:
            raise ValueError("offset cannot be negative")
        limit = DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MAX_LIMIT)
        both = not self.keyword and not self.semantic
        return SearchQuery(self.query, limit, self.offset, self.keyword or both, self.semantic or both, self.fuzzy, self.min_score, self.min_keyword_score, self.min_semantic_score)

    def least(self, config: SearchConfig) -> tuple[float, float]:
        """(keyword, semantic) thresholds: the specific one, else the common one, else the configured one."""
        first = lambda *xs: next((x for x in xs if x > 0), 0.0)
        return first(self.min_keyword_score, self.min_score, config.min_keyword_score), first(self.min_semantic_score, self.min_score, config.min_semantic_score)
