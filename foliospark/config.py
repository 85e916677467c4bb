"""Options of the tree pipelines: defaults, merging and validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

#: Granularity to the depth of subdivision.
DEPTH = {"coarse": 0, "medium": 1, "fine": 2, "keywords": 3}
#: Reasoner names by provider.
DEFAULT_MODEL = {"rules": "rules", "external": "external"}


@dataclass(frozen=True)
class Config:
    model: str = "rules"
    toc_check_page_num: int = 20
    max_page_num_each_node: int = 10
    max_token_num_each_node: int = 20000
    if_add_node_id: bool = True
    if_add_node_summary: bool = True
    if_add_doc_description: bool = False
    if_add_node_text: bool = True
    granularity: str = "coarse"
    enable_figure_detection: bool = True
    enable_table_detection: bool = True
    enable_semantic_subdivision: bool = True
    semantic_min_pages: float = 0.5
    summary_mode: str = "smart"

    @property
    def max_depth(self) -> int:
        return DEPTH[self.granularity]


def _value(name: str, value: object) -> object:
    if isinstance(getattr(Config, name), bool) and isinstance(value, str):
        return value == "yes" or value == "true"
    return value


def load(options: dict | Config | None = None) -> Config:
    """Defaults with the given options over them; None values count as absent, unknown keys are an error."""
    given = asdict(options) if isinstance(options, Config) else {k: v for k, v in (options or {}).items() if v is not None}
    unknown = given.keys() - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    config = replace(Config(), **{k: _value(k, v) for k, v in given.items()})
    if config.granularity not in DEPTH:
        raise ValueError(f"granularity must be one of {', '.join(DEPTH)}")
    return config
