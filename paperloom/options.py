"""Engine switches.  Instances are turned into literals inside expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ParseOptions:
    keep_empty_cells: bool = False
    strict_reference_header: bool = False
    caret_definitions: bool = False
    keep_double_space: bool = False


@dataclass(frozen=True)
class RenderOptions:
    include_frontmatter: bool = True
    embed_images_base64: bool = False
    image_path_prefix: str = ""
    table_alignment: bool = True
    strip_formatting: bool = False
    keep_math_delimiters: bool = False
    keep_double_space: bool = False


@dataclass(frozen=True)
class CleanerOptions:
    activation_mode: str = "off"
    cite_mode: str = "footnote"
    drop_unknown_markers: bool = False

    def __post_init__(self) -> None:
        if self.activation_mode not in ("off", "auto", "on"):
            raise ValueError("activation_mode must be one of: off, auto, on")
        if self.cite_mode not in ("footnote", "inline", "strip"):
            raise ValueError("cite_mode must be one of: footnote, inline, strip")


@dataclass(frozen=True)
class SeparatorOptions:
    mode: str = "auto"

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "rule", "page-break"):
            raise ValueError("mode must be one of: auto, rule, page-break")
