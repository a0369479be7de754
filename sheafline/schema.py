"""Settings and fixed values of the layout and text pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Language codes and names.
LANGUAGES = {
    "auto": "Auto Detect", "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ja": "Japanese", "ko": "Korean",
    "zh": "Chinese", "ar": "Arabic", "hi": "Hindi", "nl": "Dutch", "pl": "Polish", "sv": "Swedish", "tr": "Turkish", "uk": "Ukrainian", "no": "Norwegian", "da": "Danish", "fi": "Finnish",
    "cs": "Czech", "hu": "Hungarian", "ro": "Romanian", "bg": "Bulgarian", "hr": "Croatian", "sk": "Slovak", "sl": "Slovenian", "et": "Estonian", "lv": "Latvian", "lt": "Lithuanian",
    "mt": "Maltese", "ga": "Irish", "cy": "Welsh", "eu": "Basque", "ca": "Catalan", "gl": "Galician", "is": "Icelandic",
}
# Patterns of fonts and characters of formulas, of lone marks, of numbers on pages.
MATH_FONT = r"(?i)math|cambria|stix|asana|euler|latin modern"
MATH_CHAR = r"[=+\-−×÷√∫∑∏∞Δαβγδθλμρστφψω±≤≥≠≈≡%‰∀∃∈∋∩∪⊂⊃⊆⊇⊕⊗⊥⇒⇔→←↑↓↔∴≅⊢⊨]|[\x{0370}-\x{03FF}\x{2070}-\x{209F}]"
OPERATOR_CHAR = "=+-−×÷√∫∑≠≤≥≈±∞"
MISSING = "Translation missing"
DEFAULT_FAMILY = "sans-serif"
# Metadata comments in the three formats of stored documents.
META_V3 = r"^%%\s*(\{.*\})\s*%%"
META_V2 = r"<!--\s*PDF_TRANSLATOR_METADATA:([a-zA-Z0-9+/=]+)\s*-->"
META_V1 = r"<!--\s*(\{.*?\})\s*-->"


@dataclass(frozen=True)
class Page:
    left: float = 0.0
    top: float = 0.0
    right: float = 612.0
    bottom: float = 792.0


@dataclass(frozen=True)
class LayoutSettings:
    """Knobs of paragraph reconstruction; names say what they bound, factors are of a font size unless said."""

    line_height: float = 1.6
    min_strip_confidence: float = 0.7
    min_strip_width: float = 4.0
    debug: bool = False  # without effect here
    max_rounds: int = 10
    min_band_confidence: float = 0.6  # of bands that are given
    band_edge_lines: float = 0.75
    inferred_band_confidence: float = 0.8
    band_gap: float = 2.0
    band_gap_lines: float = 0.2
    max_gap_of_page: float = 0.5
    min_gaps_for_trim: int = 5
    trim: float = 0.15
    line_from_gaps: float = 1.25
    line_floor: float = 0.8
    band_overlap: float = 0.4  # this and the next: of operators/order alone
    region_width: float = 1.0
    column_lines: float = 2.0
    column_fallback: float = 20.0
    linear: bool = False
    split_strip_confidence: float = 0.7
    split_strip_width: float = 6.0
    strip_overlap: float = 0.6
    baseline: float = 0.45
    baseline_math: float = 0.75
    kerning: float = 0.55
    kerning_math: float = 0.9
    hyphen: float = 1.8
    align: float = 2.0
    align_math: float = 2.0
    first_gap_lines: float = 1.3
    first_gap_max: float = 2.2
    stack_align: float = 2.0
    stack_overlap: float = 0.25
    stack_gap_lines: float = 1.35
    stack_gap_max: float = 2.0
    merge_align: float = 2.0
    merge_overlap: float = 0.25
    merge_gap_lines: float = 1.35
    merge_gap_max: float = 2.0
    nested_overlap: float = 0.7
    stitch_baseline: float = 0.45  # these four: stitching only sorts
    stitch_baseline_math: float = 0.75
    stitch_kerning: float = 0.55
    stitch_kerning_math: float = 0.9
    inline_baseline: float = 0.3  # these two: of a regrouping that nothing calls
    inline_kerning: float = 0.6
    max_weight_difference: float = 300
    mixed_style: bool = True
    same_column_coverage: float = 0.65
    math_baseline: float = 2.0
    math_left: float = 1.5
    math_center: float = 2.5
    split_line: float = 0.7  # of ``split_line_height``, as the next
    split_dedup: float = 0.3
    word_gap: float = 1.2
    column_gap: float = 2.5
    split_line_height: float = 0.0  # splitting gets no line height, so that lines have equal tops


# The names of these knobs in stored settings, in the order of the fields.
STORED_LAYOUT = (
    "lineHeightMultiplier minStripConfidence minStripWidthPx debugValidation maxIterMerges minBandConfidence bandTopBottomThresholdMultiplier inferredBandConfidence bandMergeGapPx bandMergeGapLineHeightMultiplier "
    "maxGapFractionOfPageHeight minGapsForTrim trimPercent lineHeightFromAvgMultiplier floorMultiplier minOverlapFracForBand minRegionWidth columnThresholdLineHeightMultiplier columnThresholdFallback "
    "pmForceLinearMerge pmMinStripConfidenceSplit pmMinStripWidthPx pmMinStripOverlapFrac pmInitialMergeBaselineTolNonMath pmInitialMergeBaselineTolMath pmInitialMergeKernTolNonMath pmInitialMergeKernTolMath "
    "pmHyphenContinuationTol pmInitialMergeAlignTolNonMath pmInitialMergeAlignTolMath pmInitialMergeVerticalGapMultiplier pmInitialMergeVerticalGapMaxMultiplier "
    "pmStackedMergeAlignTol pmStackedMergeOverlapFrac pmStackedMergeVerticalGapMultiplier pmStackedMergeVerticalGapMaxMultiplier pmGeneralMergeAlignTol pmGeneralMergeOverlapFrac pmGeneralMergeVerticalGapMultiplier "
    "pmGeneralMergeVerticalGapMaxMultiplier pmNestedMergeOverlapFrac pmStitchBaselineTolNonMath pmStitchBaselineTolMath pmStitchKernTolNonMath pmStitchKernTolMath pmInlineSpanBaselineTol pmInlineSpanKernTol "
    "pmInlineSpanMaxWeightDiff pmInlineSpanAllowMixedStyle pmSameColumnCoverageRatio pmMathMergeBaselineTol pmMathMergeHorizTol pmMathMergeCenterTol pmSplitLineHeightTol pmSplitBoundaryDedupTol pmSplitInterWordGapTol pmSplitColumnGapTol"
).split()


@dataclass(frozen=True)
class GapSettings:
    """Knobs of strip detection."""

    min_confidence: float = 0.6
    max_columns: int = 6
    min_gap: float = 2.0
    band_lines: float = 0.75
    band_floor: float = 6.0
    min_height_lines: float = 1.5
    center_lines: float = 0.5
    center_floor: float = 4.0
    coverage_weight: float = 0.5
    width_weight: float = 0.25
    center_weight: float = 0.25
    merge_within: float = 3.0
    default_line: float = 15.0
    band_confidence: float = 0.6  # of a band that parts paragraphs, whatever the layout's knobs


@dataclass(frozen=True)
class SegmentSettings:
    """Knobs of vertical segmentation by column counts."""

    column_gap_lines: float = 2.0
    shift_lines: float = 4.0
    min_height_lines: float = 2.0
    step_floor: float = 5.0
    step_lines: float = 0.5
    buffer_lines: float = 0.5
    buffer_share: float = 0.1


@dataclass(frozen=True)
class TextSettings:
    budget: int = 7500
    batch: bool = True
    source: str = "auto"
    target: str = "en"
    font_scale: float = 0.95
    line_height: float = 1.45
    folder: str = ""
    batch_prompt: str = "Translate each numbered line from {sourceLang} to {targetLang}. Keep numbers and tags. Give {lineCount} numbered lines.{inputText}"
    single_prompt: str = "Translate from {sourceLang} to {targetLang}. Keep tags.{inputText}"
    single_limit: int = 3000
    attempts: int = 3
    timeout: float = 45.0


# The names of text settings in stored settings.
STORED_TEXT = {
    "maxBatchChars": "budget", "useBatchTranslation": "batch", "sourceLanguage": "source", "targetLanguage": "target", "outputFontSizeScale": "font_scale", "outputLineHeight": "line_height",
    "storageLocation": "folder", "batchPrompt": "batch_prompt", "singlePrompt": "single_prompt",
}


def layout_settings(stored: dict[str, object] | None) -> LayoutSettings:
    """The defaults, overlaid by what is stored; other names are left aside."""
    names = dict(zip(STORED_LAYOUT, (f.name for f in fields(LayoutSettings)), strict=False))
    return LayoutSettings(**{names[k]: v for k, v in (stored or {}).items() if k in names})


def text_settings(stored: dict[str, object] | None) -> TextSettings:
    """The defaults, overlaid by what is stored; the folder in its normal form."""
    own = {STORED_TEXT[k]: v for k, v in (stored or {}).items() if k in STORED_TEXT}
    return TextSettings(**{**own, "folder": normal_folder(str(own.get("folder", "")))})


def normal_folder(folder: str) -> str:
    """A folder with one slash at its end and none doubled or leading; the root is empty."""
    inner = "/".join(x for x in folder.strip().split("/") if x)
    return "" if inner in ("", ".", "..") else inner + "/"
