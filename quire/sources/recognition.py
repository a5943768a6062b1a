"""Recognised lines of an image to paragraphs, and the engine's interface.

An engine is a function from an image's bytes to ``{"confidence": 0-100, "blocks":
[{"paragraphs": [{"lines": [{"text", "confidence", "bbox", "words"}]}]}]}``, boxes
being dicts of x0, y0, x1 and y1.  None is built in; ``use_engine`` sets one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from statistics import fmean
from statistics import median as _median
from typing import NamedTuple

from .lines import WS, squash

#: Least confidence of a paragraph; gaps, columns and fill in line heights and shares; a blank's width.
LEAST_CONFIDENCE, GAP, COLUMN, FILL, BLANK = 60, 1.5, 0.6, 0.6, 0.25
#: Names that an engine folder may hold, the preferred one first.
CORES = ("tesseract-core-simd-lstm.wasm.js", "tesseract-core-lstm.wasm.js", "tesseract-core-relaxedsimd-lstm.wasm.js", "tesseract-core-simd.wasm.js", "tesseract-core.wasm.js")
LANGUAGES = ("eng.traineddata", "eng.traineddata.gz")

Engine = Callable[[bytes], dict]
_ENGINE: list[Engine] = []


def use_engine(engine: Engine | None) -> None:
    """The engine of this process's readers; a function that Spark ships must be set on the workers."""
    _ENGINE[:] = [engine] if engine else []


def engine_files(folder: str) -> tuple[str, str]:
    """Paths of the core and the language data in ``folder``."""
    try:
        names = set(os.listdir(folder))
    except OSError:
        raise ValueError(f'OCR engine folder "{folder}" does not exist') from None
    found = [next((n for n in kinds if n in names), None) for kinds in (CORES, LANGUAGES)]
    if None in found:
        missing = [kinds[0] for kinds, n in zip((CORES, LANGUAGES), found, strict=True) if n is None]
        raise ValueError(f'OCR engine folder "{folder}" is missing {" and ".join(missing)}')
    return os.path.join(folder, found[0]), os.path.join(folder, found[1])


class Line(NamedTuple):
    text: str
    confidence: float
    x0: float
    y0: float
    x1: float
    y1: float
    first_word: float


class Recognition(NamedTuple):
    paragraphs: list[str]
    confidence: float
    discarded: int


def recognise(image: bytes, engine: Engine | None = None) -> Recognition:
    engine = engine or (_ENGINE[0] if _ENGINE else None)
    if engine is None:
        raise ValueError("no OCR engine is set")
    result = engine(image)
    paragraphs, discarded = build_paragraphs(result.get("blocks") or [])
    return Recognition(paragraphs, result.get("confidence") or 0, discarded)


def median(values: list[float]) -> float:
    return _median(values) if values else 0


def average(values: list[float]) -> float:
    return fmean(values) if values else 0


def read_lines(blocks: list[dict]) -> list[list[Line]]:
    """The engine's paragraphs as lists of lines that have text and a box."""
    groups = []
    for p in (p for b in blocks for p in b.get("paragraphs") or []):
        group = []
        for x in p.get("lines") or []:
            text, box = re.sub(r"\s+", " ", x.get("text") or "").strip(WS), x.get("bbox")
            if text and box:
                word = next((w["bbox"] for w in x.get("words") or [] if (w.get("text") or "").strip(WS) and w.get("bbox")), box)
                group.append(Line(text, x.get("confidence") or 0, box["x0"], box["y0"], box["x1"], box["y1"], word["x1"] - word["x0"]))
        if group:
            groups.append(group)
    return groups


def split_on_gaps(group: list[Line], height: float) -> list[list[Line]]:
    units = [[group[0]]]
    for before, x in zip(group, group[1:], strict=False):
        if x.y0 - before.y1 > GAP * height:
            units.append([])
        units[-1].append(x)
    return units


def right_margin(left: float, every: list[Line], height: float) -> float:
    """The right end of the widest line that starts in the same column."""
    return max((x.x1 for x in every if abs(x.x0 - left) <= COLUMN * height), default=0)


def continues(before: list[Line], unit: list[Line], every: list[Line], height: float) -> bool:
    """Whether ``unit`` stands right below in the same column and its first word had no room on the line above."""
    left, last, first = before[0].x0, before[-1], unit[0]
    if not 0 <= first.y0 - last.y1 <= GAP * height or abs(first.x0 - left) > COLUMN * height:
        return False
    margin = max(0, right_margin(left, every, height))
    if margin <= left or (last.x1 - left) / (margin - left) < FILL:
        return False
    return last.x1 + BLANK * height + first.first_word > margin


def merge_wrapped(units: list[list[Line]], every: list[Line], height: float) -> list[list[Line]]:
    out: list[list[Line]] = []
    for unit in units:
        if out and continues(out[-1], unit, every, height):
            out[-1].extend(unit)
        else:
            out.append(list(unit))
    return out


def repair_strokes(text: str) -> str:
    """A lone bar or l before a lower-case word is the pronoun I; two lone bars or more are a table's."""
    if len(re.findall(r"(?:^|(?<=\s))\|(?=\s|$)", text)) >= 2:
        return text
    return re.sub(r"(^|[\s(\"'“‘])[|l](?=(?:['’](?:m|ve|ll|d|re)\b)?\s+[a-z])", r"\1I", text)


def build_paragraphs(blocks: list[dict]) -> tuple[list[str], int]:
    """Paragraphs of an engine's blocks, and how many were too uncertain to keep."""
    return paragraphs_of(read_lines(blocks))


def paragraphs_of(groups: list[list[Line]]) -> tuple[list[str], int]:
    """Paragraphs by where lines stand, and how many were too uncertain to keep."""
    every = [x for g in groups for x in g]
    height = median([x.y1 - x.y0 for x in every]) or 1
    kept, discarded = [], 0
    for unit in merge_wrapped([u for g in groups for u in split_on_gaps(g, height)], every, height):
        text = repair_strokes(squash(" ".join(x.text for x in unit)))
        if text and average([x.confidence for x in unit]) < LEAST_CONFIDENCE:
            discarded += 1
        elif text:
            kept.append(text)
    return kept, discarded
