"""What a conversion may be told, and where its notes go."""

from __future__ import annotations

import dataclasses
import json
import posixpath


@dataclasses.dataclass(frozen=True)
class Options:
    """The names and defaults of the settings, in the saved file's own spelling under ``NAMES``."""

    output_location: str = "sameFolder"
    output_folder: str = "Converted"
    extract_images: bool = True
    ocr_data_folder: str = ""
    include_hidden_sheets: bool = True
    add_frontmatter: bool = True
    add_conversion_notes: bool = True


NAMES = {"outputLocation": "output_location", "outputFolder": "output_folder", "extractImages": "extract_images", "ocrDataFolder": "ocr_data_folder", "includeHiddenSheets": "include_hidden_sheets", "addFrontmatter": "add_frontmatter", "addConversionNotes": "add_conversion_notes"}


def load_options(saved: str | None) -> Options:
    """Options from a saved JSON object; keys that are not known are ignored, absent ones keep their default."""
    found = json.loads(saved) if saved and saved.strip() else {}
    return Options(**{NAMES[k]: v for k, v in found.items() if k in NAMES} if isinstance(found, dict) else {})


def output_folder(options: Options, path: str, files: set[str] = frozenset()) -> str:
    """The folder of a source's note: its own, or the one named; an error if a file has that name."""
    if options.output_location == "sameFolder":
        return posixpath.dirname(path)
    folder = posixpath.normpath(options.output_folder or "Converted").strip("/")
    if folder in files:
        raise ValueError(f'"{folder}" is a file, not a folder')
    return folder
