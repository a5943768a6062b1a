"""Files to notes: dispatch by extension, one reader a format, each file's error on its own row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import book, delimited, html_render, image, mail, notebook, opendocument, pdf, sheets, slides, subtitles, word
from .options import Options

READERS: dict[str, Callable] = {}


def register_reader(extensions: str, read: Callable[[bytes, Callable, Options], dict]) -> None:
    """``read(data, save, options)`` returns markdown, warnings and ordered front matter; ``save(data, ext)`` keeps an image and returns its embed."""
    for ext in extensions.split():
        READERS[ext.lower()] = read


register_reader("pdf", lambda data, save, options: pdf.read_pdf(data, save))
register_reader("docx docm", lambda data, save, options: word.read_docx(data, save))
register_reader("pptx pptm", lambda data, save, options: slides.read_pptx(data, save))
register_reader("xlsx xlsm", lambda data, save, options: sheets.read_xlsx(data, save, hidden=options.include_hidden_sheets))
register_reader("odt ods odp", lambda data, save, options: opendocument.read_opendocument(data, save, options.include_hidden_sheets, options.extract_images))
register_reader("epub", lambda data, save, options: book.read_epub(data, save))
register_reader("html htm", lambda data, save, options: html_render.read_html(data, save))
register_reader("mhtml mht", lambda data, save, options: mail.read_mhtml(data, save))
register_reader("eml", lambda data, save, options: mail.read_eml(data, save))
register_reader("vtt srt", lambda data, save, options: subtitles.read_subtitles(data))
register_reader("ipynb", lambda data, save, options: notebook.read_notebook(data, save))
register_reader("csv", lambda data, save, options: delimited.read_delimited(data))
register_reader("tsv", lambda data, save, options: delimited.read_delimited(data, "\t"))
register_reader("png jpg jpeg webp gif bmp tif tiff", lambda data, save, options: image.read_image(data, save))

_PAIR = pa.struct([("key", pa.string()), ("value", pa.string())])
_ASSET = pa.struct([("name", pa.string()), ("ext", pa.string()), ("sha1", pa.string()), ("data", pa.binary())])
_COLUMNS = pa.schema([("path", pa.string()), ("ext", pa.string()), ("markdown", pa.string()), ("warnings", pa.list_(pa.string())), ("frontmatter", pa.list_(_PAIR)), ("assets", pa.list_(_ASSET)), ("error", pa.string())])
SCHEMA = "path string, ext string, markdown string, warnings array<string>, frontmatter array<struct<key:string,value:string>>, assets array<struct<name:string,ext:string,sha1:string,data:binary>>, error string"
#: Bytes of notes and images of one Arrow batch, but for a single file's.
BATCH = 8 << 20


class Assets:
    """A note's kept images: equal bytes once, named by number and hash; the first extension wins."""

    def __init__(self):
        self.kept: dict[str, tuple[str, str, str, bytes]] = {}

    def save(self, data: bytes, ext: str) -> str:
        sha = hashlib.sha1(data).hexdigest()
        if sha not in self.kept:
            self.kept[sha] = (f"image-{len(self.kept) + 1}-{sha[:8]}.{ext}", ext, sha, data)
        return f"![[{self.kept[sha][0]}]]"


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def reader_for(ext: str) -> Callable | None:
    return READERS.get(ext.lower())


def is_supported(ext: str) -> bool:
    return ext.lower() in READERS


def read_one(path: str | None, ext: str | None, data: bytes | None, readers: dict, options: Options) -> tuple[dict, int]:
    """A file's row and about how many bytes it holds."""
    row = {"path": path, "ext": ext, "markdown": None, "warnings": [], "frontmatter": [], "assets": [], "error": None}
    assets = Assets()
    try:
        if ext not in readers:
            raise ValueError(f"no reader for .{ext}")
        got = readers[ext](data or b"", assets.save if options.extract_images else lambda data, ext: None, options)
        row |= {"markdown": got["markdown"], "warnings": got["warnings"], "frontmatter": [{"key": k, "value": v} for k, v in got["frontmatter"]], "assets": [{"name": n, "ext": e, "sha1": s, "data": d} for n, e, s, d in assets.kept.values()]}
    except Exception as e:  # one file's fault is its own row's error
        row["error"] = f"{type(e).__name__}: {e}"
    return row, len(row["markdown"] or "") + sum(len(a["data"]) for a in row["assets"])


def read_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``files``: path, content.  A row a file; unsupported and failing files carry an error and no note."""
    readers = dict(READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):  # one file's bytes are Python objects at a time
                row, n = read_one(*(batch.column(c)[k].as_py() for c in range(3)), readers, options)
                if held and size + n > BATCH:
                    yield pa.RecordBatch.from_pylist(held, _COLUMNS)
                    held, size = [], 0
                held.append(row)
                size += n
            yield pa.RecordBatch.from_pylist(held, _COLUMNS)

    return files.select("path", extension(F.col("path")).alias("ext"), "content").mapInArrow(run, SCHEMA)


def pattern() -> str:
    """A glob of the readers' extensions in any letter case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in sorted(READERS)) + "}"


def scan(spark, root: str, every: bool = False) -> DataFrame:
    """path and content of the files under ``root`` that have a reader; with ``every`` the others too, which then give error rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (files if every else files.option("pathGlobFilter", pattern())).load(root).select("path", "content")
