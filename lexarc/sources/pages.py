"""A data source of PDF pages that opens only the files, and extracts words only of the pages, that a query asks for."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as ds

from ..operators.roles import SKIP_PHRASES, WORD_INDEX, WORD_INDEX_COLONS

PLACE = ["x0", "y0", "x1", "y1"]
PAGES = ("path string, pdf_page_index int, raw_text string, skipped boolean,"
         " words array<struct<word_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>")
WORD = pa.struct([("word_no", pa.int32()), *((c, pa.float64()) for c in PLACE), ("text", pa.string())])
ARROW = pa.schema([("path", pa.string()), ("pdf_page_index", pa.int32()), ("raw_text", pa.string()), ("skipped", pa.bool_()), ("words", pa.list_(WORD))])
#: A file of more bytes goes to several tasks, each of which takes an equal share of its pages.
SPLIT_BYTES = 64 << 20
COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
           ds.In: lambda v, among: v in among}


def skipped(raw: str) -> bool:
    """Whether a page's text alone gives it a role whose pages have no lines, by the rules of `roles.page_role`."""
    compact = re.sub(r"\s+", " ", raw, flags=re.ASCII)
    upper = compact.upper()
    listed = re.search(WORD_INDEX, compact, re.ASCII) is not None and compact.count(":") >= WORD_INDEX_COLONS
    return listed or any(all(p in upper for p in phrases) for phrases in SKIP_PHRASES.values())


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path in a full one)."""
    if re.match(r"(?!file:)[\w+.-]+://", path):
        store, inner = fs.FileSystem.from_uri(path)
        return store, inner, path[:path.index(inner)] if inner in path else ""
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path), "file:"


@dataclass
class Part(ds.InputPartition):
    """The share no. `part` of the `parts` of a file's pages."""

    path: str
    full: str
    part: int
    parts: int


@dataclass
class PageReader(ds.DataSourceReader):
    root: str
    words: bool
    split: int
    on_path: list = field(default_factory=list)
    on_page: list = field(default_factory=list)
    unskipped: bool = False

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if isinstance(f, ds.IsNotNull) and f.attribute[0] in ("path", "pdf_page_index", "skipped"):
                continue  # never null
            if type(f) in COMPARE and f.attribute == ("pdf_page_index",):
                self.on_page.append((type(f), f.value))
            elif isinstance(f, (ds.EqualTo, ds.In)) and f.attribute == ("path",):
                self.on_path.append((type(f), f.value))
            elif f in (ds.EqualTo(("skipped",), False), ds.Not(ds.EqualTo(("skipped",), True))):
                self.unskipped = True
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, inner, before = located(self.root)
        at = store.get_file_info(inner)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [at] if at.is_file else [x for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file]
        found = [x for x in found if x.size and not x.base_name.startswith((".", "_")) and all(COMPARE[k](before + x.path, v) for k, v in self.on_path)]
        parts = [Part(x.path, before + x.path, k, n) for x in sorted(found, key=lambda x: x.path) for n in [max(1, -(-x.size // self.split))] for k in range(n)]
        return parts or [Part("", "", 0, 0)]

    def read(self, p: Part) -> Iterator[pa.RecordBatch]:
        if not p.parts:
            return
        store, _, _ = located(self.root)
        with store.open_input_file(p.path) as f:
            yield from page_rows(p.full, f.read(), p.part, p.parts, self.words, self.unskipped, self.on_page)


def page_rows(path: str, data: bytes, part: int = 0, parts: int = 1, words: bool = True, unskipped: bool = False, on_page: Iterable = ()) -> Iterator[pa.RecordBatch]:
    """One batch a page; a skipped page has its text, but no words."""
    import pymupdf

    held = pymupdf.open(stream=data, filetype="pdf")
    for i in range(len(held) * part // parts, len(held) * (part + 1) // parts):
        if not all(COMPARE[k](i, v) for k, v in on_page):
            continue
        page = held[i]
        raw = page.get_text()
        skip = skipped(raw)
        if skip and unskipped:
            continue
        boxes = None if skip or not words else [{"word_no": k, **dict(zip(PLACE, w[:4], strict=True)), "text": w[4]} for k, w in enumerate(page.get_text("words"))]
        yield pa.RecordBatch.from_pylist([{"path": path, "pdf_page_index": i, "raw_text": raw, "skipped": skip, "words": boxes}], schema=ARROW)


class PageSource(ds.DataSource):
    """Pages of PDF files in a folder (option path) that pyarrow can open: (path, pdf_page_index, raw_text, skipped, words).

    Files of no bytes hold no page. Filters on path spare the opening of files, filters on pdf_page_index the reading of pages, and `not skipped` the rows
    of skipped pages, whose words are never extracted. Option words = false leaves all words out; split_bytes sets how
    large a file one task takes. Filters need spark.sql.python.filterPushdown.enabled, which `pdf.pages` sets.
    """

    @classmethod
    def name(cls) -> str:
        return "transcript_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], self.options.get("words", "true").lower() == "true", int(self.options.get("split_bytes", SPLIT_BYTES)))
