"""PDF files as DataFrames.

A file is the unit of work: `parse` reads one and gives its rows, `read_pdfs` does so over a folder
with binaryFile, and the `pdf` data source lists files on the driver and reads them on executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .content import Interpreter
from .document import Document, parse_pages
from .lines import lines, lines_of_runs
from .objects import PdfError
from .structure import form_fields, links, metadata, outline, tagged_nodes

ROW = "path string, kind string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, attrs string"
_NAMES = [c.split()[0] for c in ROW.split(", ")]


_BOX = ("x0", "y0", "x1", "y1")
_PAINTED = ("glyphs", "segments", "fills", "paths", "images")
KINDS = frozenset({"page", "line", *(k[:-1] for k in _PAINTED), "tag", "field", "outline", "link", "metadata", "warning", "error"})

#: Asked for beside glyphs: a row for each run of them, its number that of its first glyph, on pages that have nothing but runs that go by themselves.
RUN = "run"


def read(data: bytes, pages: str | None = None, kinds: frozenset[str] = KINDS) -> list[dict[str, Any]]:
    """Rows of one file, told apart by kind, with all that is known of each.

    Kinds are page, line, glyph, segment, fill, path, image, tag, field, outline, link, metadata, warning.
    What kind of node a tag makes, or of field a field is, stands under `what`.
    A file that can't be read gives a row of kind error and whatever came before.
    """
    out: list[dict[str, Any]] = []

    def put(kind: str, rows: Iterable[dict[str, Any]]) -> None:
        if kind in kinds:
            out.extend({"kind": kind, **r} for r in rows)

    def own(kind: str, rows: list[dict[str, Any]]) -> None:
        """Rows that nobody else holds take their kind as they are."""
        if kind in kinds:
            for r in rows:
                r["kind"] = kind
            out.extend(rows)

    try:
        doc = Document(data)
        put("metadata", [metadata(doc)])
        for page in doc.pages(parse_pages(pages)):
            reader = Interpreter(doc, page)
            rows = reader.run()
            put("page", [{"page": page.number, "seq": 0, "x0": 0.0, "y0": 0.0, "x1": reader.width, "y1": reader.height}])
            made = lines_of_runs(page.number, rows.runs) if rows.plain() and "line" in kinds else None
            runs = list(rows.runs) if made is not None and RUN in kinds else None
            if "line" in kinds:
                own("line", lines(rows.glyphs) if made is None else made)
            for kind in _PAINTED:
                if kind[:-1] not in kinds:
                    continue
                if kind == "glyphs" and runs is not None:
                    out.extend([{"kind": RUN, "page": page.number, "seq": seq, "run": run} for seq, run in runs])
                else:
                    own(kind[:-1], getattr(rows, kind))
        for kind, found in (("tag", tagged_nodes), ("field", form_fields), ("outline", outline), ("link", links)):
            if kind in kinds:
                named = "title" if kind in ("tag", "outline") else "name" if kind == "field" else "uri"
                put(kind, ({"seq": k, **{"what" if n == "kind" else n: v for n, v in r.items()}, "text": r.get(named)} for k, r in enumerate(found(doc))))
        put("warning", ({"seq": k, "text": w} for k, w in enumerate(doc.warnings)))
    except (PdfError, ValueError, RecursionError) as e:
        put("error", [{"text": f"{type(e).__name__}: {e}"}])
    return out


def parse(data: bytes, pages: str | None = None, kinds: frozenset[str] = KINDS) -> list[dict[str, Any]]:
    """The rows of `read` in the columns of ROW: what has no column of its own is JSON in attrs."""
    return _told(read(data, pages, kinds))


def _told(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    own = {"kind", "page", "seq", "text", *_BOX}
    out = []
    for r in rows:
        rest = {k: v for k, v in r.items() if k not in own}
        box = {k: None if r.get(k) is None else float(r[k]) for k in _BOX}
        out.append({"kind": r["kind"], "page": r.get("page"), "seq": r.get("seq"), **box, "text": r.get("text"), "attrs": json.dumps(rest, sort_keys=True, default=str)})
    return out


def _batch(rows: list[dict[str, Any]], path: str) -> pa.RecordBatch:
    kinds = {"page": pa.int32(), "seq": pa.int32(), **dict.fromkeys(("x0", "y0", "x1", "y1"), pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([path if n == "path" else r.get(n) for r in rows], kinds.get(n, pa.string())) for n in _NAMES], _NAMES)


#: Rows that go to Spark together, at least, where a task has so many.
BATCH_ROWS = 20_000
_KINDS = {"page": pa.int32(), "seq": pa.int32(), **dict.fromkeys(_BOX, pa.float64())}


def _columns(rows: list[dict[str, Any]], path: str, names: list[str]) -> list[pa.Array]:
    """The columns of ROW that are named, of the rows of `read`."""
    if "attrs" in names:
        made = _batch(_told(rows), path)
        return [made.column(n) for n in names]
    return [pa.repeat(pa.scalar(path, pa.string()), len(rows)) if n == "path" else pa.array([r.get(n) for r in rows], _KINDS.get(n, pa.string())) for n in names]


def parse_table(files: DataFrame, path_col: str = "path", content_col: str = "content", pages: str | None = None, kinds: frozenset[str] = KINDS, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows of the files of a table with a path and a binary column; only those of the kinds that are asked for are made, and of those the named columns of ROW (all, if none are named)."""
    wanted = set(_NAMES if columns is None else columns)
    if unknown := wanted - set(_NAMES):
        raise ValueError(f"no columns: {', '.join(sorted(unknown))}")
    names = [n for n in _NAMES if n in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        size = 0
        joined = lambda: pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = read(content or b"", pages, kinds)
                held.append(_columns(rows, path, names))
                size += len(rows)
                if size >= BATCH_ROWS:
                    yield joined()
                    held, size = [], 0
        if held:
            yield joined()

    schema = ", ".join(c for c in ROW.split(", ") if c.split()[0] in wanted)
    return files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content")).mapInArrow(run, schema)


def read_pdfs(spark: SparkSession, path: str, pages: str | None = None) -> DataFrame:
    return parse_table(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path), pages=pages)


def stream_pdfs(spark: SparkSession, path: str, pages: str | None = None) -> DataFrame:
    """The rows of files as they arrive in a folder; each file is complete in one row, so no state is kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parse_table(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path), pages=pages)


#: Bytes of files that one task reads, or one larger file.
TASK_BYTES = 32 << 20


class PdfSource(DataSource):
    """spark.read.format("pdf").option("path", ...): a file or folder, local or of any store that pyarrow reads (hdfs://, s3://, gs://). Small files share a task."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: Any) -> DataSourceReader:
        return PdfReader(self.options)


def file_system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pages = options["path"], options.get("pages")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = file_system(self.path)
        first = store.get_file_info(root)
        if first.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [first] if first.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".pdf")]
        tasks: list[list[str]] = []
        size = self.task_bytes
        for f in sorted(found, key=lambda f: f.path):
            if not tasks or size + (f.size or 0) > self.task_bytes:
                tasks.append([])
                size = 0
            tasks[-1].append(f.path)
            size += f.size or 0
        return [InputPartition(paths) for paths in tasks]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        for path in partition.value:
            with store.open_input_file(path) as f:
                yield _batch(parse(f.read(), self.pages), path)
