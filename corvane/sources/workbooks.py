"""Workbooks (.xlsx) as a data source: ``spark.read.format("corvane_workbook")`` and ``df.write.format("corvane_workbook")``.

A workbook is a zip of XML parts. Reading makes a partition of each sheet, which streams
through its part row by row. Writing stages each task's rows in the folder beside the file;
the commit puts the staged rows together, sheet by sheet, and only then moves the file into
place, so a failed job or a lost executor leaves no half-written workbook. A sheet holds at
most 1,048,576 rows by its format; more is an error, not a cut.

Options: ``path`` (a local path or a URI that pyarrow's file systems know), ``key`` (rows
without a value in this column are left out when reading), ``sheet`` (read this one only).
When reading, the first row of a sheet names its columns, matched to the schema by name; a
column that a sheet lacks is null; without a schema all columns of all sheets are strings.
A column ``sheet`` names the sheet; written names are cut to their last 31 characters.

Defined cases: empty cells and empty strings are null; an empty frame gives a workbook with
one empty sheet; two sheets whose names are equal after the cut are an error.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from corvane.session import opened

NAME = "corvane_workbook"
SHEET, MOST_ROWS, NAME_CHARS = "sheet", 1_048_576, 31
# The name spaces and part names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _unescaped(text: str) -> str:
    """Text with the format's ``_xHHHH_`` escapes undone."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _escaped(text: str) -> str:
    """Text as XML holds it; characters that XML bars become ``_xHHHH_``, and what looks like such an escape too."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _column(ref: str) -> int:
    """The 0-based column of a cell reference such as ``AB12``."""
    n = 0
    for letter in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(node: ElementTree.Element) -> str:
    return _unescaped("".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t") if t is not None))


class Book:
    """An open workbook: its sheets in order with their parts, its shared strings, and the rows of a sheet."""

    def __init__(self, file) -> None:
        self.zip = zipfile.ZipFile(file)
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {x.get("Id"): x.get("Target") for x in links}
        part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = [(_unescaped(x.get("name")), part(target[x.get(f"{{{_LINK}}}id")])) for x in book.iter(f"{{{_MAIN}}}sheet")]
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            self.shared = [_text(x) for x in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")]

    def rows(self, part: str) -> Iterator[dict[int, object]]:
        """The values of each row of a sheet by column, one row in memory at a time."""
        with self.zip.open(part) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{{{_MAIN}}}row":
                    continue
                row: dict[int, object] = {}
                for place, cell in enumerate(node.iter(f"{{{_MAIN}}}c")):
                    value = self.value(cell)
                    if value is not None and value != "":
                        row[_column(cell.get("r")) if cell.get("r") else place] = value
                yield row
                node.clear()

    def value(self, cell: ElementTree.Element) -> object:
        kind, held = cell.get("t"), cell.find(f"{{{_MAIN}}}v")
        if kind == "inlineStr":
            return _text(cell)
        if held is None or held.text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(held.text)]
        if kind == "b":
            return held.text == "1"
        return _unescaped(held.text) if kind == "str" else float(held.text)


def _said(value: object) -> str:
    """A value as text; whole numbers without a point."""
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value).lower() if isinstance(value, bool) else str(value)


def _typed(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return _said(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else str(_said(value)).lower() in ("1", "true")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.IntegralType):
        return int(value) if isinstance(value, str) else int(float(value))
    raise TypeError(f"a workbook has no {kind.simpleString()} cells")


@dataclass
class SheetPartition(InputPartition):
    """One sheet and its part of the zip."""

    name: str
    part: str


class WorkbookReader(DataSourceReader):
    """A partition a sheet."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path, self.key, self.only = schema, options["path"], options.get("key"), options.get(SHEET)

    def partitions(self) -> list[InputPartition]:
        where, path = opened(self.path)
        with where.open_input_file(path) as f:
            return [SheetPartition(n, p) for n, p in Book(f).sheets if self.only in (None, n)]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        where, path = opened(self.path)
        with where.open_input_file(path) as f:
            book = Book(f)
            rows = book.rows(partition.part)
            names = {_said(v): c for c, v in next(rows, {}).items()}
            for row in rows:
                if self.key is not None and row.get(names.get(self.key, -1)) is None:
                    continue
                yield tuple(partition.name if x.name == SHEET else _typed(row.get(names.get(x.name, -1)), x.dataType) for x in self.schema.fields)


@dataclass
class Staged(WriterCommitMessage):
    """The rows that a task staged: its place and the file of each sheet with its number of rows."""

    place: int
    files: dict[str, tuple[str, int]] = field(default_factory=dict)


class WorkbookWriter(DataSourceWriter):
    """Tasks stage rows as JSON lines; the commit makes the workbook of them."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.names, self.kinds = schema.fieldNames(), [f.dataType for f in schema.fields]
        for name, kind in zip(self.names, self.kinds, strict=True):
            if not isinstance(kind, (T.StringType, T.BooleanType, T.NumericType)):
                raise TypeError(f"column {name}: a workbook has no {kind.simpleString()} cells")
        self.path, self.overwrite, self.stage = options["path"], overwrite, f"{options['path']}.stage-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator) -> Staged:
        where, stage = opened(self.stage)
        where.create_dir(stage)
        out, attempt, task = {}, uuid.uuid4().hex[:12], TaskContext.get()
        counts: dict[str, int] = {}
        try:
            for row in iterator:
                values = row.asDict() if hasattr(row, "asDict") else dict(zip(self.names, row, strict=True))
                sheet = str(values.pop(SHEET, None) or "sheet")[-NAME_CHARS:]
                if sheet not in out:
                    out[sheet] = (f"{attempt}-{len(out)}", where.open_output_stream(f"{stage}/{attempt}-{len(out)}"))
                out[sheet][1].write((json.dumps([v if isinstance(v, (str, bool, int, float, type(None))) else float(v) for v in values.values()]) + "\n").encode())
                counts[sheet] = counts.get(sheet, 0) + 1
        finally:
            for _, f in out.values():
                f.close()
        return Staged(task.partitionId() if task else 0, {s: (n, counts[s]) for s, (n, _) in out.items()})

    def commit(self, messages: list) -> None:
        where, path = opened(self.path)
        _, stage = opened(self.stage)
        try:
            if not self.overwrite and where.get_file_info(path).type != fs.FileType.NotFound:
                raise FileExistsError(self.path)
            staged = sorted((m for m in messages if m is not None), key=lambda m: m.place)
            sheets = sorted({s for m in staged for s in m.files}) or ["sheet"]
            if len({s.lower() for s in sheets}) < len(sheets):
                raise ValueError(f"sheets of one name: {sheets}")
            for s in sheets:
                if sum(m.files.get(s, ("", 0))[1] for m in staged) >= MOST_ROWS:
                    raise ValueError(f"sheet {s} has more rows than a workbook can hold")
            where.create_dir(os.path.dirname(path))
            with where.open_output_stream(f"{path}.new") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
                for k, s in enumerate(sheets):
                    with book.open(f"xl/worksheets/sheet{k + 1}.xml", "w", force_zip64=True) as sheet:
                        self._sheet(sheet, where, [f"{stage}/{m.files[s][0]}" for m in staged if s in m.files])
                self._frame(book, sheets)
            where.move(f"{path}.new", path)
        finally:
            self._clean(where, stage)

    def abort(self, messages: list) -> None:
        where, stage = opened(self.stage)
        self._clean(where, stage)

    @staticmethod
    def _clean(where: fs.FileSystem, stage: str) -> None:
        if where.get_file_info(stage).type == fs.FileType.Directory:
            where.delete_dir(stage)

    def _sheet(self, out, where: fs.FileSystem, files: list[str]) -> None:
        """A sheet's part: the header, then the staged rows."""
        def line(n: int, values: list) -> bytes:
            cells = []
            for k, v in enumerate(values):
                at = f'<c r="{_letters(k)}{n}"'
                if isinstance(v, bool):
                    cells.append(f'{at} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
                    cells.append(f"{at}><v>{v!r}</v></c>")
                elif isinstance(v, str) and v:
                    cells.append(f'{at} t="inlineStr"><is><t xml:space="preserve">{_escaped(v)}</t></is></c>')
            return f'<row r="{n}">{"".join(cells)}</row>'.encode()

        out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        out.write(line(1, [n for n in self.names if n != SHEET]))
        n = 1
        for file in files:
            with where.open_input_stream(file) as f:
                rest = b""
                while block := f.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    for raw in lines:
                        n += 1
                        out.write(line(n, json.loads(raw)))
        out.write(b"</sheetData></worksheet>")

    @staticmethod
    def _frame(book: zipfile.ZipFile, sheets: list[str]) -> None:
        """The parts that list the sheets."""
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        quoted = lambda s: _escaped(s).replace('"', "&quot;")
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k in range(len(sheets)))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets>{"".join(f"""<sheet name="{quoted(s)}" sheetId="{k + 1}" r:id="rId{k + 1}"/>""" for k, s in enumerate(sheets))}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f"""<Relationship Id="rId{k + 1}" Type="{_LINK}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>""" for k in range(len(sheets)))}</Relationships>')


class Workbook(DataSource):
    """The data source."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        where, path = opened(self.options["path"])
        names: dict[str, None] = {}
        with where.open_input_file(path) as f:
            book = Book(f)
            for _, part in book.sheets:
                names |= {_said(v): None for _, v in sorted(next(book.rows(part), {}).items())}
        return T.StructType([T.StructField(SHEET, T.StringType()), *(T.StructField(n, T.StringType()) for n in names if n != SHEET)])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; again does no harm."""
    spark.dataSource.register(Workbook)
