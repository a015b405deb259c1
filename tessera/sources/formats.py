"""Tables as text: TOML, Markdown, padded columns and a sheet that Excel opens, written as a Spark data source.

`rows.write.format("tessera_table").option("as", "toml").option("name", "x").mode("overwrite").save(path)`: a file for each
partition, in a folder that driver and executors share. Tasks write below a hidden folder of the job; only the files of
tasks that ended well are moved beside the others, when all have, so half-written ones are never seen. Rows are held on
the task's disk until the columns' widths are known, not in memory.
"""

from __future__ import annotations

import html
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

Cells = list[str | int | float | bool | None]

NUMBER = re.compile(r"-?(0|[1-9]\d{0,14})(\.\d*[1-9])?")


def shown(cell) -> str:
    return "" if cell is None else ("true" if cell else "false") if isinstance(cell, bool) else str(cell)


def number(cell) -> bool:
    """Whether a cell is a number or a text that is written exactly as the number is."""
    return not isinstance(cell, bool) and (isinstance(cell, (int, float)) or (isinstance(cell, str) and cell != "-0" and bool(NUMBER.fullmatch(cell))))


def toml(name: str, names: list[str], rows: Callable[[], Iterator[Cells]], _: list[int]) -> Iterator[str]:
    head, keys = re.sub(r"\W+", "_", name), [re.sub(r"\W+", "_", n) for n in names]
    for i, row in enumerate(rows()):
        # JSON's strings are TOML's; a null has no form there and is left out
        told = (f"{k} = {shown(c) if number(c) or isinstance(c, bool) else json.dumps(shown(c), ensure_ascii=False)}" for k, c in zip(keys, row, strict=True) if c is not None)
        yield "\n" * (i > 0) + "\n".join((f"[[{head}]]", *told)) + "\n"


def markdown(name: str, names: list[str], rows: Callable[[], Iterator[Cells]], widths: list[int]) -> Iterator[str]:
    line = lambda row: "| " + " | ".join(shown(c).ljust(w) for c, w in zip(row, widths, strict=True)) + " |\n"
    yield f"## {name}\n\n" + line(names) + line(["-" * w for w in widths])
    yield from map(line, rows())


def grid(name: str, names: list[str], rows: Callable[[], Iterator[Cells]], widths: list[int]) -> Iterator[str]:
    """Columns two blanks apart, the first to the left and the others to the right."""
    line = lambda row: "  ".join(shown(c).rjust(w) if i else shown(c).ljust(w) for i, (c, w) in enumerate(zip(row, widths, strict=True))) + "\n"
    yield line(names)
    yield from map(line, rows())


def sheet(name: str, names: list[str], rows: Callable[[], Iterator[Cells]], _: list[int]) -> Iterator[str]:
    cell = lambda c, tag: f"<{tag}{' x:num' if number(c) else ''}>{html.escape(shown(c), quote=False)}</{tag}>"
    yield f'<html xmlns:x="urn:schemas-microsoft-com:office:excel"><head><meta charset="utf-8"><title>{html.escape(name[:31], quote=False)}</title></head><body><table><thead><tr>'
    yield "".join(cell(n, "th") for n in names) + "</tr></thead><tbody>"
    for row in rows():
        yield "<tr>" + "".join(cell(c, "td") for c in row) + "</tr>"
    yield "</tbody></table></body></html>"


FORMATS = {"toml": (toml, "toml"), "markdown": (markdown, "md"), "grid": (grid, "txt"), "sheet": (sheet, "xls")}


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class TableWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.name = options["path"].removeprefix("file:"), options.get("name", "rows")
        self.kind = options.get("as", "markdown")
        if self.kind not in FORMATS:
            raise ValueError(f"as: one of {', '.join(FORMATS)}")
        self.names, self.overwrite = schema.names, overwrite
        self.hidden = os.path.join(self.path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        made, ending = FORMATS[self.kind]
        os.makedirs(self.hidden, exist_ok=True)
        file = os.path.join(self.hidden, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.{ending}")
        widths, n = [len(x) for x in self.names], 0
        with tempfile.TemporaryFile("w+", encoding="utf-8") as held:
            for row in iterator:
                cells = [c if isinstance(c, (bool, int, float, str)) or c is None else str(c) for c in row]
                held.write(json.dumps(cells) + "\n")
                widths = [max(w, len(shown(c))) for w, c in zip(widths, cells, strict=True)]
                n += 1

            def again() -> Iterator[Cells]:
                held.seek(0)
                return map(json.loads, held)

            with open(file, "w", encoding="utf-8") as out:
                out.writelines(made(self.name, self.names, again, widths))
        return Written(file, n)

    def commit(self, messages: list[Written | None]) -> None:
        before = [f for f in os.listdir(self.path) if f.startswith("part-")] if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            if m is not None:
                os.replace(m.file, os.path.join(self.path, os.path.basename(m.file)))
        for f in before:
            os.remove(os.path.join(self.path, f))
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class Tables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_table"

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tables)
