"""Writes of one file a partition: each under another name beside its place, renamed on commit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from helica.functions.names import parse_boolean
from helica.sources.files import create, delete, exists, join, make_folder, move, names_in


@dataclass
class PartFile(WriterCommitMessage):
    """A written file, where it belongs, and the endings of files that go with it."""

    path: str
    final: str
    sides: tuple[str, ...] = ()


class PartFolder(DataSourceArrowWriter):
    """Base of the writers; the folder may be a path or a URI that pyarrow knows."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.with_header = parse_boolean(options.get("writeheader"), True)
        if names_in(self.folder) and not overwrite:
            raise FileExistsError(self.folder)

    def new_part(self, *sides: str) -> PartFile:
        make_folder(self.folder)
        name = f"part-{TaskContext.get().partitionId():05d}{self.suffix}"
        return PartFile(join(self.folder, f"_{name}.{uuid.uuid4().hex}"), join(self.folder, name), sides)

    def commit(self, messages: list[PartFile | None]) -> None:
        make_folder(self.folder)
        if self.overwrite:
            for name in names_in(self.folder):
                if name.startswith("part-") or name == "_SUCCESS":
                    delete(join(self.folder, name))
        for m in messages:
            for side in ("", *m.sides) if m else ():
                move(m.path + side, m.final + side)
        with create(join(self.folder, "_SUCCESS")):
            pass

    def abort(self, messages: list[PartFile | None]) -> None:
        for m in messages:
            for side in ("", *m.sides) if m else ():
                if exists(m.path + side):
                    delete(m.path + side)
