"""A sink that writes rows as files of their own names.

``df.write.format("named_files").mode("append").save(folder)`` writes the column ``data``
(binary or string) of each row to ``folder/name``. A task writes to a folder of its own
attempt; only when all tasks are done does the job move the files of the attempts that
count to their names and remove what is left. So a task that fails, is repeated or runs
twice leaves no half file, and a job that fails leaves none at all; what had a name
before is replaced at the end, whole. The folder has to be one that the driver and the executors share: a
path, or an address that Arrow's file systems know.

Names may have folders (``systems/system_0001.png``); one that leaves the folder, is empty
or null, or that two rows have, fails the job (``checked`` tells names before).
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"
#: Folder of the attempts, beside the files.
ATTEMPTS = "_attempts"


def file_system(address: str):
    """Arrow's file system and the path there."""
    from pyarrow import fs

    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file://") else address)
    return fs.LocalFileSystem(), address


def problem_of(name: str | None) -> str | None:
    """Why a name can't be one of a file inside the folder."""
    if not name:
        return "no name"
    if name.startswith("/") or name != posixpath.normpath(name) or name.split("/")[0] in ("..", ".", ATTEMPTS) or "\0" in name:
        return f"{name!r} isn't the name of a file inside the folder"
    return None


@dataclass
class Written(WriterCommitMessage):
    """An attempt that is done: its folder and its number of files."""

    folder: str
    n: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, address: str, name: int, data: int):
        self.address, self.name, self.data = address, name, data
        self.job = f"{ATTEMPTS}/{uuid.uuid4().hex}"

    def begin(self) -> NamedFilesWriter:
        """Makes the job's folder. Attempts make none above their own: those that outlive their job can't bring it back."""
        system, base = file_system(self.address)
        system.create_dir(f"{base}/{self.job}", recursive=True)
        return self

    def write(self, iterator) -> Written:
        system, base = file_system(self.address)
        folder, made, n = f"{self.job}/{uuid.uuid4().hex}", set(), 0
        try:
            system.create_dir(f"{base}/{folder}", recursive=False)
            for row in iterator:
                name, data = row[self.name], row[self.data]
                if (why := problem_of(name)) is not None:
                    raise ValueError(why)
                for end in (k for k, c in enumerate(name) if c == "/"):
                    if name[:end] not in made:
                        system.create_dir(f"{base}/{folder}/{name[:end]}", recursive=False)
                        made.add(name[:end])
                with system.open_output_stream(f"{base}/{folder}/{name}") as out:
                    out.write(data.encode() if isinstance(data, str) else bytes(data or b""))
                n += 1
        except BaseException:
            removed(system, f"{base}/{folder}")
            raise
        return Written(folder, n)

    def _files(self, message: Written) -> list[str]:
        from pyarrow import fs

        system, base = file_system(self.address)
        if not message.n:
            return []
        top = f"{base}/{message.folder}"
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        paths = sorted(x.path for x in found if x.type == fs.FileType.File)
        names = [p[p.rindex(message.folder) + len(message.folder) + 1 :] for p in paths]
        if len(names) != message.n:
            raise ValueError(f"an attempt wrote {message.n} files, of which {len(names)} are there: two rows have one name")
        return names

    def commit(self, messages: list) -> None:
        system, base = file_system(self.address)
        attempts = [m for m in messages if m is not None]
        names = [self._files(m) for m in attempts]
        every = [n for each in names for n in each]
        if len(set(every)) < len(every):
            self.abort(messages)
            twice = sorted({n for n in every if every.count(n) > 1})[:3] if len(every) < 10_000 else ""
            raise ValueError(f"two rows have one name {twice}")
        made = set()
        for m, each in zip(attempts, names, strict=True):
            for name in each:
                to = f"{base}/{name}"
                if (parent := posixpath.dirname(to)) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                system.move(f"{base}/{m.folder}/{name}", to)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes what this job's attempts left; another job's attempts stay."""
        from pyarrow import fs

        system, base = file_system(self.address)
        removed(system, f"{base}/{self.job}")
        top = f"{base}/{ATTEMPTS}"
        try:
            if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(top)):
                system.delete_dir(top)
        except OSError:
            pass  # another job has begun


def removed(system, folder: str) -> None:
    """Removes a folder in which an attempt may still be writing."""
    for _ in range(5):
        try:
            system.delete_dir(folder)
        except FileNotFoundError:
            return
        except OSError:
            continue


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("named_files only appends: files of the same names are replaced, others stay")
        names = [f.name for f in schema.fields]
        if not {"name", "data"} <= set(names):
            raise ValueError("named_files needs the columns name and data")
        return NamedFilesWriter(self.options["path"], names.index("name"), names.index("data")).begin()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def checked(files: DataFrame, name: str = "name") -> DataFrame:
    """``name n``: names that several rows have or that are none."""
    plain = F.col(name).rlike(r"^(?!_attempts/|/)(?!\.{1,2}(/|$))[^\x00]+$") & ~F.col(name).rlike(r"//|/\.{0,2}(/|$)")
    return files.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | ~F.coalesce(plain, F.lit(False)))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes ``name data`` as files of the folder."""
    register(files.sparkSession)
    files.select("name", "data").write.format(FORMAT).mode("append").save(folder)
