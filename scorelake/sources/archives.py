"""ZIP archives as tables of their members."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame


def members(archives: DataFrame, keys: list[str], content: str = "content", only: str = ".*") -> DataFrame:
    """``keys name data error``: one row per member whose whole name ``only`` matches, in the archive's order.

    ``content`` holds an archive's bytes, as the ``binaryFile`` source reads them. What
    isn't an archive, or a member that can't be read, is a row with an error and no
    data; a null archive has no rows. One member is in memory at a time.
    """
    fields = ", ".join(f"`{k}` {archives.schema[k].dataType.simpleString()}" for k in keys)
    wanted = re.compile(only)

    def read(raw: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for name in z.namelist():
                    if wanted.fullmatch(name):
                        try:
                            yield name, z.read(name), None
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                            yield name, None, str(e)
        except zipfile.BadZipFile as e:
            yield None, None, str(e)

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(len(keys))[i].as_py()
                for name, data, error in read(raw) if raw is not None else ():
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(j).slice(i, 1) for j in range(len(keys))), pa.array([name], pa.string()), pa.array([data], pa.binary()), pa.array([error], pa.string())],
                        names=[*keys, "name", "data", "error"],
                    )

    return archives.select(*keys, content).mapInArrow(task, f"{fields}, name string, data binary, error string")
