"""Image folders as a data source: folders are listed by the tasks that read them.

``spark.read.format("media_folders").load(path)`` gives (content_id, image, path, length, content) of
``<path>/<content id>/<image>``. The driver lists nothing: it makes one partition for each prefix of the content ids
(option ``prefixes``, one list of beginnings with commas between them; ids that begin otherwise are in a partition of their own), and every task lists the
folders with its prefix. A filter on ``content_id`` (equal to, in, starts with) leaves only the partitions and
folders that can match; with named ids no listing of the parent takes place at all.

The option ``bytes`` set to ``false`` leaves the content NULL, so that no file is read. Paths are those that
pyarrow can open (local folders, hdfs://, s3:// and the like). A missing folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
)

from authorloom.schemas import MEDIA

PREFIXES = ",".join("0123456789abcdef")
BATCH_BYTES = 8 << 20


class PrefixPartition(InputPartition):
    """Folders that begin with ``prefix``, or with none of ``others`` if that is empty."""

    def __init__(self, prefix: str, others: tuple[str, ...] = (), ids: tuple[str, ...] | None = None):
        super().__init__(prefix)
        self.prefix, self.others, self.ids = prefix, others, ids

    def holds(self, name: str) -> bool:
        if self.prefix:
            return name.startswith(self.prefix)
        return not name.startswith(self.others) if self.others else True


class MediaFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self):
        return MEDIA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.prefixes = tuple(p for p in options.get("prefixes", PREFIXES).split(",") if p)
        self.with_bytes = options.get("bytes", "true").lower() != "false"
        self.ids: tuple[str, ...] | None = None
        self.starts: tuple[str, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on content_id choose folders; Spark applies the rest."""
        for one in filters:
            named = getattr(one, "attribute", None) == ("content_id",)
            if named and isinstance(one, EqualTo):
                self._only((one.value,))
            elif named and isinstance(one, In):
                self._only(tuple(one.value))
            elif named and isinstance(one, StringStartsWith):
                self.starts = (*self.starts, one.value)
            else:
                yield one

    def _only(self, ids: tuple) -> None:
        ids = {i for i in ids if i is not None}
        self.ids = tuple(sorted(ids if self.ids is None else ids & set(self.ids)))

    def _wanted(self, name: str) -> bool:
        return all(name.startswith(s) for s in self.starts) and (self.ids is None or name in self.ids)

    def partitions(self) -> list[PrefixPartition]:
        if self.ids is not None:
            parts = [PrefixPartition(p, (), tuple(i for i in self.ids if i.startswith(p))) for p in self.prefixes]
            rest = tuple(i for i in self.ids if not i.startswith(self.prefixes or ("",)))
            found = [p for p in [*parts, PrefixPartition("", self.prefixes, rest)] if p.ids]
            return found or [PrefixPartition("", (), ())]
        every = [PrefixPartition(p) for p in self.prefixes] + [PrefixPartition("", self.prefixes)]
        return [
            p for p in every if not p.prefix or all(p.prefix.startswith(s) or s.startswith(p.prefix) for s in self.starts)
        ]

    def read(self, partition: PrefixPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

        def listed(folder: str) -> list:
            return files.get_file_info(fs.FileSelector(folder, allow_not_found=True))

        if partition.ids is None:
            folders = [i.base_name for i in listed(root) if i.type == fs.FileType.Directory]
            folders = [name for name in folders if partition.holds(name) and self._wanted(name)]
        else:
            folders = [name for name in partition.ids if self._wanted(name)]
        rows, size = [], 0
        for name in sorted(folders):
            for info in sorted(listed(f"{root}/{name}"), key=lambda i: i.base_name):
                if info.type != fs.FileType.File:
                    continue
                content = None
                if self.with_bytes:
                    with files.open_input_stream(info.path) as stream:
                        content = stream.read()
                rows.append((name, info.base_name, f"{self.path}/{name}/{info.base_name}", info.size, content))
                size += info.size if self.with_bytes else 0
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema(
    [("content_id", pa.string()), ("image", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaFolders)
