"""SRC4, SRC5, SRC6, UDF7: pages of image files as a Spark data source, where a large file is read by several tasks.

    spark.dataSource.register(PageSource)
    spark.read.format("inkplan_pages").option("path", folder).load()

A file of more than `split_bytes` is planned from its page directory (a few bytes of each page), `pages` of them a partition; smaller files are put
together, up to `split_bytes` a partition, and planned by their size alone. A task seeks to each of its pages and hands it on before it reads the next,
so it holds one page. A schema without `pixels` (.schema("name string, page int, width int, height int, error string")) reads the directories only.

Defined cases: a file that isn't PNG or TIFF, or is broken, gives one row with an error in place of its pages, or after those that could be read; a
file without pages gives none; an empty folder no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import images, stores

SCHEMA = "name string, page int, width int, height int, pixels binary, error string"
SPLIT_BYTES, PAGES = 32 << 20, 16


@dataclass
class Pages(InputPartition):
    """(path, first page, end or None) of each piece."""

    pieces: list[tuple[str, int, int | None]]

    def __post_init__(self) -> None:
        self.value = self.pieces


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkplan_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "PageReader":
        return PageReader(schema, dict(self.options))


def cut_of(file) -> images.Cut:
    """Cuts of an open file; one that goes over its end is an error, not a short page."""

    def cut(at: int, n: int) -> bytes:
        file.seek(at)
        got = file.read(n)
        if len(got) < n:
            raise ValueError("the file ends too early")
        return got

    return cut


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path = options["path"]
        self.split_bytes, self.pages = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("pages", PAGES))

    def partitions(self) -> list[Pages]:
        out, small, room = [], [], self.split_bytes
        for path, size in stores.listed(self.path):
            if size > self.split_bytes and (n := self._number(path)) > self.pages:
                out += [Pages([(path, k, min(k + self.pages, n))]) for k in range(0, n, self.pages)]
                continue
            if small and size > room:
                out.append(Pages(small))
                small, room = [], self.split_bytes
            small.append((path, 0, None))
            room -= size
        return out + [Pages(small)] * bool(small)

    def _number(self, path: str) -> int:
        """The pages of a large file; 1 for one that a task shall report on."""
        try:
            store, at = stores.opened(self.path)
            with store.open_input_file(path) as f:
                return sum(1 for _ in images.directory(cut_of(f)))
        except Exception:
            return 1

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, _ = stores.opened(self.path)
        for path, first, end in partition.pieces:
            name = path.rpartition("/")[2]
            try:
                with store.open_input_file(path) as f:
                    for k, width, height, pixels in self._of(f, first, end):
                        yield self._row({"name": name, "page": k, "width": width, "height": height, "pixels": pixels})
            except Exception as e:
                yield self._row({"name": name, "error": f"{type(e).__name__}: {e}"[:300]})

    def _row(self, values: dict) -> tuple:
        return tuple(values.get(n) for n in self.names)

    def _of(self, f, first: int, end: int | None) -> Iterator[tuple]:
        cut, wanted = cut_of(f), "pixels" in self.names
        head = f.read(min(8, f.size()))
        if head == b"\x89PNG\r\n\x1a\n":
            if wanted:
                image = images.png(cut(0, f.size()))
                yield 0, image.shape[1], image.shape[0], image.tobytes()
            else:
                size = cut(16, 8)
                yield 0, int.from_bytes(size[:4], "big"), int.from_bytes(size[4:], "big"), None
        elif head[:4] in (b"II*\0", b"MM\0*"):
            for k, (order, tags) in islice(enumerate(images.directory(cut)), first, end):
                image = images.page(cut, tags, order) if wanted else None
                yield k, tags[images.WIDTH][0], tags[images.HEIGHT][0], None if image is None else image.tobytes()
        else:
            raise ValueError("neither PNG nor TIFF")
