"""A web API as a data source: ``spark.read.format("api_pages")``. It reads through a transport; the one that ships reads recorded answers from a folder."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NEXT = re.compile(r"<([^>]*)>[^<]*;\s*rel\s*=\s*\"?[^\";<,]*\bnext\b", re.IGNORECASE)


class FolderTransport:
    """Answers recorded as JSON files {status, headers, body}, named by a hash of the URL; what wasn't recorded is a 404."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def place(self, url: str) -> Path:
        return self.folder / f"{hashlib.sha256(url.encode()).hexdigest()[:32]}.json"

    def record(self, url: str, status: int, headers: dict[str, str], body: str) -> None:
        self.place(url).write_text(json.dumps({"status": status, "headers": headers, "body": body}))

    def get(self, url: str) -> tuple[int, dict[str, str], str | None]:
        if not self.place(url).exists():
            return 404, {}, None
        own = json.loads(self.place(url).read_text())
        return own["status"], own["headers"], own["body"]


class PageSource(DataSource):
    """Options: ``urls`` (start URLs, one a line) and ``folder`` (of the recorded answers, readable by all executors). A partition reads one start URL and its further pages."""

    @classmethod
    def name(cls) -> str:
        return "api_pages"

    def schema(self) -> str:
        return "start string, page int, url string, status int, headers map<string,string>, body string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["folder"], self.options["urls"].split("\n"))


class PageReader(DataSourceReader):
    def __init__(self, folder: str, urls: list[str]) -> None:
        self.folder, self.urls = folder, [u for u in urls if u]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        transport, url, page, seen = FolderTransport(self.folder), partition.value, 1, set()
        while url and url not in seen:
            seen.add(url)
            status, headers, body = transport.get(url)
            yield partition.value, page, url, status, headers, body
            link = next((v for k, v in headers.items() if k.lower() == "link"), "")
            more = _NEXT.search(link) if status == 200 else None
            url, page = more and more.group(1), page + 1
