"""Page text from HTML with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKS = frozenset(("p", "div", "br", "li", "tr"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def _line(self) -> None:
        if self.parts and not self.parts[-1].endswith("\n"):
            self.parts.append("\n")

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in BREAKS:
            self._line()

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in BREAKS:
            self._line()

    def handle_data(self, data):
        if not self.hidden and data:
            self.parts.append(data)


def html_to_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def read_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): line breaks at the starts and ends of blocks; null HTML gives empty text."""
    schema = f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "text": [html_to_text(h) if isinstance(h, str) else "" for h in f[html_col]]})

    return pages.select(F.col(id_col), F.col(html_col)).mapInPandas(run, schema)
