"""Pages over HTTP, fetched by the executors."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

AGENT, TIMEOUT = "glintmill/1.0", 30


def _fetched(url: str, agent: str, timeout: float) -> tuple[str | None, str | None]:
    """Text, or what went wrong."""
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
            return answer.read().decode("utf-8"), None
    except HTTPError as e:
        return None, f"HTTP {e.code}"
    except (URLError, OSError, UnicodeDecodeError) as e:
        return None, f"{type(e).__name__}: {e}"


def fetch_pages(slugs: DataFrame, base: str, suffix: str = ".md", agent: str = AGENT, timeout: float = TIMEOUT) -> DataFrame:
    """(slug, url, text, error) a row of ``slugs``: the page at base/slug, or a null text and why, so that one page's failure ends nothing.

    A lost task fetches again: write the result before it is used twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            urls = [f"{base}/{slug}{suffix}" for slug in frame["slug"]]
            texts, errors = zip(*(_fetched(u, agent, timeout) for u in urls), strict=True) if urls else ((), ())
            yield pd.DataFrame({"slug": frame["slug"], "url": urls, "text": texts, "error": errors})

    return slugs.select("slug").mapInPandas(run, "slug string, url string, text string, error string")
