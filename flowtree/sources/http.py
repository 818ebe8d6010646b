"""HTTP requests for each row, on the executors, over connections that a task keeps open, one to each host.

Requests have side effects and are repeated if a task is: they should be idempotent. The columns that they make are
not deterministic, so Catalyst neither moves nor repeats them; write the result before using it twice.
"""

from __future__ import annotations

import http.client
import json as _json
import re
import string
import time
import urllib.parse
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIED = (500, 502, 503, 504)


class RequestFailed(RuntimeError):
    """No answer after the last try."""


def fill(template: str, values: dict[str, Any]) -> str:
    """{x} replaced by values that are known; others stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values and values[m[1]] is not None else m[0], template)


class Pool:
    """Connections that stay open, one to each host; of one task, so none is used twice at a time."""

    def __init__(self, timeout: float = 30, redirects: int = 10) -> None:
        self.timeout, self.redirects = timeout, redirects
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def get(self, url: str) -> tuple[int, str]:
        """(status, body), after redirects."""
        for _ in range(self.redirects + 1):
            parts = urllib.parse.urlsplit(url)
            if parts.scheme not in ("http", "https"):
                raise RequestFailed(f"{url}: not an address of the web")
            key = (parts.scheme, parts.netloc)
            kept = key in self.open
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            conn = self.open.setdefault(key, kind(parts.netloc, timeout=self.timeout))
            try:
                conn.request("GET", urllib.parse.quote(urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), safe=string.punctuation))
                answer = conn.getresponse()
                body = answer.read()
            except (OSError, http.client.HTTPException):
                self.open.pop(key).close()
                if kept:  # the host may have closed it since; a new one says
                    continue
                raise
            if answer.status in (301, 302, 303, 307, 308) and answer.headers.get("Location"):
                url = urllib.parse.urljoin(url, answer.headers["Location"])
                continue
            return answer.status, body.decode(answer.headers.get_content_charset() or "utf-8")
        raise RequestFailed(f"{url}: too many redirects")

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()


def fetch(url: str, retries: int = 5, wait: float = 0.3, timeout: float = 30, pool: Pool | None = None) -> str:
    """The body of an answer; server errors and lost connections are tried again, each wait twice the last."""
    own = pool or Pool(timeout)
    try:
        for attempt in range(retries + 1):
            try:
                status, body = own.get(url)
                if status < 400:
                    return body
                if status not in RETRIED or attempt == retries:
                    raise RequestFailed(f"{url}: status {status}")
            except (OSError, http.client.HTTPException) as e:
                if attempt == retries:
                    raise RequestFailed(f"{url}: {e}") from e
            time.sleep(wait * 2**attempt)
        raise RequestFailed(url)
    finally:
        if pool is None:
            own.close()


def http_get(df: DataFrame, endpoint_template: str, endpoint_dict: dict[str, Any] | None = None, protocol: str = "http", retries: int = 5, json: bool = True, output_key: str = "response") -> DataFrame:
    """The answer to a GET for each row: a variant (null if it isn't JSON), or text. The row's columns fill the template, then ``endpoint_dict``."""
    fixed = dict(endpoint_dict or {})

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        pool = Pool()
        for batch in batches:
            yield pd.Series([fetch(_url(fill(fill(endpoint_template, row), fixed), protocol), retries, pool=pool) for row in batch.to_dict("records")], dtype=object)

    row = F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns), F.lit("").alias("__"))
    body = F.pandas_udf(get, "string").asNondeterministic()(row)
    return df.withColumn(output_key, F.try_parse_json(body) if json else body)


def _url(address: str, protocol: str) -> str:
    return address if "://" in address else f"{protocol}://{address}"


def _at(value: Any, path: str | list) -> Any:
    for key in path.split(".") if isinstance(path, str) else path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def http_get_pages(df: DataFrame, endpoint_template: str, pagination_get_request_key: str, pagination_key: str | list, additional_data_key: str | list, endpoint_dict: dict[str, Any] | None = None, default_offset_value: str = "", protocol: str = "http", retries: int = 5, output_key: str = "page") -> DataFrame:
    """A row for each page of each row's answer, the first included, as a variant: the next page's token is at
    ``pagination_key``, and there is one while ``additional_data_key`` holds something true."""
    fixed = dict(endpoint_dict or {})
    names = list(df.columns)

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = Pool()
        for frame in frames:
            for row in frame.to_dict("records"):
                token, seen = default_offset_value, set()
                while token not in seen:
                    seen.add(token)
                    body = fetch(_paged(_url(fill(fill(endpoint_template, {**row, pagination_get_request_key: token}), fixed), protocol), endpoint_template, pagination_get_request_key, token), retries, pool=pool)
                    yield pd.DataFrame([[*(row[n] for n in names), body]], columns=[*names, "__body"])
                    page = _json.loads(body)
                    if not _at(page, additional_data_key) or _at(page, pagination_key) is None:
                        break
                    token = _at(page, pagination_key)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "__body string"])
    return df.mapInPandas(pages, schema).withColumn(output_key, F.try_parse_json("__body")).drop("__body")


def _paged(url: str, template: str, name: str, token: Any) -> str:
    """The token goes where the template names it, else as a parameter."""
    if f"{{{name}}}" in template or token in ("", None):
        return url
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode({name: token})}"
