"""Calls of external services in Arrow batches: a spreadsheet service for workbooks, a language model for texts.

The call itself is a function of the caller's, so tests and offline runs replay recorded answers. A failed call becomes a row with its
error; it never ends the job.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ServiceError(Exception):
    """An answer that is no success: status 4xx is the request's fault, 5xx the service's."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status

    @property
    def kind(self) -> str:
        return "invalid_request" if 400 <= self.status < 500 else "service_failure"


def http_workbook(url: str, timeout: float = 1800.0) -> Callable[[bytes, str], dict]:
    """A caller that posts a workbook and returns the JSON object of the answer."""

    def ask(content: bytes, name: str) -> dict:
        request = urllib.request.Request(url, data=content, headers={"Content-Type": "application/octet-stream", "X-File-Name": name}, method="POST")  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                answer = json.loads(r.read())
        except urllib.error.HTTPError as e:
            raise ServiceError(e.code, str(e)) from e
        if not isinstance(answer, dict):
            raise ServiceError(502, "the answer is no object")
        return answer

    return ask


def workbook_responses(objects: DataFrame, ask: Callable[[bytes, str], dict]) -> DataFrame:
    """One row per workbook (object_id, uri, content): status ok, invalid_request or service_failure, with the body or the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, uri, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    answer = ask(content or b"", uri.rpartition("/")[2])
                    ok = isinstance(answer, dict)
                    out.append((i, uri, "ok" if ok else "service_failure", json.dumps(answer, ensure_ascii=False) if ok else None, None if ok else "the answer is no object"))
                except ServiceError as e:
                    out.append((i, uri, e.kind, None, str(e)))
                except Exception as e:  # noqa: BLE001 (one bad workbook must not end the job)
                    out.append((i, uri, "service_failure", None, f"{type(e).__name__}: {e}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["response_id", "source_uri", "status", "body", "error"])

    return objects.select(F.col("object_id").cast("string"), F.col("uri").cast("string"), "content").mapInArrow(run, "response_id string, source_uri string, status string, body string, error string")


def completions(df: DataFrame, prompt: str, ask: Callable[[str], str], model: str, cache: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """df with completion: the model's answer to a prompt column, asked once per distinct prompt, '' after failed attempts.

    cache: prompt_hash, completion of earlier answers; only prompts without one are asked.
    """
    keyed = df.withColumn("_key", F.sha1(F.concat(F.lit(model + ":"), F.col(prompt))))
    wanted = keyed.select("_key", F.col(prompt).alias("_prompt")).filter("_key is not null").dropDuplicates(["_key"])
    known = cache.select(F.col("prompt_hash").alias("_key"), "completion") if cache is not None else None
    if known is not None:
        wanted = wanted.join(known.select("_key"), "_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                answer = ""
                for _ in range(attempts):
                    try:
                        answer = ask(p)
                        break
                    except Exception:  # noqa: BLE001, S112
                        continue
                out.append((k, answer))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["_key", "completion"])

    made = wanted.mapInArrow(run, "_key string, completion string")
    have = made if known is None else made.unionByName(known)
    return keyed.join(have, "_key", "left").drop("_key").withColumn("completion", F.coalesce("completion", F.lit("")))
