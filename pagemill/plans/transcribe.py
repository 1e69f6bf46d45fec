"""Calling a transcription model: retries, a time limit, bounded concurrency, and errors as data."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

#: Attempts after the first, first pause (doubled each time), seconds for a page, calls at once; fixed values.
RETRIES, PAUSE, PAGE_SECONDS, CONCURRENCY = 2, 1.0, 150.0, 8
#: Rows of a batch that are read at once, and answers that make one; a row may hold an image.
TAKEN, GIVEN = 16, 64
PAGE_PROMPT = "Transcribe this page to Markdown. Keep headings, lists and tables; do not summarise or invent anything."
IMAGE_PROMPT = "Write down the text in this image. Answer [logo] for a logo and [装饰图片] for decoration."


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Transcriber(Protocol):
    """Anything that turns a job into text. It is sent to the executors, so it opens its client on first use."""

    def __call__(self, job: dict, prompt: str) -> Reply: ...


class Hopeless(RuntimeError):
    """An error that another attempt cannot mend."""


class NoModel:
    """Stands where no provider is configured: every page that needs a model is reported, none is invented."""

    def __call__(self, job: dict, prompt: str) -> Reply:
        raise Hopeless("no model provider is configured")


@dataclass
class StandIn:
    """A deterministic model for tests: answers with the job's own text, counts characters as tokens, fails where told."""

    field_name: str = "hint"
    fail_on: tuple = field(default_factory=tuple)

    def __call__(self, job: dict, prompt: str) -> Reply:
        if job.get("page_number") in self.fail_on:
            raise RuntimeError("stand-in failure")
        text = job.get(self.field_name) or ""
        return Reply(text, len(prompt), len(text))


def attempt(call: Callable[[], Reply], retries: int = RETRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """``call``, tried again after growing pauses; the last error is raised, a hopeless one at once."""
    for k in range(retries + 1):
        try:
            return call()
        except Hopeless:
            raise
        except Exception:
            if k == retries:
                raise
            sleep(pause * 2**k)
    raise AssertionError


def answered(jobs: Iterable[dict], call: Callable[[dict], Reply], concurrency: int, seconds: float | None) -> Iterator[tuple[dict, Reply | Exception | None]]:
    """Each job with its reply, its error, or None if it took longer than ``seconds`` from its own start; as they finish.

    At most ``concurrency`` calls count at once. A late call's thread can't be stopped, but it is given up: its place is
    free for the next job, and nobody waits for it at the end.
    """
    source, done = iter(jobs), queue.SimpleQueue()
    running: dict[int, tuple[dict, float]] = {}
    number, left = 0, True

    def work(k: int, job: dict) -> None:
        try:
            done.put((k, call(job)))
        except Exception as e:
            done.put((k, e))

    while left or running:
        while left and len(running) < concurrency:
            job = next(source, None)
            if job is None:
                left = False
                break
            running[number] = (job, time.monotonic() + seconds if seconds is not None else float("inf"))
            threading.Thread(target=work, args=(number, job), daemon=True).start()
            number += 1
        if not running:
            continue
        wait = min(end for _, end in running.values()) - time.monotonic()
        try:
            k, reply = done.get(timeout=max(0.0, wait) if wait != float("inf") else None)
            if k in running:  # else it was given up
                yield running.pop(k)[0], reply
        except queue.Empty:
            now = time.monotonic()
            for k in [k for k, (_, end) in running.items() if end <= now]:
                yield running.pop(k)[0], None


RESULT = "text string, error string, prompt_tokens bigint, completion_tokens bigint"


def transcribe(jobs: DataFrame, model: Transcriber, prompt: str = PAGE_PROMPT, concurrency: int = CONCURRENCY, seconds: float | None = PAGE_SECONDS, retries: int = RETRIES, pause: float = PAUSE, image: Callable[[dict], bytes] | None = None) -> DataFrame:
    """``jobs`` (without a column ``image``) with ``text, error, prompt_tokens, completion_tokens``.

    A task keeps ``concurrency`` calls going. A call that fails or takes longer than ``seconds``, its retries included,
    gives a row with an error instead of failing the task; an answer without text is ''. ``image`` makes a job's picture
    in the thread that sends it, so a task holds as many pictures as it has calls.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = StructType([*(f for f in jobs.schema.fields if f.name != "image"), *_parse_datatype_string(RESULT).fields])
    arrow = to_arrow_schema(out)

    def ask(job: dict) -> Reply:
        return attempt(lambda: model({**job, "image": image(job)} if image else job, prompt), retries, pause)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, TAKEN) for r in b.slice(at, TAKEN).to_pylist())
        given: list[dict] = []
        for job, reply in answered(rows, ask, concurrency, seconds):
            job.pop("image", None)
            if isinstance(reply, Reply):
                job |= {"text": reply.text or "", "error": None, "prompt_tokens": reply.prompt_tokens, "completion_tokens": reply.completion_tokens}
            else:
                late = f"第{job.get('page_number', '?')}页 vision OCR 超时（>{seconds:g}s）" if reply is None else str(reply) or type(reply).__name__
                job |= {"text": None, "error": late, "prompt_tokens": 0, "completion_tokens": 0}
            given.append(job)
            if len(given) == GIVEN:
                yield pa.RecordBatch.from_pylist(given, schema=arrow)
                given = []
        if given:
            yield pa.RecordBatch.from_pylist(given, schema=arrow)

    return jobs.mapInArrow(run, out)
