"""Answering the misses: a built-in rule extractor, and a hook for any other provider.

A provider turns (request_key, part, text) rows into (request_key, response_json, error).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, as_completed, wait
from dataclasses import dataclass, field, replace
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "request_key string, response_json string, error string"
# Answers handed on at a time.
ROWS_OUT = 256

# Patterns of the built-in rules; they read the same in Java and RE2.
DOCUMENT_RULES = {
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    "phone": r"(\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4})",
    "ip_address": r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b",
    "license": r"[Rr]eleased under the ([A-Za-z0-9. -]+?) [Ll]icen[cs]e",
}


# A text without this literal cannot match, which is far cheaper to find out.
RULE_NEEDS = {"email": "@", "ip_address": ".", "license": "eleased under the "}


@dataclass(frozen=True)
class RuleProvider:
    """First match of each pattern, as native columns; a field without a match is blank and so reads as null."""

    rules: Mapping[str, str] = field(default_factory=lambda: dict(DOCUMENT_RULES))
    needs: Mapping[str, str] = field(default_factory=lambda: dict(RULE_NEEDS))

    def _match(self, text: Column, name: str) -> Column:
        found = F.regexp_extract(text, self.rules[name], 1)
        needed = self.needs.get(name)
        return found if needed is None else F.when(F.contains(text, F.lit(needed)), found).otherwise("")

    def native(self, text: Column, fields: Sequence[str]) -> Column:
        found = [self._match(text, n).alias(n) for n in fields if n in self.rules]
        return F.to_json(F.struct(*found)) if found else F.lit("{}")

    def answer(self, requests: DataFrame) -> DataFrame:
        body = self.native(F.col("text"), list(self.rules))
        return requests.select("request_key", body.alias("response_json"), F.lit(None).cast("string").alias("error"))


@dataclass(frozen=True)
class CallProvider:
    """Calls ``connect()`` once per task and the returned function once per request, ``in_flight`` calls at a time.

    The function gets the text of the request, or with ``send="request"`` all of it as a mapping: provider, model, system,
    max_tokens, temperature and parts (each with type and text, where a PDF is a ``document`` in base64). At most
    ``concurrency`` tasks call at the same time and a task makes about ``calls_per_task`` calls: what is more waits for
    the next wave. A wave is a Spark job of its own, so there are at most ``most_waves`` of them, and beyond that their tasks
    make more calls. Inside a task a window of calls is open: a further request is read only when one of them has ended, so
    neither requests nor answers pile up. The function must bear calls from several threads (or take ``in_flight=1``).
    ``calls_per_second`` spaces the calls of a task. A failing call is repeated after ``pause`` seconds, doubled each time, as long as
    ``retries`` of ``calls_per_task`` calls last; then it is an error row, and it never fails the job. The extraction job writes
    the answers down once per wave, so a lost executor costs no more than the calls of one.
    """

    connect: Callable[[], Callable[..., str]]
    concurrency: int = 32
    waves: int = 1
    send: str = "request_text"
    calls_per_task: int = 1000
    in_flight: int = 32
    calls_per_second: float | None = None
    retries: int = 0
    pause: float = 0.5
    most_waves: int = 16

    def waves_for(self, requests: int) -> int:
        return max(self.waves, 1, min(self.most_waves, -(-requests // (self.concurrency * self.calls_per_task))))

    def native(self, text: Column, fields: Sequence[str]) -> None:
        return None

    def answer(self, requests: DataFrame) -> DataFrame:
        connect, send, pump = self.connect, self.send, replace(self, connect=None)

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sent = ((key, what) for batch in batches for key, what in zip(batch["request_key"], batch[send]))
            rows: list[tuple[str, str | None, str | None]] = []
            for row in pump.pumped(connect(), sent):
                rows.append(row)
                if len(rows) == ROWS_OUT:
                    yield pd.DataFrame(rows, columns=["request_key", "response_json", "error"])
                    rows = []
            yield pd.DataFrame(rows, columns=["request_key", "response_json", "error"])

        return requests.select("request_key", send).repartition(self.concurrency).mapInPandas(call, ANSWER)

    def pumped(self, ask: Callable[..., str], requests: Iterable[tuple[str, object]]) -> Iterator[tuple[str, str | None, str | None]]:
        """(key, answer, error) of all requests, as they end; at most ``in_flight`` are open."""
        gate = Lock()
        left, next_call = self.retries, 0.0

        def turn() -> None:
            """Waits for this call's place in the rate."""
            nonlocal next_call
            if self.calls_per_second:
                with gate:
                    at = next_call = max(time.monotonic(), next_call) + 1 / self.calls_per_second
                time.sleep(max(0.0, at - 1 / self.calls_per_second - time.monotonic()))

        def again() -> bool:
            nonlocal left
            with gate:
                left -= 1
                return left >= 0

        def renew() -> None:
            nonlocal left
            with gate:
                left = self.retries

        def one(key: str, what: object) -> tuple[str, str | None, str | None]:
            pause = self.pause
            while True:
                turn()
                try:
                    return key, ask(what), None
                except Exception as exc:  # noqa: BLE001 - reported as a row
                    if not again():
                        return key, None, f"{type(exc).__name__}: {exc}"
                time.sleep(pause)
                pause *= 2

        with ThreadPoolExecutor(self.in_flight) as pool:
            open_calls: set[Future] = set()
            for number, (key, what) in enumerate(requests):
                if number % self.calls_per_task == 0:
                    renew()
                open_calls.add(pool.submit(one, key, what))
                if len(open_calls) >= self.in_flight:
                    ended, open_calls = wait(open_calls, return_when=FIRST_COMPLETED)
                    yield from (f.result() for f in ended)
            yield from (f.result() for f in as_completed(open_calls))
