from __future__ import annotations

import threading
import time

from pyspark.sql import types as T

from foliary.operators.providers import CallProvider
from foliary.plans.extraction import Job, dispatch, extract
from foliary.schema import field


class Meter:
    """A provider that takes a while and notes how many calls are open at once."""

    def __init__(self, seconds=0.02):
        self.seconds, self.open, self.most, self.lock = seconds, 0, 0, threading.Lock()

    def __call__(self, what):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        time.sleep(self.seconds)
        with self.lock:
            self.open -= 1
        if what == "bad":
            raise ValueError("no answer")
        return f"<{what}>"


def test_a_window_of_calls_is_open():
    meter, taken = Meter(), []

    def requests():
        for i in range(200):
            taken.append(i)
            yield str(i), i

    pump = CallProvider(None, in_flight=32).pumped(meter, requests())
    first = next(pump)
    assert len(taken) <= 33  # no request is read before a call has ended
    rows = [first, *pump]
    assert sorted(rows) == sorted((str(i), f"<{i}>", None) for i in range(200)) and 16 < meter.most <= 32


def test_one_call_at_a_time():
    meter = Meter(0.001)
    assert len(list(CallProvider(None, in_flight=1).pumped(meter, ((str(i), i) for i in range(20))))) == 20
    assert meter.most == 1


def test_retries_have_a_budget_per_task():
    calls = []

    def ask(what):
        calls.append(what)
        if what == "bad" or (what == "late" and calls.count("late") < 3):
            raise ValueError("no answer")
        return what

    provider = CallProvider(None, in_flight=1, retries=4, pause=0.001)
    rows = list(provider.pumped(ask, [("a", "late"), ("b", "bad"), ("c", "fine"), ("d", "bad")]))
    assert rows == [("a", "late", None), ("b", None, "ValueError: no answer"), ("c", "fine", None), ("d", None, "ValueError: no answer")]
    assert calls == ["late"] * 3 + ["bad"] * 3 + ["fine", "bad"]


def test_calls_are_spaced():
    start = time.monotonic()
    assert len(list(CallProvider(None, calls_per_second=100).pumped(lambda w: "x", ((str(i), i) for i in range(21))))) == 21
    assert 0.19 < time.monotonic() - start < 2


RECORD = T.StructType([
    field("who", T.StructType([field("kind", required=True, enum=("a", "b")), field("n", T.LongType(), default=7)]), required=True),
    field("tags", T.ArrayType(T.StringType())),
])


def test_all_called_paths_agree(spark):
    def connect():
        def ask(what):
            if "uno-1" in what:
                return '{"who": {"kind": 5}, "tags": ["x", 3]}'
            if "dos-2" in what:
                return '{"who": {"kind": "a"}, "tags": []}'
            return '{"who": {}}'

        return ask

    docs = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(("uno-1", "dos-2", "tres-3"))], "doc_id long, path string, text string")
    wanted = {
        0: ("failed", ["who.kind: type", "tags[1]: type"]), 1: ("ok", []), 2: ("failed", ["who.kind: missing"]),
    }

    def found(rows):
        return {r.doc_id: (r.status, r.errors) for r in rows.collect()}

    provider = CallProvider(connect, concurrency=2)
    whole, parts = Job("t", RECORD, provider), Job("t", RECORD, provider, part_size=1)
    typed = docs.selectExpr("*", "'t' AS type_key", "CAST(NULL AS STRING) AS error_message")
    assert found(extract(docs, whole).results) == wanted
    assert found(extract(docs, parts).results) == wanted
    for job in (whole, parts):
        done = dispatch(typed, {"t": job})
        assert found(done.results()) == found(done.typed("t")) == wanted
    ok = extract(docs, whole).results.where("doc_id = 1").first()
    assert ok.record.who.n == 7


def test_unknown_keys_can_be_errors(spark):
    docs = spark.createDataFrame([(1, "p", "one")], "doc_id long, path string, text string")
    provider = CallProvider(lambda: lambda what: '{"who": {"kind": "a"}, "more": 1}', concurrency=1)
    assert extract(docs, Job("t", RECORD, provider)).results.first().status == "ok"
    assert extract(docs, Job("t", RECORD, provider, reject_unknown=True)).results.first().errors == ["more: unknown"]


def test_retries_come_anew_with_each_share_of_calls():
    calls = []

    def ask(what):
        calls.append(what)
        if calls.count(what) == 1:
            raise ValueError("no answer")
        return what

    provider = CallProvider(None, in_flight=1, retries=2, pause=0.001, calls_per_task=2)
    rows = list(provider.pumped(ask, [(str(i), str(i)) for i in range(6)]))
    assert rows == [(str(i), str(i), None) for i in range(6)]


def noted(monkeypatch):
    """What providers are asked to answer, one table per wave."""
    asked, answer = [], CallProvider.answer
    monkeypatch.setattr(CallProvider, "answer", lambda self, requests: asked.append(requests) or answer(self, requests))
    return asked


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_waves_do_not_grow_with_the_input(spark, monkeypatch):
    assert CallProvider(None, concurrency=8).waves_for(8_001) == 2
    assert CallProvider(None, concurrency=8).waves_for(3_000_000) == 16
    assert CallProvider(None, waves=40).waves_for(1) == 40
    docs = spark.range(40).selectExpr("id AS doc_id", "'p' AS path", "concat('text ', id) AS text")
    asked, provider = noted(monkeypatch), CallProvider(lambda: lambda what: '{"who": {"kind": "a"}}', concurrency=1, calls_per_task=1)
    done = extract(docs, Job("t", RECORD, provider))
    assert len(asked) == 16 and sum(r.count() for r in asked) == 40
    assert done.results.where("status = 'ok'").count() == 40
    assert plan_of(done.fresh).count("Relation") == 1


def test_types_of_one_provider_are_read_once(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"p{i}", f"text {i}", t, None) for i, t in enumerate(("a", "b", "c", "a", None, "d"))],
        "doc_id long, path string, text string, type_key string, error_message string",
    )
    asked, provider = noted(monkeypatch), CallProvider(lambda: lambda what: "{}", concurrency=2)
    other = T.StructType([field("place")])
    jobs = {
        "a": Job("a", RECORD, provider, model="m", extra="Be brief.", max_tokens=9),
        "b": Job("b", other, provider, provider_name="openai", system="s", temperature=0.5),
        "c": Job("c", RECORD, provider, provider_name="Nobody"),
    }
    found = {r.doc_id: (r.status, r.error_message) for r in dispatch(docs, jobs).results().collect()}
    assert found[2] == ("failed", "Unknown provider 'nobody'") and found[1] == ("ok", None) and found[5] == ("no_result", None)
    (wave,) = asked
    assert plan_of(wave).count("Relation") == 1
    sent = {r.text: r for r in wave.collect()}
    assert sorted(sent) == ["text 0", "text 1", "text 3"]
    a, b = sent["text 0"].request, sent["text 1"].request
    assert (a.provider, a.model, a.max_tokens, a.temperature, len(a.parts)) == ("anthropic", "m", 9, 0.0, 3)
    assert (b.provider, b.model, b.max_tokens, b.temperature, len(b.parts)) == ("openai", "gpt-4.1", 2048, 0.5, 2)
    assert b.system == "s" and "place" in sent["text 1"].request_text and "Be brief." in sent["text 0"].request_text
