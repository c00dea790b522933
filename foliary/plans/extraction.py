"""From documents to validated records: single pass, several passes, a table column, several types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary import schema as S
from foliary.functions.answers import empty_keys, missing_keys, raw_fields, relaxed, strict_errors, without_fence
from foliary.functions.encode import cell
from foliary.functions.text import is_blank
from foliary.operators.assemble import merged_parts
from foliary.operators.cache import asked_of, empty_cache, misses
from foliary.operators.keyfilter import key_filter, may_contain
from foliary.operators.providers import ANSWER
from foliary.operators.requests import (
    DEFAULT_MAX_TOKENS, TABLE_MAX_TOKENS, instruction, request_key, request_text, routed, text_part, unknown_provider,
    with_extra, with_option_defaults,
)
from foliary.operators.skew import skew_join
from foliary.operators.summary import FAILED, NO_RESULT, OK
from foliary.session import staged, written

SYSTEM = "You extract structured facts from documents."


class Provider(Protocol):
    """Answers (request_key, part, text) rows with (request_key, response_json, error)."""

    def answer(self, requests: DataFrame) -> DataFrame: ...

    def native(self, text: Column, fields: Sequence[str]) -> Column | None:
        """The answer as a column over the text, for providers that are plain expressions."""
        ...


@dataclass(frozen=True)
class Job:
    """What is asked of every document."""

    type_key: str
    record: T.StructType
    provider: Provider
    provider_name: str = "anthropic"
    model: str | None = None
    system: str = SYSTEM
    extra: str | None = None
    max_tokens: int = DEFAULT_MAX_TOKENS
    temperature: float | None = None
    analyzed_at: str | None = None
    part_size: int | None = None
    # Whether a key that the record does not have is an error.
    reject_unknown: bool = False
    # Whether the results tell which keys of the record did not come, and which came empty.
    report_keys: bool = False
    wanted: T.StructType = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "wanted", S.trimmed(self.record))

    @property
    def part_schemas(self) -> list[T.StructType]:
        return S.parts(self.record, self.part_size) if self.part_size else [self.wanted]


REPORT = ("missing_keys", "empty_keys")


@dataclass(frozen=True)
class Extraction:
    results: DataFrame
    fresh: DataFrame


def _asked_parts(job: Job, text: Column, kind: Column) -> Column:
    """array<struct<part,request_key,native_json,error>> of a job: the text enters a key as its hash.

    A provider that is a column expression reads text only, so of a document in base64 it knows nothing.
    """
    content = F.sha2(text, 256)
    error = unknown_provider(job.provider_name)
    parts = []
    for number, part in enumerate(job.part_schemas, 1):
        asked = F.concat_ws("\n", F.lit(instruction(part)), content, F.lit(job.extra))
        key = request_key(
            F.lit(job.provider_name), F.lit(job.model), F.lit(job.system), asked, F.lit(job.max_tokens),
            F.lit(job.type_key),
        )
        native = None if error else job.provider.native(F.when(kind == "text", text).otherwise(""), part.fieldNames())
        native = F.lit(None).cast("string") if native is None else native
        parts.append(F.struct(
            F.lit(number).alias("part"), key.alias("request_key"), native.alias("native_json"),
            F.lit(error).cast("string").alias("error"),
        ))
    return F.array(*parts)


def keyed_requests(docs: DataFrame, jobs: Mapping[str, Job], doc_id: str, text: str, *keep: str | Column) -> DataFrame:
    """(doc_id, type_key, parts, kept columns), written by one scan of the text; nothing heavy leaves it.

    Each document takes the job of its ``type_key`` column. A provider that is a column
    expression answers in the same scan. Written before parts are exploded, because a
    filter that the explode brings along would work out every answer twice.
    """
    typed = docs.select(doc_id, "type_key", F.col(text).alias("text"), kind_of(docs).alias("__kind"), *keep)
    return staged(_with_requests(typed, jobs), "requests")


def kind_of(docs: DataFrame) -> Column:
    """Whether a row is text or a document in base64, as ``read_documents`` says in the column ``kind``; text without one."""
    return F.coalesce("kind", F.lit("text")) if "kind" in docs.columns else F.lit("text")


def _with_requests(docs: DataFrame, jobs: Mapping[str, Job]) -> DataFrame:
    """The given columns, with ``parts`` in place of text and kind; null for a blank text or a type without job."""
    asked = None
    for type_key, job in jobs.items():
        own = F.col("type_key") == type_key
        parts = _asked_parts(job, F.col("text"), F.col("__kind"))
        asked = F.when(own, parts) if asked is None else asked.when(own, parts)
    has_text = F.col("text").isNotNull() & ~is_blank(F.col("text"))
    return docs.withColumn("parts", F.when(has_text, asked)).drop("text", "__kind")


def _exploded(keyed: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, type_key, group_key, part, request_key, native_json, error); the first part's key stands for the document."""
    return keyed.select(
        doc_id, "type_key", F.get("parts", 0)["request_key"].alias("group_key"), F.explode("parts").alias("r")
    ).select(doc_id, "type_key", "group_key", "r.*")


def answered(
    docs: DataFrame, requests: DataFrame, jobs: Mapping[str, Job], cache: DataFrame, doc_id: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """((request_key, response_json, error) of all asked keys once each, those of them the cache lacked).

    The jobs are either all native or all called; ``docs`` have the type_key of their job.
    """
    if all(_is_native(job) for job in jobs.values()):
        rows = _native_answers(requests, cache)
        return rows.drop("is_fresh"), rows.where("is_fresh").drop("is_fresh")
    fresh = _called_answers(docs, requests, jobs, cache, doc_id, text)
    known = asked_of(cache, requests).select("request_key", "response_json", no_error())
    return known.unionByName(fresh), fresh


def _is_native(job: Job) -> bool:
    return job.provider.native(F.lit(""), job.wanted.fieldNames()) is not None


def _native_answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached answer, else the one from the scan."""
    asked = requests.groupBy("request_key").agg(F.min("native_json").alias("native_json"), F.min("error").alias("error"))
    known = asked_of(cache, requests).select("request_key", F.col("response_json").alias("cached_json"))
    return asked.join(known, "request_key", "left").select(
        "request_key", F.coalesce("cached_json", "native_json").alias("response_json"),
        F.when(F.col("cached_json").isNull(), F.col("error")).alias("error"), F.col("cached_json").isNull().alias("is_fresh"),
    )


def missing_requests(
    docs: DataFrame, missing: DataFrame, jobs: Mapping[str, Job], doc_id: str, text: str
) -> DataFrame:
    """(request_key, type_key, part, kind, text) of the missing keys, once each, from the one document that stands for each.

    The keys are worked out again in the scan. A bit table of the missing (key, document) pairs lets only their texts into
    the exchange: cached and repeated texts stay where they are.
    """
    typed = docs.select(doc_id, "type_key", F.col(text).alias("text"), kind_of(docs).alias("__kind"))
    kept = typed.select("*", F.col("text").alias("body"), F.col("__kind").alias("kind"))
    asked = _with_requests(kept, jobs).select(doc_id, "type_key", "body", "kind", F.explode("parts").alias("r"))
    rows = asked.select(doc_id, "type_key", "kind", F.col("body").alias("text"), F.col("r.part"), F.col("r.request_key"))
    bits = key_filter(missing.select("request_key", doc_id))
    chosen = may_contain(rows, bits, [F.col("request_key"), F.col(doc_id)], "__asked").where("__asked")
    return (
        chosen.join(missing.select("request_key"), "request_key", "left_semi")
        .groupBy("request_key").agg(F.min(F.struct("type_key", "part", "kind", "text")).alias("r"))
        .select("request_key", "r.*")
    )


def as_sent(rows: DataFrame, jobs: Mapping[str, Job]) -> DataFrame:
    """The rows of ``missing_requests`` of the given types with the request, as a text and as a struct with all options.

    However many the types, the rows are read once: each finds the options of its type in a constant map.
    """
    options = F.create_map(*[c for type_key, job in jobs.items() for c in (F.lit(type_key), _options(job))])
    own = rows.where(F.col("type_key").isin(*jobs)).withColumn("__job", options[F.col("type_key")])
    prompt, extra = F.col("__job.prompts")[F.col("part") - 1], F.col("__job.extra")
    body = request_text(prompt, F.concat_ws("\n", F.col("text"), extra))
    parts = F.array(text_part(prompt), F.struct(F.col("kind").alias("type"), F.col("text")))
    sent = with_option_defaults(own.withColumns({
        "provider": F.col("__job.provider"), "model": F.col("__job.model"), "small_model": F.lit(None).cast("string"),
        "temperature": F.col("__job.temperature"), "max_tokens": F.col("__job.max_tokens"),
        "parts": with_extra(parts, extra), "system": F.col("__job.system"), "request_text": body,
    }))
    route, error = routed(F.col("provider"))
    request = F.struct(route.alias("provider"), "model", "system", "max_tokens", "temperature", "parts")
    return sent.select("request_key", "part", "text", "request_text", request.alias("request"), error.alias("route_error"))


def _options(job: Job) -> Column:
    return F.struct(
        F.array(*[F.lit(instruction(part)) for part in job.part_schemas]).alias("prompts"),
        F.lit(job.provider_name).alias("provider"), F.lit(job.model).cast("string").alias("model"), F.lit(job.system).cast("string").alias("system"),
        F.lit(job.extra).cast("string").alias("extra"), F.lit(job.max_tokens).cast("int").alias("max_tokens"),
        F.lit(job.temperature).cast("double").alias("temperature"),
    )


def _called_answers(
    docs: DataFrame, requests: DataFrame, jobs: Mapping[str, Job], cache: DataFrame, doc_id: str, text: str
) -> DataFrame:
    """Calls the providers for each missing key once. All types and waves read one written table of the missing texts."""
    todo = misses(requests.withColumn("ask", F.struct(doc_id)), cache, "ask")
    missing = staged(todo.select("request_key", F.col(f"ask.{doc_id}").alias(doc_id)), "missing")
    count = missing.count()
    waves = max([getattr(job.provider, "waves_for", lambda n: 1)(count) for job in jobs.values()])
    texts = staged(
        missing_requests(docs, missing, jobs, doc_id, text)
        .withColumn("wave", F.pmod(F.xxhash64("request_key"), F.lit(waves)).cast("int")),
        "asked", "wave",
    )
    # Types with the same provider are asked in one job per wave.
    by_provider: dict[int, list[str]] = {}
    for type_key, job in jobs.items():
        by_provider.setdefault(id(job.provider), []).append(type_key)
    answers = []
    for types in by_provider.values():
        job = jobs[types[0]]
        # A type whose provider is not known is refused, so nothing of it is sent.
        known = {t: jobs[t] for t in types if unknown_provider(jobs[t].provider_name) is None}
        unknown = {t: jobs[t] for t in types if t not in known}
        for wave in range(waves):
            open_texts = texts.where(F.col("wave") == wave)
            given = []
            if known:
                given.append(job.provider.answer(as_sent(open_texts, known).where("route_error is null")))
            if unknown:
                given.append(as_sent(open_texts, unknown).where("route_error is not null").select(
                    "request_key", F.lit(None).cast("string").alias("response_json"), F.col("route_error").alias("error")
                ))
            # Answers are written down wave by wave: what is written is never asked again.
            answers.append(written(reduce(DataFrame.unionByName, given), "answers"))
    return docs.sparkSession.read.schema(ANSWER).parquet(*answers)


def no_error() -> Column:
    return F.lit(None).cast("string").alias("error")


def extract(
    docs: DataFrame, job: Job, *, doc_id: str = "doc_id", path: str = "path", text: str = "text",
    cache: DataFrame | None = None,
) -> Extraction:
    """Requests, cached and fresh answers, parse, strict check, lineage. Errors are rows.

    Without a cache, a provider that is a column expression needs no exchange at all:
    the job is then one pass over the documents.
    """
    typed = docs.withColumn("type_key", F.lit(job.type_key))
    jobs = {job.type_key: job}
    if cache is None and _is_native(job) and not job.part_size:
        kept = [F.col(doc_id), F.col("type_key"), F.col(text).alias("text"), F.col(path).alias("path"),
                kind_of(docs).alias("__kind")]
        asked = _with_requests(typed.select(*kept), jobs)
        rows = checked_answers(_own_answers(asked), job.wanted, (doc_id, "path"), job.reject_unknown, job.report_keys)
        return Extraction(_shaped(rows, job, doc_id), _own_answers(asked).where("group_key is not null").groupBy(
            F.col("group_key").alias("request_key")).agg(F.min("response_json").alias("response_json"), F.min("error").alias("error")))
    cache = cache if cache is not None else empty_cache(docs.sparkSession)
    scan = keyed_requests(typed, jobs, doc_id, text, F.col(path).alias("path"))
    requests = _exploded(scan, doc_id)
    answers, fresh = answered(typed, requests, jobs, cache, doc_id, text)
    return Extraction(_results(scan, requests, answers, job, doc_id), fresh)


def _results(scan: DataFrame, requests: DataFrame, answers: DataFrame, job: Job, doc_id: str) -> DataFrame:
    """Answers are read and checked once per distinct request and only then handed to
    the documents, so copies of a document cost a lookup.
    """
    fields = job.wanted.fieldNames() if job.part_size else None
    checked = checked_answers(_raw_answers(requests, answers, fields), job.wanted, (), job.reject_unknown, job.report_keys)
    slim = scan.select(doc_id, "path", F.get("parts", 0)["request_key"].alias("group_key"))
    return _shaped(skew_join(slim, checked, ["group_key"], "left", spread=[doc_id]), job, doc_id)


def _shaped(rows: DataFrame, job: Job, doc_id: str) -> DataFrame:
    return rows.select(
        doc_id, "path", F.col("group_key").alias("request_key"), F.coalesce("status", F.lit(NO_RESULT)).alias("status"),
        F.lit(job.type_key).alias("type_key"), with_lineage("record", job, F.col("path")).alias("record"),
        "errors", "error_class", "error_message", *(REPORT if job.report_keys else ()),
    )


def _own_answers(asked: DataFrame) -> DataFrame:
    """Each document with its own native answer: group_key, response_json, raw and error in place of parts."""
    first = F.get("parts", 0)
    read = asked.select(
        *[c for c in asked.columns if c != "parts"], first["request_key"].alias("group_key"),
        first["native_json"].alias("response_json"), first["error"].alias("error"),
    )
    return read.withColumn("raw", raw_fields(without_fence(F.col("response_json"))))


def _raw_answers(requests: DataFrame, answers: DataFrame, merge_fields: Sequence[str] | None) -> DataFrame:
    """(group_key, raw, error): answers as maps, parts merged when there are any."""
    read = answers.withColumn("raw", raw_fields(without_fence(F.col("response_json"))))
    if merge_fields is None:
        return read.withColumnRenamed("request_key", "group_key")
    members = requests.groupBy("group_key", "part").agg(F.min("request_key").alias("request_key"))
    return merged_parts(members.join(read, "request_key"), ["group_key"], merge_fields, carry="error")


def checked_answers(
    answers: DataFrame, wanted: T.StructType, keep: Sequence[str] = (), reject_unknown: bool = False, report_keys: bool = False
) -> DataFrame:
    """(group_key, record, errors, status, error_class, error_message) of answers with a raw map.

    With ``report_keys`` also missing_keys and empty_keys; null where no answer could be read.
    """
    read = answers.withColumn("record", relaxed(F.col("raw"), wanted))
    if report_keys:
        read = read.withColumns({"missing_keys": missing_keys(F.col("raw"), wanted), "empty_keys": empty_keys(F.col("raw"), wanted)})
        keep = (*keep, *REPORT)
    return _with_status(read.withColumn("errors", strict_errors(F.col("raw"), F.col("record"), wanted, reject_unknown)), keep)


def _with_status(read: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows without a request get no status and no errors."""
    asked = F.col("group_key").isNotNull()
    called = F.col("error").isNotNull()
    wrong = F.size("errors") > 0
    return read.select(
        *keep, "group_key", "record", F.when(asked, F.col("errors")).alias("errors"),
        F.when(asked & (called | wrong), FAILED).when(asked, OK).alias("status"),
        F.when(~asked, F.lit(None)).when(called, "ProviderError").when(F.col("raw").isNull(), "MalformedAnswer")
        .when(wrong, "ValidationError").alias("error_class"),
        F.when(~asked, F.lit(None)).when(called, F.col("error")).when(wrong, F.array_join("errors", "; "))
        .alias("error_message"),
    )


def with_lineage(record: str, job: Job, path: Column) -> Column:
    """The record with the lineage fields the provider was never asked for; null stays null."""
    fields = [F.col(record)[f].alias(f) for f in job.wanted.fieldNames()]
    lineage = [
        path.alias("source_filename"), F.lit(job.analyzed_at).cast("timestamp_ntz").alias("analyzed_at"),
        F.lit(job.model).cast("string").alias("llm_model"),
    ]
    return F.when(F.col(record).isNotNull(), F.struct(*fields, *lineage))


def enrich_table(
    table: DataFrame, row_id: str, column: str, job: Job, prefix: str = "", cache: DataFrame | None = None
) -> DataFrame:
    """The table with one text column per field of the type, named with ``prefix``.

    Blank rows and rows with an error keep empty columns; rows are never lost. Without a
    cache, a native provider fills the columns in one pass.
    """
    if column not in table.columns:
        raise ValueError(f"Column {column!r} not found in the table")
    fields = {f.name: f.dataType for f in job.wanted.fields}
    taken = [prefix + f for f in fields if prefix + f in table.columns]
    if taken:
        raise ValueError(f"output columns already exist: {', '.join(taken)}")
    usable = F.coalesce(F.col("status") == OK, F.lit(False))
    cells = [
        F.when(usable, cell(F.col("record")[f], t)).otherwise(F.lit("")).alias(prefix + f) for f, t in fields.items()
    ]
    if cache is None and _is_native(job) and not job.part_size:
        kept = [F.lit(job.type_key).alias("type_key"), F.col(column).alias("text"), F.lit("text").alias("__kind"),
                F.struct("*").alias("row")]
        asked = _with_requests(table.select(*kept), {job.type_key: job})
        return checked_answers(_own_answers(asked), job.wanted, ("row",), job.reject_unknown).select("row.*", *cells)
    # Answers are joined by content, not by an id of the caller, which may repeat or be null.
    content = F.sha2(F.col(column), 256)
    slim = table.select(content.alias("__content"), F.col(column).alias("text"), F.lit("").alias("path"))
    done = extract(slim, job, doc_id="__content", cache=cache).results.select("__content", F.struct(*cells).alias("cells"))
    once = done.where("__content is not null").groupBy("__content").agg(F.first("cells").alias("cells"))
    found = skew_join(table.withColumn("__content", content), once, ["__content"], "left", spread=table.columns)
    return found.select(
        *[F.col(f"`{c}`") for c in table.columns],
        *[F.coalesce(F.col("cells")[prefix + f], F.lit("")).alias(prefix + f) for f in fields],
    )


def table_job(type_key: str, record: T.StructType, provider: Provider, **options: object) -> Job:
    return Job(type_key, record, provider, max_tokens=TABLE_MAX_TOKENS, **options)  # type: ignore[arg-type]


@dataclass(frozen=True)
class Dispatched:
    """Documents with the requests of their own type, and the results as one table or per type."""

    scan: DataFrame
    docs: DataFrame
    jobs: Mapping[str, Job]
    cache: DataFrame | None
    doc_id: str
    text: str

    @cached_property
    def called_answers(self) -> DataFrame:
        """Answers of all called types, asked and written down once however often results are taken."""
        jobs = {k: j for k, j in self.jobs.items() if not _is_native(j)}
        requests = _exploded(self.scan.where(F.col("type_key").isin(*jobs)), self.doc_id)
        return answered(self.docs, requests, jobs, self._cache(), self.doc_id, self.text)[0]

    def typed(self, type_key: str) -> DataFrame:
        """Results of one type, with its record as a typed struct."""
        own = self.scan.where(F.col("type_key") == type_key)
        requests, job = _exploded(own, self.doc_id), self.jobs[type_key]
        if _is_native(job):
            answers = _native_answers(requests, self._cache()).drop("is_fresh")
        else:
            answers = self.called_answers.join(requests.select("request_key").distinct(), "request_key", "left_semi")
        return _results(own.select(self.doc_id, "found.path", "parts"), requests, answers, job, self.doc_id)

    def results(self) -> DataFrame:
        """All documents in one table, the record as JSON text: one join for all types.

        A document whose classification failed is a failure; one whose type nobody gave
        a job for has no result.
        """
        keep = (self.doc_id, "path", "type_key", "why")
        files = self.scan.select(
            self.doc_id, "found.path", "type_key", F.col("found.error_message").alias("why"), "parts"
        )
        in_parts = any(j.part_size for j in self.jobs.values())
        by_call = {k: j for k, j in self.jobs.items() if not _is_native(j)}
        if self.cache is None and not in_parts and not by_call:
            rows = _with_status(self._read(_own_answers(files)), keep)
        else:
            slim = files.select(*keep, F.get("parts", 0)["request_key"].alias("group_key"))
            checked = _with_status(self._read(self._distinct_answers(by_call, in_parts)))
            rows = skew_join(slim, checked, ["group_key"], "left", spread=[self.doc_id])
        return rows.select(
            self.doc_id, "path", "type_key",
            F.coalesce("status", F.when(F.col("type_key").isNull(), FAILED).otherwise(NO_RESULT)).alias("status"),
            F.col("record").alias("record_json"), "errors", "error_class",
            F.coalesce("error_message", "why").alias("error_message"),
        )

    def _distinct_answers(self, by_call: Mapping[str, Job], in_parts: bool) -> DataFrame:
        """(group_key, type_key, raw, error) once per distinct request."""
        requests = _exploded(self.scan, self.doc_id)
        native = requests.where(~F.col("type_key").isin(*by_call)) if by_call else requests
        answers = _native_answers(native, self._cache()).drop("is_fresh")
        if by_call:
            answers = answers.unionByName(self.called_answers)
        fields = list(dict.fromkeys(f for j in self.jobs.values() for f in j.wanted.fieldNames()))
        types = requests.groupBy("group_key").agg(F.min("type_key").alias("type_key"))
        return _raw_answers(requests, answers, fields if in_parts else None).join(types, "group_key")

    def _read(self, answers: DataFrame) -> DataFrame:
        """Record as JSON text and errors, each answer by the rules of its type."""
        record, errors = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
        for type_key, job in self.jobs.items():
            own, value = F.col("type_key") == type_key, relaxed(F.col("raw"), job.wanted)
            record = F.when(own, F.to_json(value)).otherwise(record)
            errors = F.when(own, strict_errors(F.col("raw"), value, job.wanted, job.reject_unknown)).otherwise(errors)
        return answers.withColumns({"record": record, "errors": errors})

    def _cache(self) -> DataFrame:
        return empty_cache(self.docs.sparkSession) if self.cache is None else self.cache


def dispatch(
    classified_docs: DataFrame, jobs: Mapping[str, Job], *, doc_id: str = "doc_id", path: str = "path",
    text: str = "text", cache: DataFrame | None = None,
) -> Dispatched:
    """Extract each document with the job of its ``type_key``.

    Classification, keys and native answers come out of one scan of the texts; all
    else works on the slim table written by that scan.
    """
    found = F.struct(F.col(path).alias("path"), "error_message").alias("found")
    scan = keyed_requests(classified_docs, jobs, doc_id, text, found)
    return Dispatched(scan, classified_docs, jobs, cache, doc_id, text)
