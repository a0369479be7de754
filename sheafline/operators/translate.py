"""The external translate stage, over a pluggable translator.

A page is one row with its requests, so a page's mode, retries and result stay
together and pages run as parallel as partitions. Answers can be kept in a folder
(``Answers``), by the hash of what was asked, so that neither a repeated job nor a
repeated task pays for a call twice.
"""

from __future__ import annotations

import hashlib
import json
import queue
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from sheafline.functions import text as T
from sheafline.functions.geometry import is_proper
from sheafline.operators import replies, units
from sheafline.schema import LANGUAGES, MISSING, TextSettings
from sheafline.session import ship, write_whole


class RateLimited(Exception):
    """The service asks for a pause."""


class Cancelled(Exception):
    """The job is to stop."""


class EmptyAnswer(Exception):
    """A page's answers have no text."""


class Translator(Protocol):
    """Sends one request; raises RateLimited, TimeoutError or another exception if it fails."""

    def __call__(self, system: str, user: str) -> str: ...


def stub(system: str, user: str) -> str:
    """The deterministic translator of tests: two letters become one."""
    return user.replace("th", "z")


# --- providers ------------------------------------------------------------------------------

# Where an answer lies in a reply, by kind of provider.
ANSWER_PATHS = {"hosted": "choices[0].message.content", "local": "message.content", "custom": "choices[0].message.content"}
# Limits of hosted requests.
MOST_TOKENS, TEMPERATURE = 4096, 0.1


@dataclass(frozen=True)
class Provider:
    """Where and how requests go.

    ``hosted``: a chat service with a key; ``local``: a chat server without; ``custom``:
    JSON templates of headers, with {apiKey}, and body, with {model}, {systemPrompt}, {userPrompt}.
    """

    kind: str
    endpoint: str = ""
    model: str = ""
    key: str = ""
    headers: str = ""
    body: str = ""
    answer_path: str = ""


def _json_escaped(text: str) -> str:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, escaped)
    return text


def request_of(p: Provider, system: str, user: str) -> dict[str, object]:
    """url, headers, body and answer path of one request; ValueError where the provider lacks something."""
    if not p.endpoint:
        raise ValueError("the provider has no endpoint")
    headers = {"Content-Type": "application/json"}
    messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    url, path = p.endpoint, p.answer_path if p.kind == "custom" and p.answer_path else ANSWER_PATHS.get(p.kind, "")
    if p.kind == "hosted":
        if not p.key:
            raise ValueError("the provider has no key")
        headers["Authorization"] = f"Bearer {p.key}"
        body: object = {"model": p.model, "messages": messages, "max_tokens": MOST_TOKENS, "temperature": TEMPERATURE}
    elif p.kind == "local":
        if not p.model:
            raise ValueError("the provider has no model")
        url, body = p.endpoint.removesuffix("/") + "/api/chat", {"model": p.model, "stream": False, "messages": messages}
    elif p.kind == "custom":
        if not p.body:
            raise ValueError("the provider has no body")
        if p.headers:
            headers |= json.loads(p.headers.replace("{apiKey}", p.key))
        body = json.loads(p.body.replace("{model}", p.model).replace("{systemPrompt}", _json_escaped(system)).replace("{userPrompt}", _json_escaped(user)))
    else:
        raise ValueError(f"no provider is of kind {p.kind}")
    return {"url": url, "headers": headers, "body": json.dumps(body), "path": path}


def value_at(document: object, path: str) -> object | None:
    """The value at a dotted and indexed path of a JSON document; None where the path ends early."""
    for key in re.sub(r"\[(\w+)\]", r".\1", path).removeprefix(".").split("."):
        if isinstance(document, dict):
            document = document.get(key)
        elif isinstance(document, list) and key.isdigit() and int(key) < len(document):
            document = document[int(key)]
        else:
            return None
    return document


Send = Callable[[dict[str, object]], tuple[int, str]]


def provider_translator(p: Provider, send: Send) -> Translator:
    """A translator over a provider. ``send`` takes a request and gives status and body; it raises TimeoutError if it takes too long."""

    def translate(system: str, user: str) -> str:
        request = request_of(p, system, user)
        status, body = send(request)
        try:
            reply: object = json.loads(body)
        except ValueError:
            reply = None
        if status == 200:
            found = value_at(reply, str(request["path"]))
            return found.strip() if isinstance(found, str) else ""
        message = value_at(reply, "error.message") or body
        if status == 429 or "rate limit" in str(message).lower():
            raise RateLimited(message)
        raise RuntimeError(f"status {status}: {message}")

    return translate


def limited(translator: Translator, system: str, user: str, seconds: float) -> str:
    """One request; TimeoutError where it takes longer, whatever the translator does. It is left to itself then."""
    if seconds <= 0:
        return translator(system, user)
    done: queue.SimpleQueue[tuple[str, Exception | None]] = queue.SimpleQueue()

    def ask() -> None:
        try:
            done.put((translator(system, user), None))
        except Exception as error:
            done.put(("", error))

    threading.Thread(target=ask, daemon=True).start()
    try:
        answer, error = done.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error
    return answer


def call(translator: Translator, system: str, user: str, attempts: int = 3, wait: Callable[[float], None] = time.sleep, timeout: float = 0.0) -> str:
    """One answer: rate limits back off exponentially, a time-out (in seconds, 0 for none) ends at once, other failures are tried again; an empty answer is the input."""
    for k in range(1, attempts + 1):
        try:
            return limited(translator, system, user, timeout) or user
        except RateLimited:
            if k == attempts:
                raise
            wait(2 ** (k - 1) + random.random() * 0.5)
        except TimeoutError:
            raise
        except Exception:
            if k == attempts:
                raise
    return user


# --- prompts --------------------------------------------------------------------------------


def prompt(template: str, s: TextSettings, lines: int | None = None) -> str:
    """A template with languages and number of lines filled in; the text itself is the user's part of a request."""
    source = "Auto-detect" if s.source == "auto" else LANGUAGES.get(s.source, s.source)
    filled = template.replace("{sourceLang}", source).replace("{targetLang}", LANGUAGES.get(s.target, s.target))
    if lines is not None:
        filled = filled.replace("{lineCount}", str(lines))
    return filled.replace("{inputText}", "")


def with_prompts(requests: DataFrame, s: TextSettings) -> DataFrame:
    """Adds to each request (of ``units.requests``) its instruction."""
    batch = F.lit(prompt(s.batch_prompt.replace("{lineCount}", "\0"), s))

    def system(r: Column) -> Column:
        return F.when(F.col("mode") == "single", F.lit(prompt(s.single_prompt, s))).otherwise(F.replace(batch, F.lit("\0"), r["expected"].cast("string")))

    return requests.withColumn("requests", F.transform("requests", lambda r: F.struct(system(r).alias("system"), r["request"].alias("request"), r["expected"].alias("expected"), r["units"].alias("units"))))


# --- answers --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Answers:
    """A folder, shared by the workers, of answers by the hash of what was asked."""

    folder: str

    def _name(self, system: str, user: str) -> str:
        key = hashlib.sha256(f"{len(system)}:{system}{user}".encode()).hexdigest()
        return f"{key[:2]}/{key}"

    def get(self, system: str, user: str) -> str | None:
        filesystem, root = pafs.FileSystem.from_uri(self.folder)
        path = f"{root}/{self._name(system, user)}"
        if filesystem.get_file_info(path).type != pafs.FileType.File:
            return None
        with filesystem.open_input_file(path) as file:
            return file.read().decode()

    def put(self, system: str, user: str, answer: str) -> None:
        write_whole(self.folder, self._name(system, user), answer.encode())


def cancel(folder: str) -> None:
    """Ask the job of a folder to stop; its pages that have not begun are reported as cancelled."""
    write_whole(folder, "cancel", b"")


def is_cancelled(folder: str) -> bool:
    filesystem, root = pafs.FileSystem.from_uri(folder)
    return filesystem.get_file_info(f"{root}/cancel").type == pafs.FileType.File


def pace(hours: float, pages: int, shortest: float = 0.2) -> float:
    """Seconds from page to page, if a job is to take so many hours; else a short pause."""
    return hours * 3600 / pages if hours > 0 and pages > 0 else shortest


@dataclass(frozen=True)
class JobSettings:
    """How pages are run: tries of a page and the first pause between them, the pause after a page, kept answers, a folder to cancel by.

    ``after`` is the pace of the whole job, whatever runs at once: its pages are dealt evenly over
    ``lanes`` tasks, each of which pauses so many times as long after a page and begins by one pause
    later than the lane before. More lanes let slow calls overlap; fewer running at once only slow the job.
    """

    tries: int = 1
    pause: float = 1.5
    after: float = 0.0
    lanes: int = 1
    answers: Answers | None = None
    control: str = ""
    wait: Callable[[float], None] = field(default=time.sleep)


def _page(mode: str, requests: list[dict], translator: Translator, s: TextSettings, job: JobSettings) -> list[str | None]:
    """Replies to a page's requests; None where one failed. A page sent in one request fails as a whole, and one without any text in its replies.

    Blank answers are not kept, so that the next try asks again.
    """

    def ask(system: str, user: str) -> str:
        known = job.answers.get(system, user) if job.answers else None
        if known is None:
            known = call(translator, system, user, s.attempts, job.wait, s.timeout)
            if job.answers and known.strip():
                job.answers.put(system, user, known)
        return known

    out: list[str | None] = []
    for r in requests:
        try:
            out.append(ask(r["system"], r["request"] or ""))
        except Exception:
            if mode == "batch":
                raise
            out.append(None)
    sent = [r for r, reply in zip(requests, out, strict=True) if reply is not None and (r["request"] or "").strip()]
    if sent and not any(reply and reply.strip() for reply in out):
        raise EmptyAnswer("the answers of the page have no text")
    return out


def answered(requests: DataFrame, translator: Translator, s: TextSettings | None = None, job: JobSettings | None = None) -> DataFrame:
    """Adds replies (null where one failed), status (completed, failed, cancelled), tries and error to pages with requests."""
    s, job = s or TextSettings(), job or JobSettings()
    ship(requests.sparkSession)

    def one(mode: str, asked: list[dict]) -> tuple[list[str | None] | None, str, int, str | None]:
        for k in range(1, job.tries + 1):
            if job.control and is_cancelled(job.control):
                return None, "cancelled", k - 1, None
            try:
                return _page(mode, asked, translator, s, job), "completed", k, None
            except Exception as error:
                if k == job.tries:
                    return None, "failed", k, str(error)
                job.wait(job.pause * 2 ** (k - 1))
        return None, "failed", 0, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        lane = context.partitionId() if context and job.after else 0
        begun = lane == 0
        for batch in batches:
            found = []
            if not begun and batch.num_rows:
                job.wait(job.after * lane)
                begun = True
            modes = batch.column(batch.schema.get_field_index("mode")).to_pylist()
            for mode, asked in zip(modes, batch.column(batch.schema.get_field_index("requests")), strict=True):
                found.append(one(mode, [{"system": r["system"].as_py(), "request": r["request"].as_py()} for r in asked]))
                if job.after:
                    job.wait(job.after * job.lanes)
            columns = zip(*found, strict=True) if found else [()] * 4
            kinds = (pa.list_(pa.string()), pa.string(), pa.int32(), pa.string())
            arrays = [*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "replies", "status", "tries", "error"])

    more = [StructField("replies", ArrayType(StringType())), StructField("status", StringType()), StructField("tries", IntegerType()), StructField("error", StringType())]
    dealt = requests.repartition(job.lanes) if job.after else requests
    return dealt.mapInArrow(run, StructType([*requests.schema.fields, *more]))


#: What region_items reads of units, beside their texts.
BOX = ("left", "top", "right", "bottom", "font_sizes", "font_family")


def page_lines(pages: DataFrame, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, ord, unit_id, paragraph_id, mode, status, original, line, final of answered pages, and what units carry.

    Lines of a numbered reply go to their units; a reply to one unit is its line as it
    is. Failed chunks keep their originals, failed single units are missing; pages that
    failed or were cancelled have no lines. A page is one row until its texts are final.
    """
    pair = F.arrays_zip(F.col("requests").alias("r"), F.coalesce("replies", F.transform("requests", lambda r: F.lit(None).cast("string"))).alias("reply"))

    def lines(p: Column) -> Column:
        own = F.transform(p["r"]["units"], lambda u: u["text"])
        numbered = F.when(p["reply"].isNull(), own).otherwise(replies.parse_numbered(p["reply"], p["r"]["expected"]))
        single = F.array(F.coalesce(p["reply"], F.lit(MISSING)))
        found = F.when(F.col("status") != "completed", F.transform(own, lambda u: F.lit(None).cast("string"))).when(F.col("mode") == "single", single).otherwise(numbered)
        return F.zip_with(p["r"]["units"], found, lambda u, line: F.struct(*[u[c].alias(c) for c in ("ord", "unit_id", "paragraph_id", *carry)], u["text"].alias("original"), line.alias("line")))

    whole = pages.select(*keys, "mode", "status", F.flatten(F.transform(pair, lines)).alias("lines"))
    return whole.select(*keys, "mode", "status", F.explode(F.arrays_zip(F.col("lines").alias("u"), replies.filled(F.col("lines")).alias("final"))).alias("x")).select(*keys, "mode", "status", "x.u.*", "x.final")


def translate_units(found: DataFrame, translator: Translator, s: TextSettings | None = None, job: JobSettings | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Units with their final texts: dispatched by mode, sent, parsed, repaired; the columns in ``carry`` go along.

    ``line`` is what came back, ``final`` what counts: originals for missing lines, for all
    of a page if over half of several are missing, and for pages that failed.
    """
    s, keys = s or TextSettings(), units.KEYS
    asked = with_prompts(units.requests(found, s.budget, s.batch, keys, s.single_limit, carry), s)
    return page_lines(answered(asked, translator, s, job), *keys, carry=carry).select(*keys, "ord", "unit_id", "paragraph_id", "mode", "status", "original", "line", "final", *carry)


def page_job(found: DataFrame, translator: Translator, first: int, last: int, s: TextSettings | None = None, job: JobSettings | None = None) -> DataFrame:
    """The units of a range of pages, translated; whole pages are tried again."""
    return translate_units(found.filter(F.col("page").between(first, last)), translator, s, job or JobSettings(tries=3, after=0.2, lanes=8))


def job_status(results: DataFrame) -> DataFrame:
    """Pages with their status; a completed page whose lines are not as many as its units, or all empty, failed its check.

    Empty answers have failed, and been tried again, before (``answered``); this check also covers rows from elsewhere.
    """
    counted = results.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.coalesce(F.col("line"), F.lit(MISSING)) == MISSING).alias("missing"), F.count("line").alias("lines"), F.sum(F.length(F.trim(F.coalesce("line", F.lit(""))))).alias("chars"), F.max("status").alias("status")
    )
    verified = F.when((F.col("status") == "completed") & ((F.col("lines") != F.col("units")) | (F.col("chars") == 0)), "failed").otherwise(F.col("status"))
    return counted.select("doc_id", "page", "units", "missing", verified.alias("status"))


def job_progress(status: DataFrame) -> DataFrame:
    """Completed, failed and cancelled pages of each document."""
    return status.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("status") == x).alias(x) for x in ("completed", "failed", "cancelled")])


def region_items(translated: DataFrame, page_width: float, page_height: float, zoom: float = 1.0) -> DataFrame:
    """Store rows of translated units that carry ``BOX``: relative boxes, sizes without the zoom, text or its original; improper boxes go."""
    boxes = translated.withColumns({"rel_left": F.col("left") / page_width, "rel_top": F.col("top") / page_height, "rel_width": (F.col("right") - F.col("left")) / page_width, "rel_height": (F.col("bottom") - F.col("top")) / page_height, "original_font_sizes": F.transform("font_sizes", lambda x: x / zoom)})
    mean = F.aggregate("original_font_sizes", F.lit(0.0), lambda a, x: a + x) / F.size("original_font_sizes")
    proper = boxes.filter(is_proper(*[F.col(f"rel_{c}") for c in ("left", "top", "width", "height")]))
    text = F.when(F.length("final") > 0, F.col("final")).otherwise(F.col("original"))
    return proper.select(*units.KEYS, "ord", F.col("original").alias("text_content"), text.alias("translated_text"), "rel_left", "rel_top", "rel_width", "rel_height", mean.alias("font_size"), "font_family", "original_font_sizes")


def plain_answer(document: Column, path: str) -> Column:
    """The text at an answer path of a JSON reply, trimmed."""
    return T.trim(T.json_path(document, path))
