"""Grounded answers: context packing, citations, prompts, and the event stream."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import Template
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import column

MAX_CONTEXT = 16_000
# The keys of a chat message.
MESSAGE_KEYS = ("role", "content")
SYSTEM = "Answer from the numbered sources only and cite them as [C1]. Say so when they do not hold the answer."
USER = "Question: ${question}\n\nSources:\n${context}"


def context_excerpts(ranked: DataFrame, most: int = MAX_CONTEXT) -> DataFrame:
    """query_id, rank, chunk_id, excerpt: numbered excerpts, cut where the running length passes ``most``; chunks beyond are dropped."""
    value = F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Source")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = ranked.withColumn("value", value)
    before = F.coalesce(F.sum(F.length("value")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(most) - before).where("left > 0")
    return rows.select("query_id", "rank", "chunk_id", F.substr("value", F.lit(1), F.col("left").cast("int")).alias("excerpt"))


def contexts(excerpts: DataFrame) -> DataFrame:
    """One row a query: the context, and the ids that are in it."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "excerpt")))
    return excerpts.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: x["excerpt"]), "\n").alias("context"), F.transform("r", lambda x: x["chunk_id"]).alias("included"))


def cited(answer) -> Column:
    return F.array_distinct(F.regexp_extract_all(column(answer), F.lit(r"\[(C\d+)\]"), 1))


def unknown_citations(answer, n_sources) -> Column:
    """Citations of sources that were not given."""
    n = column(n_sources)
    known = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.lit("C"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_except(cited(answer), known)


def source_items(final: DataFrame, chunks: DataFrame) -> DataFrame:
    return final.join(chunks, "chunk_id").select("query_id", "rank", "chunk_id", "document_id", "url", "title", "heading_path")


@dataclass(frozen=True)
class Prompt:
    """The two templates of a grounded answer, with a reference date in the time zone of the reader."""

    system: str = SYSTEM
    user: str = USER
    timezone: str = "UTC"

    def dated(self, today: datetime.date | None) -> str:
        now = datetime.datetime.now(ZoneInfo(self.timezone))
        return f"{self.system}\nReference date: {today or now.date()}"

    def render(self, question: str, context: str, today: datetime.date | None = None) -> dict[str, str]:
        """Text by role."""
        return {"system": self.dated(today), "user": Template(self.user).substitute(question=question, context=context)}


def messages(question: str, context: str, system: str = SYSTEM, user: str = USER, timezone: str = "UTC", today: datetime.date | None = None) -> tuple[list[dict], dict]:
    """System and user message, and the digests that identify them."""
    rendered = Prompt(system, user, timezone).render(question, context, today)
    sent = [dict(zip(MESSAGE_KEYS, pair)) for pair in rendered.items()]
    return sent, {f"{role}_sha256": hashlib.sha256(text.encode()).hexdigest() for role, text in rendered.items()}


def answer_events(question: str, sources: list[dict], context: str, model: Callable[[list[dict]], Iterator[str]]) -> Iterator[dict]:
    """status, sources, token.., done; an answer that cites unknown sources or fails ends in error."""
    yield {"type": "status", "status": "retrieved"}
    yield {"type": "sources", "sources": sources}
    text = ""
    try:
        for delta in model(messages(question, context)[0]):
            text += delta
            yield {"type": "token", "text": delta}
    except Exception:
        yield {"type": "error", "message": "the answer could not be generated"}
        return
    if bad := set(re.findall(r"\[(C\d+)\]", text)) - {f"C{k}" for k in range(1, len(sources) + 1)}:
        yield {"type": "error", "message": f"unknown citations: {', '.join(sorted(bad))}"}
    else:
        yield {"type": "done", "text": text}
