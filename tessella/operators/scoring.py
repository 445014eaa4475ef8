"""The boundary to an external model: requests out, answers back, and the books kept on them.

The model itself is a Scorer, given by the caller; StubScorer is for tests and says nothing about quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import frontmatter as fmt
from tessella.functions import text
from tessella.operators.numbering import batched, numbered

CLASSIFY_BATCH, ROUTE_BATCH = 50, 40
CONTEXT_CHARS = 8000

ANSWERS = {
    "classify": "id string, category string, domain string, value string, reason string",
    "route": "id string, destination string, reason string",
}


class Scorer(Protocol):
    def __call__(self, request: str) -> str:
        """Answer to one request; an exception fails that request alone."""


def in_batches(df: DataFrame, path: str, size: int) -> DataFrame:
    """Adds batch and item_id in order of path."""
    return batched(numbered(df, text.path_key(F.col(path)), "_number"), "_number", size).drop("_number")


def classify_line(item_id: Column, path: Column, fm: Column, body: Column) -> Column:
    """concat_ws leaves out the segments that are null."""
    title = F.coalesce(text.present(fmt.value(fm, "title")), text.title_from_filename(path))
    url, preview = text.present(fmt.value(fm, "url")), text.present(text.note_preview(body, F.size(fm) > 0))
    return F.concat_ws(
        " | ", F.concat(F.lit("ID: "), item_id), F.concat(F.lit("TITLE: "), F.substring(title, 1, 150)), F.concat(F.lit("URL: "), url), F.concat(F.lit("PREVIEW: "), preview)
    )


def route_line(item_id: Column, path: Column, fm: Column, body: Column) -> Column:
    title = F.coalesce(text.present(fmt.value(fm, "title")), text.stem(path))
    segments = [F.concat(F.lit("ID: "), item_id), F.concat(F.lit("FOLDER: "), F.coalesce(text.folder_hint(path), F.lit(""))), F.concat(F.lit("TITLE: "), F.substring(title, 1, 120))]
    for label, key in (("URL", "url"), ("CAT", "category"), ("DOMAIN", "domain")):
        segments.append(F.concat(F.lit(f"{label}: "), text.present(fmt.value(fm, key))))
    return F.concat_ws(" | ", *segments, F.concat(F.lit("PREVIEW: "), text.present(text.body_preview(body))))


def reader_context(context: Column) -> Column:
    return text.strip(F.substring(context, 1, CONTEXT_CHARS))


def requests(lines: DataFrame, head: Column | str) -> DataFrame:
    """batch, request: the head and the batch's lines in order; a batch is at most a few dozen lines."""
    head = F.lit(head) if isinstance(head, str) else head
    ordered = F.array_sort(F.collect_list(F.struct("item_id", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy("batch").agg(joined.alias("_lines"), F.count("*").alias("size")).select("batch", "size", F.concat(head, F.col("_lines")).alias("request"))


def answered(asked: DataFrame, scorer: Callable[[], Scorer]) -> DataFrame:
    """batch, size, answer, error. scorer() makes a client, once for each task; a request that fails has a null answer, and the rest go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = scorer()
        for pdf in batches:
            answers, errors = [], []
            for request in pdf["request"]:
                try:
                    answers.append(client(request))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001  one request's failure is a row
                    answers.append(None)
                    errors.append(str(problem))
            yield pdf[["batch", "size"]].assign(answer=answers, error=errors)

    return asked.select("batch", "size", "request").mapInPandas(run, "batch long, size long, answer string, error string")


def answers(df: DataFrame, schema: str, answer: str = "answer", batch: str = "batch") -> DataFrame:
    """One row for each line that is a JSON object; other lines are passed over. Adds the line's number."""
    lines = df.select(F.col(batch), F.posexplode(F.split(F.col(answer), "\n")).alias("line_no", "line")).withColumn("line", text.strip(F.col("line")))
    objects = lines.filter(F.col("line").startswith("{") & F.expr("try_parse_json(line) is not null"))
    return objects.withColumn("a", F.from_json("line", schema)).select(batch, "line_no", "a.*")


def last_answers(found: DataFrame) -> DataFrame:
    """The last answer to each id of a batch."""
    fields = [c for c in found.columns if c not in ("batch", "id")]
    best = found.filter("id is not null").groupBy("batch", "id").agg(F.max(F.struct("line_no", *[c for c in fields if c != "line_no"])).alias("a"))
    return best.select("batch", "id", "a.*").drop("line_no")


def joined_back(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with their answers; answers to ids that no item has are dropped."""
    return items.join(last_answers(found).withColumnRenamed("id", "item_id"), ["batch", "item_id"])


def accounts(items: DataFrame, found: DataFrame) -> DataFrame:
    """batch, size, applied, missing; distinct ids count."""
    marked = items.select("batch", "item_id").join(found.select("batch", F.col("id").alias("item_id")).distinct().withColumn("_hit", F.lit(1)), ["batch", "item_id"], "left")
    return marked.groupBy("batch").agg(F.count("*").alias("size"), F.count("_hit").alias("applied")).withColumn("missing", F.col("size") - F.col("applied"))


def classified(pairs: Column, path: Column, category: Column, domain: Column, value: Column, reason: Column) -> Column:
    """Ordered frontmatter with a classification; a raw note gets a type, a source and a title first."""
    new = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("type", F.lit("dump-item")), ("source", F.lit("apple-notes")), ("title", text.title_from_filename(path)))])
    base = F.when(F.size(pairs) == 0, new).otherwise(pairs)
    return fmt.updated(
        base, category=F.coalesce(category, F.lit("other")), domain=F.coalesce(domain, F.lit("")), value=F.coalesce(value, F.lit("1")),
        reason=F.coalesce(reason, F.lit("")), status=F.lit("classified"),
    )


def routed(pairs: Column, destination: Column, reason: Column) -> Column:
    return fmt.updated(pairs, destination=F.coalesce(destination, F.lit("skip")), destination_reason=F.coalesce(reason, F.lit("")))


class StubScorer:
    """Deterministic stand-in: answers every ID line of a request with fixed fields."""

    def __init__(self, **fields: str):
        self.fields = fields

    def __call__(self, request: str) -> str:
        import json
        import re

        return "\n".join(json.dumps({"id": x} | self.fields) for x in re.findall(r"(?m)^ID: (\S+)", request))
