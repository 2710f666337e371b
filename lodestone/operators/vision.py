"""Two phases for pictures: which go to a model, the requests, and the units made of the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AREA, ASPECT_LOW, ASPECT_HIGH = 0.05, 0.125, 8.0
DEFAULT = "png"


def mime(content: Column) -> Column:
    """Subtype by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def route(width: Column, height: Column, page_area: Column, dense: Column) -> Column:
    """text without a page area; skip if small beside the page or a strip; ocr for dense text; vision else."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    share = F.when(page_area > 0, w.cast("double") * h / page_area).otherwise(0.0)
    aspect = F.when((w > 0) & (h > 0), w / h)
    return (
        F.when(page_area.isNull(), "text")
        .when(share < AREA, "skip")
        .when((aspect > ASPECT_HIGH) | (aspect < ASPECT_LOW), "skip")
        .when(dense, "ocr")
        .otherwise("vision")
    )


def wanted(images: DataFrame) -> Column:
    """Whether a picture goes to a model: where its page's area is known, by ``route``; else always."""
    return F.col("page_area").isNull() | (route(F.col("width"), F.col("height"), F.col("page_area"), F.lit(False)) == "vision")


def requests(images: DataFrame, prompt: str) -> DataFrame:
    """(request_id, document_id, prompt, image_url, page, source_uri) for the pictures that go to a model; those without bytes are left out, those of unknown type pass for ``DEFAULT``.

    ``images``: (document_id, image_id, content, width, height, page_area, page, source_uri).
    """
    some = images.filter(wanted(images) & F.col("content").isNotNull())
    url = F.concat(F.lit("data:image/"), F.coalesce(mime(F.col("content")), F.lit(DEFAULT)), F.lit(";base64,"), plain_base64(F.col("content")))
    return some.select(F.concat_ws("::", "document_id", F.lit("img"), "image_id").alias("request_id"), "document_id", F.lit(prompt).alias("prompt"), url.alias("image_url"), "page", "source_uri")


def plain_base64(content: Column) -> Column:
    """Without the line ends that the built-in function puts in."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


RECORD = "short_caption string, detailed_description string, image_type string, objects array<string>, relationships array<string>, ocr_text string, data_values array<struct<label:string,value:string>>"


def record_text(r: str = "record") -> Column:
    """A model's answer of type ``RECORD`` as text, a line a field; blank fields are left out."""
    f = lambda k: F.col(f"{r}.{k}")
    lines = F.array(
        f("short_caption"),
        f("detailed_description"),
        F.when(F.coalesce(f("image_type"), F.lit("")) != "", F.concat(F.lit("image type: "), f("image_type"))),
        F.array_join(f("objects"), ", "),
        F.array_join(f("relationships"), "; "),
        f("ocr_text"),
        F.array_join(F.transform(f("data_values"), lambda v: F.concat(v["label"], F.lit(": "), v["value"])), "; "),
    )
    return F.trim(F.array_join(F.filter(lines, lambda x: x.isNotNull() & (F.trim(x) != "")), "\n"))


def units(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(eu_id, document_id, page, text): a unit for each answer; requests without an answer and blank answers give none. ``answers``: (request_id, record)."""
    return asked.join(answers, "request_id").select(F.col("request_id").alias("eu_id"), "document_id", "page", record_text().alias("text")).filter("text <> ''")


def fulfil(asked: DataFrame, describe: Callable[[str, str], dict]) -> DataFrame:
    """(request_id, record, error): a model's answers to (prompt, image_url), on the executors; a request that fails has an error and no record, and stops no other."""

    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for rid, prompt, url in b[["request_id", "prompt", "image_url"]].itertuples(index=False):
                try:
                    rows.append((rid, {k: describe(prompt, url).get(k) for k in FIELDS}, None))
                except Exception as e:
                    rows.append((rid, None, str(e)))
            yield pd.DataFrame(rows, columns=["request_id", "record", "error"])

    return asked.select("request_id", "prompt", "image_url").mapInPandas(f, f"request_id string, record struct<{RECORD_STRUCT}>, error string")


FIELDS = ("short_caption", "detailed_description", "image_type", "objects", "relationships", "ocr_text", "data_values")
RECORD_STRUCT = RECORD.replace(" string", ":string").replace(" array", ":array")
