"""Annotation tables for pages and paragraphs, shaded Word files, webhook payloads."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from redline.functions.kernels import signer
from redline.operators.locate import RISK_LABELS

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def annotation_rects(regions: DataFrame) -> DataFrame:
    """Rectangles in page points and their labels.

    ``regions``: page_index, region (shares of the page), page_w, page_h,
    number, alignment_id, risk_level. The label stands right of the top corner.
    """
    at = lambda i, size: F.get("region", F.lit(i)) * F.col(size)
    name = F.when(F.coalesce("number", F.lit("")) != "", F.col("number")).otherwise(F.right("alignment_id", F.lit(6)))
    level = F.create_map(*[F.lit(x) for p in RISK_LABELS.items() for x in p])
    label = F.concat(name, F.lit(" ["), F.coalesce(F.try_element_at(level, F.col("risk_level")), F.lit("-")), F.lit("]"))
    rest = [c for c in regions.columns if c != "region"]
    return regions.select(*rest, at(0, "page_w").alias("x1"), at(1, "page_h").alias("y1"), at(2, "page_w").alias("x2"), at(3, "page_h").alias("y2"), label.alias("label")).withColumn(
        "label_x", F.col("x2") + 2
    ).withColumn("label_y", F.col("y1") - 10)


def page_footers(rects: DataFrame, keys: list[str]) -> DataFrame:
    return rects.groupBy(*keys, "page_index").agg(F.count("*").alias("n_regions"))


def shade_paragraphs(content: bytes, shades: dict[int, str]) -> bytes:
    """A .docx with the n-th body paragraphs shaded; a shade that is there is replaced, the rest of the archive kept."""
    ElementTree.register_namespace("w", _W)
    source = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(source.read("word/document.xml"))
    body = root.find(f"{{{_W}}}body")
    direct = body.findall(f"{{{_W}}}p")
    inner = [p for t in body.findall(f"{{{_W}}}tbl") for p in t.iter(f"{{{_W}}}p")]
    for n, p in enumerate([*direct, *inner]):
        if n in shades:
            props = p.find(f"{{{_W}}}pPr")
            if props is None:
                props = ElementTree.Element(f"{{{_W}}}pPr")
                p.insert(0, props)
            for old in props.findall(f"{{{_W}}}shd"):
                props.remove(old)
            ElementTree.SubElement(props, f"{{{_W}}}shd", {f"{{{_W}}}val": "clear", f"{{{_W}}}color": "auto", f"{{{_W}}}fill": shades[n]})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in source.infolist():
            target.writestr(info, ElementTree.tostring(root) if info.filename == "word/document.xml" else source.read(info.filename))
    return out.getvalue()


def webhook_body(task_id: Column, status: Column, payload: Column) -> Column:
    """JSON of the event; its id is a hash of what it says, so a repeated delivery has the same one."""
    event = F.sha2(F.concat_ws("|", task_id.cast("string"), status, F.to_json(payload)), 256)
    return F.to_json(F.struct(event.alias("event_id"), task_id.alias("task_id"), status.alias("status"), payload.alias("payload")))


def signed_webhooks(events: DataFrame, secret: str) -> DataFrame:
    """``events`` (with body) and the X-Signature of each body."""
    return events.withColumn("signature", signer(secret)("body"))


def send_event(body: str, signature: str, event_id: str, send: Callable[[str, dict[str, str]], int], waits: tuple[float, ...] = (1, 4, 16), sleep: Callable[[float], None] = time.sleep) -> int:
    """Attempts made until ``send`` (body and headers -> HTTP status) answered below 300, or 0 if none of them did."""
    headers = {"Content-Type": "application/json", "X-Signature": signature, "X-Event-Id": event_id}
    for attempt, wait in enumerate((*waits, None), 1):
        try:
            if send(body, headers) < 300:
                return attempt
        except (ConnectionError, TimeoutError):
            pass
        if wait is not None:
            sleep(wait)
    return 0


def deliver(signed: DataFrame, send: Callable[[str, dict[str, str]], int], waits: tuple[float, ...] = (1, 4, 16)) -> DataFrame:
    """event_id, attempts and delivered of signed webhooks (body, signature): each is sent from where it lies, and again after each wait.

    A task that is run again sends again: the receiver knows an event by X-Event-Id.
    """
    rows = signed.select(F.get_json_object("body", "$.event_id").alias("event_id"), "body", "signature")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [send_event(b, s, e, send, waits) for e, b, s in zip(batch["event_id"], batch["body"], batch["signature"], strict=True)]
            yield pd.DataFrame({"event_id": batch["event_id"], "attempts": [n or len(waits) + 1 for n in made], "delivered": [n > 0 for n in made]})

    return rows.mapInPandas(run, "event_id string, attempts int, delivered boolean")
