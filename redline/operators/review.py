"""Review of modified pairs by an injected model: its level and reason, or the rule's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from redline.functions.text import marked_text
from redline.sources.replies import retried, tolerant_json

PAIR = "pair_id"
LEVELS = ("none", "low", "medium", "high")
NOT_SET, INVALID, FAILED = "review not set up, the rule stands", "review gave no valid level, the rule stands", "review failed, the rule stands"


def request_text(word: str, pdf: str, marked: str, level: str) -> str:
    """What the reviewer is asked."""
    return f"trusted text:\n{word}\n\nreturned text:\n{pdf}\n\ndifference ([-gone-], [+new+]):\n{marked}\n\nlevel by rule: {level}\n\nanswer as JSON with risk_level and reason"


def review(diffs: DataFrame, reviewer: Callable[[str], str] | None, retries: int = 3) -> DataFrame:
    """``diffs`` (with segments) after the review of the modified ones: risk_level, risk_reasons and judged_by.

    Only modified rows reach ``reviewer``, one call each, tried again when the
    connection fails. A reply without a valid level, a call that fails for good
    and no reviewer at all leave the level of the rule, and say so.
    """
    modified, others = diffs.where("status = 'modified'"), diffs.where("status <> 'modified'").withColumn("judged_by", F.lit("rule"))
    if reviewer is None:
        asked = modified.withColumn("risk_reasons", F.array(F.lit(NOT_SET))).withColumn("judged_by", F.lit("llm"))
        return others.unionByName(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = retried(reviewer, retries)

        def reply(text: str) -> str | None:
            try:
                return ask(text)
            except (ConnectionError, TimeoutError):
                return None

        for batch in batches:
            texts = map(request_text, batch["w_text"], batch["p_text"], batch["marked"], batch["risk_level"])
            yield pd.DataFrame({PAIR: batch[PAIR], "align_idx": batch["align_idx"], "reply": [reply(t) for t in texts]})

    sent = modified.select(PAIR, "align_idx", "w_text", "p_text", marked_text(F.col("segments")).alias("marked"), "risk_level")
    replies = sent.mapInPandas(run, f"{PAIR} long, align_idx int, reply string").withColumn("v", tolerant_json(F.col("reply")))
    part = lambda name: F.trim(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))
    replies = replies.select(PAIR, "align_idx", F.col("reply").isNotNull().alias("__got"), F.lower(part("risk_level")).alias("__level"), part("reason").alias("__reason"))
    joined = modified.join(replies, [PAIR, "align_idx"], "left")
    valid = F.col("__got") & F.col("__level").isin(*LEVELS)
    reason = F.when(~F.col("__got"), FAILED).when(~valid, INVALID).when(F.col("__reason") == "", "reviewed").otherwise(F.concat(F.lit("review: "), "__reason"))
    judged = joined.withColumn("risk_level", F.when(valid, F.col("__level")).otherwise(F.col("risk_level"))).withColumn("risk_reasons", F.array(reason))
    return others.unionByName(judged.withColumn("judged_by", F.lit("llm")).drop("__got", "__level", "__reason"))
