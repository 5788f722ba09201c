"""A scorer that asks a remote model, in batches, from the executors."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C

#: Price per million tokens where the response states no cost, and the time limit in seconds.
TOKEN_PRICE, TIMEOUT = 0.042, 8.0


@dataclass
class Judge:
    """Posts ``{"query", "items"}`` to ``url``; the answer's ``scores`` maps ids to probabilities.

    Batches are asked in parallel.  One that fails makes the query fail, so that the caller keeps the
    keyword order instead of mixing judged and unjudged hits.  A row of each batch carries its cost in
    dollars: ``cost`` of the answer's ``usage``, or its ``total_tokens`` (else a quarter of the bytes
    sent) at TOKEN_PRICE.  ``post`` can be replaced, as in tests.
    """

    url: str
    key: str = ""
    model: str = ""
    timeout: float = TIMEOUT
    post: Callable[[str, bytes, dict, float], bytes] | None = None

    @classmethod
    def from_environment(cls) -> Judge | None:
        """The judge that JUDGE_URL, JUDGE_KEY, JUDGE_MODEL and JUDGE_TIMEOUT_MS describe, unless RERANK is off."""
        if os.environ.get("RERANK", "").lower() in ("off", "0", "false") or not os.environ.get("JUDGE_URL"):
            return None
        seconds = float(os.environ.get("JUDGE_TIMEOUT_MS", TIMEOUT * 1000)) / 1000
        return cls(os.environ["JUDGE_URL"], os.environ.get("JUDGE_KEY", ""), os.environ.get("JUDGE_MODEL", ""), seconds)

    def ask(self, query: str, items: list[dict]) -> tuple[dict[str, float], float]:
        """Scores by id, and what they cost."""
        body = json.dumps({"query": query, "items": items, "model": self.model}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        answer = json.loads((self.post or _post)(self.url, body, headers, self.timeout))
        usage = answer.get("usage") or {}
        cost = usage.get("cost", usage.get("total_tokens", len(body) / 4) * TOKEN_PRICE / 1e6)
        return {str(k): float(v) for k, v in answer["scores"].items()}, float(cost)

    def __call__(self, hits: DataFrame) -> DataFrame:
        def judged(lot: pd.DataFrame) -> pd.DataFrame:
            scores, cost = self.ask(lot["query_text"].iloc[0], lot[["id", "header", "text"]].to_dict("records"))
            out = [(lot["query"].iloc[0], i, p, 0.0 if k else cost) for k, (i, p) in enumerate(scores.items())]
            return pd.DataFrame(out, columns=["query", "id", "p", "cost"])

        kind = hits.schema["query"].dataType.simpleString()
        place = F.row_number().over(Window.partitionBy("query").orderBy("id")) - 1  # of the few hits that are judged
        lots = hits.select("query", "query_text", "id", "header", "text", F.floor(place / C.JUDGE_BATCH).alias("lot"))
        return lots.groupBy("query", "lot").applyInPandas(judged, f"query {kind}, id string, p double, cost double")


def _post(url: str, body: bytes, headers: dict, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
        return answer.read()
