"""Model calls as a column operator: any text-to-text function, with status, repair and a deterministic stub.

The function runs in tasks on Arrow batches, with a few threads for calls that wait on a network. A call that fails
marks its row and stops nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text

Model = Callable[[str], str]


def stub(prompt: str) -> str:
    """The same JSON for the same prompt: a score, grade and confidence from its digest."""
    n = int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16)
    return json.dumps({"score": n % 101, "confidence": round(n % 97 / 96, 2), "summary": prompt[:60], "is_relevant": n % 4 != 0})


def complete(df: DataFrame, prompt: str, model: Model = stub, *, threads: int = 8, repair: Callable[[str], str] | None = None) -> DataFrame:
    """df with reply (JSON text or null) and status: ok, repaired, invalid or failed: and the error's name."""

    @F.pandas_udf("struct<reply:string,status:string>")
    def call(prompts: pd.Series) -> pd.DataFrame:
        def one(p):
            try:
                raw = model(p or "")
                if found := _object(raw):
                    return found, "ok"
                if repair and (found := _object(model(repair(raw)))):
                    return found, "repaired"
                return None, "invalid"
            except Exception as e:  # noqa: BLE001 - the row says so
                return None, f"failed:{type(e).__name__}"

        with ThreadPoolExecutor(threads) as pool:
            return pd.DataFrame(list(pool.map(one, prompts)), columns=["reply", "status"])

    return df.withColumn("_m", call(prompt)).withColumns({"reply": F.col("_m.reply"), "status": F.col("_m.status")}).drop("_m")


def _object(raw: str) -> str | None:
    a, b = raw.find("{"), raw.rfind("}")
    try:
        value = json.loads(raw[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return json.dumps(value, sort_keys=True, ensure_ascii=False) if isinstance(value, dict) else None


def compressed(df: DataFrame, *, content: str, model: Model = stub) -> DataFrame:
    """Candidates summarised: rows found irrelevant go, rows that failed stay as they are and are flagged, other routes pass."""
    todo = df.where("route = 'candidate'").withColumn("_prompt", F.substring(text.sanitize(F.coalesce(content, F.lit(""))), 1, 6_000))
    done = complete(todo, "_prompt", model).drop("_prompt")
    summary = F.get_json_object("reply", "$.summary")
    kept = done.where(F.coalesce(F.get_json_object("reply", "$.is_relevant"), F.lit("true")) != "false").withColumn("summary", F.coalesce(summary, F.substring(content, 1, 600)))
    passed = df.where("route != 'candidate'").withColumns({"reply": F.lit(None).cast("string"), "status": F.col("route"), "summary": F.substring(content, 1, 600)})
    return kept.unionByName(passed)


def embed(df: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]] | None = None, dims: int = 64) -> DataFrame:
    """df with embedding: by a model on batches of texts, or by feature hashing of the text's tokens."""
    from ..functions import vectors

    if model is None:
        return df.withColumn("embedding", vectors.hashed(text.tokens(F.lower(F.coalesce(column, F.lit("")))), dims))

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model([t or "" for t in texts]))

    return df.withColumn("embedding", run(column))
