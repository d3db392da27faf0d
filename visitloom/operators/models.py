"""Language models, embedders and dictionaries behind small protocols, mapped over distinct inputs.

Services are slow and may answer a retried task twice, so each distinct input is asked once,
replies are kept beside their inputs, and errors are rows, not aborts. Deterministic stand-ins need no network.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterable
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..session import ship_package
from .clients import Busy, Retry, fetch, in_order


class LLM(Protocol):
    def complete(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7) -> str: ...


class StubLLM:
    """Replies that depend on the prompt alone: a summary, a score or a prediction, as it asks."""

    def complete(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7) -> str:
        h = int(hashlib.md5(prompt.encode()).hexdigest(), 16)
        if prompt.endswith("Relevance Score (0-9):"):
            return f"Score: {h % 10}"
        if "[Output Format Example]" in prompt:
            item = lambda k: f"item {(h >> k) % 97}"
            return "```json\n" + json.dumps({"predicted_visit": {"diagnoses": [item(0)], "medications": [item(8)], "treatments": [item(16)]}}) + "\n```"
        return json.dumps({"summary": f"A history of {prompt.count('Visit ')} visits ({h % 1000})."})


class HttpLLM:
    """A chat endpoint of the common kind, asked again while it is busy or away; a lasting failure becomes an ``ERROR:`` reply."""

    def __init__(self, url: str = "http://localhost:8000/v1/chat/completions", model: str = "medgemma", timeout: float = 60.0, retry: Retry = Retry()):
        self.url, self.model, self.timeout, self.retry = url, model, timeout, retry

    def complete(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7) -> str:
        body = {"model": self.model, "max_tokens": max_tokens, "temperature": temperature,
                "messages": [{"role": "system", "content": prompts.SYSTEM}, {"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            return json.loads(self.retry.call(lambda: fetch(request, self.timeout), prompt))["choices"][0]["message"]["content"]
        except (OSError, Busy) as e:
            return f"ERROR: the model service cannot be reached ({e})"
        except Exception as e:
            return f"ERROR: no usable reply from the model service ({e})"


def complete(df: DataFrame, prompt: str, make: Callable[[], LLM] = StubLLM, max_tokens: int = 512, temperature: float = 0.7,
             tries: int = 1, valid=None, partitions: int | None = None, in_flight: int = 1) -> DataFrame:
    """``df`` with raw and cleaned reply to each prompt; each distinct prompt is asked once, up to ``tries`` times until ``valid(reply)``.

    Each task has at most ``in_flight`` questions out at once, so the service sees no more than that for every core.
    """
    ship_package(df.sparkSession)
    asked = df.select(prompt).where(F.col(prompt).isNotNull()).distinct()
    asked = asked.repartition(partitions) if partitions else asked

    def ask(batches):
        llm = make()

        def one(p):
            for _ in range(tries):
                reply = llm.complete(p, max_tokens, temperature)
                if valid is None or valid(reply):
                    break
            return reply

        for b in batches:
            yield b.assign(raw=list(in_order(one, b[prompt], in_flight)))

    replies = asked.mapInPandas(ask, f"{prompt} string, raw string")
    return df.join(replies, prompt, "left").withColumn("reply", text.clean_reply(F.col("raw")))


def relevance(pairs: DataFrame, patient: str, neighbor: str, make: Callable[[], LLM] = StubLLM, tries: int = 5, in_flight: int = 1) -> DataFrame:
    """``pairs`` with llm_relevance_score; 0.0 if no try gives a digit."""
    def has_score(reply):
        return not reply.startswith("ERROR:") and any(c.isdigit() for c in reply)

    asked = complete(pairs.withColumn("prompt", prompts.relevance(F.col(patient), F.col(neighbor))), "prompt", make, tries=tries, valid=has_score, in_flight=in_flight)
    return asked.withColumn("llm_relevance_score", F.coalesce(text.score_of(F.col("raw")), F.lit(0.0))).drop("prompt", "raw", "reply")


def predict(patients: DataFrame, history: str, neighbors: str, make: Callable[[], LLM] = StubLLM, tries: int = 1, in_flight: int = 1) -> DataFrame:
    """``patients`` with predicted_visit, and parse_error where the reply holds none; the raw reply is parsed, cleaning would eat its lists."""
    asked = patients.withColumn("prompt", prompts.prediction(F.col(history), F.col(neighbors)))
    done = complete(asked, "prompt", make, max_tokens=1024, tries=tries, valid=lambda r: "```json" in r, in_flight=in_flight)
    done = done.withColumn("predicted_visit", text.prediction_of(F.col("raw")))
    return done.withColumn("parse_error", F.when(F.col("predicted_visit").isNull(), F.concat(F.lit("no prediction in: "), F.substring("raw", 1, 200)))).drop("prompt", "reply")


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Words hashed into signed slots, scaled to length 1: like texts get like vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % self.size] += 1.0 if (h >> 32) & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


def encoded(model: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A batch that fails is halved until the texts that cannot be encoded stand alone: all others keep their vectors."""
    try:
        vecs = [[float(x) for x in v] for v in model.encode(texts)]
        if len(vecs) != len(texts):
            raise ValueError(f"{len(vecs)} vectors for {len(texts)} texts")
        return [(v, None) for v in vecs]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
    half = len(texts) // 2
    return encoded(model, texts[:half]) + encoded(model, texts[half:])


def embed(df: DataFrame, column: str, make: Callable[[], Embedder] = HashingEmbedder, batch: int = 128, errors: str | None = None) -> DataFrame:
    """``df`` with vec; each distinct text is encoded once, ``batch`` at a time, one embedder for each task.

    A text that the model cannot encode has a null vector and, in a column of the name ``errors``, the reason; it costs about ``2 log2(batch)`` more calls and no
    other text its vector. A model that fails on every text so gives error rows only. Null texts have neither.
    """
    def encode(batches):
        model = make()
        for b in batches:
            texts, done = b[column].tolist(), []
            for k in range(0, len(texts), batch):
                done += encoded(model, texts[k: k + batch])
            yield b.assign(vec=[v for v, _ in done], why=[e for _, e in done])

    ship_package(df.sparkSession)
    library = df.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(encode, f"{column} string, vec array<double>, why string")
    library = library.withColumnRenamed("why", errors) if errors else library.drop("why")
    return df.join(library, column, "left")


def lookup(df: DataFrame, column: str, make: Callable[[], Callable[[str], str]], in_flight: int = 1) -> DataFrame:
    """``df`` with raw: what a service replies to each distinct value, at most ``in_flight`` asked at once in a task; empty if it fails."""
    def ask(batches):
        service = make()

        def one(x):
            try:
                return service(x)
            except Exception:
                return ""

        for b in batches:
            yield b.assign(raw=list(in_order(one, b[column], in_flight)))

    ship_package(df.sparkSession)
    return df.join(df.select(column).distinct().mapInPandas(ask, f"{column} string, raw string"), column, "left")


class Dictionary:
    """A dictionary service: the JSON reply for a word, asked again while it is busy."""

    def __init__(self, url: str = "https://api.dictionaryapi.dev/api/v2/entries/en/", timeout: float = 10.0, retry: Retry = Retry()):
        self.url, self.timeout, self.retry = url, timeout, retry

    def __call__(self, word: str) -> str:
        return self.retry.call(lambda: fetch(self.url + quote(word), self.timeout), word).decode()


def probe(spark: SparkSession, model_ids: Iterable[str], load: Callable[[str], object]) -> DataFrame:
    """model_id, ok, error: which models can be loaded here."""
    rows = []
    for m in model_ids:
        try:
            load(m)
            rows.append((m, True, None))
        except Exception as e:
            rows.append((m, False, str(e)))
    return spark.createDataFrame(rows, "model_id string, ok boolean, error string")
