"""Model answers: strict decoding, ordered checks, merging with parser traits, providers.

A provider turns evidence into raw responses. Recorded responses are the default; the HTTP
provider is opt-in, since a retried task would send a request twice.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attestry import taxonomy as X
from attestry.functions.evidence import capped, literal_array, merged_traits, parser_traits, truncated
from attestry.questions import PRIMARY_QUESTION, questions_json



def trait_question(trait: Column) -> Column:
    return F.concat(F.lit("trait_"), trait)


_ANSWER_TYPE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("choice", T.StringType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("confidence", T.DoubleType()), T.StructField("noul", T.DoubleType()),
])
_DECODED = T.StructType([T.StructField("model", T.StringType()), T.StructField("answers", T.MapType(T.StringType(), _ANSWER_TYPE)), T.StructField("valid_json", T.BooleanType())])


def _typed(text: str | None) -> tuple:
    """(model, answers, valid) of one document: no trailing data, no NaN or Infinity; known names in any letter case; a value
    of another type than its field's makes the document invalid."""

    def no(_):
        raise ValueError

    def field(doc: dict, name: str, kind):
        found = [v for k, v in doc.items() if k.lower() == name]
        v = found[-1] if found else None
        if v is not None and (not isinstance(v, kind) or isinstance(v, bool)):
            raise ValueError
        return v

    def number(v):
        if v is not None and (isinstance(v, bool) or not isinstance(v, int | float)):
            raise ValueError
        return None if v is None else float(v)

    def answer(a):
        if a is None:
            return None
        if not isinstance(a, dict):
            raise ValueError
        p = field(a, "probabilities", dict)
        return {
            "type": field(a, "type", str), "choice": field(a, "choice", str), "probabilities": None if p is None else [(k, number(v)) for k, v in p.items()],
            "confidence": number(field(a, "confidence", (int, float))), "noul": number(field(a, "noul", (int, float))),
        }

    try:
        doc = json.loads(text, parse_constant=no)
        if not isinstance(doc, dict):
            raise ValueError
        answers = field(doc, "answers", dict)
        return field(doc, "model", str), None if answers is None else [(k, answer(v)) for k, v in answers.items()], True
    except (TypeError, ValueError, OverflowError, RecursionError):
        return None, None, False


def decoded(responses: DataFrame, raw: str = "response") -> DataFrame:
    """responses with model, answers and valid_json; model and answers are null where the text is no single JSON object. Parsed once."""
    names = [c for c in responses.columns if c not in _DECODED.names]
    base = responses.select(*names, F.col(raw).alias("_raw"))
    schema = T.StructType([*base.schema.fields[:-1], *_DECODED.fields])
    parts = [to_arrow_type(f.dataType) for f in _DECODED.fields]

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [_typed(t) for t in batch.column(len(names)).to_pylist()]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], names=[*names, *_DECODED.names])

    return base.mapInArrow(over, schema)


def probability_sum(p: Column) -> Column:
    return F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x)


def primary_error(a: Column) -> Column:
    """The first fault of a primary answer; the choice need not be the most probable label."""
    p = a["probabilities"]
    keys, values = F.map_keys(p), F.map_values(p)
    bad = lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return (
        F.when(a.isNull(), "missing primary answer").when(~F.coalesce(a["type"] == "choice", F.lit(False)), "primary answer type")
        .when(~F.coalesce(a["choice"].isin(*X.PRIMARY), F.lit(False)), "unknown primary type").when(p.isNull() | (F.size(p) == 0), "no probabilities")
        .when(a["confidence"].isNull(), "no confidence").when(bad(a["confidence"]), "confidence out of range")
        .when(F.size(F.array_except(keys, literal_array(X.PRIMARY))) > 0, "unknown probability label").when(F.exists(values, bad), "probability out of range")
        .when(F.round(F.abs(probability_sum(p) - 1), 9) > X.SUM_TOLERANCE, "probability sum").when(~F.array_contains(keys, a["choice"]), "choice not in probabilities")
    )


def noul_error(a: Column) -> Column:
    v = a["noul"]
    return F.when(a.isNull(), "missing").when(~F.coalesce(a["type"] == "noul", F.lit(False)), "type").when(v.isNull(), "no value").when(F.isnan(v) | (v < 0) | (v > 1), "out of range")


def missing_answers(answers: Column, asked=X.ASKED) -> Column:
    """The asked traits without an answer."""
    return F.filter(literal_array(asked), lambda t: ~F.array_contains(F.map_keys(answers), trait_question(t)))


def response_error(asked=X.ASKED) -> Column:
    """The first fault of a decoded response, in order: JSON, model, answers, primary, traits."""
    out = F.when(~F.col("valid_json"), "invalid JSON").when(F.coalesce("model", F.lit("")) == "", "missing model")
    out = out.when(F.col("answers").isNull() | (F.size("answers") == 0), "missing answers")
    primary = primary_error(F.try_element_at("answers", F.lit(PRIMARY_QUESTION)))
    out = out.when(primary.isNotNull(), primary)
    for t in asked:
        e = noul_error(F.try_element_at("answers", F.lit(f"trait_{t}")))
        out = out.when(e.isNotNull(), F.concat(F.lit(f"trait {t} "), e))
    return out


def predictions(evidence: DataFrame, responses: DataFrame, asked=X.ASKED) -> DataFrame:
    """evidence (with seq, features) joined to responses (seq, response): prediction columns and response_error."""
    d = decoded(responses).withColumn("response_error", F.explode(F.array(response_error(asked))))
    p = F.try_element_at("answers", F.lit(PRIMARY_QUESTION))
    nouls = F.map_from_arrays(literal_array(asked), F.array(*[F.try_element_at("answers", F.lit(f"trait_{t}"))["noul"] for t in asked]))
    ok = F.col("response_error").isNull()
    d = d.select(
        "seq", "response_error", F.when(ok, p["choice"]).alias("primary"), F.when(ok, p["probabilities"]).alias("probabilities"),
        F.when(ok, p["confidence"]).alias("confidence"), F.when(ok, nouls).alias("_nouls"), F.when(ok, F.col("model")).alias("model"),
    )
    out = evidence.join(d, "seq", "left").withColumn("response_error", F.when(F.col("primary").isNull() & F.col("response_error").isNull(), "no response").otherwise(F.col("response_error")))
    names = F.transform(F.coalesce("features", F.expr("cast(array() as array<struct<name: string, source: string>>)")), lambda f: f["name"])
    return out.withColumn("traits", F.when(F.col("_nouls").isNotNull(), merged_traits(parser_traits(names), F.col("_nouls")))).drop("_nouls")


def pinned(model: str) -> bool:
    """Whether a model's name says which version it is."""
    return model.strip() != "" and model != "latest" and not model.endswith("-latest")


def requests(evidence: DataFrame, model: str, asked=X.ASKED, experimental: bool = False) -> DataFrame:
    """(seq, request JSON, too_long): model, state and questions as a provider sends them; a request beyond the bound is not sent.

    A floating model name is refused unless experimental is set.
    """
    if not model.strip() or not (experimental or pinned(model)):
        raise ValueError("the model must be pinned")
    none = literal_array(())
    state = F.struct(
        F.coalesce("language", F.lit("")).alias("language"), F.coalesce(F.nullif("name", F.lit("")), "qualified").alias("test_name"), capped(F.coalesce("annotations", none)).alias("annotations"),
        capped(F.coalesce("imports", none)).alias("imports"), capped(F.coalesce(F.transform("features", lambda f: f["name"]), none)).alias("features"), truncated(F.coalesce("source", F.lit(""))).alias("source"),
    )
    head = F.to_json(F.struct(F.lit(model).alias("model"), state.alias("state")))
    # the questions are the same for every test: their text is put before the object's last brace
    request = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(f',"questions":{questions_json(tuple(asked))}}}'))
    return evidence.select("seq", request.alias("request")).withColumn("too_long", F.octet_length("request") > X.REQUEST_BYTES)


def error_text(body: bytes) -> str:
    """A short text of an error's body: its "error" or "message" (text, or an object's "message"), else its first 200 bytes."""
    plain = body.decode("utf-8", "replace").strip()
    try:
        doc = json.loads(body)
    except ValueError:
        doc = None
    for key in ("error", "message") if isinstance(doc, dict) else ():
        value = doc.get(key)
        value = value.get("message") if isinstance(value, dict) else value
        if isinstance(value, str) and value:
            return value
    return plain.encode()[:200].decode("utf-8", "ignore")


def backoff(attempt: int, base: float = 0.5, most: float = 8.0, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before retry ``attempt`` (from 0): doubling, capped, then between half and all of it."""
    d = min(base * 2**attempt, most)
    return d / 2 + jitter() * d / 2


class Provider(Protocol):
    def responses(self, evidence: DataFrame) -> DataFrame:
        """(seq, response, error) for evidence."""


@dataclass(frozen=True)
class RecordedProvider:
    recorded: DataFrame

    def responses(self, evidence: DataFrame) -> DataFrame:
        return evidence.select("seq").join(self.recorded.select("seq", "response"), "seq", "left").withColumn("error", F.when(F.col("response").isNull(), "no recorded response"))


@dataclass(frozen=True)
class HttpProvider:
    """Posts each request; 429 and 529 are retried, other faults are returned as errors. The result is
    materialised by the caller and must run once: keep speculation and task retries off."""

    url: str
    key: str
    model: str
    concurrency: int = 4
    retries: int = 3
    timeout: float = 60.0
    most: int = 1 << 20
    experimental: bool = False

    def _post(self, body: bytes) -> tuple[str | None, str | None]:
        for attempt in range(self.retries + 1):
            call = urllib.request.Request(self.url.rstrip("/") + "/v1/systemone", body, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(call, timeout=self.timeout) as r:
                    data = r.read(self.most + 1)
                return (data.decode("utf-8", "replace"), None) if len(data) <= self.most else (None, "response too long")
            except urllib.error.HTTPError as e:
                if e.code not in (429, 529) or attempt == self.retries:
                    text = error_text(e.read(self.most + 1))
                    return None, "authentication failed" if e.code == 401 else f"status {e.code}: {text}".replace(self.key, "[redacted]")
                time.sleep(backoff(attempt))
            except (TimeoutError, OSError) as e:
                return None, f"{type(e).__name__}: {e}".replace(self.key, "[redacted]")
        return None, "retries exhausted"

    def responses(self, evidence: DataFrame) -> DataFrame:
        def send(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = [(None, "request too long") if long else self._post(body.encode()) for body, long in zip(pdf.request, pdf.too_long, strict=True)]
                yield pd.DataFrame({"seq": pdf.seq, "response": [r for r, _ in out], "error": [e for _, e in out]})

        # one request at a time in each of at most ``concurrency`` tasks
        return requests(evidence, self.model, experimental=self.experimental).repartition(max(1, self.concurrency)).mapInPandas(send, "seq bigint, response string, error string")
