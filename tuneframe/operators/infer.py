"""Batch inference through a pluggable model function (V2).

The model is built once per task by ``make_model`` (the reference reloads it
for every request) and applied to whole Arrow batches with ``mapInPandas``.
Answers are stripped and empty ones replaced by a notice (C20).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe import constants as K
from tuneframe.functions.render import clean_response
from tuneframe.operators.batches import token_budget

Generator = Callable[[list[str], int], list[str]]


def batch_infer(df: DataFrame, make_model: Callable[[], Generator], prompt: str = "prompt",
                keep: tuple[str, ...] = (), max_new_tokens: int = K.MAX_NEW_TOKENS,
                out: str = "response", mode: str = "map", batch_size: int = 64,
                max_prompt_tokens: int | None = K.INFER_MAX_TOKENS) -> DataFrame:
    """``make_model()`` returns ``generate(prompts, max_new_tokens) -> answers``
    (new text only, prompt tokens already dropped).

    Prompts are cut to their first ``max_prompt_tokens`` tokens (runs of
    non-whitespace); give ``None`` if the model cuts by its own tokenizer.

    ``mode="map"``: ``mapInPandas``, the model is built once per task and fed
    at most ``batch_size`` prompts at a time.
    ``mode="predict"``: ``pyspark.ml.functions.predict_batch_udf``, the model
    is cached per Python worker and fed ``batch_size`` prompts at a time (the
    usual choice for GPU executors)."""
    if max_prompt_tokens is not None:
        df = token_budget(df.select(*keep, prompt), prompt, max_prompt_tokens) \
            .select(*keep, F.col("kept_text").alias(prompt))
    if mode == "predict":
        return _predict_udf(df, make_model, prompt, keep, max_new_tokens, out, batch_size)
    cols = list(keep) + [prompt]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("_raw", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        generate = make_model()
        for pdf in batches:
            texts = [p if p is not None else "" for p in pdf[prompt].tolist()]
            answers = [a for i in range(0, len(texts), batch_size)
                       for a in generate(texts[i:i + batch_size], max_new_tokens)]
            res = pdf[list(keep)].copy()
            res["_raw"] = answers
            yield res

    return df.select(*cols).mapInPandas(run, schema).withColumn(out, clean_response(F.col("_raw"))).drop("_raw")


def _predict_udf(df, make_model, prompt, keep, max_new_tokens, out, batch_size) -> DataFrame:
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf

    def make_predict():
        generate = make_model()

        def predict(prompts: np.ndarray) -> np.ndarray:
            return np.array(generate([p if p is not None else "" for p in prompts.tolist()], max_new_tokens),
                            dtype=object)
        return predict

    infer = predict_batch_udf(make_predict, return_type=T.StringType(), batch_size=batch_size)
    return df.select(*keep, clean_response(infer(F.col(prompt))).alias(out))


def echo_model() -> Generator:
    """Deterministic stand-in used by tests: answers with the words of the
    prompt's input section, last first, up to the token budget."""
    def generate(prompts: list[str], max_new_tokens: int) -> list[str]:
        out = []
        for p in prompts:
            section = p.split("### Input\n", 1)[-1].split("\n\n### ", 1)[0]
            words = section.split()[::-1][:max_new_tokens]
            out.append(" ".join(words))
        return out
    return generate
