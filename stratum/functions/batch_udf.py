"""UDF surface (U1-U3): user models run once per task over Arrow batches; the corpus format
function is the native T1-T9 chain.

Python runs here only where a user model must: the model object is built once per task (not
per row), fed fixed-size batches, and may ask for GPUs through a stage-level ResourceProfile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_batches(make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], return_type,
                  batch_size: int = 128) -> Callable[..., Column]:
    """A column function backed by ``predict_batch_udf``: ``make_predict_fn`` loads the model
    once per Python worker and its ``predict(batch)`` is called on batches of ``batch_size``."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size)


def map_batches(df: DataFrame, make_fn: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str,
                batch_size: int = 128, profile=None) -> DataFrame:
    """U1 (frame form): ``make_fn()`` once per task, then ``fn(pdf)`` per slice of ``batch_size``
    rows; ``profile`` (a ``ResourceProfile``) requests e.g. half a GPU per task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                yield fn(pdf.iloc[s:s + batch_size])

    if profile is not None:
        return df.mapInPandas(run, schema, profile=profile)
    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, cls: type, schema: str) -> DataFrame:
    """A per-row callable class with one-time initialisation (``cls()`` once per task,
    ``obj(row_dict) -> dict`` per row). Prefer native expressions where they exist."""
    cols = [f.split()[0] for f in schema.split(",")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        obj = cls()
        for pdf in it:
            out = [obj(r) for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=cols)

    return df.mapInPandas(run, schema)


def make_tokenise_fn(vocab: DataFrame, use_chat_template: bool = True):
    """The corpus format function ``text, codes -> input_ids, labels, length`` bound to a
    vocabulary, as a DataFrame -> DataFrame function (partitions replace worker processes)."""
    from stratum.functions import text as tx
    from stratum.operators import tokens as tk

    audio = tk.audio_id_array(vocab)
    boa = audio[0]

    def fn(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", codes_col: str = "codes") -> DataFrame:
        st = tx.strip_text(F.col(text_col))
        if use_chat_template:
            chat = tx.render_chat(st, tx.render_codes(F.col(codes_col)))
            rows = tk.tokens_to_ids(df.select(key_col, tk.tokenize(chat).alias("_toks")), "_toks", vocab, out="input_ids")
            rows = rows.withColumn("labels", tk.sft_labels("input_ids", boa))
        else:
            rows = tk.tokens_to_ids(df.select(key_col, F.col(codes_col).alias("_codes"), tk.tokenize(st).alias("_toks")), "_toks", vocab, out="_text_ids")
            rows = rows.select(key_col, F.concat("_text_ids", tk.code_ids("_codes", audio)).alias("input_ids"))
            rows = rows.withColumn("labels", tk.pretrain_labels("input_ids", boa))
        return rows.select(key_col, "input_ids", "labels", F.size("input_ids").alias("length"))

    return fn


# ---------------------------------------------------------------- deterministic stand-ins
def make_stub_recogniser():
    """A deterministic stand-in for a speech recogniser (tests, oracle checks): the 'transcript'
    of a text is the text without the letter e. Real use plugs a model in here."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([None if t is None else t.replace("e", "") for t in texts], dtype=object)

    return predict


class ByteCounter:
    """A per-row stand-in for a decoder with one-time set-up: UTF-8 size of the text."""

    def __init__(self):
        self.encoding = "utf-8"

    def __call__(self, row: dict) -> dict:
        return {"doc_id": row["doc_id"], "n_bytes": len(row["text"].encode(self.encoding))}
