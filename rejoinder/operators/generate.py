"""Batch inference inputs and outputs: chat prompt assembly and a batched generation hook."""

from __future__ import annotations

import sys

from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUTS = ("system_user_period", "system_user", "user_with_prefix")

# Functions of this module run inside Python workers (Arrow batches).  Pickle
# them by value so executors need only numpy/pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _msg(role: str, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompts(df: DataFrame, *, system_prompt: str, layout: str, text_col: str = "message",
                  user_template: str = "%s", assistant_prefix: str = "") -> DataFrame:
    """Add ``prompt ARRAY<STRUCT<role, content>>`` in one of three layouts:

    * ``system_user_period`` — system message, user message ending with a period
    * ``system_user``        — system message, user message as is
    * ``user_with_prefix``   — one user message (system text, a space, user text) and an assistant prefix
    """
    user = F.format_string(user_template, F.col(text_col))
    if layout == "system_user_period":
        p = F.array(_msg("system", F.lit(system_prompt)), _msg("user", F.concat(user, F.lit("."))))
    elif layout == "system_user":
        p = F.array(_msg("system", F.lit(system_prompt)), _msg("user", user))
    elif layout == "user_with_prefix":
        p = F.array(_msg("user", F.concat(F.lit(system_prompt + " "), user)),
                    _msg("assistant", F.lit(assistant_prefix)))
    else:
        raise ValueError(f"unknown layout {layout!r}; choose one of {LAYOUTS}")
    return df.withColumn("prompt", p)


def echo_generator(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in generator for tests: echoes the first words of the last user turn."""
    def one(p):
        users = [m["content"] for m in p if m["role"] == "user"]
        words = (users[-1] if users else "").split()
        return " ".join(words[:8]) + " <XXX>" + " ".join(words[-3:]) + "<XXX> strategies: 1"
    return prompts.map(one)


def batch_generate(df: DataFrame, generate: Callable[[pd.Series], pd.Series] = echo_generator, *,
                   prompt_col: str = "prompt", out_col: str = "model_output", strip: bool = True) -> DataFrame:
    """Run ``generate`` over Arrow batches of prompts (one call per batch, not per row).

    The generator (a remote client or a local model) is created once per
    Python worker by the callable itself; Spark spreads batches over executors.
    """
    def run(prompts):
        out = generate(prompts)
        return out.str.strip() if strip else out

    run.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return df.withColumn(out_col, F.pandas_udf(run, "string")(F.col(prompt_col)))
