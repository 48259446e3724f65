"""Extraction of records behind one interface: a model is a function from a prompt to an answer.

The work list is papers by models. It is narrow: each row becomes a prompt, an
answer, a repaired record, without a shuffle; the answers of judges and baselines
are DataFrame operators on what the others stored.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import repair
from tessera.operators import ensembles, metrics, normalise

#: ``client(model, prompt) -> (answer, input tokens, output tokens, cost)``.
Client = Callable[[str, str], tuple[str, int, int, float]]
RETRIES = 3


def _read(answer: str) -> dict:
    """One answer, read as :func:`tessera.functions.repair.read_json` does, so that a worker knows whether to ask again."""
    bare = answer.replace("```json", "").replace("```", "").replace("\\", "")
    if bare.startswith('"') and bare.endswith('"'):
        bare = bare[1:-1]
    parts = bare.split('"')
    record = json.loads('"'.join(p if i % 2 else p.replace("'", '"') for i, p in enumerate(parts)))
    if not isinstance(record, dict):
        raise ValueError("Expecting an object")
    return record


def ask(work: DataFrame, client: Client, key: list[str], model: str = "model", prompt: str = "prompt", retries: int = RETRIES, pause: float = 0.0) -> DataFrame:
    """``(key, model, raw, input_tokens, output_tokens, cost, error)``: the record of each prompt as a map of JSON texts.

    An answer that is no JSON, and a client that fails, are tried again; after ``retries`` the record is empty and the
    last error stands. Tokens and costs of all tries are added up.
    """
    out = _ddl(work, [*key, model])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch[[*key, model, prompt]].itertuples(index=False, name=None):
                raw, error, used = {}, None, [0, 0, 0.0]
                for turn in range(retries):
                    try:
                        answer, n_in, n_out, cost = client(values[-2], values[-1])
                        used = [used[0] + n_in, used[1] + n_out, used[2] + cost]
                        record = _read(answer)
                        raw, error = {k: v if isinstance(v, str) else None if v is None else json.dumps(v) for k, v in record.items()}, None
                        break
                    except TimeoutError:
                        error = "Timeout"
                    except Exception as e:  # noqa: BLE001 - any client, any error
                        error = str(e) or type(e).__name__
                    if pause and turn + 1 < retries:
                        time.sleep(pause * 2**turn)
                rows.append((*values[:-1], raw, *used, error))
            yield pd.DataFrame(rows, columns=[*key, model, "raw", "input_tokens", "output_tokens", "cost", "error"])

    return work.select(*key, model, prompt).mapInPandas(run, f"{out}, raw map<string,string>, input_tokens long, output_tokens long, cost double, error string")


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def merge_costs(base: str, extra: str) -> Column:
    """The cost of a browsing run: that of its base run and its own, field by field."""
    add = lambda f: (F.coalesce(F.col(f"{base}.{f}"), F.lit(0)) + F.coalesce(F.col(f"{extra}.{f}"), F.lit(0))).alias(f)
    return F.struct(add("cost"), add("input_tokens"), add("output_tokens"))


def poll(ask_cost: Callable[[], dict | None], tries: int = 10, pause: float = 0.1) -> dict | None:
    """The cost record of a call once its provider has it; none after ``tries``."""
    for turn in range(tries):
        if (got := ask_cost()) is not None:
            return got
        time.sleep(pause * turn)
    return None


def human(papers: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold record of each paper as a result; it isn't normalised."""
    return papers.select("paper_id", "schema_name").join(metrics.first_gold(gold), "paper_id").select("paper_id", "schema_name", F.lit("human").alias("model"), F.col("gold").alias("metadata"))


def dummy(papers: DataFrame, record: dict[str, str]) -> DataFrame:
    """The same record for every paper."""
    made = reduce(lambda acc, kv: [*acc, F.lit(kv[0]), F.lit(kv[1])], record.items(), [])
    raw = F.create_map(*made) if made else F.create_map().cast("map<string,string>")
    return papers.select("paper_id", "schema_name", F.lit("dummy").alias("model"), raw.alias("raw"))


def baseline(papers: DataFrame, attr_schema: DataFrame, method: str, year: int) -> DataFrame:
    """Defaults and picked options for every paper, in the long form; ``method`` is first, last or random."""
    if method not in normalise.METHODS:
        raise ValueError(f"unknown method: {method}")
    empty = papers.select("paper_id", "schema_name", F.lit(f"baseline-{method}").alias("model"), F.create_map().cast("map<string,string>").alias("raw"))
    return normalise.postprocess(empty, attr_schema, ["paper_id", "model"], year, method)


def judge(results: DataFrame, attr_schema: DataFrame, kind: str = "jury", by: tuple[str, ...] = ("paper_id", "schema_name", "shot")) -> DataFrame:
    """``(by, attribute, winners)`` of the jury (majority) or the composer (majority of those who may vote)."""
    attributes = tuple(n for n in schemas.RECORD_FIELDS if n != "Subsets")
    cast = ensembles.votes(ensembles.judge_input(results, list(by)), list(by), attributes)
    if kind == "jury":
        return ensembles.majority(cast, list(by))
    groups = attr_schema.where("validation_group IS NOT NULL").select("attribute", "validation_group").distinct()
    return ensembles.compose(cast, list(by), groups)


def failed_reading(answers: Column) -> Column:
    return repair.json_error(answers)
