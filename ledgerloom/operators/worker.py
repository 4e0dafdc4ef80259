"""Summaries by a worker: prompts, a pluggable call, usage, and escalation through tiers of models.

The worker itself is outside: `summarise` takes any function from prompts to (raw digest, usage) and runs it by batch
in Arrow batches, one client a task. The default is a deterministic stand-in, so that everything around the call can be run and tested.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .cost import FAMILIES

KINDS = ("file_map", "clusters", "run")
USAGE = "input_tokens bigint, output_tokens bigint, cache_write bigint, cache_read bigint, cost_usd double"


class Usage(NamedTuple):
    """Tokens and dollars of one call; the stand-in's are fixed."""

    input_tokens: int = 11
    output_tokens: int = 22
    cache_write: int = 33
    cache_read: int = 44
    cost_usd: float = 0.0425


_SHAPES = {
    "file_map": '{"summary": "<purpose and shape in 3-5 sentences>", "map": [{"lines": "<start>-<end>", "kind": "<what stands there>"}], "symbols": ["<at most 40 top-level names>"], "notes": "<remarks>"}',
    "clusters": '{"summary": "<what the matches have in common>", "clusters": [{"where": "<folder or file prefix>", "matches": 0, "gist": "<why these match>"}], "total": 0, "representative_files": ["<path>"]}',
    "run": '{"summary": "<outcome in 1-3 sentences>", "key_lines": ["<errors, failures, totals>"], "exit_code": 0, "log_path": ""}',
}


def prompt(kind: Column, meta: Column, content: Column, partial: Column, may_escalate: Column) -> Column:
    """What a worker is asked: the kind's JSON shape, an honest word on what part it sees, and the content."""
    shape = F.create_map(*[x for k, v in _SHAPES.items() for x in (F.lit(k), F.lit(v))])
    what = F.when(kind == "file_map", F.concat(F.lit("the file "), meta)).when(kind == "clusters", F.concat(F.lit("the matches of the pattern "), meta)).otherwise(F.concat(F.lit("the output of "), meta))
    part = F.when(~partial, "All of it is shown.").when(kind == "run", "Only its END is shown.").otherwise("Only its FIRST PART is shown: describe nothing beyond where that ends.")
    ask = F.when(may_escalate & (kind == "file_map"), 'If this is beyond you, return {"escalate": true} instead.\n').otherwise("")
    return F.concat(F.lit("Summarise "), what, F.lit(". "), part, F.lit("\nReturn only a JSON object of this shape:\n"), F.element_at(shape, kind), F.lit("\n"), ask, F.lit("\nCONTENT:\n"), content)


def stand_in(prompts: list[str], model: str) -> list[tuple[str, Usage]]:
    """Digests that depend on the prompts alone: sizes, first lines. The least of models passes on what is over 2,000 lines."""
    out = []
    for p in prompts:
        head, _, content = p.partition("\nCONTENT:\n")
        lines = content.split("\n")
        n = len(lines) - (not lines[-1])
        first = next((x.strip() for x in lines if x.strip()), "")[:60]
        if '"escalate"' in head and n > 2000 and model == FAMILIES[0]:
            digest: dict = {"escalate": True}
        elif head.startswith("Summarise the file"):
            digest = {"summary": f"{n} lines, from: {first}", "map": [{"lines": f"1-{max(1, n)}", "kind": "all lines"}], "symbols": [], "notes": ""}
        elif head.startswith("Summarise the matches"):
            digest = {"summary": f"{n} matches", "clusters": [{"where": first.split(":")[0], "matches": n, "gist": first}], "total": n, "representative_files": [first.split(":")[0]]}
        else:
            digest = {"summary": f"{n} lines of output", "key_lines": [first], "exit_code": 0, "log_path": ""}
        out.append((json.dumps(digest, ensure_ascii=False), Usage()))
    return out


def summarise(df: DataFrame, model: str = FAMILIES[0], call: Callable[[list[str], str], list[tuple[str | None, Usage]]] = stand_in, batch: int = 64) -> DataFrame:
    """df(op, prompt) to op, model, raw and usage; a call that gives nothing leaves raw null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                got = call([x or "" for x in part.column("prompt").to_pylist()], model)
                n = part.num_rows
                usage = [pa.array([u[i] for _, u in got], pa.float64() if i == 4 else pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("op"), pa.array([model] * n), pa.array([r for r, _ in got], pa.string()), *usage], ["op", "model", "raw", *Usage._fields])

    return df.select("op", "prompt").mapInArrow(run, f"op string, model string, raw string, {USAGE}")


def escalated(df: DataFrame, call: Callable[[list[str], str], list[tuple[str | None, Usage]]] = stand_in, start: str = FAMILIES[0]) -> DataFrame:
    """Attempts (op, attempt, model, raw, usage, escalate) through the tiers of models: an op whose digest asks for more
    goes to the next. At most three passes, one a tier."""
    attempts, rest = None, df
    for n, model in enumerate(FAMILIES[FAMILIES.index(start) :]):
        got = summarise(rest, model, call).withColumns({"attempt": F.lit(n), "escalate": P.escalates(F.col("raw"))})
        attempts = got if attempts is None else attempts.unionByName(got)
        rest = rest.join(got.where("escalate").select("op"), "op", "left_semi")
    return attempts
