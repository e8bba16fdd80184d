"""Judging answers by any scorer: a transport is injected, its replies are checked strictly.

A task turns the fields of a row into a request; a transport answers requests with JSON text. Requests
that are alike are sent once. A reply that isn't what the task asks for never becomes a verdict: its row
stays, with the reason. Replies are written before anything reads them, so a lost executor neither loses
nor pays for a reply twice that has been kept; an earlier run's replies can be handed in.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .labels import CONFLICT_WORDS
from .tables import kept


@dataclass(frozen=True)
class Task:
    """``fields`` of a row fill the prompt; the reply's ``key`` holds one of ``verdicts`` (booleans if none)."""

    name: str
    fields: tuple[str, ...]
    prompt: str
    key: str
    verdicts: tuple[str, ...] = ()


GROUNDEDNESS = Task(
    "groundedness",
    ("claim", "span"),
    "Decide from the passage alone, without other knowledge, whether it states what the claim says. A caption or "
    'heading that only names a subject states nothing. Answer with JSON {{"supported": true or false, "rationale": text}}.\n'
    "Claim: {claim}\nPassage: {span}",
    "supported",
)
DISAGREEMENT = Task(
    "disagreement",
    ("query", "note", "answer"),
    "Sources disagree as the note says. Does the answer tell so? pass: it says that they conflict; partial: it gives both "
    'findings without saying so; fail: it gives one side. Answer with JSON {{"verdict": "pass", "partial" or "fail", '
    '"rationale": text}}.\nQuestion: {query}\nNote: {note}\nAnswer: {answer}',
    "verdict",
    ("pass", "partial", "fail"),
)


class Busy(Exception):
    """The scorer asks to be called again later, after ``seconds`` if it says so."""

    def __init__(self, seconds: float = 15.0):
        super().__init__(seconds)
        self.seconds = seconds


#: A transport: (task, fields of the row, prompt) -> the reply's text.
Transport = Callable[[Task, dict[str, str], str], str]

# fixed value: what separates the words that are compared
_GAP = re.compile("[ \t\n\r\f\x0b   ]+")


def _share(a: str, b: str) -> float:
    x, y = ({w for w in _GAP.split(t.lower()) if len(w) > 3} for t in (a, b))
    return len(x & y) / len(x) if x and y else 0.0


def deterministic(task: Task, fields: dict[str, str], prompt: str) -> str:
    """Judges by shared words, without any network: for tests of what surrounds a judge, not for results."""
    if task.name == "groundedness":
        return json.dumps({"supported": _share(fields["claim"], fields["span"]) >= 0.35, "rationale": "shared words"})
    share = _share(fields["note"], fields["answer"])
    told = any(w in fields["answer"].lower() for w in CONFLICT_WORDS)
    return json.dumps({"verdict": "pass" if share >= 0.25 and told else "partial" if share >= 0.15 else "fail", "rationale": "shared words"})


def remote(send: Callable[[str, str], str], key: str | None) -> Transport:
    """A transport over ``send`` (prompt, key) -> reply. Without a key it fails here, not in the middle of a
    run and never by falling back to another judge."""
    if not key:
        raise RuntimeError("a remote judge needs a key")
    return lambda task, fields, prompt: send(prompt, key)


def judge(name: str, send: Callable[[str, str], str] | None = None, key: str | None = None) -> Transport:
    if name == "deterministic":
        return deterministic
    if name == "remote" and send is not None:
        return remote(send, key)
    raise ValueError(f"unknown judge {name!r}")


def checked(task: Task, reply: str) -> tuple[str | None, str | None, str | None]:
    """(verdict, rationale, error) of a reply; booleans come as true and false."""
    try:
        said = json.loads(reply)
    except (TypeError, ValueError):
        return None, None, "not_json"
    if not isinstance(said, dict):
        return None, None, "not_an_object"
    verdict, rationale = said.get(task.key), said.get("rationale", "")
    if not isinstance(rationale, str):
        return None, None, "rationale_not_text"
    if task.verdicts:
        fine = isinstance(verdict, str) and verdict in task.verdicts
    else:
        fine = isinstance(verdict, bool)
    if not fine:
        return None, None, f"bad_{task.key}"
    return (verdict if task.verdicts else str(verdict).lower()), rationale, None


def asked(task: Task, fields: dict[str, str], transport: Transport, tries: int, sleep: Callable[[float], None]) -> tuple:
    """(verdict, rationale, tries, error): only a busy scorer is asked again."""
    prompt = task.prompt.format(**fields)
    for n in range(1, tries + 1):
        try:
            return (*checked(task, transport(task, fields, prompt)), n)
        except Busy as busy:
            if n < tries:
                sleep(busy.seconds)
        except Exception as e:  # noqa: BLE001  whatever a transport raises belongs to this row alone
            return None, None, f"transport:{type(e).__name__}", n
    return None, None, "busy", tries


def request_id(task: Task) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(task.name).alias("task"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in task.fields])), 256)


REPLY = "request_id string, verdict string, rationale string, error string, tries int"


def judged(rows: DataFrame, task: Task, transport: Transport, parallel: int | None = None, tries: int = 6, replies: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with request_id, verdict, rationale, error and tries.

    rows: the task's fields, among other columns; null fields count as empty. Each distinct request is sent
    once; ``parallel`` partitions ask at a time (default: as the rows lie). ``replies``: (request_id,
    verdict, rationale, error, tries) of earlier runs; what has a verdict there isn't asked again. error:
    null, not_json, not_an_object, rationale_not_text, bad_<key>, busy after ``tries`` tries, or
    transport:<kind>. Rows never get lost, repeated ones share a reply; an empty table sends nothing.
    """
    ship(rows.sparkSession)
    keyed = rows.withColumn("request_id", request_id(task))
    need = keyed.select("request_id", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in task.fields]).dropDuplicates(["request_id"])
    known = None if replies is None else replies.where("verdict is not null").select(*[c.split(" ")[0] for c in REPLY.split(", ")]).dropDuplicates(["request_id"])
    if known is not None:
        need = need.join(known.select("request_id"), "request_id", "left_anti")
    if parallel:
        need = need.repartition(parallel, "request_id")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [asked(task, {f: row[f] for f in task.fields}, transport, tries, sleep) for row in frame.to_dict("records")]
            columns = list(zip(*said, strict=True)) if said else [[], [], [], []]
            out = {"request_id": frame["request_id"], **{c: pd.Series(v, dtype=object) for c, v in zip(("verdict", "rationale", "error"), columns[:3], strict=True)}}
            yield pd.DataFrame(out | {"tries": pd.Series(columns[3], dtype="int32")})

    found = kept(need.mapInPandas(ask, REPLY), "replies")
    return keyed.join(found if known is None else found.unionByName(known), "request_id", "left")


def failures(judgments: DataFrame) -> DataFrame:
    """(error, n): what a run must not hide."""
    return judgments.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def required(judgments: DataFrame) -> DataFrame:
    """The same rows, or an error that counts the failures by reason."""
    bad = {r["error"]: r["n"] for r in failures(judgments).collect()}
    if bad:
        raise RuntimeError(f"judgments failed: {bad}")
    return judgments
