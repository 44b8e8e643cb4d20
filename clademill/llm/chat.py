"""Chat formatting: records of different layouts become canonical turns, and turns become one string and back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declarative mappings. `list` names the field that holds the turns, with the fields of each turn's order, role and text;
#: `aliases` marks layouts whose own role names stand for user and assistant; other layouts' roles stay as they are.
#: `fields` gives single fields and the roles that their texts take, in order, several of one role joined by a blank line.
MAPPINGS: list[dict] = [
    {"name": "messages", "list": "messages", "role": "role", "text": "content"},
    {"name": "turns", "list": "turns", "role": "role", "text": "text", "order": "turn"},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value", "aliases": True},
    {"name": "prompt-completion", "fields": [("prompt", "user"), ("completion", "assistant")]},
    {"name": "prompt-response", "fields": [("prompt", "user"), ("response", "assistant")]},
    {"name": "system-prompt-response", "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    {"name": "question-answer", "fields": [("question", "user"), ("answer", "assistant")]},
    {"name": "instruction-output", "fields": [("instruction", "user"), ("output", "assistant")]},
    {"name": "instruction-input-output", "fields": [("instruction", "user"), ("input", "user"), ("output", "assistant")]},
    {"name": "instruction-response", "fields": [("instruction", "user"), ("response", "assistant")]},
    {"name": "instruction-context-response", "fields": [("instruction", "user"), ("context", "user"), ("response", "assistant")]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _paths_of(mapping: dict) -> set[str]:
    if "list" in mapping:
        return {f"{mapping['list']}[].{mapping[k]}" for k in ("order", "role", "text") if k in mapping}
    return {f for f, _ in mapping["fields"]}


KNOWN_PATHS = set().union(*map(_paths_of, MAPPINGS))


def paths(value, at: str = "") -> set[str]:
    """The paths of all fields that hold something else than an object: a.b for fields, a[] for what a list holds."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found: set[str]) -> str:
    """A hash of the field paths that mappings know; other fields don't count."""
    return hashlib.sha256("\n".join(sorted(found & KNOWN_PATHS)).encode()).hexdigest()[:16]


def _variants(mapping: dict) -> list[set[str]]:
    """The sets of paths that select a mapping: all of its paths; in lists of turns also some, as fields that are null in all turns
    may be left out."""
    every = sorted(_paths_of(mapping))
    if "list" not in mapping:
        return [set(every)]
    return [set(some) for n in range(1, len(every) + 1) for some in combinations(every, n)]


BY_FINGERPRINT = {fingerprint(v): m for m in MAPPINGS for v in _variants(m)}


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """The name of the record's layout and its turns (role, text), or None if no mapping fits or it isn't an object."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    mapping = BY_FINGERPRINT.get(fingerprint(paths(value)))
    if mapping is None:
        return None
    show = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if "list" in mapping:
        items = [x for x in value[mapping["list"]] if isinstance(x, dict)]
        if mapping.get("order"):
            items.sort(key=lambda x: (x.get(mapping["order"]) is not None, x.get(mapping["order"]) or 0))
        turns = [(show(x.get(mapping["role"])), show(x.get(mapping["text"]))) for x in items]
        return mapping["name"], [(ROLES.get(r, r), t) for r, t in turns] if mapping.get("aliases") else turns
    turns = []
    for field, role in mapping["fields"]:
        text = show(value[field])
        if turns and turns[-1][0] == role:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{text}" if text else turns[-1][1])
        else:
            turns.append((role, text))
    return mapping["name"], turns


#: The template's control strings: a backslash before them, or before a backslash, makes them text.
START, CLOSE, END = "<turn ", ">", "</turn>\n"
_CONTROL = re.compile(r"\\|(?=<turn |</turn>)")
_IN_ROLE = re.compile(r"\\|(?=<turn |</turn>|>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:\\.|[^\\>])*)>((?:\\.|[^\\])*?)</turn>\n", re.S)


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and its loss mask: the spans (start, end) of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, _IN_ROLE)}{CLOSE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted string holds."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def chat_format(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """One row per record (JSON): id, layout, turns, formatted, loss_spans.

    The record's nested field paths are hashed; the hash selects the mapping that says where roles and texts are.
    Records of no known layout, null ones and what isn't a JSON object come back with layout, turns and formatted null.
    Null texts and roles are empty. A list without turns has no paths, hence no layout. Repeated records are formatted alike.
    Other columns are ignored, as are fields of the record that no mapping names.
    """
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch["record"]:
                found = canonical(record)
                if found is None:
                    rows.append((None, None, None, None))
                else:
                    formatted, spans = format_turns(found[1])
                    turns = [{"role": r, "text": t} for r, t in found[1]]
                    rows.append((found[0], turns, formatted, [{"start": a, "end": b} for a, b in spans]))
            out = pd.DataFrame(rows, columns=["layout", "turns", "formatted", "loss_spans"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    schema = (
        f"id {kind}, layout string, turns array<struct<role: string, text: string>>, formatted string, "
        "loss_spans array<struct<start: long, end: long>>"
    )
    rows = records.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{record_col}`").alias("record"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted strings hold, read back from them: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A row for each record; those that couldn't be formatted have nulls. Ids may repeat or be null; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for i, f, spans in zip(batch["id"], batch["formatted"], batch["loss_spans"], strict=True):
                if f is None:
                    rows.append((i, *[None] * 5))
                    continue
                turns = read_turns(f)
                loss = "".join(unescape(f[s["start"] : s["end"]]) for s in spans)
                rows.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(f)))
            yield pd.DataFrame(
                rows, columns=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            ).astype({"id": "object", "n_turns": "Int64", "loss_chars": "Int64", "formatted_chars": "Int64"})

    kind = formatted.schema[id_col].dataType.simpleString()
    rows = formatted.select(F.col(f"`{id_col}`").alias("id"), "formatted", "loss_spans")
    return rows.mapInPandas(
        run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumnRenamed("id", id_col)


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation, by turn, as one JSON record. A conversation is one string in the end,
    so its rows have to fit in memory; conversations are spread by id. Null fields keep their names, by which mappings are found.
    Rows of one turn number come by role and text, null numbers first; repeated rows stay. Null ids are one conversation. Other columns are ignored."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )


ORACLE_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>') as esc from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(6 + length(role) + 1 + length(esc) + 8) as bigint) as formatted_chars
from e group by conv_id
"""
