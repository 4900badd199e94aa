"""Chat formatting by schema fingerprints.

A record is a JSON text of any layout.  Its fingerprint is the hash of its
sorted set of nested field paths (list positions dropped).  The fingerprint
selects a declarative mapping, a list of steps that say where turns are found;
``canonical_turns`` applies it.  A template then marks turns, escapes control
strings reversibly and marks what is trained on (the assistants' texts).

Control strings of the template are ``###`` and ``</turn>``; a backslash, or
one of them inside a role or text, is written after a backslash.  A line break
ends the head of a turn, so one inside a role is written as backslash and n.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A step is (path to a list of turns or "" for the record itself, role field or
# "=role" for a fixed one, text field, names of roles). Steps run in order.
OWN = {}
SHARED = {"human": "user", "gpt": "assistant"}
LAYOUTS: dict[str, dict] = {
    "message": {"paths": ["content", "role"], "steps": [("", "role", "content", OWN)]},
    "from_value": {"paths": ["from", "value"], "steps": [("", "from", "value", SHARED)]},
    "speaker": {"paths": ["body.text", "speaker.role"], "steps": [("", "speaker.role", "body.text", OWN)]},
    "messages": {"paths": ["messages", "messages.content", "messages.role"],
                 "steps": [("messages", "role", "content", OWN)]},
    "conversations": {"paths": ["conversations", "conversations.from", "conversations.value"],
                      "steps": [("conversations", "from", "value", SHARED)]},
    "prompt_completion": {"paths": ["completion", "prompt"],
                          "steps": [("", "=user", "prompt", OWN), ("", "=assistant", "completion", OWN)]},
    "prompt_response": {"paths": ["prompt", "response"],
                        "steps": [("", "=user", "prompt", OWN), ("", "=assistant", "response", OWN)]},
    "instruction": {"paths": ["instruction", "output"],
                    "steps": [("", "=user", "instruction", OWN), ("", "=assistant", "output", OWN)]},
    "instruction_input": {"paths": ["input", "instruction", "output"],
                          "steps": [("", "=system", "instruction", OWN), ("", "=user", "input", OWN),
                                    ("", "=assistant", "output", OWN)]},
}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; elements of a list share their list's path."""
    if isinstance(value, dict):
        out = {at} if at and not value else set()
        for k, v in value.items():
            p = f"{at}.{k}" if at else k
            out |= ({p} if isinstance(v, list) else set()) | field_paths(v, p)
        return out
    if isinstance(value, list):
        return set().union(*(field_paths(v, at) for v in value)) if value else ({at} if at else set())
    return {at} if at else set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(x["paths"]): (name, x["steps"]) for name, x in LAYOUTS.items()}


def _at(value, path: str):
    for k in path.split(".") if path else ():
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """(fingerprint, layout, turns) of one JSON record; layout "unknown" has no turns."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    mark = fingerprint(field_paths(value))
    name, steps = MAPPINGS.get(mark, ("unknown", []))
    turns = []
    for path, role, text, names in steps:
        items = _at(value, path)
        for item in items if isinstance(items, list) else [items]:
            r = role[1:] if role.startswith("=") else _text(_at(item, role))
            turns.append((names.get(r, r), _text(_at(item, text))))
    return mark, name, turns


TURN = "conv_id long, seq long, part int, role string, text string, layout string, fingerprint string"


def canonical_turns(records: DataFrame) -> DataFrame:
    """Turns (conv_id, seq, part, role, text, layout, fingerprint) of records (conv_id, seq, record JSON text).

    A conversation may be one record or several, in order of ``seq``; ``part``
    numbers the turns of a record.  Null texts and roles become empty.  A null or
    broken record, or one whose field paths no mapping knows, gives one row with
    layout "unknown" and null role and text, so that nothing is lost in silence.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, seq, record in b.itertuples(index=False):
                mark, name, turns = canonical(record)
                out += [(conv, seq, i, r, t, name, mark) for i, (r, t) in enumerate(turns)] or [
                    (conv, seq, 0, None, None, name, mark)]
            yield pd.DataFrame(out, columns=["conv_id", "seq", "part", "role", "text", "layout", "fingerprint"]).astype(
                {"conv_id": "Int64", "seq": "Int64"})
    return records.select("conv_id", "seq", "record").mapInPandas(run, TURN)


def escaped(c):
    return F.regexp_replace(c, r"(\\|###|</turn>)", r"\\$1")


def formatted(turns: DataFrame) -> DataFrame:
    """Adds ``piece`` (the turn in the template), ``loss_start`` and ``loss_length`` (code points in the piece).

    A conversation's text is its pieces in order of (seq, part).  Turns of the
    assistant are trained on: their text, without marks, lies under the mask;
    other turns have length 0.  Rows without a role (unknown records) are left out.
    """
    head = F.concat(F.lit("### "), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(r"\n")), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    trained = F.col("role") == "assistant"
    return (turns.filter(F.col("role").isNotNull())
            .withColumn("piece", F.concat(head, body, F.lit("</turn>\n")))
            .withColumn("loss_start", F.length(head))
            .withColumn("loss_length", F.when(trained, F.length(body)).otherwise(0)))


def unescape(s: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|n)", lambda m: "\n" if m[1] == "n" else m[1], s)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
MARKS = re.compile(r"\\.|### |</turn>\n", re.S)           # an escaped character, or the begin or end of a turn


class Reader:
    """Reads a conversation's formatted text, given in any pieces, by its marks alone.

    A turn begins with an unescaped ``### `` and ends with an unescaped ``</turn>`` and line break; its first
    line is the role.  Every unescaped mark is searched for, so a text that held one
    unescaped would be read as more turns.  State: the open turn and two hashes.
    """

    def __init__(self):
        self.n, self.turns, self.chars, self.loss, self.size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        self.held = ""

    def feed(self, text: str) -> None:
        self.size += len(text)
        self.held += text
        while True:
            begun, end = None, None
            for m in MARKS.finditer(self.held):
                if m[0] == "### ":
                    if begun is not None:
                        raise ValueError("a turn begins inside a turn")
                    begun = m.end()
                elif not m[0].startswith("\\"):
                    end = m
                    break
            if end is None:
                return
            if begun is None:
                raise ValueError("a turn ends that has not begun")
            head, _, body = self.held[begun:end.start()].partition("\n")
            role, said = unescape(head), unescape(body)
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
            if role == "assistant":             # what lies under the loss mask
                self.chars += len(said)
                self.loss.update(said.encode())
            self.held = self.held[end.end():]

    def result(self) -> tuple:
        if self.held:
            raise ValueError("text after the last turn")
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted text by the marks in it (``Reader``).

    Pieces of a conversation are sorted within a task and read as one text, as a stream: the
    state is two hash objects and the open turn, however long a conversation is.
    The loss mask is checked too: ``loss_start`` and ``loss_length`` must lie on the text of an assistant's turn.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, reader = None, None
        masked = (0, None)
        for b in batches:
            done = []
            for conv, piece, start, length in b.itertuples(index=False):
                key = (None if pd.isna(conv) else int(conv),)
                if key != open_id:
                    if reader is not None:
                        done.append(_closed(open_id[0], reader, masked))
                    open_id, reader, masked = key, Reader(), (0, hashlib.sha256())
                reader.feed(piece)
                under = unescape(piece[start:start + length])
                masked[1].update(under.encode())
                masked = (masked[0] + len(under), masked[1])
            yield _read_frame(done)
        if reader is not None:
            yield _read_frame([_closed(open_id[0], reader, masked)])

    cols = ["conv_id", "piece", "loss_start", "loss_length"]
    return (pieces.select(*cols, "seq", "part").repartition("conv_id")
            .sortWithinPartitions("conv_id", "seq", "part", "piece").select(*cols).mapInPandas(run, READ))


def _closed(conv, reader: Reader, masked: tuple) -> tuple:
    n, turns, chars, loss, size = reader.result()
    if (chars, loss) != (masked[0], masked[1].hexdigest()):
        raise ValueError("the loss mask does not lie on the assistant's texts")
    return conv, n, turns, chars, loss, size


def _read_frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                       "formatted_chars"]).astype({"conv_id": "Int64"})
