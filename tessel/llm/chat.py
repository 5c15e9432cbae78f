"""Chat formatting with typed content parts, escaped control strings and an exact loss mask.

A message is a list of parts (text, image, audio, document). A visitor flattens them into one string with ordered
placeholders, and records what each placeholder refers to and how many tokens it expands to. Every turn becomes one
row, so formatting needs no grouping; a conversation's output is its rows in turn order, one after the other.

Defined cases: null text, null role and an unknown part type's missing text are empty; turns that tie are ordered by role
then text; repeated rows are turns of their own; a null conversation id is a conversation; an empty table gives
an empty result; other columns are ignored. Of parts: a null list or part is nothing; a list that isn't JSON, or no list, is
one text part with the string as it is; a part that is a string is text, and any other that is no object is text in JSON; a size
that is no positive finite number counts as missing; half a surrogate pair becomes U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rows, small

#: What opens, ends and marks a turn; strings that chat templates read as control.
OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIND = re.compile("|".join(map(re.escape, CONTROL)))
FORMATTED = "conv_id long, turn long, role string, formatted string, loss_from long, loss_to long, attachments string, expanded_tokens long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string."""
    return _FIND.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], role)


_HALF = re.compile("[\ud800-\udfff]")
#: No attachment counts for more tokens, so that sums stay in range.
MOST = 1 << 40


def size(x: object, missing: float) -> float:
    try:
        out = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return missing
    return min(out, float(MOST)) if out > 0 and not math.isnan(out) and not math.isinf(out) else missing


@dataclass
class Flattener:
    """Visitor over content parts: text is escaped, the rest become numbered placeholders."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: object) -> None:
        if part is None:
            return
        if not isinstance(part, dict):
            part = {"text": part}
        kind = part.get("type")
        {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(kind if isinstance(kind, str) else "", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.out.append(escape(_HALF.sub("\ufffd", text if isinstance(text, str) else "" if text is None else json.dumps(text))))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append({"n": n, "type": kind, "ref": part.get("ref"), "tokens": min(tokens, MOST)})
        self.out.append(f"<|{kind}:{n}|>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil(size(part.get("width"), self.patch) / self.patch) * math.ceil(size(part.get("height"), self.patch) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round(size(part.get("seconds"), 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(size(part.get("pages"), 1))) * self.page_tokens)


def parts_of(text: str | None) -> list:
    """The parts of a JSON list."""
    try:
        found = json.loads(text) if text else []
    except (ValueError, RecursionError):
        found = text
    return found if isinstance(found, list) else [] if found is None else [{"text": text}]


def format_turn(role: str | None, parts: list, loss_role: str = "assistant") -> tuple[str, int, int, list[dict]]:
    """The turn's string, the code points [from, to) under the loss mask, and its attachments."""
    f = Flattener()
    for p in parts:
        f.visit(p)
    head, body = f"{OPEN}{escape_role(role or '')}{BREAK}", "".join(f.out)
    a = len(head)
    return head + body + CLOSE, a, a + len(body) if role == loss_role else a, f.attachments


def format_chat(turns: DataFrame, parts_json: str | None = None) -> DataFrame:
    """One row per turn of turns(conv_id, turn, role, text); parts_json names a column with a JSON list of parts to use instead of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(FORMATTED)
        for b in small(batches):
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                parts = parts_of(text) if parts_json else [{"type": "text", "text": text}]
                out, a, e, attachments = format_turn(role, parts)
                if rows.add(conv, turn, role, out, a, e, json.dumps(attachments), sum(x["tokens"] for x in attachments), weight=len(out)):
                    yield from rows.take()
        yield from rows.take()

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col(parts_json or "text").cast("string")).mapInArrow(run, FORMATTED)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not one formatted turn")
    return unescape_role(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back, one digest row per conversation.

    Rows are dealt by conversation and sorted; a fold over the sorted stream keeps only the running hashes, so a
    conversation of any length needs constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, state = Rows(DIGEST), object(), None

        def close() -> bool:
            return state is not None and rows.add(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in small(batches):
            for conv, out, a, e in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != now:
                    if close():
                        yield from rows.take()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(out)
                masked = unescape(out[a:e])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(out)
        close()
        yield from rows.take()

    # equal keys of the sort are equal rows, so their order cannot matter
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, DIGEST)
