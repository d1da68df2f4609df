"""Chat formatting of typed content parts, with loss mask, attachments and a reader that takes the format apart again.

A turn is written `### role: content</turn>` and a line feed. Its content is a list of parts; a visitor goes through them in order:
text is escaped, an image, a recording or a document becomes a numbered placeholder such as `<|image 2|>`, its reference is noted, and
the tokens that the placeholder stands for are counted. The control strings (`##`, `</`, `<|`, in roles also `: `) are broken by a
backslash, backslashes are doubled, so none of them occurs in what is written between, and undoing it gives the same text.

Turns are ranged by (conversation, turn), so even a conversation with a third of all rows is formatted by many tasks. A conversation
is a series of segments of bounded length, most have one; only a hash over a whole conversation reads its segments in one task, one
after the other.

Cases: null texts, roles and contents are empty; a null part has no text; parts of an unknown type become `<|other n|>` with no tokens;
a null turn comes first; turns with equal numbers are ordered by role and content; repeated rows are turns of their own; rows without
conversation id are one conversation with a null id; an empty table gives no segment; other columns don't count.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.llm.common import saved

#: What parts are; which fields are set depends on the type.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
SEGMENTS = (
    "conv_id long, segment long, text string, n_turns int, loss array<struct<start: int, stop: int>>, "
    "attachments array<struct<turn: long, number: int, type: string, ref: string, at: int, tokens: long>>, tokens long"
)
#: Characters after which a segment ends with its turn.
SEGMENT = 200_000
#: Pixels of a side of an image patch, tokens a second of a recording, tokens a page.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 1000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = "</turn>\n"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</", "<\\/").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escaped_role(role: str) -> str:
    return escaped(role).replace(": ", ":\\ ")


@dataclass
class _Turn:
    """What the visitor has written of a turn's content."""

    turn: int | None
    written: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def write(self, text: str) -> None:
        self.written.append(text)
        self.size += len(text)

    def attach(self, kind: str, ref: str | None, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.attachments.append({"turn": self.turn, "number": number, "type": kind, "ref": ref, "at": self.size, "tokens": tokens})
        self.tokens += tokens
        self.write(f"<|{kind} {number}|>")


def _text(turn: _Turn, part: dict) -> None:
    turn.write(escaped(part["text"] or ""))
    turn.tokens += len(WORD.findall(part["text"] or ""))


def _image(turn: _Turn, part: dict) -> None:
    turn.attach("image", part["ref"], math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))


def _audio(turn: _Turn, part: dict) -> None:
    turn.attach("audio", part["ref"], math.ceil((part["seconds"] or 0) * TOKENS_PER_SECOND))


def _document(turn: _Turn, part: dict) -> None:
    turn.attach("document", part["ref"], (part["pages"] or 0) * TOKENS_PER_PAGE)


#: The visitor: what is done at a part of each type.
VISIT: dict[str, Callable[[_Turn, dict], None]] = {"text": _text, "image": _image, "audio": _audio, "document": _document}


def visited(turn: int | None, content: list[dict | None] | None) -> _Turn:
    out = _Turn(turn)
    for part in content or []:
        if part is not None:
            VISIT.get(part["type"], lambda t, p: t.attach("other", p["ref"], 0))(out, part)
    return out


def _segments(trained: frozenset[str], longest: int):
    """Reads turns in order and gives segments."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("n_turns", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))), ("tokens", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, now = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"] or now["size"] >= longest:
                    if now is not None:
                        done.append(now)
                        size += now["size"]
                    if size >= 8 * longest or len(done) >= 4096:
                        yield _batch(done, schema)
                        done, size = [], 0
                    now = {"conv_id": row["conv_id"], "segment": row["first"], "written": [], "size": 0, "n_turns": 0, "loss": [], "attachments": [], "tokens": 0}
                turn, role = visited(row["turn"], row["content"]), row["role"] or ""
                head = f"### {escaped_role(role)}: "
                start = now["size"] + len(head)
                now["written"] += [head, *turn.written, END]
                now["size"] = start + turn.size + len(END)
                now["n_turns"] += 1
                now["tokens"] += turn.tokens
                now["attachments"] += [a | {"at": start + a["at"]} for a in turn.attachments]
                if role in trained:
                    now["loss"].append({"start": start, "stop": start + turn.size})
        if now is not None:
            done.append(now)
            yield _batch(done, schema)

    return run


def _batch(done: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f: "".join(x["written"]) if f == "text" else x[f] for f in schema.names} for x in done], schema=schema)


def format_chats(messages: DataFrame, trained: tuple[str, ...] = ("assistant",), longest: int = SEGMENT) -> DataFrame:
    """Segments of the formatted conversations.

    messages: conv_id, turn, role, content (array of PART). Returns conv_id, segment (rises within a conversation), text, n_turns, loss
    (code points of text that are trained on: what the trained roles say), attachments (in order, at their placeholder in text) and tokens
    (words, and placeholders at their expanded size).
    """
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("content").asc_nulls_first()]
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.col("content").cast(f"array<{PART}>"))
    rows = rows.withColumn("__salt", F.monotonically_increasing_id())  # equal rows can be cut between ranges
    ranged = rows.repartitionByRange(*by, "__salt").sortWithinPartitions(*by, "__salt").drop("__salt").withColumn("first", F.monotonically_increasing_id())
    return ranged.mapInArrow(_segments(frozenset(trained), longest), SEGMENTS)


def text_content(text) -> F.Column:
    """Content of a single text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted segment; placeholders stay in the text."""
    out = []
    for turn in text.split(END)[:-1]:
        role, content = turn.removeprefix("### ").split(": ", 1)
        out.append((unescaped(role), unescaped(content)))
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads segments in order, takes them apart and gives a row for each conversation."""
    out, now = [], None

    def row() -> dict:
        return now | {"turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()}

    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in DIGESTS.split(", "))])
    for batch in batches:
        for s in batch.to_pylist():
            if now is None or now["conv_id"] != s["conv_id"]:
                if now is not None:
                    out.append(row())
                now = {n: 0 for n in schema.names} | {"conv_id": s["conv_id"], "turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()}
            for role, text in turns(s["text"]):
                now["n_turns"] += 1
                now["turns_sha256"].update(f"{role}\n{text}\n".encode())
            for span in s["loss"]:
                said = unescaped(s["text"][span["start"] : span["stop"]])
                now["loss_chars"] += len(said)
                now["loss_sha256"].update(said.encode())
            now["formatted_chars"] += len(s["text"])
            now["n_attachments"] += len(s["attachments"])
            now["expanded_tokens"] += s["tokens"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each conversation of the segments: its turns and trained texts as they are read back, hashed."""
    by = [F.col("conv_id").asc_nulls_first(), "segment"]
    return segments.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(_digested, DIGESTS)


def digest(messages: DataFrame) -> DataFrame:
    """messages formatted, written, and read back."""
    return read_back(saved(format_chats(messages), "chat-segments"))
