"""Chat texts from turns by a declarative template, checked by a finite-state machine over roles.

Each turn becomes the template's segments: literal marks and the turn's text, every segment with a
loss flag of its own. Control strings inside texts are escaped reversibly: of every ``<``, any
number of backslashes and ``|`` one backslash more is written, so ``<|`` occurs in marks only.

The machine's state after a turn is that turn's role, so a turn is legal when the pair of the
previous role and its own is a transition; a conversation is valid when all its turns are legal and
its last role may end it. Turns are ordered by (turn, role, text). Where a conversation is larger
than others, its turns are still sorted and read as a stream: nothing holds a whole conversation.

Null texts and roles are empty; a null conv_id is a conversation like any other. Turns of equal
number keep the order above, repeated rows are turns of their own. Other columns are not read. An
empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
#: Segments of a turn: (kind, literal or None for a field, loss for the roles named).
TEMPLATE = (
    ("mark", START, ()),
    ("role", None, ()),
    ("mark", "\n", ()),
    ("text", None, ("assistant",)),
    ("mark", STOP + "\n", ()),
)
#: Role before ("" at the start) -> roles that may follow; END ends a conversation.
END = "<end>"
TRANSITIONS = {
    "": ("system", "user"),
    "system": ("user",),
    "user": ("assistant", END),
    "assistant": ("user", "tool", END),
    "tool": ("assistant",),
}
_RAW, _ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"<\\$1|")


def escape_role(role: Column) -> Column:
    """A role fills one line: newlines and backslashes are written with a backslash, too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(_ESCAPED, lambda m: "<" + m[1] + "|", text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _allowed(before: Column, after: Column) -> Column:
    pairs = [F.concat_ws("\n", F.lit(a), F.lit(b)) for a, follow in TRANSITIONS.items() for b in follow]
    return F.concat_ws("\n", before, after).isin(*pairs)


def segments(turns: DataFrame, template=TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text, legal, may_end, segments``.

    ``segments`` is an array of (kind, text, loss) in the order of the template. ``legal`` says
    whether the turn may follow the one before, ``may_end`` whether a conversation may end with it.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    checked = rows.withColumn("legal", _allowed(F.coalesce(before, F.lit("")), F.col("role")))
    each = []
    for kind, literal, loss in template:
        value = F.lit(literal) if literal is not None else escape_role(F.col("role")) if kind == "role" else escape(F.col("text"))
        each.append(F.struct(F.lit(kind).alias("kind"), value.alias("text"),
                             (F.col("role").isin(*loss) if loss else F.lit(False)).alias("loss")))
    return checked.select("*", _allowed(F.col("role"), F.lit(END)).alias("may_end"), F.array(*each).alias("segments"))


class _Reader:
    """Reads formatted text piece by piece; holds the turn that is open and running digests."""

    TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + "\n", re.S)

    def __init__(self) -> None:
        self.open, self.masked = "", ""
        self.n = self.loss = self.chars = 0
        self.turns, self.learnt = sha256(), sha256()
        self.valid = True

    def feed(self, text: str, loss: bool) -> None:
        self.open += text
        self.chars += len(text)
        if loss:
            self.masked += text

    def close_turn(self) -> None:
        """All whole turns of the text so far are read back."""
        at = 0
        for m in self.TURN.finditer(self.open):
            if m.start() != at:
                break
            at = m.end()
            self.n += 1
            self.turns.update((unescape_role(m[1]) + "\n" + unescape(m[2]) + "\n").encode())
        if at != len(self.open):
            raise ValueError("the formatted text does not read back as turns")
        plain = unescape(self.masked)
        self.loss += len(plain)
        self.learnt.update(plain.encode())
        self.open = self.masked = ""

    def row(self, valid: bool) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars, valid


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the segments' texts alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid``. A digest
    needs a conversation's turns in order, so they are sorted inside a partition by conversation and
    streamed; memory holds one turn.
    """
    rows = (formatted.select("conv_id", "turn", "role", "text", "legal", "may_end", "segments")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "legal", "may_end", F.col("segments.text").alias("texts"), F.col("segments.loss").alias("losses")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv, ended, done, id_type = None, None, False, [], None

        def flush():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names)

        for batch in batches:
            id_type = batch["conv_id"].type
            for c, legal, may_end, texts, losses in zip(*[batch[n].to_pylist() for n in ("conv_id", "legal", "may_end", "texts", "losses")]):
                if reader is None or c != conv:
                    if reader is not None:
                        done.append((conv, *reader.row(reader.valid and ended)))
                    reader, conv = _Reader(), c
                for text, loss in zip(texts, losses):
                    reader.feed(text, loss)
                reader.close_turn()
                reader.valid &= legal
                ended = may_end
            if len(done) >= 4096:
                yield flush()
                done = []
        if reader is not None:
            done.append((conv, *reader.row(reader.valid and ended)))
        if done:
            yield flush()

    schema = (f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, valid boolean")
    return rows.mapInArrow(work, schema)
