"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered with a template of control strings; control strings inside a role or text are
escaped, so the rendering can be read back. The whole rendering is encoded once with character offsets. The spans of
the turns whose text counts for the loss are sorted, as are the token offsets, and each span finds its tokens by binary
search. The control strings are tokens of their own, so no token crosses the edge of a span.

Turns stream to the formatter sorted by conversation and turn. A conversation longer than ``SEGMENT`` characters is
rendered in several segments of whole turns; as control strings cut the encoding, its tokens and masks are the same,
and memory is bounded by SEGMENT and the longest turn, not by the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 22


@dataclass(frozen=True)
class Template:
    """Control strings around role and text of a turn, and foreign ones that texts must not contain either."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return self.turn, self.text, self.end

    @property
    def pattern(self) -> re.Pattern:
        """A control string, with any backslashes after its first character."""
        names = sorted({*self.controls, *self.foreign}, key=len, reverse=True)
        return re.compile("|".join(re.escape(x[0]) + r"\\*" + re.escape(x[1:]) for x in names))


@cache
def pattern_of(template: Template) -> re.Pattern:
    return template.pattern


def escape(text: str, template: Template) -> str:
    """One more backslash after the first character of every control string, however many it has already."""
    return pattern_of(template).sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str, template: Template) -> str:
    """The inverse of escape."""
    return pattern_of(template).sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the sorted spans of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = template.turn + escape(role, template) + template.text
        body = escape(text, template)
        if role in template.loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, template.end]
        at += len(head) + len(body) + len(template.end)
    return "".join(parts), spans


def parse(formatted: str, template: Template) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns = []
    for part in formatted.split(template.end)[:-1]:
        role, _, text = part.removeprefix(template.turn).partition(template.text)
        turns.append((unescape(role, template), unescape(text, template)))
    return turns


@cache
def tokenizer(path: str, controls: tuple[str, ...]):
    """The tokenizer file, with the control strings as tokens of their own and offsets that leave nothing out."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    if isinstance(loaded.pre_tokenizer, pre_tokenizers.ByteLevel):
        loaded.post_processor = processors.ByteLevel(trim_offsets=False)
    loaded.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in controls])
    return loaded


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that lie in a span. offsets: sorted (start, end) rows; spans: sorted and disjoint."""
    mask = np.zeros(len(offsets), dtype=bool)
    for start, end in spans:
        if end > start:
            mask[np.searchsorted(offsets[:, 0], start, "left") : np.searchsorted(offsets[:, 1], end, "right")] = True
    return mask


def runs(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the unbroken runs of masked tokens."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in zip(edges[::2], edges[1::2])]


FORMATTED = "conv_id long, segment int, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(rows: DataFrame, path: str, template: Template = Template()) -> DataFrame:
    """One row for each segment of a conversation: its text, token ids, token offsets and loss mask.

    rows: conv_id (long), turn, role, text. Turns are ordered by turn, ties by role and text; null ones come first. A
    null role or text is empty; rows with a null conv_id make one conversation. Repeated rows are repeated turns. An
    empty table has no segment. Other columns are left out. The result is sorted by conversation and segment in each
    partition, and all segments of a conversation are in one.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = tokenizer(path, template.controls)
        held: list[tuple[str, str]] = []
        state = {"conv": None, "segment": 0, "chars": 0, "open": False}

        def flush() -> pa.RecordBatch:
            formatted, spans = render(held, template)
            coded = loaded.encode(formatted, add_special_tokens=False)
            offsets = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
            out = {"conv_id": pa.array([state["conv"]], pa.int64()), "segment": pa.array([state["segment"]], pa.int32()), "formatted": [formatted], "input_ids": pa.array([coded.ids], pa.list_(pa.int32()))}
            out |= {"token_starts": pa.array([offsets[:, 0]], pa.list_(pa.int32())), "token_ends": pa.array([offsets[:, 1]], pa.list_(pa.int32())), "loss_mask": pa.array([mask_tokens(offsets, spans)], pa.list_(pa.bool_()))}
            held.clear()
            state.update(segment=state["segment"] + 1, chars=0)
            return pa.RecordBatch.from_pydict(out)

        for batch in it:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if state["open"] and (conv != state["conv"] or state["chars"] >= SEGMENT):
                    yield flush()
                if not state["open"] or conv != state["conv"]:
                    state.update(conv=conv, segment=0, open=True)
                held.append((role or "", text or ""))
                state["chars"] += len(text or "")
        if held:
            yield flush()

    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted segments say when read back, one row for each conversation.

    Takes the result of format_conversations as it is partitioned and sorted: the turns are parsed from the text, the
    loss text is cut out along the masked tokens' offsets and unescaped.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums, begun = None, None, False
        names = [x.split()[0] for x in DIGESTS.split(", ")]

        def result() -> pa.RecordBatch:
            turns, loss = sums["turns"].hexdigest(), sums["loss"].hexdigest()
            values = [conv, sums["n"], turns, sums["loss_chars"], loss, sums["chars"], sums["tokens"], sums["masked"]]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if "sha" in n else pa.int64()) for n, v in zip(names, values)], names=names)

        for batch in it:
            for i in range(batch.num_rows):
                row = {n: batch.column(n).slice(i, 1) for n in batch.schema.names}
                name = row["conv_id"][0].as_py()
                if begun and name != conv:
                    yield result()
                if not begun or name != conv:
                    conv, begun = name, True
                    sums = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "tokens": 0, "masked": 0}
                text = row["formatted"][0].as_py()
                for role, said in parse(text, template):
                    sums["turns"].update(f"{role}\n{said}\n".encode())
                    sums["n"] += 1
                mask = np.array(row["loss_mask"][0].as_py(), dtype=bool)
                offsets = np.stack([row[n].values[row[n].offsets[0].as_py() : row[n].offsets[1].as_py()].to_numpy() for n in ("token_starts", "token_ends")], axis=1)
                for start, end in runs(offsets, mask):
                    said = unescape(text[start:end], template)
                    sums["loss"].update(said.encode())
                    sums["loss_chars"] += len(said)
                sums["chars"] += len(text)
                sums["tokens"] += len(mask)
                sums["masked"] += int(mask.sum())
        if begun:
            yield result()

    return formatted.mapInArrow(run, DIGESTS)


def op1_chat_format(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """conversations and a made one, -1, whose texts hold foreign control strings; digests of what is read back."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    made = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digest(format_conversations(rows.unionAll(made), path)).drop("n_tokens", "loss_tokens")


def escaped_sql(c: str) -> str:
    """escape for the default template, in DuckDB's SQL."""
    template = Template()
    for first in "<[":
        rest = "|".join(re.escape(x[1:]) for x in (*template.controls, *template.foreign) if x[0] == first)
        c = f"regexp_replace({c}, '({re.escape(first)})(\\\\*(?:{rest}))', '\\1\\\\\\2', 'g')"
    return c


QUERIES = {"op1_chat_format": op1_chat_format}
SQL = {
    "op1_chat_format": f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len("<|turn|><|text|><|end|>")} + length({escaped_sql("role")}) + length({escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
}
