"""Chat formatting by token-level assembly.

Each segment of a turn (role, text) is encoded by itself and reserved ids are
spliced in between, so no merge crosses a border and no content can produce a
reserved id. Running sums of segment lengths give where each segment lies, and
from that the loss mask. Control strings that occur in content are escaped, so
that the formatted text can be told apart and read back as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernweft.llm.vocabulary import FOLDER, byte_bpe

#: Control strings of the template; their ids follow the vocabulary's.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
#: Control strings before and after the text of a role; others are spelled out.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ESCAPE = "\\"
OUT = "conv_id bigint, n_turns bigint, input_ids array<int>, loss_mask array<boolean>, formatted string"


@dataclass(frozen=True)
class Template:
    """``foreign``: further control strings to escape in content, for readers
    that know other templates. ``learned``: roles under the loss mask."""

    vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken"
    first_reserved: int = 50_257
    foreign: tuple[str, ...] = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")
    learned: tuple[str, ...] = ("assistant",)

    @cached_property
    def reserved(self) -> dict[str, int]:
        return {c: self.first_reserved + i for i, c in enumerate(CONTROLS)}

    @cached_property
    def _marks(self) -> re.Pattern[str]:
        strings = sorted({*CONTROLS, *self.foreign}, key=len, reverse=True)
        return re.compile(rf"{re.escape(ESCAPE)}|(?=(?:{'|'.join(map(re.escape, strings))}))")

    @cached_property
    def _signs(self) -> tuple[str, ...]:
        """Characters of which a text needs one for anything to be escaped."""
        return tuple({ESCAPE, *(s[0] for s in (*CONTROLS, *self.foreign))})

    def escape(self, text: str) -> str:
        """Double each escape sign, and put one after the first character of
        each control string, overlapping ones included."""
        if not any(sign in text for sign in self._signs):
            return text
        out, at = [], 0
        for m in self._marks.finditer(text):
            end = m.end() if m.group() else m.start() + 1
            if end > at:
                out += [text[at:end], ESCAPE]
                at = end
        return "".join([*out, text[at:]])

    def unescape(self, text: str) -> str:
        return re.sub(rf"{re.escape(ESCAPE)}(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool, bool]]:
        """Strings of a turn: (string, whether control, whether learned)."""
        body = (self.escape(text), False, role in self.learned)
        if role in TURNS:
            before, after = TURNS[role]
            return [*([(before, True, False)] if before else []), body, (after, True, False)]
        return [("[ROLE]", True, False), (self.escape(role), False, False), ("[/ROLE]", True, False), body, ("[END]", True, False)]

    def assemble(self, turns: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray, str]:
        """Ids, loss mask and formatted text of a conversation. Null roles and
        texts count as empty."""
        encode, reserved = byte_bpe(self.vocabulary).encode_to_numpy, self.reserved
        segments = [("<s>", True, False)]
        for role, text in turns:
            segments += self.segments(role or "", text or "")
        parts = [np.array([reserved[s]]) if control else encode(s, disallowed_special=()) for s, control, _ in segments]
        ends = np.cumsum([len(p) for p in parts])
        change = np.zeros(ends[-1] + 1, np.int8)
        for (_, _, learned), part, end in zip(segments, parts, ends):
            if learned:
                change[end - len(part)] += 1
                change[end] -= 1
        return np.concatenate(parts).astype(np.int32), np.cumsum(change[:-1]) > 0, "".join(s for s, _, _ in segments)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
        """Turns (role, text) and learned texts, read back from the tokens."""
        names = {i: c for c, i in self.reserved.items()}
        opened = {before: role for role, (before, _) in TURNS.items() if before}
        decode = byte_bpe(self.vocabulary).decode_bytes
        turns, learned = [], []
        role, state, start = None, "turn", 0
        for at in np.flatnonzero(ids >= self.first_reserved).tolist():
            control = names[int(ids[at])]
            text = self.unescape(decode(ids[start:at].tolist()).decode("utf-8", "surrogatepass"))
            if control in opened:
                role, state = opened[control], "text"
            elif control == "[ROLE]":
                state = "role"
            elif control == "[/ROLE]":
                role, state = text, "text"
            elif control != "<s>":
                turns.append((role if state == "text" else "assistant", text))
                if at > start and mask[start:at].all():
                    learned.append(text)
                role, state = None, "turn"
            start = at + 1
        return turns, learned


def format_conversations(
    turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each conversation: ``conv_id, n_turns, input_ids, loss_mask``
    (one boolean for each id) and ``formatted``.

    Turns are in order of number, then role, then text, nulls first. Rows with
    a null conversation id form one conversation. Repeated rows are turns of
    their own. Null roles and texts count as empty. An empty table gives no
    rows. Other columns are not read. Rows are shuffled and sorted by
    conversation, and each task assembles one conversation at a time, so its
    memory is bounded by the longest conversation, which is one output row.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")])

    def assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, str | None]] = []
        current, ready = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*columns):
                if held and conv != current:
                    ready.append((current, len(held), *template.assemble(held)))
                    held = []
                current = conv
                held.append((role, text))
            if ready:
                yield packed(ready)
                ready = []
        if held:
            yield packed([(current, len(held), *template.assemble(held))])

    return ordered.mapInArrow(assembled, OUT)


def packed(rows: list[tuple[int | None, int, np.ndarray, np.ndarray, str]]) -> pa.RecordBatch:
    convs, counts, ids, masks, texts = zip(*rows)
    bounds = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(convs, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids), pa.int32())),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(masks), pa.bool_())),
            pa.array(texts, pa.string()),
        ],
        ["conv_id", "n_turns", "input_ids", "loss_mask", "formatted"],
    )
