"""Chat formatting: exact round trips through ids and through text."""

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from fernweft.llm.chat import CONTROLS, Template, format_conversations
from fernweft.llm.queries import op5

PIECE = st.one_of(st.sampled_from([*CONTROLS, "\\", "<|im_start|>", "</", "s>", "[", "INST]", " ", "\n"]), st.text(max_size=8))
TEXT = st.lists(PIECE, max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT), TEXT), max_size=6)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_escape_hides_control_strings_and_is_undone(text):
    template = Template()
    escaped = template.escape(text)
    assert template.unescape(escaped) == text
    assert not [c for c in (*CONTROLS, *template.foreign) if c in escaped]


@given(TURNS)
@settings(max_examples=200, deadline=None)
def test_conversations_read_back(turns):
    template = Template()
    ids, mask, formatted = template.assemble(turns)
    back, learned = template.read(ids, mask)
    assert back == turns
    assert "".join(learned) == "".join(t for r, t in turns if r == "assistant")
    assert len(ids) == len(mask)
    reserved = np.flatnonzero(ids >= template.first_reserved)
    assert not mask[reserved].any(), "control tokens carry no loss"
    assert len(reserved) == sum(formatted.count(c) for c in CONTROLS), "the text shows the controls that were spliced, no others"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_on_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in op5.query(spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        turns = sorted(r for r in rows if r[0] == conv)
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(turns), len(loss), sha(loss))
        assert row.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns))
        assert row.formatted_chars >= sum(len(r[3]) for r in turns)


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, 0, "user", "x", 1), (1, 2, "assistant", None, 1), (1, 1, None, "b", 1), (1, 1, None, "b", 1), (1, None, "user", "a" * 100_000, 1), (1, 1, None, "a", 2)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, input_ids int")
    got = {r.conv_id: r for r in format_conversations(turns).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 1, 1: 5}
    back, _ = Template().read(np.array(got[1].input_ids), np.array(got[1].loss_mask))
    assert back == [("user", "a" * 100_000), ("", "a"), ("", "b"), ("", "b"), ("assistant", "")]
    assert format_conversations(turns.limit(0)).count() == 0
