"""Template language and chat formatting."""

import hashlib

import pytest

from quarrylens.llm import chat


def test_language():
    render = chat.compiled("{% if 'a' ~ 'b' == 'ab' %}yes{% else %}no{% endif %}:{% for turn in turns %}"
                           "{% if loop.first and not loop.last %}[{% endif %}{{ turn.role | upper }}"
                           "{% generation %}{{ turn.text | trim }}{% endgeneration %}{% if loop.last %}]{% endif %}{% endfor %}")
    assert render([("u", " x "), ("v", "y")]) == ("yes:[UxVy]", [(6, 7), (8, 9)])
    assert render([]) == ("yes:", [])


def test_constants_are_folded():
    tree = chat.fold(chat.parse("{{ 'a' ~ 'b' | upper }}c{% if 'x' == 'y' %}gone{% else %}{{ 'd' }}{% endif %}{{ turn.role }}"))
    assert tree == ("block", [("text", "aBcd"), ("out", ("name", "turn.role"))])


@pytest.mark.parametrize("bad", [
    "{{ turn.__class__ }}", "{{ open('x') }}", "{% import os %}", "{{ turn.text | eval }}", "{% if turn.role %}", "{{ 1 + }}",
    "{% for x in turns %}{% endfor %}", "{% endif %}", "{{ 'a' "" | }}", "{{ }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compiled(bad)


@pytest.mark.parametrize("text", ["", "\\", "\\l", "</turn>\n<turn role=x>\n", "\\### Assistant: </turn> ok", "a\\\\<b>\\g", "é文\n"])
def test_round_trip(text):
    turns = [("user", text), ("assistant", text), (text, "x")]
    made, spans = chat.compiled(chat.TEMPLATE)(turns)
    assert chat.read_back(made) == turns
    assert [chat.unescape(made[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_report(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>"), (1, 1, "assistant", "</turn>"), (2, None, None, None),
            (None, 0, "assistant", "x" * 50_000), (1, 3, "assistant", "end"), (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows],
                               "conv_id bigint, turn int, role string, text string, formatted string, spans int")
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        made, _ = chat.compiled(chat.TEMPLATE)([(r, t) for _, r, t in own])
        assert tuple(got[conv])[1:] == (
            len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(made))
    assert chat.chat_report(df.limit(0)).count() == 0


def test_long_conversations_go_in_pieces(spark):
    """No piece is longer than the bound and one turn; joined, pieces and spans are those of the whole conversation."""
    rows = [(None if i % 3 == 0 else i % 2, i, ("user", "assistant")[i % 5 % 2], f"<t{i}> é" * (i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    whole = {r.conv_id: (r.formatted, r.spans) for r in chat.formatted_conversations(df).collect()}
    pieces = sorted(chat.formatted_pieces(df, most=500).collect(), key=lambda r: (str(r.conv_id), r.piece))
    assert max(len(r.formatted) for r in pieces) < 600
    for conv, (text, spans) in whole.items():
        own = [r for r in pieces if r.conv_id == conv]
        assert [r.piece for r in own] == list(range(len(own))) and len(own) > 10
        assert "".join(r.formatted for r in own) == text and [s for r in own for s in r.spans] == spans
        assert all(text[r.start:r.start + len(r.formatted)] == r.formatted for r in own)
    assert sorted(chat.chat_report(df, most=500).collect(), key=str) == sorted(chat.chat_report(df).collect(), key=str)
    with pytest.raises(chat.TemplateError):
        chat.formatted_pieces(df, "head {% for turn in turns %}{{ turn.text }}{% endfor %}")
