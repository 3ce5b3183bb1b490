"""Operators drop nothing that their contract keeps."""

from __future__ import annotations

import json

from chronofold.llm import chat_format, html_extraction


def test_elements_that_only_start_like_raw_ones_hide_nothing():
    text = lambda page: " ".join(b.text for b in html_extraction.blocks(page))
    for tag in ("svg-icon", "title-bar", "select-box", "object-view", "script-x", "style-y", "template-z"):
        assert text(f"<p>One <{tag}></{tag}> two</p><p>Three</p>") == "One two Three"
        assert text(f"<p>One <{tag} a='b'/> two</p><p>Three</p>") == "One two Three"
    for tag in ("svg", "object", "noscript", "template", "select", "iframe"):
        assert text(f"<p>One</p><{tag} a='b'><p>Two</p><p>Three</p>") == "One Two Three"
        assert text(f"<p>One</p><{tag} a='x>y'>hidden</{tag} ><p>Two</p>") == text(f"<p>One</p><{tag.upper()}>hidden</{tag}><p>Two</p>") == "One Two"
    assert text("<p>One<svg/> two</p><p>Three <svg><title>x</title></svg></p>") == "One two Three"
    for tag in ("script", "style", "textarea", "title"):
        assert text(f"<p>One</p><{tag}>hidden <p>hidden") == "One"


def test_formulas_are_text():
    assert [b.text for b in html_extraction.blocks("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p></article>")] == ["Let x=2 hold"]


def test_calls_without_an_identifier_are_kept(spark):
    call = lambda *cs: json.dumps({"tool_calls": list(cs)})
    ok, bare, null = {"id": "a", "name": "search", "arguments": {"query": "x"}}, {"name": "fetch", "arguments": {"url": "u"}}, {"id": None, "name": "nope", "arguments": {}}
    rows = [(1, 0, "assistant", call(ok, bare)), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "y"})), (2, 0, "assistant", call(null, bare)), (3, 0, "assistant", call(ok, ok))]
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0].n_calls, got[1, 0].errors) == (2, "missing_id")
    assert got[1, 0].json == '{"conv_id":1,"role":"assistant","tool_calls":[{"arguments":{"query":"x"},"id":"a","name":"search"},{"arguments":{"url":"u"},"name":"fetch"}],"turn":0}'
    assert (got[1, 1].linked_turn, got[1, 1].errors) == (0, "")
    assert (got[2, 0].n_calls, got[2, 0].errors) == (2, "missing_id,unknown_tool")
    assert got[3, 0].errors == "duplicate_id,unanswered" and len(got) == len(rows)
