"""Contexts and values that the guess cost alone decides."""

import pytest

from grainmill.llm import secrets


def found(text):
    return [text[a:b] for a, b in secrets.guess_spans(text, secrets.base_spans(text))]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("pwd=QxZvKpLmWtRbNcYs", "QxZvKpLmWtRbNcYs"),
        ("db passphrase: kqzvwxjmptrbncys", "kqzvwxjmptrbncys"),
        ("postgres://u:QxZvKpLmWtRbNcYs@db/x", "QxZvKpLmWtRbNcYs"),
        ("redis://:9fQ2mZ8xKd7@host", "9fQ2mZ8xKd7"),
        (f"https://{'u' * 90}:9fQ2mZ8xKd7@host", "9fQ2mZ8xKd7"),
        ("SECRET_KEY = 'xK9mQ2vL7pR4zT8w'", "xK9mQ2vL7pR4zT8w"),
        ("secretKey: xK9mQ2vL7pR4zT8w", "xK9mQ2vL7pR4zT8w"),
        ("AUTH_TOKEN_2=kqzvwxjmptrbncys", "kqzvwxjmptrbncys"),
        ("The passcode is: xK9mQ2vL7pR4zT8w.", "xK9mQ2vL7pR4zT8w"),
        ("the passcode is kqzvwxjmptrbncys", "kqzvwxjmptrbncys"),
        ("passcode xK9mQ2vL7pR4zT8w", "xK9mQ2vL7pR4zT8w"),
    ],
)
def test_costly_values_are_found(text, value):
    assert secrets.guess_cost(value) >= secrets.MIN_GUESSES and found(text) == [value]


@pytest.mark.parametrize("text", ["token classification", "pwd: sunshine", "pwd=passwordpassword", "redis://:monkey@host", "https://host:8080/a@b", "secretary: xK9mQ2vL7pR4zT8w"])
def test_cheap_values_and_prose_give_none(text):
    assert found(text) == []


def test_long_texts_take_linear_time():
    assert found("://" + "a" * 300_000 + " " + "secret" * 50_000 + "://:" + "b" * 300_000) == []
