"""Whole values of any length and alphabet; prose beside sensitive keys stays."""

import random
import string

import pytest

from loomgraph.llm import secrets

RNG = random.Random(31)
MANY = "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(6000))
JUDGE = secrets.Judge(secrets.SEED.encode())


@pytest.mark.parametrize(
    ("text", "value"),
    [
        (f'token = "{MANY}" x', MANY),
        (f"token = {MANY} x", MANY),
        (f"see ghp_{MANY} x", f"ghp_{MANY}"),
        ("password: Tr0ub4dor&3!xK%9q x", "Tr0ub4dor&3!xK%9q"),
        ('secret = "kX9 vQ2#zz 81Lm@p" x', "kX9 vQ2#zz 81Lm@p"),
        ('password = "qzvkxjwplmtrbndghs" x', "qzvkxjwplmtrbndghs"),
        ("auth_token=839201746520918374 x", "839201746520918374"),
        ('api_key = "a8Kd2\\"mZ0pQ7r" x', 'a8Kd2\\"mZ0pQ7r'),
        (f"(token={MANY[:40]}), x", MANY[:40]),
    ],
)
def test_whole_value_is_redacted(text, value):
    assert value in text and JUDGE.redact(text) == text.replace(value, secrets.REDACTED)


def test_value_cut_by_the_surroundings_edge_stays_novel():
    value = MANY[:40]
    text = f'token = "{value}" {"a " * 66}token = "{value}"'
    assert JUDGE.redact(text).count(secrets.REDACTED) == 2


@pytest.mark.parametrize("text", ["the secret ingredient is characteristically simple", 'password: "please enter your new password here"', "password = configuration", "author: Konstantinopolous", "token = authentication", "token = changeme"])
def test_prose_stays(text):
    assert JUDGE.redact(text) == text
