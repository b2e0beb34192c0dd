"""Values in credential contexts: short ones, ones of words, long ones, and prose that is none."""

import math
import random
import time

import pytest


@pytest.mark.parametrize("text", ["pwd: K#9x!Qz", "pwd: Zx9#q!7", "password is correcthorsebatterystaple", "pass: kalimeronorabitelu", "passphrase: tinfoilmangorivetclasp", "passphrase is correct-horse-battery-staple"])
def test_found(text):
    from quire.llm.secret_scan import masked, spans_of

    value = text.split(" ")[-1]
    assert ("guess", len(text) - len(value), len(text)) in spans_of(text) and masked(text).endswith("[SECRET]")


@pytest.mark.parametrize(
    "text",
    [
        "The password is case-sensitive.", "the password is thereafter", "your password is required, your passphrase is unconditional", "The passcode is four-digit", "pass: ${DB_PASSWORD}", "pwd: {{ secret }} %PASSWORD%",
        "pwd: $PASSWORD", "passphrase: your_password_here", "pwd: ********", "pwd: 20240131", "pwd: qwertyuiop", "The secret is Constantinople.", "The login is straightforward/easy.", "Bearer: Donaudampfschifffahrt.", "pass: password2024",
    ],
)
def test_left_alone(text):
    from quire.llm.secret_scan import added_spans

    assert added_spans(text, text.lower(), [], 8.0) == []


@pytest.mark.parametrize("value", ["qwertyuiop" * 10_000, "a" * 100_000, "qwe" * 33_000, "x7G#" * 25_000, "password" * 12_500, "kalimero" * 12_500, "20240131" * 12_500])
def test_long_values_in_linear_time(value):
    from quire.llm.secret_scan import spans_of

    began = time.process_time()
    spans_of("pwd: " + value)
    assert time.process_time() - began < 2.5


def test_cost_of_a_limit():
    """The limit changes no cost below it, and the program finds the cheapest of all segmentations that are tried."""
    from quire.llm.secret_scan import guess_cost

    r = random.Random(5)
    pieces = ["password", "2024", "aaaa", "qwer", "kalimero", "x", "7", "#", "-", "Summer", "zQv"]
    for _ in range(300):
        value = "".join(r.choice(pieces) for _ in range(r.randint(0, 6)))
        cost = guess_cost(value)
        assert math.isfinite(cost)
        for limit in (2.0, 8.0, 20.0):
            assert guess_cost(value, enough=limit) == pytest.approx(min(cost, limit))
