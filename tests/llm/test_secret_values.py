"""Every value in a credential context is scored whole, whatever its characters; prose is not taken."""

import random
import string

import pytest

from quantloom.llm import secrets, token_files

WORDS = secrets.known_words(token_files.vocabulary_path())


def scan(text):
    return secrets.scan(text, WORDS)


@pytest.mark.parametrize("text, value", [
    ("pwd: qzxvjkwpmtrb", "qzxvjkwpmtrb"), ("passphrase=XkqVzBwJmPlR", "XkqVzBwJmPlR"), ("auth: 839201748362 ", "839201748362"), ('pwd="a8$K,9z!QmT"', "a8$K,9z!QmT"), ('pwd="a8$Kq7x,9z!QmT", b', "a8$Kq7x,9z!QmT"),
    ("pass: 'k9;<z>Q\"mT4' x", "k9;<z>Q\"mT4"), ('pwd="a8 $K 9z!QmT"', "a8 $K 9z!QmT"), ('{"pwd": "a8$K\\"9z!QmT"}', 'a8$K\\"9z!QmT'),
])
def test_value_is_taken_whole(text, value):
    at = text.index(value)
    assert scan(text) == [("guess", at, at + len(value))]


def test_value_whose_head_is_a_base_match():
    text = "ü password=Ab3dEf6hIj9k$Lm0nOp!Qr end"
    assert [k for k, *_ in scan(text)] == ["assign", "guess"]
    assert secrets.hide(text, scan(text), "[secret]") == "ü [secret] end"
    assert [k for k, *_ in scan("password=Ab3dEf6hIj9kLm0nOpQr")] == ["assign"]


@pytest.mark.parametrize("text", ["secret: something", "Auth: Understanding", "login: getUserToken", "TOKEN: REQUIRED", "auth: Verschlüsselung", "pass: información", 'secret: "this is a plain sentence, with 2 of them"', "login: rythm, really", "pwd: aaaaaaaaaaaa", "pass: 123456789", "login: straightforward", "pass: Rechtsschutzversicherung", "secret: quelquefois"])
def test_prose_is_not(text):
    assert scan(text) == []


def test_few_random_runs_spell_like_words():
    r = random.Random(1)
    missed = sum(secrets.prose("".join(r.choices(string.ascii_lowercase, k=12)).encode()) for _ in range(5000)) / 5000
    assert missed < 0.05


def test_words_of_the_vocabulary_are_cheap():
    assert len(WORDS.rank) > 20_000 and WORDS.rank["password"] == 1
    few = secrets.Words()
    for phrase in ("correcthorsebattery", "purchasedepartment"):
        assert secrets.guess_cost(phrase, WORDS)[0] < secrets.guess_cost(phrase, few)[0] - 5
        assert {k for k, _ in secrets.guess_cost(phrase, WORDS)[1]} == {"word"}


def test_many_matches_take_linear_time():
    import time

    def seconds(n):
        text = " ".join(f"password={i:014d}x pwd=Ab{i}" for i in range(n))
        began = time.perf_counter()
        assert sum(k == "assign" for k, *_ in scan(text)) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8000) < 12 * seconds(1000) + 0.5
