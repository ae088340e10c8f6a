"""Secrets in assignments without a space, in URL parameters, in long runs and beside pattern spans."""

import pytest

from cairnlog.llm import secrets

KEY = "Zk3vQ9xT7mB2wL8pR4sN6cY1"
LETTERS = "wJalrXUtnFEMIKbPxRfiCYqZvT"


@pytest.mark.parametrize("name", ["aws_secret_access_key", "PRIVATE_KEY", "SIGNING_KEY", "session_id", "auth", "a_secret_of_a_very_long_name_which_goes_on_for_over_forty_eight_characters"])
@pytest.mark.parametrize("before", ["", "export ", "https://host.example/in?x=1&", "https://host.example/in?"])
@pytest.mark.parametrize("value", [KEY, KEY + "==", LETTERS])
def test_values_of_sensitive_names(name, before, value):
    text = f"{before}{name}={value}\nthe next line"
    at = len(before) + len(name) + 1
    assert secrets.spans(text, secrets.Novelty()) == [(at, 3, at + len(value))]
    assert secrets.redacted(text, secrets.spans(text, secrets.Novelty())) == f"{before}{name}=[SECRET]\nthe next line"


def test_values_of_other_names_and_plain_words():
    n = secrets.Novelty()
    assert secrets.spans(f"colour_of_the_table={KEY}", n) == []
    assert secrets.spans("PRIVATE_KEY=----------------------------", n) == []
    assert secrets.spans("the session was about internationalization and more", n) == []
    assert secrets.spans("session_id=short1", n) == []


def test_parts():
    assert secrets.parts("a=b") == [(0, 0, 1), (0, 2, 3)]
    assert secrets.parts("=ab==") == [(1, 1, 5)]
    assert secrets.parts("n=ab==cd=") == [(0, 0, 1), (0, 2, 4), (2, 6, 9)]
    assert secrets.parts("====") == []


def test_long_runs_and_partly_covered_keys():
    import random

    n, rng = secrets.Novelty(), random.Random(7)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(8192))
    assert secrets.novel_spans("the secret " + "A" * 8192 + noise, [], n) == [(11 + 8192, 3, 11 + 16384)]
    assert secrets.novel_spans("the secret " + noise + "A" * 8192, [], n) == [(11, 3, 11 + 8192)]
    text = "the bearer is Zk3vQ9xT7m" + "0a1b2c3d4e5f60718293a4b5" + "R4sN6cY1Wq"
    got = secrets.spans(text, n)
    assert got == [(14, 3, 24), (24, 2, 48), (48, 3, 58)]
    assert secrets.redacted(text, got).startswith("the bearer is [SECRET]") and "R4sN" not in secrets.redacted(text, got)
    assert secrets.uncovered(0, 10, [(0, 3), (5, 12)]) == [(3, 5)] and secrets.uncovered(2, 4, [(0, 9)]) == []


FORMATS = (
    "export SESSION_KEY={}",
    "cookie={}",
    "Authorization: Bearer {}",
    'auth_key: "{}"',
    "https://api.example/v1/items?access_token_id=7&signature={}&page=2",
    "-H 'x-credential: {}'",
    "{} is the pass phrase of the session on that host",
    "the private one is {} as of today",
    "    private_key = '{}'",
    "db.connect(user='me', pwd='{}')",
)


def planted(seed, n=400):
    """(text, start, end) of random keys in prose and code, in forms that the base patterns do not take."""
    import random
    import string

    rng = random.Random(seed)
    prose = "the report of the month was sent to all who had asked for it and nobody found anything to say about it".split()
    for k in range(n):
        letters = string.ascii_letters + (string.digits if k % 4 else "")
        key = "".join(rng.choice(letters) for _ in range(rng.randrange(20, 45)))
        before = " ".join(rng.choice(prose) for _ in range(30)) + "\n"
        form = FORMATS[k % len(FORMATS)]
        at = len(before) + form.index("{}")
        yield before + form.format(key) + "\n" + before, at, at + len(key)


def test_recall_of_planted_keys_and_false_reports(spark):
    from pyspark.sql import functions as F

    n = secrets.Novelty()
    found = [any(a <= lo and hi <= b for lo, k, hi in secrets.spans(text, n) if k == 3) for text, a, b in planted(1)]
    missed_by_patterns = [not secrets.base_spans(text) for text, _, _ in planted(1)]
    assert sum(missed_by_patterns) >= 0.95 * len(found)
    assert sum(found) >= 0.9 * len(found), sum(found) / len(found)
    # Words, names and paths beside sensitive words are no keys.
    plain = ["the session was about internationalization and more", "getSessionTokenFromRequest(password_reset_form_handler)", "/usr/share/private/documentation/readme", "see the secret_santa_gift_list_of_two_thousand", "token " + "-" * 40, "the private " + "ab" * 20 + "1"]
    assert [t for t in plain if secrets.novel_spans(t, [], n)] == []
    # Prose of the given documents: false reports, that is novel spans in texts without any planted secret.
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    reports = secrets.scan(docs).select(F.size(F.filter("found", lambda x: x["kind"] == "novel")).alias("n"))
    assert reports.filter("n > 0").count() <= 0.01 * docs.count()


def test_dictionary_is_learnt_from_all_texts(spark):
    rows = [(k, f"{'load_user_thing'[: 8 + k % 8]}(x) and total_price = {k}; {KEY}=1") for k in range(40)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = secrets.identifiers(docs)
    assert learnt[0] == "total_price" and KEY not in learnt and all(len(x) < secrets.LEAST for x in learnt)
    plain, primed = secrets.Novelty(), secrets.Novelty(learnt=learnt)
    text = "secret: load_user_thing_total_price"
    assert primed.bits(text, 8, len(text)) < plain.bits(text, 8, len(text))
