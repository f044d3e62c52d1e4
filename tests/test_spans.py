import random
import time

import pytest

from sievelight.operators.builtin import with_builtin_hits
from sievelight.operators.rewrite import neutralize_spans, spans, splice


def brute(text, values):
    """Marks every character under a place of a value that is a word of its own."""
    word = lambda c: c == "_" or c.isalnum()
    marked = [False] * len(text)
    for v in values:
        for i in range(len(text) - len(v) + 1):
            before = i and word(text[i - 1]) and word(v[0])
            after = i + len(v) < len(text) and word(text[i + len(v)]) and word(v[-1])
            if text[i : i + len(v)] == v and not before and not after:
                marked[i : i + len(v)] = [True] * len(v)
    return marked


@pytest.mark.parametrize("seed", range(30))
def test_all_places_against_brute_force(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab é.1") for _ in range(rng.randint(0, 80)))
    values = {"".join(rng.choice("ab é.1") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))}
    under = [False] * len(text)
    for s, e, _ in spans(text, dict.fromkeys(values, "?")):
        under[s:e] = [True] * (e - s)
    assert under == brute(text, values)
    done, n = splice(text, dict.fromkeys(values, "?" * 9))
    assert (n == 0) == (done == text) == (not any(under))


def test_union_takes_the_covering_form_or_stars():
    email = {"bob@mail.org": "bob***@mail.org", "bob": "***"}
    assert splice("to bob@mail.org, bob", email) == ("to bob@mail.org, bob".replace("bob@mail.org", "*" * 12).replace(", bob", ", ***"), 2)
    assert splice("x 12-34-56 y", {"12-34": "1****", "34-56": "****6"}) == ("x ******** y", 1)
    assert splice("ab cd", {"ab": "<ab>", " cd": "_"}) == ("<ab>_", 2)  # they touch, but do not overlap
    assert splice("", {"a": "*"}) == ("", 0) and splice("a", {}) == ("a", 0)


def test_no_value_stays_in_clear(texts):
    cards = ["4539 1488 0343 6467", "5425-2334-3010-9903", "378282246310005", "4539148803436467"]
    df = texts(
        *[f"card {c} x\n{c}" for c in cards],
        "user id: bob.dylan7@mail.org and bob.dylan7",
        "user id: abcdef9 and zabcdef9z abcdef9",
        "password: s3cret-word, s3cret-word!",
        "nothing here",
        None,
        "",
    )
    got = {r.id: r for r in neutralize_spans(with_builtin_hits(df)).collect()}
    for i, c in enumerate(cards):
        assert c not in got[i].redacted_text and c[-6:] not in got[i].redacted_text and got[i].replaced_total == 2
    assert "bob.dylan7" not in got[4].redacted_text
    assert "zabcdef9z" in got[5].redacted_text and " abcdef9" not in got[5].redacted_text and got[5].replaced_total == 2
    assert "s3cret" not in got[6].redacted_text and got[6].replaced_total == 2
    assert [(got[i].redacted_text, got[i].replaced_total) for i in (7, 8, 9)] == [("nothing here", 0), (None, 0), ("", 0)]


def test_work_is_linear_in_text_and_values():
    took = []
    for n in (2_000, 20_000):
        values = {f"user{i}@mail{i}.org": "***" for i in range(n)}
        text = " ".join([*values] * 2)
        start = time.perf_counter()
        done, count = splice(text, values)
        took.append(time.perf_counter() - start)
        assert "user" not in done and count == 2 * n
    assert took[1] < 60 * max(took[0], 0.01)
