import datetime
import random

import pytest

from leasemill.llm import pii

KEY = b"a key"


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000, 73_049])
def test_permutation(size):
    p = pii.Permutation(KEY, "t", size)
    images = [p.forward(x) for x in range(min(size, 2000))]
    assert len(set(images)) == len(images) and all(0 <= x < size for x in images)
    assert [p.backward(x) for x in images] == list(range(len(images)))


VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111"],
    "account": ["4111111111111112", "12345678901234567"],
    "iban": ["GB82WEST12345698765432", "DE89370400440532013000"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "+33 612 34 56 78"],
    "ip": ["10.0.0.1", "255.255.255.255"],
    "date": ["1980-02-29", "31.12.1999", "02/29/1980", "31/12/2001"],
    "email": ["a.b-c9@mail7.example.com", "é.1@x.org"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"],
}


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_format_and_way_back(kind, value):
    assert pii.find(f"so {value}, yes") == [(kind, 3, 3 + len(value))]
    made = pii.Pseudonyms(KEY).change(kind, value)
    assert made != value and [k for k, _, _ in pii.find(f"so {made}, yes")] == [kind]
    assert kind == "ip" or (len(made) == len(value) and all(a.isdigit() == b.isdigit() or kind == "secret" for a, b in zip(made, value)))
    assert pii.Pseudonyms(KEY).change(kind, made, back=True) == value
    assert pii.Pseudonyms(b"other").change(kind, value) != made


FORMS = {
    "card": ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904", "41 1111 11111 111 11", "4111-1111 1111-1111", "6212 3456 7890 0000 003", "4222222222222"],
    "account": ["6212 3456 7890 1234 567", "1234 5678 9012 3456"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00", "NL91 ABNA 0417 1643 00"],
    "phone": ["(017) 555-7713", "017-555-7713", "017.555.7713", "1-800-555-7713", "020 7946 0958", "(0171) 1234567", "0171/1234567", "06 12 34 56 78"],
    "date": ["5.3.2021", "3/5/2021", "13/5/2021", "05/3/2021", "2021-3-5", "5.12.2021"],
    "secret": ["0f" * 64 + "a", "0f" * 300, "0123aBcD" * 8, "abcdefab" * 4, "ABCDEFab" * 20 + "7", "7" * 5000],
}


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in FORMS.items() for v in vs])
@pytest.mark.parametrize("text", ["so {}, yes", "{} AND 7 more", "{}"])
def test_every_form_and_way_back(kind, value, text):
    before = text.index("{")
    if kind in ("card", "account") and "7 more" in text:
        text = text.replace(" AND 7", " and seven")
    p = pii.Pseudonyms(KEY)
    made, found = p.text(text.format(value))
    assert found == [(kind, before, before + len(value))] and made != text.format(value) and len(made) == len(text.format(value))
    assert p.reveal(made) == text.format(value)
    written = made[before : before + len(value)]
    assert kind == "secret" or [c.isalnum() for c in written] == [c.isalnum() for c in value]


def test_grouping_plays_no_part():
    change = pii.Pseudonyms(KEY).change
    for kind, *forms in (("iban", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"), ("card", "378282246310005", "3782 822463 10005", "3782-822463-10005"),
                         ("card", "4111111111111111", "4111-1111-1111-1111"), ("phone", "0175557713", "(017) 555-7713", "017.555.7713")):
        assert len({pii._plain(change(kind, v)).translate(str.maketrans("", "", "().")) for v in forms if kind != "phone" or v != forms[0]}) == 1


def test_neighbours_stay_apart():
    p = pii.Pseudonyms(KEY)
    rng = random.Random(5)
    card = p.change("card", "4111111111111111")
    for text, whole in (("4111 1111 1111 1111 123", "4111 1111 1111 1111"), ("3782 822463 10005 12", "3782 822463 10005"), ("DE89 3704 0044 0532 0130 00 12 AB", "DE89 3704 0044 0532 0130 00"),
                        ("020 7946 0958 2 times", "020 7946 0958"), ("5 4111111111111111 7", "4111111111111111")):
        assert [text[a:b] for _, a, b in pii.find(text)] == [whole]
    assert pii._plain(p.text("4111 1111 1111 1111 123")[0]) == card + "123"
    for _ in range(2000):
        sizes = rng.choices([1, 2, 3, 4, 4, 4, 5, 6, 13, 16], k=rng.randrange(1, 8))
        text = "".join("".join(rng.choices("0123456789", k=n)) + rng.choice("  -") for n in sizes) + "x"
        made, found = p.text(text)
        assert p.reveal(made) == text and [(k, a, b) for k, a, b in pii.find(made)] == found
    for clean in ("1 2 3 4 5 6 7 8 9 10 11 12", "31.13.2021", "1.2.3.2021x", "12 345", "DE89 3704 0044 0532 0130 01"[:20], "0f" * 15):
        assert pii.find(clean) == []


def test_checks():
    assert pii.luhn_digit("7992739871") == 3
    for clean in ("version 2.0.", "1980-02-30", "999.1.1.1", "000-12-3456", "GB82WEST12345698765431", "12345", "a@b", "1.2.3.4.5", "x" * 5000 + "@", "@" * 2000):
        assert pii.find(clean) == []


def test_dates_stay_dates():
    rng = random.Random(1)
    p = pii.Pseudonyms(KEY)
    days = {f"{datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(20_000))}" for _ in range(300)}
    made = {p.change("date", d) for d in days}
    assert len(made) == len(days) and all(datetime.date.fromisoformat(d) for d in made)


def test_texts(documents):
    text = "call +1 (017) 555-7713 or 4111111111111111!! mail q.7@mail.example.com. Done 4111111111111111"
    docs = documents([(1, text), (2, "x 4111111111111111"), (3, None), (4, ""), (5, "clean 12 text"), (6, "7" * 100_000)], "found")
    got = {r[0]: r[1] for r in docs.select("doc_id", pii.pseudonymise(docs, KEY).alias("f")).collect()}
    card = got[2]["text"].split()[-1]
    assert got[1]["text"].count(card) == 2 and "4111111111111111" not in got[1]["text"] and [f["kind"] for f in got[1]["found"]] == ["phone", "card", "email", "card"]
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "clean 12 text" and not got[5]["found"]
    assert pii.Pseudonyms(KEY).reveal(got[1]["text"]) == text
    empty = documents([])
    assert empty.select(pii.pseudonymise(empty, KEY)).count() == 0
