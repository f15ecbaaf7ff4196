import re

import pytest
from tables import ROWS, awkward

from reliefspark.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": all(int(p) <= 255 for p in hit.split(".")) if kind == "ip" else 0,
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(kind, m.group())]


def spans(docs):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs).collect()}


def test_base_spans_against_plain_patterns(spark):
    texts = [
        "a@b.co%x@d.com .y@z.org a@b a@b. a@b.c_d@e.f", "1.2.3.4.5 256.1.1.1 001.002.003.0255 1.2.3 9.9.9.9", "é漢\U0001f600 4111 1111-1111 1111 and 4111111111111112",
        "0000000000000 5500005555555559x4012888888881881", "+1 (974) 555-3436, +12 34 +999999999999999999 ++4 555 123 4567 8.", "+33 1 23 45 67 89(", "x@" * 50, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
        "@a.b u%%@v-w.x-y.z", "7" * 25, "", "no data here", "10.0.0.1:80 mail me@host.example.org. Card 4012 8888 8888 1881!"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + ROWS
    got = spans(awkward(spark, rows))
    for i, text in rows:
        if i != 7:
            assert [s for s in got[i] if s[0] in pii.BASE] == base(text), text


@pytest.mark.parametrize("text,added", [
    ("our iban DE89 3704 0044 0532 0130 00 today", [("iban", 9, 36)]),
    ("code DE88370400440532013000", []),  # remainder is wrong
    ("my ssn 123-45-6789", [("ssn", 7, 18)]), ("number 123-45-6789", []), ("example ssn 123-45-6789", []),
    ("phone 555-123-4567", [("tel", 6, 18)]), ("part 555-123-4567", []), ("phone +1 555-123-4567", []), ("ssn 9123-45-6789", [])])
def test_checks_and_context(spark, text, added):
    got = spans(awkward(spark, [(1, text)]))[1]
    assert [s for s in got if s[0] in pii.FURTHER] == added


def test_redaction_and_empty_table(spark):
    found = pii.find(awkward(spark, [(1, "write a.b@c.org or +1 974 555 3436 now"), (2, None)]))
    assert {r.doc_id: r.text for r in pii.redacted(found).collect()} == {1: "write [email] or [phone] now", 2: ""}
    assert pii.find(awkward(spark, [])).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    pii.find(awkward(spark)).explain()
    assert "Python" not in capsys.readouterr().out


def iban(country, account):
    rest = 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97
    return f"{country}{rest:02}{account}"


def test_account_numbers_beside_other_tokens_and_cards(spark):
    numbers = [iban("AT", "1904300234573201"), iban("ES", "21000418450200051332"), iban("SE", "50000000058398257466"), iban("PL", "109010140000071219812874"), iban("DE", "370400440532013000"), iban("NO", "86011117947")]
    numbers += [" ".join(n[i:i + 4] for i in range(0, len(n), 4)) for n in numbers]
    rows, want = [], []
    for number in numbers:
        for before, behind in (("", " 250"), ("", " BIC "), ("", " CODE"), ("", ""), ("GB12 ", " X1"), ("paid ", ".")):
            rows.append((len(rows), before + number + behind))
            want.append([("iban", len(before), len(before) + len(number))])
    # the digits of this one pass as a card by chance
    chance = next(n for k in range(1000) for n in [iban("GB", f"NWBK{60161331926000 + k}")] if luhn(n[8:]))
    rows.append((len(rows), f"account {chance} today"))
    want.append([("card", 16, 30), ("iban", 8, 30)])
    found = pii.find(awkward(spark, rows))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert [[s for s in got[i] if s[0] == "iban"] for i, _ in rows[:-1]] == want[:-1]
    assert got[len(rows) - 1] == want[-1]
    assert {r.doc_id: r.text for r in pii.redacted(found).collect()}[len(rows) - 1] == "account [iban] today"


def test_redaction_leaves_no_part_of_overlapping_spans(spark):
    number = iban("GB", "NWBK60161331926819")
    tail = next(t for t in (f"{k:04}" for k in range(10)) if luhn(number[8:] + t))
    found = pii.find(awkward(spark, [(1, f"account {number} {tail} end")]))
    assert [s.kind for s in found.first().spans] == ["card", "iban"]
    assert [r.text for r in pii.redacted(found).collect()] == ["account [iban] end"]
