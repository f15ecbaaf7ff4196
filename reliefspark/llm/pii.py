"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for account numbers, ranges for
addresses), words nearby raise or lower the score.  The four base kinds are always reported when their check holds;
the further kinds ``iban``, ``ssn`` and ``tel`` need a score of at least ``THRESHOLD``, ``ssn`` and ``tel`` also no base
span below them.  An ``iban`` has the length of its country, whatever follows; of other countries it is the longest run.

Patterns are possessive and anchored at the first character of a run, so a long run costs linear time and no stack.
A null text is an empty one.  Repeated rows are searched one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kinds in the order of reports; base kinds first
BASE, FURTHER = ("email", "ip", "card", "phone"), ("iban", "ssn", "tel")
#: the same matches as the plain patterns of the kinds: nothing follows a possessive part that could give it back
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}",
}
#: countries by the length of their account numbers
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Heads of account numbers; group 1 is the whole candidate, so that a false head takes nothing from a number behind it."""
    def run(length: int) -> str:
        whole, rest = divmod(length - 4, 4)
        return rf"(?: ?[A-Z0-9]{{4}}){{{whole}}}" + rf" ?[A-Z0-9]{{{rest}}}" * bool(rest)

    known = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}{run(n)}" for n, names in LENGTHS.items())
    return rf"(?<![A-Za-z0-9+-])(?=[A-Z]{{2}}[0-9]{{2}})(?=({known}|(?!{'|'.join(LENGTHS.values()).replace(' ', '|')}){PATTERNS['iban']}))[A-Z]{{2}}[0-9]{{2}}"


#: hundredths
POINTS = {"email": 80, "ip": 70, "card": 80, "phone": 60, "iban": 90, "ssn": 30, "tel": 30}
NEAR, AGAINST, THRESHOLD = 40, -30, 50
CONTEXT = {
    "email": "mail|contact|write to", "ip": "address|host|server", "card": "card|visa|credit|payment", "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank", "ssn": "ssn|social security", "tel": "phone|call|tel|fax|mobile"}
COUNTER = "example|sample|dummy|version|order no"
#: code points looked at before and behind a span
BEFORE, BEHIND = 40, 20

_SPANS = "array<struct<start:int,end:int>>"


def _mod97(hit: Column) -> Column:
    code = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97))
    return F.length(code).between(15, 34) & (rest == 1)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: F.forall(F.split(hit, "[.]"), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(part, F.lit(3))).cast("int") <= 255)),
    "card": lambda hit: F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda hit: F.lit(True),
    "tel": lambda hit: F.lit(True),
}


def _spans(text: Column, kind: str) -> Column:
    """Confirmed matches of a pattern as code point spans: lengths of matches and of what is between them add up."""
    # of an account number the pattern takes its head only
    pattern, group, taken = (_iban(), 1, lambda hit: F.lit(4)) if kind == "iban" else (PATTERNS[kind], 0, F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    pairs = F.filter(F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap"))), lambda x: x["hit"].isNotNull())
    state = f"struct<at:int,found:{_SPANS}>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((start + taken(x["hit"])).alias("at"), F.when(_CHECKS[kind](x["hit"]), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found")).cast(state)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found")).cast(state)
    return F.aggregate(pairs, begin, step, lambda acc: acc["found"])


def _scored(text: Column, spans: Column, kind: str) -> Column:
    def scored(span: Column) -> Column:
        first = F.greatest(span["start"] - BEFORE, F.lit(0))
        around = F.lower(F.concat(F.substr(text, first + 1, span["start"] - first), F.lit("|"), F.substr(text, span["end"] + 1, F.lit(BEHIND))))
        points = POINTS[kind] + F.when(around.rlike(CONTEXT[kind]), NEAR).otherwise(0) + F.when(around.rlike(COUNTER), AGAINST).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), (F.least(points, F.lit(100)) / 100).alias("score"))

    return F.transform(spans, scored)


def _alone(text: Column, span: Column) -> Column:
    """No letter, digit or hyphen right before or behind."""
    before = F.when(span["start"] > 0, F.substr(text, span["start"], F.lit(1))).otherwise("")
    return ~F.concat(before, F.substr(text, span["end"] + 1, F.lit(1))).rlike("[A-Za-z0-9+-]")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``text`` and ``spans``: array of (kind, start, end, score), by kind and then start; code points, end exclusive."""
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast(_SPANS)
    # most texts lack the one character that a kind cannot do without
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    found = source.withColumn("digits", text.rlike("[0-9]"))
    found = found.select(id_col, "text", *[F.when(has.get(kind, F.lit(True)) & (F.col("digits") if kind != "email" else F.lit(True)), _spans(text, kind)).otherwise(none).alias(kind) for kind in BASE + FURTHER])
    found = found.withColumn("base", F.concat(*map(F.col, BASE)))

    def free(kind: str) -> Callable[[Column], Column]:
        # a sum modulo 97 says more than digits that pass as a card by chance: both are told
        if kind == "iban":
            return lambda span: _alone(text, span)
        return lambda span: _alone(text, span) & ~F.exists("base", lambda other: (other["start"] < span["end"]) & (other["end"] > span["start"]))

    parts = [_scored(text, F.col(kind), kind) for kind in BASE]
    parts += [F.filter(_scored(text, F.filter(kind, free(kind)), kind), lambda x: x["score"] * 100 >= THRESHOLD) for kind in FURTHER]
    return found.select(id_col, "text", F.concat(*parts).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """Replaces every span of ``find`` by ``[kind]``; overlapping spans go together under the first one's kind."""
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["out"], F.substr("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), grown.alias("out")))

    return found.withColumn("text", F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text")))))
