"""Surrogates: nothing left, same to same, distinct to distinct, formats kept."""

import re
from collections import defaultdict

import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import pii

KEY = "a key"


def out(spark, texts, key=KEY, **columns):
    frame = documents(spark, texts)
    for name, value in columns.items():
        frame = frame.withColumn(name, F.lit(value))
    return {r.doc_id: r for r in pii.pseudonymized(frame, key).collect()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


MIXED = [
    "mail Ann.Lee@Mail.Example.org now", "ANN.LEE@mail.example.org ann.lee@mail.example.org.",
    "+1 (743) 555-3824 end", "call +1-743-555-3824 or 743-555-3824", "4111111111111111 4111 1111 1111 1111",
    "4994226020900891%%% 4994-2260-2090-0891", "at 227.5.221.1, 10.0.0.255.", None, "", "no entity: 1.2.3 2020-01-01 v12",
]


def test_mentions_are_replaced_and_the_rest_stays(spark):
    rows = out(spark, MIXED, n_card="clash", _found=1)
    assert rows[7].text is None and rows[8].text == "" and rows[9].text == MIXED[9]
    for i, text in enumerate(MIXED[:7]):
        for entity in re.findall(r"[\w.]+@[\w.]+\w|\+?[\d(][\d() .-]{7,}\d", text):
            assert entity not in rows[i].text
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.org now", rows[0].text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} end", rows[2].text)
    assert re.fullmatch(r"at (\d{1,3}\.){3}\d{1,3}, (\d{1,3}\.){3}\d{1,3}\.", rows[6].text)
    assert (rows[0].n_email, rows[2].n_phone, rows[4].n_card_, rows[6].n_ip) == (1, 1, 2, 2)
    assert rows[0].n_card == "clash" and rows[0]._found == 1


def test_coreference_over_spellings_and_documents(spark):
    rows = out(spark, MIXED)
    first = rows[0].text.split()[1].lower()
    assert rows[1].text.lower().split() == [first, first + "."] and rows[1].text.split()[0][:7].isupper()
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(rows[2].text) == digits(rows[3].text.split(" or ")[0])
    plain, spaced = rows[4].text[:16], rows[4].text[17:]
    assert digits(spaced) == plain and re.fullmatch(r"(\d{4} ){3}\d{4}", spaced)
    assert plain[0] == "4" and luhn(plain)
    assert luhn(rows[5].text[:16]) == luhn(MIXED[5][:16])
    wrong = out(spark, ["4111111111111112"])[0].text
    assert len(wrong) == 16 and not luhn(wrong)
    assert digits(rows[5].text[20:]) == rows[5].text[:16]
    assert out(spark, MIXED)[2].text == rows[2].text
    assert out(spark, MIXED, "another key")[2].text != rows[2].text


def test_persons_keep_gender_script_and_family(spark):
    texts = ["Frau Anna Schmidt met FRAU SCHMIDT.", "Mr. John Smith", "Госпожа Анна Петрова", "Κύριος Νίκος Παππάς", "Dr Lee and the Others"]
    rows = out(spark, texts)
    m = re.fullmatch(r"Frau ([A-Z][a-z]+a) ([A-Z][a-z]+) met FRAU ([A-Z]+)\.", rows[0].text)
    assert m and m[2].upper() == m[3] and m[2] != "Schmidt"
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+o [A-Z][a-z]+", rows[1].text)
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+а [А-Я][а-я]+", rows[2].text)
    assert re.fullmatch(r"Κύριος [Α-Ω][α-ω]+ος [Α-Ω][α-ω]+", rows[3].text)
    assert re.fullmatch(r"Dr [A-Z][a-z]+ and the Others", rows[4].text)


def test_whole_names_are_replaced(spark):
    texts = [
        "Mr John Fitzgerald Kennedy spoke.", "Mr. John F. Kennedy spoke.", "Prof. Dr. Anna Schmidt kam.", "Herr Dr. Mueller kam.",
        "Mr. J. Smith spoke.", "Frau Dr. med. Anna von der Leyen kam.", "Mr Kennedy's car. Later Kennedy left, KENNEDY's dog too, Kennedys not.",
        "Kennedy alone stays.",
    ]
    rows = out(spark, texts)
    for i, names in enumerate(["John|Fitzgerald|Kennedy", "John|F\\.|Kennedy", "Anna|Schmidt", "Mueller", "J\\.|Smith", "Anna|Leyen", r"Kennedy\b|KENNEDY"]):
        assert not re.search(rf"\b(?:{names})", rows[i].text) and rows[i].n_person >= 1, rows[i].text
    assert re.fullmatch(r"Mr [A-Z][a-z]+o [A-Z][a-z]+o [A-Z][a-z]+ spoke\.", rows[0].text)
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+o [A-Z]\. [A-Z][a-z]+ spoke\.", rows[1].text)
    assert re.fullmatch(r"Prof\. Dr\. [A-Z][a-z]+ [A-Z][a-z]+ kam\.", rows[2].text)
    assert re.fullmatch(r"Frau Dr\. med\. [A-Z][a-z]+a von der [A-Z][a-z]+ kam\.", rows[5].text)
    m = re.fullmatch(r"Mr (\w+)'s car\. Later (\w+) left, (\w+)'s dog too, Kennedys not\.", rows[6].text)
    assert m and m[1] == m[2] and m[3] == m[1].upper() and rows[6].n_person == 3
    assert rows[0].text.split()[3] == m[1] and rows[7].text == texts[7]


FORMATS = [
    ("call 555 123 4567 now", "phone", r"call \d{3} \d{3} \d{4} now"),
    ("call 020 7946 0958 now", "phone", r"call 0\d\d \d{4} \d{4} now"),
    ("call 01 23 45 67 89 now", "phone", r"call 0\d \d\d \d\d \d\d \d\d now"),
    ("call 0221/1234567 now", "phone", r"call 0\d{3}/\d{7} now"),
    ("card 3782 822463 10005 now", "card", r"card 3\d{3} \d{6} \d{5} now"),
    ("card 3056-930902-5904 now", "card", r"card 3\d{3}-\d{6}-\d{4} now"),
    ("card 6304 0000 0000 0000 007 now", "card", r"card 6\d{3} \d{4} \d{4} \d{4} \d{3} now"),
    ("mail anna@bücher.de now", "email", r"mail \w{4}@\w{6}\.de now"),
    ("mail a.b@mail.пример.рф now", "email", r"mail \w\.\w@\w{4}\.[а-я]{6}\.рф now"),
    ("at 2001:db8::8a2e:370:7334 now", "ip", r"at 2\w{3}(?::\w{4}){7} now"),
    ("at 2001:0db8:0:0:0:8a2e:0370:7334 now", "ip", r"at 2\w{3}(?::\w{4}){7} now"),
    ("at fe80::1, now", "ip", r"at 2\w{3}(?::\w{4}){7}, now"),
]


def test_every_format_is_found(spark):
    rows = out(spark, [text for text, _, _ in FORMATS])
    for i, (text, kind, pattern) in enumerate(FORMATS):
        assert rows[i].text != text and re.fullmatch(pattern, rows[i].text), rows[i].text
        assert rows[i][f"n_{kind}"] == 1 and sum(rows[i][f"n_{k}"] for k in pii.TYPES) == 1
    assert luhn(re.sub(r"\D", "", rows[4].text)) and rows[9].text == rows[10].text
    others = ["std::dec a::b 12:30:45 on 01-02-2020 and 2020 123456 12345", "size 100 200 3000 4000", "x::"]
    assert [r.text for _, r in sorted(out(spark, others).items())] == others


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With twelve possible surrogates, six of them taken by originals, all stay distinct."""
    few = lambda h: F.concat(F.lit("9.9.9."), (pii.number(h, F.lit(0)) % 12).cast("string"))
    monkeypatch.setattr(pii, "ip_surrogate", few)
    texts = [f"a 9.9.9.{i} b 9.9.9.{i} c" for i in range(6)] + ["x 9.9.9.0 y 9.9.9.3"] * 3
    rows = out(spark, texts)
    mapped = defaultdict(set)
    for i, text in enumerate(texts):
        for a, b in zip(re.findall(r"9\.9\.9\.\d+", text), re.findall(r"9\.9\.9\.\d+", rows[i].text)):
            mapped[a].add(b)
    new = [next(iter(v)) for v in mapped.values()]
    assert all(len(v) == 1 for v in mapped.values()) and len(set(new)) == 6
    assert not set(new) & set(mapped)


def test_written_phone_numbers_are_distinct(spark):
    """Four national digits for 400 numbers: most draws collide in what is written."""
    texts = [f"+999 {i // 100 + 10} {i % 100:02d}" for i in range(400)] + ["+99910 01", "+999 10.01"]
    rows = out(spark, texts)
    new = [rows[i].text for i in range(400)]
    assert all(re.fullmatch(r"\+999 \d\d \d\d", t) for t in new)
    assert len(set(new)) == 400 and not set(new) & set(texts)
    assert {re.sub(r"\D", "", rows[i].text) for i in (1, 400, 401)} == {re.sub(r"\D", "", new[1])}


@pytest.mark.parametrize("n", [1, 3000])
def test_long_texts_and_hot_entities(spark, n):
    rows = out(spark, ["word " * 2000 + "ab@example.org " * n] * 3)
    assert len({r.text for r in rows.values()}) == 1 and rows[0].n_email == n
    assert "ab@example.org" not in rows[0].text and len(set(rows[0].text.split())) == 2


def test_empty_table_length_column_and_no_python(spark):
    docs = documents(spark, ["ip 227.5.221.1 !", "none"]).withColumn("n_chars", F.length("text").cast("long"))
    frame = pii.pseudonymized(docs, KEY, length="n_chars")
    assert all(r.n_chars == len(r.text) for r in frame.collect())
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())
    assert pii.pseudonymized(docs.limit(0), KEY).count() == 0


def repeated(n):
    return [
        "Dr " + "Aa " * n, "Dr A" + "a" * n, "Dr " + "A" * n, "Dr A" + "-a" * n, "Dr " * n + "Aa", "Dr A" + ".A" * n + ". Bb",
        "Dr " + "von " * n + "Aa", "Dr " + "med. " * n + "Aa", "Dr " + "A. " * n + "Aa", "x@" + "a." * n + "com", "x@" + "é." * n + "com",
        "x" * n + "@a.de", "x@" + "a" * n, "a@" * n, "1:" * n, "::" * n, "1::" + "1:" * n, "+1 " + "23 " * n, "0 1" * n,
        "(020) " * n, "1234 " * n, "4" * n, "1.1.1.1." * n, "Mr. " * n,
    ]


def holds_one(text):
    return "Aa" in text or "Bb" in text or text.endswith(("com", "@a.de"))


def test_a_million_repetitions_of_everything_are_searched(spark):
    texts = repeated(1_000_000)
    rows = documents(spark, texts).select("doc_id", F.transform(pii.mentions(F.col("text")), lambda m: m["type"]).alias("t"))
    found = {r.doc_id: set(r.t) & set(pii.TYPES) for r in rows.collect()}
    assert all(found[i] for i, text in enumerate(texts) if holds_one(text))


def test_long_entities_are_replaced(spark):
    texts = repeated(20_000)
    rows = out(spark, texts)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert (rows[i].n_person + rows[i].n_email > 0) == (rows[i].text != text) or not holds_one(text)


def test_surrogates_do_not_run_out(spark):
    """More one-letter names than there are letters, and initials of one family."""
    texts = [f"{chr(0x4E00 + i)}@qq.com" for i in range(30)]
    texts += [f"Dr {chr(c)}. Smith" for c in range(65, 91)] + ["Herr " + chr(c) + "a" for c in range(65, 80)]
    rows = out(spark, texts)
    new = [rows[i].text for i in range(len(texts))]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert len({t.split("@")[1] for t in new[:30]}) == 1 and len({t.split()[-1] for t in new[30:56]}) == 1


def test_domains_and_families_stay_distinct(spark, monkeypatch):
    """Two-letter domains and a small alphabet of families: parts collide at first."""
    monkeypatch.setitem(pii.SCRIPTS, "latin", ("abcdefghijklmnopqrstuvwxyz", "bd", "a", ("a", "o", "e")))
    texts = [f"u@{chr(97 + i % 26)}{chr(97 + i // 26)}.de" for i in range(120)] + [f"Dr Name{chr(97 + i)}" for i in range(26)]
    rows = out(spark, texts)
    domains = [rows[i].text.split("@")[1] for i in range(120)]
    assert len(set(domains)) == 120 and not set(domains) & {t.split("@")[1] for t in texts[:120]}
    assert len({rows[i].text for i in range(120, 146)}) == 26


def test_whole_table_and_plain_search(spark):
    """All documents come back; those without a trace of an entity as they were."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.pseudonymized(docs, KEY).collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    card = re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?)(?![\w-])")
    mail = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    ip = re.compile(rf"(?<![\w.])(?:{octet}\.){{3}}{octet}(?!\w|\.[0-9])")
    seen = 0
    for r in rows:
        text = before[r.doc_id]
        counts = [r[f"n_{k}"] for k in pii.TYPES]
        if not sum(counts):
            assert r.text == text
        for pattern, n in ((card, r.n_card), (mail, r.n_email), (ip, r.n_ip)):
            found = [m[0] for m in pattern.finditer(text)]
            assert n >= len(found)
            seen += len(found)
            new = [m[0] for m in pattern.finditer(r.text)]
            assert not set(found) & set(new)
    assert seen
