"""Quality rules against a plain reading of the contract, text by text."""

import random
import re
import time

import duckdb
import regex
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import quality, sql

PROSE = "The quick brown fox jumps over the lazy dog near a quiet river bank today. " * 1


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, marked = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(marked), failed,
    )


BLANK = "[\x09-\x0d\x20]"


def plain_fails(line):
    """The line rules, told once more."""

    def often(found, least, chars, of=line):
        return found >= least and found * chars >= len(of)

    if not re.search("[.!?…。！？．।॥؟۔։።]", line):
        return True
    if regex.search(r"\p{Lu}{2}", line) and not regex.search(r"[\p{Ll}\p{Lo}]", re.sub("[ªº]", "", line)):
        return True
    calm = re.sub(r"(\*{2,3})(?=[^\s*])([^*]*[^\s*])\1", r"\2", line, flags=re.ASCII)
    if often(len(re.findall("[#*$%&]{2,}", calm)), 3, 25) or often(len(re.findall("[!?]{2,}", line)), 3, 25):
        return True
    if often(len(re.findall("[|>•]", line)), 3, 25):
        return True
    if often(len(re.findall(f"(?<={BLANK})[»›](?={BLANK})", line)), 3, 25) and not re.search("[«‹]", line):
        return True
    small = line.lower()
    for phrases, chars in ((quality.NOTICES, 200), (quality.MENUS, 60)):
        whole = "|".join(
            rf"(?<![\p{{L}}\p{{N}}_]){p}(?![\p{{L}}\p{{N}}_])" if p[0].isalpha() else p for p in phrases
        )
        if often(len(regex.findall(whole, small)), 1, chars, small):
            return True
    return False


def plain_cleaned(text):
    """(is the document kept, its text without failing lines)."""
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lines = [(x, bool(words.search(x)) and plain_fails(x)) for x in (text or "").split("\n")]
    whole = sum(map(len, words.findall(text or "")))
    lost = sum(len("".join(words.findall(x))) for x, bad in lines if bad)
    return not plain(text)[5] and whole - lost >= 0.5 * whole, "\n".join(x for x, bad in lines if not bad)


def texts():
    rng = random.Random(3)
    vocabulary = ["a", "bb", "ccc", "dé", "e.", "#x", "|", "y%"]
    out = [None, "", " \n\t \n", "one", PROSE, "\x1fa\x0bb\x0cc\x85d e " * 3, "a " * 5000, PROSE * 400]
    for _ in range(60):
        n = rng.randint(1, 120)
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n)))
    return out


def test_base_measures(spark):
    given = texts()
    rows = quality.judged(documents(spark, given)).collect()
    assert len(rows) == len(given)
    for r in rows:
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert mine == plain(given[r.doc_id])
        assert not (r.base_failed and r.kept)


def sentences(n, rng):
    return " ".join(f"Word{rng.randrange(10**6)} and thing{rng.randrange(10**6)} went on." for _ in range(n))


def test_lines_and_verdicts(spark):
    rng = random.Random(4)
    good = "\n".join(sentences(4, rng) for _ in range(5))
    bad = ["Home | About | News | Contact", "BUY NOW AND SAVE!", "wow!! great!! yes!! more.", "a%%% b%%% c%%% d.",
           "We use Cookie Settings here.", "Licensed under CC BY.", "no mark at all"]
    cases = [good, good + "\n" + "\n".join(bad), "\n".join(bad * 12) + "\n" + sentences(2, rng), good + "\n\n" + good[:30]]
    rows = {r.doc_id: r for r in quality.judged(documents(spark, cases)).collect()}
    assert rows[0].kept and rows[0].cleaned == good and rows[0].n_bad_lines == 0
    assert rows[1].kept and rows[1].cleaned == good and rows[1].n_bad_lines == len(bad)
    assert not rows[2].kept
    assert rows[3].n_bad_lines == 1 and rows[3].cleaned == good + "\n"


CLEAN = [
    "The plan was written in terms of user needs, and the design in Milan spread more quickly than anyone on the small team had expected at first.",
    "Il a dit « oui », puis « non », puis « peut-être », et enfin « jamais » avant de partir de la maison avec son frère et sa petite sœur hier soir.",
    "Hon sade »ja» och sedan »nej» och sedan »kanske» innan hon gick hem till sin bror och sin lilla syster som väntade på henne hela kvällen i går.",
    "This is a **bold** move and a **brave** one for the whole team, which had waited for years until somebody took the first step in public.",
    "中国 的 GDP 在 去年 增长 了 很多 ， 专家 认为 这 一 趋势 将 继续 下去 ， 但是 也 有 一些 风险 需要 注意 。",
    "Страны НАТО и ВОЗ обсудили новый договор о помощи, который должен вступить в силу в начале следующего года после долгих переговоров всех сторон в Женеве.",
    "भारत की GDP पिछले साल बहुत बढ़ी और जानकार मानते हैं कि यह रुझान आगे भी जारी रहेगा लेकिन कुछ जोखिम भी हैं जिन पर ध्यान देना होगा।",
    "He wanted to sign in at the desk of the hotel, but the clerk told him to read more of the small print first, and so he sat down in the hall and did.",
    "The engineers compared the ratio a > b with b > c and then with c > d over many years of records, and they found that the order never changed at all in any of the stations.",
]


BAD = [
    "Home » News » Sport » Football.", "Start › Shop › Schuhe › Rot.", "КУПИТЕ СЕЙЧАС НАТО!", "OFERTA Nº 1 HOY!",
    "Click here to sign in.", "READ MORE... or read more.", "© 2020 Somebody.", "*** $$$ ### now.",
    "Accept all cookies. Privacy policy. Terms of use. Cookie settings. " * 5,
    "Home | About | News | Contact", "BUY NOW AND SAVE!", "wow!! great!! yes!! more.", "a%%% b%%% c%%% d.",
    "We use Cookie Settings here.", "Licensed under CC BY.", "no mark at all",
]


def test_sql_and_plain_version_agree_line_by_line(spark):
    """Every line decides a document of its own: 30 good words, and the line with as many."""
    rng = random.Random(8)
    lines = [*CLEAN, *BAD, *[x[:60] for x in CLEAN], *[f"{b} {c}" for b in BAD for c in CLEAN[:3]]]
    pieces = ["**a b**", "***x***", "##", "!!", "??", " » ", "›", " | ", "•", "ªº", "GDP", "sign in", "design in", "©", "word.", "ß", "ля", "中"]
    lines += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    cases = [f"{x}\n" * 25 + "".join(f"w{i}x{k}. " for i in range(len(x) * 8)) for k, x in enumerate(lines)]
    cases += lines + [None, ""]
    rows = quality.judged(documents(spark, cases)).collect()
    for r in rows:
        assert (r.kept, r.cleaned) == plain_cleaned(cases[r.doc_id]), cases[r.doc_id][:200]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(cases)))
    said = {row[0]: row[1:] for row in connection.execute(sql.QUALITY).fetchall()}
    for r in rows:
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        assert said[r.doc_id] == mine, cases[r.doc_id][:200]


def test_very_long_lines(spark):
    long = [
        "ACGT" * 2_500_000 + "acgt", "A" * 3_000_000, "ab " * 1_000_000 + "!!", "**a " * 500_000, "#" * 2_000_000 + ".",
        "!? " * 500_000, "*" * 1_000_000 + "x", "read " * 500_000 + ".",
    ]
    start = time.time()
    rows = quality.judged(documents(spark, long)).collect()
    assert len(rows) == len(long) and time.time() - start < 60


def test_clean_documents_of_one_line_stay(spark):
    rows = {r.doc_id: r for r in quality.judged(documents(spark, CLEAN)).collect()}
    assert [i for i in range(len(CLEAN)) if not rows[i].kept] == []
    assert all(rows[i].cleaned == text for i, text in enumerate(CLEAN))


def test_short_and_dense_lines_go(spark):
    bad = [
        "Home » News » Sport » Football.", "Start › Shop › Schuhe › Rot.", "КУПИТЕ СЕЙЧАС НАТО!", "OFERTA Nº 1 HOY!",
        "Click here to sign in.", "READ MORE... or read more.", "© 2020 Somebody.", "*** $$$ ### now.",
        "Accept all cookies. Privacy policy. Terms of use. Cookie settings. " * 5,
    ]
    [row] = quality.judged(documents(spark, ["\n".join([*bad, CLEAN[0]])])).collect()
    assert row.cleaned == CLEAN[0] and row.n_bad_lines == len(bad)


def test_cleaned_keeps_columns_and_length(spark):
    rng = random.Random(5)
    good = sentences(8, rng)
    docs = documents(spark, [good + "\nHome | A | B | C", "x", None]).withColumn("_m", F.lit(7))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    [row] = quality.cleaned(docs, length="n_chars").collect()
    assert row.asDict() == {"doc_id": 0, "text": good, "_m": 7, "n_chars": len(good)}
    assert quality.cleaned(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = quality.judged(documents(spark, ["a"]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
