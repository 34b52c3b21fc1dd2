"""Alignment of two tokenizers against sets of byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import alignment, encoders

TEXTS = [
    None, "", " ", "one two three four", "Größe, naïve café! 日本語 and 🙂🙃", "a▁b", "  two  blanks \n\n line\ttab",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "aaaa" * 3000, "word " * 5000, "one two three four", "x　y z w",
    "unbelievably antidisestablishmentarianism, http://a.b/c?d=e", "tail ", "\n", "́ é é", "\x00 \x01 a", "1 234,567.89",
    " " * 3000 + "x", "é é", "a ,b .c", "the the the the the the",
]


@pytest.fixture(scope="module")
def vocabularies():
    a = encoders.json_tokenizer(encoders.file_bytes(encoders.vocabulary_file(alignment.BYTE_LEVEL)), True)
    b = encoders.piece_tokenizer(encoders.file_bytes(encoders.vocabulary_file(alignment.PIECES)))
    tokens_a = encoders.byte_level_tokens(encoders.file_bytes(encoders.vocabulary_file(alignment.BYTE_LEVEL)))
    return a, b, tokens_a, encoders.piece_tokens(b)


def spans(ids, tokens):
    end, out = 0, []
    for i in ids:
        out.append((i, end, end + len(tokens[i])))
        end += len(tokens[i])
    return out


def plain(text, vocabularies):
    """(ids of A, ids of B, groups, links) by comparing byte ranges."""
    a, b, tokens_a, tokens_b = vocabularies
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(t[i] for i in ids) != raw for ids, t in ((ids_a, tokens_a), (ids_b, tokens_b))):
        return [], [], [], []
    spans_a, spans_b = spans(ids_a, tokens_a), spans(ids_b, tokens_b)
    ends = sorted({e for _, _, e in spans_a} & {e for _, _, e in spans_b})
    groups, start = [], 0
    at_a = at_b = 0
    for end in ends:
        group = [[], []]
        while at_a < len(spans_a) and spans_a[at_a][2] <= end:
            group[0].append(spans_a[at_a][0])
            at_a += 1
        while at_b < len(spans_b) and spans_b[at_b][2] <= end:
            group[1].append(spans_b[at_b][0])
            at_b += 1
        groups.append(group)
        start = end
    links, low = [], 0
    for i, s, e in spans_a:
        while low < len(spans_b) and spans_b[low][2] <= s:
            low += 1
        k = low
        while k < len(spans_b) and spans_b[k][1] < e:
            links.append((i, spans_b[k][0]))
            k += 1
    return ids_a, ids_b, groups, links


def expected(texts, vocabularies):
    found = [plain(t, vocabularies) for t in texts]
    counts = Counter(link for f in found for link in f[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = []
    for i, (a, b, groups, links) in enumerate(found):
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        best = sum(counts[link] == highest[link[1]] for link in links)
        rows.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[link] for link in links), sha))
    return rows


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("most_common", [1 << 18, 20, 0])
def test_documents(spark, vocabularies, monkeypatch, most_common):
    """With all pairs common, with some, and with all pairs joined by shuffle."""
    monkeypatch.setattr(alignment, "MOST_COMMON", most_common)
    docs = documents(spark, TEXTS).withColumn("row", F.lit("clash")).withColumn("pairs", F.lit(1)).withColumn("kind", F.lit(2))
    rows = alignment.digest(alignment.aligned(docs)).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in rows) == expected(TEXTS, vocabularies)


def test_whole_table(spark, vocabularies):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = alignment.digest(alignment.aligned(docs)).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in rows) == expected(texts, vocabularies)


def test_runs_are_found_whatever_their_length():
    draw = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 60, 500):
        for keep in (0.05, 0.5, 0.98):
            common = np.cumsum(draw.integers(1, 5, n))
            a = common[(draw.random(n) < keep) | (np.arange(n) == n - 1)]
            b = common[(draw.random(n) < keep) | (np.arange(n) == n - 1)]
            link_a, link_b, inner_a, inner_b = alignment.groups(a, b)
            starts_a, starts_b = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
            overlaps = (starts_a[:, None] < b) & (starts_b < a[:, None])
            assert sorted(zip(link_a.tolist(), link_b.tolist())) == [tuple(x) for x in np.argwhere(overlaps).tolist()]
            assert inner_a.tolist() == np.flatnonzero(~np.isin(a, b)).tolist()
            assert inner_b.tolist() == np.flatnonzero(~np.isin(b, a)).tolist()


def test_cuts_change_nothing(vocabularies):
    """Odd characters around single blanks, cut and whole."""
    import pyarrow as pa

    from soundrows.llm.textbytes import buffer_of

    a, b, *_ = vocabularies
    aligner = alignment.Aligner(*[encoders.file_bytes(encoders.vocabulary_file(f)) for f in (alignment.BYTE_LEVEL, alignment.PIECES)])
    odd = [chr(c) for c in [*range(1, 0x250, 3), 0x301, 0x1680, 0x2003, 0x2028, 0x3000, 0x3042, 0xFEFF, 0x1F600]]
    texts = [f"{x} {y}{x} {x}" for x in odd for y in ("b", ".", "\n", "é", "中")]
    for text, found in zip(texts, aligner.ids(*buffer_of(pa.array(texts)))):
        if found is not None:
            assert [x.tolist() for x in found] == [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)], repr(text)
        else:
            assert plain(text, vocabularies)[0] == []


def test_repeated_rows_null_ids_and_empty_table(spark, vocabularies):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), ("x", None)], "doc_id string, text string")
    rows = alignment.digest(alignment.aligned(docs)).collect()
    [_, _, (_, *once)] = expected([None, "a b c", "a b c"], vocabularies)
    assert sorted(r.doc_id or "" for r in rows) == ["", "", "x"]
    assert all([r[c] for c in NAMES[1:]] == once for r in rows if r.doc_id is None)
    assert alignment.digest(alignment.aligned(docs.limit(0))).count() == 0
