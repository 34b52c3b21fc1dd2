"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every text becomes a set of word shingles and a signature of ``coordinates`` least
   hashes.  Texts with equal sets are one class; only classes are compared.
2. A class is posted under its (coordinate, value) tokens.  Two sets at the wanted
   similarity agree in at least ``matches`` coordinates (but for a chance below 1e-6 per
   pair exactly at the threshold), so classes with fewer shared tokens are skipped, and the
   others are posted under their rarest tokens only: the first s - matches + 1 of s shared
   ones.  Two classes with enough matches meet under one of them.
3. Star pass: under each token, every class is compared with the list's most typical class.
   Collisions are counted on whole signatures, pairs that reach ``matches`` are confirmed on
   whole sets.
4. Remaining pass: lists whose classes are all linked by then are skipped.  In the others
   pairs of different components are counted and confirmed, each pair under its first
   common token, in blocks of bounded size.  A task returns links that join components, at
   most one per class, never all pairs.
5. Links are joined to components; a document's component is the least doc_id in it.

Scale: shuffles carry signatures of classes, postings and texts of candidates.  Copies cost
one row each; a group of near copies costs its list, not its square, because a list's own
component is compared with outsiders only.  Lists are cut into blocks by rows and by
shingles, so no task gathers a group.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles are compared by 64-bit
hashes.  Defined results for odd input: texts without words (NULL, empty, white space) have
an empty set and are linked with nothing; a text with fewer words than a shingle has one
shingle; repeated documents are copies; documents without an id are linked like others, but
their id names a component only if it has no other; an empty table gives an empty result;
extra columns are ignored by ``judged`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.llm.components import components
from soundrows.llm.frames import Renamed, narrowed, small_batches
from soundrows.llm.shingles import WIDTH, alike, shingle_sets, signatures
from soundrows.llm.textbytes import as_text, buffer_of, pieces
from soundrows.session import stored

PIECE = 2 << 20
SMALL_LIST = 8
PAIR_ROWS = 16


@dataclass(frozen=True)
class Settings:
    """Shingle width, wanted similarity, signature length and what a task may gather."""

    width: int = WIDTH
    percent: int = 75
    coordinates: int = 48
    matches: int = 20
    block_rows: int = 512
    block_shingles: int = 1 << 20
    task_rows: int = 4096


DEFAULT = Settings()


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sign(batches, settings: Settings):
    """Per text: set size, class (a 128-bit fingerprint of the set) and signature."""
    for batch, data, offsets in pieces(batches, most=PIECE):
        sets = shingle_sets(data, offsets, settings.width)
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        signed = signatures(sets, settings.coordinates)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1) * settings.coordinates, pa.int32()),
                    pa.array(signed.reshape(-1)),
                ),
            ],
            names=["doc_id", "text_key", "n_shingles", "cls", "signature"],
        )


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """A stored row per document (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return stored(
        keyed.mapInArrow(
            lambda b: sign(b, settings),
            f"doc_id {kind}, text_key binary, n_shingles long, cls binary, signature array<int>",
        ),
        "signatures",
    )


def head() -> Column:
    """The document that stands for a class: the least id, ids before NULL."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("head")


def tokens_of(signature: Column) -> Column:
    return F.transform(
        signature,
        lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))),
    )


def candidates(rows: DataFrame, settings: Settings) -> DataFrame:
    """Classes that share enough tokens with others: their prefix and how typical they are.

    ``prefix`` are the rarest shared tokens, ``mask`` their coordinates as bits, ``score``
    the summed frequency of all shared tokens.
    """
    classes = rows.filter("cls is not null").groupBy("cls").agg(
        F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), head()
    )
    tokens = classes.select("cls", F.explode(tokens_of(F.col("signature"))).alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = tokens.join(often, "token").groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"), F.sum("n").alias("score")
    )
    enough = shared.filter(F.size("shared") >= settings.matches)
    prefix = F.slice("shared", F.lit(1), F.size("shared") - (settings.matches - 1))
    bits = F.aggregate(
        "prefix",
        F.lit(0).cast("long"),
        lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 32).cast("int"))),
    )
    chosen = enough.select("cls", "score", F.transform(prefix, lambda x: x["token"]).alias("prefix"))
    return stored(
        chosen.withColumn("mask", bits).join(classes, "cls"), "candidates"
    )


def star_pairs(lists: DataFrame, signed: DataFrame, settings: Settings) -> DataFrame:
    """Each class with the typical class of each of its lists, if they match enough."""
    pairs = (
        lists.filter("cls != pivot")
        .select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )
    own = signed.select("cls", "signature")
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return both.filter(same >= settings.matches).select("a", "b")


def confirm(batches, settings: Settings):
    """The pairs whose whole sets are alike."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            left = shingle_sets(*buffer_of(part.column("ta")), settings.width)
            right = shingle_sets(*buffer_of(part.column("tb")), settings.width)
            same = [alike(x, y, settings.percent) for x, y in zip(left, right)]
            yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The text of each candidate class, taken from its head document."""
    heads = chosen.select("cls", "head")
    keyed = docs.select("text", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text_key(F.col("text")).alias("text_key")).alias("head"))
    parts = ["doc_id", "text_key"]
    same = [keyed["head"][p].eqNullSafe(heads["head"][p]) for p in parts]
    found = keyed.join(heads, same[0] & same[1])
    return stored(found.select("cls", "text").dropDuplicates(["cls"]), "texts")


def matching(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal coordinates of signatures, row by row, as bits."""
    packed = np.packbits(left == right, axis=1, bitorder="little")
    out = np.zeros((len(left), 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<i8").reshape(-1)


def first_bit(x: np.ndarray) -> np.ndarray:
    return x & -x


class Lists:
    """Blocks of posting lists that one task compares, several small ones at once."""

    def __init__(self, table: pa.Table, settings: Settings):
        k = settings.coordinates
        keys = [table.column(c).to_numpy() for c in ("bj", "bi", "token")]
        order = np.lexsort(keys)
        self.table = table.take(pa.array(order))
        self.matches = settings.matches
        self.signature = (
            self.table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, k)
        )
        self.mask, self.part, self.token, self.left, self.right = (
            self.table.column(c).to_numpy() for c in ("mask", "part", "token", "bi", "bj")
        )
        names = self.table.column("component").combine_chunks().dictionary_encode()
        self.component = names.indices.to_numpy()
        same = np.ones(len(order), bool)
        for key in keys:
            same[1:] &= key[order][1:] == key[order][:-1]
        same[:1] = False
        self.firsts = np.flatnonzero(~same)
        self.sizes = np.diff(np.r_[self.firsts, len(order)])

    def wanted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Matches of the pairs that this task has to confirm, 0 for all others.

        They are of different components, match enough, and this list's token is the
        first that both are posted under.
        """
        sides = (self.part[i] == self.left[i]) & (self.part[j] == self.right[i])
        sides |= (self.part[j] == self.left[i]) & (self.part[i] == self.right[i])
        equal = matching(self.signature[i], self.signature[j])
        n = np.bitwise_count(equal)
        common = equal & self.mask[i] & self.mask[j]
        ok = sides & (self.component[i] != self.component[j]) & (n >= self.matches)
        ok &= first_bit(common) == np.int64(1) << (self.token[i] >> 32)
        return np.where(ok, n, 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs to be confirmed: two rows each, and their matches."""
        found = [np.empty((3, 0), np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            n = self.wanted(i, j)
            found.append(np.stack([i, j, n])[:, n > 0])

        for size in np.unique(self.sizes[self.sizes > 1]).tolist():
            firsts = self.firsts[self.sizes == size]
            if size <= SMALL_LIST:  # the same pair of all lists of this size at once
                for x in range(size):
                    for y in range(x + 1, size):
                        keep(firsts + x, firsts + y)
                continue
            for first in firsts.tolist():
                for x in range(first, first + size, PAIR_ROWS):
                    i, j = np.meshgrid(
                        np.arange(x, min(x + PAIR_ROWS, first + size)),
                        np.arange(x + 1, first + size), indexing="ij",
                    )
                    once = i < j
                    keep(i[once], j[once])
        a, b, n = np.concatenate(found, axis=1)
        return a, b, n


def involved(table: pa.Table, settings: Settings) -> pa.Table:
    """The rows that take part in any pair to be confirmed."""
    lists = Lists(table, settings)
    a, b, _ = lists.pairs()
    rows = pa.array(np.unique(np.concatenate([a, b])))
    return lists.table.select(["token", "bi", "bj", "cls"]).take(rows)


def joining_links(table: pa.Table, settings: Settings) -> pa.Table:
    """Confirmed links that join components; the best matches are tried first."""
    lists = Lists(table, settings)
    a, b, n = lists.pairs()
    cls = lists.table.column("cls").to_pylist()
    texts = as_text(lists.table.column("text"))
    row_of = {c: i for i, c in enumerate(cls)}
    rows = pa.array(sorted(row_of.values()))
    sets: dict[bytes, np.ndarray] = {}
    for first in range(0, len(rows), 64):
        some = rows.slice(first, 64)
        for i, s in zip(some.to_pylist(), shingle_sets(*buffer_of(texts.take(some)), settings.width)):
            sets[cls[i]] = s
    root = list(range(int(lists.component.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i in np.argsort(-n, kind="stable").tolist():
        x, y = int(a[i]), int(b[i])
        u, v = find(int(lists.component[x])), find(int(lists.component[y]))
        if u != v and alike(sets[cls[x]], sets[cls[y]], settings.percent):
            root[u] = v
            links.append((cls[x], cls[y]))
    return pa.table(
        {"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())}
    )


def dealt_to_tasks(blocks: DataFrame, settings: Settings) -> DataFrame:
    """Blocks with the ``task`` that compares them: bounded numbers of rows and shingles."""
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).first()
    n = max(1, -(-size["n"] // settings.task_rows), -(-(size["shingles"] or 0) // settings.block_shingles))
    return blocks.withColumn("task", F.pmod(F.xxhash64("token", "bi", "bj"), F.lit(n)))


def open_lists(lists: DataFrame, known: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    """Blocks (token, bi, bj) of the lists that still hold several components.

    The component of a list's typical class is its main side; main classes are compared
    with the others only, the others also with each other.
    """
    label = known.select(F.col("node").alias("cls"), "component")
    named = lists.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    main = named.filter("cls = pivot").select("token", F.col("component").alias("main"))
    sided = named.join(main, "token").withColumn("other", F.col("component") != F.col("main"))
    many = lambda side: F.greatest(
        F.ceil(F.sum(F.when(side, 1).otherwise(0)) / settings.block_rows),
        F.ceil(F.sum(F.when(side, F.col("n_shingles")).otherwise(0)) / settings.block_shingles),
    ).cast("int")
    counts = sided.groupBy("token").agg(
        many(F.col("other")).alias("n_other"), many(~F.col("other")).alias("n_main")
    ).filter("n_other > 0")
    dealt = F.pmod(F.xxhash64("cls", "token"), F.when(F.col("other"), F.col("n_other")).otherwise(F.col("n_main")))
    rows = sided.join(counts, "token").withColumn("part", F.when(F.col("other"), dealt).otherwise(-1 - dealt).cast("int"))
    others = lambda: F.filter(F.sequence(F.lit(0), F.col("n_other")), lambda i: i < F.col("n_other"))
    mains = F.transform(F.filter(F.sequence(F.lit(0), F.col("n_main")), lambda i: i < F.col("n_main")), lambda i: -1 - i)
    block = lambda i, j: F.struct(i.cast("int").alias("bi"), j.cast("int").alias("bj"))
    mine = F.when(
        F.col("other"),
        F.concat(
            F.transform(mains, lambda i: block(i, F.col("part"))),
            F.transform(others(), lambda i: block(F.least(i, F.col("part")), F.greatest(i, F.col("part")))),
        ),
    ).otherwise(F.transform(others(), lambda i: block(F.col("part"), i)))
    spread = rows.select("token", "cls", "component", "part", F.explode(mine).alias("b"))
    spread = spread.select("token", "b.bi", "b.bj", "cls", "component", "part")
    return spread.join(chosen.select("cls", "n_shingles", "signature", "mask"), "cls")


def linked_classes(docs: DataFrame, rows: DataFrame, settings: Settings) -> DataFrame:
    """All components of two or more classes: (node, component)."""
    chosen = candidates(rows, settings)
    posted = chosen.select("cls", "n_shingles", "score", F.explode("prefix").alias("token"))
    tokens = posted.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("score", "cls")).alias("best")
    ).filter("n > 1").select("token", F.col("best.cls").alias("pivot"))
    lists = stored(posted.join(tokens, "token").select("token", "cls", "n_shingles", "pivot"), "postings")
    texts = texts_of(docs, chosen.join(lists.select("cls").distinct(), "cls", "left_semi"))
    pairs = star_pairs(lists, chosen, settings)
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    confirmed = both.select("a", "b", "ta", "tb").mapInArrow(
        lambda b: confirm(b, settings), "a binary, b binary"
    )
    known = components(confirmed)
    blocks = stored(open_lists(lists, known, chosen, settings), "blocks")
    dealt = dealt_to_tasks(blocks, settings)
    needed = dealt.groupBy("task").applyInArrow(
        lambda t: involved(t, settings), "token long, bi int, bj int, cls binary"
    )
    remaining = dealt.join(needed, ["token", "bi", "bj", "cls"]).join(texts, "cls")
    rest = remaining.groupBy("task").applyInArrow(
        lambda t: joining_links(t, settings), "a binary, b binary"
    )
    # What the star pass linked goes on as links to the least class of each component.
    return components(rest.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def labelled(docs: DataFrame, rows: DataFrame, settings: Settings) -> DataFrame:
    """Signed rows with the head of their component (a struct), NULL for empty sets."""
    linked = linked_classes(docs, rows, settings)
    heads = rows.filter("cls is not null").groupBy("cls").agg(head())
    of_class = heads.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    of_component = of_class.groupBy("component").agg(F.min("head").alias("first"))
    named = of_class.join(of_component, "component").select("cls", "first")
    return rows.drop("signature").join(named, "cls", "left")


def judged(
    docs: DataFrame, settings: Settings = DEFAULT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    docs = narrowed(docs, doc_id=doc_id, text=text)
    rows = labelled(docs, signed(docs, settings), settings)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(
    docs: DataFrame, settings: Settings = DEFAULT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component, with all its columns; empty sets all stay."""
    small_batches(docs.sparkSession)
    renamed = Renamed(docs)
    own = renamed.frame
    narrow = own.select(renamed.column(doc_id).alias("doc_id"), renamed.column(text).alias("text"))
    rows = signed(narrow, settings)
    named = stored(labelled(narrow, rows, settings).filter("cls is not null"), "labels")
    is_head = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    keyed = own.withColumn("_key", F.struct(renamed.column(doc_id).alias("doc_id"), text_key(renamed.column(text)).alias("text_key")))
    gone = named.filter(~is_head).select(F.struct("doc_id", "text_key").alias("_key")).distinct()
    kept = keyed.join(gone, "_key", "left_anti")
    repeated = named.filter(is_head).groupBy("doc_id", "text_key").count().filter("count > 1")
    if repeated.limit(1).count():  # the same row more than once
        again = repeated.select(F.struct("doc_id", "text_key").alias("_key"))
        once = kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(again, "_key", "left_anti").unionByName(once)
    return renamed.back(kept)
