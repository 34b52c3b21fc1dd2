"""Mixing sources to target weights by Poisson replication.

Every document gets a mean repetition rate from its source: the source's share of the
target divided by the documents that it has.  The number of its copies is the Poisson
quantile of a uniform number hashed from the seed and the document's id, so the same seed
gives the same mix, on any cluster and after any lost task.  Documents are exploded by
their counts and dealt to partitions by a hash of (seed, id, copy): the concatenated
partitions are one global random order.

Scale: one aggregate over the source column, one pass over the documents and one shuffle of
the copies, which is the wanted global shuffle.  Rates are one row per source; they are
broadcast while measured small and joined with salted hot sources otherwise.

Defined results for odd input: documents without a source are a source of their own;
a document without an id has the id '' in the hash; repeated ids get equal counts; empty
texts are replicated like all others; a source without a weight gets none and leaves the
mix; an empty table gives an empty mix.  Extra columns are kept; a column that is called
like one of the two new ones keeps its name and the new one gets an underscore.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import Renamed
from soundrows.operators.keyed import DEFAULT_LIMITS, attach, fits_broadcast, most_frequent
from soundrows.session import stored

SEED = 20
MOST_MEAN = 16  # larger means are sums of independent draws with at most this mean
HASH_DIGITS = 13  # 52 bits, exact in a double
ORDER_DIGITS = 15


def hashed(digits: int, *parts: Column) -> Column:
    """The first hex digits of an MD5 of the parts, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return hashed(HASH_DIGITS, *parts) / F.lit(float(1 << (4 * HASH_DIGITS)))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest n whose cumulative probability exceeds ``u`` (mean at most 16)."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).cast("long").alias("n")
    )

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(
            p.alias("p"),
            (state["below"] + p).alias("below"),
            (state["n"] + F.when(state["below"] <= u, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["n"])


def copies(mean: Column, doc_id: Column, seed: int) -> Column:
    """Poisson count of a document; means above ``MOST_MEAN`` are drawn in equal parts."""
    parts = F.greatest(F.lit(1), F.ceil(mean / MOST_MEAN).cast("int"))
    draws = F.transform(
        F.sequence(F.lit(1), parts),
        lambda j: poisson(mean / parts, uniform(F.lit(seed), j, doc_id)),
    )
    return F.aggregate(draws, F.lit(0).cast("long"), lambda total, n: total + n)


def rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    size: float = 1.0,
    source: str = "source",
) -> DataFrame:
    """Mean repetitions per source (columns: key, n_docs, rate), as a stored table.

    ``weights`` names the target share of each source (any scale); without it a source
    weighs its number of documents to the power ``exponent``.  The mix is expected to have
    ``size`` times as many documents as there are.
    """
    renamed = Renamed(docs)
    counted = (
        renamed.frame.groupBy(keyed(renamed.column(source)).alias("key"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    if weights is None:
        counted = counted.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(exponent)))
    else:
        given = [("=" + name, float(weight)) for name, weight in weights.items()]
        table = docs.sparkSession.createDataFrame(given, "key string, weight double")
        counted = counted.join(F.broadcast(table), "key", "left").fillna(0.0, ["weight"])
    totals = counted.agg(
        F.sum("weight").alias("all_weight"), (F.sum("n_docs") * F.lit(size)).alias("target")
    )
    rate = F.col("target") * F.col("weight") / F.col("all_weight") / F.col("n_docs")
    with_totals = counted.crossJoin(F.broadcast(totals))  # one row
    return stored(
        with_totals.select("key", "n_docs", F.when(F.col("all_weight") > 0, rate).otherwise(0.0).alias("rate")),
        "rates",
    )


def keyed(source: Column) -> Column:
    """A key that is never NULL: '=' and the name, or '' for documents without a source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in [t.lower() for t in taken]:
        name += "_"
    return name


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    size: float = 1.0,
    seed: int = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The mix: all columns of the copies, ``copy`` (1, 2, ...) and ``place``.

    ``place`` is the hash that orders the mix; partitions hold ascending ranges of it.
    """
    spark = docs.sparkSession
    per_source = rates(docs, weights, exponent, size, source)
    renamed = Renamed(docs)
    rows = renamed.frame.withColumn("key", keyed(renamed.column(source)))
    small = fits_broadcast(per_source, "key", DEFAULT_LIMITS)
    hot = None
    if not small:
        hot = most_frequent(per_source.withColumnRenamed("n_docs", "_rows"), "key", DEFAULT_LIMITS)
    rated = attach(rows, "key", per_source, [renamed.column(doc_id)], hot, small)
    own_id = renamed.column(doc_id)
    n_copies = F.when(F.col("rate") > 0, copies(F.col("rate"), own_id, seed)).otherwise(0)
    numbers = F.filter(F.sequence(F.lit(0), n_copies.cast("int")), lambda i: i > 0)
    exploded = rated.select(*renamed.frame.columns, F.explode(numbers).alias("copy")).withColumn(
        "place", hashed(ORDER_DIGITS, F.lit(seed), F.lit("place"), own_id, F.col("copy"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = (1 << (4 * ORDER_DIGITS)) // n + 1
    dealt = exploded.repartitionById(n, F.floor(F.col("place") / F.lit(span)).cast("int"))
    ordered = dealt.sortWithinPartitions("place", own_id, "copy")
    return renamed.back(
        ordered,
        [
            F.col("copy").alias(free_name("copy", docs.columns)),
            F.col("place").alias(free_name("place", docs.columns)),
        ],
    )
