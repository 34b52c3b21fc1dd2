"""URL filters: rules by hand, and a cascade against set membership."""

import random

from pyspark.sql import functions as F

from soundrows.llm import urlfilter
from soundrows.llm.urlfilter import RULES, Sizes


def pages(spark, urls):
    rows = list(enumerate(urls))
    return spark.createDataFrame(rows, "page_id long, url string").repartition(3)


def test_hosts_paths_and_rules(spark):
    urls = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "https://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/17#x": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr/a/b": ("x.com", "/fr/a/b", "com/fr/", "allow"),
        "http://xcom/de/": ("xcom", "/de/", None, "allow"),
        "http://h.net?u=://z.org/": ("h.net", "", None, "allow"),
        "http://bad.net/x": ("bad.net", "/x", None, "block"),
    }
    table = pages(spark, list(urls)).withColumn("host", F.lit(1)).withColumn("listed", F.lit("clash"))
    listed = spark.createDataFrame([("bad.net/x",), ("unknown/y",), (None,)], "key string").filter("key is not null")
    for row in urlfilter.judged(table, RULES, listed).collect():
        want = list(urls.values())[row.page_id]
        assert (row.host, row.path, row.rule, row.verdict) == want


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(2)
    keys = [f"h{rng.randrange(50)}.net/{i}" for i in range(6000)]
    listed = set(rng.sample(keys, 2000))
    rows = spark.createDataFrame([(k,) for k in keys + keys[:100]], "key string").repartition(4)
    on_list = spark.createDataFrame([(k,) for k in listed] + [("elsewhere",)], "key string")
    for sizes in (Sizes(), Sizes(filter_bytes=1000), Sizes(first_rate=0.5)):
        out = urlfilter.with_membership(rows, "key", on_list, sizes).collect()
        assert len(out) == 6100
        assert all(r.listed == (r.key in listed) for r in out)
    assert Sizes(filter_bytes=1000).groups(2000) > 1


def test_empty_list_and_empty_table(spark):
    nothing = spark.createDataFrame([], "key string")
    table = pages(spark, ["http://a.net/1", "http://a.net/1"])
    assert {r.verdict for r in urlfilter.judged(table, (), nothing).collect()} == {"allow"}
    assert urlfilter.judged(table.limit(0), RULES, nothing).count() == 0
