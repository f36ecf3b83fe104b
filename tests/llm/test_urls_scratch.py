"""URL filters against regular expressions, and the life of scratch tables."""

import os
import random
import re
from urllib.parse import urlparse

from cairn.llm import quality, url_filter
from cairn.llm.common import release, scratch_scope, scratch_table
from cairn.session import ensure_checkpoint_dir

SCHEMA = "page_id bigint, url string, host string, path string, rule string, m string, globs string"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "r", "m", "g") for i, u in enumerate(urls)], SCHEMA).repartition(3)


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == url_filter.BLOCK, h + p, v) for v, h, p in url_filter.BASE_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    hit = any(re.fullmatch(url_filter.glob_regex(g), "." + host + path) for g in url_filter.BLOCK_GLOBS)
    return host, path, None, "block" if hit else "allow"


def test_urls(spark):
    rnd = random.Random(5)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.net", "net", "my-casino.org", "x.ads.de",
             "pharma-x.org", "b.xxx", "é.org", ""]
    parts = ["/en/", "/es/", "/fr/x", "/en", "/", "", "/wp-login.php", "/a/wp-login.php", "/cart/1", "/f.exe", "/a/b.apk?x.exe", "#/en/",
             "?u=http://example.com/en/", "/login/\nx"]
    urls = [rnd.choice(["http://", "HTTPS://", "://", ""]) + rnd.choice(hosts) + "".join(rnd.choices(parts, k=rnd.randint(0, 2)))
            for _ in range(400)]
    urls += [None, "", "example.com/en/", "http://", "http://example.com/en/" + "a" * 50_000, *["http://a.net/es/"] * 5]
    out = {r.page_id: r for r in url_filter.judge_urls(frame(spark, urls)).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        r = out[i]
        assert (r.host, r.path, r.rule, r.verdict) == expected(u), u
    assert {r.verdict for r in out.values()} == {"allow", "block"}


def test_masks_carry_across_words():
    globs = ["".join(chr(97 + (i * k) % 26) for i in range(50)) + "*z" for k in range(1, 6)] + ["**q", "?" * 70]
    texts = [g.replace("*", "mm") for g in globs] + ["a" * 70, "b", "", "zq", "a/" * 35]
    got = url_filter.ShiftAnd.compile([url_filter.parse_glob(g) for g in globs]).run([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert row.tolist() == [re.fullmatch(url_filter.glob_regex(g), t) is not None for g in globs], t


def test_no_urls(spark):
    assert url_filter.judge_urls(frame(spark, ["x"]).filter("page_id < 0")).count() == 0


def folders(spark):
    return set(os.listdir(urlparse(ensure_checkpoint_dir(spark)).path))


def test_scratch_tables_go_with_their_scope(spark):
    before = folders(spark)
    with scratch_scope():
        with scratch_scope():
            first = scratch_table(spark.range(10), "first")
            second = scratch_table(first.filter("id > 3"), "second")
            release(first)
            assert len(folders(spark) - before) == 1
            last = scratch_table(second.filter("id > 5"), "last", keep=True)
        assert len(folders(spark) - before) == 1
        assert last.count() == 4
    assert folders(spark) == before
    alone = scratch_table(spark.range(3), "alone")
    assert alone.count() == 3 and len(folders(spark) - before) == 1


def test_scratch_tables_go_after_a_failure(spark):
    before = folders(spark)
    try:
        with scratch_scope():
            scratch_table(spark.range(10), "first")
            raise KeyError
    except KeyError:
        pass
    assert folders(spark) == before


def test_quality_filters_as_it_judges(spark):
    """Rows that share an id, have none or clash with inner names; empty tables."""
    good = "The cat sat on the mat and the dog lay by the door, for it was a warm day in the middle of the summer."
    rows = [(1, good, "en", "x"), (1, "short", "en", "x"), (None, good, "en", "y"), (None, None, None, "z"), (2, good, None, None),
            (2, good, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, doc string").repartition(3)
    out = quality.filtered(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(repr(r) for r in docs.collect() if r.text == good)
    assert quality.filtered(docs.filter("false")).count() == 0
