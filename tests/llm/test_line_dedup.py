import random

from plain import sha
from pyspark.sql import functions as F

from surveyloom.llm import line_dedup

PAGES = "page_id long, url string, text string"


def expected(rows, ratio, least):
    hosts, seen = {}, {}
    for _, host, lines in rows:
        if host:
            hosts[host] = hosts.get(host, 0) + 1
            for line in set(lines):
                seen[host, line] = seen.get((host, line), 0) + 1
    out = []
    for page, host, lines in rows:
        kept = [x for x in lines if not (host and seen[host, x] >= least and seen[host, x] > ratio * hosts[host])]
        out.append((page, host, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        host = rng.choice(["a.org", "a.org", "b.org", f"only{i}.org", None])
        lines = [rng.choice([f"line {k}" for k in range(8)]) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randint(0, 9))]
        rows.append((i, host, lines + lines[:1]))
    pages = spark.createDataFrame(
        [(i, f"HTTPS://user@{h.upper()}:80/x?y=http://z" if h else "no address", "\n".join(x)) for i, h, x in rows], PAGES)
    for ratio, least in ((0.3, 3), (0.05, 1)):
        found = line_dedup.without_boilerplate(pages, line_dedup.lines_of(F.col("text")), ratio=ratio, least_pages=least)
        got = sorted(((r.id, r.host, r.n_lines, r.n_dropped, sha(r.text)) for r in found.collect()), key=repr)
        assert got == expected(rows, ratio, least)


def test_markup_and_odd_rows(spark):
    html = ("<head><title>t</title></head><script>var x='<p>no</p>'</script><P class=a>One  <b>two</b>\t three</p>four<br/>"
            "<!-- no --><pre>five</pre> &amp; six")
    rows = [(1, "http://h/a", html), (2, None, html), (None, "http://h/b", None), (3, "http://h/c", ""),
            (3, "http://h/c", ""), (4, "", "<p>" * 2000 + "word " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 as host", "2 as lines", "3 as boiler", "4 as id", "5 as total")
    found = line_dedup.without_boilerplate(pages, line_dedup.html_column("html")).collect()
    texts = {r.id: r.text for r in found}
    assert len(found) == len(rows) and texts[1] == texts[2] == "One two three\nfour\nfive\n&amp; six"
    assert texts[3] == "" and {r.host for r in found} == {"h", None}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert line_dedup.without_boilerplate(empty, line_dedup.html_column("html")).count() == 0
