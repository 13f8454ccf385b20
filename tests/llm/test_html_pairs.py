"""Page differencing against brute force: every page with all others of its host, whatever the ranges."""

import random

import pytest
from pyspark.sql import functions as F

from planwright.llm import html_text
from planwright.llm.queries import op10_html_text

SCHEMA = "page_id bigint, url string, html string"
STORY = "the long first sentence of story {0} goes on for a good while, as articles do"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(60))
def test_longest_common_lines(seed):
    draw = random.Random(seed)
    a, b = (["abcd"[draw.randrange(1 + seed % 4)] for _ in range(draw.randrange(12))] for _ in "ab")
    found = sorted(html_text.shared_lines(a, b))
    rest = iter(b)
    assert len(found) == longest(a, b) and all(a[k] in rest for k in found)


def plain_texts(rows):
    """Text by page id, with every host's pages in one list."""
    hosts = {}
    for page_id, url, page in rows:
        host, _, path = (url or "").removeprefix("http://").partition("/")
        hosts.setdefault(host, []).append(("/" + path if path else "", page_id, html_text.blocks(page or "")))
    out = {}
    for pages in hosts.values():
        pages.sort(key=lambda p: p[:2])
        for k, (path, page_id, own) in enumerate(pages):
            near = [(j, pages[j]) for j in range(max(0, k - html_text.NEAR), min(len(pages), k + html_text.NEAR + 1)) if j != k]
            near.sort(key=lambda p: (-html_text.common_prefix(path, p[1][0]), abs(p[0] - k), p[0] > k))
            out[page_id] = html_text.main_text(own, [p[2] for _, p in near])
    return out


@pytest.fixture(scope="module")
def pages():
    draw, rows = random.Random(7), []
    for k in range(120):
        lines = [f"<div>menu {k % 4}</div>", f"<p>{STORY.format(k // 2 if k % 5 == 0 else k)}</p>", f"<p>{STORY.format(-k)}</p>", "<div>about us</div>", f"<div>seen {k} times</div>"]
        rows.append((k, f"http://{'big' if k < 100 else f'h{k % 7}'}/{draw.choice('abc')}/{draw.randrange(40)}", "".join(lines)))
    return [*rows, (200, None, "<p>alone</p>"), (201, None, None), (202, "http://big", ""), (203, "http://big/a/1", "<article><p>about us</p></article>")]


@pytest.mark.parametrize("n_ranges", [1, 3, 64])
def test_ranges_do_not_decide(spark, pages, n_ranges):
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, SCHEMA).repartition(5), n_ranges).collect()}
    assert out == plain_texts(pages)
    assert out[203] == "about us" and not any("about us" in text for k, text in out.items() if k < 100)


def test_near_copies_keep_their_article(spark):
    page = f"<p>{STORY.format(1)}</p><p>{STORY.format(2)}</p><div>seen {{0}} times</div>"
    other = f"<div>site name</div><p>{STORY.format(3)}</p>"
    rows = [(1, "http://a/p/1", page.format(5)), (2, "http://a/p/2", page.format(6)), (3, "http://b/q/1", "<div>site name</div>" + page.format(7)),
            (4, "http://b/q/2", "<div>site name</div>" + page.format(8)), (5, "http://b/q/3", other)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    story = f"{STORY.format(1)}\n\n{STORY.format(2)}\n\nseen "
    assert out == {1: story + "5 times", 2: story + "6 times", 3: story + "7 times", 4: story + "8 times", 5: STORY.format(3)}


def test_repeats_ties_and_empty_tables(spark):
    rows = [(1, "http://a/x", "<p>one</p>")] * 9 + [(None, "http://a/x", "<p>none</p>"), (1, "http://a/x.html", "<p>one</p><p>two</p>")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("clash")).withColumn("texts", F.lit(1)).withColumn("g", F.lit(2))
    found = sorted((r.page_id or 0, r.text) for r in html_text.extract(table, 8).collect())
    assert found == sorted((r.page_id or 0, r.text) for r in html_text.extract(table, 1).collect()) and len(found) == 11
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows = op10_html_text(spark, "/root/testdata/sf0.001").collect()
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
