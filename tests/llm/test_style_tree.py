"""Rare nodes on a large host."""

from dwellstat.llm import html_extraction


def test_rare_unique_parts_stay_on_a_large_host(spark):
    def page(i):
        table = f"<table><tr><td>figures of {i}</td></tr></table>" if i < 20 else ""
        return f"<body><div class='top'>Welcome</div><div class='body'><p>story {i}</p>{table}</div><div class='rare'>{'same' if i % 100 == 7 else ''}</div></body>"

    rows = [(i, f"http://big.com/{i}", page(i)) for i in range(3000)] + [(5000 + i, f"http://small.com/{i}", page(i)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extracted(pages).collect()}
    for i in range(200):
        want = f"story {i}" + (f"\nfigures of {i}" if i < 20 else "")
        assert got[i] == want
        assert got[5000 + i].replace("\nsame", "") == want
    assert got[2007] == "story 2007"


def test_the_tree_judges_declared_elements_too(spark):
    def page(i):
        return (f"<body><nav><ul><li>Home</li></ul></nav><div class='body'><p>story {i}</p></div>"
                f"<div class='comments'>reader {i}</div><footer>all rights</footer></body>")

    pages = spark.createDataFrame([(i, f"http://a.com/{i}", page(i)) for i in range(60)], "page_id long, url string, html string")
    noise = set(html_extraction.site_noise(pages).first()["noise"])
    # menu and footer go by importance alone, comments that differ only by their role
    assert html_extraction.text_of(page(3), noise, roles=False) == "story 3\nreader 3"
    assert html_extraction.text_of(page(3), roles=False) == "Home\nstory 3\nreader 3\nall rights"
    assert {r.text for r in html_extraction.extracted(pages).collect()} == {f"story {i}" for i in range(60)}


def test_declared_and_plain_elements_of_one_path_stay_apart(spark):
    def page(i):
        return f"<body><div role='navigation'>Home</div><p>story {i}</p></body>" if i >= 10 else f"<body><div>story {i}</div></body>"

    pages = spark.createDataFrame([(i, f"http://a.com/{i}", page(i)) for i in range(200)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extracted(pages).collect()} == {i: f"story {i}" for i in range(200)}


def test_an_article_below_an_open_head_stays():
    assert html_extraction.text_of("<head><title>x</title><article><p>story</p></article>") == "story"
