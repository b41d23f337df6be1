import random

from meshwork.llm import revisits

RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, hit string, slice int"


def run(spark, rows, slices=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], RECORDS)
    return {r.record_id: r for r in revisits.resolve(df, slices).collect()}


def test_canonical_urls(spark):
    urls = {
        "HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2",
        "https://example.com": "example.com",
        "https://example.com/A//": "example.com/A",
        "http://m.example.com/p?ref=x": "m.example.com/p",
        "nothing": None,
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.c for r in df.select("url", revisits.canonical(df.url).alias("c")).collect()}
    assert got == urls


def test_latest_earlier_and_validators(spark):
    h = lambda **kw: [(k.replace("_", "-"), v) for k, v in kw.items()]
    rows = [
        (1, "http://a.b/x", 10, "response", '"e1"', None, "d1", h(ETag='"e1"', Content_Length="5", Date="10")),
        (2, "http://a.b/x", 20, "response", '"e2"', "mon", "d2", h(ETag='"e2"', Content_Length="6")),
        (3, "https://www.a.b/x#f", 20, "revisit", 'W/"e1"', None, None, h(Date="20", Content_Length="0", X="y")),
        (4, "http://a.b/x/", 30, "revisit", '"e1"', None, None, None),
        (5, "http://a.b/x", 31, "revisit", None, "mon", "other", h(date="31")),
        (6, "http://a.b/x", 32, "revisit", None, None, "d1", None),
        (7, "http://a.b/x", 33, "revisit", None, None, None, None),
        (8, "http://a.b/y", 33, "revisit", None, None, None, None),
        (9, None, 33, "revisit", None, None, None, None),
        (10, "http://a.b/x", None, "revisit", None, None, None, None),
        (11, "http://a.b/x", 5, "revisit", None, None, None, None),
    ]
    for slices in (1, 2, 7):
        got = run(spark, rows, slices)
        assert {k: (r.response_id, r.outcome) for k, r in got.items()} == {
            3: (1, "resolved"), 4: (2, "validators differ"), 5: (2, "resolved"), 6: (2, "validators differ"), 7: (2, "resolved"),
            8: (None, "no earlier response"), 9: (None, "no earlier response"), 10: (None, "no earlier response"), 11: (None, "no earlier response"),
        }
        assert [tuple(x) for x in got[3].headers] == [("content-length", "5"), ("date", "20"), ("etag", '"e1"')]
        assert got[4].headers is None


def test_repeated_headers_stay_together(spark):
    old = [("Set-Cookie", "a"), ("Link", "1"), ("Set-Cookie", "b"), ("Vary", "x"), ("Vary", "y"), ("Link", "2"), (None, "z")]
    new = [("vary", "n"), ("Warning", "w1"), ("warning", "w2"), ("set-cookie", "other")]
    rows = [(1, "http://a.b/x", 10, "response", None, None, None, old), (2, "http://a.b/x", 20, "revisit", None, None, None, new)]
    got = [tuple(h) for h in run(spark, rows)[2].headers]
    assert got == [("link", "1"), ("link", "2"), ("set-cookie", "a"), ("set-cookie", "b"), ("vary", "n"), ("warning", "w1"), ("warning", "w2")]


def test_hot_url_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        url = "http://hot.x/" if rng.random() < 0.5 else f"http://c{rng.randrange(9)}.x/"
        rows.append((k, url, rng.randrange(120), rng.choice(["response", "revisit"]), None, None, None, None))
    want = {}
    for r in rows:
        if r[3] == "revisit":
            before = [(s[2], s[0]) for s in rows if s[3] == "response" and s[1] == r[1] and s[2] < r[2]]
            want[r[0]] = max(before)[1] if before else None
    assert {k: r.response_id for k, r in run(spark, rows, 5).items()} == want


def test_no_records(spark):
    assert run(spark, []) == {}


def test_repeated_rows_and_null_kinds(spark):
    rows = [(1, "http://a.b/", 1, "response", None, None, None, None)] + [(2, "http://a.b/", 2, "revisit", None, None, None, None)] * 2 + [(3, "http://a.b/", 3, None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], RECORDS)
    assert [r.response_id for r in revisits.resolve(df).collect()] == [1, 1]
