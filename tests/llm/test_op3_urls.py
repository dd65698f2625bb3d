from provenmark.llm import op3_urls as U

from .small import save

URLS = ["http://a.net/x", "HTTP://Example.NET/en/1?q=1", "https://www.example.net/en/", "http://example.net/de/", "http://example.com/de/x#y", "http://xexample.com/de/x", "http://b.org/fr/", "http://org/fr/a", "http://net", "http://net?x", "http://a.net//", "no scheme", "", None, "x://", "http://ÜBER.net/ä", "http://a.net/x", "http://.net/"]


def brute(url, rules=U.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    for c in "?#":
        cutoff = rest.split(c, 1)[0]
        rest = cutoff
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = slash + path
    fits = [r for r in rules if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])]
    best = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, *best


def test_against_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.op3_url_filter(spark, save(df, tmp_path, "pages")).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_empty_table(spark, tmp_path):
    assert U.op3_url_filter(spark, save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")).count() == 0


def test_index_confirms_strings(tmp_path):
    path = str(tmp_path / "i")
    U.write_index([(f"h{i}.com/p{i}/", "block") for i in range(1000)], path)
    index = U.Index(path)
    assert (index.find([f"h{i}.com/p{i}/".encode() for i in range(1000)]) >= 0).all()
    assert (index.find([b"h1.com/p2/", b""]) == -1).all()
    index.keys = index.keys.copy()
    index.keys[:] = index.find and U.xxhash.xxh64_intdigest(b"other")  # all keys collide
    assert (index.find([b"other"]) == -1).all()


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.filter_urls(spark, df, rules=()).first().verdict == "allow"
