"""Rounds of many crawls against one queue for each crawl, one page at a time."""

import heapq
import itertools
import random
from urllib.parse import urlsplit

from brandlens.operators import crawl_order as C

SKIPPED = (".pdf", ".jpg")


def plain_crawl(crawl, seeds, links, canonicals):
    _, hosts, subdomains, max_depth, max_pages = crawl
    heap, seen, count, fetched = [], {}, itertools.count(), {}

    def allowed(url):
        host = (urlsplit(url).hostname or "").removeprefix("www.")
        return any(host == h.removeprefix("www.") or (subdomains and host.endswith("." + h)) for h in hosts)

    def discover(url, depth, priority, parent):
        if url in seen or len(seen) >= max_pages or not allowed(url) or depth > max_depth:
            return
        n = next(count)
        seen[url] = (parent, depth, priority, n, "skipped" if urlsplit(url).path.lower().endswith(SKIPPED) else "queued")
        heapq.heappush(heap, (priority, depth, n, url))

    for url, root in seeds:
        discover(url, 0 if root else 1, 0 if root else 1, None)
    while heap:
        _, depth, _, url = heapq.heappop(heap)
        if seen[url][4] == "skipped":
            continue
        fetched[url] = len(fetched)
        if depth < max_depth:
            for target, nav, nofollow in links.get(url, []):
                if not nofollow:
                    discover(target, depth + 1, 2 if nav else 3, url)
            if url in canonicals and canonicals[url] != url:
                discover(canonicals[url], depth, 3, url)
    return sorted((url, *v, fetched.get(url)) for url, v in seen.items())


def test_best_first_equals_a_heap(spark):
    r = random.Random(9)
    urls = [f"https://{h}/p{i}{e}" for h in ("a.example", "www.a.example", "blog.a.example", "b.example") for i, e in enumerate(["", "", "", ".pdf", "", "?q=.jpg", ".JPG", "", ""])]
    links = {u: [(r.choice(urls), r.random() < 0.25, r.random() < 0.1) for _ in range(r.randrange(1, 6))] for u in urls}
    canonicals = {u: r.choice(urls) for u in urls if r.random() < 0.3}
    crawls = [("one", ["a.example"], True, 6, 1000), ("small", ["a.example", "b.example"], True, 9, 11), ("narrow", ["www.a.example"], False, 3, 1000), ("shallow", ["b.example"], False, 0, 5), ("nothing", ["c.example"], True, 5, 5)]
    seeds = {c[0]: [(urls[27] if c[0] == "shallow" else urls[0], True), (urls[2], False), (urls[2], False), (urls[20], False), (urls[3], False)] for c in crawls}
    got = C.best_first(
        spark.createDataFrame(crawls, "crawl_id string, hosts array<string>, allow_subdomains boolean, max_depth int, max_pages int"),
        spark.createDataFrame([(c, u, i, root) for c, rows in seeds.items() for i, (u, root) in enumerate(rows)], "crawl_id string, url string, position int, is_root boolean"),
        spark.createDataFrame([(u, t, i, n, x) for u, rows in links.items() for i, (t, n, x) in enumerate(rows)], "source string, target string, position int, in_navigation boolean, nofollow boolean"),
        spark.createDataFrame(list(canonicals.items()), "source string, target string"),
    ).collect()
    for crawl in crawls:
        want = plain_crawl(crawl, seeds[crawl[0]], links, canonicals)
        assert sorted((x.url, x.parent_url, x.depth, x.priority, x.arrival, x.status, x.processed) for x in got if x.crawl_id == crawl[0]) == want, crawl
    assert len([x for x in got if x.crawl_id == "one"]) > 15


def sitemap(*locs, index=False):
    kind, one = ("sitemapindex", "sitemap") if index else ("urlset", "url")
    return f'<{kind} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<{one}><loc> {x} </loc></{one}>" for x in locs) + f"</{kind}>"


def plain_sitemaps(origin, candidates, documents, most, limit):
    queue, seen, found = [*candidates, origin + "/sitemap.xml"], set(), []
    while queue and len(seen) < most and len(found) < limit:
        url = queue.pop(0)
        if url in seen or urlsplit(url).hostname != urlsplit(origin).hostname:
            continue
        seen.add(url)
        kind, locs = documents.get(url, ("", []))
        if kind == "index":
            queue += locs
        else:
            found += locs
    return found[:limit]


def test_sitemap_indexes_equal_a_queue(spark):
    o = "https://a.example"
    documents = {
        f"{o}/i1": ("index", [f"{o}/i2", f"{o}/s1", "https://b.example/s", f"{o}/i1", f"{o}/gone"]),
        f"{o}/i2": ("index", [f"{o}/i1", f"{o}/s2", f"{o}/s1", *[f"{o}/many{k}" for k in range(30)]]),
        f"{o}/s1": ("page", [f"{o}/x{k}" for k in range(40)]),
        f"{o}/s2": ("page", [f"{o}/x1", "https://elsewhere.example/y", f"{o}/x1"]),
        f"{o}/sitemap.xml": ("page", [f"{o}/home"]),
        **{f"{o}/many{k}": ("page", [f"{o}/m{k}"]) for k in range(30)},
        "https://b.example/sitemap.xml": ("page", ["https://b.example/1"]),
    }
    rows = [(u, sitemap(*locs, index=kind == "index")) for u, (kind, locs) in documents.items()]
    rows += [(f"{o}/d", "<!DOCTYPE x>" + sitemap(f"{o}/no")), ("https://c.example/sitemap.xml", "<broken"), (None, None), rows[2], ("https://d.example/sitemap.xml", "<urlset><url><loc>https://d.example/</loc></url></urlset>")]
    crawls = [("a", o, [f"{o}/i1"]), ("a2", o, [f"{o}/s1", f"{o}/d"]), ("b", "https://b.example", None), ("c", "https://c.example", []), ("d", "https://d.example", [])]
    frames = spark.createDataFrame(crawls, "crawl_id string, origin string, candidates array<string>"), spark.createDataFrame(rows, "sitemap_url string, xml string")
    for most, limit in ((20, 5000), (4, 5000), (20, 30), (20, 47)):
        got = C.sitemap_pages(*frames, max_sitemaps=most, limit=limit).orderBy("crawl_id", "n").collect()
        for crawl, origin, candidates in crawls:
            known = documents if crawl != "d" else {}
            mine = [x for x in got if x.crawl_id == crawl]
            assert [x.loc for x in mine] == plain_sitemaps(origin, candidates or [], known, most, limit)
            assert [x.n for x in mine] == list(range(len(mine)))


def test_no_crawls(spark):
    none = spark.createDataFrame([], "crawl_id string, origin string, candidates array<string>")
    assert C.sitemap_pages(none, spark.createDataFrame([], "sitemap_url string, xml string")).collect() == []
