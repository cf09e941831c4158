import math
import random

from quarrylight.llm import pages as P

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"


def text(html, low=frozenset()):
    return P.main_text(P.parsed(html)[1], low)


def test_article():
    html = HEAD + "<nav><ul><li>Home</ul></nav><div class='ad'>Buy</div><article><h1>Big &amp; bold</h1><p><b>One<br>two\n  three<p>Four <i>fi</i>ve&nbsp;six</article><footer>&copy; x</footer></body></html>"
    assert text(html) == "Big & bold One two three Four five six"


def test_furniture():
    for junk in ("<aside>x</aside>", "<div id='sidebar'>x</div>", "<form><input>x</form>", "<div class='cookie-notice'>x</div>", "<section class='comments'>x</section>", "<div role='banner'>x</div>", "<div hidden>x</div>", "<noscript>x</noscript>", "<header>x</header>", "<div style='display: none'>x</div>"):
        assert text(f"{HEAD}{junk}<div><p>Kept</p></div>") == "Kept", junk
    assert text(f"{HEAD}<article><header><h1>Title</h1></header><p>Kept</p><div class='comment-list'>x</div></article>") == "Title Kept"
    assert text(f"{HEAD}<p class='address header-image'>Kept</p>") == "Kept"


def test_broken_pages():
    assert text("") == "" and text("plain text") == "plain text" and text("<p>a &lt; b") == "a < b"
    assert text("<article><p>cut off <b>here") == "cut off here"
    assert text("<article><p>cut in a <a hre") == "cut in a"
    assert text("<article><p>a &am") == "a &am"
    assert text("</div></p><article></span><p>x</article>") == "x"


def test_hosts():
    assert P.host_of("https://WWW.Example.com:80/x?y") == "example.com" and P.host_of("//u@a.b/c") == "a.b"
    assert P.host_of(None) == P.host_of("nothing") == ""


def site(n, host="h.example"):
    return [(i, f"http://{host}/{i}", f"{HEAD}<div class='top'>Welcome to our site</div><div class='body'><p>Story number {i} {'word ' * i}</p></div><div class='bottom'>Made by us</div></body>") for i in range(n)]


def test_tree_removes_what_repeats(spark):
    schema = "page_id long, url string, html string"
    for p in (P.PageParams(), P.PageParams(broadcast_rows=0)):
        got = {r["page_id"]: r["text"] for r in P.extract_main_text(spark.createDataFrame(site(8), schema), p).collect()}
        assert all(t == f"Story number {i} {'word ' * i}".strip() for i, t in got.items()), got
    copies = spark.createDataFrame([(i, "http://c/1", f"{HEAD}<div>All the same</div>") for i in range(9)], schema)
    assert {r["text"] for r in P.extract_main_text(copies).collect()} == {"All the same"}


def brute_tree(rows, p):
    """(nodes, contents) of every host, from element trees, by plain recursion over all pages."""
    hosts = {}
    for _, url, html in rows:
        nodes, blocks = P.parsed(html or "")
        sites = hosts.setdefault(P.host_of(url), {})
        sites.setdefault("\n".join(b.text for b in blocks), []).append((nodes, blocks))
    nodes_out, contents_out = {}, {}
    for host, pages in hosts.items():
        has, styles, texts, kids = {}, {}, {}, {}
        for page, versions in pages.items():
            for nodes, blocks in versions:
                for n in nodes:
                    if not any(n.key in b.keys for b in blocks):
                        continue
                    has.setdefault(n.key, set()).add(page)
                    styles.setdefault(n.key, {}).setdefault(tuple(n.children), set()).add(page)
                    kids.setdefault(n.parent, set()).add(n.key)
                for b in blocks:
                    key = b.keys[-1] if b.keys else 0
                    has.setdefault(key, set()).add(page) if not b.keys else None
                    texts.setdefault(key, {}).setdefault(b.content, set()).add(page)

        def importance(key, has=has, styles=styles, texts=texts, kids=kids):
            """(importance, whether there is anything in it, peak)"""
            m = len(has[key])
            below = [(importance(k), len(has[k])) for k in sorted(kids.get(key, ())) if k != key]
            tops = [t for (_, full, t), _ in below if full]
            below = [(v, w) for (v, full, _), w in below if full]
            seen = [len(x) for x in texts.get(key, {}).values()]
            full = bool(below or seen)
            if m < p.pages:
                return 1.0, full, 1.0
            logs = lambda ns: sum(n * math.log(n) for n in ns) / sum(ns) / math.log(m)
            text = 1 - logs(seen) if seen else None
            if not below:
                return (text or 0.0), full, (text or 0.0)
            counts = [len(x) for x in styles.get(key, {}).values()]
            parts = below + ([(text, m)] if seen else [])
            under = sum(v * w for v, w in parts) / sum(w for _, w in parts)
            if not counts:
                return under, full, max([under, text or 0.0, *tops])
            own = min(1.0, (math.log(sum(counts)) - logs(counts) * math.log(m)) / math.log(m))
            share = p.gamma ** len(counts)
            v = (1 - share) * own + share * under
            return v, full, max([v, text or 0.0, *tops])

        for key in has:
            v, _, peak = importance(key)
            nodes_out[host, key] = (len(has[key]), v, peak)
        for key, found in texts.items():
            m = len(has[key])
            for content, on in found.items():
                contents_out[host, key, content] = (len(on), 1.0 if m < p.pages else 1 - math.log(len(on)) / math.log(m))
    return nodes_out, contents_out


def assert_tree(spark, rows, p):
    nodes, contents = P.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string"), p)
    mask = (1 << 64) - 1
    want_nodes, want_contents = brute_tree(rows, p)
    got_nodes = {(r["host"], r["key"] & mask): (r["pages"], r["importance"], r["peak"]) for r in nodes.collect()}
    got_contents = {(r["host"], r["key"] & mask, r["content"] & mask): (r["pages"], r["importance"]) for r in contents.collect()}
    for got, want in ((got_nodes, want_nodes), (got_contents, want_contents)):
        assert got.keys() == want.keys()
        for k, values in want.items():
            assert all(abs(x - y) < 1e-9 for x, y in zip(got[k], values, strict=True)), (k, got[k], values)
    return want_nodes


def test_tree_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        items = "".join(f"<li><a>{rng.choice('one two three four'.split())}</a>" for _ in range(rng.randint(1, 4)))
        story = "".join(f"<p>Line {rng.randrange(40)} <b>of</b> a story" for _ in range(rng.randint(1, 3)))
        rows.append((i, f"http://{rng.choice(['a.example', 'b.example'])}/{i}", f"{HEAD}<ul class=nav>{items}</ul>loose text<div class=box><div>{story}</div>{'<section>More</section>' * rng.randint(0, 1)}</div>"))
    rows += [(100, None, "no tags"), (101, None, ""), (102, None, None), (103, "http://a.example/x", rows[0][2])]
    want = assert_tree(spark, rows, P.PageParams())
    assert min(v for _, v, _ in want.values()) < 0.5 < 0.9 < max(v for _, v, _ in want.values())


def test_tree_of_the_pages_table_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    rows = [tuple(r) for r in pages]
    assert_tree(spark, rows, P.PageParams(pages=2))
    p = P.PageParams(pages=2)
    nodes, contents = brute_tree(rows, p)
    got = {r["page_id"]: r for r in P.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), p).collect()}
    assert len(got) == len(rows)
    mains = {}
    for _, url, html in rows:
        for n in P.parsed(html or "")[0]:
            mains[P.host_of(url), n.key] = n.main
    low = {}
    for (host, key), (m, _, v) in nodes.items():
        if m >= p.pages and v < (p.least_within if mains.get((host, key)) else p.least):
            low.setdefault(host, set()).add(key)
    for (host, _, content), (m, v) in contents.items():
        if m >= p.pages and v < p.least_within:
            low.setdefault(host, set()).add(content)
    for page_id, url, html in rows:
        assert got[page_id]["text"] == P.main_text(P.parsed(html or "")[1], low.get(P.host_of(url), set()))


def test_a_sentence_on_most_pages_goes_from_articles_and_copies_stay(spark):
    schema = "page_id long, url string, html string"
    story = lambda i: f"<p>{' '.join(f'w{i}x{j}' for j in range(30))}</p>"
    rows = [(i, f"http://n/{i}", f"{HEAD}<article><h1>Title {i}</h1>{story(i)}<p>Sign up for our letter</p></article>") for i in range(20)]
    rows += [(100 + i, f"http://c/{i}", f"{HEAD}<div class=ad>ad {i}</div><article><h1>Title</h1>{story(0)}</article>") for i in range(20)]
    got = {r["page_id"]: r for r in P.extract_main_text(spark.createDataFrame(rows, schema)).collect()}
    assert all(r["text"] == f"Title {i} " + " ".join(f"w{i}x{j}" for j in range(30)) and r["n_low"] == 1 for i, r in got.items() if i < 20)
    assert all(r["text"] == "Title " + " ".join(f"w0x{j}" for j in range(30)) for i, r in got.items() if i >= 100)


def test_paths_of_any_length_are_told_apart(spark):
    deep = "".join(f"<div class='{'very-long-name-' * 20}{i}'>" for i in range(60))
    nodes, blocks = P.parsed(f"{deep}<p class=x>One</p><p class=y>Two</p>")
    assert len({n.key for n in nodes}) == P.DEPTH and len(blocks) == 2
    nodes, blocks = P.parsed(f"<div class='{'long ' * 500}'><p class=x>One</p></div><div class='{'long ' * 500}z'><p class=x>Two</p></div>")
    assert blocks[0].keys[-1] != blocks[1].keys[-1]


def test_awkward(spark):
    schema = "page_id long, url string, html string, text string, host string, low string"
    rows = [(1, None, None, "x", "x", "x"), (2, "", "", "x", "x", "x"), (None, "http://a/", "<p>x</p>", "x", "x", "x"), (3, "http://a/", "<p>é ü</p>", "x", "x", "x"), (3, "http://a/", "<p>é ü</p>", "x", "x", "x"), (4, "http://a/", "<p>" + "long " * 200_000, "x", "x", "x")]
    for p in (P.PageParams(), P.PageParams(broadcast_rows=0, pages=1, least=2.0)):
        got = P.extract_main_text(spark.createDataFrame(rows, schema), p).collect()
        by = {r["page_id"]: r for r in got}
        assert len(got) == 6 and by[1]["text"] == by[2]["text"] == "" and by[3]["text"] == "é ü" and by[3]["n_chars"] == 3 and by[4]["n_chars"] == 999_999
    assert P.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_class_words_do_not_empty_an_article():
    story = "<p>" + "A story of many words. " * 9 + "</p>"
    for marks in ("content with-sidebar", "has-sidebar", "article-body no-comments", "entry comments-open", "post category-legal", "story tag-social"):
        for tag in ("article", "main", "div"):
            got = text(f"{HEAD}<nav>x</nav><div class='sidebar'>Side</div><{tag} class='{marks}'>{story}<div class='share'>Share</div></{tag}>")
            assert got == ("A story of many words. " * 9).strip(), (tag, marks)


def test_head_without_an_end():
    assert text("<html><head><title>T</title><body><p>Kept</p></body></html>") == "Kept"
    assert text("<head><title>T</title><style>p{}</style><div><p>Kept</p></div>") == "Kept"
