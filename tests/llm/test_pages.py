"""URL rules and HTML extraction."""

import random

import pytest

from pulsegrid.llm import htmltext, urlfilter

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, html string"


def brute(url, rules, default="allow"):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), p, h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(4)
    labels = ["com", "net", "example", "www", "a", "b-c", "EXAMPLE", "co", "m", "é"]
    rules = list(urlfilter.RULES) + [(".".join(rng.choices(["com", "net", "example", "a", "b-c", "co"], k=rng.randint(1, 3))),
                                      rng.choice(["/", "/en/", "/e", "", "/en/x"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [None, "", "x", "http://", "://", "http://com", "a://b://com/en/", "http://net?/es/", "http://.com/", "http://a..com/",
            "http://com./", "http://example.com:80/en/"]
    urls += [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}"
             f"{rng.choice(['', '/', '/en/', '/en/x?y', '/es/1#z', '/e', '?q=/en/', '/fr/'])}" for _ in range(600)]
    urls += ["http://www.example.com/en/hot"] * 300
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(None, "http://a.com/", ""), (5, urls[5], "")]
    got = sorted((tuple(r) for r in urlfilter.judge(spark.createDataFrame(rows, PAGES).repartition(4),
                                                    spark.createDataFrame(rules, RULES)).collect()), key=repr)
    assert got == sorted(((i, *brute(u, rules)) for i, u, _ in rows), key=repr)


def test_url_rules_odd_tables(spark):
    some = spark.createDataFrame([(1, "http://x.com/a", "")], PAGES)
    rules = spark.createDataFrame(list(urlfilter.RULES), RULES)
    assert [tuple(r) for r in urlfilter.judge(some, rules.limit(0), "block").collect()] == [(1, "x.com", "/a", None, "block")]
    assert urlfilter.judge(some.limit(0), rules).count() == 0
    extra = spark.createDataFrame([(1, "http://x.com/a", "", "h", "k", "s")],
                                  PAGES + ", host string, key string, stack string")
    assert urlfilter.judge(extra, rules).first().verdict == "allow"


def main_text(page):
    return [t for k, t in htmltext.blocks(page) if k == htmltext.TEXT]


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("<article><h1>A &amp; b</h1><p>c\n <i>d</i><br>e</p></article>", ["A & b", "c d e"]),
    ("<nav><a>x</a></nav><article><p>one<p>two</article><footer>f</footer>", ["one", "two"]),
    ("<article><p><b>open<br><p>next</p></article><p>after", ["open", "next"]),
    ("<ARTICLE><P>Up &lt;p&gt;</P><script>var t='</p><p>no'</script><p>x&nbsp;y</p>", ["Up <p>", "x y"]),
    ("<article><!-- <p>no</p> --><p>a<!-- x -->b</p><aside>side</aside><form><p>q</p></form></article>", ["ab"]),
    ("<article><p>text</p><section class='comments'><p>reader</p></section><div id='related-posts'><p>r</p></div></article>", ["text"]),
    ("<main><p>in main</p></main><p>out</p>", ["in main"]),
    ("<article><p title=\"a > b\">q</p><ul><li>1<li>2</ul><pre>x\n  y</pre></article>", ["q", "1", "2", "x y"]),
    ("<article><p>3 < 4 & 5</p><textarea>t</textarea><select><option>o</select></article>", ["3 < 4 & 5"]),
    ("<div class='cookie-notice'><p>c</p></div><article class='post'><header><h1>T</h1></header><p>p</p></article>", ["T", "p"]),
    ("<article><p>a</p><div hidden><p>b</p></div><div style='display: none'>c</div></article>", ["a"]),
])
def test_structure(page, want):
    assert main_text(page) == want


def test_host_suffixes_settle_open_blocks(spark):
    menu = "home news sport weather travel about us contact and imprint"
    own = "these words are only on page number"
    rows = [(i, f"http://{'h' if i < 30 else 'other'}.com/{i}",
             f"<div>{menu}</div><div>{own} {i} {'x' * i}</div><div>start {i} {menu} end {i}</div>") for i in range(31)]
    rows += [(40, "http://solo.com/", f"<div>{menu}</div>"), (41, None, None), (42, "http://h.com/42", ""),
             (43, "http://z.com/a", "<p>one and the same page text of nine words</p>"),
             (43, "http://z.com/a", "<p>one and the same page text of nine words</p>")]
    for extra in ("", ", row string, blocks string, host string, kind string"):
        data = [(*r, "1", "2", "3", "4") if extra else r for r in rows]
        got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(data, PAGES + extra)).collect()}
        assert all(got[i] == f"{own} {i} {'x' * i}".strip() + f"\nstart {i} {i}" for i in range(30))
        assert got[30] == f"{menu}\n{own} 30 {'x' * 30}\nstart 30 {menu} end 30"  # no other page of its host
        assert got[40] == menu and got[41] == "" and got[42] == ""
        assert got[43] == "one and the same page text of nine words"  # equal rows are one page
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_very_long_pages_and_broken_markup():
    text = "word " * 50_000
    assert main_text(f"<article><p>{text}</p></article>") == [text.strip()]
    assert main_text("<article><p>" + "<b>" * 3000 + "deep") == ["deep"]
    for page in ("<" * 5000, "<a href=\"" * 2000, "<p <p <p", "<!-- open", "<script>never", "&" * 3000, "</" * 2000):
        htmltext.blocks(page)


def test_articles_of_the_driver_pages(spark):
    import html
    import re
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows)).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inside))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def by_rule(rows, depth=htmltext.DEPTH):
    """The text of each row by the rule of the module's head, from counts of all heads of all blocks."""
    from collections import defaultdict

    def heads(text):
        words = text.split(" ")
        return [(at, tuple(words[at:at + depth])) for at in range(max(1, len(words) - depth + 1))]

    host = lambda url: brute(url, [])[0]
    pages = {r: htmltext.blocks(r[2]) for r in rows}
    all_, as_text, other = defaultdict(set), defaultdict(set), defaultdict(set)
    for r, page in pages.items():
        all_[host(r[1])].add(r)
        for kind, text in page:
            for _, head in heads(text):
                (as_text if kind == htmltext.TEXT else other)[host(r[1]), head].add(r)
    out = []
    for r in rows:
        parts, h = [], host(r[1])
        for kind, text in pages[r]:
            gone = set()
            for at, head in heads(text):
                n, m = len(other[h, head]), len(as_text[h, head])
                if kind == htmltext.OPEN and n >= 2 and n > m or kind == htmltext.TEXT and len(all_[h]) >= htmltext.CROWD \
                        and 2 * len(other[h, head] | as_text[h, head]) > len(all_[h]):
                    gone |= set(range(at, at + len(head)))
            if kind != htmltext.TEMPLATE:
                parts.append(" ".join(w for i, w in enumerate(text.split(" ")) if i not in gone))
        out.append((r[0], "\n".join(p for p in parts if p)))
    return sorted(out, key=str)


def texts_of(spark, rows, n=3):
    got = htmltext.extract(spark.createDataFrame(rows, PAGES).repartition(n)).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.text) for r in got), key=str)


def test_article_text_enters_the_host_step(spark):
    line = "please write to our friendly desk and get the weekly letter by mail"
    rows = [(i, f"http://big.com/{i}", f"<article><p>only page {i} says {'so ' * i}here</p><p>{i} told {line} {i}</p></article>")
            for i in range(14)]
    rows += [(20 + i, f"http://small.com/{i}", f"<article><p>small {i}</p><p>{line}</p></article>") for i in range(3)]
    story = "a story that stands as an article and once more as a plain view for printers"
    rows += [(30 + i, f"http://s.com/{i}", f"<article><p>{story}</p></article>") for i in range(2)]
    rows += [(40 + i, f"http://s.com/print/{i}", f"<div>{story}</div><div>printed {i}</div>") for i in range(2)]
    got = dict(texts_of(spark, rows))
    assert all(got[i] == f"only page {i} says {'so ' * i}here\n{i} {i}" for i in range(14))  # on all pages: a notice
    assert all(got[20 + i] == f"small {i}\n{line}" for i in range(3))  # too few pages to tell
    assert all(got[30 + i] == story and got[40 + i] == f"{story}\nprinted {i}" for i in range(2))  # article text elsewhere
    assert sorted(got.items(), key=str) == by_rule(rows)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_host_step_equals_counts_of_all_heads(spark, monkeypatch, piece):
    monkeypatch.setattr(htmltext, "PIECE", piece)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(300)}"
    passages = [" ".join(word() for _ in range(r.choice([1, 3, 7, 8, 9, 30]))) for _ in range(12)]
    rows = []
    for i in range(90):
        inside = [f"<p>{word()} {r.choice(passages[:3]) if r.random() < 0.6 else word()} {passages[r.randrange(12)]}</p>"
                  for _ in range(3)]
        outer = [f"<{t}>{' '.join([passages[r.randrange(12)], word(), *r.choices(passages, k=r.randrange(2))])}</{t}>"
                 for t in r.choices(["div", "nav", "p", "footer"], k=4)]
        page = f"<article>{''.join(inside)}<div>{passages[5]} {i}</div></article>" if r.random() < 0.6 else "".join(inside)
        rows.append((i, r.choice([None, "http://a.com/", "http://b.com/"]) if i % 7 else "http://c.com/", page + "".join(outer)))
    rows += [rows[3], rows[4], (None, "http://a.com/", None), (200, None, ""), (201, None, f"<div>{'x ' * 50_000}</div>")]
    assert texts_of(spark, rows) == by_rule(rows)
