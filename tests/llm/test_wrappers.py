import random
import re
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.llm.wrappers import Leaf, Slots, align, blocks, chosen, dump, extract, fold, host_of, load, main_blocks, matching, places

from .data import SF, by_id

PAGES = "page_id long, url string, html string, host string, text string"
NOISE = '<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a>More</a></ul></nav><div class="cookie-notice">We use cookies</div>'
TAIL = '<section id=comments><article class="comment"><p>First!</p></article></section><aside class=sidebar>Side</aside><form><label>Mail</label></form><footer>&copy; us</footer>'


def run(spark, rows):
    return by_id(extract(spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES).repartition(3)), "page_id")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{NOISE}<article>{body}</article>{TAIL}</body></html>"


def test_article_without_noise(spark):
    rows = [
        (1, "http://a.com/1", page("<h1>A &amp; B</h1><p>one\n  <b>two</b> <a href='x'>three</a></p><p>four<br>five")),
        (2, "http://a.com/2", page("<h1>C</h1><div class='ad'>Buy</div><ul><li>x<li>y</ul><p>a < b &lt;p&gt; &#233;<script>no()</script></p><!-- <p>no</p> -->")),
        (3, "http://a.com/3", "<html><body><nav>n</nav><article><h1>Cut"), (4, None, None), (5, "http://b.com", ""), (6, "http://c.com/", "plain &amp; text"),
        (7, "http://d.com/", "<body><div><a href=1>Menu one</a></div><div class=intro>Long running text</div></body>"),
        (8, "http://e.com/", "<main><header>x</header><p>in main</p></main><p>out</p>"), (9, "http://a.com/1", page("<p>" + "w " * 50_000)),
    ]
    got = run(spark, rows)
    want = {1: "A & B\none two three\nfour five", 2: "C\nx\ny\na < b <p> é", 3: "Cut", 4: "", 5: "", 6: "plain & text", 7: "Long running text", 8: "x\nin main", 9: ("w " * 50_000).strip()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(want[k]) and r.url == rows[k - 1][1] for k, r in got.items())


def test_wrapper_inference():
    assert fold(list("abababc")) == [("a", True, [0, 2, 4]), ("b", True, [1, 3, 5]), ("c", False, [6])]
    assert fold(list("aab")) == [("a", True, [0, 1]), ("b", False, [2])]
    leaf = lambda text: [Leaf(s, repeated=r) for s, r, _ in fold(list(text))]
    shown = lambda w: " ".join(x.slot + "+" * x.repeated + "?" * x.optional for x in w)
    assert shown(w := align(leaf("abc"), leaf("accd"))) == "a b? c+ d?"
    assert shown(align(w, leaf("xa"))) == "x? a b? c+? d?"
    assert shown(align(leaf("ahphpf"), leaf("ahpf"))) == "a h+ p+ f"
    assert [x.slot for x in places(align(leaf("aba"), leaf("aca")), fold(list("aba")))] == ["a", "b", "a"]
    slots = Slots()
    found = blocks("<body><nav><a>m</a></nav><article><p>x</p></article></body>", slots)
    assert [slots.path(s) for s, _, _ in found] == ["body/nav", "body/article/p"] and found[0][2] == 1
    assert [slots.nature(s) for s, _, _ in found] == ["out", "article"]
    wrapper, other = [Leaf(s) for s, _, _ in found], Slots()
    other.inside(0, "div")
    assert [other.path(x.slot) for x in load(dump(wrapper, slots), other)] == ["body/nav", "body/article/p"]


def test_the_place_in_the_wrapper_decides(spark):
    """Slots are alike, without names or main elements: only alignment tells the template's place from a text slot that says the same once."""
    story = lambda i: "Tell your friends" if i == 3 else f"A story of number {i} and more"
    rows = [(i, f"http://s.com/{i}", f"<body><div><p>Tell your friends</p></div><div><h2>T{i}</h2><p>{story(i)}</p></div></body>") for i in range(9)]
    assert {k: r.text for k, r in run(spark, rows).items()} == {i: f"T{i}\n{story(i)}" for i in range(9)}


def test_pages_of_known_templates_equal_brute_force(spark):
    """Three templates, dealt over hosts and with optional and repeated parts; the main text is known."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(120):
        host, kind = f"k{i % 4}.com", rng.randrange(3)
        word = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(8, 20)))
        body = [word() for _ in range(rng.randint(1, 5))]
        inner = "".join(f"<p>{b}</p>" for b in body)
        links = "".join(f"<li><a href=/{n}>{word()}</a>" for n in range(rng.randint(0, 4)))
        text = {0: f"<article class='post ad-free'>{inner}</article>", 1: f"<main>{inner}</main>", 2: f"<div class=c><div class=has-sidebar>{inner}</div></div>"}[kind]
        rows.append((i, f"http://{host}/{i}", f"<body><div><p>{host} is a place to read at</p></div><ul>{links}</ul>{text}<div class=comments><p>{word()}</p></div><footer>{i}</footer></body>"))
        want[i] = "\n".join(body)
    assert {k: r.text for k, r in run(spark, rows).items()} == want


def test_many_wrappers_are_joined_with_salt(spark):
    rows = [(i, f"http://j{i % 3}.com/{i}", page(f"<p>{i}</p>")) for i in range(30)] + [(99, None, None)]
    t = spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES).repartition(3)
    assert sorted(map(tuple, extract(t, most_bytes=0).collect())) == sorted(map(tuple, extract(t).collect()))


def test_one_article_page_on_a_host_of_main_pages(spark):
    rows = [(i, f"http://x.com/{i}", f"<main><p>in main {i}</p></main>") for i in range(5)] + [(9, "http://x.com/9", "<article><p>in article</p></article>")]
    assert {k: r.text for k, r in run(spark, rows).items()} == {i: f"in main {i}" for i in range(5)} | {9: "in article"}


def test_given_pages_equal_their_article(spark):
    t = spark.read.parquet(f"{SF}/pages.parquet")
    got = by_id(extract(t), "page_id")
    for r in t.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        import html

        assert got[r.page_id].text == "\n".join(html.unescape(p) for p in parts if p)


def test_given_pages_without_their_article_tags_and_names(spark):
    """Nothing but the wrapper tells the article from the advert before it, if the host has two pages; without what the wrapper knows, nothing does."""
    t = spark.read.parquet(f"{SF}/pages.parquet")
    bare = t.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"(</?)article\b", "$1div"), ' class="[^"]*"', ""))
    assert t.filter("html LIKE '%class=%'").count() == t.count()
    several = {r.page_id for r in t.withColumn("host", host_of("url")).withColumn("n", F.count("*").over(Window.partitionBy("host"))).filter("n > 1").collect()}
    want = {k: r.text for k, r in by_id(extract(t), "page_id").items()}
    assert {k for k, r in by_id(extract(bare), "page_id").items() if r.text != want[k]}.isdisjoint(several) and len(several) > 25
    for r in bare.limit(50).collect():
        slots = Slots()
        found = blocks(r.html, slots)
        leaves = [Leaf(s, repeated=many) for s, many, _ in fold([s for s, _, _ in found])]
        kept, strict = chosen(leaves, slots)
        assert "\n".join(found[n][1] for n in main_blocks(found, fold([s for s, _, _ in found]), leaves, kept, strict)) != want[r.page_id]


def test_teasers_in_article_elements(spark):
    """Article elements that hold links in the main are teasers, if the host's leaves show an article elsewhere."""
    teasers = lambda i: "".join(f"<article class=card><h3><a href=/{n}>Story number {n}</a></h3></article>" for n in range(i + 2))
    rows = [(i, f"http://v.com/{i}", f"<body><article class=post><h1>T{i}</h1><p>Words of {i}</p></article><div>{teasers(i)}</div></body>") for i in range(4)]
    rows += [(10 + i, f"http://w.com/{i}", f"<body><div><h1>T{i}</h1><p>{f'Words of number {i} ' * 40}</p></div><div>{teasers(2)}</div></body>") for i in range(4)]
    rows += [(20 + i, f"http://x.com/{i}", f"<body><article><p><a href=/>All of it {i} is one link</a></p></article></body>") for i in range(4)]
    want = {i: f"T{i}\nWords of {i}" for i in range(4)} | {10 + i: f"T{i}\n{(f'Words of number {i} ' * 40).strip()}" for i in range(4)} | {20 + i: f"All of it {i} is one link" for i in range(4)}
    assert {k: r.text for k, r in run(spark, rows).items()} == want


def test_empty_table_and_repeats(spark):
    t = spark.createDataFrame([(1, "u", "<p>a</p>", "h", "t")] * 2, PAGES)
    assert [r.text for r in extract(t).collect()] == ["a", "a"] and extract(t.limit(0)).count() == 0


def test_a_host_with_mixed_templates(spark):
    rows = [
        (1, "http://m.com/1", page("<p>new</p>")), (2, "http://m.com/2", "<main><p>in main</p></main><div><p>beside</p></div>"),
        (3, "http://m.com/3", "<div class=post><p>older</p></div>"), (4, "http://m.com/4", "<div><a href=1>Menu one</a></div><p>plain</p>"),
        (5, None, "<article><p>no host</p></article>"), (6, None, "<p>no host, plain</p>"), (7, "http://m.com/7", "<nav>n</nav>"),
    ]
    want = {1: "new", 2: "in main", 3: "older", 4: "plain", 5: "no host", 6: "no host, plain", 7: ""}
    assert {k: r.text for k, r in run(spark, rows).items()} == want


def test_template_text_goes_outside_of_articles_alone(spark):
    """However many pages a host has: what all of them repeat stays in an article, and goes from a region of varying text."""
    rows, want = [], {}
    for n in (2, 4, 12):
        for i in range(n):
            rows.append((100 * n + i, f"http://t{n}.com/{i}", page(f"<p>By our staff</p><p>story {i}</p><p>Tell your friends</p>")))
            want[100 * n + i] = f"By our staff\nstory {i}\nTell your friends"
            rows.append((100 * n + 50 + i, f"http://r{n}.com/{i}", f"<body><div><p>By our staff</p></div><div><h2>Title {i}</h2><p>A story of {i} and more</p></div></body>"))
            want[100 * n + 50 + i] = f"Title {i}\nA story of {i} and more"
    rows += [(30 + i, "http://copies.com/", "<body><div><p>A copy of one page</p></div></body>") for i in range(12)]  # copies are one page
    rows += [(50 + i, f"http://alike.com/{i}", f"<body><div><p>All the text that these pages share</p><h2>No. {i}</h2></div></body>") for i in range(6)]  # much alike
    want |= {30 + i: "A copy of one page" for i in range(12)} | {50 + i: f"All the text that these pages share\nNo. {i}" for i in range(6)}
    assert {k: r.text for k, r in run(spark, rows).items()} == want


def test_very_deep_and_very_long_pages(spark):
    rng = random.Random(8)
    kinds = ["p", "li", "h2", "td", "dd", "pre", "blockquote"]
    mixed = lambda: "".join(f"<{k}>w{i}</{k}>" for i, k in enumerate(rng.choices(kinds, k=30_000)))
    rows = [(1, "http://deep.com/", "<div>x" * 50_000), (2, "http://deep.com/2", "<p>" + "<b>" * 50_000 + "y"), *((10 + i, f"http://long.com/{i}", f"<article>{mixed()}</article>") for i in range(2))]
    began = time.time()
    got = run(spark, rows)
    assert time.time() - began < 120
    assert set(got[1].text.split()) == {"x"} and got[2].text == "y" and all(got[10 + i].text.split("\n") == [f"w{n}" for n in range(30_000)] for i in range(2))


def test_matching_gives_opcodes():
    rng = random.Random(9)
    for n, m in ((0, 3), (3, 0), (5, 5), (900, 1000), (1000, 900)):
        a, b = rng.choices(range(9), k=n), rng.choices(range(9), k=m)
        built, i, k = [], 0, 0
        for kind, i1, i2, k1, k2 in matching(a, b):
            assert (i1, k1) == (i, k) and (kind != "equal" or a[i1:i2] == b[k1:k2])
            built += [kind] * (kind == "equal") * (i2 - i1)
            i, k = i2, k2
        assert (i, k) == (n, m) and (n < 900 or len(built) > 150)


def test_names_that_contain_a_noise_word(spark):
    rows = [
        (1, "http://n1.com/", "<div class='container has-sidebar'><article><p>one</p></article></div>"),
        (2, "http://n2.com/", "<div class='site no-sidebar'><p>two</p></div>"),
        (3, "http://n3.com/", "<div class='widget Blog'><article><p>three</p></article></div>"),
        (4, "http://n4.com/", "<article><div class='elementor-widget-container'><p>four</p></div><div class=widget><p>no</p></div></article>"),
        (5, "http://n5.com/", "<article class='category-social'><p>five</p><div class='cookie-notice'>no</div><div id=shareBar><p>bar</p></div></article>"),
        (6, "http://n6.com/", "<main><p>six</p></main><section id=comments><article><p>no</p></article></section>"),
        (8, "http://n8.com/", "<div itemprop=articleBody id=post-812><p>eight</p></div><p>no</p>"),
        (7, "http://n7.com/", "<article class='md:w-1/2 p-1.5'><p>seven</p></article><div class=Sidebar><p>no</p></div>"),
    ]
    want = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five\nbar", 6: "six", 7: "seven", 8: "eight"}
    slots = Slots()
    assert slots.path(blocks(rows[6][2], slots)[0][0]) == "div.articlebody.post-_/p"
    assert {k: r.text for k, r in run(spark, rows).items()} == want
