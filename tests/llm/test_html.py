from palimpsest.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="masthead"><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now and save much money today.</div><div class='cookie-notice'>We use cookies here.</div>
<article><h1>The  title &amp; more</h1><p><b>First para&shy;graph of the story with words.<br><p>Second <a href="x">linked</a> para&#103;raph &lt;here&gt; is a longer one.</p>
<form><input name=q> Search this site <button>Go</button></form><aside>Related: other things to read</aside><ul><li>one point</li><li>two points</li></ul>
<div id="comments"><p>Reader says: nice article, I liked it so much.</p></div><p>Last words of it all.</p></article>
<footer>&copy; site &middot; imprint</footer></body></html>"""
TEXT = "The title & more\n\nFirst para\xadgraph of the story with words.\n\nSecond linked paragraph <here> is a longer one.\n\none point\n\ntwo points\n\nLast words of it all."


def best_sum(scores):
    return max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)


def test_extract():
    for weight in (h.DEFAULTS, h.weights([PAGE] * 30)):
        assert h.extract(PAGE, weight) == TEXT
        assert h.extract(PAGE.replace("<article>", "<div>").replace("</article>", "</div>"), weight) == TEXT
        assert h.extract(PAGE.partition("Last words")[0] + "Last words of it all.", weight) == TEXT


def test_odd_markup():
    assert h.extract(None, h.DEFAULTS) == h.extract("", h.DEFAULTS) == h.extract("<p></p><script>x", h.DEFAULTS) == ""
    assert h.extract("plain words < 3 & more", h.DEFAULTS) == "plain words < 3 & more"
    assert h.extract("<p>one two three <a title='x", h.DEFAULTS) == "one two three"
    assert h.extract("<p>one two three <a title='x>y", h.DEFAULTS) == "one two three y"  # a quote that never ends
    assert h.extract("<p>a&nbsp; b\tc<p>d e f", h.DEFAULTS) == "a b c\n\nd e f"
    long = "<p>" + "word " * 100_000 + "</p>" + "<div>" * 20_000
    assert h.extract(long, h.DEFAULTS) == ("word " * 100_000).strip()


def test_region_is_the_best():
    import random

    rnd = random.Random(2)
    some = 0
    for _ in range(300):
        page = "".join(rnd.choice(["<p>a b</p>", "<p>c <a>d e</a> f</p>", "<div>", "</div>", "<nav>x y</nav>", "<li><a>z</a></li>", "g ", "<b>h</b>"]) for _ in range(12))
        weight = {k: rnd.choice([0.25, 0.5, 1, 2]) * (1 if v > 0 else -1) for k, v in h.DEFAULTS.items()}
        scores, where, blocks = h.scored(page, weight)
        a, b = h.best_region(scores)
        assert sum(scores[a:b]) == max(0, best_sum(scores))
        spans = [(x, y) for x in range(len(scores)) for y in range(x + 1, len(scores) + 1) if sum(scores[x:y]) == sum(scores[a:b]) > 0]
        assert not spans or b == min(y for _, y in spans)
        want = [" ".join("".join(blocks[i]).split()) for i in sorted({*range(where[a], where[b - 1] + 1)} if a < b else ())]
        assert h.extract(page, weight) == "\n\n".join(x for x in want if x)
        some += a < b
    assert some > 200


def test_scores_are_those_of_single_words():
    import random

    rnd = random.Random(3)
    for _ in range(100):
        page = "".join(rnd.choice(["<p>a b</p>", "<p>c d e</p>", "<h2>t u</h2>", "<div>", "</div>", "<b>h</b>"]) for _ in range(8))
        weight = {k: rnd.choice([0.25, 0.5, 1, 2]) * (1 if v > 0 else -1) for k, v in h.DEFAULTS.items()}
        flat = [weight[k] for k, t, _ in h.events(page) if k != "break" for _ in range(len(t.split()) if k.startswith("word") else 1)]
        scores = h.scored(page, weight)[0]
        a, b = h.best_region(scores)
        assert sum(scores[a:b]) == max(0, best_sum(flat))


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", PAGE, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = h.extract_pages(pages, h.fit(pages), keep=["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, TEXT, len(TEXT))] * 2 + [(0, TEXT, len(TEXT)), (2, "", 0), (3, "", 0)])
    assert h.fit(pages.limit(0)) == h.DEFAULTS and h.extract_pages(pages.limit(0), h.DEFAULTS, keep=["page_id"]).count() == 0


def test_elements_without_an_end_lose_no_text():
    body = "<article><p>First words of the story.</p><p>Last words of it all.</p></article>"
    want = "First words of the story.\n\nLast words of it all."
    for name in ("button", "canvas", "object", "svg", "select", "noscript", "template"):
        for lead in (f"<{name}>", f"<div><{name}></div>", f"<{name}><script>'</{name}>'</script><!-- </{name}> -->", f"<{name} x=\"</{name}>\">"):
            assert h.extract(lead + body, h.DEFAULTS) == want
            assert h.extract(lead + body + f"<{name}>Go</{name}>", h.DEFAULTS) == want
        assert h.extract(f"<{name}>Go <b>on</b></{name}>" + body, h.DEFAULTS) == want
        assert h.extract(f"<{name}>a<{name}>b</{name}>c</{name}>" + body, h.DEFAULTS) == want
    for lead in ("<datalist><option>a<option>b</datalist>", "<option>a<option>b", "<select><option>a<option>b</select>"):
        got = h.extract(lead + body, h.DEFAULTS)
        assert got.endswith(want)
    assert h.extract("<p>so <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds here</p>", h.DEFAULTS) == "so x = 2 holds here"
    assert h.extract("<p>one</p><script>x <p>two</p>", h.DEFAULTS) == "one"
    long = "<button>" * 20_000 + "<p>" + "word " * 1000
    assert h.extract(long, h.DEFAULTS).endswith("word word")
