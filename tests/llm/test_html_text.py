import random
import time

from pyspark.sql import functions as F

from slotweave.llm.html_text import extract_main_text, main_text

PROSE = "The cat is on the mat and it was here. " * 9


def test_article_with_everything_around_it():
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><p>Site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies on this site and you agree to it.</div><div class="ad">Buy</div><article><header><h1>T &amp; &eacute;</h1></header><p>The  first\n<b>part</b> of<br>it.'
        '<p>Er.</p><aside><p>Side</p></aside><form><label>Mail</label></form><ul><li>one</li><li>two &lt;3</li></ul><!-- <p>gone</p> --><div id="comments"><p>' + PROSE + "</p></div><p>End"
        "</article><section class='sidebar'><p>" + PROSE + "</p></section><footer>&copy; me</footer></body></html>"
    )
    assert main_text(page) == "T & é\nThe first part of it.\nEr.\none\ntwo <3\nEnd"


def test_rules_without_an_article_element():
    page = '<div class="wrap"><ul><li><a href="x">Home</a></li></ul><h1>Title</h1><p>' + PROSE + '</p><p>Short.<p>Also short<div class="footer">Copyright</div><p>alone</p></div>'
    assert main_text(page) == "Title\n" + PROSE.strip() + "\nShort.\nAlso short"
    assert main_text("<p>" + "qwx zrt " * 30 + "</p><p>" + PROSE + "</p><p>" + "qwx zrt " * 30 + "</p><footer>x</footer>") == PROSE.strip()
    russian, japanese = "Кошка лежала на ковре и смотрела в окно. " * 8, "猫は窓辺の敷物の上で静かに眠っていた。" * 14
    for prose in (russian, japanese):
        page = f"<nav><a href=x>{prose}</a></nav><div><h2>{prose[:6]}</h2><p>{prose}</p><p><a href=y>{prose}</a></p><p>{prose[:9]}</p></div><footer>{prose}</footer>"
        assert main_text(page) == "\n".join(x.strip() for x in (prose[:6], prose))  # the last short block has a link before it and the end behind


def test_quotes_in_unquoted_values_take_no_text():
    assert main_text("<article><img alt=it's><p>text don't lose</p><p>tail</p></article>") == "text don't lose\ntail"
    assert main_text("<article><p title= 'a>b' data-x=\"c>d\" e=f'g>one</p><p x='>two</p></article>") == "one\ntwo"
    assert main_text('<article><p a"b>one</p><p =">two</p><i x=\'y\'/>three</article>') == "one\ntwo\nthree"


def test_rules_against_a_second_reading():
    """Random trees of known blocks: what is kept follows from each block's own marks and its neighbours, worked out apart."""
    rnd = random.Random(8)
    prose, middle, other = PROSE.strip(), "the cat is on the mat and it was here for the day of our lord it", "qwx zrt " * 30
    for _ in range(400):
        made = [(rnd.choice(["long", "mid", "other", "short", "link", "nav", "mark"]), k) for k in range(rnd.randrange(1, 9))]
        html, labels, texts = "", [], []
        for kind, k in made:
            text = {"long": f"{prose} {k}", "mid": f"{middle} {k} {middle[:20]}", "other": f"{other}{k}", "short": f"Short {k}", "link": f"link {k} {middle}", "nav": f"nav {k} {prose}", "mark": f"mark {k} {prose}"}[kind]
            html += {"link": f"<p><a href=x>{text}</a></p>", "nav": f"<nav><p>{text}</p></nav>", "mark": f'<div class="promo-box"><p>{text}</p></div>'}.get(kind, f"<p>{text}</p>")
            labels.append({"long": "good", "mid": "near", "short": "short"}.get(kind, "bad"))
            texts.append(" ".join(text.split()))
        if not {"long", "mid"} & {kind for kind, _ in made}:
            continue
        decided = {"good": True, "near": True, "bad": False}
        left = lambda k: next((decided[x] for x in reversed(labels[:k]) if x != "short"), False)
        right = lambda k: next((decided[x] for x in labels[k + 1 :] if x != "short"), False)
        keep = [x == "good" or x in ("near", "short") and (left(k) or right(k)) for k, x in enumerate(labels)]
        assert main_text(html) == "\n".join(t for t, k in zip(texts, keep) if k), made


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<article><p>a & b &am</p><p title='x>y'>c</p>" + "<p>word</p>" * 20000), (5, "u", "<article>plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    assert got[1] == ("u", "", 0) and got[2] == (None, "", 0) and got[3] == ("u", "", 0)
    assert got[4][1] == "\n".join(["a & b &am", "c", *["word"] * 20000]) and got[5] == ("u", "plain", 5)
    assert extract_main_text(pages.unionAll(pages)).count() == 10 and extract_main_text(pages.limit(0)).count() == 0


def test_broken_markup_stays_linear():
    began = time.time()
    for page in ("<b>" * 20000 + "</i>" * 20000, "<b>" * 20000 + "<p>x</p>" * 20000, "<b>" * 20000 + "<script>x</script>" * 20000, "<svg>" + "<b>" * 20000 + "</i>" * 20000, "<" * 100000, "<a b='" * 3000, "<p " + "x" * 200000, "&" * 100000, "<div>" * 20000):
        main_text(page)
    assert time.time() - began < 20


def test_elements_without_an_end_tag_take_no_more_than_their_parent():
    for head in ("<head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=x><title>T<body>", "<head class='nav'><title>T</title></head>", "<head><style>p{}</style></head><body>", "<head>"):
        assert main_text(f"<html>{head}<article><p>One</p><p>Two</p></article></html>") == "One\nTwo", head
    for tag in ("object", "select", "svg", "video", "title", "iframe"):
        for rest in ("", f"<footer><{tag}>x</{tag}></footer>" if tag not in ("title", "iframe") else ""):
            assert main_text(f"<body><article><p>One</p><div><{tag} a=b>gone<b>gone</b></div><p>Two</p></article>{rest}</body>") == "One\nTwo", (tag, rest)
    assert main_text("<article><p>One</p><object><object>a</object>b</object><p>Two</p></article>") == "One\nTwo"
    assert main_text("<article><p>One</p><script>'</article>'</script><p>Two</p></article>") == "One\nTwo"
    began = time.time()
    for page in ("<b><title></b>" * 20000, "<object>" * 20000, "<p><svg></p>" * 20000, "<svg><title>" * 10000):
        main_text(page)
    assert time.time() - began < 20


def test_linked_headings_and_paragraphs_of_an_article_stay():
    page = '<nav><p><a href="/">Home</a></p></nav><article><h1><a href="x">Title</a></h1><p>Text of it.</p><p><a href="y">All of this is a link</a></p><ul><li><a href="z">Menu</a></li></ul></article><p><a href="w">More</a></p>'
    assert main_text(page) == "Title\nText of it.\nAll of this is a link"


def test_marks_on_frames_lose_no_article():
    comments = "".join(f"<p>{PROSE} says reader {k}.</p>" for k in range(2))
    inner = f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article>"
    want = f"Title\n{PROSE.strip()}\nShort."
    for page in (
        f'<div class="layout has-sidebar">{inner}</div>', f'<form id="aspnetForm">{inner}</form>', f'<div class="content no-ads">{inner}</div>', f'<div id="pageHeader-menu"><div class="sidebar-left">{inner}</div></div>',
        f'<article class="post share">{inner[9:]}', f'<div class="has-sidebar">{inner}<div class="sidebar"><p>{PROSE}</p></div></div>',
        f'<div class="has-sidebar"><article>{inner[9:-10]}<ol class="commentlist"><li>{comments}</li></ol></article></div>', f'<article>{inner[9:-10]}<article class="comment">{comments}</article></article>',
        f'<article>{inner[9:-10]}<div class="userComments">{comments}</div></article>', f'<div class="no-ads"><h1>Title</h1><p>{PROSE}</p><p>Short.</p><div class="related"><p>{PROSE}</p></div></div>',
        f'<form><h1>Title</h1><p>{PROSE}</p><p>Short.</p><footer>x</footer></form>', f'<div class="has-sidebar"><main><p>Only short.</p></main><p class="ad">{PROSE}</p></div>',
    ):
        assert main_text(page) == (want if "Only" not in page else "Only short."), page
