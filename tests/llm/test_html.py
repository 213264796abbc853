import random

from tablediff.llm import html

SCHEMA = "page_id long, url string, html string, text string, rule string, host string"


def page(rnd, k):
    word = lambda: f"w{rnd.randrange(5000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    blocks = [text(4), *[text(rnd.randrange(5, 40)) for _ in range(rnd.randrange(1, 5))]]
    body = "".join(f"<P class=x>{b}\n</P>" if i % 2 else f"<p>{b.replace(' ', '&nbsp;<br>', 1)}" for i, b in enumerate(blocks[1:]))
    optional = f"<div class='related-posts'><p>{text(30)}</p></div>" if k % 2 else ""
    return (
        f"<!doctype html><head><title>T {k}</title><script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style></head><body>"
        f"<header><h2>Site {text(2)}</h2></header><div id=menu><a href='/'>{text(6)}</a></div><!-- <p>hidden</p> -->"
        f"<div id=wrap{k}><div class='content col-{k}'><h1>{blocks[0]}</h1><div class=by>By our own staff</div>{body}{optional}"
        f"<form><p>{text(20)}<input name=q></form><aside>{text(50)}</aside><div class='ad box'>{text(9)}</div>"
        f"<section class='user comments'><p>{text(80)}</p></section></div></div><footer>{text(60)}</footer></body>",
        "\n\n".join(blocks),
    )


def test_same_host_pages(spark):
    rnd = random.Random(10)
    made = [page(rnd, k) for k in range(12)]
    rows = [(k, f"http://Host.example/{k}", h, "t", "r", "h") for k, (h, _) in enumerate(made)]
    odd = {
        100: ("http://a/1", None, ""), 101: (None, "<p>one &lt;b&gt;<p>two", "one <b>\n\ntwo"), 102: ("not a url", "", ""),
        103: ("http://b/", "plain & simple &amp", "plain & simple &"), 104: ("http://c/", "<article><h1>A</h1>b<article>c", "A\n\nb\n\nc"),
        105: ("http://d/", "<ul><li>x<li>y</ul><p <broken", "x\n\ny\n\n<p <broken"), 106: ("http://e/", "<main>é&#233;&eacute;<!-- open", "ééé"),
        107: ("http://f/", "<body><main><header><h1>In</h1></header>x</main><header>out</header>", "In\n\nx"),
        108: ("http://g/", "<p>a</p>" * 5000, "\n\n".join("a" * 5000)), 109: ("http://h/", "<table><tr><td>1<td>2</tr><tr><td>3</table>", "1 2\n\n3"),
    }
    rows += [(k, u, h, "t", "r", "h") for k, (u, h, _) in odd.items()] + [(None, None, "<p>no id", None, None, None)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got = html.extract(df).collect()
    assert len(got) == len(rows) + 1
    expected = {k: t for k, (_, t) in enumerate(made)} | {k: t for k, (_, _, t) in odd.items()} | {None: "no id"}
    for r in got:
        assert r.text == expected[r.page_id], r.page_id
        assert r.n_chars == len(r.text)


def test_wrappers():
    a = "<div><h1>x</h1><p>one<p>two<p>three<div class=f>same foot</div></div>"
    b = "<div><h1>y</h1><p>four<div class=f>same foot</div><b>extra</b></div>"
    wrapper = html.infer([a, b])
    assert [(wrapper.elements[n.key][1], n.value, n.repeated, n.optional) for n in wrapper.nodes] == [
        ("h1", None, False, False), ("p", None, True, False), ("div.f", html.digest("same foot"), False, False), ("b", html.digest("extra"), False, True),
    ]
    assert html.rule(html.infer([a] * 6))["fixed"] == []  # copies tell nothing
    pages = [a.replace("x", f"title {k}").replace("one", f"text {k}") for k in range(3)]
    assert [v for _, v in html.rule(html.infer(pages))["fixed"]] == [html.digest("same foot")]
    again = html.Wrapper.loads(wrapper.dumps())
    assert again == wrapper


def test_order_of_pages_does_not_matter():
    rnd = random.Random(14)
    pages = [page(rnd, k)[0] for k in range(30)]
    first = html.rule(html.infer(pages))
    for _ in range(3):
        rnd.shuffle(pages)
        parts = [html.infer(pages[i::4]) for i in range(4)]
        whole = html.Wrapper()
        for part in parts:
            whole.add(part)
        assert html.rule(whole) == first


def test_wrappers_decide():
    rnd = random.Random(15)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    made = []
    for _ in range(6):
        blocks = [text(4), text(30), text(40), text(25)]
        made.append((
            "<body><div class=top><a href=/>Home</a> <a href=/x>All of it</a></div><div class=outer><div class=post><h2>%s</h2>"
            "<div class=body><p>%s<p>%s</div><p>%s</p><span>Read more here</span></div></div><div class=end>Made by us, all rights kept</div></body>" % tuple(blocks),
            "\n\n".join(blocks),
        ))
    found = html.rule(html.infer([h for h, _ in made]))
    for h, expected in made:
        assert html.article(h, found) == expected  # the lead and the last part beside the body stay
        assert html.article(h) != expected  # without a wrapper the menu and the end are text
    # A class that names a side matter is none where it holds the text, and is one where it does not.
    for name, rest in (("comments", "<div class=main>short</div>"), ("main", f"<div class=comments>{text(9)}</div>")):
        pages = [f"<body><div class={name}><p>{t}</p></div>{rest}</body>" for t in (text(60), text(50), text(70))]
        found = html.rule(html.infer(pages))
        for p in pages:
            assert p[p.index("<p>") + 3 : p.index("</p>")] in html.article(p, found)
    for odd in ("<article><section class=social-science><p>kept</p></section></article>", "<article><div id=form><p>kept</p></div></article>"):
        assert html.article(odd, html.rule(html.infer([odd]))) == "kept"


def test_notices_go_whatever_their_length_and_element():
    rnd = random.Random(18)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    for n in (3, 12, 13, 60):
        for notice in (f"<div class=x>{text(n)}</div>", f"<p class=x># {text(n)}</p>", f"<li>{text(n)}</li>"):
            made = [(text(30), text(20)) for _ in range(8)]
            pages = [f"<body><div class=story><h1>{a}</h1>{notice}<p>{b}</p></div></body>" for a, b in made]
            found = html.rule(html.infer(pages))
            assert [html.article(p, found) for p in pages] == [f"{a}\n\n{b}" for a, b in made]
    quoted = [f"<body><div class=story><h1>{text(5)}</h1>{'<p class=q>the same words</p>' * (k < 2)}<p>{text(9)}</p></div></body>" for k in range(8)]
    assert "the same words" in html.article(quoted[0], html.rule(html.infer(quoted)))


def test_templates_of_a_host_are_apart(spark):
    rnd = random.Random(16)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    rows, expected = [], {}
    for k in range(12):
        own = text(40)
        if k % 4:
            h = f"<body><div class=story><div class=x><p>{own}</p></div></div></body>"
        else:  # a rarer one, with a teaser where the others have their text
            h = f"<body><div class=long><p>{own}</p></div><div class=story><div class=x><a href=/>a teaser {k}</a></div></div></body>"
        rows.append((k, "http://one.example/", h, None, None, None))
        expected[k] = own
    got = html.extract(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert all(expected[r.page_id] in r.text for r in got)


def test_deep_and_broken_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for odd in ("<div>" * 30_000 + "x" + "</p>" * 30_000, "<div>y" * 20_000, "<b>z<i>" * 10_000 + "</u>" * 10_000, "<p><a href='" * 20_000, "<!--" * 20_000):
        html.rule(html.infer([odd, odd + "w"]))
        html.article(odd)
    assert time.perf_counter() - began < 20


def test_empty(spark):
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0
