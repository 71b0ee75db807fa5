import random

from foliant.llm import html_wrappers as hw


def page(rng, i, body=None, wrap=("<article>", "</article>")):
    paras = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=rng.randrange(5, 20))) for _ in range(rng.randrange(1, 6))]
    own = body if body is not None else f"<h1>Title {i}</h1>" + "".join(f"<p>{p} &amp; {i}</p>" for p in paras)
    want = "\n\n".join([f"Title {i}", *(f"{p} & {i}" for p in paras)])
    return (
        f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        f'<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav><!-- ad --><div class="ad">Buy {i}</div>'
        f'<div class="cookie-notice">We use cookies</div>{wrap[0]}{own}<p>All rights of this text are reserved here.</p>{wrap[1]}'
        f'<aside>more {i}</aside><section id="comments"><article class="comment">nice {i}</article></section><form><p>Send</p></form>'
        f"<footer>&copy; site {i}</footer></body></html>",
        want,
    )


def test_named_parts_go_and_template_texts_inside_the_article():
    rng = random.Random(1)
    # The reserved-rights line stands outside the repeated paragraphs only if the article ends differently.
    for wrap in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>")):
        html, want = page(rng, 7, wrap=wrap)
        assert hw.main_text(html) == want + "\n\nAll rights of this text are reserved here."


def test_wrapper_has_slots_optional_and_repeated_groups():
    a = hw.stream(hw.parse("<div><b>Name</b><p>x</p><p>y</p></div>"))
    b = hw.stream(hw.parse("<div><b>Name</b><i>maybe</i><p>z</p></div>"))
    ((name, pages, repeated, optional, kids),) = hw.align(a, b)
    assert (name, pages, repeated, optional) == ("div", 2, False, False)
    assert [(k[0], k[2], k[3]) for k in kids] == [("b", False, False), ("i", False, True), ("p", True, False)]
    assert kids[0][4] == [["#", 2, False, False, hw._hash("Name"), 8]] and kids[2][4][0][4] == 0
    ab = hw.stream(hw.parse("<dl><dt>1</dt><dd>2</dd><dt>3</dt><dd>4</dd></dl>"))
    assert [(k[0], k[2]) for k in ab[0][4]] == [("dt", True), ("dd", True)]


def test_template_without_named_elements():
    pages = [f"<body><div><span>Welcome to the site</span></div><div><h2>Story {i}</h2><p>Text {i} of its own.</p></div><div><span>Made by us</span></div></body>" for i in range(5)]
    wrapper = []
    for p in pages:
        wrapper = hw.combine(wrapper, hw.stream(hw.parse(p))) if wrapper else hw.stream(hw.parse(p))
    assert hw.main_text(pages[2], wrapper) == "Story 2\n\nText 2 of its own."
    assert "Welcome" in hw.main_text(pages[2])


def test_copies_of_one_page_keep_their_text():
    body = "<h1>One title</h1><p>First.</p><p>{}</p>"
    for wrap in ("<article>{}</article>", "<div>{}</div>"):
        pages = [f"<body><nav>Home</nav>{wrap.format(body.format(x))}</body>" for x in ("Second.", "Second.", "Second!", "Second.")]
        wrapper = hw.stream(hw.parse(pages[0]))
        for p in pages[1:]:
            wrapper = hw.combine(wrapper, hw.stream(hw.parse(p)))
        if "article" in wrap:
            assert hw.main_text(pages[0], wrapper) == "One title\n\nFirst.\n\nSecond."
    same = hw.stream(hw.parse(pages[0]))
    for _ in range(4):
        same = hw.combine(same, hw.stream(hw.parse(pages[0])))
    assert hw.main_text(pages[0], same).endswith("First.\n\nSecond.")


def test_small_parts_that_are_named_content():
    page = "<body><div class='post-meta content'>by me</div><div><p>A long text of the page itself.</p></div><p style='display: none'>no</p><p hidden>no</p></body>"
    assert hw.main_text(page) == "by me\n\nA long text of the page itself."
    assert hw.main_text("<body><div id='main'><p>Long text of the page.</p></div><div>small</div></body>") == "Long text of the page."


def test_broken_markup():
    for html, want in [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<article><p>a<p>b<b>c<br>d</article>", "a\n\nbc d"),
        ("<article><h1>A &lt;b&gt; &amp &#233;</h1><p>x<!-- no </p>", "A <b> & é\n\nx"),
        ("<article><p class='ad'>buy<p>keep", "keep"),
        ("<article><div title='a > b'>in</div></div></p>out</article>", "in\n\nout"),
        ("<div class='content-with-sidebar'><p>kept</p></div>", "kept"),
        ("<div class='menu'><p>only this</p></div>", "only this"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2\n\n3"),
        ("<script>x", ""),
        ("<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>", "deep"),
        ("<article>a < b and c > d</article>", "a < b and c > d"),
    ]:
        assert hw.main_text(html) == want, html


def test_operator(spark):
    rng, rows, want = random.Random(2), [], {}
    for i in range(60):
        html, text = page(rng, i)
        rows.append((i, f"http://host{i % 3}.org/{i}", html))
        want[i] = text + "\n\nAll rights of this text are reserved here."
    rows += [(100, None, rows[0][2]), (101, "http://[bad", rows[1][2]), (102, "http://x.org", None), (103, "http://x.org", ""), (None, "http://host0.org/", rows[0][2]), (5, *rows[5][1:])]
    want |= {100: want[0], 101: want[1], 102: "", 103: "", None: want[0]}
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(6)
    got = hw.extract_main_text(frame).collect()
    assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert hw.infer_wrappers(frame).count() == 4
    assert hw.extract_main_text(frame.limit(0)).collect() == []


def test_long_attribute_values():
    for n in (100, 5000, 300_000):
        assert hw.main_text(f"<body><p>kept</p><div data-x=\"{'a' * n}<b>k</b> v > w\" class='menu'>text</div></body>") == "kept"
        assert hw.main_text(f"<body><p title='{'a' * n} > b'>kept</p></body>") == "kept"


def test_deep_nesting_keeps_what_follows_and_leaves_noise_out():
    for n in (70, 5000):
        deep = "<div>" * n + "<p>deep</p><nav>menu</nav><div class='ad'>buy</div>" + "</div>" * n
        page = f"<body><div id=page><article><h1>T</h1>{deep}<p>after</p></article></div><p>outside</p></body>"
        assert hw.main_text(page) == "T\n\ndeep\n\nafter"
        wrapper = hw.stream(hw.parse(page))
        for _ in range(3):
            wrapper = hw.combine(wrapper, hw.stream(hw.parse(page)))
        assert hw.dumped(hw.loaded(hw.dumped(wrapper))) == hw.dumped(wrapper) and hw._size(wrapper) > n
        assert hw.main_text(page, hw.loaded(hw.dumped(wrapper))) == "T\n\ndeep\n\nafter"


def test_large_hosts_keep_their_template():
    slug = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    make = lambda i: f"<body><div id='{slug(i)}'><span>Welcome to the site</span><div>" + "".join(f"<div class='{slug(i)}-{slug(j)}'><b>x</b></div>" for j in range(10)) + f"<p>Text {i}.</p></div><span>Made by us</span></div></body>"
    wrapper = hw.stream(hw.parse(make(0)))
    for i in range(1, 400):
        wrapper = hw.combine(wrapper, hw.stream(hw.parse(make(i))))
    assert hw._size(wrapper) <= hw.RARE * hw.MAX_NODES and wrapper[0][1] == 400
    found = hw.main_text(make(7), wrapper)
    assert "Text 7." in found and "Welcome" not in found and "Made by us" not in found


def neutral_pages():
    """Pages without names for their parts: a notice longer than most articles stands on every page of the host."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    notice, rows, want = " ".join(word() for _ in range(120)), [], []
    for i in range(40):
        paragraphs = [" ".join(word() for _ in range(rng.randrange(5, 20))) for _ in range(rng.randrange(1, 6))]
        title = " ".join(word() for _ in range(4))
        menu = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(5))
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<html><body><div class=x1><ul>{menu}</ul></div><div class=x2><p>{notice}</p></div><div class=x3><h2>{title}</h2>{body}</div><div class=x4><span>{word()}</span></div></body></html>"
        rows.append((i, f"http://n.example.org/{i}", page))
        want.append("\n\n".join([title, *paragraphs]))
    return rows, want


def test_the_wrapper_finds_the_article(spark):
    rows, want = neutral_pages()
    assert sum(hw.main_text(page) != w for (_, _, page), w in zip(rows, want, strict=True)) > 30  # without the host's wrapper
    for parts in (1, 4, 32):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in hw.extract_main_text(pages).collect()}
        assert [got[i] for i in range(len(want))] == want


def test_alignment_matches_every_page_of_the_host():
    """Brute force: every page's tokens, folded, are matched one by one by the wrapper's nodes, none left over."""
    rng = random.Random(6)
    for _ in range(30):
        pages = ["".join(f"<{t}>{rng.choice(['x', 'y', ''])}</{t}>" for t in rng.choices(["p", "ul", "div", "b"], k=rng.randrange(1, 7))) for _ in range(5)]
        wrapper = hw.stream(hw.parse(pages[0]))
        for page in pages[1:]:
            wrapper = hw.align(wrapper, hw.stream(hw.parse(page)))

        def matches(names, nodes):
            """Whether the names are a word of the union-free expression, by trying all its readings."""
            if not nodes:
                return not names
            n, rest = nodes[0], nodes[1:]
            if n[3] and matches(names, rest):
                return True
            if names and names[0] == n[0]:
                return matches(names[1:], rest) or n[2] and matches(names[1:], nodes)
            return False

        for page in pages:
            own = hw.stream(hw.parse(page))
            assert matches([n[0] for n in own], wrapper), (page, wrapper)


def test_rare_groups_of_large_hosts_stay_in_the_wrapper(spark):
    """A notice on four of 400 pages is template; it stands between groups that no other page shows."""
    slug = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    extra = "<div class='extra'><span>On four pages of all</span></div>"
    make = lambda i: "<body><div><span>Welcome</span><div>" + "".join(f"<div class='{slug(i)}-{slug(j)}'><b>x</b></div>" for j in range(10)) + f"<p>Text {i} of its own, long enough to count.</p>{extra if i % 100 == 7 else ''}</div></div></body>"
    wrapper = hw.stream(hw.parse(make(0)))
    for i in range(1, 400):
        wrapper = hw.combine(wrapper, hw.stream(hw.parse(make(i))))
    assert "On four pages" not in hw.main_text(make(7), wrapper)
    names = {n[0] for n in wrapper[0][4][0][4][1][4]}
    assert names == {"p", "div extra", *(f"div {slug(i)}-{slug(j)}" for i in range(400) for j in range(10))}
    rows = [(i, f"http://{'large' if i % 8 else 'small'}.org/{i}", make(i)) for i in range(400)] + [(None, None, make(7)), (5, "http://large.org/5", make(5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    both = [sorted(map(str, hw.extract_main_text(pages, carried=n).collect())) for n in (0, 1500, 10**9)]
    assert both[0] == both[1] == both[2] and len(both[0]) == 402
    assert sum("On four pages" in r for r in both[0]) == 1  # the page without a host
