"""Main text: pages built from known articles, odd markup, and template classes against whole vectors."""

import random

from pyspark.sql import functions as F

from opsmetrics.llm.html_text import (
    _OUTLINES, Outline, Roles, _outlines, check_pages, deduce, extract, main_text, outline, page_counts, page_tokens, plain, read, settle, settled_templates,
    squeeze, templates)

SCHEMA = "page_id bigint, url string, html string, text string"


def page(host, i, pick, named=True):
    words = ["alpha", "beta", "caf&eacute;", "a &amp; b", "1 &lt; 2", "delta", "x&#39;y", "naïve"]
    blocks = [" ".join(pick.choices(words, k=pick.choice([1, 8, 60]))) for _ in range(pick.choice([1, 3, 6]))]
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in pick.sample(words, 3))
    body = "".join(f"<p>{b.replace(' ', '  ', 1)}" if pick.random() < 0.5 else f"<p><b>{b}</b>\n</p>" for b in blocks)
    box = "article" if named else "div class='text'"
    html = (f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>"
            f"<header>Site {host}</header><nav><ul>{menu}</ul></nav><!-- <p>hidden</p> --><div class=\"ad top\">Buy {i}</div>"
            f"<aside>Side {i}</aside><{box}><h1>Head {i}</h1>{body}<div class='share-box'>Share</div></{box.split()[0]}>"
            f"<section id=comments><p>Nice {i}</p></section><form><input><button>Go</button></form><footer>&copy; {host}</footer>")
    if pick.random() < 0.8:
        html += "</body></html>"
    return html, " ".join(squeeze(x) for x in [f"Head {i}", *blocks])


def test_pages(spark):
    pick = random.Random(10)
    rows, want = [], {}
    for i in range(60):
        host = pick.choice(["a.org", "b.org", "b.org", "lonely%d.org" % i])
        html, text = page(host, i, pick)
        rows.append((i, f"http://{host}/{i}", html, "clash"))
        want[i] = text
    for i in range(100, 130):  # an element that no name marks, known only from its text
        html, text = page("plain.org", i, pick, named=False)
        rows.append((i, f"http://plain.org/{i}", html, None))
        want[i] = text
    rows += [(900, None, None, None), (901, "", "", None), (None, "x", "just words", None), (903, "http://a.org/", "<article>" + "w " * 90_000, None)]
    rows += [(950, "http://copies.org/", "<article><p>Same text</p></article>", None)] * 40
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    wrong = [i for i in want if by_id[i]["text"] != want[i]]
    assert not wrong, (by_id[wrong[0]]["text"], want[wrong[0]])
    assert by_id[900]["text"] == by_id[901]["text"] == "" and by_id[None]["text"] == "just words"
    assert by_id[903]["text"] == ("w " * 90_000).strip() and by_id[950]["text"] == "Same text"
    assert all(r["n_chars"] == len(r["text"]) for r in got) and by_id[900]["url"] is None


def test_classes_are_those_of_whole_vectors(spark):
    pick = random.Random(11)
    pages = [page("h", i, pick)[0] for i in range(12)]
    rows = [("h", i, t, n, 0) for i, p in enumerate(pages) for t, n in page_tokens(p)[0].items()] + [("h", i, "", 1, 0) for i in range(12)]
    found = templates(spark.createDataFrame(rows, "host string, page bigint, token string, n bigint, chars bigint").repartition(3)).first()
    vectors = {}
    for _, i, t, n, _ in rows:
        vectors.setdefault(t, [0] * 12)[i] = n
    got, want = {}, {}
    for e in found["template"]:
        got.setdefault(e["class"], set()).add(e["token"])
    for t, v in vectors.items():
        if t and sum(x > 0 for x in v) >= 6:
            want.setdefault(tuple(v), set()).add(t)
    assert found["host_pages"] == 12
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def entries_of(pages):
    """The template's entries by whole vectors."""
    vectors, chars = {}, {}
    for i, p in enumerate(pages):
        counts, sizes = page_tokens(p)
        for t, n in counts.items():
            vectors.setdefault(t, [0] * len(pages))[i] = n
            chars[t] = chars.get(t, 0) + sizes.get(t, 0)
    held = {t: v for t, v in vectors.items() if sum(x > 0 for x in v) >= max(2, len(pages) / 2)}
    return [{"token": t, "class": hash(tuple(v)), "pages": sum(x > 0 for x in v), "total": sum(v), "chars": chars[t]} for t, v in held.items()]


def texts_of(spark, pages):
    got = main_text(spark.createDataFrame([(i, "http://h.org/", p, "") for i, p in enumerate(pages)], SCHEMA).repartition(3)).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_slots_decide_where_an_article_element_holds_template(spark):
    """Without the template the article element, which is the same on all pages, would be the text."""
    for n in (2, 3, 9, 10, 12):
        pages = [f"<body><article><p>Join our club</p></article><div class='w-1/2|x'><p>{words(i, 30)}</p></div></body>" for i in range(n)]
        assert texts_of(spark, pages) == [words(i, 30) for i in range(n)]
        assert texts_of(spark, pages) == [extract(p, deduce(entries_of(pages))) for p in pages]
        assert extract(pages[0]) == "Join our club"


def test_article_elements_at_any_depth(spark):
    assert extract("<article><p>one</p></article><div><article><p>two</p></article></div>") == "one two"
    pages = [f"<article class='a'><p>{words(i, 20)}</p></article><div><div><article class='b'><p>{words(-i - 1, 9)}</p></article></div></div>"
             "<article class='club'><p>Join us</p></article>" for i in range(6)]
    assert texts_of(spark, pages) == [f"{words(i, 20)} {words(-i - 1, 9)}" for i in range(6)]


def test_page_numbers_change_nothing(spark):
    for n in (1, 2, 9, 10, 11):
        pages = [f"<body><p>Every page of this site says so</p><p>text {i}</p></body>" for i in range(n)]
        assert texts_of(spark, pages) == [f"Every page of this site says so text {i}" for i in range(n)]


def test_names_mark_by_what_they_name(spark):
    assert extract("<article><div class='widget-text'><p>real body text</p></div><p>more</p></article>") == "real body text more"
    assert extract("<article><section class='related-work'><p>text</p></section></article>") == "text"
    assert extract("<article><p>text</p><p class='ad'>buy</p><div class='ad-box'>buy</div><div class='main-menu'>x</div></article>") == "text"
    assert extract("<article><p>text</p><div class='comment-list'><p>nice</p></div></article>") == "text"
    # A box of the slot whose paragraphs vary over the host is text whatever its name; one that does not is none.
    pages = [f"<article><p>{words(i, 20)}</p><div class='notice'><p>{words(-i - 1, 9)}</p></div><div class='sidebar'><p>Of us</p></div>"
             f"<div class='ads'><p>Buy {i}</p></div></article>" for i in range(5)]
    assert extract(pages[0]) == words(0, 20)
    assert texts_of(spark, pages) == [f"{words(i, 20)} {words(-i - 1, 9)}" for i in range(5)]


def test_template_by_grouping_is_that_of_whole_vectors(spark):
    pick = random.Random(12)
    for named in (True, False):
        pages = [page("h", i, pick, named)[0] for i in range(11)]
        host = deduce(entries_of(pages))
        assert host.slots and texts_of(spark, pages) == [extract(p, host) for p in pages]


def test_odd_markup():
    assert extract("<p>a<b>b</b>c<br>d<p>e &am <3") == "abc d e &am <3"
    assert extract("<ARTICLE><h1>T</h1><script>x") == "T"
    assert extract("<div><p title='a>b'>in</p><p title=\"open>out") == "in out"
    assert extract("</div></p>text<!-- never closed") == "text"
    assert extract("<article>a b&nbsp;c</article>") == "a b c"
    assert extract(None or "") == ""
    assert extract("<" * 20_000 + "a") != ""


def test_empty(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_article_keeps_what_all_pages_hold(spark):
    """A tenth page changes nothing in the text of the others."""
    for n in (9, 12):
        rows = [(i, "http://h.org/", f"<body><article><h2>Verdict</h2><p>Story {i}</p></article></body>", "") for i in range(n)]
        got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {i: f"Verdict Story {i}" for i in range(n)}


def test_names_do_not_mark_what_holds_the_article():
    menu, notes = "<nav>Menu</nav><div class='sidebar'>Side</div>", "<section id='comments'><p>Nice</p></section>"
    story = "<p>A long story</p><p class='notice'>and a notice</p><div class='share'>Share</div>"
    for page in (f"<div class='layout with-sidebar'>{menu}<article>{story}</article>{notes}</div>",
                 f"<body>{menu}<article class='post comments-open'>{story}</article>{notes}</body>",
                 f"<p>Home</p><div class='with-sidebar'><div class='has-widget'>{menu}<main>{story}</main></div></div>"):
        assert extract(page) == "A long story and a notice"
    assert extract(f"<div class='layout with-sidebar'>{menu}<p>A long story without an article</p></div>") == "A long story without an article"
    assert extract(f"<div class='text'><p>Short</p></div><div id='comments'><p>{'long ' * 50}</p></div>") == "Short"


def test_all_slots_of_an_article(spark):
    assert extract("<main><article class='b'><p>One</p></article><article class='a'><p>Two</p></article></main>") == "One Two"
    block = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, "http://h.org/", f"<body><div class='intro'><p>{block(i, 30)}</p></div><div class='about'><p>We are us</p></div>"
             f"<div class='body'><p>{block(-i - 1, 70)}</p></div></body>", "") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"{block(i, 30)} {block(-i - 1, 70)}" for i in range(12)}


def rounds_of(pages):
    """Template, roles and cuts of one host by whole vectors, round by round."""
    lines = [outline(read(p))[0] for p in pages]
    cuts, told, marks = {}, {}, {}
    while True:
        vectors, chars = {}, {}
        for i, page in enumerate(lines):
            counts, sizes = page_counts(page, Roles(told, marks))
            for t, n in counts.items():
                vectors.setdefault(t, [0] * len(pages))[i] = n
                chars[t] = chars.get(t, 0) + sizes.get(t, 0)
        held = {t: v for t, v in vectors.items() if sum(x > 0 for x in v) >= max(2, len(pages) / 2)}
        entries = [{"token": t, "class": hash(tuple(v)), "pages": sum(x > 0 for x in v), "total": sum(v), "chars": chars[t]} for t, v in held.items()]
        found = check_pages(entries, cuts, Roles(told, marks), [x._asdict() for x in lines])
        checks = [dict(zip(("token", "low", "high", "first", "last"), (t, *x))) for t, x in found.items()]
        new_cuts, new_told, new_marks = settle(entries, checks, cuts)
        cuts.update(new_cuts)
        told.update(new_told)
        for t, g, r in new_marks:
            if g not in [x for x, _ in marks.get(t, [])]:
                marks.setdefault(t, []).append((g, r))
        if not new_cuts and not new_told:
            return entries, Roles(told, marks), cuts


def test_roles_part_elements_of_one_path(spark):
    """Three elements of one path: their places between tokens of the page's class tell menu, article and imprint apart."""
    pages = [f"<body><div>Home <b>About us</b></div><h1>T {i}</h1>{f'<div><p>{words(i, 20)}</p></div>' * (1 + i % 3)}<hr><div>Imprint</div></body>"
             for i in range(8)]
    assert texts_of(spark, pages) == [" ".join([words(i, 20)] * (1 + i % 3)) for i in range(8)]


def test_seldom_roles_of_a_slot_stay(spark):
    """A part of the article that few pages have between other tokens is no template and stays."""
    pages = [f"<body><div>Home</div><h1>T</h1><div><p>{words(i, 30)}</p></div><hr>{'<div><p>' + words(-i - 1, 9) + '</p></div>' if i in (2, 5) else ''}"
             "<h2>End</h2><div>Imprint</div></body>" for i in range(9)]
    assert texts_of(spark, pages) == [words(i, 30) + (" " + words(-i - 1, 9) if i in (2, 5) else "") for i in range(9)]


def test_classes_are_ordered_and_nested():
    # Two boxes that change places leave the class of the page; they tell nothing apart.
    a, b = "<ul class='x'><li>One</li></ul>", "<ol><li>Two</li></ol>"
    pages = [f"<body><h1>T</h1>{a + b if i % 2 else b + a}<div><p>{words(i, 9)}</p></div></body>" for i in range(6)]
    entries, _, cuts = rounds_of(pages)
    tokens = {e["token"] for e in entries}
    left = {plain(t) for t in cuts}
    assert {"/body/ul[x]", "/body/ol", "/body/ul[x]/li", "/body/ol/li"} <= left & tokens and not left & {"/body", "/body/h1", "/body/div", "/body/div/p"}
    # Two boxes of one vector in different gaps of the page's class are not one class.
    pages = [f"<body><h1>T</h1>{a if i % 3 else ''}<h2>U</h2>{b if i % 3 else ''}<hr><p>{words(i, 9)}</p></body>" for i in range(9)]
    entries, _, cuts = rounds_of(pages)
    class_of = {e["token"]: (e["class"], cuts.get(e["token"], 0)) for e in entries}
    assert len({e["class"] for e in entries if e["token"] in ("/body/ul[x]", "/body/ol")}) == 1
    assert class_of["/body/ul[x]"] == class_of["/body/ul[x]/li"] != class_of["/body/ol"] == class_of["/body/ol/li"]


def test_settled_templates_are_those_of_whole_vectors(spark):
    pick = random.Random(13)
    box = lambda: pick.choice(["<div>Home</div>", "<div><p>Some</p></div>", "<ul><li>a<li>b</ul>", ""])
    for _ in range(3):
        fixed = [box() for _ in range(5)]
        pages = [f"<body>{fixed[0]}<h1>T {i}</h1>{fixed[1]}<div><p>{words(i, 9)}</p>{box()}</div>{fixed[2]}<hr>{box()}<div>{fixed[3]}</div><h2>E</h2>{fixed[4]}"
                 f"<div><div>{words(-i, 5)}</div></div></body>" for i in range(10)]
        rows = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, uid bigint, html string").repartition(4)
        found = settled_templates(rows.mapInArrow(_outlines, _OUTLINES)).withColumn("n", F.size("told")).collect()
        entries, roles, cuts = rounds_of(pages)
        assert len(found) == 1 and {e["token"] for e in found[0]["template"]} == {e["token"] for e in entries}
        assert {x["token"] for x in found[0]["told"]} == set(roles.told) and {x["token"] for x in found[0]["cuts"]} == set(cuts)
        assert texts_of(spark, pages) == [extract(p, deduce(entries), roles) for p in pages]
