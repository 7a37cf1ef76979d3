import random
import time

import pytest

from marlstone.llm.html_text import _container, extract_text, main_text

LONG = "This is a long paragraph of the article with enough words to count as text. " * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p>a\n  b&nbsp;c</p><p>d</p></article><footer>f</footer>", "T & U\n\na b c\n\nd"),
        ("<article><p><b>bold<br><p>next</p></article>", "bold\n\nnext"),
        ("<main><p>x</p><div class='sidebar-left'>s</div><div class=ad>ad</div><form>q<input></form><p>y</p></main>", "x\n\ny"),
        ("<form><article><p>kept</p></article></form>", "kept"),
        ("<article><p>one</p><section id='comments'><article><p>reader</p></article></section></article>", "one"),
        ("<script>var t='</p>';</script><style>p{}</style><article>t</article><!-- c -->", "t"),
        (f"<div id=menu><a href=1>Home</a></div><div class=content><h2>Head</h2><p>{LONG}</p><p>Hi.</p></div><div class=footer>c</div>", f"Head\n\n{LONG.strip()}\n\nHi."),
        ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>i</div><div>text alone</div>", "text alone"),
        ("<article><header><h1>Own</h1></header><p>p</p></article>", "Own\n\np"),
        ("<header>site</header><main>m</main>", "m"),
        ("plain words", "plain words"),
        ("<div class='layout with-sidebar'><article><p>a</p></article></div>", "a"),
        (f"<div class='page sidebar-right'><div><article><p>{LONG}</p><div class=sidebar>s</div></article></div></div><div>b</div>", LONG.strip()),
        ("<section class=sidebar-page><main><p>m</p></main><aside><article>x</article></aside></section>", "m"),
        ("<article class='post no-comments'><p>a</p></article>", "a"),
        ("<article class=share-enabled><p>a</p></article>", "a"),
        ("<main class='layout-sidebar'><p>a</p></main>", "a"),
        (f"<div class=content><p>{LONG}</p></div><section id=comments><article>{LONG}{LONG}</article></section>", LONG.strip()),
        ("<article>a</article><div class=related><article>b</article></div>", "a"),
        (f"<div hidden><article>{LONG}</article></div><p>shown</p>", "shown"),
        (f"<div class=content><p>{LONG}{LONG}</p><h2>H</h2><ul><li>one</li><li>two</li></ul><table><tr><td>t</td></tr></table><blockquote>q</blockquote><p>{LONG}</p></div><div>out</div>", f"{(LONG * 2).strip()}\n\nH\n\none\n\ntwo\n\nt\n\nq\n\n{LONG.strip()}"),
        ("<article><p class=ad>ad<p>text<ul><li class=promo>x<li>y</ul><p>z</article>", "text\n\ny\n\nz"),
        (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section></article>", f"{LONG.strip()}\n\nDiscussion\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><div class=comment><p>{LONG}</p></div></section></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><div class=related><h2>More</h2><ul><li><a href=1>{LONG}</a></ul></div><div class=notice>short</div></article>", LONG.strip()),
        ("<article><p class=copyright-law>law</p><p class=social-intro>intro</p><blockquote class=reply>quote</blockquote><p class=post-share>x</p><div class=related-posts>y</div></article>", "law\n\nintro\n\nquote"),
        ("<table class=sidebar><tr><td>menu</td><td><article><p>in a table</p></article></td></tr></table>", "in a table"),
        ("<ul class=comments-off><li><article><p>in a list</p></article></li></ul>", "in a list"),
        ("<p>cut off in a <b", "cut off in a"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_table(spark):
    data = [(1, "u", "<article>é &lt;x&gt;</article>", "t", 5), (1, "u", "<article>é &lt;x&gt;</article>", "t", 5), (None, None, None, None, None), (2, "u", "<p>" + "word " * 100_000, "t", 5)]
    got = extract_text(spark.createDataFrame(data, "page_id long, url string, html string, text string, region int")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 5), (1, 5), (None, 0), (2, 499_999)]
    assert got[0].text == "é <x>"
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_nesting_is_no_recursion():
    assert main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"


@pytest.mark.parametrize("odd", ["<![ if IE]>", "<![]]>", "<![1]", "see <![foo[", "<![<p>", "<![endif]>", "<![if !IE]>", "<![CDATA[x]]>", "<!", "<!x", "<?", "<!DOCTYPE x>"])
def test_odd_declarations_crash_nothing(odd):
    assert main_text(f"<article><p>before</p>{odd}<p>after</p></article>").startswith("before")
    assert main_text(odd) is not None
    if odd.endswith("]>"):
        assert main_text(f"<article><p>before</p>{odd}<p>after</p></article>") == "before\n\nafter"


def test_random_markup_crashes_nothing():
    rng = random.Random(8)
    for _ in range(10_000):
        main_text("".join(rng.choices("<!-[]/>&;\"'= ap", k=rng.randrange(1, 40))))


@pytest.mark.parametrize("page", ["<div><p>some words of text</p></div>" * 100_000, "<div><p>some words of text</p>" * 100_000])
def test_many_blocks_take_linear_time(page):
    began = time.process_time()
    assert main_text(page)
    assert time.process_time() - began < 8


def test_smallest_container_against_all_paths():
    rng = random.Random(6)
    for _ in range(300):
        parents = [0] + [rng.randrange(i) for i in range(1, 30)]
        regions = {rng.randrange(30) for _ in range(rng.randrange(1, 5))}

        def path(r):
            return {r} if r == 0 else {r} | path(parents[r])

        assert _container(regions, parents) == max(set.intersection(*map(path, regions)))
