import math
import random
from collections import Counter

import pytest

from voxlab.llm.html_extract import blocks, extract, main_text, stop_words
from voxlab.llm.lm_score import cross_entropy_difference

STOP = frozenset("the a of and to in is it was for on with that as at".split())
SENTENCE = "the house of the man was on the hill and it is a sign of the time that was to come for all in it"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_without_surroundings():
    html = page(f'<nav><ul><li><a href="/x">the menu</a></li></ul></nav><div class="ad">{SENTENCE} buy</div><article><h1>Title</h1>'
                f"<p><b>{SENTENCE} &amp; more<br><p>short one.</p><p>{SENTENCE}\n\t last&nbsp;&#33;</p></article>"
                f'<div id="comments"><p>{SENTENCE} reader</p></div><footer>&copy; x</footer>')
    assert main_text(html, STOP) == f"Title\n{SENTENCE} & more\nshort one.\n{SENTENCE} last !"


def test_page_without_article_mark():
    html = page('<div><a href="a">home</a> <a href="b">about us</a> <a href="c">contact</a></div><h2>A title</h2>'
                f"<p>{SENTENCE} one. {SENTENCE}</p><p>yes.</p><p>{SENTENCE} two</p><ul><li><a href=x>link one here</a></li><li><a href=y>link two here</a></li></ul>")
    assert main_text(html, STOP) == f"A title\n{SENTENCE} one. {SENTENCE}\nyes.\n{SENTENCE} two"


def test_short_blocks_take_the_nearest_decided_label():
    html = page(f"<p>{SENTENCE} one</p><p>near text</p><div><a href=a>some link text of a menu</a></div><p>near menu</p><div><a href=b>another link text of it</a></div>")
    assert main_text(html, STOP) == f"{SENTENCE} one\nnear text"


@pytest.mark.parametrize("section", ['<aside>{}</aside>', '<form>{}</form>', '<div class="sidebar left">{}</div>', '<div id="cookie-notice">{}</div>',
                                     '<section class="comments">{}</section>', '<div role="navigation">{}</div>', '<header>{}</header>', '<script>{}</script>',
                                     '<style>{}</style>', '<!-- {} -->', '<div style="display: none">{}</div>', '<noscript>{}</noscript>'])
def test_sections_that_are_no_text(section):
    html = page(section.format(f"<p>{SENTENCE} outside</p>") + f"<main><p>{SENTENCE} inside</p></main>")
    assert main_text(html, STOP) == f"{SENTENCE} inside"
    inner = page(f"<article><p>{SENTENCE} inside</p>" + (section.format(f"<p>{SENTENCE} outside</p>") if "header" not in section else "") + "</article>")
    assert main_text(inner, STOP) == f"{SENTENCE} inside"


@pytest.mark.parametrize("wrapper", ['<div class="site has-sidebar">', '<div class="container right-sidebar">', '<div class="content no-comments">', '<div id="with-nav">'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_a_layout_named_like_a_section_keeps_its_text(wrapper, inner):
    text = inner.format(f"<p>{SENTENCE} one</p><p>{SENTENCE} two</p>")
    aside = f'<div class="sidebar"><p>{SENTENCE}</p></div>'
    assert main_text(page(f"<nav>menu</nav>{wrapper}{text}{aside}</div><footer>x</footer>"), STOP) == f"{SENTENCE} one\n{SENTENCE} two"


@pytest.mark.parametrize("inner", ['<div class="legal-analysis"><p>{}</p></div>', '<div class="tags-explained meta"><p>{}</p></div>', '<div id="side-effects"><p>{}</p></div>',
                                   '<section class="search"><p>{}</p></section>', "<p><math><mi>{}</mi></math></p>", "<object><p>{}</p></object>"])
def test_parts_of_an_article_stay(inner):
    html = page(f"<nav>menu</nav><article><p>{SENTENCE} one</p>{inner.format(SENTENCE + ' two')}<p>{SENTENCE} three</p></article>")
    assert main_text(html, STOP) == f"{SENTENCE} one\n{SENTENCE} two\n{SENTENCE} three"


def test_a_table_in_an_article_keeps_its_cells():
    html = page(f"<article><p>{SENTENCE}</p><table><tr><th>Year</th><th>Size</th></tr><tr><td>1990</td><td>12 m</td></tr></table>"
                f"<div><a href=a>some link text of a list</a></div><table><tr><td>end</td></tr></table></article>")
    assert main_text(html, STOP) == f"{SENTENCE}\nYear\nSize\n1990\n12 m\nend"


def test_a_long_list_of_names_is_no_text_where_the_language_is_known():
    names = " ".join(f"Name{i}" for i in range(60))
    body = f"<div><p>{SENTENCE} one. {SENTENCE}. {SENTENCE}. {SENTENCE}. {SENTENCE}</p><p>{SENTENCE} two. {SENTENCE}</p></div><div>{names}</div><div><a href=x>link one here and there</a></div>"
    assert names not in main_text(page(body), STOP)
    assert names in main_text(page(f"<div>{names}</div><p>{names} more</p>"), STOP)


def test_stop_words_are_those_of_the_prose(spark):
    html = page(f"<script>var margin = 1; var track = margin;</script><style>p {{margin: 0}}</style><nav>home blog</nav><p>{SENTENCE} &middot; see www.example.com</p>")
    got = stop_words(spark.createDataFrame([(html,), (html,)], "html string"))
    assert {"the", "was", "hill"} <= got and got.isdisjoint({"var", "margin", "track", "middot", "www", "com", "example", "blog", "home"})


def test_articles_in_comments_are_no_article():
    for a, b in (("", ""), ('<div class="site has-sidebar">', "</div>")):
        comments = f'<div id="comments"><article class="comment"><p>{SENTENCE} reader</p></article></div>'
        html = page(f"{a}<article><p>{SENTENCE} one</p><p>{SENTENCE} two</p></article>{comments}{b}")
        assert main_text(html, STOP) == f"{SENTENCE} one\n{SENTENCE} two"


@pytest.mark.parametrize("html", [None, "", "<", "<div", "<!--", "<p>", "&am", "</p></div>", '<a href="', "<script>x", "<p class='a", "<![CDATA[x"])
def test_broken_pages(html):
    assert isinstance(main_text(html, STOP), str)


def test_references_and_scripts():
    html = page(f'<script>var t="</p>";</script><article><p>{SENTENCE} &lt;b&gt; &eacute; &#x41; &unknown; &am</article>')
    assert main_text(html, STOP) == f"{SENTENCE} <b> é A &unknown; &am"


def test_long_page_is_taken_whole():
    html = page("<article>" + "".join(f"<p>{SENTENCE} {i}</p>" for i in range(5000)) + "</article>")
    assert len(blocks(html)) == 5000 and main_text(html, STOP).count("\n") == 4999


def test_query_over_odd_rows(spark):
    rows = [(1, "u", page(f"<article><p>{SENTENCE}</p></article>"), "x"), (1, "u", page(f"<article><p>{SENTENCE}</p></article>"), "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", page("<nav>x</nav>"), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", SENTENCE, len(SENTENCE))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=str)
    assert extract(df.where("page_id = 99")).collect() == []
    assert "the" in stop_words(df)


def brute(texts, wanted, vocabulary, weight=0.6, floor=0.5):
    """The same models with exact bigram counts."""
    from collections import Counter
    words = Counter(w for t in texts for w in (t or "").lower().split())
    known = {w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:vocabulary - 1]}
    code = lambda t: [w if w in known else None for w in (t or "").lower().split()]
    out, models = [], []
    for some in ([t for t, x in zip(texts, wanted) if x], texts):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for t in some:
            ids = code(t)
            for a, b in zip(["^", *ids[:-1]], ids):
                uni[b] += 1
                ctx[a] += 1
                bi[a, b] += 1
        models.append((uni, ctx, bi, sum(uni.values()) + floor * vocabulary))
    for t in texts:
        ids = code(t)
        if not ids:
            out.append((0, None, None))
            continue
        loss = []
        for uni, ctx, bi, total in models:
            s = 0.0
            for a, b in zip(["^", *ids[:-1]], ids):
                p = (uni[b] + floor) / total
                s -= math.log(weight * bi[a, b] / ctx[a] + (1 - weight) * p if ctx[a] else p)
            loss.append(s / len(ids))
        out.append((len(ids), *loss))
    return out


def test_losses_against_exact_counts(spark, frame):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["the", "a", "x", "y", "z", f"r{rnd.randrange(40)}"] if i % 2 else ["the", "b", "c", "x", f"q{rnd.randrange(40)}"]) for _ in range(rnd.randrange(0, 30))) for i in range(80)]
    wanted = [i % 2 == 1 and i < 60 for i in range(80)]
    ids = spark.createDataFrame([(i,) for i in range(80) if wanted[i]] + [(1,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in cross_entropy_difference(frame([(i, t, "en", "s") for i, t in enumerate(texts)]), ids, vocabulary=30).collect()}
    for i, (n, t, b) in enumerate(brute(texts, wanted, 30)):
        assert got[i].n_tokens == n
        if n:
            assert got[i].target_loss == pytest.approx(t, rel=1e-5) and got[i].background_loss == pytest.approx(b, rel=1e-5)
            assert got[i].difference == pytest.approx(t - b, rel=1e-4, abs=1e-6)
        else:
            assert got[i].difference is None


def test_losses_of_odd_rows(spark, odd, frame):
    ids = spark.createDataFrame([(4,)], "doc_id long")
    got = cross_entropy_difference(odd, ids).collect()
    assert len(got) == 10 and all((r.difference is None) == (r.n_tokens == 0) for r in got)
    none = ids.where("doc_id = 0")
    assert len(cross_entropy_difference(odd, none).collect()) == 10
    assert cross_entropy_difference(frame([]), ids).collect() == []


def test_every_bigram_of_a_large_vocabulary_has_its_own_count(spark, frame):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(60_000)}" for _ in range(800)) for _ in range(300)]
    texts += texts[:60]  # bigrams that are held twice, and words that are
    wanted = [i % 3 == 0 for i in range(len(texts))]
    ids = spark.createDataFrame([(i,) for i in range(len(texts)) if wanted[i]], "doc_id long")
    words = [w for t in texts for w in t.split()]
    twice = {w for w, n in Counter(words).items() if n > 1}
    assert len(twice) > 1 << 15
    got = {r.doc_id: r for r in cross_entropy_difference(frame([(i, t, "en", "s") for i, t in enumerate(texts)]), ids).collect()}
    for i, (n, t, b) in enumerate(brute(texts, wanted, len(twice) + 1)):
        assert got[i].n_tokens == n
        assert got[i].target_loss == pytest.approx(t, rel=1e-9) and got[i].background_loss == pytest.approx(b, rel=1e-9)
