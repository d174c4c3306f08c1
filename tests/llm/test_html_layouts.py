"""Main text of pages in layouts and words unlike the labelled table."""

import random

from tuneframe.llm import html_extract as H


def text_of(page):
    return H.main_text(page, H.trained())


def words(n, w="w"):
    return " ".join(f"{w}{i}" for i in range(n))


def test_marked_elements_never_pass():
    art = f"<article><h1>Title</h1><p>{words(30)}</p></article>"
    want = f"Title {words(30)}"
    for extra in (f"<footer>{words(80)}</footer>", f'<div class="cookie-notice">{words(80)}</div>',
                  "<nav>" + "".join(f'<a href="/{i}">link {i}</a> ' for i in range(80)) + "</nav>", "<nav>one two three</nav>",
                  f"<aside>{words(200)}</aside>", f"<form>{words(50)}<button>Send</button></form>", f"<style>{words(40)}</style>",
                  f'<section id="comments"><p>{words(90)}</p></section>', f'<div class="sponsored-ad">{words(60)}</div>'):
        assert text_of(f"<body>{extra}{art}</body>") == want
        assert text_of(f"<body>{art}{extra}</body>") == want
        assert text_of(f"<body>{art.replace('</article>', extra + '</article>')}</body>") == want


def test_elements_inside_an_article():
    page = ("<article><h1>T</h1><p>Body text here now.</p><form><label>Your email</label><button>Send</button></form>"
            "<aside>Side box</aside><nav>Prev Next</nav><footer>Foot words</footer></article>")
    assert text_of(page) == "T Body text here now."


def test_lists_of_links_and_links_in_prose():
    links = "".join(f'<li><a href="/{i}">more about {i}</a></li>' for i in range(6))
    prose = 'and <a href="/x">a link</a> in the midst of a long sentence goes on'
    page = f"<article><h1>A title</h1><p>{words(20)}</p><ul>{links}</ul><p>{prose}</p></article>"
    assert text_of(page) == f"A title {words(20)} and a link in the midst of a long sentence goes on"


def test_pages_without_an_article():
    for n in (12, 25, 60):
        paras = [words(n, f"p{k}x") for k in range(5)]
        page = f"<body><nav><a href=/>home</a></nav><div><h1>A title</h1>{''.join(f'<p>{p}</p>' for p in paras)}</div><footer>f</footer>"
        assert text_of(page) == " ".join(["A title", *paras])
        paras = [p for p in paras if n > 20]
        if paras:
            assert text_of("<body>" + "".join(f"<div>{p}</div>" for p in paras) + "</body>") == " ".join(paras)


def test_held_out_layouts():
    """Block precision and recall on layouts that the table does not have."""
    rng = random.Random(77)
    vocabulary = "alpha beta gamma delta orbit quartz lemon saddle pepper violin marble candle".split()

    def say(low, high):
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(low, high))) + f" z{rng.randrange(10**9)}"

    def links(n):
        return "".join(f"<li><a href=#>{say(1, 3)}</a></li>" for _ in range(n))

    def page(kind):
        good = []

        def g(low, high):
            good.append(say(low, high))
            return good[-1]

        body = (
            lambda: f"<div class=post><h2>{g(2, 7)}</h2>" + "".join(f"<p>{g(8, 50)}</p>" for _ in range(6)) + f"<blockquote>{g(10, 30)}</blockquote></div>",
            lambda: f"<article><h1>{g(2, 7)}</h1><p>{g(8, 50)}</p><aside><h4>{say(1, 4)}</h4><p>{say(20, 60)}</p></aside><p>{g(2, 50)}</p>"
                    f"<div class='share-buttons'>{say(2, 5)}</div><p>{g(1, 12)}</p></article>",
            lambda: "<div id=content>" + "".join(f"<h3>{g(1, 6)}</h3><p>{g(15, 60)}</p><ul><li>{g(3, 15)}</li><li>{g(3, 15)}</li></ul>" for _ in range(4)) + "</div>",
            lambda: f"<main><h1>{g(2, 7)}</h1>" + "".join(f"<section><h2>{g(1, 5)}</h2><p>{g(4, 40)}</p><pre>{g(4, 12)}</pre></section>" for _ in range(3))
                    + f"<form><input><button>{say(1, 2)}</button></form></main><div class='related-posts'><h3>{say(1, 3)}</h3><ul>{links(5)}</ul></div>",
            lambda: f"<table><tr><td><ul>{links(6)}</ul></td><td><h1>{g(2, 6)}</h1>" + "".join(f"<p>{g(20, 60)}</p>" for _ in range(4)) + "</td></tr></table>",
            lambda: "".join(f"<div class=para>{g(20, 70)}</div>" for _ in range(5)))[kind]()
        head = f"<header class=site><a href=/>{say(1, 2)}</a><p>{say(3, 9)}</p></header><nav><ul>{links(7)}</ul></nav>"
        foot = f"<footer><div>{say(60, 120)}</div><ul>{links(8)}</ul><p>{say(5, 20)}</p></footer>"
        return f"<html><body>{head}{body}{foot}</body></html>", set(good)

    for kind in range(6):
        hit = found = wanted = 0
        for _ in range(40):
            html, good = page(kind)
            blocks = H.blocks_of(html)
            keep = H.judge(H.trained(), H.block_features(blocks))
            got = {b.text for b, k in zip(blocks, keep, strict=True) if k and not b.aside}
            hit, found, wanted = hit + len(got & good), found + len(got), wanted + len(good)
        assert 2 * hit / (found + wanted) >= 0.9, kind


def test_the_tree_looks_at_links_and_neighbours():
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(H.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(H.trained())
    assert {"words", "link_density", "words_before", "density_before", "words_after", "density_after"} <= used


def test_long_blocks_and_repeated_rows(spark):
    long = "<article><p>" + "word " * 400_000 + "</p></article>"
    rows = [(1, long), (1, long), (2, None), (2, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, html string, main_text string")
    got = sorted((r.page_id, len(r.main_text_)) for r in H.extract(df).collect())
    assert got == [(1, 1_999_999)] * 2 + [(2, 0)] * 2
