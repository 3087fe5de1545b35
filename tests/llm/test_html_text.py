import numpy as np
import pytest

from cairnflow.llm.html_text import lines_of, main_text, with_main_text

FRAME = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies. ' + "Accept. " * 60 + "</div><!-- ad --><div class='ad'>Buy now " * 1 + "</div>"
    "%s"
    '<aside class="sidebar"><p>Sidebar text</p></aside><section id="comments"><p>First reader comment, long enough to look like text.</p></section>'
    '<form><label>Mail</label><input name="m"><button>Go</button></form><footer>&copy; site &middot; all rights</footer></body></html>'
)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head</h1><p><b>First  line.<br><p>Sec&ouml;nd &amp;\n third&nbsp;x.</p><p>Er.</p></article>", "Head\nFirst line.\nSecönd & third x.\nEr."),
        ("<article><header><h1>Head</h1></header><p>One.</p><div class='ad-box'><p>Advert</p></div><p>Two.</p><ul><li><a href='x'>Link line</a></li></ul><footer>By me</footer></article>", "Head\nOne.\nTwo.\nLink line"),
        ("<div id='content'><h1>Head</h1><p>" + "Long text here. " * 20 + "</p><p>Short.</p></div>", "Head\n" + ("Long text here. " * 20).strip() + "\nShort."),
        ("<main><p>Only</p></main>", "Only"),
        ("", ""),
    ],
)
def test_frames_go_and_articles_stay(body, want):
    assert main_text(FRAME % body) == want


def test_broken_markup():
    assert main_text("") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>a < b and <i>c</i>d") == "a < b and cd"
    assert main_text("<article><p>x<script>unclosed") == "x"
    assert main_text("<article><p>one</div></span><p>two</article>tail") == "one\ntwo"
    assert len(main_text("<article>" + "<p>w</p>" * 20000 + "</article>").split("\n")) == 20000


def test_frame_of_pages(spark):
    rows = [(1, "u", None, 5), (2, None, "", None), (3, "u", "<article><p>é&#128512;</p></article>", 1), (3, "u", "<article><p>é&#128512;</p></article>", 1), (None, "v", "<nav>x</nav>", 0)]
    got = with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, k1 int")).collect()
    assert sorted((r.page_id or 0, r.k1, r.text, r.n_chars) for r in got if r.k1 is not None) == [(0, 0, "", 0), (1, 5, "", 0), (3, 1, "é😀", 2), (3, 1, "é😀", 2)]
    assert with_main_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_adverts_within_a_page_without_article():
    long = ("Long text here. " * 20).strip()
    advert = '<div class="ad"><p>Buy</p></div>'
    assert main_text(FRAME % f"<div><p>{long}</p>{advert}<p>more</p><aside>x</aside><h2>Part</h2><p>{long}</p></div>") == f"{long}\nmore\nPart\n{long}"
    assert main_text(FRAME % f"<div><section><p>{long}</p></section>{advert}<section><p>{long} Two.</p></section></div>") == f"{long}\n{long} Two."
    assert main_text(f"<body><p>One.</p>{advert}<p>Two.</p></body>") == "One.\nTwo."
    assert main_text(FRAME % f"<div>Little chrome</div>{advert}<div><p>{long}</p></div>") == long


def test_names_of_other_words_hide_no_text():
    assert main_text('<article><p>One.</p><p class="share-price">Two.</p><div class="notice-period"><p>Three.</p></div><div class="share-bar"><p>Tweet</p></div></article>') == "One.\nTwo.\nThree."
    assert main_text('<div><p class="share-price">' + "Price. " * 30 + "</p></div>") == ("Price. " * 30).strip()


def test_the_distribution_decides():
    gap = '<div class="ad"><p>Buy</p></div>'
    page = f"<body><div><p>{'Main. ' * 40}</p></div>{gap}<div><p>Stray</p></div>{gap}<div><p>{'Second. ' * 20}</p></div></body>"
    assert main_text(page) == "\n".join([("Main. " * 40).strip(), ("Second. " * 20).strip()])
    assert main_text(page, 8) == "\n".join([("Main. " * 40).strip(), "Stray", ("Second. " * 20).strip()])
    outside = "<div><p>%s</p></div><article><p>Short.</p></article>"
    assert main_text(outside % ("word " * 30)) == "Short."  # a tenth of its characters stay under the dense weight
    assert main_text(outside % ("word " * 300)) == ("word " * 300).strip() + "\nShort."


def brute(lines, window):
    """Blocks by hand, then runs of lines from whose block on nothing is zero."""
    blocks = [sum(x[1] for x in lines[i : i + window]) for i in range(len(lines))]
    runs, own = [], []
    for i, b in enumerate([*blocks, 0]):
        if b:
            own.append(i)
        elif own:
            while not lines[own[0]][1]:
                own.pop(0)
            runs.append(own)
            own = []
    if not runs:
        return ""
    weight = [(any(lines[i][2] for i in r), sum(lines[i][1] for i in r)) for r in runs]
    best = runs[weight.index(max(weight))]
    top = max((lines[i][2], lines[i][1]) for i in best)
    home = next(lines[i] for i in best if (lines[i][2], lines[i][1]) == top)
    keep = []
    for r in runs:
        near = any(lines[i][2] if home[2] else lines[i][1] and lines[i][3] == home[3] for i in r)
        if r is best or near or max(blocks[i] for i in r) >= 86:
            keep += [lines[i][0] for i in r if lines[i][0]]
    return "\n".join(keep)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 9])
def test_random_pages_equal_brute_force(window):
    rng = np.random.default_rng(window)
    block = lambda: f"<p>{'w' * int(rng.choice([1, 5, 20, 40, 90, 300]))}</p>"
    kinds = ["<div>%s</div>", '<div class="ad">%s</div>', "<article>%s</article>", "<nav>%s</nav>", "<div><a href='x'>%s</a></div>", "%s", "<section>%s</section>"]
    seen = set()
    for k in range(300):
        use = kinds if k % 2 else [x for x in kinds if "article" not in x]
        page = "<body>" + "".join(str(rng.choice(use)) % "".join(block() for _ in range(int(rng.integers(0, 4)))) for _ in range(int(rng.integers(0, 9)))) + "</body>"
        lines = lines_of(page)
        assert main_text(page, window) == brute(lines, window), page
        seen.add(main_text(page, window) != "\n".join(line[0] for line in lines if line[0]))
    assert seen == {True, False}


def test_ties_go_to_the_earlier_stretch():
    gap = '<div class="ad"><p>Buy</p></div>'
    assert main_text(f"<div><p>Same size 1</p></div>{gap}<div><p>Same size 2</p></div>") == "Same size 1"
