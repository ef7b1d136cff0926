"""Ids, hidden marks and self-closed graphics that don't make an article's text boilerplate."""

import pytest

from lexloom.llm import html_text as H


@pytest.mark.parametrize("slug", ["binary-search-trees", "related-work", "skip-lists", "search"])
def test_ids_of_headings_are_no_hints(slug):
    assert H.main_text(f'<article><h2 id="{slug}">Head</h2><p id="{slug}">Text</p></article>') == "Head\nText"


@pytest.mark.parametrize("slug", ["binary-search-trees", "related-work", "skip-lists"])
def test_slugs_of_sections_are_no_hints(slug):
    assert H.main_text(f'<article><section id="{slug}" class="{slug}"><p>Text</p></section></article>') == "Text"


@pytest.mark.parametrize("attrs", ['class="ad"', 'class="x cookie-notice"', "id=comments", 'class="site-nav"', 'class="related-posts"', "hidden", 'aria-hidden="true"', 'style="display: none"', "role=navigation"])
def test_boilerplate_is_left_out(attrs):
    assert H.main_text(f"<article><p>In</p><div {attrs}><p>Out</p></div></article>") == "In"


@pytest.mark.parametrize("attrs", ['aria-hidden="false"', 'data-hidden="1"', 'title="a hidden cave"'])
def test_what_is_not_hidden_stays(attrs):
    assert H.main_text(f"<article><div {attrs}><p>In</p></div></article>") == "In"


def test_self_closed_svg():
    assert H.main_text('<article><p>A</p><svg/><p>B</p><svg class="i" /><p>C</p><svg><path d="M"/>x</svg><p>D</p></article>') == "A\nB\nC\nD"


@pytest.mark.parametrize("name", ["post-comments", "commentlist", "comment-respond", "responses", "cookie-law-info", "sidebarRight", "navMenu", "entry-comments"])
def test_names_of_boilerplate_are_parted(name):
    assert H.main_text(f'<article><p>In the text</p><div class="{name}"><p>Out</p></div></article>') == "In the text"
    assert H.main_text(f"<body><p>{'word ' * 30}</p><div id='{name}'><p>{'out ' * 30}</p></div></body>") == ("word " * 30).strip()


def test_menu_and_rights_in_main():
    menu = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(4))
    page = f"<main><ul>{menu}</ul><h1>Head</h1><p>{'word ' * 20}</p><p><a href='/s'>A source in full</a></p><p>{'more ' * 20}</p><p>© 2024 The Paper</p></main>"
    assert H.main_text(page).split("\n") == ["Head", ("word " * 20).strip(), "A source in full", ("more " * 20).strip()]


def test_teasers_beside_the_article():
    teaser = "<article><h3>Another story</h3><p>Its first words</p></article>"
    assert H.main_text(f"{teaser}<article><h1>Head</h1><p>{'word ' * 60}</p></article>{teaser}") == "Head\n" + ("word " * 60).strip()
    both = "<article><p>One of two posts of a day.</p></article><article><p>The other post of that day.</p></article>"
    assert H.main_text(both) == "One of two posts of a day.\nThe other post of that day."


def test_short_blocks_around_skipped_ones():
    skipped = "<nav>x</nav><form>y</form><aside>z</aside><footer>f</footer>"
    page = f"<body><h1>Title</h1>{skipped}<p>{'word ' * 30}</p>{skipped}<p>The end.</p></body>"
    assert H.main_text(page) == "Title\n" + ("word " * 30).strip() + "\nThe end."


def test_windows_decide_on_marked_pages():
    """Runs of links part the text of an article, and what follows them is weighed anew."""
    links = "".join(f"<li><a href='/{i}'>Related story number {i}</a></li>" for i in range(6))
    page = f"<article><p>{'word ' * 30}</p><ul>{links}</ul><p>End</p><ul>{links}</ul><p>{'more ' * 30}</p></article>"
    assert H.main_text(page) == ("word " * 30).strip() + "\n" + ("more " * 30).strip()


def brute_lines(weight, texts, window, surge):
    out, inside = [], False
    least = min(surge, max(1, max((sum(weight[i : i + window]) for i in range(len(weight))), default=0) // 2))
    for i, w in enumerate(weight):
        ahead = sum(weight[i : i + window])
        inside = ahead > 0 and (inside or w > 0 and ahead >= least)
        out += [texts[i]] * (inside and w > 0)
    return out


def test_extraction_equals_brute_force_on_generated_pages():
    """Pages of random blocks, whose lines, links and marks the generator knows."""
    import random

    rng = random.Random(6)
    for _ in range(300):
        marked, html, rows = rng.random() < 0.5, [], []
        for i in range(rng.randrange(1, 25)):
            kind = rng.choice(["text", "text", "short", "link", "nav", "out"])
            text = f"{kind}{i} " + " ".join(["word"] * (rng.randrange(15, 40) if kind in ("text", "out") else rng.randrange(0, 2)))
            text = text.strip()
            if kind == "nav":
                html.append(f"<nav>{text}</nav>")
            elif kind == "out":
                html.append(f"<div class='sidebar'>{text}</div>")
            else:
                html.append(f"<p><a href='#'>{text}</a></p>" if kind == "link" else f"<p>{text}</p>")
                rows.append((text, kind == "link"))
        weight = []
        for i, (text, link) in enumerate(rows):
            beside = any(rows[j][1] for j in (i - 1, i + 1) if 0 <= j < len(rows))
            weight.append(0 if link and (not marked or beside) else (1 if link else len(text)) * (4 if marked else 1))
        page = "".join(html)
        want = "\n".join(brute_lines(weight, [t for t, _ in rows], 3, 60))
        assert H.main_text(f"<article>{page}</article>" if marked else f"<body>{page}</body>") == want
