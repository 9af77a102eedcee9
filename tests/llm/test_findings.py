"""Cases that earlier versions cut short."""

from keyloom.llm import html_extract, toxicity


def readings(text):
    model = toxicity.Model([], [], dict(toxicity.PRIOR))
    return [r for r, n in zip(toxicity.READINGS, model.features(text)) if n]


def test_threats_at_someone():
    for text in ("I will kill you", "gonna hurt them", "kill you", "I kill and stab you", "You should burn."):
        assert readings(text) == ["threat"], text
    assert readings("He said they attack you") == ["reported"] and readings("I do not hurt them") == ["negated"]
    assert readings("They attack the problem.") == [] and readings("You fix it. Kill the process.") == []
    model = toxicity.Model([], [], dict(toxicity.PRIOR))
    assert model.score("I will kill you") > model.score("")


def test_an_open_head_and_a_closed_svg_do_not_mute():
    assert html_extract.extract("<html><head><title>t</title><body><p>text of it</p>") == "text of it"
    assert html_extract.extract("<head><title>t</title><p>text of it</p>") == "text of it"
    assert html_extract.extract("<head><meta charset=x><title>t</title>plain text") == "plain text"
    assert html_extract.extract("<head><title>t</title></head><body><p>text of it</p>") == "text of it"
    assert html_extract.extract("<body><p>one two</p><svg viewBox='0'/><p>three four</p>") == "one two\nthree four"
    assert html_extract.extract("<p>one two<svg><path/><text>no</text></svg></p>") == "one two"


def test_a_marked_wrapper_does_not_hide_the_article():
    article = "<article><h1>Head line</h1><p>Some text in here.</p></article>"
    for wrapper in ("page has-sidebar", "no-sidebar", "header-fixed", "menu-open", "elementor-widget"):
        page = f"<body><div class='{wrapper}'><nav><a>Home</a></nav><div class='ad'>Buy it now.</div>{article}<div class='comments'><article>I agree.</article></div></div></body>"
        assert html_extract.extract(page) == "Head line\nSome text in here.", wrapper
        assert html_extract.extract(page.replace("article>", "main>", 2)) == "Head line\nSome text in here.", wrapper
    assert html_extract.extract("<body><div class='has-sidebar'><p>No article element here.</p></div></body>") == "No article element here."
    assert html_extract.extract(f"<body><aside>{article}</aside><nav>{article}</nav></body>") == ""


def test_lists_tables_links_and_boxes_of_an_article():
    text = "A head of some words"
    for box in ("article", "div"):
        def page(inner):
            return f"<body><nav><ul><li><a>Home</a></li></ul></nav><{box}><h1>{text}</h1><p>Intro words here.</p>{inner}</{box}><footer>f</footer></body>"

        start = f"{text}\nIntro words here."
        assert html_extract.extract(page("<ul><li>one</li><li>two</li></ul>")) == start + "\none\ntwo"
        assert html_extract.extract(page("<table><tr><td>x</td><td><span>y</span></td></tr></table>")) == start + "\nx\ny"
        assert html_extract.extract(page("<p>See <a href=u>this</a>.</p>")) == start + "\nSee this."
        related = "<div class='related'><ul>" + "<li><a href=u>Story</a></li>" * 10 + "</ul></div>"
        assert html_extract.extract(page(related + "<p>A tail of the text.</p>")) == start + "\nA tail of the text."
    final = "<ul><li><a href=u>one</a></li><li><a href=v>two</a></li></ul>"
    assert html_extract.extract(f"<body><article><h1>{text}</h1>{final}</article></body>") == f"{text}\none\ntwo"
    assert html_extract.extract(f"<body>{final}<div><h1>{text}</h1><p>Intro words here.</p></div>{final}</body>") == f"{text}\nIntro words here."
