"""HTML extraction and WARC bundles."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from spindrift.llm import html_extract, warc
from spindrift.llm.common import open_fs, shared_dir

TREE = html_extract.grow(*html_extract.labelled_table())
LONG = "word " * 40


def test_tree_fits_its_table():
    x, y = html_extract.labelled_table()
    assert all(html_extract.decide(TREE, tuple(r)) == t for r, t in zip(x, y))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<article><h1>T &amp; U&nbsp;v</h1><p>one\n two<br>three</p><script>if(a<b)'</p>'</script>end</article>tail", "T & U v\n\none two three\n\nend"),
        ("<nav><a>x</a></nav><header>Site</header><main><h1>H</h1><p>body</p><aside>s</aside><form>f</form><section class='comments'><p>" + LONG + "</p></section></main><footer>c</footer>", "H\n\nbody"),
        ("<div class='cookie-notice'>We use</div><article><header><h1>Hi</h1></header><p>B</p><div class=ad>" + LONG + "</div></article>", "Hi\n\nB"),
        ("<div><h2>A title</h2><p>" + LONG + "</p><ul class='menu'><li><a>Home</a><li><a>B</a></ul></div>", "A title\n\n" + LONG.strip()),
        ("<article><p>open <b>bold<p>next<!-- c --><!-- open", "open bold\n\nnext"),
        ("<article><p>a &lt;b&gt; &#233; &copy <p>x < y</article>", "a <b> é ©\n\nx < y"),
        # names that only hint at furniture, linked titles and sources, short pages, cards, linked blocks
        ("<article><p class=share-price>" + LONG + "</p><section id=search-algorithms><p>About them.</p></section></article>", LONG.strip() + "\n\nAbout them."),
        ("<article><h1><a href=/self>A title that links to itself</a></h1><p>" + LONG + "</p><ul><li><a href=1>A source of some words</a><li><a href=2>Another source of words</a></ul></article>", "A title that links to itself\n\n" + LONG.strip() + "\n\nA source of some words\n\nAnother source of words"),
        ("<h1>Note</h1><p>one two three four five six seven eight nine ten</p>", "Note\n\none two three four five six seven eight nine ten"),
        ("<main><h1>T</h1><p>" + LONG + "</p><p>LAST short para</p><article><h3><a href=1>Other story here</a></h3><p>Its teaser text</p></article></main>", "T\n\n" + LONG.strip() + "\n\nLAST short para"),
        ("<a href=1><div>nav link text of some length here</div></a><a href=2><div>more nav link text of this kind</div></a><div><p>" + LONG + "</p></div>", LONG.strip()),
        ("<article><p>one <a href='x'>link</a> <b title='a>b'>two</b></p></article>", "one link two"),
    ],
)
def test_known_pages(page, text):
    assert html_extract.extract(page, TREE) == text


STORY = "<h1>A title here</h1><p>" + LONG * 2 + "</p><p>Another " + LONG + "</p>"
TOLD = "A title here\n\n" + (LONG * 2).strip() + "\n\nAnother " + LONG.strip()
AROUND = "<nav><a href=1>Home</a> <a href=2>News</a></nav>{}<footer>Imprint and rights</footer>"


@pytest.mark.parametrize("story", [STORY, f"<article>{STORY}</article>", f"<main><article>{STORY}</article></main>"])
@pytest.mark.parametrize(
    "wrapper",
    [
        "<form id=aspnetForm>{}</form>",
        "<div class='container sidebar-right'>{}</div>",
        "<div class='main sidebar-left'>{}</div>",
        "<div id=content class='search-page'>{}</div>",
        "<form id=f><div class='page menu-left'><div class='widget'>{}</div><div class=sidebar>A few side words</div></div></form>",
        "<form>{}</form><div class=comments><p>" + LONG * 9 + "</p></div>",
    ],
)
def test_wrappers_of_the_page_are_no_furniture(wrapper, story):
    """A form around everything and names of layouts lose no text; what is furniture inside and beside them still goes."""
    for page in (wrapper, AROUND.replace("{}", wrapper), "<html><body>" + wrapper + "</body></html>"):
        assert html_extract.extract(page.replace("{}", story), TREE) == TOLD


def test_furniture_that_outweighs_the_text_stays_furniture():
    comments = "<section class=comments><p>" + LONG * 20 + "</p></section>"
    assert html_extract.extract(f"<article>{STORY}</article>{comments}", TREE) == TOLD
    assert html_extract.extract(f"<article><h1>Hi you</h1><p>Few words here</p></article>{comments}", TREE) == "Hi you\n\nFew words here"
    assert html_extract.extract(f"<div class=cookie-consent><p>{LONG * 9}</p></div><article>{STORY}</article><aside>{LONG}</aside>", TREE) == TOLD


@pytest.mark.parametrize("piece", ['<a b="', "<a '>'", "<div>", "<span class=ad>", "<!--", "</script", "<p><article>", "<li><span class=ad>", "</p>", "<form>x ", "<form><article>x "])
def test_broken_pages_take_linear_time(piece):
    import time

    began = time.process_time()
    html_extract.extract(piece * (1_000_000 // len(piece)), TREE)
    assert time.process_time() - began < 20


def test_extraction_equals_brute_force(spark, sf_dir):
    """The pages of the tables mark their article: all of its blocks, and nothing else, is main text."""
    from html.parser import HTMLParser

    from spindrift.llm.queries import op1_html_text

    class Plain(HTMLParser):
        def handle_starttag(self, tag, attributes):
            self.inside |= tag == "article"
            if tag == "br":
                self.parts[-1] += " "
            elif tag in ("h1", "p", "article"):
                self.parts.append("")

        def handle_endtag(self, tag):
            self.parts.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.parts[-1] += data

    def plain(page):
        p = Plain()
        p.inside, p.parts = False, [""]
        p.feed(page.replace("<b>", "").replace("</b>", ""))
        return "\n\n".join(" ".join(x.split()) for x in p.parts if x.strip())

    html_of = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op1_html_text(spark, sf_dir).collect()
    assert len(got) == len(html_of)
    for r in got:
        assert r.text == plain(html_of[r.page_id] or "") and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>" + "equal " * 30 + "</p>"
    rows = [(5, "u5", same), (3, "u3", same), (9, "u9", same), (None, "n", same), (4, "u4", "short"), (6, None, "short"), (7, "a\r\nb", None), (8, "", ""), (3, "u3", same), (10, "big", "é" * 700_000), (11, "x", "\r\n\r\nWARC/1.1\r\n" * 20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_extraction_of_odd_rows(spark, pages):
    got = html_extract.extract_text(pages.withColumns({"text": F.lit("old"), "place": F.lit(1)}))
    assert got.count() == pages.count() and got.filter("text is null").count() == 0
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, pages):
    got = warc.warc_round_trip(spark, pages.withColumns({"frame": F.lit("z"), "record_type": F.lit("z")}))
    first = {}
    rows = pages.collect()
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 100 and r.page_id is not None:
            first[p] = min(first.get(p, r.page_id), r.page_id)
    want = []
    for r in rows:
        p = (r.html or "").encode()
        other = len(p) >= 100 and sum((x.html or "").encode() == p for x in rows) > 1 and r.page_id != first[p]
        want.append((r.page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if other else "response", first[p] if other else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_archives_are_plain_zstandard_and_seekable(spark, pages, monkeypatch):
    import zstandard

    folder = shared_dir(spark, "warc-test")
    index = warc.write_archives(pages.filter("page_id < 9"), folder).collect()
    fs, path = open_fs(folder)
    for name in {r.archive for r in index}:
        with fs.open_input_file(f"{path}/{name}") as f:
            frames, raw = warc.read_seek_table(f), f.read_at(f.size(), 0)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert len(whole) == sum(s for *_, s in frames)
        assert whole.count(b"WARC/1.1\r\nWARC-Type") == sum(r.archive == name for r in index)
    back = warc.read_archives(spark.createDataFrame(index[:2], warc.INDEX), folder, payloads=True)
    assert back.count() == len(index[:2])
