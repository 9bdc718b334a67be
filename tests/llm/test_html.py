import random

from pyspark.sql import functions as F

from helixframe.llm import html
from helixframe.llm.html import main_text


def test_article_alone():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
    <header class="site">Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>c</p> -->
    <div id="cookieNotice"><p>We use cookies</p></div><div class="ad">Buy<p>now</div>
    <article><header><h1>The &amp; title</h1></header><p><b>One</b>two &lt;x&gt;<br><p>  a \n\t b&nbsp;c</p><form><p>q</p><input></form>
    <div class="related-posts"><p>other</p></div><p>1 < 2 &copy;</p><section class="comments"><p>nice</p></section></article>
    <aside><p>side</p></aside><div class="sidebar">more</div><footer><p>&copy; x</p></footer></body></html>"""
    assert main_text(page) == "The & title\nOnetwo <x>\na b c\n1 < 2 ©"
    assert main_text("") == "" and main_text("plain text &amp") == "plain text &"
    assert main_text("<body><p>a<p>b<div>c</div>d<p>cut off <b") == "a\nb\nc\nd\ncut off"
    assert main_text("<p>x</p><script>never closed <p>y") == "x"


def test_template_holds_where_markup_breaks(spark):
    rng = random.Random(3)
    def page(body):
        return f"<html><body><nav><a>m</a></nav><div class='wrap'>{body}</div><div class='x7'>Read more of us</div><footer>f</footer></body></html>"
    rows, want = [], {}
    for i in range(40):
        words = [f"w{rng.randrange(1000)}" for _ in range(6)]
        rows.append((i, "http://Host.example/" + str(i), page(f"<h2>{words[0]} t{i}</h2><p>{words[1]} {words[2]}<p>{words[3]}</p>")))
        want[i] = f"{words[0]} t{i}\n{words[1]} {words[2]}\n{words[3]}"
    rows.append((100, "http://host.example/x", page("<h2>odd</h2></div></nav></body><p>still here</p><div class='ad'>unclosed advert")))
    want[100] = "odd\nstill here"
    rows.append((101, "https://user@lone.example:80/", page("<h2>lone</h2>")))
    want[101] = "lone\nRead more of us"  # one page alone cannot tell
    rows += [(102, None, None), (103, "not an address", ""), (None, "http://host.example/y", page("<h2>no id</h2>")), (5, rows[5][1], rows[5][2])]
    want |= {102: "", 103: "", None: "no id"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as template", "3 as host").repartition(4)
    got = html.extract_main_text(df).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_main_text(empty).count() == 0


def test_repeated_paragraph_in_articles_stays(spark):
    rows = [(i, "http://h/", f"<body><nav>n</nav><article><h1>t</h1><p>same everywhere</p><p>x{i}</p></article><footer>f</footer></body>") for i in range(30)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"t\nsame everywhere\nx{i}" for i in range(30)}


def test_long_page_and_many_open_tags():
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>word " * 50_000)) == 50_000 * 5 - 1
    assert main_text("<" * 20_000 + "a") .startswith("<<<")


def test_classes_of_repeated_tokens_are_template(spark):
    def page(i, teasers, odd=""):
        items = "".join(f"<div class='teaser'><h3>t{i} {k}</h3><p>x{i}{k}</p><h6>Go on reading</h6></div>" for k in range(teasers))
        return f"<html><body><nav>m</nav><section>{items}</section>{odd}<footer>f</footer></body></html>"
    def text(i, teasers):
        return "\n".join(f"t{i} {k}\nx{i}{k}" for k in range(teasers))
    rows = [(i, "http://h/", page(i, i % 5)) for i in range(30)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: text(i, i % 5) for i in range(30)}


def test_order_and_nesting_of_classes():
    cls = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    rank = {1: 0, 4: 1}
    assert html.read_classes([1, 9, 2, 4, 5, 6, 4, 5, 6, 3], cls, rank) == {1: ((1, 2, 3), -1), 4: ((4, 5, 6), 2)}
    assert html.read_classes([1, 2, 3, 2, 1, 3], cls, rank) == {1: None}
    assert html.read_classes([1, 4, 5, 6, 2, 4, 5, 6, 3], cls, rank)[4] is None  # in two slots
    assert html.read_classes([1, 4, 5, 2, 6, 3], cls, rank) == {1: ((1, 2, 3), -1), 4: None}  # across a slot's end
    assert html.read_classes([4, 1, 5, 2, 6, 3], cls, rank) == {1: ((1, 2, 3), 4), 4: None}


def test_template_outlasts_null_and_odd_pages(spark):
    notice = "Read more of us"
    rows = [(i, "http://h/", f"<body><nav>m</nav><section><p>x{i}</p></section><div>{notice}</div><footer>f</footer></body>") for i in range(40)]
    odd = [None, "", "  ", "<html><body>hello</body></html>", "<body><footer>f</footer><section><p>o4</p></section><nav>m</nav></body>",
           "<body><nav>m</nav><section><p>o5</p></section></body>", "<body class='error'><nav>m</nav><p>o6</p><footer>f</footer></body>"]
    rows += [(100 + i, "http://h/", page) for i, page in enumerate(odd)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"x{i}" for i in range(40)} | {
        100: "", 101: "", 102: "", 103: "hello", 104: "o4", 105: "o5", 106: "o6"}


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><nav>m</nav><section><p>all of it</p></section><footer>f</footer></body>"
    got = html.extract_main_text(spark.createDataFrame([(i, "http://h/", page) for i in range(40)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"all of it"}


def test_names_mark_whole_and_no_container():
    for around in ("<body class='single right-sidebar'>%s</body>", "<body class='sidebar'>%s</body>", "<body><div class='content with-sidebar'>%s</div></body>",
                   "<body class='custom-header'>%s</body>", "<body style='visibility:hidden'>%s</body>", "<body><main class='has-banner banner'>%s</main></body>",
                   "<body><div class='modal'><main>%s</main></div></body>"):
        assert main_text(around % "<p>kept</p>") == "kept", around
    page = "<article><h2 id='related-work'>Related</h2><p id='share'>a</p><section id='discussion'><p>b</p></section><div class='share-buttons'>x</div></article>"
    assert main_text(page) == "Related\na\nb"
    assert main_text("<div class='Comments_list'>x</div><div id='sidebar'>x</div><div class='site-header'>x</div><p>a</p>") == "a"
    assert main_text("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b <object>c</object></p><noscript><p>d</p></noscript>") == "a x=1 b c\nd"


def test_template_tells_ids_inside_articles(spark):
    def page(i):
        return f"<body><article><p>x{i}</p><div id='share'>s</div><h6>e</h6></article><footer>f</footer></body>"
    got = html.extract_main_text(spark.createDataFrame([(i, "http://h/", page(i)) for i in range(9)] + [(9, "http://lone/", page(9))], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"x{i}\ne" for i in range(9)} | {9: "x9\ns\ne"}


def test_articles_in_comments_do_not_hide_the_body():
    comments = "<section class='comments'><article><p>nice</p></article></section>"
    assert main_text(f"<body><div><h1>t</h1><p>a</p></div>{comments}<aside><article>teaser</article></aside></body>") == "t\na"
    assert main_text(f"<body><div><p>a</p></div><article> </article>{comments}</body>") == "a"
    assert main_text(f"<body><p>x</p><article><p>a</p>{comments}</article></body>") == "a"
    assert main_text("<body><nav>m</nav><div class='modal'><article><p>a</p></article></div></body>") == "a"
    assert main_text("<body><aside><article>teaser</article></aside></body>") == ""


def test_vectors_of_very_many_pages_add_up(spark, monkeypatch):
    """Sums beyond a bigint, and a task that sends its tokens in several parts."""
    from helixframe.llm import html as module

    pages = spark.createDataFrame(
        [(i, "http://big/", f"<body><div><p>Head</p></div><section>{'text ' * 3}{i}</section><ul><li>x</li></ul></body>") for i in range(40)],
        "page_id long, url string, html string").select(module.host_of(F.col("url")).alias("host"), F.lit(1).cast("long").alias("layout"), "html")
    whole = module.token_classes(pages).collect()
    monkeypatch.setattr(module, "HELD_TOKENS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert module.token_classes(pages.coalesce(1)).collect() == whole and len(whole) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    top = spark.range(1000).select(F.lit((1 << 63) - 1).alias("low")).agg(F.sum(F.col("low").cast("decimal(20,0)"))).first()[0]
    assert int(top) == 1000 * ((1 << 63) - 1)
