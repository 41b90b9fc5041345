from pyspark.sql import functions as F

from concord.functions import pages as P


def rows(spark, html, f):
    return [tuple(r.e) for r in spark.createDataFrame([(html,)], "h string").select(F.explode(f(F.col("h"))).alias("e")).collect()]


def blocks(spark, html, tags="div", opening="(?i)^<div[^>]*card"):
    return spark.createDataFrame([(html,)], "h string").select(P.element_blocks(F.col("h"), tags, opening).alias("b")).first().b


def test_blocks_by_depth(spark):
    html = "<div class=card>a<div>b<div>c</div></div>d</div>e<div class=card>f<DIV class=card>g</DIV>h</div><p>"
    assert blocks(spark, html) == ["<div class=card>a<div>b<div>c</div></div>d", "<div class=card>f<DIV class=card>g</DIV>h"]
    assert blocks(spark, "</div></div><div card>x<div>y</div>") == ["<div card>x<div>y</div>"]
    assert blocks(spark, "none") == [] and blocks(spark, None) is None
    assert blocks(spark, "<a card><div>x</a>y</div>", "a|div", "(?i)^<a[^>]*card") == ["<a card><div>x"]
    page = "<div>" * 3000 + "<div card>z" + "<div></div>" * 3000 + "w</div>" + "</div>" * 3000 + "x" * (2 << 20)
    assert [len(b) for b in blocks(spark, page)] == [11 + 11 * 3000 + 1]


def test_lists_with_lists_in_them(spark):
    html = """<ol><li class="r"><ul><li>tag one</li><li>tag two</li></ul><h3>No. 1 <a class="t" href="go?id=5"><b>Robot</b> finals</a></h3>
      <p class="s txt-info">Teams of <i>three</i></p><span class="all-time-y2">Physics Club</span><script>timeConvert('86400')</script></li><li><h3>none</h3></li>"""
    assert rows(spark, html, P.article_list) == [("Robot finals", "https://weixin.sogou.com/go?id=5", "Teams of three", "Physics Club", "1970-01-02T08:00:00+08:00")]
    assert rows(spark, "", P.article_list) == []


def test_event_cards(spark):
    html = """<div itemscope itemtype="http://schema.org/Event"><div><h2>Night <b>Build</b></h2></div><meta itemprop="url" content="https://night.test/go">
      <div><meta itemprop="startDate" content="2031-05-06"><meta itemprop="eventAttendanceMode" content="https://schema.org/MixedEventAttendanceMode"></div><span itemprop="name">Pier 4</span></div>
      <a href="https://day.test/" itemtype="https://schema.org/Event"><h5>Day Jam</h5></a><div itemtype="https://schema.org/Event"><h5>No address</h5></div>"""
    assert rows(spark, html, P.event_cards) == [("Night Build", "https://night.test/go", "2031-05-06", None, "hybrid", "Pier 4"), ("Day Jam", "https://day.test/", None, None, None, None)]


def test_lines_of_a_listing(spark):
    html = """<p>Earlier Thing</p><h1>Upcoming Events</h1><i>2031</i><b>Register</b><script>var Some Title;</script><h4>Sea Sprint</h4><p>SEP 3 - 5</p><p>Porto, PT</p><p>Lisbon, Portugal</p>
      <p>Online</p><p>OCT 7 – 9, 2031</p><h4>ALL CAPS LINE</h4><h4>Hill Code Week</h4><p>Virtual</p><h4>oneword</h4>"""
    got = rows(spark, html, P.listed_events)
    assert got == [("Sea Sprint", "OCT 7 – 9, 2031", "Porto, PT", "online"), ("Hill Code Week", None, None, "virtual")]
    assert rows(spark, html, lambda h: P.event_cards(h, F.lit("u")))[1] == ("Hill Code Week", "u", None, None, "virtual", None)


def test_names_near_a_state(spark):
    html = """<style>.Open{}</style><h3>River <b>Games</b></h3><span>Live</span><div class="big title">Lake Games</div>Closed <p>Tiny hackathon of ours</p><p>Upcoming</p>""" + "x" * 600 + "<b>Closed</b><h2>abc</h2>Open"
    got = rows(spark, html, lambda h: P.page_state(h, "https://list.test"))
    assert [(e[0], e[1], e[4]) for e in got] == [("River Games", "https://list.test", "Live")]
    lines = "<p>Our hackathon two</p><p>Open</p>"
    assert [(e[0], e[4]) for e in rows(spark, lines, lambda h: P.page_state(h, "b"))] == [("Our hackathon two", "Open")]


def test_article_page_needs_a_body(spark):
    page = lambda html: spark.createDataFrame([(html,)], "h string").select(P.article_page(F.col("h")).alias("a")).first().a
    assert page("<title>t</title>") is None and page(None) is None
    got = page('<h1 id="activity-name"> Call </h1><a id="js_name">Chess Club</a><script>var biz = "Qk8="; var mid = "12"; var idx="3"; var sn="0fe"</script><div id="js_content"><div><p>first</p></div>second</div>third')
    assert (got.title, got.author, got.biz, got.mid, got.idx, got.sn) == ("Call", "Chess Club", "Qk8=", "12", "3", "0fe") and got.publish_time is None
    assert "first" in got.body and "second" in got.body and "third" not in got.body
