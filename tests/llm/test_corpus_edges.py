"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcol.llm import bpe, components, decontaminate, html_text, language_id, quality_model, quality_rules, sharding, simhash, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The first sentence is here, and it goes on for a while. The second one follows it, as it must, in time. "
LONG = " ".join(f"word{i % 9973} and{i % 31}." for i in range(60_000))
ROWS = [
    (1, PROSE + "A third one ends the text, at last.", "en", "a", 1),
    (2, PROSE + "A third one ends the text, at last.", "en", None, None),
    (2, PROSE + "A third one ends the text, at last.", "en", None, None),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "a", 0),
    (6, LONG, "en", "b", 9),
    (None, "A text without any id, which is no reason to fail, is here as well, with ten words.", None, None, None),
    (7, "\x00\x01 ÀÉß ￿ 🙂🙂 日本語 x", "xx", "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("kept", "fp", "found", "_row", "_text", "n_words", "shard", "component_id", "_id", "x", "score", "N_PIECES", "_place", "bpe", "covered", "_hash", "row")
    return docs.withColumns({n: F.lit(f"extra {n}") for n in names}).withColumnRenamed("score", "a.dotted `name`")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench_items(spark):
    return spark.createDataFrame([(1, "The second one follows it, as it must, in time."), (2, "third ONE ends"), (2, None), (3, ""), (None, "reason to fail is"), (4, "日本語 x")], "item_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# -- quality rules


def test_rules_on_odd_rows(docs, nothing):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert (got[3].n_words, got[3].word_chars, got[3].base_failed, got[3].kept) == (0, 0, True, False)
    assert got[4].kept is False and got[5].n_dup_lines == 0
    assert got[6].n_words == 120_000 and got[1].kept
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


def test_rules_keep_what_came(clashing):
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, None}
    assert {r.kept for r in kept.collect()} == {"extra kept"}


def test_repeated_windows_are_counted_once_each(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d e", "x a b c d e y a b c d e z", "a b c d", "one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_repeat_words for r in quality_rules.judge(df).orderBy("doc_id").collect()] == [10, 6, 10, 10, 0, 0]


def test_line_rules(spark):
    good = "This line ends as a sentence should, with a mark."
    for line, passes in ((good, True), ("Home | News | Sport | Weather | More.", False), ("All rights reserved.", False), ("WOW!!! BUY!!! NOW!!! OK!!!", False), ("no mark at its end", False), ('She said "no."', True), ("It ended. Then the line went on", True),
        ("We use cookies, so click here.", False), ("In a long report on the web, the paper found that most of the sites that people visit use cookies to follow them.", True),
        ("She baked two dozen cookies for the fair on Sunday.", True), ("यह एक साफ वाक्य है।", True), ("这是一个干净的句子。然后是下一个", True), ("هل هذه جملة نظيفة؟", True), ("นี่เป็นประโยคที่สะอาดและยาวพอ", True), ("कोई चिह्न नहीं", False)):
        df = spark.createDataFrame([(line,)], "line string")
        assert df.select(quality_rules.line_passes(F.col("line"), quality_rules.QualityLimits())).first()[0] is passes, line


def test_clean_texts_of_other_scripts_are_kept(spark):
    hindi = "यह एक साफ और लंबा पाठ है जिसमें बहुत से शब्द हैं। इसके वाक्य दंड से समाप्त होते हैं और यह कई बातें बताता है।"
    arabic = "هذا نص نظيف وطويل فيه كلمات كثيرة جدا عن أشياء مختلفة؟ نعم هو كذلك وينتهي بعلامة۔"
    chinese = "这 是 一个 干净 的 文本 它 有 很多 词 而且 以 句号 结束。"
    df = spark.createDataFrame([(1, hindi), (2, arabic), (3, chinese)], "doc_id long, text string")
    assert {(r.doc_id, r.base_failed, r.kept, r.lost_chars) for r in quality_rules.judge(df).collect()} == {(i, False, True, 0) for i in (1, 2, 3)}


# -- sharding


def placed(df, n=16, **options):
    return sharding.histogram_sort(sharding.digest(df), "doc_id", "size", n, **options).collect()


def check_shards(rows, n=16):
    """Shards are what the law says: a row's shard is the number of n-ths of all bytes that lie at or below its first byte."""
    total = sum(r["size"] for r in rows)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    below = 0
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert keys == sorted(keys)
    for r in order:
        assert r["shard"] == n * below // total
        below += r["size"]
    for s in {r["shard"] for r in rows}:
        assert [r["slot"] for r in order if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_of_odd_rows(docs, nothing):
    rows = placed(docs)
    check_shards(rows)
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {1}
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sharding.shard_documents(nothing).count() == 0


@pytest.mark.parametrize("case", ["one key", "hot key", "far apart", "steep sizes"])
def test_splitters_are_exact(spark, case):
    random.seed(7)
    n = 3000
    ids = {"one key": [5] * n, "hot key": [7] * (n // 3) + list(range(2 * n // 3)), "far apart": [random.choice((-1, 1)) * random.randrange(2**62) for _ in range(n)], "steep sizes": list(range(n))}[case]
    texts = ["x" * (i % 50 if case != "steep sizes" else int(1.002**i)) for i in range(n)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    check_shards(placed(df, 7, buckets_per_shard=4), 7)
    check_shards(placed(df, 7, buckets_per_shard=4, task_rows=20), 7)


def test_a_bucket_is_dealt_over_tasks(spark):
    df = spark.range(0, 4000, 1, 4).select(F.expr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.histogram_sort(sharding.digest(df), "doc_id", "size", 2, buckets_per_shard=2, task_rows=50)
    check_shards(rows.collect(), 2)
    plan = rows._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def test_tolerance_is_met(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('y', CAST(id % 40 AS INT))").alias("text"))
    rows = placed(df, 4, tolerance=2000)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 4 * 2000


# -- WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a", "plain"), (2, None, None), (3, "u\r\nX: y", ""), (4, "d", "plain"), (5, "e", fake), (6, "f", "start " + fake * 3 + " end \r\n\r\n"), (7, "g", "é🙂" * 5000), (8, "h", fake), (9, "i", "WARC/1.1\r\n"), (10, "j", "\r\n\r\n")]
    got = {r.page_id: r for r in warc.pages_through_archives(pages(spark, rows), str(tmp_path / "w")).collect()}
    import base64
    import hashlib

    first = {}
    assert len(got) == len(rows)
    for i, _, text in rows:
        data = (text or "").encode()
        r, origin = got[i], first.setdefault(data, i)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if origin == i else ("revisit", origin))
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).where("record_type = 'response'").collect()}
    assert all(payloads[i] == (t or "").encode() for i, _, t in rows if got[i].record_type == "response")


def test_archives_split_anywhere(spark, tmp_path):
    fake = "WARC/1.1\r\nContent-Length: 100000\r\n\r\n"
    rows = [(i, f"http://x/{i}", f"{i} " + "text " * (i % 40) + (fake if i % 7 == 0 else "")) for i in range(400)]
    warc.write_archives(warc.describe(pages(spark, rows).coalesce(2)), str(tmp_path / "w"), 150)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (777, 5003):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chains_are_followed_over_many_runs(spark):
    random.seed(3)
    edges, want = [], set()
    for f in ("a", "b"):
        at = 0
        for _ in range(200):
            step = random.randrange(50, 90)
            edges.append((f, at, at + step))
            want.add((f, at))
            for k in range(random.randrange(3)):  # inside the payload, pointing anywhere ahead
                edges.append((f, at + 10 + k, random.choice([at + step, at + 11 + k, 10**6, None])))
            at += step
    df = spark.createDataFrame(edges, "file string, offset long, successor long")
    assert {(r.file, r.offset) for r in warc.reachable(df).collect()} == want


def test_pages_that_are_odd(spark, tmp_path):
    rows = [(5, "a", "same"), (5, "a", "same"), (None, "b", "same"), (9, "c", "same")]
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.pages_through_archives(pages(spark, rows), str(tmp_path / "w")).collect()), key=str)
    assert got == [(0, "revisit", 5), (5, "response", None), (5, "response", None), (9, "revisit", 5)]
    assert warc.pages_through_archives(pages(spark, []), str(tmp_path / "e")).count() == 0


def test_ids_of_any_type_come_back(spark, tmp_path):
    rows = [("a b>c", "u", "one"), ("%41é", None, "two"), ("", "w", "one"), (None, "x", "only")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.pages_through_archives(df, str(tmp_path / "w")).collect()}
    assert got == {("a b>c", "revisit", ""), ("%41é", "response", None), ("", "response", None), (None, "response", None)}


def test_a_corrupt_payload_raises(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(warc.describe(pages(spark, [(1, "u", "payload one")])).withColumn("payload_digest", F.lit("WRONG")), str(path))
    with pytest.raises(Exception, match="stated digest"):
        own = warc.write_archives
        try:
            warc.write_archives = lambda *a: None
            warc.pages_through_archives(pages(spark, [(1, "u", "payload one")]), str(path)).collect()
        finally:
            warc.write_archives = own


def test_very_long_records(spark, tmp_path):
    import hashlib

    long = "é magic WARC/1.1\r\n and more " * 400_000
    r = warc.pages_through_archives(pages(spark, [(1, "u", long)]), str(tmp_path / "w")).first()
    assert r.payload_bytes == len(long.encode()) and len(r.payload_digest) == 32
    payload = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).first().payload
    assert hashlib.sha1(payload).digest() == hashlib.sha1(long.encode()).digest()


# -- HTML


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("plain text, only &amp; so", "plain text, only & so"),
        ("<p>cut off<p", "cut off"),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One, two.<p>Three&nbsp;four&#33;<br>five</article><footer>foot</footer>", "Head One, two. Three four! five"),
        ("<main><article><p>Kept, as it should be.</p><div class='comments'><p>Nice one, I liked it, very much.</p></div><form>Sign up</form></article><aside>Else</aside></main>", "Kept, as it should be."),
        ("<div id=w><div><h2>Head</h2><p>A long paragraph, with commas, and an end.</p><p>Another long one, with commas, too.</p></div><div class='cookie-notice'>We use cookies, to track.</div></div>", "Head A long paragraph, with commas, and an end. Another long one, with commas, too."),
        ("<article><script>if (a<b) x('</p>')</script><p>a<b>b</b>c &lt;tag&gt; &copy &am</article>", "abc <tag> © &am"),
        ("<div class='siteHeader'><h1>Site, of news.</h1></div><article><div class='entry-header'><h1>Head</h1></div><p>Body, here.</p><ol class=commentlist><li>Me, too.</ol></article><div id=pageFooter>Foot, note.</div>", "Head Body, here."),
        ("<article><p>x</article>" + "<div>" * 3000 + "deep", "x"),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source) == text


PARAGRAPH = "This paragraph, which is long, tells of a thing at length; it has marks, too, and it ends. " * 4


@pytest.mark.parametrize(
    "source, text",
    [
        (f"<div id=text><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div>By a writer</div></div><div id=more><article><h3>Card</h3><p>See this</p></article><article><h3>Card</h3><p>See that</p></article></div>", f"{PARAGRAPH}{PARAGRAPH}By a writer"),
        (f"<article><p>{PARAGRAPH}</p></article><div id=on><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH}{PARAGRAPH}".strip()),
        (f"<body><article><div><h1>Head</h1><p>{PARAGRAPH}</p><dl><dd>Note</dd></dl></div><div><table><tr><td>tiny</td></tr></table></div></article>", f"Head {PARAGRAPH}Note"),
        (f"<article><p>{PARAGRAPH}</p><p><a href=x>A paragraph that is a link</a></p><ul><li><a href=y>An item</a></ul></article>", f"{PARAGRAPH}A paragraph that is a link An item"),
        (f"<article><p>{PARAGRAPH}</p><ul><li><a href=x>one</a><li><a href=y>two</a><li><a href=z>three</a></ul></article>", PARAGRAPH.strip()),
        ("<p title=it's>Hello don't stop. More text.</p>", "Hello don't stop. More text."),
        (f"<article><p>{PARAGRAPH}</p><h2 id='related-work'>Related work</h2><p>Other text, here.</p><section id='social-policy'><p>Policy.</p></section></article>", f"{PARAGRAPH}Related work Other text, here. Policy."),
        (f"<head><title>The head - a site</title></head><body><header><h1>The head</h1><p>Tagline</p></header><div><p>{PARAGRAPH}</p></div>", f"The head {PARAGRAPH}".strip()),
        (f"<title>Site | The long head of it</title><div class=page-header><h1>The long head of it</h1></div><div><p>{PARAGRAPH}</p></div>", f"The long head of it {PARAGRAPH}".strip()),
        (f"<title>The long head of it | Site</title><header><h1>Site</h1></header><div><p>{PARAGRAPH}</p></div>", PARAGRAPH.strip()),
        (f"<div class='content no-sidebar has-menu'><p>{PARAGRAPH}</p></div><div class='c-comments wp-block'><p>{PARAGRAPH}</p></div><p id=x>{PARAGRAPH}</p>", f"{PARAGRAPH}{PARAGRAPH}".strip()),
        (f"<form id=all><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>End.</p></div></form>", f"{PARAGRAPH}{PARAGRAPH}End."),
        ("<p>x &am<b>p;</b> y</p>", "x &amp; y"),
        ("<div class=ad>Only an advert, so.</div>", ""),
    ],
)
def test_paths_select_the_text_whatever_is_named_article(source, text):
    assert html_text.main_text(source) == text


def plain_page(seed):
    """A page whose tags and names tell nothing: a menu, a teaser, the article, a side list and a foot; and the article's text."""
    rng = random.Random(seed)
    words = "the of and thing words made river stone light over under house garden morning evening people often never always small large".split()

    def sentence(low, high):
        w = [rng.choice(words) for _ in range(rng.randrange(low, high))]
        return " ".join([*w[:4], *([w[4] + ","] if len(w) > 8 else w[4:5]), *w[5:]]).capitalize() + "."

    parts = [("h1", sentence(3, 7)[:-1])]
    for _ in range(rng.randrange(2, 9)):
        parts.append(("p", sentence(2, 4) if rng.random() < 0.15 else " ".join(sentence(6, 16) for _ in range(rng.randrange(2, 8)))))
        if rng.random() < 0.2:
            parts += rng.choice([[("h2", sentence(2, 5)[:-1])], [("li", sentence(3, 8))] * 3, [("blockquote", sentence(20, 40))]])
    body = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>{rng.choice(words)}</a></li>" for i in range(rng.randrange(4, 10))) + "</ul></div>"
    teaser, foot = f"<div>{sentence(4, 8)}</div>", f"<div>&copy; {sentence(3, 8)}</div>"
    side = "<div>" + "".join(f"<div><a href=/{i}>{sentence(4, 8)}</a></div>" for i in range(5)) + "</div>"
    source = rng.choice([f"<body>{menu}{teaser}<div>{body}</div>{side}{foot}", f"<body><div>{menu}{teaser}<div><div>{body}</div></div>{foot}</div>", f"<table><tr><td>{menu}<td>{body}<td>{side}</table>{foot}"])
    return source, " ".join(x for _, x in parts)


def test_the_ratios_choose_on_pages_that_tell_nothing(monkeypatch):
    pages = [plain_page(seed) for seed in range(200)]
    assert sum(html_text.main_text(source) == text for source, text in pages) >= 194
    scores = html_text.path_scores
    monkeypatch.setattr(html_text, "path_scores", lambda page, blocks: dict.fromkeys(scores(page, blocks), 1.0))
    assert sum(html_text.main_text(source) == text for source, text in pages) <= 20


def test_deep_and_long_pages():
    deep = "".join(f"<div>t{i}" for i in range(100_000))
    began = time.process_time()
    assert len(html_text.main_text(deep)) > 688_000
    assert html_text.main_text("<ul><li>" + "<div>" * 50_000 + "<li>x</li>" * 50_000).count("x") == 50_000
    assert time.process_time() - began < 10
    long = "A sentence, of some words, again. " * 300_000
    assert html_text.main_text(f"<nav>menu</nav><p>{long}</p>") == long.strip()


def test_html_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, None, None, "k"), (1, None, None, "k")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.report(df).collect()] == [(1, "", 0)] * 2
    assert html_text.report(df.limit(0)).count() == 0


# -- decontamination


def test_decontamination_of_odd_rows(docs, bench_items, nothing):
    got = by_id(decontaminate.report(docs, bench_items))
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (13, 2, True)
    assert (got[3].n_words, got[4].n_words, got[5].n_words, got[3].n_items) == (0, 0, 0, 0)
    assert (got[None].n_hit, got[None].n_items) == (4, 0)
    assert got[7].n_items == 1 and got[6].n_words == 120_000
    assert decontaminate.report(nothing, bench_items).count() == 0
    assert by_id(decontaminate.report(docs, bench_items.limit(0)))[1].n_hit == 0


def test_blocks_of_the_benchmark_agree(docs, bench_items):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontaminate.report(docs, bench_items)) == key(decontaminate.report(docs, bench_items, block_bytes=20))


def test_removal(clashing, bench_items):
    spans = decontaminate.remove(clashing, bench_items)
    assert spans.columns == clashing.columns
    got = by_id(spans)
    assert "follows" not in got[1].text and got[1].text.endswith("the text, at last.") and got[6].text == LONG and got[3].text is None
    assert {r.doc_id for r in decontaminate.remove(clashing, bench_items, "documents").collect()} == {3, 4, 5, 6, 7, None}


def test_windows_never_cross_texts(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "x a b c d e f g h y")], "doc_id long, text string")
    item = spark.createDataFrame([(9, "A, b c-d e f g h")], "item_id long, text string")
    assert {i: r.n_hit for i, r in by_id(decontaminate.report(df, item)).items()} == {1: 0, 2: 0, 3: 8}


# -- substring dedup


def test_passages_go_but_the_first(clashing, nothing):
    got = substring_dedup.remove_repeats(clashing)
    rows = {(r.row.doc_id, r.row.source): r for r in got.collect()}
    assert rows[1, "a"].n_removed == 0 and rows[2, None].text == "" and rows[3, None].text is None
    dropped = substring_dedup.drop_repeats(clashing)
    assert dropped.columns == clashing.columns and {r.doc_id for r in dropped.collect()} == {1, 3, 4, 5, 6, 7, None}
    assert substring_dedup.drop_repeats(nothing).count() == 0


def test_passages_of_any_script_and_shape_are_found(spark):
    long = " ".join(f"word{i}" for i in range(60)) + "."
    two = " ".join(f"a{i}" for i in range(30)) + ". " + " ".join(f"b{i}" for i in range(30)) + "."
    chinese = "".join(chr(0x4E00 + i) + ("。" if i % 9 == 8 else "") for i in range(60)) + "。"
    hindi = "।".join(" ".join(chr(0x0905 + (7 * i + j) % 40) for j in range(8)) for i in range(5)) + "।"
    arabic = "، ".join(" ".join(chr(0x0627 + (5 * i + j) % 20) * 3 for j in range(8)) for i in range(5)) + "؟"
    tail = " ".join(f"c{i}" for i in range(20)) + ". " + " ".join(f"d{i}" for i in range(20)) + ". End of it all."
    texts = [long, two, chinese, hindi, arabic, tail]
    rows = [(2 * i + k, own + t) for i, t in enumerate(texts) for k, own in enumerate(("", "Not the same. "))]
    got = {r.row.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i] for i in range(len(texts))] == texts
    assert [got[2 * i + 1] for i in range(len(texts))] == ["Not the same."] * len(texts)


def test_short_texts_that_are_equal_are_one(spark):
    short = ["Only this one sentence.", "唯一的一句话。", "एक वाक्य।", "جملة واحدة؟"]
    df = spark.createDataFrame([(f"{k}-{i}", t.upper() if k else t) for k in (0, 1) for i, t in enumerate(short)] + [("9", "Only this one other sentence.")], "doc_id string, text string")
    got = {r.row.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {**{f"0-{i}": 0 for i in range(4)}, **{f"1-{i}": 1 for i in range(4)}, "9": 0}


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_a_span_that_most_documents_hold_crosses_tasks(spark, partitions):
    shared = "This is the notice that stands below each of the texts, word for word. It has some thirty words in two sentences, so that it is found, and it goes on. "
    df = spark.createDataFrame([(i, f"{shared}{i} is own." if i % 3 else f"{i} has none.") for i in range(3000)], "doc_id long, `a.b` string").withColumnRenamed("a.b", "text")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.row.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == {i: 2 if i % 3 and i != 1 else 0 for i in range(3000)}


def test_a_shared_passage_inside_other_text(spark):
    shared = "here is what they share, word for word, without a change. it has two sentences, so it counts, and it goes on, for so many words that it is a passage. "
    df = spark.createDataFrame([(8, "own begin, of eight. " + shared + "own end of eight."), (3, "three starts so. " + shared + "three stops so.")], "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert got[3].count("they share") == 1 and got[8] == "own begin, of eight. own end of eight."


# -- BPE


def test_bpe_of_odd_rows(docs, nothing):
    rows = bpe.encode(docs)
    back = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(rows).collect()}
    assert back[3] == ([], "") and back[4] == ([], "")
    assert all(back[i][1] == (t or "") for i, t, *_ in ROWS)
    assert by_id(bpe.report(docs))[6].n_tokens == len(back[6][0])
    assert bpe.report(nothing).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 37, 1000):
        keys = [f"key {i}".encode() for i in range(n)]
        table = bpe.PerfectHash(keys)
        assert sorted(table.slot(k) for k in keys) == list(range(n))


def test_pieces_change_nothing():
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    text = "don't stop  \n\n now 123 é🙂 " * 50
    assert [t for p in bpe.pieces(text, pattern, 17) for t in p] == pattern.findall(text)


def test_new_pretokens_are_merged_together(monkeypatch):
    import random

    ranks = bpe.read_ranks(bpe.default_path())
    tokenizer = bpe.Tokenizer(ranks, bpe.default_pattern(), bpe.PerfectHash(list(ranks)[:2000]))
    draw = random.Random(5)
    made = [b"", b"a", b"ab", b"  the", *(c * n for c in (b"a", b"ab", b"\xc3\xa9", b"\xff", b"\0", b" ") for n in (2, 5, 15, 16, 17, 31, 32, 33, 64, 65))]
    made += [bytes(draw.choice(letters) for _ in range(draw.randint(1, 64))) for letters in (b"etaonis", b" aeiou\xc3\xa9\xb3", range(256)) for _ in range(500)]
    want = [tokenizer.merge(x) for x in made]
    for width in bpe.WIDTHS:
        fit = [k for k, x in enumerate(made) if 0 < len(x) <= width]
        assert tokenizer.merge_rows([made[k] for k in fit], width) == [want[k] for k in fit]
    assert tokenizer.encode_tokens(made) == [tokenizer.encode_token(x) for x in made] and tokenizer.encode_tokens([]) == []

    words = ["".join(draw.choice("etaoinshr") for _ in range(12)) for _ in range(200)]
    alone = bpe.Memory(tokenizer)
    texts = ["", " ".join(words), words[0] * 30, " ".join(words[:100]), "it's  \n\n " + " ".join(words[50:])]
    want = [bpe._digest([tokenizer.pattern.findall(t)], alone) for t in texts]
    for size, most in ((1 << 20, 1000), (700, 1000), (1 << 20, 20), (30, 20)):
        memory = bpe.Memory(tokenizer, most)
        assert [bpe._digest(lists, memory) for lists in bpe.learned(texts, memory, size)] == want
    monkeypatch.setattr(bpe.Tokenizer, "merge", None)  # no heap of its own for any of many short pre-tokens
    memory = bpe.Memory(tokenizer)
    assert [bpe._digest(lists, memory) for lists in bpe.learned([texts[1]], memory)] == want[1:2]


def test_perfect_hash_of_many_keys():
    for n in (1, 2, 37, 1000):
        keys = [f"key {i}".encode() for i in range(n)]
        table = bpe.PerfectHash(keys)
        others = [f"other {i}".encode() for i in range(50)]
        assert table.slots_of(keys + others).tolist() == [table.slot(k) for k in keys + others]


# -- language


def test_language_of_odd_rows(docs, nothing):
    got = by_id(language_id.report(docs))
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert {r.lang_pred for r in language_id.report(nothing).collect()} == set()
    assert {r.lang_pred for r in language_id.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixtures_are_found(spark, duck):
    texts = {lang: duck.execute("SELECT string_agg(text, ' ') FROM (SELECT text FROM documents WHERE lang = ? ORDER BY doc_id LIMIT 30)", [lang]).fetchone()[0] for lang in ("en", "de", "fr")}
    df = spark.createDataFrame([(t, lang) for lang, t in texts.items()], "text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ["de", "en", "fr"]
    en, de = texts["en"][:3000], texts["de"][:1500]
    assert language_id.identify(en, model)[2] == "en"
    assert language_id.identify(en + " " + de, model)[2] == "en,de"


def brute_language(text, counts, names):
    """EM, ranking and penalised likelihood, written out with plain dictionaries."""
    data = " " + " ".join("".join(c if c.isascii() and c.islower() or not c.isascii() else " " for c in text.lower()).split()) + " "
    raw, x = data.encode(), {}
    for i in range(len(raw) - 2):
        code = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % 2**32 >> 17
        x[code] = x.get(code, 0) + 1
    totals = {n: sum(counts[n].values()) + 0.5 * 2**15 for n in names}
    p = {n: {f: (counts[n].get(f, 0) + 0.5) / totals[n] for f in x} for n in names}

    def em(of):
        share = dict.fromkeys(of, 1 / len(of))
        while True:
            mix = {f: sum(share[n] * p[n][f] for n in of) for f in x}
            new = {n: share[n] * sum(k * p[n][f] / mix[f] for f, k in x.items()) / sum(x.values()) for n in of}
            moved, share = max(abs(new[n] - share[n]) for n in of), new
            if moved < 1e-3:
                return share, sum(k * math.log(sum(share[n] * p[n][f] for n in of)) for f, k in x.items())

    whole = em(names)[0]
    order = sorted(names, key=lambda n: -whole[n])
    chosen, share, best = order[:1], {order[0]: 1.0}, sum(k * math.log(p[order[0]][f]) for f, k in x.items())
    for k in range(2, len(order) + 1):
        shares, value = em(order[:k])
        if whole[order[k - 1]] < 0.02 or value - best <= 1.5 * math.log(sum(x.values())):
            break
        chosen, share, best = order[:k], shares, value
    ranked = sorted(chosen, key=lambda n: -share[n])
    return ranked[0], min(1.0, whole[ranked[0]]), ",".join(ranked)


def test_languages_equal_brute_force(spark, duck):
    rows = duck.execute("SELECT doc_id, text, lang FROM documents WHERE lang IS NOT NULL AND length(text) BETWEEN 40 AND 900 ORDER BY doc_id LIMIT 60").fetchall()
    names = sorted({lang for _, _, lang in rows})
    counts = {n: {} for n in names}
    for _, text, lang in rows[:40]:
        for f, k in enumerate(language_id.counts(text)):
            if k:
                counts[lang][f] = counts[lang].get(f, 0) + int(k)
    model = language_id.fit(spark.createDataFrame([(t, n) for _, t, n in rows[:40]], "text string, lang string"))
    names = [n for n in names if counts[n]]
    assert model.languages == names
    for text in [t for _, t, _ in rows[30:]] + [rows[0][1] + " " + rows[-1][1], "a", "éé 12"]:
        lang, score, languages = language_id.identify(text, model)
        want = brute_language(text, counts, names)
        assert (lang, languages) == (want[0], want[2]) and math.isclose(score, want[1], rel_tol=1e-9)


# -- quality model


def test_scores_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (2, 1), (4, 0), (99, 1), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality_model.report(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.report(nothing, labels).count() == 0
    assert {r.score for r in quality_model.report(docs, labels.limit(0)).collect()} == {0.5}


def test_the_commonest_word_is_sought_among_all_words():
    at = quality_model.STATISTICS.index("most_common")
    for k in range(20):
        words = [f"w{i}" for i in range(200)] + [f"w{k}"] * 300
        assert math.isclose(quality_model.statistics(" ".join(words))[at], math.log(301.5 / 199.5))


def test_densities_are_those_of_the_formula(spark):
    rng = np.random.default_rng(0)
    d = len(quality_model.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (200, d)) for k in (0, 1)}
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k in (0, 1) for row in x[k]], "quality int, x array<double>")
    model = quality_model.fit(df, pooling=0.0, sphere=0.0, temper=1.0)
    probe = rng.normal(0.5, 1.5, (5, d))
    logs = []
    for k in (0, 1):
        m, c = x[k].mean(axis=0), np.cov(x[k].T, bias=True)
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", probe - m, np.linalg.inv(c), probe - m))
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(-(logs[1] - logs[0]))))


def test_scores_equal_brute_force(spark, duck):
    """The whole query, with the discriminant written out anew over the operator's statistics."""
    import zlib

    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    x = {i: np.array(quality_model.statistics(t)) for i, t in docs}
    learned = {k: np.array([x[i] for i in x if labels.get(i) == k and zlib.crc32(str(i).encode()) % 4 != 2]) for k in (0, 1)}
    n = sum(map(len, learned.values()))
    cov = {k: np.cov(v.T, bias=True) for k, v in learned.items()}
    pooled = sum(len(v) * cov[k] for k, v in learned.items()) / n
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    logs = {}
    for k, v in learned.items():
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * np.trace(c) / len(c) * np.eye(len(c))
        inverse, whole = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        logs[k] = {i: math.log(len(v) / n) - 0.5 * whole - 0.5 * (z @ inverse @ z) for i in x for z in [(x[i] - v.mean(axis=0)) / scale]}
    df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for r in quality_model.report(*df).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(min(700.0, 0.5 * (logs[0][r.doc_id] - logs[1][r.doc_id])))), rel_tol=1e-6, abs_tol=1e-9)


# -- SimHash


def clusters(seed, centres, members, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 14, 40])
@pytest.mark.parametrize("bits, shape", [(4, (30, 12, 5)), (4, (2, 150, 3)), (10, (40, 6, 9)), (1, (20, 10, 2))])
def test_links_connect_what_all_pairs_connect(spark, most, bits, shape):
    prints = clusters(5, *shape)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.link(nodes, max_bits=bits, most=most)).collect()}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            parent[find(i)] = find(i + 1 + int(j))
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(find(i), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g if len(g) > 1}
    assert roots == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_odd_rows(docs, clashing, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[3].fp == got[4].fp == got[5].fp == 0 and got[5].component_id == 3 and got[2].component_id == 1 and got[None].component_id is None
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7]
    assert simhash.keep_first(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("bar", "den", "fil", "gop", "hut")]
    base = [rng.choice(words) for _ in range(400)]
    near = list(base)
    for i in (50, 200, 333):
        near[i] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base))] + [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(10, 60)]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1} | set(range(10, 60))


def test_links_of_two_fingerprints_are_between_pairs(spark):
    prints = [(0, 0), (0, 2**30 - 1), (1, 2**30 - 1), (1, -1)]
    links = simhash.link(spark.createDataFrame(prints, "fp long, fp2 long"), max_bits=26, second="fp2")
    roots = {tuple(r.node): tuple(r.root) for r in components.components(links).collect()}
    assert roots == {(0, 2**30 - 1): (0, 2**30 - 1), (1, 2**30 - 1): (0, 2**30 - 1)}


def test_most_texts_of_similarity_08_are_linked(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrst"]
    rows, like = [], []
    for k in range(600):
        base = [rng.choice(words) for _ in range(rng.randrange(150, 500))]
        near = list(base)
        for i in rng.sample(range(len(base)), rng.randrange(1, max(2, len(base) // 45))):
            near[i] = "changed"
        a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, near))
        if len(a & b) / len(a | b) >= 0.8:
            like.append(k)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(like) > 300 and sum(2 * k + 1 not in kept for k in like) >= 0.9 * len(like)
    assert all(2 * k in kept for k in range(600))


def test_all_links_of_two_fingerprints_are_met(spark):
    rng = random.Random(3)
    rows, base = [], []
    for _ in range(400):
        x = rng.getrandbits(128)
        y = x ^ sum(1 << b for b in rng.sample(range(128), 26))
        base.append((x, y))
        rows += [(z & (1 << 64) - 1, z >> 64) for z in (x, y)]
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(signed, "fp long, fp2 long")
    for options in ({}, {"most": 20}):  # whole keys, and keys in blocks
        roots = {tuple(r.node): tuple(r.root) for r in components.components(simhash.link(nodes, max_bits=26, second="fp2", **options)).collect()}
        assert len(roots) == 800 and all(roots[tuple(signed[2 * k])] == roots[tuple(signed[2 * k + 1])] for k in range(400))
        assert len(set(roots.values())) == 400
    drawn = {frozenset((tuple(r.a), tuple(r.b))) for r in simhash.link(nodes, max_bits=26, second="fp2", recall=0.95).collect()}
    assert 0 < len(drawn) <= 400 and drawn <= {frozenset((tuple(signed[2 * k]), tuple(signed[2 * k + 1]))) for k in range(400)}


def test_links_within_a_large_key():
    rng = np.random.default_rng(5)
    ring = simhash.double_ring(26)
    assert len(ring) == 27 and sum(m | m2 << 64 for m, m2 in ring) == (1 << 128) - 1
    v, w = rng.integers(0, 1 << 64, (2, 3000), np.uint64)
    v2, w2 = v.copy(), w.copy()
    for k in range(3000):
        for b in rng.choice(128, 26, replace=False).tolist():
            (v2 if b < 64 else w2)[k] ^= np.uint64(1 << b % 64)
    crowd = rng.integers(0, 1 << 12, 3000).astype(np.uint64)  # all within 12 bits of each other
    v, w = np.concatenate([v, v2, crowd]), np.concatenate([w, w2, np.zeros(3000, np.uint64)])
    edges, found, spread = [], 0, []
    for start, masks in enumerate(ring):
        keys = np.unique(np.stack([v & np.uint64(masks[0]), w & np.uint64(masks[1])]), axis=1, return_inverse=True)[1]
        for key in range(keys.max() + 1):
            at = np.flatnonzero(keys == key)
            chain = simhash._Chain(ring, start, 26)
            spread.append(len(chain.buckets(v[at], w[at])[1]))
            for i, j in chain.links(v[at], w[at]):
                assert len(i) < len(at)
                edges.append(np.stack([at[i], at[j]]))
    i, j = simhash._forest(*np.concatenate(edges, axis=1), len(v))
    root = np.arange(len(v))
    root[j] = i
    assert max(spread) > 1 and (root[:3000] == root[3000:6000]).all() and len(np.unique(root[6000:])) == 1
    assert len(np.unique(root)) == 3001


def test_decontamination_takes_one_python_worker_a_task(spark):
    benchmark = spark.createDataFrame([("i", "one two three four five six seven eight")], "item_id string, text string")
    rows = [(1, "Before, one two three four five six seven eight; after."), (2, "Nothing of it."), (3, "one two three four five six seven eight"), (4, None)]
    df = decontaminate.remove(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = [(1, "Before, ; after."), (2, "Nothing of it."), (4, None)]
    assert sorted(map(tuple, df.collect())) == want
    longer = benchmark.union(spark.createDataFrame([("j", "words that no text has, at any place, not one")], benchmark.schema))
    assert sorted(map(tuple, decontaminate.remove(spark.createDataFrame(rows, "doc_id long, text string"), longer, block_bytes=20).collect())) == want


def test_comparisons_of_distinct_fingerprints_grow_slowly():
    rng = np.random.default_rng(4)
    work = {}
    for n in (1 << 14, 1 << 18):
        fp, fp2 = rng.integers(0, 1 << 63, (2, n), np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, n), np.uint64)
        masks = simhash.sampled_keys(n)
        pairs = sum(int((c * (c - 1) // 2).sum()) for m, m2 in masks for c in [np.unique((fp & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) ^ (fp2 & np.uint64(m2)), return_counts=True)[1].astype(np.int64)])
        work[n] = n * len(masks), pairs
    (rows, pairs), (more_rows, more_pairs) = work.values()
    assert more_pairs <= simhash.PER_KEY * more_rows
    assert math.log(more_rows / rows, 16) < 1.3 and math.log(more_pairs / pairs, 16) < 1.35  # sixteen times as many fingerprints


def test_ids_of_other_types(spark):
    text = PROSE + "A third one ends the text, at last."
    df = spark.createDataFrame([("b", text), ("a", text), (None, text), ("c", "Another text that is not like it, with words of its own, all of them.")], "doc_id string, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == ["a", "c"]
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {"a", "c"}
    assert {r.doc_id: r.n_removed > 0 for r in substring_dedup.remove_repeats(df).select("row.doc_id", "n_removed").collect()} == {"a": False, "b": True, "c": False, None: True}
