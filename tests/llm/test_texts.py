"""SpotSigs, pages, quality, licences and personal data."""

import hashlib
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import htmltext, licenses, pii, quality, spotsigs
from wardline.llm import queries as llm


def plain_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    out = set()
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    for k, (i, w) in enumerate(content):
        j = i - 1
        while j >= 0 and words[j] in spotsigs.ANCHORS:
            out.add((words[j], w, content[k + 1][1] if k + 1 < len(content) else None))
            j -= 1
    return out or ({tuple(words)} if words else set())


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_plain_sets(documents, texts):
    got = {r["doc_id"]: r for r in spotsigs.compared(documents).collect()}
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[nxt][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        own = plain_signatures(texts[i])
        assert r["n_signatures"] == len(own)
        assert abs(r["near_edited"] - plain_likeness(own, plain_signatures(edited))) < 1e-9
        assert abs(r["near_next"] - plain_likeness(own, plain_signatures(texts[nxt]))) < 1e-9


def test_fingerprints_of_odd_rows(odd, none):
    rows = spotsigs.compared(odd).collect()
    assert len(rows) == 12
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert {r["near_edited"] for r in rows if r["doc_id"] == 3} == {1.0}
    assert spotsigs.compared(none).count() == 0


def test_next_row_across_sparse_chunks(spark):
    ids = [-5000, -1, 0, 1, 1023, 1024, 5_000_000, 2**50, 2**50 + 1]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, ["text"], chunk=4).collect()}
    assert got == {i: str(n) for i, n in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_near_groups_against_all_pairs(documents, texts):
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_groups(documents).collect()}
    sets = {i: plain_signatures(t) for i, t in texts.items()}
    ids, label = sorted(texts), {i: i for i in texts}
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and plain_likeness(sets[a], sets[b]) >= 0.8]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert got == label


def test_near_groups_of_what_all_sets_share_and_odd_rows(spark, odd, none):
    shared = "the alpha beta of gamma delta in epsilon zeta for eta theta "
    rows = [(i, shared + " ".join(f"the w{i % 4}x{k} v{k}" for k in range(40))) for i in range(60)]
    rows += [(100 + i, shared * (i + 1)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_groups(df).collect()}
    sets = {i: plain_signatures(t) for i, t in rows}
    for i, own in sets.items():
        for j, other in sets.items():
            if plain_likeness(own, other) >= 0.8:
                assert got[i] == got[j]
    assert {got[i] for i in range(60)} == {0, 1, 2, 3}
    assert spotsigs.near_groups(odd).count() == 12 and spotsigs.near_groups(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies and so do you.</div><aside>Side bar of the page</aside><article><header><h1>Head &amp; line</h1></header>
<p>One <b>bold</b>word&nbsp;and
 more.<br>Two<p>Short.<form><input>name</form><div id="comments"><p>I like it, says the reader</p></div><!-- gone --><style>p{}</style></article>
<footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert htmltext.main_text(PAGE) == "Head & line One boldword and more. Two Short."
    assert htmltext.main_text("") == "" and htmltext.main_text("<p") == "" and htmltext.main_text("a < b") == ""


def test_layout_words_are_not_furniture():
    page = '<div class="content has-sidebar no-ads"><article><p>Some words.</p></article></div><div class="sidebar">Gone.</div>'
    assert htmltext.main_text(page) == "Some words."


ARTICLE = " ".join("It is what the page is about and has the words that all texts have." for _ in range(5))


def test_what_holds_the_article_is_not_furniture():
    for before, after in [
        ('<div class="main-content sidebar-right"><article>', "</article></div>"),
        ('<div class="content-with-sidebar"><article>', "</article></div>"),
        ('<div id="social"><div class="post"><main>', "</main></div></div>"),
        ('<form action="/x"><article>', "</article></form>"),
        ('<form action="/x"><div class="promo">', "</div></form>"),
        ('<div class="ad"><article><p>A short teaser of the other page.</p></article></div><article>', "</article>"),
        ("<article>", '<div class="comments"><article><p>' + "I think that it is not so. " * 100 + "</p></article></div></article>"),
        ("<article>", '</article><div class="related"><article><p>A teaser.</p></article></div>'),
    ]:
        assert htmltext.main_text(f"{before}<p>{ARTICLE}</p>{after}") == ARTICLE, before


def test_comments_are_furniture_even_if_they_are_most_of_the_page():
    comments = '<div class="comments"><p>' + "I think that it is not so. " * 100 + "</p></div>"
    assert htmltext.main_text(f"<div><p>{ARTICLE}</p></div>{comments}") == ARTICLE
    assert htmltext.main_text(f"<div><p>{ARTICLE}</p></div><div class='sidebar'><p>{ARTICLE[:200]}</p></div>") == ARTICLE


def test_a_quote_counts_only_after_an_equals_sign():
    for tag in ["<p title=it's>", "<p it's>", "<p \">", "<p title = 'a > b'>", '<p title="a > b" x>']:
        assert htmltext.main_text(f"<article>{tag}{ARTICLE}</p></article>") == ARTICLE, tag


def test_deep_and_unclosed_tags_are_linear():
    begin = time.perf_counter()
    for page in ("<b>" * 100_000 + "</i>" * 100_000, "<div class=ad>" * 50_000 + "x", '<p a="' * 100_000, "<p '" * 100_000):
        assert htmltext.main_text(page) in ("", "x")
    assert time.perf_counter() - begin < 30


def test_main_text_by_rules_alone():
    long = "It is one of the things that you have to do in the end, and it is not what they said to us. " * 4
    page = f"<body><div><a href=x>Links and more of the links are here</a></div><p>{long}</p><p>Ok.</p><p>{long}</p><div><a href=y>next page of the list</a></div><div>tiny end</div></body>"
    assert htmltext.main_text(page) == f"{' '.join(long.split())} Ok. {' '.join(long.split())}"


def test_pages_against_their_articles(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in llm.op3_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        wanted = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r["page_id"]]["text"] == wanted and got[r["page_id"]]["n_chars"] == len(wanted)


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "x"), (2, "u", PAGE, None), (2, "u", PAGE, None)], "page_id long, url string, html string, extra string")
    rows = htmltext.extract(df).collect()
    assert sorted(r["text"] for r in rows)[:2] == ["", ""] and len(rows) == 4 and "extra" in rows[0].asDict()
    assert htmltext.extract(df.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = llm.op4_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(seen) > 800 and np.mean([a == b for a, b in seen]) > 0.98


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (9, 0, 0), (10, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_from(odd, labels)
    rows = quality.scored(odd, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if not (r["text"] or "").strip()} == {0.0}
    assert quality.scored(none, quality.fit_from(none, labels)).count() == 0
    assert {r["score"] for r in quality.scored(odd, quality.fit_from(odd, labels.limit(0))).collect()} == {0.0}


def test_license_notices(odd, none):
    rows = licenses.scan(odd).collect()
    assert [(r["doc_id"], r["line"], r["license"], r["n_differences"]) for r in rows] == [(9, 0, "Apache-2.0", 0)]
    assert licenses.scan(none).count() == 0


def test_license_wording():
    matcher = licenses.Matcher()
    for name, text in licenses.TEMPLATES.items():
        assert matcher.find(text)[0] == name and matcher.find(text)[2] == []
        assert matcher.find(f"Some words. {text.upper()} More of them")[0] == name
    assert matcher.find("He lost his driving license") is None
    assert matcher.find("Released under the terms of the MIT License.")[2] == ["+terms", "+of", "+the"]


def test_license_in_long_lines(spark):
    """A notice is found wherever it stands in a line, and blocks stay short."""
    prose, notice = "the cat sat on a mat and looked at it " * 3000, licenses.TEMPLATES["MPL-2.0"]
    line = f"{prose}{notice} {prose}{licenses.TEMPLATES['MIT']} {prose}{notice}"
    rows = licenses.scan(spark.createDataFrame([(1, line), (2, "ü" * 5000 + " licence " * 9000), (3, "license" * 150000), (4, f"{notice} {prose}")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["line"], r["license"]) for r in rows) == [(1, 0, "MIT"), (1, 0, "MPL-2.0"), (4, 0, "MPL-2.0")]
    reach = licenses.Matcher().reach
    blocks = list(licenses.blocks_of(line.encode(), reach))
    assert all(len(b) <= 5 * reach + 20 for b in blocks) and sum(notice.encode() in b for b in blocks) == 2


def test_license_scan_finds_each_known_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {(r["doc_id"], n) for r in docs.collect() for n, line in enumerate(r["text"].split("\n")) if line in licenses.TEMPLATES.values()}
    assert {(r["doc_id"], r["line"]) for r in licenses.scan(docs).collect()} == wanted and wanted


def hidden(spark, texts, key=pii.DEFAULT_KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    return [r for r in pii.pseudonymised(df, key=key).orderBy("doc_id").collect()]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    cases = {
        "email": ("hein.19@mail5.example.com", r"[a-z]{4}\.\d\d@mail5\.example\.com"),
        "phone": ("+1 (743) 555-3824", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        "card": ("4111 1111 1111 1111", r"4\d{3} \d{4} \d{4} \d{4}"),
        "ip": ("192.168.1.254", r"\d+\.\d+\.\d+\.\d+"),
        "ssn": ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
        "secret": ("24be64439e3e49cf46b2d7c90f3602a3", r"[0-9a-f]{32}"),
        "date": ("1999-12-31", r"\d{4}-\d\d-\d\d"),
    }
    rows = hidden(spark, [f"See {value}, {value}!" for value, _ in cases.values()])
    for (kind, (value, shape)), row in zip(cases.items(), rows, strict=True):
        first, second = re.fullmatch(rf"See ({shape}), ({shape})!", row["text"]).groups()
        assert first == second != value and row[f"n_{kind}"] == 2
        if kind == "card":
            assert luhn(first)
        if kind == "ip":
            assert all(int(x) < 256 for x in first.split("."))
    assert hidden(spark, ["See 1999-12-31"], key="other")[0]["text"] != hidden(spark, ["See 1999-12-31"])[0]["text"]


def test_what_is_not_valid_stays(spark):
    texts = ["4111 1111 1111 1112", "9807915762804490", "300.1.1.1", "v1.2.3.4.5", "2023-02-30", "000-12-3456", "abcdefabcdefabcdefabcdefabcdefab", "12 + 34 (56)", None, "", "plain"]
    assert [r["text"] for r in hidden(spark, texts)] == texts


def test_pseudonyms_are_a_permutation(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1900-01-01', DATE'2099-12-31')) AS day").select(F.col("day").cast("string").alias("text")).withColumn("doc_id", F.lit(1))
    new = days.select(pii._date(F.col("text"), "k").alias("t"))
    assert new.distinct().count() == days.count() and new.where("t IS NULL OR try_to_date(t) IS NULL").isEmpty()
    numbers = spark.range(10000).select(pii.feistel(F.lpad(F.col("id").cast("string"), 4, "0"), "x", "k").alias("t"))
    assert numbers.distinct().count() == 10000
    addresses = spark.range(65536).select(pii._ip(F.concat(F.lit("10.1."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256), "k").alias("t"))
    assert addresses.distinct().count() == 65536


def test_pii_of_odd_rows(odd, none):
    rows = pii.pseudonymised(odd).collect()
    assert len(rows) == 12 and {r["n_card"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert pii.pseudonymised(none).count() == 0


def test_an_unbroken_megabyte_is_linear(spark):
    import time

    df = spark.createDataFrame([(1, "x@ " + "a1" * 500_000 + " 4" * 200_000)], "doc_id long, text string")
    start = time.monotonic()
    assert pii.pseudonymised(df).select(F.length("text")).first()[0] == 1_400_003
    assert time.monotonic() - start < 30


def test_cards_before_other_numbers(spark):
    """A card is hidden whatever number stands before or after it; equal cards stay linked."""
    card, amex = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [card, f"{card} 12/27", f"{card} 123", f"2222 {card}", f"3 {card} 5500 0000 0000 0004", "4111111111111111 4845168114407329", "4111111111111111 3 times", f"{amex} 4", "41111111 11111111 12", f"6 {card} 7 {card}"]
    rows = hidden(spark, texts)
    new = re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", rows[0]["text"])[0]
    assert new != card and [r["n_card"] for r in rows] == [1, 1, 1, 1, 2, 2, 1, 1, 1, 2]
    assert [r["text"] for r in rows[1:4]] == [f"{new} 12/27", f"{new} 123", f"2222 {new}"] and rows[4]["text"].startswith(f"3 {new} 5") and rows[9]["text"] == f"6 {new} 7 {new}"
    assert re.fullmatch(r"4\d{15} 3 times", rows[6]["text"]) and re.fullmatch(r"3\d{3} \d{6} \d{5} 4", rows[7]["text"]) and re.fullmatch(r"4\d{7} \d{8} 12", rows[8]["text"])
    for row, text in zip(rows, texts, strict=True):
        assert not {"4111", "4845168114407329", "3782"} & set(row["text"].split()) and len(row["text"]) == len(text)


def test_phones_end_before_cards_and_other_numbers(spark):
    texts = [
        "+1 (743) 555-3824 4111 1111 1111 1111",
        "+1 (743) 555-3824",
        "+1 (743) 555-3824 2019",
        "+44 20 7946 0958 1234 5678 9012",
        "+44 20 7946 0958 4111111111111111 x",
    ]
    both, alone, year, long, card = (r["text"] for r in hidden(spark, texts))
    assert "555-3824" not in both and "4111 1111 1111 1111" not in both and both.startswith(alone + " ")
    assert year == f"{alone} 2019"
    assert "7946 0958" not in long and re.fullmatch(r"\+44( [0-9]+){6}", long)
    assert "4111111111111111" not in card and "7946 0958" not in card
    number = re.search("[0-9]{16}", card)[0]
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(number)) % 10 == 0


def test_dates_in_timestamps_and_day_first_are_linked(spark):
    plain, stamp, dotted, not_a_day = (r["text"] for r in hidden(spark, ["1985-12-31", "1985-12-31T10:00:00Z", "31.12.1985", "31.02.1985 1985-12-31Tx"]))
    assert plain != "1985-12-31" and stamp == f"{plain}T10:00:00Z"
    assert dotted == ".".join(reversed(plain.split("-"))) and not_a_day == "31.02.1985 1985-12-31Tx"


def test_the_key_comes_from_the_session_where_it_is_not_given(spark):
    text = ["mail a.person@example.org"]
    given, usual = hidden(spark, text, key="another")[0]["text"], hidden(spark, text)[0]["text"]
    df = spark.createDataFrame([(0, text[0])], "doc_id long, text string")
    assert pii.pseudonymised(df).first()["text"] == usual
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.pseudonymised(df).first()["text"] == given != usual
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_quality_and_counts_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "x", 7, "y")], "doc_id long, text string, SCORE string, n_email int, predicted string")
    model = quality.fit_from(df, spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.scored(df, model)
    assert scored.columns == ["doc_id", "text", "n_email", "score", "predicted"] and scored.first()["score"] == 0.0
    assert pii.pseudonymised(df).first()["n_email"] == 1 and pii.pseudonymised(df, counts=False).first()["n_email"] == 7
