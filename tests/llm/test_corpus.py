"""Operators over the whole corpus: near-duplicates, line dedup, urls, conversations, the pipeline."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sentryframe.llm import chat, html, linededup, minhash, urls

from .builders import awkward, clashing, documents, prose


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(texts, n=4):
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))}


def near_texts():
    rng = random.Random(7)
    texts = []
    for base in range(12):
        words = prose(base, rng.choice((3, 8, 60, 200))).split()
        for _ in range(rng.choice((1, 2, 9, 30))):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(("new", "other", "words"))
            texts.append(" ".join(copy) if rng.random() < 0.8 else "\t".join(copy).upper())
    notice = prose(99, 30)
    texts += [f"{prose(500 + i, 20)} {notice}" for i in range(30)]
    return [*texts, None, "", " ", "one", "ONE", "two words"]


def test_components_equal_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = brute_components(texts)
    docs = clashing(documents(spark, texts))

    def got():
        return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.components(docs, words=4).collect()}

    assert got() == want
    # Small bounds: common values, lists and bundles in many blocks.
    monkeypatch.setattr(minhash, "COMMON", 5)
    monkeypatch.setattr(minhash, "LIST_ROWS", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    assert got() == want


def test_components_take_awkward_rows(spark):
    rows = minhash.components(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [(r["component_id"], r["kept"]) for r in by_id[None]] == [(None, True)]
    assert by_id[6][0]["component_id"] == 5 and not by_id[6][0]["kept"] and len(by_id[3]) == 2
    assert minhash.components(documents(spark, [])).count() == 0


def test_components_follow_every_text_of_a_repeated_id(spark):
    a, b = prose(71, 60).split(), prose(72, 60).split()
    near = lambda words, i: " ".join([*words[:-i], *["changed"] * i])
    mixed = " ".join(a + b)
    rows = [(7, near(a, 1)), (7, near(b, 1)), (9, " ".join(a)), (8, " ".join(b)), (3, mixed), (5, mixed), (5, near(a, 2)), (6, prose(73, 60))]
    rows = [(i, t, None, None, 0) for i, t in rows]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.components(docs, words=4).collect()}
        assert got == {(3, 3, True), (5, 3, False), (6, 6, True), (7, 3, False), (8, 3, False), (9, 3, False)}


def test_shingler_cuts_do_not_change_words(monkeypatch):
    text = prose(3, 3000).encode()
    whole = minhash.Shingler(5).set_of(text)
    monkeypatch.setattr(minhash, "CHUNK", 50)
    assert (minhash.Shingler(5).set_of(text) == whole).all()


def brute_lines(texts):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        lines = None if text is None else text.split("\n")
        solid = [] if text is None else [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for s in range(len(solid) - 2):
            window = tuple(lines[k] for k in solid[s:s + 3])
            if window in seen:
                gone.update(solid[s:s + 3])
            seen.add(window)
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(("a", "b", "", " ", "c")) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += ["p\nq\nr\ns\nt", "x\np\nq\n\nr\ny", None, "", "a\na\na\na\na", "only\ntwo"]
    docs = clashing(documents(spark, texts))
    got = linededup.dedup_lines(docs)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(texts)
    assert set(docs.columns) <= set(got.columns)
    rows = linededup.dedup_lines(awkward(spark))
    assert rows.count() == awkward(spark).count() and linededup.dedup_lines(documents(spark, [])).count() == 0


PAGES = "page_id long, url string, html string"


def url_pages(spark, n=240):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        kind = i % 4
        host = ("news.site.com", "shop.site.net", "news.site.org", "casino.org")[kind]
        path = ("/story/", "/es/bets/", "/story/", "/bets/")[kind] + str(rng.randint(0, 99))
        rows.append((i, f"http://{host}{path}", None))
    rows += [(n, None, None), (n + 1, "", None), (n + 2, "no scheme", None), (n + 3, "http://A.Example.COM/en/x?y#z", None),
             (n + 4, "http://www.example.com/en/x", None), (n + 5, "http://com", None), (n + 6, "x://y://com/", None), (None, "http://b.net/fr/", None)]
    return spark.createDataFrame(rows, PAGES)


def test_url_rules_and_models(spark):
    pages = clashing(url_pages(spark))
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert [tuple(got[240 + i][c] for c in ("host", "path", "rule", "verdict")) for i in (0, 1, 3, 4)] == [
        ("", "", None, "block"), ("", "", None, "block"), ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert (got[245]["host"], got[245]["path"], got[245]["rule"]) == ("com", "", None)
    assert (got[246]["host"], got[246]["path"]) == ("y:", "//com/") and got[None]["rule"] == "net/fr/"
    assert {got[i]["verdict"] for i in range(2, 240, 4)} == {"allow"} and {got[i]["verdict"] for i in range(3, 240, 4)} == {"block"}
    assert urls.judge_urls(url_pages(spark).limit(0)).count() == 0


def test_url_scores_equal_brute_force(spark):
    examples = [("news.com/a1", "allow"), ("news.com/b2", "allow"), ("bets.net/a1", "block")]
    asked = ["news.org/a1", "bets.org/zz"]
    grams = urls.count_grams(spark.createDataFrame(examples, "body string, verdict string"))
    got = {r["body"]: r["score"] for r in urls._scores(spark.createDataFrame([(a,) for a in asked], "body string"), grams).collect()}

    def model(side):
        counts = collections.defaultdict(collections.Counter)
        for body, verdict in examples:
            text = urls.BEGIN + body + urls.END
            if verdict == side:
                for i in range(1, len(text)):
                    for k in range(min(urls.ORDER, i) + 1):
                        counts[text[i - k:i]][text[i]] += 1
        return counts

    def chance(counts, text, i):
        p = 1 / urls.ALPHABET
        for k in range(min(urls.ORDER, i) + 1):
            seen = counts.get(text[i - k:i])
            if seen:
                p = (seen[text[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    yes, no = model("allow"), model("block")
    for body in asked:
        text = urls.BEGIN + body + urls.END
        each = [math.log(chance(yes, text, i)) - math.log(chance(no, text, i)) for i in range(1, len(text))]
        assert got[body] == pytest.approx(sum(each) / len(each), abs=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header>Site</header><div class="cookie-notice">We use, cookies, here, and, there</div>
<article><h1>Head &amp; line</h1><p>First,  of\n all &lt;b&gt;<b>bold<br>text<p>Second &eacute;&#233;.</p><div class="ad">Buy, buy, buy</div>
<form><p>Sign up, now</p></form></article><aside>More, and, more</aside><section id="comments"><p>Nice, nice, nice</p></section>
<footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &amp; simple"), (None, "u", "<p>a<p>b"), (1, "u", PAGE),
            (5, "u", "<div><p>" + "long, text " * 50_000 + "</p></div>"), (6, "u", "<body><div id=main><p>one, two, three</p><p>four</p></div><div class=sidebar><p>five, six, seven, eight</p></div></body>")]
    got = [r["text"] for r in html.extract(clashing(spark.createDataFrame(rows, PAGES))).orderBy(F.col("page_id").asc_nulls_first()).collect()]
    article = "Head & line\n\nFirst, of all <b>bold text\n\nSecond éé."
    assert got[0] == "a\n\nb" and got[1] == got[2] == article and got[3] == got[4] == ""
    assert got[5] == "plain & simple" and got[6] == ("long, text " * 50_000).strip() and got[7] == "one, two, three\n\nfour"
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_html_keeps_the_same_parts_at_any_length():
    for n in (3, 30):
        body = "".join(f"<p>part {i}, one, two, three, four, five</p>" for i in range(n))
        text = [f"part {i}, one, two, three, four, five" for i in range(n)]
        parts = f"<h1>Head</h1><div>{body}</div><ul><li>item</ul><blockquote>said</blockquote><table><tr><td>cell</table><p>short"
        whole = "\n\n".join(["Head", *text, "item", "said", "cell", "short"])
        links = "<ul><li><a href=/x>Elsewhere</a></ul>"
        assert html.extract_text(f"<body><nav>menu</nav><article>{parts}</article>{links}") == whole
        assert html.extract_text(f"<body><main><div>{parts}</div></main>{links}") == whole
        assert html.extract_text(f"<body><div>{parts}{links}</div>{links}") == whole
        said = "\n\n".join(["See this now", *text, "end, of it"])
        assert html.extract_text(f"<div>See <b>this</b> now<section>{body}</section><section><p>end, of it</section></div>") == said


def test_html_names_do_not_cut_the_article():
    side = "<div class='sidebar'><p>side, side, side</p></div><div class=site-footer><p>foot, foot</p></div>"
    text = "<h1>Head</h1><p>one, two, three</p><p>four</p>"
    for name in ("site has-sidebar", "layout-with-sidebar", "no-ads", "post-with-comments", "sidebar-layout", "withSidebar"):
        for page in (f"<article>{text}</article>{side}", f"<main>{text}{side}</main>", f"<div>{text}</div>{side}"):
            assert html.extract_text(f"<body><div class='{name}'><div id=x>{page}</div></div></body>") == "Head\n\none, two, three\n\nfour"
    talk = "<div class=comments>" + "<p>nice, nice, nice</p>" * 30 + "</div><div class=related><article><a href=/x>More</a></article></div>"
    assert html.extract_text(f"<body><article>{text}</article>{talk}</body>") == "Head\n\none, two, three\n\nfour"


def test_html_forms_headers_labels_and_quotes():
    text, want = "<h1>Head</h1><p>one, two, three</p><p>four</p>", "Head\n\none, two, three\n\nfour"
    sign = "<form><p>Sign up, now, please</p><label>Mail</label><input></form>"
    assert html.extract_text(f"<body><form id=aspnetForm><div><nav>menu</nav>{text}</div></form></body>") == want
    assert html.extract_text(f"<body><form id=aspnetForm><article>{text}{sign}</article></form></body>") == want
    assert html.extract_text(f"<body><div>{text}{sign}</div></body>") == want
    assert html.extract_text("<article><header><h1>Big <b>news</b></h1><p>by, me</p></header><p>one, two</article>") == "Big news\n\none, two"
    assert html.extract_text("<body><header><h1>Site</h1></header><article><header hidden><h1>x</h1></header><p>one, two</article>") == "one, two"
    assert html.extract_text("<article><p>one <label>word</label> two</article>") == "one word two"
    page = "<p title=don't>One, two.</p><p>It's fine, more.</p><p title = 'a > b'>Third's text.</p>"
    assert html.extract_text(page) == "One, two.\n\nIt's fine, more.\n\nThird's text."


def test_html_doubtful_names():
    page = "<article><p>a, b</p><div class={}><p>some, text {}</p></div></article>".format
    for name in ("market-share", "social-science", "header-image", "media-widget"):
        assert html.extract_text(page(name, "")) == "a, b\n\nsome, text"
        assert html.extract_text(page(name, "<a href=/x>and a long link</a>")) == "a, b"
    for name in ("site-header", "share-buttons", "notice-bar", "ad-leaderboard", "comment-thread", "widget", "widget-2"):
        assert html.extract_text(page(name, "")) == "a, b"


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip_of_any_text(spark):
    bad = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "\\", "<", "|im_end|>", "<\\\\|x", None, "", "a\nb", "<|<|", "é日"]
    rows = [(1, i, ("user", "assistant", None, "sys\\n\n<|x")[i % 4], t) for i, t in enumerate(bad)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "user", "first"), (None, 0, "user", "no id"), (3, 5, "user", "z" * 200_000)]
    made = chat.format_paths(chat.reply_paths(chat.from_turns(clashing(spark.createDataFrame(rows, CONVERSATIONS)))))
    got = {r["thread"]: r for r in made.select(
        "thread", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("pieces"), F.col("loss_pieces")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[:len(bad)]]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(bad) if i % 4 == 1)
    assert [t["text"] for t in got[2]["turns"]] == ["first", "x", "x"] and got[None]["turns"][0]["text"] == "no id"
    assert len(got[3]["formatted"]) == 200_000 + len("<|im_start|>user\n<|im_end|>\n")
    assert chat.format_paths(chat.reply_paths(chat.from_turns(spark.createDataFrame([], CONVERSATIONS)))).count() == 0


def test_reply_trees_rank_branches(spark):
    rows = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "good", 2.0), ("t", "c", "a", "assistant", "bad", 1.0),
            ("t", "d", "b", "user", "more", 0.0), ("t", "b", "a", "assistant", "good", 2.0), ("u", "x", "y", "user", "loop", 1.0),
            ("u", "y", "x", "user", "loop", 1.0), ("u", "z", "x", "user", "tail", 1.0), ("w", "o", "gone", "user", "orphan", None)]
    rows += [("deep", f"{i:03}", f"{i - 1:03}" if i else None, "user", str(i), 1.0) for i in range(100)]
    trees = spark.createDataFrame(rows, "thread_id string, message_id string, parent_id string, role string, text string, score double")
    got = collections.defaultdict(list)
    for r in chat.reply_paths(trees, score="score").orderBy("pos").collect():
        got[r["thread"], r["rank"], r["leaf"]].append(r["text"])
    assert got == {("t", 1, "d"): ["q", "good", "more"], ("t", 2, "c"): ["q", "bad"], ("w", 1, "o"): ["orphan"], ("deep", 1, "099"): [str(i) for i in range(100)]}
    assert {r["rank"] for r in chat.reply_paths(trees, score="score", best=1).collect()} == {1}


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    texts, langs = [], {}
    for i in range(60):
        texts.append("\n".join(prose(10 * i + k, 12) for k in range(4)))
        langs[i] = "aa"
    copy = texts[0].split()
    copy[3] = "changed"
    item = prose(77, 14, ["bench", "mark", "words", "here"])
    texts += [" ".join(copy) + " x", texts[1], f"{prose(900, 30)} {item}", None, "123 ...", "lead\n" + texts[2] + "\ntail"]
    docs = documents(spark, texts, langs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(kept) and not {61, 62, 63, 64} & set(kept)
    assert 65 in kept and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in kept.values())
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and first.count() == len(texts) - 2
    assert corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).where("doc_id in (60, 61)").count() == 0


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    """Clashing columns keep their values, repeated rows go once, null ids and empty tables pass."""
    import corpus_pipeline

    spark.createDataFrame([(1, "no such words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(awkward(spark)).withColumns({"gone": F.lit("own"), "n_hit": F.lit("own"), "doc": F.lit("own"), "n_removed": F.lit("own")})
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, str(tmp_path))
            assert got.columns == docs.columns, name
            assert got.where("gone <> 'own' or n_hit <> 'own' or doc <> 'own' or n_removed <> 'own' or score <> 'clash'").count() == 0
            if rows is not docs:
                assert got.count() == 0
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in left]
    assert sorted(i for i in ids if i is not None) == [i for i in range(11) if i != 6] and ids.count(None) == 1
    text = prose(5, 40)
    same = documents(spark, [text, prose(6, 40), text]).unionByName(documents(spark, [text, prose(7, 40)])).unionByName(documents(spark, [text]))
    left = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, same, str(tmp_path)).collect())
    assert left == [(0, text), (1, min(prose(6, 40), prose(7, 40)))]


def test_queries_have_the_contracted_columns(spark):
    from sentryframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op10_chat_format"](spark, sf).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(text)
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
