import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, tricky

from keytide.llm import decontaminate, html_text, lm_score, registry, toxicity, url_reputation


def duck(sql, **tables):
    con = duckdb.connect()
    for name, (cols, rows) in tables.items():
        con.execute(f"create table {name} ({cols})")
        if rows:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def brute_scores(rows):
    docs = [lm_score.tokens(t) for _, t in rows]
    grams = [Counter(tuple(d[i : i + n]) for n in (1, 2, 3) for i in range(len(d) - n + 1)) for d in docs]
    total = sum(grams, Counter())
    size = sum(map(len, docs))
    out = []
    for (i, _), d, own in zip(rows, docs, grams):
        left = lambda g: total[g] - own[g]  # noqa: B023, E731
        score = 0.0
        for k in range(len(d)):
            longest = min(3, k + 1)
            for n in range(longest, 0, -1):
                g = tuple(d[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(max(left(g), 1) / max(size - len(d), 1))
                elif left(g) > 0:
                    score += math.log(left(g) / left(g[:-1]))
                    break
                else:
                    score += math.log(lm_score.ALPHA)
        out.append((i, len(d), score))
    return out


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_backoff_scores(spark, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", block)
    monkeypatch.setattr(lm_score, "PART_ENTRIES", 500)
    rows = tricky()
    got = sorted(map(tuple, lm_score.score(documents(spark, rows)).collect()), key=str)
    want = sorted(brute_scores(rows), key=str)
    assert [(a[0], a[1]) for a in got] == [(b[0], b[1]) for b in want]
    assert np.allclose([a[2] for a in got], [b[2] for b in want])
    assert lm_score.score(documents(spark, [])).count() == 0
    _, sql = duck(lm_score.OP1_SQL, documents=("doc_id bigint, text varchar", rows))
    assert np.allclose([r[2] for r in sorted(sql, key=str)], [r[2] for r in want], atol=1e-5)


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"word{k}" for k in range(300)], ["nasty", "vilething", "vileness", "vilest", "rotten"]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            ws[rng.randrange(len(ws))] = rng.choice(bad).upper() if rng.random() < 0.2 else rng.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    ldf = spark.createDataFrame([x for x in labels if x[0] < 250] + [(250, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    docs = documents(spark, rows, extra=False)
    model = toxicity.train(docs, ldf)
    assert all(np.diff(model.cuts) > 0)
    odd = [(1000, None), (1001, ""), (1002, "vilething " * 5000), (None, "nasty rotten vilest"), (0, rows[0][1])]
    got = toxicity.grade(documents(spark, rows + odd), model).collect()
    held = [r for r in got if r.doc_id is not None and 250 <= r.doc_id < 400]
    assert sum(r.rejected == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got if r.doc_id != 0}
    assert not by[1000].rejected and not by[1001].rejected and by[1002].rejected and by[None].rejected
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in got) and len(got) == len(rows) + len(odd)
    kept = toxicity.keep_clean(documents(spark, rows + odd), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected) and "digest" in kept.columns


def test_severity_orders_held_out_documents(spark):
    """Planted grades that the model never sees: more toxic words are more severe."""
    rng = random.Random(8)
    plain, bad = [f"word{k}" for k in range(300)], ["nasty", "vilething", "vileness", "vilest", "rotten"]
    rows, labels, grade = [], [], {}
    for i in range(700):
        ws, n = [rng.choice(plain) for _ in range(60)], rng.choice([0, 0, 0, 0, 1, 3, 6, 10])
        for k in rng.sample(range(60), n):
            ws[k] = rng.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(n > 0)))
        grade[i] = n
    docs = documents(spark, rows, extra=False)
    model = toxicity.train(docs, spark.createDataFrame(labels[:400], "doc_id bigint, toxic int"))
    got = [(grade[r.doc_id], r.expected_severity) for r in toxicity.grade(docs, model).collect() if r.doc_id >= 400]
    mean = [np.mean([x for g, x in got if g == n]) for n in (0, 1, 3, 6, 10)]
    assert mean == sorted(mean) and mean[-1] - mean[0] > 1.5
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    toxic = [(g, x) for g, x in got if g]
    assert np.corrcoef(rank([g for g, _ in toxic]), rank([x for _, x in toxic]))[0, 1] > 0.8


def test_fit_by_brute_force():
    """The fitted weights are where the penalised likelihood is least."""
    rng = np.random.default_rng(4)
    n, k = 60, 3
    x = rng.integers(0, 3, (n, k)).astype(float)
    grades = np.clip((x @ [1.0, 0.5, -0.5] + rng.normal(0, 1, n)).round().astype(int), 0, toxicity.GRADES - 1)
    at, col = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(at, col, x[at, col], grades, k, l2=0.05, steps=3000)

    def loss(w, cuts):
        total = 0.0
        for row, g in zip(x, grades):
            upto = [0.0, *(1 / (1 + math.exp(row @ w - c)) for c in cuts), 1.0]
            total -= math.log(upto[g + 1] - upto[g]) / n
        return total + 0.025 * (w @ w) + 0.0005 * sum(math.log(b - a) ** 2 for a, b in zip(cuts, cuts[1:]))

    best = loss(w, cuts)
    for _ in range(300):
        dw, dc = rng.normal(0, 0.05, k), rng.normal(0, 0.05, len(cuts))
        if all(np.diff(cuts + dc) > 0):
            assert loss(w + dw, cuts + dc) >= best - 1e-6


def test_features_of_fit_and_score_are_the_same():
    texts = ["İstanbul naïve é́x ΣΑΣ ﬁne_word x-y 漢字漢字漢字", "", None, "one two threefour"]
    for t in texts:
        found = toxicity.text_features(t)
        model = toxicity.Model({w: i for i, w in enumerate(sorted(found))})
        assert set(model.features(t)) == set(range(len(found)))


def test_toxicity_without_examples(spark):
    docs = documents(spark, [(1, "a b"), (2, None)], extra=False)
    for labels in ([], [(1, 0)], [(1, 1), (2, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert not any(r.rejected for r in toxicity.grade(docs, model).collect())


def test_sample_is_bounded(spark):
    rows, labels = toxic_corpus(60)
    assert toxicity.sample(documents(spark, rows, extra=False), spark.createDataFrame(labels, "doc_id bigint, toxic int"), 20).count() == 20


def items(rng, n):
    return [(i, " ".join(rng.choice(["the", "of", "and", *(f"w{k}" for k in range(60))]) + (". " if rng.random() < 0.15 else "") for _ in range(rng.randrange(3, 50)))) for i in range(n)]


def brute_items(bench, t):
    ws = decontaminate.words(t)

    def share(part):
        k = max(map(len, part))
        return len(part & {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}) / len(part)

    out = set()
    for i, b in bench:
        parts = [p for p in (decontaminate.shingles(decontaminate.words(b)), *map(decontaminate.shingles, decontaminate.question_answer(b))) if p] if decontaminate.words(b) else []
        if parts and all(share(p) >= decontaminate.OVERLAP for p in parts):
            out.add(i)
    return out


def test_items_are_found_wherever_they_stand(spark):
    rng = random.Random(3)
    bench = items(rng, 40)
    rows = tricky(rng)
    for k in range(60):
        ws = [f"n{rng.randrange(500)}" for _ in range(rng.randrange(1, 400))]
        if k % 2:
            leak = bench[k % 40][1]
            ws[rng.randrange(len(ws)) : 0] = (leak.upper() if k % 3 == 0 else leak).split()
        rows.append((100 + k, " ".join(ws)))
    bdf = spark.createDataFrame([*bench, (98, None), (99, "")], "item_id bigint, text string")
    got = {r.doc_id: {x.item_id for x in r["items"]} for r in decontaminate.contaminated(documents(spark, rows), bdf).collect() if r.contaminated}
    want = {i: f for i, t in rows if (f := brute_items(bench, t))}
    assert got == want and len(want) >= 30
    assert {r.doc_id for r in decontaminate.remove(documents(spark, rows), bdf).collect()} == {i for i, _ in rows} - set(want)
    none = spark.createDataFrame([], bdf.schema)
    assert not decontaminate.contaminated(documents(spark, rows), none).filter("contaminated").count()
    assert decontaminate.contaminated(documents(spark, []), bdf).count() == 0


def test_near_and_cut_copies_of_items_are_found():
    rng = random.Random(6)
    new = lambda n: [f"q{rng.getrandbits(40):x}" for _ in range(n)]
    bench = [(i, f"{' '.join(new(60))}. {' '.join(new(7 if i % 2 else 5))}.") for i in range(10)]
    s = decontaminate.Searcher(bench)
    for i, t in bench:
        ws = t.split()
        copies = [[*ws[:k], "changed", *ws[k + 1 :]] for k in range(len(ws))] + [ws[:60], ws[7:]]
        assert [[x["item_id"] for x in f] for f in s.find([" ".join(new(20) + c + new(20)) for c in copies])] == [[i]] * len(copies)
        assert s.find([" ".join(ws[:45] + new(40))]) == [[]]


def test_items_of_any_id_in_any_number_of_shards(spark, monkeypatch):
    rng = random.Random(31)
    new = lambda n: " ".join(f"q{rng.getrandbits(40):x}" for _ in range(n))
    bench = [("a", f"{new(30)}. {new(6)}."), ("a", new(40)), (None, new(20)), ("long", new(900)), ("b", new(3)), *((f"i{k}", new(25)) for k in range(20))]
    docs = [(k, f"{new(15)} {t} {new(15)}") for k, (_, t) in enumerate(bench)] + [(100, new(50)), (101, bench[0][1] + " " + bench[1][1])]
    bdf = spark.createDataFrame(bench, "item_id string, text string")
    results = []
    for size in (8 << 20, 200):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        parts = list(decontaminate.shards(bdf))
        assert (len(parts) > decontaminate.RESIDENT) == (size == 200) and sum(map(len, parts)) == len(bench)
        results.append({r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.contaminated(documents(spark, docs), bdf).collect()})
    assert results[0] == results[1]
    assert results[0] == {**{k: [i] for k, (i, _) in enumerate(bench)}, 100: [], 101: ["a", "a"]}
    first = decontaminate.contaminated(documents(spark, docs[:1]), bdf).first()["items"][0]
    assert first.overlap == first.question == first.answer == 1.0


def test_search_finds_every_score_over_the_threshold():
    rng = random.Random(5)
    bench = items(rng, 30)
    s = decontaminate.Searcher(bench)
    texts = [b for _, b in items(rng, 25)] + [" ".join(b.split()[: len(b.split()) * 2 // 3]) for _, b in bench]
    passage, term, where = s.passages([decontaminate.words(t) for t in texts])
    for threshold in (0.2, 0.5, 0.9):
        got = {(p, k): round(v, 4) for p, k, v in zip(*(x.tolist() for x in s.index.search(passage, term, threshold)))}
        want = {}
        for p in range(len(where)):
            mine = set(term[passage == p].tolist())
            for k in range(len(s.index.items)):
                v = sum(float(w) for t, d, w in zip(s.index.term_of, s.index.docs, s.index.weights) if d == k and t in mine)
                if v >= threshold - 1e-4:
                    want[p, k] = round(v, 4)
        assert got.keys() == want.keys()


PAGES = [("http://A.example.org/x?y#z", "a.example.org", "/x"), ("https://h", "h", ""), ("no scheme", "", ""), (None, "", ""), ("x://?a/b", "", ""), ("a://b://c/d", "b:", "//c/d"), ("http://ÀB.com/de/1", "Àb.com", "/de/1"), ("ftp://u@Host:80/p#f?q", "u@host:80", "/p")]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(PAGES)], "i int, url string")
    from pyspark.sql import functions as F

    host, path = url_reputation.url_parts(F.col("url"))
    assert [tuple(r) for r in df.orderBy("i").select(host, path).collect()] == [p[1:] for p in PAGES]
    cases = {("example.org", "/es/1"): "example.org/es/", ("www.example.org", "/en/12"): "example.org/en/1", ("example.org", "/en/2"): "org/", ("org", "/"): "org/", ("org", ""): None, ("xorg", "/"): None, ("a.com", "/fr/"): "com/fr/", ("a.com", "/de/x"): "com/de/", ("a.com", "/"): None}
    df = spark.createDataFrame(list(cases), "host string, path string")
    got = {(r.host, r.path): r.r.rule if r.r else None for r in df.withColumn("r", url_reputation.rule_column(F.col("host"), F.col("path"))).collect()}
    assert got == cases


def test_reputation_against_sql(spark):
    rng = random.Random(11)
    hosts = [f"{a}.{b}.{c}" for a in "abcdef" for b in ("good", "bad", "odd") for c in ("net", "com", "co.uk")]
    pages = [(i, rng.choice(["http://{}/q", "https://{}/fr/1", "x{}"]).format(h), "h", 1) for i, h in enumerate(rng.choices(hosts, k=900))] + [(2000, None, None, 1), (2001, "", "h", 1), (5, "http://repeated.bad.net/", "h", 1)]
    labels = [(i, int(rng.random() > (0.9 if "bad" in u else 0.1)), 0) for i, u, *_ in pages[:700] if u] + [(701, None, None), (702, 0, None)]
    pdf = spark.createDataFrame(pages, "page_id bigint, url string, host string, n bigint")
    ldf = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")

    from pyspark.sql import functions as F

    host, _ = url_reputation.url_parts(F.col("url"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    outcomes = pdf.select("page_id", host.alias("host")).join(ldf.select(F.col("doc_id").alias("page_id"), bad), "page_id").select("host", "bad")
    got = sorted(map(tuple, url_reputation.judge(pdf, outcomes).collect()), key=str)
    names, rows = duck(url_reputation.OP7_SQL, pages=("page_id bigint, url varchar, host varchar, n bigint", pages), labels=("doc_id bigint, quality int, toxic int", labels))
    assert names == ["page_id", "host", "path", "rule", "verdict"]
    assert got == sorted(rows, key=str)
    verdicts = {r[4] for r in rows if "bad" in r[1] and r[3] is None}
    assert "block" in verdicts
    assert {r[4] for r in rows if "good" in r[1] and r[3] is None} == {"allow"}
    none = outcomes.limit(0)
    assert {r.verdict for r in url_reputation.judge(pdf.filter("url is null"), none).collect()} == {"allow"}
    assert url_reputation.judge(pdf.limit(0), outcomes).count() == 0


def test_suffixes_from_a_table(spark):
    cases = {"a.b.c.uk": ("c.uk", "b.c.uk"), "c.uk": ("c.uk", "c.uk"), "x.y.z.w": ("z.w", "y.z.w"), "www.me.co.uk": ("co.uk", "me.co.uk"), "plain.net": ("net", "plain.net"), "": ("", ""), "q.deep.y.z.w": ("deep.y.z.w", "q.deep.y.z.w")}
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    table = spark.createDataFrame([("c.uk",), ("z.w",), ("w",), ("deep.y.z.w",), ("z.w",), (None,)], "suffix string")
    assert {r.host: (r.suffix, r.domain) for r in url_reputation.with_domains(hosts, table).collect()} == cases


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="sidebar-left">
<header><h2>Site</h2><a href=/>Home</a></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta, gamma.</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, please accept them all, thank you.</p></div>
{body}
<aside><p>Read more of this, it is good.</p></aside><section id="comments"><p>I liked this article a lot, really.</p></section>
<form><p>Sign up here, now.</p><input name=q></form><footer>&copy; site, all rights.</footer></body>"""


def test_pages():
    article = "<article><header><h1>Head  line</h1><span>by x</span></header><p>One &eacute;\n two,\t<b>bold</b> text.<p>Second<br>line; it &lt;is&gt; longer.<div class='ad'>Buy, now!</div><p>Short.<ul><li>item one</li><li>item two</ul></article>"
    want = "Head line\n\nOne é two, bold text.\n\nSecond line; it <is> longer.\n\nShort.\n\nitem one\n\nitem two"
    assert html_text.extract(PAGE.format(body=article)) == want
    plain = "<div id=main><p>First paragraph, long enough to count; it has marks.</p><!-- <p>no</p> --><p>Next one, <a href=x>with a link</a>, also long.</p></div>"
    assert html_text.extract(PAGE.format(body=plain)) == "First paragraph, long enough to count; it has marks.\n\nNext one, with a link, also long."
    wrapped = "<div class='page no-sidebar'><main class='post has_comments'><h1>Title here</h1><p>First part, long enough.</p><article class='comment'><p>A reader wrote this, at length.</p></article></main></div>"
    assert html_text.extract(PAGE.format(body=wrapped)) == "Title here\n\nFirst part, long enough."
    assert html_text.extract("<main><p data-x='hidden' title=\"a hidden b\">Shown, yes.</p><p hidden>Not shown, no.</p></main>") == "Shown, yes."
    for empty in (None, "", "   ", "<p></p>", "<script>x", "<nav>only, this.</nav>"):
        assert html_text.extract(empty) == ""
    assert html_text.extract("just text, no tags") == "just text, no tags"
    assert html_text.extract("<p>a < b & c &amp d</p>") == "a < b & c & d"
    assert html_text.extract("<p title='a>b' data-x=\"c>d\">x, y.</p><p>unclosed <b>tag") == "x, y.\n\nunclosed tag"
    long = "word, " * 20000
    assert html_text.extract(PAGE.format(body=f"<article><p>{long}</p></article>")) == long.strip()


LONG = "A sentence of the article, with its marks; and some more words to read."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize(
    "inner, want",
    [
        (f"<h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div>", ["Title", LONG, LONG]),
        (f"<section><p>{LONG * 9}</p></section><section><p>{LONG}</p></section>", [LONG * 9, LONG]),
        (f"<div><div><p>{LONG * 9}</p></div></div><div><p>{LONG}</p></div>", [LONG * 9, LONG]),
        (f"<p>Short intro.</p><section><p>{LONG}</p><p>{LONG}</p></section>", ["Short intro.", LONG, LONG]),
        (f"<h2>List</h2><p>Intro.</p><ul>{f'<li>{LONG}</li>' * 9}</ul>", ["List", "Intro.", *[LONG] * 9]),
        (f"<p>{LONG}</p><table><tbody>{f'<tr><td>{LONG}</td></tr>' * 9}</tbody></table><p>End.</p>", [LONG, *[LONG] * 9, "End."]),
        (f"<p>Intro.</p><dl>{f'<dt>Term</dt><dd>{LONG}</dd>' * 9}</dl>", ["Intro.", *["Term", LONG] * 9]),
    ],
)
def test_the_root_cuts_nothing_off(tag, inner, want):
    assert html_text.extract(PAGE.format(body=f"<{tag}>{inner}</{tag}>")).split("\n\n") == want


@pytest.mark.parametrize("tag", ["script", "STYLE", "svg", "iframe"])
def test_skipped_elements_end_where_they_end(tag):
    """Lower-casing a dotted capital I makes two characters of it."""
    page = f"<article><p>{'İ' * 40} first, here.</p><{tag}>var x;</{tag.upper()} ><p>Second, here; <b>to stay</b>.</p></article>"
    assert html_text.extract(page) == f"{'İ' * 40} first, here.\n\nSecond, here; to stay."


@pytest.mark.parametrize("tag", ["svg", "object", "canvas", "video", "audio", "math", "template", "noscript"])
def test_elements_without_end_tag_leave_the_page(tag):
    assert html_text.extract(f"<article><p>First, here.</p><{tag} id=x><p>Second, here.</p><{tag}><p>Third.</p></article>") == "First, here.\n\nSecond, here.\n\nThird."


def test_formulas_stay():
    math = "<math><semantics><mrow><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation encoding=tex>a=\\frac12</annotation></semantics></math>"
    assert html_text.extract(f"<p>Let {math} hold, then.</p>") == "Let a = 1 2 hold, then."


def test_pages_table(spark):
    rows = [(1, "u", "<p>a, b.</p>", "x"), (1, "u", "<p>a, b.</p>", "x"), (None, None, None, None)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "a, b.", 5), (1, "u", "a, b.", 5), (None, None, "", 0)], key=str)


def test_registry_names():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in registry.QUERIES) == 1
    assert set(registry.SQL) <= set(registry.QUERIES)


UNNAMED = [
    f"<article><h1>T</h1><p>{LONG}</p><div class='z'>Buy now! Great offers, today only.</div><p>{LONG}</p><p>{LONG}</p></article>",
    f"<div class='q7'>This site keeps small files, see here.</div><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>",
    f"<div>This site keeps small files, see here.</div><div class='k'><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='w'><h3>More</h3>Win a prize, now!</div>",
    f"<article><div class='head9'><h1>T</h1></div><div class='x1'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='b2'><h4>Offers</h4><ul><li><a href=1>One</a></li></ul></div></article>",
    f"<article><h1>T</h1><p>{LONG}</p><div class='z'><p>Win now</p></div><p>{LONG}</p><p>{LONG}</p></article>",
    f"<div class='u'><p>Members only</p></div><div class='k'><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='v'><ul><li>Top</li><li>Print</li></ul></div>",
]


@pytest.mark.parametrize("page", UNNAMED)
def test_ratios_drop_adverts_and_notices_without_a_name(page, monkeypatch):
    assert html_text.extract(page).split("\n\n") == ["T", LONG, LONG, LONG]


def test_constant_ratios_change_the_result(monkeypatch):
    monkeypatch.setattr(html_text, "path_scores", lambda found: {b.place: 1.0 for b in found})
    assert sum(html_text.extract(p).split("\n\n") != ["T", LONG, LONG, LONG] for p in UNNAMED) >= 3


def test_names_that_leave_doubt_only_weigh():
    page = f"<article><div class='article-header'><h1>Title</h1><p>{LONG}</p></div><p>{LONG}</p><section class='related-work'><h2>Others</h2><p>{LONG}</p><p>Short.</p></section><section class='related posts'><p>{LONG}</p></section><div class='ad-box'><p>{LONG}</p></div></article>"
    assert html_text.extract(page).split("\n\n") == ["Title", LONG, LONG, "Others", LONG, "Short."]


def test_path_scores_against_sums():
    rng = random.Random(12)
    for _ in range(50):
        found = [html_text.Block((), (), "".join(rng.choice("ab,. ") for _ in range(rng.randrange(1, 60))).strip() or "x", rng.randrange(0, 12), False, False, 0, (rng.choice("pqr"),)) for _ in range(rng.randrange(1, 30))]
        ratio = {}
        for place in {b.place for b in found}:
            mine = [b for b in found if b.place == place]
            length = sum(max(0, len(b.text) - b.link) for b in mine) / len(mine)
            marks = sum(sum(c in ",." for c in b.text) for b in mine if b.link < 0.8 * len(b.text)) / len(mine)
            ratio[place] = math.sqrt(length * (1 + marks))
        weight = {-2: 0.25, -1: 0.5, 0: 1.0, 1: 0.5, 2: 0.25}
        want = {}
        for place in ratio:
            smooth = []
            for i, b in enumerate(found):
                if b.place == place:
                    near = [(ratio[found[i + d].place], w) for d, w in weight.items() if 0 <= i + d < len(found)]
                    smooth.append(sum(r * w for r, w in near) / sum(w for _, w in near))
            want[place] = ratio[place] ** 0.75 * (sum(smooth) / len(smooth)) ** 0.25
        got = html_text.path_scores(found)
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in got)


def test_empty_pages_table(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_lm_block_takes_little_memory():
    """Two workers score blocks beside each other in what an executor has besides its heap."""
    import tracemalloc

    n, order = 1 << 18, lm_score.ORDER
    vocab = np.random.default_rng(1).integers(1, 1 << 63, 60000, np.uint64)
    words = np.random.default_rng(2).integers(0, len(vocab), n).astype("<u4")
    planes = lm_score.zstandard.ZstdCompressor().compress(np.ascontiguousarray(words.view(np.uint8).reshape(-1, 4).T).tobytes())
    sizes = [n // 64] * 64
    held, rows = lm_score._Block(sizes, planes, vocab.tobytes(), order), []
    for k in range(order):
        sent = held.next(k)
        runs = [(k, r["part"], 3 * lm_score._unsqueeze(r["counts"])) for r in lm_score._run_rows(1, k, sent, 4)]
        held.settle(sent, np.concatenate([t for *_, t in runs]))
        rows += [{"n": k, "part": p, "totals": lm_score._squeeze(t)} for k, p, t in runs]
    told = pa.Table.from_pylist(rows)
    block = pa.table({"doc_ids": [list(range(64))], "sizes": [sizes], "words": pa.array([planes]), "vocab": pa.array([vocab.tobytes()])})
    tracemalloc.start()
    try:
        lm_score._scorer(order, lm_score.ALPHA, 10 * n)(block, told)
        assert tracemalloc.get_traced_memory()[1] < 115 * n  # 132 n before, 105 n since
    finally:
        tracemalloc.stop()
