"""Ranked search, main text and source divergence against brute force, and on odd input."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence, lexical, queries, wrappers

DOCS = "doc_id long, text string, lang string, source string"


def lowered(text, pattern):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(pattern, text or "")]


def search(docs, items, k):
    pattern = "[0-9A-Za-z\x80-\U0010ffff]+"
    words = [(d, lowered(t, pattern)) for d, t in docs if d is not None]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(lowered(t, pattern))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, w in words:
            c, m = Counter(w), 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(16, 1 << 17, 16, 256, 1 << 17, 2048), (2, 8, 1, 2, 5, 2)])
def test_search_as_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_ROWS", "BLOCK_POSTINGS", "SEEDS", "PIECE", "ROUND_TERMS", "ROUND_ITEMS"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, size)
    words = [f"w{i % 23}x" for i in range(400)]
    docs = [(n, " ".join(words[n * 3 % 90 : n * 3 % 90 + n % 17])) for n in range(120)]
    docs += [(200, None), (201, ""), (202, "... --"), (203, "É été ÉTÉ w1x"), (204, "w1x " * 20000 + "rare"), (7, "w1x w2x"), (7, "w1x w2x"), (None, "w1x rare")]
    items = [(1, "W1X w2x, w3x w1x"), (2, "rare été"), (3, ""), (4, None), (5, "nowhere"), (None, "w1x"), (6, "w5x"), (6, "w6x"), (7, " ".join(set(words)))]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rank int").repartition(3)
    found = lexical.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, found.collect())) == search(docs, items, 5)


def test_search_skips_blocks_and_takes_empty_tables(spark):
    docs = [(n, f"common word{n} " + "filler " * (n % 7) + ("needle" if n % 50 == 0 else "")) for n in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    parts = lexical.search_parts(frame, spark.createDataFrame([(1, "needle")], "item_id long, text string"), 10)
    scored, seen = parts.selectExpr("sum(scored)", "sum(blocks)").first()
    assert seen >= 125 and scored <= 45
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(none, item).count() == 0 == lexical.rank_documents(frame, item.limit(0)).count()


def audit(docs, least, k):
    rows = [(lang or "", source or "", lowered(text, "[A-Za-z\x80-\U0010ffff]+")) for _, text, lang, source in docs]
    df, counts, of_lang = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in rows:
        df.update((lang, t) for t in set(w))
        counts[lang, source].update(w)
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    for (lang, _), c in counts.items():
        of_lang[lang].update(c)

    def shares(c, lang):
        v, n = len(kept[lang]), sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept[lang]}

    f = lambda p, q: (p - q) ** 2 // q
    p = {g: shares(c, g[0]) for g, c in counts.items()}
    whole = {lang: shares(c, lang) for lang, c in of_lang.items()}
    out = []
    for lang, source in counts:
        mine = p[lang, source]
        pairs = [(sum(f(mine[t], p[g][t]) for t in mine), g[1]) for g in counts if g[0] == lang and g[1] != source]
        terms = [(f(mine[t], whole[lang][t]), t) for t in mine if counts[lang, source][t] and mine[t] > whole[lang][t]]
        for part, found, most in (("pair", pairs, 10**9), ("term", terms, k)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, x, v, r) for r, (v, x) in enumerate(found, 1) if r <= most]
    return sorted(out)


def audited(frame, least, k):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.audit_sources(frame, least, k).collect())


@pytest.mark.parametrize("side", [256, 2])
def test_audit_as_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "ROWS_A_TASK", 20)
    monkeypatch.setattr(divergence, "FLUSH", 30)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 16)
    docs = [(n, " ".join(f"t{chr(97 + (n * i) % 26)}{'é' * (i % 3)}" for i in range(n % 19)), ("en", "de", None)[n % 3], f"s{n * n % 5}" if n % 11 else None) for n in range(150)]
    docs += [(None, "Ta TA ta 9 t9", "en", "s0"), (500, None, "fr", "x"), (501, "", "fr", "y"), (502, "word " * 30000, "fr", "x"), (1, docs[1][1], "de", "s1"), (503, "solo solo", "it", "one")]
    frame = spark.createDataFrame([(*d, 7) for d in docs], DOCS + ", value int").repartition(3)
    assert audited(frame, 3, 6) == audit(docs, 3, 6)
    assert divergence.audit_sources(frame.limit(0)).count() == 0


def test_radix_selection_with_ties(spark):
    rows = [("a", v, f"{'same' * 3}{n:05d}") for n, v in enumerate([0, 1, 5, 5, 5, 5, 5, 5, 127, 128, 1 << 59, (1 << 60) - 1] * 40)] + [("b", 3, f"é{n}") for n in range(300)] + [("c", 9, "z")]
    frame = spark.createDataFrame(rows, "g string, v long, item string")
    for k in (1, 90, 200):
        found = sorted((r.g, r["rank"], r.v, r["item"]) for r in divergence.top_by_radix(frame, ["g"], "v", "item", k, enough=3).collect())
        want = [(g, n, v, i) for g in "abc" for n, (v, i) in enumerate(sorted(((v, i) for x, v, i in rows if x == g), key=lambda x: (-x[0], x[1].encode()))[:k], 1)]
        assert found == want


def article(html):
    import html as entities

    inside = re.search("<article>(.*)</article>", html, re.S)[1]
    blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_pages(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    found = queries.op12_main_text(spark, small).collect()
    assert {r.page_id: r.text for r in found} == {k: article(v) for k, v in pages.items()} and all(r.n_chars == len(r.text) for r in found)


def page(n, extra="", body=None):
    body = body or f"<h2>Part {n}</h2><p>First words of story {n} &amp; more.<p>Second\n  part{' x' * n}.</p>"
    return f"<html><body><div class=top0{n % 2}><a href=/>Home</a> <a href=/b>Other</a></div><div class=x><div class=y>{extra}<h1>Title {n}</h1>{body}<div>Read our <b>terms</b> of use</div></div></div><div class=z>All rights kept {n}</div></body></html>"


def test_wrappers_without_semantic_tags(spark):
    rows = [(n, f"http://h.example/{n}", page(n, "<table><tr><td>note</table>" if n == 3 else "")) for n in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in wrappers.extract_main_text(frame).collect()}
    assert found[4] == "Title 4\nPart 4\nFirst words of story 4 & more.\nSecond part x x x x."
    assert found[3].split("\n")[0] == "note" and "terms" not in "".join(found.values()) and "rights" not in "".join(found.values())
    said = wrappers.expression(wrappers.Item.of(__import__("json").loads(wrappers.infer_wrappers(frame).first().wrapper)))
    assert '"Read our terms of use"' in said and "<h1>#</h1>" in said and "(<p>#</p>)+" in said and "(<table>" in said


def test_wrapper_alignment():
    of = lambda h: wrappers.wrapper_of(wrappers.parse(h))
    one = of("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>same</p>")
    assert wrappers.expression(one) == '<html><dl>(<dt>#</dt><dd>#</dd>)+</dl><p>"same"</p></html>'
    two = wrappers.merged(one, of("<dl><dt>a<dd>b</dl><ul><li>q</ul><p>same</p>"))
    assert two.pages == 2 and '(<ul><li>"q"</li></ul>)?<p>"same"</p>' in wrappers.expression(two)
    assert wrappers.expression(wrappers.Item.of(two.plain())) == wrappers.expression(two)


ODD = [
    ("<article><p>a<script>x='<p>no</p>'</script> b<!-- c --><div class='ad'>buy</div><aside>s</aside><form><input>f</form></article><div id=comments><p>hi</div>", "a b"),
    ("<main><header><h1>T</h1></header><nav>n</nav><ul><li>one<li>two</ul></main><footer>f</footer>", "T\none\ntwo"),
    ("<article><ul class=x><li><a href=1>l1</a><li><a href=2>l2</a></ul><p>text &lt;b&gt; &#233;&nbsp;x</p></article>", "text <b> é x"),
    ("<div class='cookie-notice'>c</div><p>only</p>", "only"),
    ("<body class='has-sidebar'><p>kept</p></body>", "kept"),
    ("", ""), ("<", "<"), ("<p", "<p"), ("plain", "plain"), ("<nav>menu</nav>", ""), (None, ""),
]


def test_odd_pages(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(n, None if n % 2 else "no url", h, "x") for n, (h, _) in enumerate(ODD)] + [(90, "http://one.example", long, "y"), (91, "http://U@One.example:80/p", long, "y"), (91, "http://one.example/p", long, "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, decision string")
    found = [(r.page_id, r.text) for r in wrappers.extract_main_text(frame).collect()]
    assert {k: v for k, v in found if k < 90} == {n: t for n, (_, t) in enumerate(ODD)}
    assert sorted(k for k, v in found if k >= 90 and v == "\n".join(["word word"] * 50_000)) == [90, 91, 91]
    assert wrappers.extract_main_text(frame.limit(0)).count() == 0
