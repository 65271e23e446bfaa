import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import common, decontaminate, html_extract, langid, line_dedup, mixing, simhash, substring_dedup, toxicity, url_filter, vector_graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, langs=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentences(n, seed, words=None, least=3, most=30):
    rng = random.Random(seed)
    words = words or [f"w{i}" for i in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(least, most))) for _ in range(n)]


EDGE = [None, "", " \n\t ", "a", "A b", "é\u00a0x\u2003y", "w " * 30_000, "same text here", "same text here"]


# ---------------------------------------------------------------- shared
def test_hash_spans_and_words():
    data = np.frombuffer("ab cd ab".encode() + "ab".encode(), np.uint8)
    starts, ends, rows = common.words_of(data, np.array([0, 8, 10]), common.word_table())
    assert rows.tolist() == [0, 0, 0, 1]
    h = common.hash_spans(data, starts, ends)
    assert h[0] == h[2] == h[3] != h[1]


def test_hash_index():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    index = common.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) < 0).sum() > 4000


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- op1
def test_html_rules():
    page = """<body><header>Site</header><div id="cookie-banner">We use</div><main><article class="post"><header><h1>T &amp; x</h1></header>
    <p>one <i>t</i>wo<p>3 < 4 &nbsp; y<div class="ad-slot">Buy</div><script>if (a<b) "</p>"</script><section class="comments"><p>hey</p></section></article><aside>s</aside></main><form>f</form><footer>z</footer>"""
    assert html_extract.main_text(*html_extract.parse(page), set()) == "T & x one two 3 < 4 y"


def test_html_wrappers_and_stray_signs():
    text = lambda h: html_extract.main_text(*html_extract.parse(h), set())
    assert text('<body><div class="layout with-sidebar"><article><p>The article.</p></article></div></body>') == "The article."
    assert text('<div class="page has-comments"><main><p>M</p></main><div class="comments">c</div></div>') == "M"
    assert text('<article>own</article><div class="related"><article>other</article></div>') == "own"
    assert text("<p>so <math><mi>x</mi></math> holds</p>") == "so x holds"
    assert text("<p>a <b and c</p><p>d</p>") == "a <b and c d" and text('1 <a href="x>y">t</a> 2') == "1 t 2"


@pytest.mark.parametrize("unit", ['<a "', '<a ">"', "<div>", "<b>", "<div>x", "</x>", "<p '", "<div class='nav'>", "<!--"])
def test_html_of_hostile_pages_is_linear(unit):
    def seconds(n):
        start = time.process_time()
        parsed = html_extract.parse(unit * (n // len(unit)))
        html_extract.subtree_hashes(*parsed)
        html_extract.main_text(*parsed, set())
        return time.process_time() - start

    assert seconds(400_000) < 8 * seconds(100_000) + 0.5


@pytest.mark.parametrize("parts", [("<main>", "<b>", "</x>"), ("", "<div>", "<dt></dt>"), ("<p>", "<b>", "<div>"), ("", "<span>", "<li>"), ("<main>", "<b>", "</div>"), ("<h1>", "<td>", "</main>")])
def test_html_of_mixed_hostile_pages_is_linear(parts):
    def seconds(n):
        page = parts[0] + parts[1] * n + parts[2] * n
        start = time.process_time()
        parsed = html_extract.parse(page)
        html_extract.subtree_hashes(*parsed)
        html_extract.main_text(*parsed, set())
        return time.process_time() - start

    assert seconds(80_000) < 8 * seconds(20_000) + 0.5


def test_subtree_hashes_tell_structure():
    hashes = lambda h: html_extract.subtree_hashes(*html_extract.parse(h))
    one, two, three = (hashes(f"<div><ul>{x}</ul></div>") for x in ("<li>a</li><li>b</li>", "<li>a b</li>", "<li class=on>a</li><li> b </li>"))
    assert one[0] == three[0] and one[0] != two[0] and one[1] == three[1]
    assert hashes("<div><img></div>") == {}


def test_templates_of_a_host(spark):
    rows = [(i, f"http://a.com/{i}", f"<body><div>Welcome to A</div><p>text {i} of its own</p><div>Bottom line</div></body>") for i in range(8)]
    rows += [(20, "http://b.com/", "<body><div>Welcome to A</div><p>only</p></body>"), (21, None, None), (22, "x", ""), (23, "http://a.com/0", rows[0][2])]
    got = {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "text 3 of its own" and got[23].text == got[0].text
    assert got[20].text == "Welcome to A only" and got[21].text == "" and got[22].n_chars == 0


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://a.com/x", "<body><p>the same article</p></body>") for i in range(20)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.where("text = 'the same article'").count() == 20
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- op2
def test_toxicity_learns_words_and_sparsity(spark):
    clean = sentences(400, 2)
    texts = [t + (" awful grotty" if i % 4 == 0 else "") for i, t in enumerate(clean)] + EDGE
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 0, None)], "doc_id long, quality int, toxic int")
    held = F.pmod(common.doc_crc("doc_id"), F.lit(3)) == 1
    model = toxicity.fit(docs, labels, ~held)
    assert 0 < len(model[0]) < 2000
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in test]) > 0.95
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, empty, F.lit(True))).count() == 2


def test_toxicity_trains_on_whole_texts_once_an_id(spark):
    clean = sentences(60, 2)
    long = " ".join(sentences(2500, 9)) + " grotty grotty"
    texts = [t + (" grotty" if i % 3 == 0 else "") for i, t in enumerate(clean)] + [long] * 3
    assert len(long) > 100_000
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i >= 60)) for i in range(63)], "doc_id long, toxic int")
    docs = documents(spark, texts)
    whole = toxicity.text_features(docs.select("text", F.col("doc_id").alias("u"), F.lit(1).alias("y"))).where("u = 60").first().i
    data = np.frombuffer(long.encode(), np.uint8)
    assert np.array_equal(np.frombuffer(whole, "<i4"), np.unique(toxicity.features(data, np.array([0, len(data)]))[1]))
    first = toxicity.fit(docs, labels, F.lit(True))
    again = docs.union(docs.withColumn("text", F.concat("text", F.lit(" zzz")))).withColumn("toxic", F.lit(9)).withColumn("y", F.lit("x"))
    second = toxicity.fit(again, labels.withColumn("u", F.lit("clash")), F.lit(True))
    assert all(np.array_equal(a, b) for a, b in zip(first, second, strict=True))


def test_ftrl_by_its_definition():
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(12), 5))), rng.randrange(2)) for _ in range(40)]
    index, weight = toxicity.train(rows, epochs=3, alpha=0.5, beta=1.0, l1=0.4, l2=0.1, positive=2.0, least_rows=1)
    z, n, bias = defaultdict(float), defaultdict(float), 1 << toxicity.BITS

    def w(i):
        if i == bias:
            return -z[i] / ((1.0 + n[i] ** 0.5) / 0.5)
        return 0.0 if abs(z[i]) <= 0.4 else -(z[i] - (0.4 if z[i] > 0 else -0.4)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    for _ in range(3):
        for coordinates, y in rows:
            at = [*coordinates.tolist(), bias]
            now = {i: w(i) for i in at}
            g = (1 / (1 + np.exp(-sum(now.values()))) - y) * (2.0 if y else 1.0)
            for i in at:
                step = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i] += g - step * now[i]
                n[i] += g * g
    true = {i: w(i) for i in z if w(i)}
    assert dict(zip(index.tolist(), weight.tolist(), strict=True)) == pytest.approx(true, rel=1e-9)


# ---------------------------------------------------------------- op3
def brute_bits(train, text, order=4):
    """Code length by the definition, one byte at a time, over one language's texts."""
    counts = defaultdict(lambda: defaultdict(int))
    low = lambda s: s.encode().lower()
    for t in train:
        b = b"\n" * order + low(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    bits, b = 0.0, b"\n" * order + low(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(b[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                bits -= np.log2(c[b[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    train = {"x": ["the cat sat", "on the mat"], "y": ["der hund", "die katze lief"]}
    keys = {k: [langid.padded_keys(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in v] for k, v in train.items()}
    trees = langid.Trees({k: np.unique(np.concatenate(v), return_counts=True) for k, v in keys.items()})
    texts = ["the hat", "Die Katze", "zq", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = trees.code_lengths(data, offsets)
    for i, t in enumerate(texts):
        for j, lang in enumerate(trees.langs):
            assert got[i, j] == pytest.approx(brute_bits(train[lang], t), rel=1e-5, abs=1e-4)


def test_language_sample_is_whole_and_bounded(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abC d") for _ in range(n)) for n in (30, 50, 9000, 20, 7000, 40)]
    docs = documents(spark, texts + [None, ""], langs=["en", "en", "en", "de", "de", None, "en", "de"])
    got = langid.sample(docs, F.lit(True), 2, 4000, 11)
    assert {(r.lang, r.text) for r in got.collect()} == {("en", texts[0]), ("en", texts[1]), ("de", texts[3]), ("de", texts[4])}
    true = defaultdict(int)
    for lang, t in got.collect():
        b = b"\n" * 4 + t.lower().encode()
        for i in range(4, len(b)):
            true[lang, int.from_bytes(b[i - 4 : i + 1], "big")] += 1
    assert {(r.lang, r.key): r.n for r in langid.gram_counts(got).collect()} == true


def test_language_of_edges(spark):
    a, b = [f"th{x}" for x in "aeiou"], [f"sch{x}" for x in "aeiou"]
    texts = sentences(60, 3, a) + sentences(60, 4, b) + ["123 !?", None, "", "\u4e16\u754c"]
    docs = documents(spark, texts, langs=["en"] * 60 + ["de"] * 60 + [None] * 4)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, F.col("doc_id") % 2 == 0)).collect()}
    assert all(got[i].lang_pred == ("en" if i < 60 else "de") for i in range(120))
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3 and got[123].lang_pred != "und"
    nothing = langid.predict(docs, langid.fit(docs, F.lit(False)))
    assert nothing.where("lang_pred <> 'und'").count() == 0


# ---------------------------------------------------------------- op4
def brute_links(rows, least=0.93):
    ok = {i: np.array(e, float) / np.linalg.norm(e) for i, e, y in rows if y is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    label = {i: y for i, _, y in rows}
    links = {i: {j for j in ok if i in ok and j != i and label[i] == label[j] and ok[i] @ ok[j] >= least} for i, _, _ in rows}
    seen, comp = {}, {}
    for i in sorted(links):
        todo = [i] if i not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = comp[x] = i
                todo += links[x]
    return links, seen


def test_vector_graph_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    base = rng.normal(size=16)
    rows += [(300 + i, (base + 0.08 * rng.normal(size=16)).tolist(), 1) for i in range(120)]
    rows += [(500, rows[7][1], 1), (501, rows[7][1], 1), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, rows[7][1], None), (506, [None] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit(1))
    out = vector_graph.link_vectors(df, shard_rows=60)
    got = {r.vec_id: r for r in out.collect()}
    links, comp = brute_links(rows)
    true = sum(map(len, links.values()))
    assert len(got) == len(rows) and sum(r.n_links for r in got.values()) >= 0.98 * true
    assert all(got[i].n_links <= len(links[i]) for i in got)
    assert np.mean([got[i].component_id == comp[i] for i in got]) > 0.98
    whole = vector_graph.audit_recall(df.where("vec_id < 502"), out, every=10)
    assert whole >= 0.95 and vector_graph.audit_recall(df.where("vec_id < 502"), out, every=10, block=15) == pytest.approx(whole)
    assert vector_graph.link_vectors(df.where("false")).count() == 0


def sphere(n, seed=11):
    """Rows of one label that lie on a sphere of four dimensions: links everywhere, and no gap between clusters."""
    v = np.random.default_rng(seed).normal(size=(n, 4))
    return [(i, np.pad(x / np.linalg.norm(x), (0, 12)).tolist(), 1) for i, x in enumerate(v)]


def test_links_across_many_clusters(spark):
    rows = sphere(1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, comp = brute_links(rows)
    true = sum(map(len, links.values()))
    found = {k: {r.vec_id: r for r in vector_graph.link_vectors(df, shard_rows=60, overlap=k).collect()} for k in (1, 3)}
    assert true > 10_000
    for got in found.values():
        assert sum(r.n_links for r in got.values()) >= 0.99 * true
        assert all(got[i].n_links <= len(links[i]) and got[i].component_id == comp[i] for i in links)


def test_no_link_no_recall(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert vector_graph.audit_recall(df, vector_graph.link_vectors(df), every=1) is None


# ---------------------------------------------------------------- op5
def brute_lines(texts):
    seen, out = [], {}
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            w = set(line.lower().replace("\t", " ").split(" ")) - {""}
            if w:
                out[d, n] = any(len(w & v) / len(w | v) >= 0.8 for v in seen)
                seen.append(w)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    base = sentences(40, 7, [f"t{i}" for i in range(60)], 1, 14)
    lines = []
    for _ in range(260):
        w = rng.choice(base).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = f"t{rng.randrange(60)}"
        rng.shuffle(w)
        lines.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, 260, 4)] + [None, "", " \n ", "q", "q"]
    docs = documents(spark, texts)
    got = {(r.doc_id, r.line_no): r.removed for r in line_dedup.later_lines(docs).collect()}
    assert got == brute_lines(texts)
    kept = {r.doc_id: r.text for r in line_dedup.drop_later_lines(docs.withColumn("h", F.lit(1))).collect()}
    assert kept[0].split("\n")[0] == lines[0] and kept[len(texts) - 1] == "" and kept[65] is None


def test_line_dedup_without_broadcasts_and_of_long_lines(spark):
    rng = random.Random(31)
    words = [f"v{i}" for i in range(900)]
    base = [rng.sample(words, n) for n in (70, 130, 260, 300)]
    lines = []
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(len(w) // 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        lines.append("\t".join(w) if rng.random() < 0.2 else " ".join(w))
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, 60, 3)] + [lines[0]] * 3
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.line_no): r.removed for r in line_dedup.later_lines(documents(spark, texts), broadcast_lines=limit).collect()}
        assert got == brute_lines(texts)


def test_line_dedup_of_strange_ids_and_empty(spark):
    rows = [(None, "one two three four"), (1 << 60, "one two three four"), (1 << 60, "other words")]
    got = line_dedup.later_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.removed) for r in got) == [(0, False), (1 << 60, False), (1 << 60, True)]
    assert line_dedup.line_report(documents(spark, ["x"]).where("false")).count() == 0


def test_line_dedup_of_text_ids_clashing_names_and_repeated_rows(spark):
    rows = [("b", "one two three four\nx", 1, "k"), ("a", "ONE two three four", 2, "k"), ("a", "ONE two three four", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _gone int, h string")
    got = {(r.doc_id, r._gone): r.text for r in line_dedup.drop_later_lines(docs).collect()}
    assert got == {("b", 1): "x", ("a", 2): rows[1][1], ("a", 3): rows[1][1]} and line_dedup.drop_later_lines(docs).columns == docs.columns
    assert sorted(map(tuple, line_dedup.line_report(docs).collect())) == [("a", 1, 0, ""), ("a", 1, 0, ""), ("b", 2, 1, "0")]


# ---------------------------------------------------------------- op6
def brute_hits(texts, items, n=10):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        if w and k is not None:
            m = min(n, len(w))
            for i in range(len(w) - m + 1):
                windows[tuple(w[i : i + m])].add(k)
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (k := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= k
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"É{i}" if i % 7 == 0 else f"Wd{i}" for i in range(120)]
    items = [(i, t) for i, t in enumerate(sentences(25, 9, words, 12, 30))] + [(30, "short One"), (31, None), (None, "x y z"), (32, "..."), (33, "Wd1 wd2 WD3")]
    texts = sentences(60, 10, words, 5, 60)
    for i in range(0, 60, 3):
        w, it = texts[i].split(), items[rng.randrange(25)][1].split()
        at = rng.randrange(len(w))
        a = rng.randrange(max(1, len(it) - 11))
        texts[i] = " ".join([*w[:at], *it[a : a + rng.choice((9, 10, 15))], *w[at:]])
    texts += ["a short, ONE here", *EDGE]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    for limit in (200_000, 0):
        out = decontaminate.contaminated_words(docs, bench, broadcast_windows=limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()}
        assert got == brute_hits(texts, items)
    assert decontaminate.contaminated_words(docs, bench.where("false")).where("contaminated").count() == 0


def test_windows_across_segments(spark):
    rng = random.Random(13)
    item = [f"z{i}" for i in range(14)]
    texts = []
    for at in (0, 1, 2035, 2038, 2043, 2047, 2048, 2049, 4090, 6000):
        w = [f"a{rng.randrange(3000)}" for _ in range(6000)]
        texts.append(" ".join([*w[:at], *item, *w[at:]]))
    items = [(1, " ".join(item)), (2, "z3 z4 z5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (200_000, 0):
        out = decontaminate.contaminated_words(documents(spark, texts), bench, broadcast_windows=limit)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()} == brute_hits(texts, items)


def test_selected_grams_are_thinned_and_shared(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(5)}" if i % 50 < 20 else f"x{rng.randrange(900)}" for i in range(5000)]
    rows = spark.createDataFrame([(1, words), (2, words[1000:1200])], "k int, words array<string>")
    got = decontaminate.fingerprints(rows, ["k"], [10], 5, 10).select("k", "f", "at").collect()
    assert len({(r.k, r.at) for r in got}) == len(got) < 0.4 * 5200
    mine = {(r.at - 1000, r.f) for r in got if r.k == 1}
    assert {(r.at, r.f) for r in got if r.k == 2} <= mine
    at = sorted(r.at for r in got if r.k == 1)
    assert at[0] <= 5 and at[-1] >= 4990 and max(b - a for a, b in zip(at, at[1:])) <= 6


# ---------------------------------------------------------------- op7
def test_fingerprint_by_definition():
    def slow(t):
        w = t.lower().split()
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in [*sentences(30, 11, least=1), "a", "a b", ""]:
        assert simhash.fingerprint(t) == slow(t)
    assert simhash.fingerprint(None) == 0


def test_spark_hash_is_the_same(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_groups_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    fp = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for x in fp[:150]]
    fp = np.unique(np.concatenate([fp, np.array(near, np.uint64), np.array([0, 1, 7, 15], np.uint64)]))
    x, y = simhash.near_pairs(fp, fp)
    true = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if bin(int(fp[i]) ^ int(fp[j])).count("1") <= 3}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == true
    df = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    for rows in (32_768, 30):
        parent, _ = common.forest(len(fp), *map(np.array, zip(*true, strict=True)))
        links = simhash.link_fingerprints(df, tile_rows=rows).collect()
        at = {int(v): i for i, v in enumerate(fp.view(np.int64))}
        other, _ = common.forest(len(fp), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))

        def root(p, i):
            while p[i] != i:
                i = p[i]
            return i

        assert [root(parent, i) for i in range(len(fp))] == [root(other, i) for i in range(len(fp))]


def test_simhash_edges(spark):
    got = {r.doc_id: r for r in simhash.simhash_groups(documents(spark, EDGE)).collect()}
    assert [got[i].component_id for i in (0, 1, 2)] == [0, 0, 0] and got[8].component_id == got[7].component_id == 7
    assert got[0].fingerprint == "0" * 16 and len(got) == len(EDGE)
    assert simhash.simhash_groups(documents(spark, ["x"]).where("false")).count() == 0


# ---------------------------------------------------------------- op8
def test_url_rules_and_false_positives(spark):
    urls = ["http://Example.COM/en/x?y", "https://www.example.com/en/", "https://www.example.com/fr", "ftp://a.net/es/#f", "http://net/fr/1", "http://x.org/", "no scheme", None, "http://a.net", "http://notexample.com/en/", "a://b://c/"]
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [got[i].rule for i in range(11)] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None, "com/", None]
    assert [got[i].verdict for i in range(7)] == ["block", "allow", "allow", "block", "block", "allow", "allow"]
    assert got[0].host == "example.com" and got[0].path == "/en/x" and got[7].host == "" and got[10].host == "b:"
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules.where("false")).first().verdict == "allow"


def test_every_path_length_of_a_long_list(spark):
    rules = spark.range(1, 5001).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("path"), F.lit("block").alias("verdict"))
    some = [1, 2, 63, 64, *range(100, 5001, 100)]
    urls = spark.createDataFrame([(n, f"http://www.h{n}.com/{'a' * n}") for n in some] + [(9000, "http://h70.com/aa")], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(urls, rules).collect()}
    assert all(got[n].verdict == "block" and got[n].rule == f"h{n}.com/{'a' * n}" for n in some) and got[9000].verdict == "allow"


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    table = url_filter.build_filter(keys, "key")
    probe = spark.range(20_000).select("id", url_filter.passes(F.xxhash64(F.concat(F.lit("k"), "id")), table).alias("in"))
    assert probe.where("id < 5000 and not in").count() == 0 and probe.where("id >= 5000 and in").count() < 600
    assert url_filter.build_filter(keys, "key", max_bytes=640).nbytes <= 640


# ---------------------------------------------------------------- op9
def test_targets_fill_like_water(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 200)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    sizes, weights = {"a": 10, "b": 1000, "c": 500, None: 200}, {"a": 5, "b": 2, "c": 1, None: 5}
    total, out, left = 1.5 * 1710, {}, set(sizes)
    while left:
        level = (total - sum(out.values())) / sum(weights[k] for k in left)
        over = {k for k in left if level * weights[k] > 2 * sizes[k]}
        out |= {k: 2.0 * sizes[k] for k in over} if over else {k: level * weights[k] for k in left}
        left = left - over if over else set()
    assert got == pytest.approx(out)


def test_mixing_takes_near_the_target_and_repeats(spark):
    texts = sentences(900, 13, most=60) + [None, "", "  "]
    docs = documents(spark, texts, sources=[f"s{i % 3}" for i in range(900)] + [None, "s1", "z"])
    got = mixing.mix_sources(docs, keep=("lang", "text")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.size == len((r.text or "").split()) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 30 and len({r.target for r in rows}) == 1
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mixing_equals_brute_force_sampling(spark):
    rng = random.Random(41)
    texts = [" ".join(["w"] * int(2 ** rng.uniform(0, 9))) for _ in range(700)] + [None, "", "a b"]
    docs = documents(spark, texts, sources=[f"s{min(i % 7, 3)}" for i in range(700)] + ["s1", None, "z"])
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    u = {r.doc_id: (r.u + 0.5) / 2**53 for r in docs.select("doc_id", mixing.draw(F.xxhash64("doc_id"), 7).alias("u")).collect()}
    by = defaultdict(list)
    for i, r in got.items():
        by[r.source].append((i, r.size))
    for rows in by.values():
        r, total = got[rows[0][0]], sum(n for _, n in rows)
        whole = int(r.target / total + 1e-12) if total else 0
        rest = r.target - whole * total if total else 0.0
        order = {i: n.bit_length() for i, n in rows if n}
        certain = set()
        while order.keys() - certain:
            scale = (rest - sum(n for i, n in rows if i in certain)) / sum(order[i] * n for i, n in rows if n and i not in certain)
            top = max(order[i] for i in order if i not in certain)
            if scale * top <= 1 + 1e-12:
                break
            certain |= {i for i in order if order[i] == top}
        left, extra = rest - sum(n for i, n in rows if i in certain), set(certain)
        odds = {i: u[i] / (1 - u[i]) / (scale * order[i] / (1 - scale * order[i])) for i in order if i not in certain and 0 < scale * order[i] < 1}
        upto = 0
        for i in sorted(odds, key=odds.get):
            upto += got[i].size
            if upto - got[i].size / 2 > left:
                break
            extra.add(i)
        assert {i: r.copies for i, r in got.items() if i in dict(rows)} == {i: (whole + (i in extra)) if n else 0 for i, n in rows}


def test_mixing_of_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, f"{'x ' * (i % 9)}y{i}", "a", i) for i in range(60)] + [(5, "p q r", "b", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int").withColumn("b1", F.lit("mine"))
    got = mixing.mix_sources(docs, keep=("rank", "b1", "text")).collect()
    assert len(got) == 64 and all(r.b1 == "mine" and r.size == len(r.text.split()) for r in got) and sorted(r["rank"] for r in got) == sorted(x[3] for x in rows)
    a = [r for r in got if r.source == "a"]
    assert len({r.copies for r in a}) == 2 and abs(sum(r.taken for r in a) - a[0].target) <= 9


# ---------------------------------------------------------------- op10
def brute_repeats(texts, window=50):
    first, out = {}, {}
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = set()
        keys = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        for i, k in enumerate(keys):
            if first.get(k, d) < d:
                gone |= set(range(i, i + window))
        for k in keys:
            first.setdefault(k, d)
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(14)
    texts = sentences(50, 15, most=200, least=40)
    passage = sentences(6, 16, least=45, most=90)
    for i in range(10, 50):
        w = texts[i].split()
        at = rng.randrange(len(w))
        texts[i] = " ".join([*w[:at], *rng.choice(passage).split(), *rng.choice(passage).split(), *w[at:]])
    texts += [texts[3], texts[12], *EDGE, EDGE[6]]
    out = substring_dedup.remove_repeats(documents(spark, texts)).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out}
    assert got == brute_repeats(texts)
    for r in out:
        assert all(f.words >= 50 and f.ref_doc < r.doc_id for f in r.factors)
        if r.factors and len(texts[r.doc_id].split()) < 1000:
            f = r.factors[0]
            assert texts[r.doc_id].split()[f.start : f.start + f.words] == texts[f.ref_doc].split()[f.ref_start : f.ref_start + f.words]
    assert substring_dedup.remove_repeats(documents(spark, ["x"]).where("false")).count() == 0


def test_frequent_windows_and_clashing_names(spark, monkeypatch):
    rng = random.Random(51)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [f"{' '.join(f'a{i}b{rng.randrange(99)}' for _ in range(20))} {passage} end{i}" for i in range(30)]
    docs = documents(spark, texts).withColumn("h", F.lit(1)).withColumn("ref", F.lit("x"))
    for hot, most in ((5, 200_000), (5, 0), (10**6, 200_000)):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", most)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
        assert got == brute_repeats(texts)


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_of_structure_are_told_apart(spark, size):
    """Words that any polynomial modulo 2**64 maps to one value are different words."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    data = np.frombuffer((one + two).encode(), np.uint8)
    h = common.hash_spans(data, np.array([0, size]), np.array([size, 2 * size]))
    assert h[0] != h[1]
    same = [f"w{i}" for i in range(59)]
    texts = [" ".join([*same[:30], w, *same[30:]]) for w in (one, two)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert got == brute_repeats(texts) and got[1][1] == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = sentences(60, 17, [f"th{a}{b}{c}" for a in "aeiou" for b in "aeioust" for c in "lmnrstvw"], 40, 80) + EDGE
    texts.append(texts[0])
    docs = documents(spark, texts, sources=["a", "b", None] * 23 + ["a"]).withColumn("size", F.lit("kept apart"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialise(stage(spark, now, str(tmp_path)), "test")
        seen[name] = {r.doc_id for r in now.collect()}
        if name != "mix":
            assert now.columns == docs.columns
    assert seen["language_id"] >= set(range(60)) and not seen["language_id"] & {60, 61, 62}
    assert len(texts) - 1 not in seen["simhash"] and 5 not in seen["decontaminate"] and 4 in seen["decontaminate"]
    assert seen["mix"] <= seen["decontaminate"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == seen["mix"]
