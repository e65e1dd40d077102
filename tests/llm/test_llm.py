"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import components, decontaminate, embedding_dedup, html_extract, kernel, langid, lm, mixing, ngram_join, pack, sharding, substring_dedup, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(x):
    return WORD.findall((x or "").translate(LOW))


def prose(rng, n, syllables="ba ce di fo gu ha ki lo mu na pe ri so tu va".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.choice((3, 20, 60, 150, 400))) for _ in range(60)]
    near = [" ".join(w if i != 40 else "ZZZ" for i, w in enumerate(base[k].split())) for k in range(10)]
    long = prose(rng, 30_000)
    passage = prose(rng, 70)
    shared = [f"{prose(rng, 30)} {passage} {prose(rng, 45)}" for _ in range(4)]
    odd = [None, "", "   \n\t", "!!! ??? ---", "x", "é ü ñ", "der " * 300, long, base[0], base[0].upper(), "12 34", "\u00a0", "a\x00b"]
    return base + near + shared + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "s1", "s0", "s2", "s0")[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "en", "s0", 5), (5, "other text under a used id", "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS)
    # extra columns whose names clash with the operators' own
    return df.withColumns({c: F.lit(1) for c in ("row", "key", "score", "size", "id", "th", "h", "cluster", "taken")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_kernel_is_exact(texts):
    for table, pattern, lower in ((kernel.ALNUM, WORD, True), (kernel.NONSPACE, TOKEN, True)):
        h, offs = kernel.words(pa.array(texts, pa.string()), table)
        names = {}
        for i, t in enumerate(texts):
            want = pattern.findall((t or "").translate(LOW))
            assert len(want) == offs[i + 1] - offs[i]
            for w, x in zip(want, h[offs[i] : offs[i + 1]].tolist(), strict=True):
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)
    spans = list(kernel.slices(pa.array(texts, pa.string()), 1000))
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[-1][1] == len(texts)


def test_pack_round_trip():
    for x in (np.array([], np.uint64), np.arange(5, dtype=np.uint32), np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64))):
        for rising in (False, True):
            y = pack.load(pack.dump(x, rising), rising)
            assert y.dtype == x.dtype and (y == x).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1 << 21, 60_000])
def test_decontaminate(spark, docs, texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", block)
    a = words(texts[3])
    items = [(1, " ".join(words(texts[20]))), (2, None), (3, "..."), (10, " ".join(a[:4])), (11, texts[7]), (12, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(0))
    found = decontaminate.search(decontaminate.build_index(docs), bench).collect()
    assert len(found) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for i, t in rows:
        w, hit, held = words(t), set(), set()
        for item, text in items:
            q = words(text)
            for k in range(max(1, len(q) - 9) if q else 0):
                p = q[k : k + 10]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        held.add(str(item))
        want.append((i, len(w), len(hit), sorted(held)))
    got = [(r["id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in found]
    assert Counter(map(repr, got)) == Counter(map(repr, want)) and any(x[2] for x in want)


def test_decontaminate_proximity_and_empty(spark, docs, empty):
    d = spark.createDataFrame([(1, "one gap two gap gap three"), (2, "one two three"), (3, "one " + "x " * 40 + "two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "three one two")], "item_id long, text string")
    got = {r["id"]: (r["items"], r["near_items"]) for r in decontaminate.search(decontaminate.build_index(d), bench, slop=4).collect()}
    assert got == {1: ([], ["7"]), 2: ([], ["7"]), 3: ([], [])}
    assert decontaminate.search(decontaminate.build_index(empty), bench).count() == 0
    none = decontaminate.search(decontaminate.build_index(docs), bench.where("false")).collect()
    assert len(none) == docs.count() and not any(r["items"] for r in none)


def test_decontaminate_stage(spark, docs, empty, texts, tmp_path):
    items = spark.createDataFrame([(1, " ".join(words(texts[20])[:12])), (2, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = decontaminate.stage(spark, docs, str(tmp_path))
    bad = " ".join(words(texts[20])[:12])
    want = [r for r in docs.collect() if bad not in " ".join(words(r["text"]))]
    assert left.columns == docs.columns and Counter(map(repr, left.collect())) == Counter(map(repr, want)) and len(want) < docs.count()
    assert decontaminate.stage(spark, empty, str(tmp_path)).count() == 0


def test_phrases_of_a_large_benchmark_are_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 250_000))
    assert len(text) < decontaminate.QUERY_BYTES
    tracemalloc.start()
    p = decontaminate.Phrases(["1", "2"], pa.array([text, None]), 10)
    assert p.groups[0][0].shape == (249_991, 10) and tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_lm_matches_automaton(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    line = lambda t: TOKEN.findall((t or "").translate(LOW))
    model = lm.Automaton([line(t) for i, t in rows if train(i)])
    from helixframe.llm.common import split_mod

    got = lm.score(docs, split_mod(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(rows)
    want = Counter((str(i), len(line(t)) + 1, sum(model.count[(w,)] > 0 for w in [*line(t), "</s>"]), round(model.score(line(t)), 5), round(sum(model.arc((), w) for w in [*line(t), "</s>"]), 5)) for i, t in rows)
    assert Counter((str(r["id"]), r["n_tokens"], r["n_known"], round(r["score"], 5), round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {model.n}


def test_lm_states_sum_to_one():
    rng = random.Random(3)
    model = lm.Automaton([prose(rng, 30).split() for _ in range(20)])
    vocabulary = [w for (w,) in (x for x in model.count if len(x) == 1)]

    def p(state, word):
        total = 0.0
        while (a := model.arc(state, word)) is None:
            total += model.failure(state)
            state = state[1:]
        return 10 ** (total + a)

    for state in [(), ("<s>",), *[x for x in model.context if len(x) == 2][:5]]:
        seen = sum(p(state, w) for w in vocabulary)
        assert seen < 1 and abs(seen + p(state, "unseen-word") - 1) < 1e-9


def test_lm_empty(empty):
    assert lm.score(empty, F.lit(True)).count() == 0


def brute_near(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in (words(t) for _, t in rows)]
    n = len(rows)
    link = [[bool(sets[a]) and a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if link[a][b] and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return [sum(x) for x in link], comp


@pytest.mark.parametrize("tile", [2, 1500])
def test_ngram_join(docs, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    if tile == 2:
        monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 300)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()]
    links, comp = brute_near(rows)
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        low[c] = min(low.get(c, i), i)
    want = Counter((i, low[c], n) for (i, _), c, n in zip(rows, comp, links, strict=True))
    got = ngram_join.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    assert sum(x[2] for x in want) > 20


def test_ngram_join_stage(spark, docs, empty):
    left = ngram_join.stage(spark, docs, "")
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    _, comp = brute_near(rows)
    assert left.count() == len(set(comp))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(64) * rng.choice([0.05, 0.14, 0.4])
        rows.append((i, [float(x) for x in v], int(i % 40 % 3)))
    odd = [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, rows[0][1], None), (504, [None] + [1.0] * 63, 0), (505, rows[0][1], 0), (506, [2 * x for x in rows[0][1]], 0), (507, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    used = (7, [float(x) for x in base[3]], int(rows[3][2]))  # an id that another vector has
    odd += [(520 + i, rows[i][1][: 3 + i], 1) for i in range(20)] + [(540, rows[0][1][:3], 1), (541, [1e300] * 64, 1), (542, [1e-300] * 64, 1)]  # lengths of their own; extreme sizes
    every = rows + odd + [used, *rows[:3]]
    df = spark.createDataFrame(every, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit(1)).withColumn("keys", F.lit(2))

    def fine(i, v, c):
        return i is not None and v is not None and c is not None and None not in v and np.isfinite(v).all() and any(v)

    keep = [r for r in every if fine(*r)]
    x = [np.array(v) / np.abs(v).max() for _, v, _ in keep]
    x = [v / np.linalg.norm(v) for v in x]
    ok = np.array([[len(a) == len(b) and ka[2] == kb[2] and a @ b >= 0.98 for b, kb in zip(x, keep, strict=True)] for a, ka in zip(x, keep, strict=True)])
    np.fill_diagonal(ok, False)
    comp = components.roots(ok)
    least = {}
    for k, c in zip(keep, comp, strict=True):
        least[c] = min(least.get(c, k[0]), k[0])
    want = Counter((k[0], int(n), least[c], k[0] == least[c]) for k, n, c in zip(keep, ok.sum(1), comp, strict=True)) + Counter((r[0], 0, r[0], True) for r in every if not fine(*r))
    for tile, lengths in ((2048, 16), (3, 2)):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        monkeypatch.setattr(embedding_dedup, "LENGTHS", lengths)
        got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
        assert got == want
    assert sum(n for _, n, _, _ in want) > 500
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_substring_dedup(docs, empty, texts):
    got = {}
    for r in substring_dedup.repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    seen = {}
    for key in rows:
        w = words(key[1])
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(key)
    for key in rows:
        w = words(key[1])
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:  # a repeated passage is found
                assert any(min(s["end"], k + 50) - max(s["start"], k) >= 25 for r in got[key[0]] for s in r["spans"])
    clean = {i for i, t in rows if t and len(words(t)) > 100 and not any(len(seen[tuple(words(t)[k : k + 50])]) > 1 for k in range(len(words(t)) - 49))}
    near = {i for i in range(60, 70)} | set(range(10))
    assert not (clean - near - {None}) & set(got)
    assert substring_dedup.repeats(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://a.com/en/1", "https://example.com/en/7x?q", "https://notexample.com/en/7", "http://b.net/de/", "http://x.EXAMPLE.net/de/88#f", "http://o.org/es", "http://o.org/es/?a", "o.org/es/", None, "", "x://", "y://COM/en/", "z://com?en", "http://com/en/a://b.net/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("h")).withColumn("key", F.lit("k"))
    got = [tuple(r) for r in url_filter.judge(pages).orderBy("page_id").collect()]

    def brute(i, u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
        host = host.translate(LOW)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")

    assert got == sorted([brute(i, u) for i, u in enumerate(urls)] + [brute(0, urls[0])])
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, ()).collect()} == {"allow"}


def test_bloom_cascade_is_exact(spark):
    listed = spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("key"))
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    levels = url_filter.build(listed, universe)
    out = url_filter._with(universe, levels).select("key", url_filter.member(levels, F.col("key")).alias("m")).collect()
    assert len(levels) > 2 and all(r["m"] == (int(r["key"]) % 7 == 0) for r in out)


@pytest.mark.parametrize("words", [1 << 20, 20])
def test_url_filter_with_many_rules(spark, words, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_WORDS", words)  # the second: parts, one after another
    rng = random.Random(6)
    hosts = [f"h{i}.{rng.choice(('net', 'org', 'co.uk'))}" for i in range(300)]
    rules = sorted({(rng.choice(hosts), rng.choice(("/", "/a", "/a/b", "")), rng.choice(("block", "allow"))) for _ in range(400)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(('', 'www.', 'x.y.'))}{rng.choice(hosts)}{rng.choice(('', '/', '/a', '/a/b/c', '/ab', '/z'))}" for _ in range(500)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), tuple(rules)).collect()}
    for i, u in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fit = sorted(((h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: -len(x[0]))
        assert got[i] == (fit[0] if fit else (None, "allow"))


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(TOKEN.findall(r["text"] or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    by_size = {size[s]: target[s] for s in order}
    taken = Counter()
    for r in got:
        assert abs(r["target"] - by_size[r["source_size"]]) < 1e-6 and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source_size"]] += r["taken"]
    biggest = max(r["size"] for r in got)
    assert all(abs(taken[n] - t) <= biggest / 2 + 1e-6 for n, t in by_size.items())
    assert Counter(map(repr, got)) == Counter(map(repr, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(8)
    kinds = {"xx": "ka ko ku zik zak".split(), "yy": "el la men tre ion".split()}
    rows = [(i, prose(rng, rng.randint(2, 60), kinds[k]), k) for i in range(300) for k in [("xx", "yy")[i % 2]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(d, langid.train(d.where("doc_id % 3 <> 1"))).where("doc_id % 3 = 1").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.98 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    odd = {r["text"]: r["lang_pred"] for r in langid.predict(docs.select("doc_id", "text"), langid.train(d)).collect()}
    assert all(odd[t] == "und" for t in (None, "", "!!! ??? ---", "12 34")) and odd["x"] != "und"
    assert {r["lang_pred"] for r in langid.predict(d, langid.train(d.where("false"))).collect()} == {"und"}
    assert langid.predict(empty, langid.train(d)).count() == 0
    assert langid.stage(spark, docs, "").columns == docs.columns


def test_html_rules():
    m = html_extract.model()
    page = """<html><head><title>T</title><style>x{}</style></head><body class="page"><nav><ul><li><a href=1>Home</a></li><li><a>About</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, accept them now.</p></div><article><h1>A  title &amp;\n more</h1><p>First <b>bold</b>&nbsp;text<br>line two.<p>Second &lt;tag&gt; here, with words.
    <script>var a = "<p>no</p>";</script><!-- <p>no</p> --><ul><li>item one</li><li>item two</li></ul></article><div class="ad">Buy now cheap</div>
    <section class="comments"><p>Great post, thanks for it.</p></section><aside><p>Related story links</p></aside><footer>&copy; 2024 site</footer></body></html>"""
    assert html_extract.extract(page, m) == ["A title & more", "First bold text line two.", "Second <tag> here, with words.", "item one", "item two"]
    assert html_extract.extract(None, m) == [] and html_extract.extract("", m) == []
    for broken in ("<", "<<p", "</p></div>", "<p", "<!--", "<script>", "&#xFFFFFFF; &bogus;", "<a b='c", "<div>" * 3000):
        html_extract.extract(broken, m)


def test_html_held_out_pages():
    m = html_extract.model()
    rng = random.Random(4242)
    right = 0
    for _ in range(60):
        page = html_extract.generated(rng)
        order = html_extract._measure(html_extract.parse(page))
        kept = set()
        for n in order:
            own = re.search(r'data-truth="(\d)"', n.attrs)
            good = int(own.group(1)) if own else 1
            if n.parent is None or (good and id(n.parent) in kept and n.tag not in html_extract.DEAD):
                kept.add(id(n))
        want = html_extract.blocks(order[0], kept)
        right += html_extract.extract(re.sub(r' data-truth="\d"', "", page), m) == want
    assert right >= 57


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><h1>Title here</h1><p>Some text, really.</p></article>"), (1, None, None), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, html_extract.extract_text(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "Title here\n\nSome text, really.", 30), (1, None, "", 0), (None, "u", "", 0)], key=repr)
    assert html_extract.extract_text(pages.where("false")).count() == 0


def test_digests(spark):
    """The thin queries' digest columns on the smallest tables."""
    d = "/root/testdata/sf0.001"
    r = decontaminate.op2_decontaminate(spark, d).where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]
    x = langid.op9_langid(spark, d)
    assert x.columns == ["doc_id", "held_out", "lang_pred", "score"] and x.where("held_out").count() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200))
    assert math.isclose(lm.op3_lm_score(spark, d).agg(F.max("score")).first()[0], lm.op3_lm_score(spark, d).agg(F.max("score")).first()[0])
