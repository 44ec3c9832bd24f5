"""The corpus operators against brute force, on small tables with the awkward rows put in."""

import collections
import html
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, hash long, block long"


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, and nulls, empty, blank, tiny, long, repeated and equal ones, with columns of clashing names."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    odd = [(None, None, None), (900, None, "en"), (901, "", None), (902, " \n\t", "en"), (903, "word", "en"), (903, "word", "en"), (904, "12 34 !!", "en")]
    long = [(905, " ".join(f"w{i % 700}x{i}" for i in range(30000)), "en"), (906, rows[0][1], rows[0][2]), (907, "x" * 20000, "en"), (908, rows[3][1], None)]
    every = [(*r, "s", None, "c", 1, 2) for r in rows + odd + long]
    return spark.createDataFrame(every, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def test_simhash(spark, docs, none):
    from modelframe.llm.simhash import near_duplicate_classes

    assert near_duplicate_classes(none).count() == 0
    given = texts(docs)

    def fp(t):
        w = words(t)
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [fp(t) for _, t in given]
    group = list(range(len(given)))
    for _ in range(8):
        for i in range(len(given)):
            group[i] = min(group[j] for j in range(len(given)) if (fps[i] ^ fps[j]).bit_count() <= 2)
    least = collections.defaultdict(lambda: math.inf)
    for g, (i, _) in zip(group, given):
        least[g] = min(least[g], math.inf if i is None else i)
    want = sorted(((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(given, fps, group)), key=str)
    assert sorted(map(tuple, near_duplicate_classes(docs).collect()), key=str) == want


def test_near_duplicates(spark, docs, none, monkeypatch):
    """Pairs that share most of a text with all others, so that few of them are near to any band's first or last."""
    from modelframe.llm import near_duplicates as nd

    assert nd.one_of_each(none).count() == 0 and nd.one_of_each(docs).columns == docs.columns
    monkeypatch.setattr(nd, "TILE", 5)
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for pair in range(30):
        own = [f"p{pair}q{i}" for i in range(100)]
        for k in range(2):
            text = [*common, *own]
            for at in rng.integers(0, len(text), 4):
                text[at] = f"n{pair}m{k}x{at}"
            rows.append((int(rng.integers(0, 1 << 40)), " ".join(text)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(rows)))
    for _ in range(6):
        for i, a in enumerate(shingles):
            group[i] = min(group[j] for j, b in enumerate(shingles) if near(a, b))
    least = collections.defaultdict(lambda: math.inf)
    for (i, _), g in zip(rows, group):
        least[g] = min(least[g], i)
    assert len(least) > 25
    got = nd.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_near_duplicates_leave_tiles_as_links(spark, monkeypatch):
    """A family of which most pairs are near misses: what tiles return are links between groups, not pairs to verify."""
    import xxhash

    from modelframe.llm import near_duplicates as nd

    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(400)]
    texts = []
    for k in range(150):
        text = [*common]
        for at in rng.choice(len(text), 6, replace=False):
            text[at] = f"n{k}x{at}"
        texts.append(" ".join(text))
    node = [int(np.array(xxhash.xxh64_intdigest(t.encode(), 5), np.uint64).view(np.int64)) for t in texts]
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = {
        (max(node[i], node[j]), min(node[i], node[j]))
        for i, a in enumerate(shingles)
        for j, b in enumerate(shingles[:i])
        if len(a & b) >= 0.8 * len(a | b)
    }
    assert 0 < len(links) < len(texts)
    tables = []

    class Kept(nd.Stored):
        def __init__(self, df, *args):
            super().__init__(df, *args)
            if df.columns == ["a", "b"]:
                tables.append([tuple(r) for r in self.df.collect()])

    monkeypatch.setattr(nd, "Stored", Kept)
    for tile in (nd.TILE, 20):
        monkeypatch.setattr(nd, "TILE", tile)
        tables.clear()
        got = nd.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        group = {v: v for v in node}
        for _ in links:
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
        assert got.count() == len(set(group.values()))
        candidates, *later = tables
        assert len(candidates) > len(texts)
        for table in later:
            assert set(table) <= links


def test_components(spark):
    from modelframe.llm.components import connected_components

    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 499), (499, 500)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {499: 499, 500: 499}


def test_context_tree(docs, none):
    from modelframe.llm import context_tree as ct

    assert ct.scored(none).count() == 0
    given = texts(docs)
    crc = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 5
    taught = [t for i, t in given if crc(i) != 1]
    n = collections.Counter(w for t in taught for w in [*words(t), "\n"])
    every, v = sum(n.values()), len(n)
    got = sorted(ct.scored(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_bytes"]))
    # brute force of the trees: counts of all contexts of all depths, weights by recursion
    counts = collections.defaultdict(lambda: [0, 0])
    stream = lambda t: " ".join(words(t)).encode() + b"\n"
    for t in taught:
        s = b"\n" * ct.DEPTH + stream(t)
        for k in range(ct.DEPTH, len(s)):
            for d in range(ct.DEPTH + 1):
                u = 1
                for level in range(7, -1, -1):
                    bit = s[k] >> level & 1
                    counts[s[k - d : k], u][bit] += 1
                    u = 2 * u + bit
    kids = collections.defaultdict(list)
    for c, u in counts:
        if c:
            kids[c[1:], u].append((c, u))
    log_pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    log_pw, weight = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        pe = log_pe(*counts[node])
        if len(node[0]) == ct.DEPTH:
            log_pw[node], weight[node] = pe, 1.0
        else:
            a, b = math.log(0.5) + pe, math.log(0.5) + sum(log_pw[k] for k in kids[node])
            log_pw[node] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            weight[node] = math.exp(a - log_pw[node])

    def logp(s, k):
        total, u = 0.0, 1
        for level in range(7, -1, -1):
            bit, p = s[k] >> level & 1, None
            for d in range(ct.DEPTH, -1, -1):
                node = (s[k - d : k], u)
                if node in counts:
                    kt = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                    p = kt if p is None else weight[node] * kt + (1 - weight[node]) * p
            total += math.log10(0.5 if p is None else p)
            u = 2 * u + bit
        return total

    by_id = {(i, len(stream(t))): t for i, t in given}
    assert len(got) == len(given)
    for r in got:
        t = by_id[r["doc_id"], r["n_bytes"]]
        w = [*words(t), "\n"]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(w), every, sum(n[x] > 0 for x in w))
        assert r["held_out"] == (crc(r["doc_id"]) == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((n[x] + 0.5) / (every + 0.5 * (v + 1))) for x in w))
        if len(t) < 3000:
            s = b"\n" * ct.DEPTH + stream(t)
            assert r["score"] == pytest.approx(sum(logp(s, k) for k in range(ct.DEPTH, len(s))), rel=1e-6)


def test_html(spark):
    from modelframe.llm.html_text import extracted, main_text

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in extracted(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split(" ")) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        blocks = [re.sub(r"[ \t\n\r\f]+", " ", b).strip() for b in blocks]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
    assert main_text(None) == main_text("") == ""
    page = (
        "<nav>menu</nav><div class='cookie-notice'>ok?</div><main><h1>T &lt; &amp; &eacute;</h1><p>a <b>b</b>\n c<p>d<script>var x='<p>'</script>"
        "<ul><li>one<li>two</ul><div id=comments>no</div></main><footer>f</footer>"
    )
    assert main_text(page) == "T < & é\na b c\nd\none\ntwo"
    # no article: what recurs on a host goes, what doesn't stays
    rows = [(i, "http://h/x", f"<body><div><p>Same</p></div><div><p>own {i}</p></div></body>") for i in range(4)]
    rows += [(9, None, None), (10, "http://h/y", "")]
    found = extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["text"]) for r in found.collect()) == [(i, f"own {i}") for i in range(4)] + [(9, ""), (10, "")]
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_html_template_in_articles(spark):
    """What recurs on a host goes inside articles too; parts of passages and near copies stay."""
    from modelframe.llm.html_text import extracted

    box = "<div><b>Read our letter</b></div><p>Five ways to save</p>"
    rows = [(i, "http://a/x", f"<article><h2>Steps</h2><p>own {i} is <em>not</em> it</p>{box}<ul><li>Salt</li><li>spice {i}</li></ul></article>") for i in range(4)]
    rows += [(i, "http://b/x", f"<article><p>{'the same long story ' * 9}</p><p>version {i}</p></article>") for i in range(4, 8)]
    got = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Steps\nown {i} is not it\nSalt\nspice {i}" for i in range(4))
    assert all(got[i] == f"{('the same long story ' * 9).strip()}\nversion {i}" for i in range(4, 8))


def test_html_copies(spark):
    """Copies of a page without an article keep their text, whatever share of their host they are."""
    from modelframe.llm.html_text import extracted

    copy = "<html><body><div><p>One</p><p>text</p></div></body></html>"
    own = [(i, "http://h/x", f"<html><body><div>menu</div><div>own {i}</div></body></html>") for i in range(4)]
    rows = [(i, "http://h/x", copy) for i in range(10, 16)] + own
    rows += [(i, None, f"<html><head><title>{i}</title></head><body><div>all of it</div></body></html>") for i in range(20, 24)]
    got = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "One\ntext" for i in range(10, 16)} | {i: f"own {i}" for i in range(4)} | {i: "all of it" for i in range(20, 24)}


def test_html_wrappers():
    """What is around the article isn't dropped; a class names a kind as a whole token only."""
    from modelframe.llm.html_text import main_text

    for kind in ("site has-sidebar", "no-sidebar", "search-page", "with-comments", "sidebar", "page-with-nav"):
        for tag in ("article", "main"):
            assert main_text(f"<body><div class='{kind}'><nav>n</nav><{tag}><p>text</p></{tag}></div></body>") == "text"
            assert main_text(f"<body><{tag}><div class='{kind}'><article><p>text</p></article></div></{tag}></body>") == "text"
        assert main_text(f"<body><form><article><p>text</p></article></form><p>beside</p><div class='{kind}'></div></body>") == "text"
    for kind in ("no-sidebar", "search-page", "with-comments"):
        assert main_text(f"<body><div class='{kind}'>text</div></body>") == "text"
    for kind in ("cookie-notice", "site-footer", "x sidebar", "ad_slot_2", "comments-area", "skip-link"):
        assert main_text(f"<body><p>text</p><div class='{kind}'>no</div></body>") == "text"
    # articles in what is dropped stay out beside a main text
    assert main_text("<article>text</article><section id=comments><article>no</article></section>") == "text"
    assert main_text("<main><p>text</p><aside><article>no</article></aside></main>") == "text"


def test_language(spark, docs, none):
    from modelframe.llm.langid import identified

    assert identified(none).count() == 0
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in identified(whole).collect()}
    held = [r for r in whole.collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in whole.collect())
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    found = identified(docs).collect()
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == docs.count()
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {None, 900, 901, 902, 904}


def test_sharding(docs, none):
    from modelframe.llm.sharding import sharded

    assert sharded(none).count() == 0
    for cell in (20000, 50):  # one level, and several
        got = sharded(docs, shards=4, cell=cell).collect()
        assert len(got) == docs.count()
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        want = collections.Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts(docs))
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    whole = docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = collections.Counter()
    for r in sharded(whole).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 40 and max(size.values()) < 1.01 * min(size.values())


def test_personal_data(docs, none):
    from modelframe.llm import personal_data as pd_

    tagger = pd_.trained(docs)
    assert pd_.personal_data(none, tagger).count() == 0
    assert pd_.personal_data(docs, tagger).count() == docs.count()
    text = "mail a.b@c-d.org, ip 1.2.3.4 no 1.2.3.400, card 4111 1111 1111 1111 not 4111111111111112, +1 (212) 555-0100."
    assert [(pd_.KINDS[k], text[a:b]) for k, a, b in pd_.base_spans(text)] == [
        ("email", "a.b@c-d.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100"),
    ]
    # windows without an anchor change nothing
    some = [t for _, t in texts(docs) if len(t) < 4000][:25] + [text, ""]
    assert pd_.Finder(tagger).spans(some) == pd_.Finder(tagger, all_windows=True).spans(some)
    # and the tagger finds again what teaches it
    x, y = pd_.lessons([w for k in range(120) for w in pd_.teaching_windows("the mail of foo@bar.com is it " * 6, k)], variants=0)
    fitted = pd_.Tagger().fit(x, y)
    assert (fitted.decode(x) == y).mean() > 0.9
    loss, grads = pd_.Tagger().gradients(x[:3], y[:3])
    for name in ("T", "O", "Wf", "Ub", "E"):
        t = pd_.Tagger()
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        t.p[name][at] += 1e-2
        up = t.gradients(x[:3], y[:3])[0]
        t.p[name][at] -= 2e-2
        assert (up - t.gradients(x[:3], y[:3])[0]) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=1e-5)


def test_token_counts(docs, none):
    import sentencepiece

    from modelframe.llm.bpe_count import PieceCounter, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts(none, path).count() == 0
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, path).collect())
    assert got == collections.Counter((i, len(t.encode()), len(model.encode(t))) for i, t in texts(docs))
    count = PieceCounter(path).count
    rng = np.random.default_rng(1)
    odd = list("abc  \n\t▁<s>é́ﬁ２　😀你\x00\r'.,0")
    for _ in range(500):
        t = "".join(rng.choice(odd, rng.integers(0, 30)))
        assert count(t) == len(model.encode(t)), t


def test_nearest(spark):
    from modelframe.llm.vector_tree import nearest

    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[100:300] = x[100]  # one vector that a third share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [1.0] * 7 + [None]), (703, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    hits = 0
    for q in range(0, 600, 20):
        want = [i for i in np.lexsort((np.arange(600), -s[q].round(9))) if i != q][:20]
        assert len(got[q]) == 20
        hits += len({i for i, _ in got[q]} & set(want))
        assert all(v == pytest.approx(s[q, i], abs=1e-9) for i, v in got[q])
    assert hits >= 0.9 * 20 * 30 and len(got) == 30
    assert nearest(df.where("vec_id < 3")).count() == 2
    assert nearest(df.where("vec_id = -1")).count() == 0


def test_decontamination(spark, docs, none):
    from modelframe.llm.decontaminate import clean, contamination

    items = [(1, " ".join(f"item{i}" for i in range(20))), (2, "Short but known words here"), (3, None), (4, "two words"), (5, " ".join(f"item{i}" for i in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = items[0][1].split()
    every_fifth = [w if i % 5 else f"other{i}" for i, w in enumerate(whole)]
    rows = [(1, "lead " + " ".join(whole) + " tail"), (2, "a " + " !! ".join(w.upper() for w in every_fifth)), (3, " ".join(whole[:6]) + " no more"),
            (4, "say short BUT known, words here now"), (5, None), (6, "short but"), (None, " ".join(whole))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"]) for r in contamination(df, bench).collect()}
    assert got[1] == (True, "1:1:21") and got[2][0] and got[4][0] and got[None][0]
    assert not got[3][0] and not got[5][0] and not got[6][0]
    assert sorted(r["doc_id"] for r in clean(df, bench).collect()) == [3, 5, 6]
    assert contamination(none, bench).count() == 0
    assert contamination(docs, bench.where("item_id = 99")).where("contaminated").count() == 0


def test_masks_hit_all_overlaps():
    """Every pattern of equal tokens that the verification accepts has a hit: each one of 4 to 20 tokens, the fewest beyond."""
    from modelframe.llm import decontaminate as dc

    def bits(mask):
        return [i for i, c in enumerate(mask) if c == "1"]

    for n in range(4, 21):
        p = np.arange(1 << n, dtype=np.int32)
        missed = np.ones(len(p), bool)
        for m in dc._of_item(n):
            both = np.full(len(p), -1, np.int32)
            for k in bits((*dc.MASKS, *dc.SHORT)[m]):
                both &= p >> k
            missed &= both == 0
        need = min(dc.MATCHED, math.ceil(dc.SHARE * n))
        for x in p[missed]:
            if int(x).bit_count() >= need:
                assert dc.best_segment(np.array([int(x) >> k & 1 for k in range(n)], bool))[0] < need, (n, bin(x))
    # beyond: the most equal tokens that no mask hits, by the last tokens
    size = max(map(len, dc.MASKS)) - 1
    every = np.arange(1 << size)
    free = np.ones(1 << size, bool)
    for m in map(bits, dc.MASKS):
        need = sum(1 << (m[-1] - k - 1) for k in m[:-1])
        free &= every & need != need
    most = np.where(every == 0, 0, -(10**6))
    for n in range(1, 100):
        after = np.full(1 << size, -(10**6))
        np.maximum.at(after, every << 1 & (1 << size) - 1, most)
        np.maximum.at(after, (every[free] << 1 | 1) & (1 << size) - 1, most[free] + 1)
        most = after
        assert n < dc.MATCHED or most.max() < max(dc.MATCHED, (n + 3) // 2)
        if n == 24:
            assert most.max() <= 12  # so 24 tokens more bring 12 at most, and all lengths follow


def test_decontamination_substitutions(spark):
    """Items whose tokens are substituted here and there, as many as the verification accepts, beside lone texts."""
    from modelframe.llm.decontaminate import best_segment, contamination

    rng = np.random.default_rng(9)
    sizes = [4, 5, 8, 11, 12, 15, 18, 24, 30]
    bench = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in sizes]
    rows, want = [], {}
    for n in sizes:
        for _ in range(60):
            equal = np.ones(n, bool)
            equal[rng.choice(n, rng.integers(1, max(2, n // 2)), replace=False)] = False
            i = len(rows)
            own = [f"i{n}x{k}" if e else f"o{i}x{k}" for k, e in enumerate(equal)]
            rows.append((i, " ".join([f"b{i}", *own, f"e{i}"])))
            want[i] = best_segment(equal)[0] >= min(13, math.ceil(0.75 * n))
    df, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in contamination(df, items).collect()}
    assert 100 < sum(want.values()) < len(want) and got == want


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from modelframe.llm.packing import best_fit, local_search, packed

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    assert packed(none, path).count() == 0
    got = packed(docs, path, cell=40).collect()
    want = collections.Counter()
    for i, t in texts(docs):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    sizes = np.array([7, 7, 6, 5, 5, 5, 4, 4, 4, 3])
    first = [[0, 9], [1], [2, 6], [3, 4], [5, 7], [8]]
    better = local_search(first, sizes, 10)
    assert sorted(i for b in better for i in b) == list(range(10)) and all(sizes[b].sum() <= 10 for b in better)
    assert len(better) <= len(first) and len(best_fit(sizes, 10)) == 6


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "personal_data", "best_fit_packing"]
    stage = dict(cp.STAGES)
    kept = stage["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] > 899) == [903, 903, 905, 906, 907, 908]
    base = " ".join(f"a{i}b" for i in range(200)).split()
    near = [*base[:90], "other", *base[91:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (4, " ".join(base[:100] + [f"z{i}" for i in range(100)])), (5, "x"), (5, "x"), (6, None), (7, "")]
    got = stage["simhash_near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 4, 5, 6]
    red = stage["personal_data"](spark, spark.createDataFrame([(1, "to a@b.com now", 14), (2, None, None)], "doc_id long, text string, n_chars long"), SF)
    assert [tuple(r) for r in red.orderBy("doc_id").collect()] == [(1, "to <EMAIL> now", 14), (2, None, None)]
    assert cp.run(spark, SF).agg(F.sum("length")).first()[0] > 0
