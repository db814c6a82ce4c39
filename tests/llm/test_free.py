"""Token files, n-gram join, decontamination, extraction, toxicity, token counts and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import decontamination as D
from maskwright.llm import html_extraction as H
from maskwright.llm import ngram_join as J
from maskwright.llm import token_counts as C
from maskwright.llm import token_files as T
from maskwright.llm import toxicity as X


# --- token files ---------------------------------------------------------------------------
HARD = ["a  b ", " a", "  \n b", "x \ny", "foo\n bar\t\tbaz  ", "", "it's don't\x1c y", " ", "é à  ê\n\n", "<|endoftext|> a", None, "Ω≈ç√ 漢字 😀,", "same", "same", "x" * 3000]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 2500])
def test_planes(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    index, data = T.pack(ids, 1000, kind)
    assert (T.unpack(index, data, n, 1000) == ids).all()


def encoded(texts, **how):
    ids, counts = T.PieceEncoder().encode(pa.array(texts, pa.string()), **how)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_encoder_is_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*HARD, "<|endoftext|>", "a <|endoftext|>b c<|endoftext|><|endoftext|> d", "<|endoftext|", "x  <|endoftext|>\n y"]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(texts) == want and encoded(texts, end_id=2) == [w + [2] for w in want]
    assert want[HARD.index("<|endoftext|> a")] == [50256, 257]


def test_encoder_of_random_and_long_texts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1'. \n\u00a0\u3000\u0085é漢\u1680 s") for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["word and " * 200_000, "x" * 30_000 + " " + "y" * 700_000 + " z"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(texts) == want
    monkeypatch.setattr(T, "MEMO", 50)
    monkeypatch.setattr(T, "BLOCK", 64)
    assert encoded(texts[:2000]) == want[:2000]


def test_token_files(spark, tmp_path):
    rows = [(i * 3 % 17, t, "x") for i, t in enumerate(HARD)] + [(None, "null id", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = f"file://{tmp_path}/t"
    T.write_token_files(df, path, block_ids=64, segment_ids=50)
    out = T.read_token_files(spark, path, block_ids=64).collect()
    tok = T.PieceEncoder().tokenizer
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()) if r[1] is not None else -1, r[1] or ""))
    at = 0
    got = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    for r, (_, text, _) in zip(got, order):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert T.token_output(df.limit(0)).count() == 0


# --- n-gram join ---------------------------------------------------------------------------
def brute_components(rows):
    sets = []
    for d, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for (d, _), s in zip(rows, sets)}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for k in range(n // 6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))] + shared * (k % 3 == 0)
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = [x.upper() for x in t]
            rows.append(" ".join(t))
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(12):
        chain[i * 5] = f"c{i}"
        rows.append(" ".join(chain))
    rows += ["", None, "  ", "one two", "One TWO", "one two three four five", "é É", "É é"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, comp string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicate_components(df).collect()}
    assert got == brute_components(rows)


def test_components_without_stars(spark, monkeypatch):
    """The prefix join alone finds every link too: no star is formed here."""
    rows = near_copies(3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = J.verify

    def second_only(docs, pairs, calls=[]):  # noqa: B006
        calls.append(1)
        return whole(docs, pairs).limit(0) if len(calls) == 1 else whole(docs, pairs)

    monkeypatch.setattr(J, "verify", second_only)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicate_components(df).collect()}
    assert got == brute_components(rows)


def test_hot_groups(spark):
    """A third of all rows equal, a third near copies on both sides of the threshold, and one common passage."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = [" ".join(base)] * 150
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rows += [" ".join([word() for _ in range(rng.randrange(1, 30))] + passage) for _ in range(150)]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicate_components(df).collect()}
    assert got == brute_components(rows)


def test_one_of_each(spark):
    rows = near_copies(4, 60) + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, c in brute_components(rows[:-1]).values()}
    kept = J.one_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want | {None}
    assert J.near_duplicate_components(df.limit(0)).count() == 0


# --- decontamination -----------------------------------------------------------------------
def test_overlaps(spark):
    rng = random.Random(7)
    words = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([40, 25, 17, 12, 5, 40])] + [(9, None), (10, "")]
    text = lambda n: [rng.choice(words) for _ in range(n)]

    def planted(i, changes=0):
        t = items[i][1].split()
        for k in range(changes):
            t[(k * 7 + 3) % len(t)] = f"z{k}"
        return " ".join([*text(30), *(x.upper() + "," for x in t), *text(30)])

    docs = [(0, planted(0)), (1, planted(1, 3)), (2, planted(2, 2)), (3, planted(3)), (4, planted(4)), (5, " ".join(text(500))), (6, None), (7, ""), (8, planted(0, 5)),
            (9, " ".join(text(20) + items[5][1].split()[10:30] + text(20))), (9, " ".join(text(9)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 30):
        got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(df, bench, size).collect()}
        assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (8, 0), (9, 5)}
        assert sorted(str(r["doc_id"]) for r in D.clean(df, bench, size).collect()) == ["5", "6", "7", "9"]
    assert D.overlaps(df, bench.limit(0)).count() == 0 and D.clean(df.limit(0), bench).count() == 0


def test_parts_of_a_stretch_count():
    """Three runs of 14 equal tokens with 8 others between are an overlap, as one of them is."""
    item = [f"i{k}" for k in range(58)]
    text = [t if k % 22 < 14 else f"z{k}" for k, t in enumerate(item)]
    index = D.SeedIndex([(1, " ".join(item))])
    assert index.overlaps(" ".join(text)) == [(1, 0, 36, 0, 28)]
    assert index.overlaps(" ".join(text[:14])) == [(1, 0, 14, 0, 14)]


def test_stretch_matches_brute_force():
    rng = np.random.default_rng(2)
    for n in [*range(1, 30), *[40] * 60]:
        same = rng.random(n) < rng.choice([0.5, 0.65, 0.75, 0.9])
        y = np.arange(1, n + 1, dtype=np.uint64)
        need = min(D.LEAST_EQUAL, int(np.ceil(D.LEAST_OF_ITEM * n)))
        sums = [(int(same[a:b].sum()), b - a) for a in range(n) for b in range(a + 1, n + 1)]
        want = any(e >= need and e >= D.LEAST_SHARE * size for e, size in sums)
        got = D.SeedIndex._stretch(np.where(same, y, np.uint64(0)), y, 0)
        assert (got is not None) == want
        if got:
            first, last, equal = got
            assert equal == same[first:last].sum() >= need and equal >= D.LEAST_SHARE * (last - first)


@pytest.mark.parametrize("n, changes", [(5, 1), (8, 1), (10, 2), (14, 2), (15, 3), (16, 4), (20, 5), (32, 8)])
def test_no_overlap_without_a_hit(n, changes):
    rng = random.Random(n)
    item = [f"i{k}" for k in range(n)]
    index = D.SeedIndex([(1, " ".join(item))])
    for _ in range(300):
        at = set(rng.sample(range(n), changes))
        text = " ".join(f"z{k}" if k in at else t for k, t in enumerate(item))
        assert [o[0] for o in index.overlaps(text)] == [1], text


# --- extraction ----------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><header>Site name</header><div class="ad">Buy now %d</div>%s<aside>More</aside>
<div id="comments"><p>First!</p></div><form><label>Mail</label><input></form><footer>&copy; site all rights are reserved by us here</footer></body></html>"""


def test_extraction(spark):
    article = "<article><h1>Head &amp; line</h1><p><b>One  two\nthree<br><p>Four &eacute; %s<div class='share-bar'>Share</div></article>"
    plain = "<div><p>Own words of page %s which are many here.</p></div><div><p>Read our newsletter each week for more news from us</p></div>"
    rows = [(i, "http://h.example/%d" % i, PAGE % (i, article % f"w{i}"), "t") for i in range(5)]
    rows += [(10 + i, "http://p.example/x", PAGE % (i, plain % f"n{i} m{i} o{i} q{i}"), "t") for i in range(4)]
    rows += [(20, None, None, "t"), (21, "x", "", "t"), (22, "http://h.example/z", "just text &lt;b&gt; <p>next", "t")]
    rows += [(30 + i, "http://c.example/x", "<p>the very same page as the other one is</p>", "t") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in H.extract_main_text(df, group_chars=1500).collect()}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    for i in range(5):
        assert out[i]["text"] == f"Head & line\nOne two three\nFour é w{i}"
    for i in range(4):
        assert out[10 + i]["text"] == f"Own words of page n{i} m{i} o{i} q{i} which are many here."
    assert (out[20]["text"], out[21]["text"], out[22]["text"]) == ("", "", "just text <b>\nnext")
    assert out[30]["text"] == "the very same page as the other one is"
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_text_does_not_depend_on_groups(spark):
    """A notice on five of 24 pages is cut, one on three stays, however the host is dealt out."""
    rng = random.Random(5)
    own = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(40))
    notice, rare = "please read our newsletter each week for news", "this passage was quoted by three pages of the host"
    rows, want = [], {}
    for i in range(24):
        t = own()
        rows.append((i, "http://n.example/x", f"<p>{t}</p>" + f"<p>{notice}</p>" * (i < 5) + f"<p>{rare}</p>" * (10 <= i < 13)))
        want[i] = t + f"\n{rare}" * (10 <= i < 13)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chars in (10**6, 500):
        assert {r["page_id"]: r["text"] for r in H.extract_main_text(df, group_chars=chars).collect()} == want, chars


def test_hostile_pages_are_read_in_linear_time():
    import time

    for page in ("<b c " * 200_000, '<a "' * 200_000, "<b>" * 50_000 + "</i>" * 50_000, "<object>x" * 50_000, "<!" * 100_000):
        began = time.thread_time()
        H.page_blocks(page)
        assert time.thread_time() - began < 10, page[:10]
    deep = H.page_blocks("<div>" * 6000 + "<nav>menu</nav><p>in</p>" + "</div>" * 6000 + "<p>after</p>")
    assert [(b.text, b.furniture) for b in deep] == [("menu", True), ("in", False), ("after", False)]
    assert [b.text for b in H.page_blocks('<p>one</p><a href="x>two</a><p>three</p>')] == ["one", "two", "three"]
    assert [b.text for b in H.page_blocks("a < b and <c")] == ["a < b and <c"]


def test_near_copies_keep_their_text(spark):
    rng = random.Random(6)
    own = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    rows, want = [], {}

    def page(k, host, *blocks, text=None):
        rows.append((k, f"http://{host}.example/{k}", "".join(f"<p>{b}</p>" for b in blocks)))
        want[k] = "\n".join(blocks if text is None else text)

    base, notice, quote = own(1000), "please read our newsletter each week for news", " ".join(own(20))
    for k in range(2):  # two pages that share 995 of 1,000 words
        page(k, "a", " ".join(x if i % 200 else f"z{k}{i}" for i, x in enumerate(base)))
    for k in range(2, 4):  # a passage that two pages quote
        page(k, "b", " ".join(own(60)), quote)
    for k in range(10, 16):  # six near copies of one page, which one more page quotes
        page(k, "c", " ".join(f"z{k}" if i == 7 * k else x for i, x in enumerate(base)), quote)
    page(16, "c", " ".join(own(60)), quote)
    for k in range(20, 26):  # a page and its exact copy, among others with the same notice
        t = " ".join(own(60)) if k != 21 else t
        page(k, "d", t, notice, text=[t])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chars in (10**6, 3000):
        assert {r["page_id"]: r["text"] for r in H.extract_main_text(df, group_chars=chars).collect()} == want, chars


def test_repeated_matches_brute_force():
    rng = np.random.default_rng(1)
    pages = [rng.integers(1, 4, n).astype(np.uint64) for n in (30, 3, 0, 40, 6, 25)]
    ids, counts = H.repeated(pages, 4)
    want = {}
    for k, p in enumerate(pages):
        for w in set(H.windows(p, 4).tolist()):
            want.setdefault(w, set()).add(k)
    assert dict(zip(ids.tolist(), counts.tolist())) == {w: len(s) for w, s in want.items() if len(s) > 1}


def test_notices_within_articles(spark):
    """Blocks on most of a host's articles go, whatever the groups; lines that fewer articles share stay, and copies keep theirs."""
    rng = random.Random(7)
    own = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(40))
    notice, line = "please read our newsletter each week for news", "this very line stands on just half of all articles"
    rows, want = [], {}

    def page(k, host, *blocks, text):
        rows.append((k, f"http://{host}.example/{k}", "<nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article><p>out</p>"))
        want[k] = "\n".join(text)

    for k in range(20):  # the notice on 13 of 20 articles, once within a block, the line on 10
        t = f"{own()} {notice}" if k == 12 else own()
        page(k, "a", t, *[notice] * (k < 12), *[line] * (k % 2), text=[t, *[line] * (k % 2)])
    for k in range(30, 36):  # copies of one article, and another
        t = t if k < 35 else own()
        page(k, "b", t, notice, text=[t, notice])
    for k in range(40, 43):  # fewer pages than a notice asks for
        t = own()
        page(k, "c", t, notice, text=[t, notice])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chars in (10**6, 3000, 500):
        out = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract_main_text(df, group_chars=chars).collect()}
        assert out == {k: (v, len(v)) for k, v in want.items()}, chars


def test_hidden_is_an_attribute():
    texts = lambda html: [b.text for b in H.page_blocks(html) if not b.furniture]
    for attr in ('style="overflow: hidden"', 'class="post hidden-print"', 'title="a hidden lake"', "data-hidden=1"):
        assert texts(f"<body {attr}><article {attr}><p {attr}>kept</p></article></body>") == ["kept"], attr
    for attr in ("hidden", "HIDDEN", 'id="x"\thidden', 'hidden=""', 'style="color:red; display : none"'):
        assert texts(f"<div><p {attr}>gone</p><p>kept</p></div>") == ["kept"], attr


def test_all_declared_regions_stay():
    def text(html):
        blocks = H.page_blocks(html)
        return H.main_text(blocks, np.zeros(sum(b.text.count(" ") + 1 for b in blocks), bool))

    assert text('<p>out</p><div class="entry-content">one one one</div><div class="entry-content">two</div>') == "one one one\ntwo"
    assert text("<article>a a a</article><p>out</p><article>b<article class='comment'>c</article></article>") == "a a a\nb"
    assert text('<div class="content"><p>lead</p><article>body body</article><p>end</p></div><p>out</p>') == "lead\nbody body\nend"
    assert text("<main><header><h1>head</h1></header><p>lead</p><article>body body</article></main><p>out</p>") == "head\nlead\nbody body"


# --- toxicity ------------------------------------------------------------------------------
def test_grammar():
    g = X.Grammar({"idiot$": 0.9, "scum": 0.9})
    kinds = lambda t: [m[2] for m in g.matches(t)]
    assert kinds("What an Idiot.") == ["insult"] and kinds("idiotic things") == [] and kinds("scummy deeds") == ["insult"]
    assert kinds("you are an idiot") == ["insult_targeted"] and kinds("not an idiot") == ["insult_negated"]
    assert kinds("not so very much of an idiot") == ["insult"] and kinds('she said "idiot" today') == ["insult_reported"]
    assert kinds("you! idiot") == ["insult"] and kinds("I will kill you") == ["threat"] and kinds("you I kill") == ["threat_targeted"]
    assert g.matches(None) == [] and g.matches("") == []


def test_toxicity_model(spark):
    rng = random.Random(3)
    clean = [f"k{i}q".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        t, toxic = [rng.choice(clean) for _ in range(40)], i % 4 == 0
        if toxic:
            t[rng.randrange(40)] = rng.choice(["zorgish", "zorging", "blarf"])
        rows.append((i, " ".join(t), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "x", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = X.fit(df, lab)
    out = {r["doc_id"]: r for r in X.scored(df, model).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    held = [i for i in range(900) if out[i]["held_out"]]
    assert 100 < len(held) < 260 and sum(out[i]["predicted"] == (i % 4 == 0) for i in held) > 0.97 * len(held)
    assert X.scored(df, X.fit(df, lab.limit(0))).count() == len(rows) and X.scored(df.limit(0), model).count() == 0


# --- token counts --------------------------------------------------------------------------
def test_rollup(spark, tmp_path):
    rows = [(1, "a b c.", "s", "en"), (2, "d", "s", None), (3, None, None, "en"), (4, "e f", "s", "en"), (4, "e f", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    store = C.TokenRollup(spark, f"file://{tmp_path}/r")
    assert store.totals().count() == 0
    assert store.commit("1", C.inserts(df, "words-1")) and not store.commit("1", C.inserts(df, "words-1"))
    get = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}
    assert get() == {("s", "en", "words-1"): (3, 7), ("s", None, "words-1"): (1, 1), (None, "en", "words-1"): (1, 0)}
    store.commit("2", C.revisions(df, "words-1", "words-2"))
    assert get() == {("s", "en", "words-2"): (3, 8), ("s", None, "words-2"): (1, 1), (None, "en", "words-2"): (1, 0)}
    store.commit("3", C.deletes(df.where("lang IS NULL"), "words-2"))
    store.commit("4", C.inserts(df.limit(0), "words-2"))
    assert get() == {("s", "en", "words-2"): (3, 8), (None, "en", "words-2"): (1, 0)} and store.batches() == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        store.commit("../x", C.inserts(df, "words-1"))


# --- pipeline ------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, d)
        assert after.columns == docs.columns
        if name != "mixing":
            assert after.join(before, docs.columns, "left_anti").count() == 0
        before = after
    out = P.run(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("end")).first()
    assert out["n"] == before.count() and out["t"] == out["end"]
