"""The training-data operators against brute force, and on tables with odd rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import decontam, encoding, html, jaccard, packing, quality, queries, sufdedup, suffixes, tokenfiles, toxicity, urls

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, sig string, k long"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = "The quick brown fox jumps over the lazy dog and runs away from all of them. " * 400
    shared = "a passage of some length that stands in several of these little documents, word for word"
    texts = [None, "", "  \n ", "one", "one", f"x {shared} y", f"other {shared} end", f"x {shared} y", long_text, long_text + "tail", "é" * 60, "ü é" + "é" * 60, "\x00\x01 control <|endoftext|> s\tp\x0bc\r\n", "İstanbul ß ﬁ " * 20]
    return spark.createDataFrame([(i, t, None, "s", None, "c", 7) for i, t in enumerate(texts)], COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def check_jaccard(df):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows(df)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    links, parent = collections.Counter(), {r: r for r in rep.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(rep.values()), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["rep_id"], r["n_links"], r["class_id"]) for r in rows(jaccard.join(df))}
    assert got == {i: (rep[s], links[rep[s]], root(rep[s])) for i, s in sets.items()}


def test_jaccard(docs, odd, none):
    check_jaccard(docs)
    check_jaccard(odd)
    assert jaccard.join(none).count() == 0
    assert set(jaccard.keep_one(odd).columns) == set(odd.columns)


def test_jaccard_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(600):  # more than a block of near copies
        own = list(base)
        own[int(rng.integers(150))] = f"edit{i}"
        texts.append((i, " ".join(own)))
    check_jaccard(spark.createDataFrame(texts, "doc_id long, text string"))


def test_keep_one_row_of_each_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    data = [(None, a, "1"), (None, b, "2"), (5, b, "3"), (5, c, "4"), (5, c, "5"), (3, c + " more", "6"), (7, "x y z", "7"), (7, "x y z", "8"), (None, "none", "9"), (None, "none", "10")]
    got = rows(jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string, lang string")))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", a), ("5", b), ("3", c + " more"), ("7", "x y z"), ("None", "none")])


def check_dedup(df):
    data = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in rows(df)), key=lambda x: x[0])
    first, want = {}, {}
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(sufdedup.report(df))} == want


def test_suffix_dedup(docs, odd, none, monkeypatch):
    check_dedup(docs)
    check_dedup(odd)
    assert sufdedup.report(none).count() == 0
    cut = rows(sufdedup.cut(odd))
    assert all(r["sig"] == "c" and (r["text"] is None or r["n_chars"] == len(r["text"])) for r in cut)
    monkeypatch.setattr(sufdedup, "GROUP", 2)  # the way for groups too large for a task
    check_dedup(docs)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in range(80):
        s = bytes(rng.integers(0, 1 + n % 5, n).astype(np.uint8))
        assert suffixes.suffix_array(s) == sorted(range(n + 1), key=lambda i: s[i:])


def test_suffix_arrays_of_many():
    rng = np.random.default_rng(6)
    for n in range(100):
        texts = sorted((bytes(rng.integers(0, 1 + n % 5, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 12))), key=len, reverse=True)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        symbols = np.concatenate([[*(c + 1 for c in t), 0] for t in texts])
        out = suffixes.suffix_arrays(symbols, bounds)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert (out[a:b] - a).tolist() == sorted(range(len(t) + 1), key=lambda i: t[i:])


def test_equal_windows(monkeypatch):
    rng = np.random.default_rng(7)
    for together in (1, 4, 1000):
        monkeypatch.setattr(suffixes, "TOGETHER", together)
        texts = [bytes(rng.integers(0, 2, rng.integers(0, 60)).astype(np.uint8)) for _ in range(300)]
        group = np.sort(rng.integers(0, 60, 300))
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        want, got = collections.defaultdict(list), collections.defaultdict(list)
        for t, g, a in zip(texts, group.tolist(), bounds.tolist(), strict=False):
            for i in range(len(t) - 10):
                want[g, t[i : i + 11]].append(a + i)
        for place, number in zip(*(x.tolist() for x in suffixes.equal_windows(np.frombuffer(b"".join(texts), np.uint8), bounds, group, 11)), strict=True):
            got[number].append(place)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def check_tokens(df):
    tok = Tokenizer.from_file(BPE)
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids for r in rows(df)}
    start, want = 0, {}
    for i in sorted(ids):
        x = np.array(ids[i] + [1], "<u4")
        want[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    back = tokenfiles.read_back(tokenfiles.write_pfor(df, BPE, end_id=1))
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(back)} == want
    packed, at = rows(packing.best_fit(df, BPE, end_id=0)), collections.defaultdict(list)
    for r in packed:
        x = np.array(ids[r["doc_id"]] + [0], "<u4")[r["start"] : r["start"] + 2048]
        assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(x), zlib.crc32(x.tobytes()))
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(-(-(len(x) + 1) // 2048) for x in ids.values()) == len(packed)
    for runs in at.values():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        assert end <= 2048
    return ids


def test_token_files_and_packing(docs, odd, none):
    ids = check_tokens(docs)
    check_tokens(odd)
    assert packing.best_fit(none, BPE).count() == 0
    assert tokenfiles.read_back(tokenfiles.write_pfor(none, BPE)).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in rows(tokenfiles.token_counts(docs, BPE, 49407))}
    assert counts == {i: len(x) + 1 for i, x in ids.items()}
    assert tokenfiles.token_counts(none, BPE, 49407).count() == 0


def test_token_ids_of_odd_rows(spark):
    """Nulls beside an id that no float holds, repeated ids and rows, special tokens in texts, clashing columns."""
    large = 2**53 + 1
    texts = [(None, "a b"), (large, "<|endoftext|> c"), (5, "x"), (5, "x"), (5, "x y"), (None, None), (2, "<|startoftext|>"), (-7, ""), (8, "a<|endoftext|>b")]
    df = spark.createDataFrame([(i, t, 1, "u", 2) for i, t in texts], "doc_id long, text string, start long, uri string, width long").coalesce(1)
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    got = tokenfiles.token_counts(df, BPE, 49407)
    assert "Broadcast" not in got._jdf.queryExecution().toString() and "Join" not in got._jdf.queryExecution().toString()
    got = sorted(rows(got), key=lambda r: r["ordinal"])
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    tok.encode_special_tokens = False
    want = sorted((-(2**63) if i is None else i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts)
    back = sorted(rows(tokenfiles.read_back(tokenfiles.write_pfor(df, BPE))), key=lambda r: r["start"])
    assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in back) == want
    assert [r["doc_id"] for r in back] == [None, None, -7, 2, 5, 5, 5, 8, large]
    again = sorted(rows(tokenfiles.read_back(tokenfiles.write_pfor(df.repartition(5), BPE))), key=lambda r: r["start"])
    assert back == again
    packed = rows(packing.best_fit(df, BPE))
    assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["length"]) for r in packed) == want


def test_encoder_is_the_library(docs, monkeypatch):
    """Odd characters, long words, long texts and special tokens."""
    monkeypatch.setattr(encoding, "BLOCK_BYTES", 100_000)
    rng = np.random.default_rng(4)
    parts = ["a", "B", "É", "ß", "÷", "×", "'", "'s", "'LL", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "1", "٣", "½", "e\u0301", "İ", "Σ", "日本", "🎉", "!!", "<|endoftext|>", "<|", "the", "Word", "\x00", "\u0301", "ff", "x" * 300, "Ÿ", "Þ", "12a3"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)] + [" ".join(r["text"] or "" for r in rows(docs)), "ab1" * 80_000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for ordinary in (False, True):
            tok = Tokenizer.from_file(public_tokenizers.path(name))
            tok.encode_special_tokens = ordinary
            enc = encoding.Encoder(public_tokenizers.path(name), ordinary)
            want = [np.array(x.ids, enc.dtype).tobytes() for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            assert enc.ids(texts) == want
            assert [x for k in range(0, 500, 50) for x in enc.ids(texts[k : k + 50])] == want[:500]


def test_encoder_forgets(docs, monkeypatch):
    monkeypatch.setattr(encoding, "MOST_RUNS", 1 << 13)
    monkeypatch.setattr(encoding, "BLOCK_BYTES", 20_000)
    enc, tok = encoding.Encoder(BPE), Tokenizer.from_file(BPE)
    texts = [r["text"] or "" for r in rows(docs)]
    assert enc.ids(texts) == [np.array(x.ids, enc.dtype).tobytes() for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_scan_blocks(docs):
    files = tokenfiles.write_flat(docs, BPE, 49407)

    def ends(block):
        return sorted((r["uri"], r["n_before"] + k, e) for r in rows(tokenfiles.scan_flat(files, 49407, block)) for k, e in enumerate(r["ends"]))

    assert ends(97) == ends(1 << 20)


def test_pfor_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for most in (1, 2, 50_000, 1 << 32):
            ids = rng.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
            data, starts = tokenfiles.encode_blocks(ids)
            assert (tokenfiles.decode_blocks(np.frombuffer(data, np.uint8), starts, n) == ids).all()


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(inside), failed


def test_quality(docs, odd, none):
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] for r in rows(df)}
        for r in rows(quality.judge(df)):
            assert brute_quality(text[r["doc_id"]]) == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
            assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0
    kept = {r["doc_id"] for r in rows(quality.judge(docs)) if r["kept"]}
    assert {r["doc_id"] for r in rows(quality.keep(docs))} == kept


def edits(p, t):
    column, best = list(range(len(p) + 1)), None
    for c in t:
        n = [0]
        for i, x in enumerate(p):
            n.append(min(column[i] + (x != c), column[i + 1] + 1, n[i] + 1))
        column = n
        best = column[-1] if best is None else min(best, column[-1])
    return best


def test_decontamination(spark, docs, odd, none):
    rng = np.random.default_rng(2)
    for _ in range(200):
        p = "".join(rng.choice(list("abcd"), 30))
        t = "".join(rng.choice(list("abcd"), 20)) + "".join(c for c in p if rng.random() > 0.08) + "zz"
        got = [m[1] for m in decontam.Matcher([(1, p)], 0.1).matches(t)]
        assert got == ([edits(p, t)] if edits(p, t) <= 3 else [])
    items = spark.createDataFrame([(1, "A passage of some  length that stands in SEVERAL"), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontam.leaks(odd, items))} == {(5, 1), (6, 1), (7, 1)}
    assert {r["doc_id"] for r in rows(decontam.clean(odd, items))} == set(range(14)) - {5, 6, 7}
    assert decontam.leaks(none, items).count() == 0
    assert decontam.leaks(odd, items.where("false")).count() == 0


def test_decontamination_short_items(spark):
    items = spark.createDataFrame([(1, "In  Rome"), (2, "42"), (3, "東京"), (4, " ")], "item_id long, text string")
    texts = ["It was in rome.", "in romeo", "142 and 42nd", "(42)", "当時の東京は", "begin rome", "in Rom", "in romeo, in rome"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in decontam.leaks(df, items).collect()} == {(0, 1, 0, 14), (3, 2, 0, 3), (4, 3, 0, 5), (7, 1, 0, 17)}
    assert {r["doc_id"] for r in rows(decontam.clean(df, items))} == {1, 2, 5, 6}


def test_html(spark):
    frame = '<nav><a href="/">Home</a></nav><div class="hello"><p>Site words of {0}</p></div>'
    pages = [(i, f"http://h{i % 2}.x/{i}", f"<html><body>{frame.format(i % 2)}<article><h1>T {i}</h1><p><b>A &amp; b<br>c{i}<p>Same text<script>x('</p>')</script></article><footer>f") for i in range(40)]
    pages += [(90, None, None), (91, "", ""), (92, "http://h0.x/n", "<div>plain <i>te</i>xt</div><aside>no</aside>"), (93, "x", "<p>cut <")]
    got = {r["page_id"]: r["text"] for r in rows(html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert got[3] == "T 3\nA & b c3\nSame text"
    assert (got[90], got[91], got[92]) == ("", "", "plain text")
    bare = [(i, f"http://h.x/{i}", f"{frame.format(0)}<div><p>Own {i}</p></div>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in rows(html.extract(spark.createDataFrame(bare, "page_id long, url string, html string")))}
    assert got[7] == "Own 7"


def html_texts(spark, pages):
    return {r["page_id"]: r["text"] for r in rows(html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}


def test_html_counts_decide(spark):
    # frame text outside all lists of tags and classes, in paragraphs, list items, headings and inline elements
    frame = '<span>My site</span><h2>The site</h2><p>All about <b>us</b></p><ul><li>first</li><li>of {0}</li></ul>'
    pages = [(i, "http://h.x/a", f"{frame.format(i)}<div><p>Own <i>word</i> {i}</p></div><p>imprint<script>t({i})</script></p>") for i in range(30)]
    assert html_texts(spark, pages)[7] == "of 7\nOwn word 7"
    inside = [(i, "http://h.x/a", f"<article><p>Own {i}</p><p>Said <b>twice</b></p><p><a>Share</a> <a>Print</a></p></article>") for i in range(30)]
    assert html_texts(spark, inside)[7] == "Own 7\nSaid twice"


def test_html_small_and_hot_hosts(spark):
    def page(frame, own):
        return f'<div><ul><li><a href="/">{frame}</a></li></ul></div><div><p>Own {own}</p></div>'

    small = [(i, "http://small.x/a", page("Small", i)) for i in range(3)]
    hot = [(100 + i, "http://hot.x/a", page(f"Section {i // 6}", i)) for i in range(120)]  # 5 % of the host each
    got = html_texts(spark, small + hot + [(900, "http://one.x/", page("One", 0))])
    assert (got[1], got[130], got[900]) == ("Own 1", "Own 30", "One\nOwn 0")
    # what recurs by chance on a few of many pages stays
    plain = [(i, "http://p.x/a", f"<div><p>Thanks{'.' if i % 10 else '!'}</p><p>Own {i}</p></div>") for i in range(60)]
    assert html_texts(spark, plain)[10] == "Thanks!\nOwn 10"


def test_html_articles_stay(spark):
    long, short = "six " * 150, "five " * 100
    teaser = '<article><a href="/t">Read the other one</a></article>'
    pages = [(1, "http://a.x/", f"<article><p>{long}</article><article><p>{short}</article>"), (2, "http://b.x/", "<form><input><label>L</label><article><p>In a form</article><button>Go</button></form>"), (3, "http://c.x/", "<p>Text</p><form><p>Search</p></form>")]
    pages += [(10 + i, "http://t.x/", f"<article><p>Own {i}</article>{teaser}") for i in range(6)] + [(20 + i, "http://t.x/", f"{teaser}<p>{i}</p>") for i in range(2)]
    got = html_texts(spark, pages)
    assert got[1] == f"{long.strip()}\n{short.strip()}"
    assert (got[2], got[3], got[10], got[20]) == ("In a form", "Text", "Own 0", "Read the other one")


def test_html_odd_pages(spark):
    frame = '<div><ul><li><a href="/">Frame</a></li></ul></div>'
    pages = [(None, "http://n.x/", f"{frame}<div><p>Own {i}</p></div>") for i in range(6)] + [(7, None, None), (7, None, None), (8, "u", "")]
    pages += [(20, "http://a.x/", "<article><header><h1>A<h2>B</h2></header><p>x<aside>y</aside></article>"), (21, "http://b.x/", '<article><p class="related work">Related work</p><section id="search-methods"><h2>Search</h2></section><div class="ad">Buy</div><p class="advert">Now</p><div class="post-comments">C</div></article>')]
    deep = "<b>" * 60_000 + "text" + "</foo>" * 60_000  # quadratic work on this would take hours
    pages += [(30, "http://c.x/", deep), (31, "http://d.x/", "<article>" + "<span>" * 20_000 + "w" + "</b>" * 20_000)]
    df = spark.createDataFrame([(i, u, h, "t", 1, "s") for i, u, h in pages], "page_id long, url string, html string, templates string, row long, subtree string")
    got = collections.defaultdict(list)
    for r in rows(html.extract(df)):
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert sorted(got[None]) == [f"Own {i}" for i in range(6)]
    assert (got[7], got[8], got[20], got[30], got[31]) == (["", ""], [""], ["A\nB\nx"], ["text"], ["w"])
    assert got[21] == ["Related work\nSearch"]
    assert html.extract(df.where("false")).count() == 0


def test_html_tags_read_at_once(monkeypatch):
    """Tags as most are written pass by HTMLParser's own reading, and all of a page gives the same elements as with it."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    def flat(node):
        return [(x.tag, x.attrs, [c if isinstance(c, str) else c.tag for c in x.children]) for x in html._elements(node)]

    odd = ["", "<", "<p", "</p", "</>", "</1>", "<p>a<P CLASS=x>b", "<a href=x/>y</a >", "<br/></br>", "<a  b='1'>", '<a b="1"c="2">z', '<a b="&lt;&quot;" c>', '<a b="x y=&quot;" D-e="">t</A>', "<td>1<td>2</table>", '<li a="b=c" a="d">1<li>2</ul>x']
    odd += ["<script>if (a<b) '</p>'</script>c", "<style>p</style><title>a<b>c</title>d", "<textarea><p></textarea>e", '<script type="x">a</SCRIPT >f<p>', "<!-- <p> --><!x><?y>g", '<x:y z="1">h</x:y>', '<p a="<b>">i</p>', '<p a="1\n2">j<form><div id="k">l</form>', "<a\x00b>m"]
    odd += [r["html"] or "" for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    got = [flat(html.parse(h)) for h in odd]
    asked = []
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i, f=HTMLParser.parse_starttag: (asked.append("start"), f(self, i))[1])
    monkeypatch.setattr(HTMLParser, "parse_endtag", lambda self, i, f=HTMLParser.parse_endtag: (asked.append("end"), f(self, i))[1])
    html.parse('<html><body class="a b"><p>1</p><A HREF="x?y=1">2</A><td>3</td></body></html>')
    assert not asked
    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.delattr(html._Builder, name)
    assert [flat(html.parse(h)) for h in odd] == got


def test_html_counts_by_brute_force(spark):
    """The subtrees of given pages that recur, counted in plain Python, are those that extract() deletes."""
    pages = rows(spark.read.parquet(f"{SF}/pages.parquet"))
    marks = {r["page_id"]: (html.host_of(r["url"]), set(html.subtrees(html.parse(r["html"] or ""), html.host_of(r["url"])).values())) for r in pages}
    held, total = collections.defaultdict(set), collections.defaultdict(set)
    for r in pages:
        host, own = marks[r["page_id"]]
        total[host].add(r["html"])
        for m in own:
            held[host, m].add(r["html"])
    templates = set()
    for (host, m), own in held.items():
        most, few = (html.MIN_PAGES_STRICT, html.MIN_PAGES_SMALL_STRICT) if m & 1 else (html.MIN_PAGES, html.MIN_PAGES_SMALL)
        if len(own) >= most or len(own) >= max(few, html.NEARLY_ALL * len(total[host])):
            templates.add(m)
    want = {}
    for r in pages:
        root = html.parse(r["html"] or "")
        html.remove(root, html.subtrees(root, marks[r["page_id"]][0]), frozenset(templates))
        want[r["page_id"]] = "\n".join(b for x in html.prune(root) for b in html.blocks(x))
    assert {r["page_id"]: r["text"] for r in rows(html.extract(spark.read.parquet(f"{SF}/pages.parquet")))} == want


def test_urls(spark):
    data = [(1, "http://A.Example.NET/en/1?q"), (2, "http://x.net"), (3, "ftp://b.net/x#y"), (4, None), (5, "no scheme"), (6, "http://www.casino-win.example.com/en/"), (7, "http://casino-win.example.com/de/1"), (8, "http://q.org/fr/"), (8, "http://q.org/fr/"), (9, "http://badcasino-win.example.com/"), (10, "http://www.casino-win.example.com:80")]
    listed = spark.createDataFrame([("http://Casino-Win.example.com",), (None,), ("q.org/sub/",)], "entry string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urls.judge(spark.createDataFrame(data, "page_id long, url string"), listed, queries.RULES)) if r["page_id"] != 8)
    assert [(g[0], g[3], g[4]) for g in got] == [
        (1, "example.net/en/", "allow"), (2, None, "allow"), (3, "net/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "block"), (7, "example.com/de/", "block"), (9, None, "allow"), (10, None, "block"),
    ]
    assert got[0][1:3] == ("a.example.net", "/en/1")


def test_urls_deep_entries(spark):
    data = [(1, "http://a.b.c.d.e.example/"), (2, "http://x.a.b.c.d.e.example/p"), (3, "http://b.c.d.e.example/"), (4, "http://h.com/a/b/c/d/e/f/"), (5, "http://w.h.com/a/b/c/d/e/f/g/h/i?q"), (6, "http://h.com/a/b/c/d/e/g"), (7, "http://h.com/a/b/c/d/e/f")]
    pages = spark.createDataFrame(data, "page_id long, url string")
    listed = spark.createDataFrame([("a.b.c.d.e.example",), ("http://h.com/a/b/c/d/e/f/",)], "entry string")
    assert {r["page_id"] for r in rows(urls.judge(pages, listed, [])) if r["verdict"] == "block"} == {1, 2, 4, 5}
    assert {r["verdict"] for r in rows(urls.judge(pages, listed.where("false"), []))} == {"allow"}


def test_urls_listed_pages(spark):
    entries = ["http://x.com/a/b.html", "https://User@Y.com.:8080/p?q=1", "z.com", "w.com/d/", None, "?", "http://x.com/a/b.html"]
    data = [(1, "http://x.com/a/b.html"), (2, "https://www.x.com/a/b.html?x#y"), (3, "http://x.com/a/b.htm"), (4, "http://x.com/a/"), (5, "http://y.com/p/"), (6, "http://y.com/p/q"), (7, "http://y.com/pq"), (8, "http://me@z.com.:80"),
            (9, "http://z.com/any"), (10, "http://w.com/d"), (11, "http://w.com/d/"), (12, "http://w.com/d/e"), (13, "http://notz.com/"), (None, "http://z.com"), (1, "http://x.com/a/b.html"), (14, "http://com/"), (15, "http:///p")]
    pages = spark.createDataFrame([(i, u, "k", 1, True) for i, u in data], "page_id long, url string, key string, block long, hit boolean")
    listed = spark.createDataFrame([(e, "x") for e in entries], "entry string, key string")
    want = sorted(map(str, [1, 1, 2, 5, 6, 8, 9, 11, 12, None]))

    def blocked():
        return sorted(str(r["page_id"]) for r in rows(urls.judge(pages, listed, [])) if r["verdict"] == "block")

    assert blocked() == want and urls.judge(pages, listed, []).count() == len(data)
    assert urls.judge(pages.where("false"), listed, queries.RULES).count() == 0
    most, urls.MOST_BROADCAST = urls.MOST_BROADCAST, 0
    try:  # nothing small enough to broadcast
        assert blocked() == want
    finally:
        urls.MOST_BROADCAST = most


def test_urls_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    got = sorted(tuple(r) for r in queries.op7_url_filters(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL["op7_url_filters"]).fetchall())


def test_toxicity(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows(toxicity.classify(docs, labels))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len(rows(toxicity.classify(odd, labels.where("false")))) == 14
    assert toxicity.classify(none, labels).count() == 0


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    found = toxicity.classify(spark.read.parquet(f"{big}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows(found.groupBy("toxic", "predicted").count())}
    # some 2,600 training rows, a tenth of them toxic; larger tables give MAX_TRAIN rows and a better model
    print(n)
    assert n[1, 1] > 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.01 * n[0, 0]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept
