"""Each operator against the library, a brute-force version or an exact round trip, with the awkward inputs."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from domsift.llm import chat_format, decontaminate, html_extract, jaccard, packing, token_counts, topk, toxicity, url_filter, warc
from domsift.llm.components import connected_components
from domsift.llm.wordbpe import PrefixCounts, WordIds, _Bounded, load

DOCS = "doc_id LONG, text STRING, evidence INT, digest STRING, label STRING"  # extra columns that could clash


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], DOCS)


def prose(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


# 1
def test_url_rules(spark):
    urls = ["http://A.example.ORG/en/17", "https://example.org/es/", "http://x.org", "http://x.org/?q", "ftp://a.com/fr/x", "http://com/de/",
            None, "", "no scheme/org/", "http://", "http://example.org:80/en/1", "http://notexample.org/en/1", "http://example.org/en/1", "http://example.org/en/1"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://b.com/de/", "h")], "page_id LONG, url STRING, host STRING")
    got = sorted((r.page_id if r.page_id is not None else 99, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect())
    want = ["example.org/en/1", "example.org/es/", None, "org/", "com/fr/", "com/de/", None, None, None, None, None, "org/", "example.org/en/1", "example.org/en/1"]
    verdict = {"com/de/": "block", "example.org/en/1": "block", "example.org/es/": "block"}
    assert got == [(i, r, verdict.get(r, "allow")) for i, r in enumerate(want)] + [(99, "com/de/", "block")]
    twice = df.where("page_id = 0").unionAll(df.where("page_id = 0"))
    assert url_filter.filter_urls(twice).count() == 2
    as_table = spark.createDataFrame(url_filter.RULES, "host STRING, path STRING, verdict STRING")
    assert sorted(map(str, url_filter.filter_urls(df, as_table).collect())) == sorted(map(str, url_filter.filter_urls(df).collect()))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# 2
def test_chat_round_trip(spark):
    rnd = random.Random(4)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\/INST]", "\\", "<", "[", "/s>", "é", "\n", "日", "ok", "$1"]
    rows = [(c, t, rnd.choice(["user", "assistant", "<s>", None]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(9))) or None) for c in range(120) for t in range(3)]
    rows += [(200, 0, "user", "hi"), (200, 0, "user", "hi"), (200, None, "assistant", "yo"), (None, 1, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, formatted STRING")
    done = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    sums = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(df)).collect()}
    assert all(r.identical for r in done.values()) and not done[200].escaped and len(done) == 122
    for conv, row in done.items():
        turns = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda t: (t[0], t[1] or 0, t[2:]))
        assert [(t.role, t.text) for t in row.turns] == [t[2:] for t in turns]
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        assert sums[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and sums[conv].loss_chars == len(learned)
        assert sums[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        at, under = 0, []
        for run in row.loss_mask:
            under += [row.formatted[at : at + run.n_chars]] if run.learn else []
            at += run.n_chars
        assert at == len(row.formatted)
        if not row.escaped:
            assert "".join(under) == learned
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 3
def links_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    links = {i: {j for j in ids if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in ids}
    label = {}
    for i in ids:
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    return {i: (label[i], len(links[i])) for i in ids}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", block)
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randrange(1, 60))) for i in range(60)]
    base = prose(rnd, 150).split()
    for i in range(100, 130):  # one group in which only some pairs reach the threshold
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, ""), (301, None), (302, "a b"), (303, "A  b"), (304, "long " * 20_000)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == links_by_brute_force(rows)


def test_keep_one_and_empty(spark):
    rows = [(5, "same text here now ok"), (2, "same text here now ok"), (7, "other words"), (7, "other words"), (None, "same text here now ok")]
    kept = jaccard.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "evidence", "digest", "label"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, rows[0][1]), (2, rows[0][1]), (7, "other words")]
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0
    bands, width = jaccard.choose_bands()
    assert 1 - (1 - 0.8**width) ** bands >= jaccard.TARGET_RECALL


def test_links_of_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 50)
    rnd = random.Random(12)
    rows = []
    for i in range(0, 60, 3):  # three near copies, each larger than a block; the third falls in a higher size class
        text = prose(rnd, 90, 10**6)
        rows += [(i, text), (i + 1, text + " end"), (i + 2, text + " " + prose(rnd, 18, 10**6))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == links_by_brute_force(rows)


def test_one_id_on_different_texts(spark):
    rnd = random.Random(11)
    a, b, c = prose(rnd, 100), prose(rnd, 100), prose(rnd, 100)
    rows = [(5, a), (3, a + " end"), (5, b), (5, "  " + b.upper()), (6, b + " end"), (9, c), (9, c + " end"), (9, "alone")]
    for order in (rows, rows[::-1]):
        got = sorted(map(tuple, jaccard.near_duplicates(docs_of(spark, order)).collect()))
        assert got == sorted([(5, 3, 1), (3, 3, 1), (5, 5, 2), (5, 5, 2), (6, 5, 2), (9, 9, 1), (9, 9, 1), (9, 9, 0)])
        kept = [(r.doc_id, r.text.lower().strip()) for r in jaccard.keep_one(docs_of(spark, order)).collect()]
        assert len(kept) == 4 and {(3, a + " end"), (5, b), (9, "alone")} < set(kept) and set(kept) & {(9, c), (9, c + " end")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# 4
def test_decontaminate(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(prose(rnd, 8, 3000) + "." for _ in range(4))) for i in range(30)] + [(30, None), (31, ""), (3, "one more text of item three. yes."), (32, prose(rnd, 300, 3000))]
    rows = [(i, prose(rnd, 300, 3000)) for i in range(40)]
    for i in range(0, 40, 3):
        t = rows[i][1].split()
        at = rnd.randrange(len(t))
        rows[i] = (i, " ".join(t[:at]) + " " + items[i % 30][1].upper() + " " + " ".join(t[at:]))
    rows += [(100, items[33][1]), (101, None), (102, ""), (103, items[0][1]), (103, items[0][1])]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect())
    assert got == sorted([(i, i % 30) for i in range(0, 40, 3)] + [(100, 32), (103, 0), (103, 0)])
    kept = {r.doc_id for r in decontaminate.keep_clean(docs_of(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_block_max_wand_equals_scoring_all():
    rnd = random.Random(7)
    items = [(i, prose(rnd, rnd.randrange(3, 40), 120)) for i in range(90)]
    frequency = {}
    for _, t in items:
        for w in set(t.split()):
            frequency[w] = frequency.get(w, 0) + 1
    index = decontaminate.Index(items, len(items), 20.0, frequency)
    for _ in range(200):
        terms = [index.term[w] for w in {f"w{rnd.randrange(120)}" for _ in range(rnd.randrange(1, 40))} if w in index.term]
        full = {}
        for t in terms:
            for k, s in zip(*index.postings[t][:2]):
                full[k] = full.get(k, 0.0) + s
        for threshold in (0.1, 0.3, 0.6):
            assert sorted(k for k, _ in index.retrieve(terms, threshold)) == sorted(k for k, s in full.items() if s >= threshold - 1e-9)


# 5
def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", big), (4, "u", other), (5, "u", None), (6, "u", "small"), (7, "u", "small"), (None, "u", other), (8, "u", "a\r\n\r\nb" * 9000), (6, "u", "small")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id LONG, url STRING, html STRING, digest STRING")
    manifests = [warc.write(df, str(tmp_path / str(k)), roll_bytes=200, shard_bytes=3000) for k in range(2)]
    assert [f["sha256"] for f in manifests[0]["files"]] == [f["sha256"] for f in manifests[1]["files"]] and len(manifests[0]["files"]) > 2
    got = sorted(map(tuple, warc.read(spark, str(tmp_path / "0")).collect()), key=str)
    last = {big: 3, other: 4}
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h in last and i != last[h]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert got == sorted(want, key=str)
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


# 6
def odd_texts():
    rnd = random.Random(8)
    alphabet = "abc'sSTrevl 1½éÉİſŉ<|endoftext|>\t\n\x85\x1d.!Σς日😀́"
    fixed = ["", "  ", "x<|endoftext|>y <|ENDOFTEXT|>", "日本 12½ ²", "we'll 'r ''s", "a" * 3000]
    return fixed + ["".join(rnd.choice(alphabet) for _ in range(30)) for _ in range(150)] + ["".join(chr(rnd.randrange(32, 384)) for _ in range(30)) for _ in range(100)]


def test_records_are_read_whatever_the_step():
    bodies = [b"", b"x", b"<p>" * 40_000, bytes(range(256)) * 30]
    records = [warc.record(i, "http://h/", b, len(b), hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    data = b"".join(map(warc._member, records))
    for step in (1, 7, 1 << 14, 1 << 24):
        got = [block.partition(b"\r\n\r\n")[2] for _, block in warc.parse(data, step)]
        assert got == bodies
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.parse(data[:-3]))
    many, few = data * 800, data * 200
    took = []
    for archive in (few, many):
        began = time.process_time()
        assert sum(1 for _ in warc.parse(archive)) == 4 * len(archive) // len(data)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_prefix_counts_are_the_librarys():
    path = token_counts.default_tokenizer()
    library, counts, ids = load(path), PrefixCounts(path), WordIds(path)
    for text in odd_texts():
        store = counts.store(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert (int(store[-1]) if len(store) else 0) == len(want)
        assert ids.ids(text) == np.array(want, dtype="<u4").tobytes()
        if len(text) > 100:
            continue
        every = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [counts.at(text, store, k) for k in range(len(text) + 1)] == every
        for budget in (0, 1, 5):
            assert counts.longest(text, store, budget) == max(k for k, n in enumerate(every) if n <= budget)


def test_long_unspaced_texts_of_any_script():
    path = token_counts.default_tokenizer()
    library, counts, ids = load(path), PrefixCounts(path), WordIds(path)
    rnd = random.Random(8)
    for letters in ("中文字符很多", "日本語カナかな", "абвгдЖЁ", "ΑΒΓδέ", "한국어", "😀😃", "İıſß", "e\u0301o"):
        text = "".join(rnd.choice(letters) for _ in range(120))
        every = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        store = counts.store(text)
        assert [counts.at(text, store, k) for k in range(len(text) + 1)] == every
        assert counts.longest(text, store, 50) == max(k for k, n in enumerate(every) if n <= 50)
    long = "".join(rnd.choice("中文字符很多") for _ in range(100_000))
    began = time.process_time()
    kept = counts.longest(long, counts.store(long), 2048)
    assert time.process_time() - began < 10
    assert len(library.encode(long[:kept], add_special_tokens=False).ids) <= 2048 < len(library.encode(long[: kept + 1], add_special_tokens=False).ids)
    assert ids.ids(long) == np.array(library.encode(long, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_full_dictionary_keeps_what_is_in_use():
    made = []
    words = _Bounded(lambda k: made.append(k) or len(k), limit=3)
    for i in range(50):
        assert words["the"] == 3 and words[f"w{i}"] == len(f"w{i}")
    assert made.count("the") == 1 and len(words) <= 3 and len(words.older) <= 3


def test_other_tokenizer_files():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert WordIds(path).ids("Some Text, 12") == np.array(load(path).encode("Some Text, 12", add_special_tokens=False).ids, dtype="<u4").tobytes()
    with pytest.raises(ValueError, match="not known"):
        PrefixCounts(path)


def test_count_tokens(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "word " * 3000)]
    got = sorted(map(tuple, token_counts.count_tokens(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 3, 2, False, 3)] * 2 + [(None, 0, 0, False, 0), (2, 15000, 3000, True, 2048 * 5)], key=str)


# 7
def test_extract_pages():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
    <article class="post"><h1>Title &amp; more</h1><p>One<br>two <b>bold<p>three &nbsp; x</b> &lt;tag&gt;</p><div class="advert">Buy</div><ul><li>a<li>b</ul>
    <form><input><label>Name</label></form><section class="comments"><article class="comment"><p>nice</p></article></section><p hidden>no</p>
    <table><tr><td>1<td>2<tr><td>3</table><aside>side</aside><p>end</article><footer>f</footer><script>if(a<b)"</p>"</script></body></html>"""
    assert html_extract.extract_pages([page]) == ["Title & more\n\nOne two bold\n\nthree x <tag>\n\na\n\nb\n\n1 2\n\n3\n\nend"]
    notice = "This site is run by the example foundation of the town of nowhere since 1999"
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    assert html_extract.extract_pages([f"<div>{notice}</div><div>{t}</div><p>{notice} {t}" for t in own]) == [f"{t}\n\n{t}" for t in own]
    copies = [f"<article><p>{own[0]}</p></article>"] * 5 + ["", "<", "<!-- open", "<script>x", "<p>&#x41;&bogus;"]
    assert html_extract.extract_pages(copies) == [own[0]] * 5 + ["", "<", "", "", "A&bogus;"]


def test_shared_runs_by_brute_force():
    rnd = np.random.default_rng(9)
    for _ in range(30):
        pages = [rnd.integers(0, 3, rnd.integers(0, 40)) for _ in range(6)]
        tokens = np.concatenate([np.append(p, -k - 1) for k, p in enumerate(pages)])
        page = np.concatenate([np.full(len(p) + 1, k) for k, p in enumerate(pages)])
        got = html_extract.covered(html_extract.pages_sharing(tokens, page, 4), 4, 3)
        want, at = np.zeros(len(tokens), bool), 0
        for p in pages:
            for i in range(len(p) - 3):
                run = p[i : i + 4].tolist()
                if sum(any(q[j : j + 4].tolist() == run for j in range(len(q) - 3)) for q in pages) >= 3:
                    want[at + i : at + i + 4] = True
            at += len(p) + 1
        assert (got == want).all()


def test_extract_rows(spark):
    rows = [(1, "http://h/1", "<p>x"), (1, "http://h/1", "<p>x"), (None, None, None), (2, "bad", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id LONG, url STRING, html STRING, _n INT")
    got = sorted(map(tuple, html_extract.extract(df, shard_bytes=2).collect()), key=str)
    assert got == sorted([(1, "http://h/1", "x", 1)] * 2 + [(None, None, "", 0), (2, "bad", "", 0)], key=str)


def test_extract_copies_and_shards(spark, monkeypatch):
    rnd = random.Random(13)
    menu, notice = prose(rnd, 12, 10**6), prose(rnd, 12, 10**6)
    own = [prose(rnd, 40, 10**6) for _ in range(60)]
    pages = [f"<article><p>{notice}</p><p>{t}</p></article>" for t in own[:40]] + [f"<p>{menu}</p><p>{t}</p>" if k < 7 else f"<p>{t}</p>" for k, t in enumerate(own[40:])]
    want = html_extract.extract_pages(pages)
    assert html_extract.extract_pages(["<p>two words"]) == ["two words"]  # fewer tokens than a run
    assert html_extract.run_hashes(np.array([1, 2, -1]), 8)[1].sum() == 0
    assert want == own  # on 40 of 60 pages, and on 7, of a host
    rows = [(k, "http://h/", p) for k, p in enumerate(pages)] + [(1000 + k, "http://h/x", pages[0]) for k in range(300)] + [(2000, "http://g/", pages[0])]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    for many in (1_000_000, 3):
        monkeypatch.setattr(html_extract, "MANY_RUNS", many, raising=False)
        got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.extract(df, shard_bytes=1500).collect()}
        assert len(got) == len(rows)
        assert all(got[k] == ("http://h/", t, len(t)) for k, t in enumerate(want))
        assert all(got[1000 + k] == ("http://h/x", want[0], len(want[0])) for k in range(300))
        assert got[2000][1] == f"{notice}\n\n{own[0]}"


def test_copies_are_packed_once(spark, monkeypatch):
    tables, write = {}, html_extract.written
    monkeypatch.setattr(html_extract, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    df = spark.range(500).selectExpr("id page_id", "'http://h/' url", "concat('<p>text ', if(id < 400, 0, id)) html").repartition(7)
    got = {r.page_id: r.text for r in html_extract.extract(df, shard_bytes=200).collect()}
    assert got == {i: f"text {0 if i < 400 else i}" for i in range(500)}
    pages = [html_extract._unpacked(bytes(r.data))[0].num_rows for r in tables["shards"].collect()]
    assert sum(pages) == 101 and max(pages) < 50  # the copies make no large group


# 8
def test_maximal_segments_by_brute_force():
    rnd = random.Random(10)

    def by_definition(scores, offset=0):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return by_definition(scores[:i], offset) + [(offset + i, offset + j, best[0])] + by_definition(scores[j:], offset + j)

    for _ in range(200):
        scores = [rnd.randrange(-7, 6) + rnd.random() / 1000 for _ in range(rnd.randrange(0, 14))]
        got = toxicity.maximal_segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in by_definition(scores)]


def test_toxicity(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rnd, 60).split(), i % 6 == 0
        for _ in range(3 * toxic):
            words[rnd.randrange(60)] = rnd.choice(["vile", "Rotten!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "w1 w2"), (1002, "w1 " * 50_000 + "vile rotten vile"), (0, rows[0][1])]
    known = spark.createDataFrame(labels + [(5, None), (None, 1), (9999, 1)], "doc_id LONG, toxic INT")
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, known)
    assert set(model.positive) == {"vile", "rotten"}
    got = toxicity.score(docs, model).collect()
    truth = dict(labels) | {1000: 0, 1001: 0, None: 0, 1002: 1}
    assert len(got) == len(rows) and all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i, _ in rows if not truth[i]}
    assert toxicity.fit(docs, known.where("toxic = 0")) is None and {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# 9
def test_sum_of_squares_follows_the_rule():
    rnd = random.Random(12)
    capacity = 20
    for _ in range(60):
        lengths = [rnd.randrange(1, capacity + 1) for _ in range(25)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), capacity)
        used = []
        for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
            def total(levels):
                gaps = [capacity - u for u in levels if 0 < u < capacity]
                return sum(gaps.count(g) ** 2 for g in set(gaps))
            choices = [total(used + [s])] + [total([u + s * (i == k) for i, u in enumerate(used)]) for k in range(len(used)) if used[k] + s <= capacity]
            if b == len(used):
                used.append(0)
            assert o == used[b] and o + s <= capacity
            used[b] += s
            assert total(used) == min(choices)


def test_pack(spark):
    rnd = random.Random(13)
    rows = [(i, prose(rnd, rnd.choice([0, 1, 30, 300, 3000]))) for i in range(40)] + [(None, None), (7, "again"), (7, "again")]
    packed = packing.pack(docs_of(spark, rows), with_ids=True).toPandas()
    library = load(token_counts.default_tokenizer())
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if i != 7 and i is not None}
    for r in packed.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length <= 4096
        if not math.isnan(r.doc_id) and r.doc_id != 7:
            assert list(r.ids) == whole[int(r.doc_id)][r.start : r.start + 4096]
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert packed.length.sum() == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert packing.pack(docs_of(spark, [])).count() == 0


# 10
def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    rnd = np.random.default_rng(14)
    vectors = [(i, (rnd.standard_normal(8) / 3).round(2).tolist()) for i in range(300)]
    vectors += [(300, vectors[0][1]), (301, vectors[0][1]), (302, None), (303, [1.0, None]), (304, [float("nan")]), (305, [float("inf")]), (306, [0.5]), (None, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors + vectors[:5]], "vec_id LONG, embedding ARRAY<FLOAT>, score INT")
    rows = [(i, v) for i, v in vectors + vectors[:5] if i is not None and i not in (302, 303, 304, 305)]
    usable = [(i, np.floor(256 * np.array(v + [0.0] * (8 - len(v)), dtype=np.float32).astype(float)).astype(int)) for i, v in rows]
    want = []
    for at, (q, query) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-int(query @ v), i) for other, (i, v) in enumerate(usable) if other != at)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 40  # vector 0 stands twice and asks twice
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0)
    assert few.count() == 10 and topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("largest", [1, 1000, 2**21])
def test_top_k_broadcasts_and_joins_nothing(spark, monkeypatch, largest):
    for name, value in {"BLOCK_ROWS": 20, "STRIPS": 3, "LANES": 2, "LANE_ROWS": 4}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    rnd = np.random.default_rng(15)
    rows = [(i % 280, (largest * rnd.uniform(-1, 1, 6)).tolist()) for i in range(300)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for at, (q, query) in enumerate(whole):
        if q % 10 == 0:
            best = sorted((-sum(map(int.__mul__, query, v)), i) for other, (i, v) in enumerate(whole) if other != at)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
    try:
        found = topk.top_k(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>"), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 150
        # queries copied for all blocks were once broadcast on the size of a single copy
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Broadcast" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_top_k_of_equal_ids_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.0]), (1, [3.0, 0.0]), (2, [2e6, 0.0]), (3, [-(2.0**24), 1.0]), (3, [2.0**25, 0.25]), (4, [0.1, -0.1])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for asked in (0, 2):
        query = next(v for i, v in whole if i == asked)
        best = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in whole if i != asked)[:5]
        got = topk.top_k(df, F.col("vec_id") == asked).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in best]
    one = topk.top_k(df.where("vec_id in (0, 2)"), F.col("vec_id") == 0).first()
    assert (one.vec_id, one.score) == (2, 256 * 512_000_000)
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id LONG, embedding ARRAY<DOUBLE>"), F.col("vec_id") == 0).collect()
