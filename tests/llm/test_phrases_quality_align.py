"""Phrase mining, quality rules and token alignment against brute force on small tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from domsift.llm import align, phrases, quality

DOCS = "doc_id long, text string, lang string, `_w` string, n string, `_lines` string, `block` int, words int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", 7, 8) for i, t, lang in rows], DOCS)


# -- phrases ------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = {
        (lang, x[i : i + k])
        for (lang, x), a in found.items()
        for k in range(2, len(x))
        for i in range(len(x) - k + 1)
        if a >= f[lang, x[i : i + k]]
    }
    by_lang = {}
    for (lang, x), a in found.items():
        if (lang, x) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, x[:k]] * f[lang, x[k:]]), k) for k in range(1, len(x))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(x).encode(), f[lang, x[:k]], f[lang, x[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, listed in by_lang.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1)
    )


def phrase_rows(seed, n=60):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "É", "é", "net\xa0work", "\x00", "a-b", "ﬁ", "x" * 300, "和"]
    between = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "]
    rows = [(draw.choice(["en", "fr", None, "und", ""]), "".join(draw.choice(vocabulary) + draw.choice(between) for _ in range(draw.randrange(60)))) for _ in range(n)]
    rows += [("en", None), (None, ""), ("fr", " .,\t "), ("en", "the of " * 4000)]  # nulls, empty, a long text of one pair
    return rows + rows[:9]


@pytest.mark.parametrize("buckets, group", [(1 << 16, 1_000_000), (8, 40), (1, 1)])
def test_phrases_equal_brute_force_however_routed(spark, buckets, group):
    rows = phrase_rows(3)
    df = docs(spark, [(i // 2, t, lang) for i, (lang, t) in enumerate(rows)]).repartition(5)
    for least, top in ((3, 2000), (6, 4)):
        got = phrases.collocations(df, top=top, least=least, buckets=buckets, group=group)
        assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


def test_chunks_do_not_change_counts(monkeypatch):
    rows = phrase_rows(5, 30)
    batch = pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])

    def counted():
        sums = Counter()
        for words in phrases._chunks(iter([batch])):
            for row in words.counts().to_pylist():
                sums[row["lang"], row["word"]] += row["n"]
        return sums

    whole = counted()
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    assert whole == counted() and whole["en", "of"] >= 4000


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs(spark, [])).collect() == []
    assert phrases.collocations(docs(spark, [(1, "only once here", "en")])).collect() == []


def test_products_beyond_64_bits(spark):
    a = 4_000_000_000_000
    score = spark.range(1).select(F.expr(f"(1000BD * cast({a}L as decimal(19,0)) * cast({9 * a}L as decimal(19,0))) div (cast({a}L as decimal(19,0)) * cast({a + 1}L as decimal(19,0)))"))
    assert score.first()[0] == 1000 * a * 9 * a // (a * (a + 1))


def test_sort_keeps_parts_of_hot_leading_words(spark):
    columns = np.array([[0] * 6, [1, 1, 1, 1, 2, 2], [3, 3, 4, -1, 3, 3]], dtype=np.int32)
    found = {tuple(k.tolist()): n for k, n in phrases.sort_suffixes(columns, np.array([5, 1, 2, 1, 1, 1]), 3, 2)}
    assert found == {(0, 1, 3): 6}
    partial = {tuple(k.tolist()): n for k, n in phrases.sort_suffixes(columns, np.array([5, 1, 2, 1, 1, 1]), 3, 3)}
    assert partial == {(0, 1, 3): 6, (0, 1, 4): 2, (0, 2, 3): 2}


# -- quality rules ------------------------------------------------------------------------------------------

SPACE = "[\x20\x09-\x0d]"


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(SPACE + "+", text) if w]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    left = 0
    for line in dict.fromkeys(lines):
        w = [x for x in re.split(SPACE + "+", line) if x]
        n = len(w)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        fails = (
            not re.search(quality.CLOSED.replace(r"\z", r"\Z"), line[-12:].rstrip("\x20\x09\x0b\x0c\x0d"))
            or 10 * len(re.findall(quality.MARKS, line)) > 3 * n
            or (sum(c in "|»›•·→" for c in line) >= 2 and 4 * sum(c in "|»›•·→" for c in line) >= n)
            or (n <= 30 and any(p in low for p in quality.PHRASES))
            or 10 * sum(a == b for a, b in itertools.pairwise(w)) > 3 * n
        )
        left += 0 if fails else sum(map(len, w))
    chars = sum(map(len, words))
    base_failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        base_failed, not base_failed and 100 * (chars - left) <= 50 * chars,
    )


def quality_texts():
    draw = random.Random(11)
    vocabulary = ["word", "Wort", "é\xa0x", "a|b", "##", "net!!", "$$$", "100%", "…", "\x00", "和", "w"]
    ends = [".", "!", "?”", "", " \t", ".\r", ".)", " | Home | About | Contact"]
    texts = []
    for _ in range(150):
        lines = [" ".join(draw.choice(vocabulary[: draw.randrange(1, 12)]) + draw.choice(["", str(draw.randrange(9))]) for _ in range(draw.randrange(40))) + draw.choice(ends) for _ in range(draw.randrange(1, 8))]
        texts.append(draw.choice(["\n", "\n\n", "\r\n", "\n \t\n"]).join(lines + lines[: draw.randrange(3)]))
    article = " ".join(f"sentence{i} has its own words." for i in range(30))
    texts += [None, "", " \n\t\x0b", "one", "\n" * 50, article, article + "\nAll Rights Reserved.", article + "\n" + article, "x " * 5000, " ".join(f"w{i}" for i in range(60_000)) + "."]
    return texts


def test_quality_equals_brute_force(spark):
    texts = quality_texts()
    df = docs(spark, [(None if i % 7 == 0 else i // 2, t, str(i)) for i, t in enumerate(texts)])
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.judge(df).select("doc_id", *columns).collect()
    want = [(None if i % 7 == 0 else i // 2, *brute_quality(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in got) > 3 and sum(not r.kept and not r.base_failed for r in got) > 3
    assert quality.judge(docs(spark, [])).collect() == []


def test_quality_removes_lines_and_keeps_the_rest(spark):
    body = "This first line tells of one thing in some ten words.\nAnother line goes on with other things, and it ends here."
    text = f"Home | About | Contact us | Help\n{body}\nsubscribe to our letter.\n{body}\nBUY!! NOW!! CHEAP!! DEALS!!\nno closing mark"
    row = quality.judge(docs(spark, [(1, text, "en")])).first()
    assert row.cleaned == body
    assert (row.n_punctuation, row.n_navigation, row.n_boilerplate, row.n_dup_lines) == (3, 0, 1, 2)


def test_quality_is_native(spark):
    plan = quality.judge(docs(spark, [(1, "a", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_many_lines_stay_linear(spark):
    text = "\n".join(f"line number {i}." for i in range(100_000))
    assert quality.judge(docs(spark, [(1, text, "en")])).first().n_words == 300_000


# -- token alignment ----------------------------------------------------------------------------------------

HARD = [
    None, "", " ", "a", "  two  spaces ", "中文字符很多的一句话", "naïve café — “quoted” text…", "x\ty\nz\r\n", "▁under", "　wide",
    "emoji 👩‍👩‍👧 ok", "<|endoftext|> </s> <s> <unk> <0x41>", " lead", "ﬁ ligature", "é comb", "\x00nul", "a" * 5000,
    "中" * 3000, " " * 3000, "don't we'll I'M", "1234567 12.5%", "\x85nel\xa0nb", "the of " * 3000,
]


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(*align.default_tokenizers())


def brute_alignment(aligner, text):
    text = text or ""
    a = aligner.a.library.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.library.encode(text)
    a_bytes, b_bytes = [aligner.a.bytes_of[i] for i in a], [aligner.b.bytes_of[i] for i in b]
    if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {b" " + text.encode()}:
        return 0, 0, 0, "", Counter()
    a_end, b_end = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
    cut, begin = [], 0
    for end in sorted(set(a_end) & set(b_end)):
        cut.append(([i for i, e in zip(a, a_end) if begin < e <= end], [i for i, e in zip(b, b_end) if begin < e <= end]))
        begin = end
    digest = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in cut)
    return len(a), len(b), len(cut), hashlib.sha256(digest.encode()).hexdigest(), Counter((i, j) for g, h in cut for i in g for j in h)


def test_alignment_equals_brute_force(spark, aligner):
    draw = random.Random(2)
    letters = "ab cdé中 \n.,'’0ﬁ́😀"
    texts = [*HARD, *("".join(draw.choices(letters, k=draw.randrange(1, 60))) for _ in range(150)), "the cat sat.", "the cat sat."]
    rows = [(None if i % 9 == 0 else i // 2, t, "en") for i, t in enumerate(texts)]
    each = [brute_alignment(aligner, t) for t in texts]
    held = Counter(pair for *_, links in each for pair in links)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    want = [
        (i, n_a, n_b, n_groups, links.total(), sum(k for (a, b), k in links.items() if held[a, b] == most[a]), sum(k * held[p] for p, k in links.items()), digest)
        for (i, _, _), (n_a, n_b, n_groups, digest, links) in zip(rows, each)
    ]
    got = align.alignments(docs(spark, rows).repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_nothing(spark):
    assert align.alignments(docs(spark, [])).collect() == []
    assert [tuple(r) for r in align.alignments(docs(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_blocks_do_not_change_a_text(aligner):
    texts = [f"word{i % 50} und Wörter {i}" for i in range(300)]
    whole, single = aligner.block(texts), [aligner.block([t]) for t in texts]
    for i, alone in enumerate(single):
        assert [c[i] for c in whole[:5]] == [c[0] for c in alone[:5]]
        pairs = [{int(b[7][k]): int(n) for k, n in zip(np.frombuffer(b[5][j], "<u4"), np.frombuffer(b[6][j], "<u4"))} for b, j in ((whole, i), (alone, 0))]
        assert pairs[0] == pairs[1]
    assert sum(whole[8]) == sum(sum(b[8]) for b in single)


def test_quick_encoder_cuts_like_the_library(aligner):
    """Every character that takes the quick encoder, alone and beside letters, digits, marks and blanks."""
    usual = [chr(c) for c in range(0x3000) if not align._UNUSUAL.search(chr(c))]
    texts = [f"a{c}b {c}1{c} {c}{c} .{c} '{c}s  {c}\n{c}" for c in usual]
    draw = random.Random(4)
    texts += ["".join(draw.choices(usual, k=40)) for _ in range(3000)]
    assert aligner.a.quick is not None
    assert [aligner.a.quick.encode_ordinary(t) for t in texts] == [e.ids for e in aligner.a.library.encode_batch(texts, add_special_tokens=False)]
