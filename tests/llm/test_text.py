"""Taggers, HTML extraction and piece encoding."""

import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from codonlake.llm import crf, html_pages, html_text, language, pieces, toxicity
from codonlake.llm.textarrays import Words


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    emit, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([1, 0, 0, 1, 0, 0, 0], bool)
    total, want = 0.0, np.zeros((7, 3))
    for y in itertools.product(range(3), repeat=7):
        w = np.exp(sum(emit[i, y[i]] + (start[y[i]] if first[i] else trans[y[i - 1], y[i]]) for i in range(7)))
        total += w
        for i in range(7):
            want[i, y[i]] += w
    for length in (1, 2, 3, 128):
        assert np.allclose(crf.marginals(emit, first, trans, start, length), want / total)
    assert crf.marginals(emit[:0], first[:0], trans, start).shape == (0, 3)


def test_words_of_texts():
    w = Words(["Ab c1é", "", "Ünï x"])
    assert [w.text(i) for i in range(len(w))] == ["ab", "c", "é", "ünï", "x"] and w.doc.tolist() == [0, 0, 0, 2, 2]


def corpus(rng, n):
    syl = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ösch", "ern", "ung", "ich"], "cc": ["que", "aux", "oir", "eau"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(syl))
        out.append((i, " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_language(spark):
    rows = corpus(random.Random(2), 400)
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None), (903, "kalo " * 6000, "aa"), (903, "kalo " * 6000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows[:400] if by[r[0]].held_out]
    assert held and sum(by[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert {r.lang_pred for r in language.report(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None)).collect()} <= {"und", ""}
    assert language.report(df.limit(0)).count() == 0


def test_language_learns_every_language(spark):
    rng = random.Random(12)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(sorted(words) * 4)]
    got = language.predict(df := spark.createDataFrame(rows, "doc_id long, text string, lang string"), df).collect()
    assert {r.lang_pred for r in got} == set(words)
    assert sum(r.lang_pred == rows[r.id][2] for r in got) / len(rows) > 0.9


def test_toxicity_catches_planted_words_and_keeps_clean_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i, t, _ in corpus(rng, 500):
        bad = rng.random() < 0.25
        w = t.split()
        if bad:
            w[rng.randrange(len(w))] = "grumblefool" + rng.choice(["", "s", "ish", "er"])
        rows.append((i, " ".join(w)))
        if i % 5 < 4:
            labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "mi lo"), (902, "mi lo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    want = {i: int("grumble" in t) for i, t in rows[:500]}
    assert np.mean([by[i].predicted == y for i, y in want.items() if by[i].held_out]) > 0.95
    kept = {r.doc_id for r in toxicity.keep_clean(docs, lab).collect()}
    assert {900, 901, 902} <= kept
    assert {r.score for r in toxicity.report(docs, lab.limit(0)).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), lab).count() == 0


def test_spans():
    sample = [(int(i % 3 == 0), f"lo mi tu {'zzbad' if i % 3 == 0 else 'ka'} mi lo ka tu " * 3 + f"w{i}") for i in range(150)]
    fitted = toxicity.fit([(y, t.replace(f"w{i}", "q" * (i % 7 + 1))) for i, (y, t) in enumerate(sample)])
    if fitted is not None:
        assert toxicity.spans("lo mi zzbad tu", fitted) in ([(6, 11)], [])
    assert toxicity.fit([(1, "a")]) is None and toxicity.fit([]) is None


def test_html():
    trees = html_text.fit(300)
    page = """<html><head><title>T</title><script>"<p>no</p>"</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>
    <article><h1>The &eacute;  title &amp; more</h1><p><b>First paragraph, with <i>markup</i> and text that goes on.<br><p>Second   one,
    over lines. It has several sentences, like prose.</p><div class="ad">Buy this now</div></article><!-- x --><footer>&copy; host</footer>"""
    assert html_text.extract([page], trees) == ["The é title & more\nFirst paragraph, with markup and text that goes on.\nSecond one, over lines. It has several sentences, like prose."]
    assert html_text.extract(["", "plain &lt;text"], trees) == ["", "plain <text"]
    wrong = 0
    for k in range(60):
        p = html_text.Page(html_pages.Writer(70_000 + k).page())
        kept, gold = html_text.decode(p.parent, trees.logits(html_text.features(p))), html_text.labels(p)
        assert all(kept[q] for i, q in enumerate(p.parent) if kept[i] and i)
        wrong += any(kept[i] != gold[i] for i, _ in p.texts)
    assert wrong <= 12


def test_decode_is_the_best_consistent_choice():
    rng = np.random.default_rng(5)
    for _ in range(20):
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, 8)]
        z = rng.normal(size=8) * 2
        value = lambda keep: sum(-np.log1p(np.exp(-z[i])) if keep[i] else -np.log1p(np.exp(z[i])) for i in range(1, 8))  # noqa: B023, E731
        best = max(value((True, *k)) for k in itertools.product([False, True], repeat=7) if all(not k[i - 1] or parent[i] == 0 or k[parent[i] - 1] for i in range(1, 8)))
        assert np.isclose(value(html_text.decode(parent, z)), best)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "v", "<p>"), (2, "v", "<p>")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extracted(df, fit_pages=60).collect()] == [("", 0)] * 3


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return pieces.Model(f.read())


TEXTS = ["", " ", "  a  b ", "a\n\n b\tc", "日本語 テキスト 🎉 x", "x" * 700, "hello   world\r\n", "3.14 + 15", "é" * 300 + " " + "ab" * 400, "<s> </s> <0x0A>", "The quick brown fox"]


def test_pieces_match_the_library_and_round_trip(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("abc eé\n.,XY") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [x.tolist() for x in model.encode(texts)] == lib.encode(texts, num_threads=1)
    assert [model.decode(x) for x in model.encode(texts)] == texts


def test_viterbi_matches_brute_force(model):
    words = ["▁the", "▁other", "abcab", "▁日x"]
    for w in words:
        codes = np.frombuffer(w.encode("utf-32-le"), np.uint32)[None]
        ends = model.viterbi(model.spans(codes))[0]
        worst = model.score[model.kind == pieces.NORMAL].min() - 10

        def cost(cuts, w=w):
            return sum(model.score[model.id_of[w[a:b]]] if w[a:b] in model.id_of else worst if b - a == 1 else -1e18 for a, b in zip(cuts, cuts[1:]))

        best = max(cost((0, *c, len(w))) for n in range(len(w)) for c in itertools.combinations(range(1, len(w)), n))
        cuts = [i for i, e in enumerate(ends) if e] + [len(w)]
        assert np.isclose(cost(cuts), best)


def test_token_frame(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "a b", 3), (3, "a b", 3)], "doc_id long, text string, n_tokens int")
    out = pieces.tokenised(df).orderBy("doc_id")
    got = out.collect()
    assert out.columns == [*df.columns, "token_ids", "n_tokens_", "round_trip"]
    assert [(r.n_tokens_ > 0, r.round_trip) for r in got] == [(False, True), (False, True), (True, True), (True, True)]
    assert [r.decoded_text for r in pieces.detokenised(out).orderBy("doc_id").collect()] == ["", "", "a b", "a b"]


def plain_marginals(emit, trans, start):
    """One text's posterior, word by word."""
    n, s = emit.shape
    e, t, b = np.exp(emit), np.exp(trans), np.exp(start)
    ahead, after = [b * e[0]], [np.ones(s)]
    for i in range(1, n):
        ahead.append(np.array([sum(ahead[-1][p] * t[p, q] for p in range(s)) * e[i, q] for q in range(s)]))
    for i in range(n - 1, 0, -1):
        after.append(np.array([sum(t[p, q] * e[i, q] * after[-1][q] for q in range(s)) for p in range(s)]))
    out = np.array(ahead) * np.array(after[::-1])
    return out / out.sum(1, keepdims=True)


def plain_emissions(words, model):
    """Sum of the weights of each word's features, looked up one by one."""
    f = model.features(words)
    ends = [*f.first[1:], len(f.letter)]
    return np.array([sum(model.table[k] for k in row) + 2.0 * np.mean(model.table[f.letter[a:b]], axis=0) for row, a, b in zip(f.fixed, f.first, ends, strict=True)], float)


def test_scores_match_a_plain_field():
    rng = random.Random(14)
    rows = corpus(rng, 150)
    langs, model = language.fit([(x, t) for _, t, x in rows], sequences=200)
    texts = [t for _, t, _ in rows[:25]] + ["kalo ösch que", "", "12"]
    best, p = language.score(texts, langs, model)
    for t, k, score in zip(texts, best, p, strict=True):
        w = Words([t])
        mean = plain_marginals(plain_emissions(w, model), model.trans, model.start).mean(0) if len(w) else None
        assert (k, score) == (-1, 0.0) if mean is None else k == mean.argmax() and np.isclose(score, mean.max(), atol=1e-5)
    sample = [(int(i % 3 == 0), t + (" grumblefool" if i % 3 == 0 else "") + " " + t[::-1]) for i, t, _ in rows]
    fitted = toxicity.fit(sample, runs=(300, 600))
    assert fitted is not None
    model, weights = fitted
    for t, score in zip(texts, toxicity.score(texts, fitted), strict=True):
        w = Words([t])
        hot = plain_marginals(plain_emissions(w, model), model.trans, model.start)[:, 1] if len(w) else np.zeros(0)
        z = weights @ [1.0, np.log1p(hot.sum()), hot.max(initial=0.0), hot.mean() if len(hot) else 0.0]
        assert np.isclose(score, 1 / (1 + np.exp(-z)), atol=1e-5)


def test_toxicity_learns_from_short_texts():
    sample = [(int(i % 4 == 0), f"{a} {b} {'grumble' if i % 4 == 0 else 'kind'} {c}") for i, (a, b, c) in enumerate(itertools.product("lo mi ka tu ve".split(), "ra se ti".split(), "mo nu pa qe ri su ta".split()))]
    fitted = toxicity.fit(sample * 2)
    assert fitted is not None and (toxicity.score(["lo grumble ra", "lo kind ra"], fitted) >= 0.5).tolist() == [True, False]


def test_letters_of_the_third_plane():
    assert [Words([chr(0x30123)]).text(0), len(Words([chr(0x1F389)]))] == [chr(0x30123), 0]


class Walk(HTMLParser):
    """All text of a page, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.raw.append(tag)

    def handle_endtag(self, tag):
        if self.raw and self.raw[-1] == tag:
            self.raw.pop()

    def handle_data(self, data):
        if not self.raw:
            self.out.append(data)


def test_pages_hold_all_text_that_a_plain_walk_finds():
    for k in range(40):
        source = html_pages.Writer(90_000 + k).page()
        walk = Walk()
        walk.feed(source)
        walk.close()
        assert "".join("".join(t for _, t in html_text.Page(source).texts).split()) == "".join("".join(walk.out).split())


def test_extraction_matches_a_plain_walk_over_the_kept_elements():
    trees = html_text.fit(60)
    for k in range(20):
        source = html_pages.Writer(91_000 + k).page()
        page = html_text.Page(source)
        z = trees.logits(html_text.features(page))

        def best(i):  # log-likelihood of the subtree where i is kept and where it is dropped, and the kept elements
            below = [best(j) for j in range(len(page.tag)) if page.parent[j] == i]  # noqa: B023
            keep, drop, kept = -np.log1p(np.exp(-z[i])), -np.log1p(np.exp(z[i])), {i}  # noqa: B023
            for a, b, own in below:
                keep += max(a, b)
                kept |= own if a >= b else set()
                drop += b
            return keep, drop, kept

        kept = best(0)[2]
        assert html_text.extract([source], trees) == ["\n".join(t for j, t in page.texts if j in kept)]


def test_inner_text_of_formulas_and_objects_stays():
    page = html_text.Page("<article><p>The formula <math><mi>x</mi></math> is shown, and <object>fallback words</object> follow <svg><text>drawn</text></svg>.</p><script>if (a<b) { '</p>' }</script><textarea>typed</textarea></article>")
    assert [t for _, t in page.texts] == ["The formula x is shown, and fallback words follow drawn."]


def test_markup_is_read_in_linear_time():
    began = time.time()
    for hostile in ('<a "', "<a '\"", '<a ">"', "<", "<!--", "<a>", "</a b='", "<p <p "):
        html_text.Page(hostile * 60_000)
    assert time.time() - began < 60
    assert [t for _, t in html_text.Page('a <b c="x > y">d</b> 1 < 2 <a "e').texts] == ['a d 1 < 2 <a "e']


def test_viterbi_is_never_worse_than_the_library(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    data = open(pieces.default_model(), "rb").read()
    at, out = 0, b""
    while at < len(data):  # the same file, with the kind of model set to unigram
        (number, _), size = next(iter(pieces._fields(data[at:]))), message_size(data, at)
        part = data[at : at + size]
        out += part if number != 2 else b""
        at += size
    lib = sentencepiece.SentencePieceProcessor(model_proto=out + b"\x12\x05\x18\x01\x98\x02\x01")
    mine = pieces.Model(data, viterbi=True)
    rng = random.Random(16)
    texts = ["the quick brown fox", "Hello world, this is text.", "naïve café", *[" ".join(rng.choice(["other", "words", "and", "thing", "overs", "unlike"]) for _ in range(9)) for _ in range(30)]]
    score = lambda ids: sum(mine.score[i] for i in ids)
    for t, a, b in zip(texts, mine.encode(texts), lib.encode(texts, num_threads=1), strict=True):
        assert score(a) >= score(b) - 1e-6 * abs(score(b)) and mine.decode(a) == lib.decode(b) == t


def message_size(data, at):
    """Bytes of one field of a protocol-buffer message."""
    i = at
    while data[i] & 128:
        i += 1
    i, size, shift = i + 1, 0, 0
    while True:
        size |= (data[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if not data[i - 1] & 128:
            return i + size - at
