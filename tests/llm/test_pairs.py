"""N-gram Jaccard groups and line dedup against brute force."""

import random

import pytest
from codonlake.llm import line_dedup, ngram_join


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root, sets


def make(rng, n):
    out = []
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(n):
        if out and rng.random() < 0.7:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                if w:
                    w[rng.randrange(len(w))] = str(rng.random())
        else:
            w = [str(rng.randrange(400)) for _ in range(rng.choice([1, 2, 4, 12, 60, 150]))] + (passage.split() if rng.random() < 0.3 else [])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "task"), [(3, 90, 10**6), (5, 80, 400)])
def test_groups_match_brute_force(spark, k, percent, task):
    texts = make(random.Random(k), 140) + [None, "", " \t\n", "One two", "one TWO", "É a b c d", "é a b c d"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    want, sets = brute_groups(texts, k, percent)
    got = {r.id: r for r in ngram_join.near_groups(df, k=k, percent=percent, task_shingles=task).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_rows for i in range(len(texts))] == [want.count(want[i]) if sets[i] else 1 for i in range(len(texts))]
    kept = ngram_join.keep_first(df, k=k, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, r in enumerate(want) if r == i]
    assert kept.columns == df.columns


def test_repeats_null_ids_and_empty_tables(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "z y x w v u")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in ngram_join.near_groups(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3)], key=str)
    assert sorted((r.doc_id for r in ngram_join.keep_first(df).collect()), key=str) == sorted([1, None, 3], key=str)
    assert ngram_join.near_groups(df.limit(0)).count() == 0


def test_large_group_of_near_copies_takes_every_path(spark):
    rng = random.Random(9)
    base = [str(i) for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        w[rng.randrange(120)] = str(rng.random())
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i + 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.component_id for r in ngram_join.near_groups(df, k=5, percent=80, task_shingles=1000).collect()}
    assert got == {5}


def test_patience_blocks():
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6, 7]
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert line_dedup.common_lines(a, b, [6] * 7, line=20) == [1, 2, 4, 5]
    assert line_dedup.common_lines(a, b, [3, 3, 3, 3, 5, 3, 3], line=5) == [4] and set(line_dedup.common_lines(a, b, [6] * 7)) >= {1, 2, 4, 5}
    assert line_dedup.common_lines(a, b, [4] * 7) == []
    assert line_dedup.patience([], b) == [] and line_dedup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]


def test_line_dedup(spark):
    p, q = "one two three four five six seven eight nine ten eleven", "first second third fourth fifth sixth seventh eighth ninth tenth"
    rows = [(1, f"{p}\nown line here\n{q}"), (2, f"other start\n {p} \nmore"), (3, f"{p}\nown line here\n{q}"), (4, "short line\nanother"), (5, "short line"), (6, None), (7, ""), (None, p), (3, f"{p}\nown line here\n{q}")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone int")
    got = sorted(((r.doc_id, r.text, r.gone) for r in line_dedup.deduped(df).collect()), key=str)
    want = [(1, rows[0][1], 1), (2, "other start\nmore", 1), (3, "", 1), (3, "", 1), (4, rows[3][1], 1), (5, "short line", 1), (6, None, 1), (7, "", 1), (None, p, 1)]
    assert got == sorted(want, key=str)
    assert line_dedup.deduped(df.limit(0)).count() == 0


def test_line_dedup_finds_a_block_whose_lines_have_other_first_holders(spark):
    a, b, c = "alpha beta gamma delta epsilon", "one two three four five six", "uno due tre"
    texts = [f"{a}\nfirst own", f"{b}\nsecond own", f"start\n{a}\n{b}\n{c}\nend of third", f"other\n{a}\n{b}\nfourth", f"fifth\n{a}\n{b}\n{c}\nlast"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduped(df, line_words=7).collect()}
    assert got == {**dict(enumerate(texts, 1)), 4: "other\nfourth", 5: "fifth\nlast"}
    got = {r.doc_id: r.text for r in line_dedup.deduped(df).collect()}
    assert got == {**dict(enumerate(texts, 1)), 3: f"start\n{c}\nend of third", 4: "other\nfourth", 5: "fifth\nlast"}


def test_line_dedup_of_short_lines_and_unspaced_text(spark):
    verse = "\n".join(f"w{i} x{i} y{i} z{i}" for i in range(20))
    han = "今天天气很好我们一起去\n公园里散步看花听鸟唱歌"
    texts = [f"first\n{verse}", f"second\n{verse}", f"third\n{han}", f"fourth\n{han}", "fifth\n今天天气", "sixth\n今天天气"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in line_dedup.deduped(df).orderBy("doc_id").collect()]
    assert got == [texts[0], "second", texts[2], "fourth", *texts[4:]]


def test_line_dedup_matches_alignment_with_all_earlier_documents(spark):
    rng = random.Random(21)
    for round_ in range(3):
        # lines of a fixed order, so that common lines never cross
        lines = [" ".join(f"{round_}w{i}x{j}" for j in range(rng.randint(1, 9))) for i in range(40)]
        docs = []
        for d in range(25):
            at = sorted(rng.sample(range(40), 3))
            chosen = [lines[i] for i in range(40) if at[0] <= i < at[1] or rng.random() < 0.25 or i == at[2]]
            docs.append("\n".join(x for line in chosen for x in ([line, f"own {d} line"] if rng.random() < 0.05 else [line])))
        hashes, want = [[hash(x) for x in t.split("\n")] for t in docs], []
        for d, t in enumerate(docs):
            words = [len(x.split()) for x in t.split("\n")]
            gone = {i for e in range(d) for i in line_dedup.common_lines(hashes[e], hashes[d], words)}
            want.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        assert [r.text for r in line_dedup.deduped(df).orderBy("doc_id").collect()] == want
        assert want != docs


def test_line_dedup_of_copies_whose_lines_have_other_holders(spark):
    a, b = "one two three four five six", "uno due tre quattro cinque sei"
    df = spark.createDataFrame([(1, a), (4, b), *[(i, f"{a}\n{b}") for i in (5, 6, 7)]], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduped(df).collect()} == {1: a, 4: b, 5: "", 6: "", 7: ""}
    # lines that are no evidence alone go with a block that another document has
    assert {r.doc_id: r.text for r in line_dedup.deduped(df, line_words=7).collect()} == {1: a, 4: b, 5: f"{a}\n{b}", 6: "", 7: ""}


def test_groups_of_rows_without_ids_link_others(spark):
    base = [str(i) for i in range(60)]
    change = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    # 1 and 2 are too far apart, and only the text without id links them
    df = spark.createDataFrame([(1, change(10, 20)), (None, change(10)), (2, change(10, 30))], "doc_id long, text string")
    ids = {r.component_id for r in ngram_join.near_groups(df, k=3, percent=90).collect()}
    want, _ = brute_groups([change(10, 20), change(10), change(10, 30)], 3, 90)
    assert len(set(want)) == 1 and ids == {1}
