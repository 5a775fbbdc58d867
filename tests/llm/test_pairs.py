"""Joins, searches and dedup against brute force on small tables with planted copies."""

from __future__ import annotations

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import _graph, _store, ann, line_dedup, ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, size string, component string"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    parent = {d: d for d in sets}
    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(parent, d)) for d in sets}


def copies_corpus(seed=7):
    """Originals, exact copies, chains of small edits, a large near-copy group and shared boilerplate."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, boiler = [], text(30)
    for _ in range(30):
        w = text(draw.randint(1, 120))
        rows.append(w)
        for _ in range(draw.randint(0, 3)):
            w = list(w)
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
            rows.append(w)
    base = text(60)
    for i in range(40):
        w = list(base)
        w[i] = draw.choice(vocabulary)
        rows.append(w if i % 4 else list(base))
    rows += [[*boiler, *text(3)] for _ in range(20)]
    out = [(i, " ".join(w).upper() if i % 9 == 0 else "\n".join(w)) for i, w in enumerate(rows)]
    n = len(out)
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "One"), (n + 5, "a b"), (n + 6, "b a")]


@pytest.mark.parametrize(("n", "num", "den", "frequent"), [(3, 90, 100, None), (3, 90, 100, 20), (5, 80, 100, 2), (1, 50, 100, 14)])
def test_join(spark, monkeypatch, n, num, den, frequent):
    rows = copies_corpus()
    if frequent is not None:  # makes the token combinations work on a small table
        whole = ngram_join.profile
        monkeypatch.setattr(ngram_join, "profile", lambda *a: (*whole(*a)[:2], frequent))
    docs = spark.createDataFrame([(d, t, "s", "c") for d, t in rows], DOCS)
    got = {r.doc_id: (r["size"], r.component_id) for r in ngram_join.components(docs, n, num, den).collect()}
    assert got == brute_components(rows, n, num, den)


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c", "s", "c"), (None, None, "s", "c"), (3, "a b c", "s", "c"), (3, "a b c", "s", "c")], DOCS)
    got = sorted((r["size"], r.component_id) for r in ngram_join.components(docs, 3).where("size > 0").collect())
    assert got == [(1, 3)] * 3
    assert ngram_join.components(docs.limit(0), 3).count() == 0


def test_join_of_near_rows_without_an_id(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (None, " ".join([*w, "x", "y", "z"])), (9, " ".join([*w, *"xyzuvw"]))]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 95, 100).collect()
    assert [r.component_id for r in got] == [1, 1, 1]


@pytest.mark.parametrize(("num", "den"), [(1, 2), (9, 10)])
def test_sets_of_all_sizes_share_a_bucket_with_their_partners(num, den):
    """Whatever tokens count as frequent: every pair that links has an index entry in common."""
    draw = np.random.default_rng(17)
    for frequent in (0, 1, 30, 255):
        sets = []
        for size in (1, 1, 2, 3, 5, 9, 16, 30, 64, 150, 700):
            base = draw.integers(0, 2**63, size, dtype=np.uint64)
            for gone in (0, 1, size // 30, size // 11, size // 3):
                sets.append(np.unique(np.concatenate([base[gone:], draw.integers(0, 2**63, gone // 2, dtype=np.uint64)])))
        h, ptr = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        classes = draw.integers(0, 90, ngram_join.SKETCH).astype(np.uint8)
        bucket, row = ngram_join.index_rows(h, ptr, classes, frequent, num, den)
        of = [set(bucket[row == r].tolist()) for r in range(len(sets))]
        met = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                common = len(np.intersect1d(a, b))
                if len(a) and len(b) and den * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                    met += 1
                    assert of[i] & of[j], (frequent, len(a), len(b), common)
        assert met > 10


def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(40)]
    parent = {x: x for pair in links for x in pair}
    for a, b in links:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(parent, x) for pair in links for x in pair if pair[0] != pair[1]}
    got = _graph.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == want
    assert _graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tiles", [(8, 16), (1000, 1000)])
def test_search(spark, tiles):
    draw = np.random.default_rng(6)
    x = draw.standard_normal((150, 12)).astype(np.float32)
    x[40:80] = x[40]  # one common vector
    x[3] = x[5]
    rows = [(i, v.tolist(), 1, "r") for i, v in enumerate(x)]
    bad = [(200, None, 1, "r"), (210, [0.0] * 12, 1, "r"), (220, [float("nan")] * 12, 1, "r"), (230, [1.0, None] + [0.0] * 10, 1, "r"), (240, [], 1, "r"), (None, [1.0] * 12, 1, "r"), (250, [1.0] * 3, 1, "r")]
    df = spark.createDataFrame(rows + rows[:4] + bad, "vec_id long, embedding array<float>, dim int, rank string")
    got = ann.search(df, F.col("vec_id") % 10 == 0, 7, query_tile=tiles[0], candidate_tile=tiles[1]).collect()
    want = {w[:3]: w[3] for w in ann.brute_force(np.arange(150), x, range(0, 150, 10), 7)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == set(want)
    assert all(abs(r.score - want[r.query_id, r["rank"], r.vec_id]) < 1e-12 for r in got)
    few = ann.search(df.where("vec_id < 5"), F.lit(True), 20).collect()
    assert len(few) == 20 and ann.search(df.limit(0), F.lit(True), 3).count() == 0


def sentence(draw, n=20):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(5, 9))) for _ in range(n))


def test_lines(spark):
    draw = random.Random(8)
    shared, near = sentence(draw), sentence(draw, 60)
    edited = near.replace(near.split()[30], near.split()[30][:-1] + "x")
    own = [sentence(draw) for _ in range(6)]
    rows = [
        (5, f"{own[0]}\n{shared}\n\nyes", "k", "h"), (2, f"{shared.upper()}!\n{own[1]}\n{shared}\nyes", "k", "h"), (7, near, "k", "h"), (6, f"{edited}\n{own[2]}", "k", "h"),
        (8, None, "k", "h"), (9, "", "k", "h"), (None, f"{shared}\n{own[3]}", "k", "h"), (2, f"{own[4]}\n{shared}", "k", "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string, h string")
    got = {(r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()}
    # Of the two documents of id 2 the one of smaller text hash keeps the line.
    kept = {(2, f"{shared.upper()}!\n{own[1]}\nyes"), (2, f"{own[4]}")} <= got or {(2, f"{own[1]}\nyes"), (2, f"{own[4]}\n{shared}")} <= got
    assert kept
    # The repeated "yes" goes too; blank lines stay.
    assert {(5, f"{own[0]}\n"), (6, f"{edited}\n{own[2]}"), (7, ""), (8, None), (9, ""), (None, own[3])} <= got
    assert line_dedup.dedup(docs).columns == ["doc_id", "text", "k", "h", "__lines", "__removed"]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def removed_lines(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id for r in line_dedup.dedup(docs).collect() if r["__removed"]}


def edited_lines(draw, words, changes, typo, pairs=60):
    """Pairs of a line and its copy with some words replaced, or with a typing error in some words."""
    lines = []
    for _ in range(pairs):
        w = sentence(draw, words).split()
        v = list(w)
        for i in draw.sample(range(words), changes):
            v[i] = v[i][:-1] + "x" if typo else sentence(draw, 1)
        lines += [" ".join(w), " ".join(v)]
    return lines


def similarity(a, b):
    return 1 - duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] / max(len(a), len(b))


def test_recall_of_near_lines(spark):
    """Of the pairs at edit similarity 0.8 or more, brute force, nine in ten or more are found in every kind of line; no others are."""
    kinds = {"typo of 15": (15, 1, True), "word of 15": (15, 1, False), "two of 15": (15, 2, False), "word of 40": (40, 1, False), "six of 60": (60, 6, False), "typo of 6": (6, 1, True), "word of 6": (6, 1, False), "thirteen of 30": (30, 13, False), "six of 120": (120, 6, False), "twelve of 250": (250, 12, False)}
    draw = random.Random(15)
    made = {kind: edited_lines(draw, *how) for kind, how in kinds.items()}
    removed = removed_lines(spark, [line for lines in made.values() for line in lines])
    at = 0
    for kind, lines in made.items():
        near = {at + i + 1 for i in range(0, len(lines), 2) if similarity(lines[i], lines[i + 1]) >= 0.8 - 1e-9}
        got = removed & set(range(at, at + len(lines)))
        assert got <= near, kind
        assert len(got) >= 0.9 * len(near), (kind, len(got), len(near))
        at += len(lines)


def test_long_lines_go_by_edit_similarity(spark):
    draw = random.Random(16)
    w = sentence(draw, 400).split()
    swapped = [x for pair in zip(w[1::2], w[::2]) for x in pair]  # the same words, but many edits
    typo = [*w[:200], w[200][:-1] + "x", *w[201:]]
    assert removed_lines(spark, [" ".join(w), " ".join(swapped), " ".join(typo)]) == {2}


def test_a_line_that_repeats_a_word(spark):
    draw = random.Random(17)
    w = ["again"] * 3000 + sentence(draw, 60).split()
    assert removed_lines(spark, [" ".join(w), " ".join([*w[:-1], "other"]), "* * *", "* * *", "- -"]) == {1, 3}


def test_lines_with_one_changed_word(spark):
    draw = random.Random(12)
    lines = []
    for _ in range(40):
        w = sentence(draw, 20).split()
        changed = list(w)
        changed[draw.randrange(20)] = sentence(draw, 1)
        lines += [" ".join(w), " ".join(changed)]
    assert removed_lines(spark, lines) == set(range(1, 80, 2))


def test_short_lines_with_a_change(spark):
    draw = random.Random(13)
    lines = []
    for _ in range(20):
        w = sentence(draw, 5).split()
        typo = " ".join(w)
        lines += [typo, typo[:-1] + "x", " ".join([*w[:2], w[2][:-1] + "z", *w[3:]])]
    assert removed_lines(spark, lines) == {i for i in range(60) if i % 3}


def test_lines_of_the_same_words_in_other_orders(spark):
    draw = random.Random(14)
    w = sentence(draw, 24).split()
    lines = []
    for _ in range(6):
        draw.shuffle(w)
        lines += [" ".join(["on", *w]), " ".join(["at", *w])]
    assert removed_lines(spark, lines) == set(range(1, 12, 2))


def test_lines_of_a_large_group(spark):
    draw = random.Random(9)
    base = sentence(draw, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[i] = f"edited{i}"
        rows.append((i, " ".join(w)))
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(r["__removed"]) for r in got) >= 50 and not next(r for r in got if r.doc_id == 0)["__removed"]


def test_frequent_words_alone_bring_no_lines_together(spark, monkeypatch):
    """Neither repeats of a word, nor two words in short lines, leave a pair of lines to compare later."""
    draw = random.Random(18)
    lines = []
    for i in range(60):
        w = [f"w{i}x{k}" for k in range(36)] + ["the", "of", "and", "to"] * 4
        draw.shuffle(w)
        lines += [" ".join(w), " ".join(["the", "of", "and", *(sentence(draw, 1) for _ in range(5))])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    pairs = []

    def counted(df, **options):
        out = _store.materialize(df, **options)
        if df.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    assert line_dedup.removals(docs).count() == 0
    assert len(pairs) >= 2 and sum(pairs) <= 6, pairs


def test_word_edits_bound_the_edit_distance(spark):
    draw = random.Random(19)
    w = sentence(draw, 60).split()
    near = [[*w[:9], "x", *w[10:]], [*w[:20], "more", *w[20:40], "y", *w[41:]], w[:30] + w[32:]]
    rows = [(" ".join(w), " ".join(v)) for v in [*near, w, sentence(draw, 60).split(), w[::-1], w[:3]]]
    words = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", "split(x, ' ') as u", "split(y, ' ') as v")
    got = words.selectExpr(f"{line_dedup._edits('u', 'v')} as most", "levenshtein(x, y) as real", f"{line_dedup._most('x', 'y')} as allowed").collect()
    assert all(r.most >= r.real for r in got)
    assert all(r.most <= r.allowed for r in got[:4])


def test_pieces_bound_the_edit_distance(spark):
    """Lines with words put in and left out at many places are seen to be near without a distance of the whole lines."""
    draw = random.Random(20)
    lines = []
    for n in (40, 90, 400):
        w = sentence(draw, n).split()
        v = [x for i, x in enumerate(w) if i % 19 != 5]
        more = [y for i, x in enumerate(w) for y in ([x, "put"] if i % 9 == 3 else [x])]
        lines += [(w, v), (w, more), (w, w)]
    w = sentence(draw, 60).split()
    far = [(w, sentence(draw, 60).split()), (w, w[::-1]), (w, w[30:] + w[:30]), (w, ["", "", *w[:40]]), (w[:3], w[:4]), (["ä ö ü"] * 9, ["ä ö ü"] * 12)]
    rows = [(" ".join(u), " ".join(v)) for u, v in [*lines, *far]]
    words = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", "split(x, ' ') as u", "split(y, ' ') as v")
    got = words.select(F.expr(f"{line_dedup._cut('x', 'u', 'y')} as most"), F.expr(f"{line_dedup._edits('u', 'v')} as plain"), F.expr("levenshtein(x, y) as real"), F.expr(f"{line_dedup._most('x', 'y')} as allowed"), line_dedup._near("x", "y").alias("near")).collect()
    assert all(r.most >= r.real for r in got)
    assert all(r.most <= r.allowed for r in got[:9]) and any(r.plain > r.allowed for r in got[:9])
    # Beginnings reject no pair that is near.
    assert all(r.near == (r.real <= r.allowed) for r in got)


def test_long_stretches_and_common_ends(spark):
    """One long stretch put in is seen to be near from pieces alone, and common ends change no decision."""
    draw = random.Random(23)
    w = sentence(draw, 400).split()
    put = [*w[:200], *sentence(draw, 25).split(), *w[200:]]
    a, b = sentence(draw, 40), sentence(draw, 40)
    others = [(a, b), (f"{a} {b} {a}", f"{a} {b[::-1]} {a}"), (a, a), ("", a), (f"{a} {b}", f"{b} {a}"), (f"ä {a} ö", f"ä {a[9:]} ö"), ("aaaa", "aaaaa"), ("abab", "ab")]
    rows = [(" ".join(w), " ".join(put)), *others, *((y, x) for x, y in others)]
    words = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", "split(x, ' ') as u")
    got = words.select(F.expr(f"{line_dedup._cut('x', 'u', 'y')} as most"), F.expr("levenshtein(x, y) as real"), F.expr(f"{line_dedup._most('x', 'y')} as allowed"), line_dedup._near_within("x", "y").alias("near")).collect()
    assert got[0].real <= got[0].most <= got[0].allowed and all(r.most >= r.real for r in got)
    assert all(r.near == (r.real <= r.allowed) for r in got)


def test_blocks_without_a_lambda_for_each_word(spark):
    """Only short lines less a word each are interpreted; rows alike and lines of punctuation have rows of their own."""
    draw = random.Random(24)
    a, b = sentence(draw, 50), sentence(draw, 6)
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n..."), (1, f"{a}\n{b}\n..."), (2, f"{a} {a}"), (3, None)], "doc_id long, text string")
    signed = line_dedup.signed(docs)
    # Two lambdas, and what stands in one is named so again.
    assert signed._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") <= 2
    got = [(r.k, r.pos, sorted(r.buckets)) for r in signed.collect()]
    assert len(got) == 7 and all(got.count(x) == 2 for x in got if x[0] == 1)
    first, twice = (next(set(x[2]) for x in got if x[:2] == at) for at in ((1, 0), (2, 0)))
    assert len(first) >= 5 and all(len(x[2]) >= 7 for x in got if x[:2] == (1, 1)) and not any(x[2] for x in got if x[:2] == (1, 2))
    assert len(twice) >= 5


def test_lines_that_meet_no_other_are_not_signed(spark, monkeypatch):
    draw = random.Random(21)
    lines = [sentence(draw) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*lines, lines[0] + " more", lines[1]])), "doc_id long, text string")
    seen = {}

    def kept(df, **options):
        out = _store.materialize(df, **options)
        seen[tuple(df.columns)] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    assert {r.k for r in line_dedup.removals(docs).collect()} == {30, 31}
    assert seen[("k", "th", "pos", "h", "buckets")] == 32 and seen[("h", "norm", "n", "len", "sim")] == 2


def test_what_line_dedup_wrote_and_shuffled_goes(spark):
    shared = Path(_store.shared_dir(spark).removeprefix("file://"))
    blocks = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    draw = random.Random(5)
    lines = [sentence(draw) for _ in range(40)]
    near = [x.replace(" ", " very ", 1) for x in lines]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines + near)], "doc_id long, text string")
    held = set(blocks.rglob("shuffle_*"))
    counted = _store.materialize(docs.groupBy("text").count())
    assert not set(blocks.rglob("shuffle_*")) - held and counted.count() == 80
    tables = set(shared.glob("table-*"))
    found = line_dedup.removals(docs)
    assert len(set(shared.glob("table-*")) - tables) == 1
    assert {r.k for r in found.collect()} == set(range(40, 80))


def test_workers_get_small_batches(spark):
    """Whole texts and token sets go to Python workers a thousand at a time, and the session keeps its setting."""
    from loomdex.llm._store import BATCH, materialize

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    for given in ("10000", "0", "700"):
        before = spark.conf.get(BATCH)
        spark.conf.set(BATCH, given)
        try:
            sizes = [r.n for r in materialize(spark.range(5000).coalesce(1).mapInArrow(run, "n long")).collect()]
            assert spark.conf.get(BATCH) == given
        finally:
            spark.conf.set(BATCH, before)
        assert sum(sizes) == 5000 and max(sizes) == min(int(given) or 1000, 1000)


def test_passages(spark):
    draw = random.Random(10)
    clean = [(i, sentence(draw, draw.randint(30, 200))) for i in range(20)]
    passage = sentence(draw, 55)
    put = lambda i: (i, f"{sentence(draw, draw.randint(1, 60))} {passage} {sentence(draw, draw.randint(1, 60))}")
    planted = [put(i) for i in range(100, 112)]
    short = sentence(draw, 8)
    boiler = [(i, f"{short}\n{sentence(draw, 60)}") for i in range(200, 210)]
    docs = spark.createDataFrame([*clean, *planted, *boiler, (300, None), (301, "")], "doc_id long, text string")
    found = substring_dedup.repeats(docs)
    got = {r.k: r for r in found.collect()}
    assert set(got) == {d for d, _ in planted}
    assert got[100].n_removed_words == 0 and all(got[d].n_removed_words >= 20 for d, _ in planted[1:])
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove(docs, found).collect()}
    assert cleaned[100] == dict(planted)[100] and cleaned[0] == dict(clean)[0] and cleaned[300] is None
    for d, t in planted[1:]:
        assert len(WORD.findall(cleaned[d])) == len(WORD.findall(t)) - got[d].n_removed_words
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_near_paragraphs_that_agree_with_no_pivot(spark):
    """First paragraphs of Jaccard 0.8 or more that meet in one bucket of many, and differ in both other bands."""
    draw = random.Random(4)
    texts = []
    for _ in range(40):
        phrase = sentence(draw, 5)
        for _ in range(1000):
            x = f"{phrase} {sentence(draw, 9)}"
            texts += [x, f"{sentence(draw, 1)} {x}"]
    p = substring_dedup.Paragraphs(pa.array(texts))
    first = np.searchsorted(p.owner, np.arange(len(texts)))
    size = (p.ends - p.starts)[first]
    bands = [p.minima(b)[first] for b in range(substring_dedup.BANDS)]
    a, b = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    fits = (size[a] >= 8) & (size[b] == size[a] + 1) & (bands[0][a] == bands[0][b]) & (bands[1][a] != bands[1][b]) & (bands[2][a] != bands[2][b])
    values, counts = np.unique(bands[0][a][fits], return_counts=True)
    chosen = np.flatnonzero(fits & (bands[0][a] == values[counts.argmax()]))
    assert len(chosen) >= 4
    docs = spark.createDataFrame([(2 * int(i) + j, texts[2 * i + j]) for i in chosen for j in (0, 1)], "doc_id long, text string")
    found = {r.k: r.n_shared_words for r in substring_dedup.repeats(docs, min_run=1).collect()}
    assert found == {2 * int(i) + j: 14 + j for i in chosen for j in (0, 1)}


def test_unlike_paragraphs_around_one_phrase(spark, monkeypatch):
    """Paragraphs that differ in one of seven shingles are not near; their number of comparisons must not grow with its square."""
    draw = random.Random(6)
    make = lambda phrase, n: [f"{phrase} {sentence(draw, 2).replace(' ', '')}" for _ in range(n)]

    def together(texts):
        """The share of texts that are cut once at most, near their first word."""
        p = substring_dedup.Paragraphs(pa.array(texts))
        return ((np.bincount(p.owner) <= 2) & ((p.ends - p.starts)[np.searchsorted(p.owner, np.arange(len(texts)), "right") - 1] >= 11)).mean()

    phrase = next(x for x in (sentence(draw, 14) for _ in range(1000)) if together(make(x, 50)) >= 0.8)
    texts = make(phrase, 1200)
    asked = []
    real = substring_dedup._verify
    monkeypatch.setattr(substring_dedup, "_verify", lambda pairs, sets: asked.append(pairs.count()) or real(pairs, sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    substring_dedup.repeats(docs, min_run=1).count()
    assert sum(asked[1:]) <= len(texts)


def shingle_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def near_passages(spark):
    """(documents with a copy at Jaccard 0.8 or more, removed words of each document with a removal)."""
    draw = random.Random(18)
    rows, want = [], set()
    for i in range(60):
        passage = sentence(draw, 90).split()
        copy = list(passage)
        for at in draw.sample(range(90), 1 + i % 2):
            copy[at] = sentence(draw, 1)
        for j, w in enumerate((passage, copy)):
            before, after = (sentence(draw, draw.randint(20, 60)) for _ in "ab")
            rows.append((2 * i + j, f"{before} {' '.join(w)} {after}"))
        if shingle_jaccard(passage, copy) >= 0.8:
            want.add(2 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return want, {r.k: r.n_removed_words for r in substring_dedup.repeats(docs).collect() if r.n_removed_words}


def test_near_passages(near_passages):
    """Of the copies of passages that brute force puts at Jaccard 0.8 or more, nearly all are found."""
    want, got = near_passages
    assert len(want) > 30 and len(want & set(got)) >= 0.95 * len(want)
    assert all(d % 2 and n <= 90 for d, n in got.items())


@pytest.mark.xfail(strict=True, reason="66 % of the words go: edges up to the first cut, and paragraphs with an edit there, stay")
def test_words_of_near_passages(near_passages):
    want, got = near_passages
    assert sum(got.get(d, 0) for d in want) >= 0.75 * 90 * len(want)


def test_paragraphs_agree_wherever_a_passage_stands():
    import pyarrow as pa

    draw = random.Random(11)
    passage = sentence(draw, 80)
    texts = [f"{sentence(draw, n)} {passage} {sentence(draw, 5)}" for n in (0, 3, 17, 50)]
    p = substring_dedup.Paragraphs(pa.array(texts))
    sets = [set(p.whole[p.owner == i].tolist()) for i in range(4)]
    assert len(set.intersection(*sets)) >= 4
    assert len(substring_dedup.Paragraphs(pa.array([None, ""], pa.string())).starts) == 0
