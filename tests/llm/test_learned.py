"""Language, quality and language-model operators against brute force and held-out texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import langid, lm, quality
from loomdex.llm.gru import PER_CLASS, Gru, _exp
from loomdex.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_language(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op4_langid"](spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "nothing", None)], "doc_id long, text string, lang string")
    f = langid.learn(docs)
    asked = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !?", 1), (4, "und die katze", 1), (5, "THE DOG " * 9000, 1), (None, "the", 1)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(asked, f).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "de" and got[5][0] == "en" and got[None][0] == "en"
    empty = langid.learn(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(asked, empty).collect()} == {"und"}
    assert langid.predict(asked.limit(0), f).count() == 0


def test_filters_hold_every_member():
    draw = np.random.default_rng(1)
    members = [draw.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(70)]
    f = langid.build([f"{i:02}" for i in range(70)], members, [1.0] * 70)
    hits, count = f.hits(members[69], np.zeros(500, np.int64), 1)
    assert count[0] == 500 and hits[0].argmax() == 69 and hits[0, 69] > 495
    assert np.delete(hits[0], 69).max() < 25


def brute_statistics(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_statistics():
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab \n#é") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += [None, "", "\n", "a\na\n", "x " * 50, " ".join(str(i % 9) for i in range(40)), "a\x0bb\tc\rd"]
    got = quality.statistics_of(pa.array(texts, pa.string()))
    assert [tuple(int(got[k][i]) for k in quality.BASE) for i in range(len(texts))] == [brute_statistics(t) for t in texts]
    assert all(len(v) == 0 for v in quality.statistics_of(pa.array([], pa.string())).values())


def test_quality_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op9_quality"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in table(spark, sf_dir, "labels").where("quality = 1").collect()}
    rated = [r.kept for r in got if r.doc_id in good and not r.base_failed]
    assert np.mean(rated) > 0.95


def test_decision_list():
    draw = np.random.default_rng(2)
    x = draw.random((4000, len(quality.FEATURES)))
    bad = ((x[:, 0] > 0.7) & (x[:, 3] <= 0.5)) | (x[:, 8] < 0.1)
    rules = quality.learn(x[:2000], bad[:2000].astype(int))
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= r.covers(x[2000:])
    assert bad[2000:][hit].mean() > 0.95 and hit[bad[2000:]].mean() > 0.9
    assert quality.learn(x, np.zeros(4000, int)) == []


def test_keep_carries_columns(spark):
    docs = spark.createDataFrame([(1, "good words are here " * 1 + " ".join(f"w{i}" for i in range(30)), 7), (2, None, 8), (3, "", 9), (1, "short", 1)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and [(r.doc_id, r.n_words) for r in kept.collect()] == [(1, 7)]
    assert quality.keep(docs.limit(0), labels.limit(0)).count() == 0


def test_lm_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d in texts if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op10_lm"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_lm_cases(spark):
    docs = spark.createDataFrame([(1, "a b a", "x"), (1, "a b a", "x"), (2, None, "y"), (None, "zz", "z")], "doc_id long, text string, score string")
    model, counts = lm.fit(docs.where("doc_id = 1"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm.score(docs, model, counts).collect())
    assert got == [(0, 2, 1), (1, 4, 4), (1, 4, 4), (2, 1, 1)]
    model, counts = lm.fit(docs.limit(0))
    assert {r.score for r in lm.score(docs, model, counts).collect()} == {0.0}


def test_network_is_a_distribution():
    net = Gru.start(np.array([50.0, *range(200, 0, -1)]), np.array([30.0, 7.0]), hidden=8)
    h = np.random.default_rng(3).standard_normal((1, 8)).astype(np.float32)
    all_tokens = np.arange(net.words + net.bands)
    assert math.isclose(np.exp(net.log_prob(np.repeat(h, len(all_tokens), 0), all_tokens)).sum(), 1, rel_tol=1e-4)


def test_state_is_carried_over_windows():
    net = Gru.start(np.array([5.0, 9, 8, 7]), np.array([2.0]), hidden=6)
    draw = np.random.default_rng(4)
    lists = [draw.integers(0, 5, n) for n in (1, 700, 33, 0, 256)]
    ids, ptr = np.concatenate(lists).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    want = []
    for x in lists:
        h, last, total = np.zeros((1, 6), np.float32), np.array([0]), 0.0
        for t in x:
            h = net.step(h, last)
            last = np.array([t])
            total += net.log_prob(h, last)[0]
        want.append(total)
    for chunk in (1, 64, 1 << 15):
        assert np.allclose(net.score(ids, ptr, 0, chunk), want, atol=1e-2)


def test_gradients():
    net = Gru.start(np.array([5.0, 9, 8, 7]), np.array([2.0]), hidden=4)
    for k in ("table", "u", "b", "wc", "bc", "ww", "bw"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    draw = np.random.default_rng(5)
    inputs, wanted = draw.integers(1, 5, (3, 6)), draw.integers(0, 5, (3, 6))
    inputs[:, 0] = 0

    def loss():
        h, total = np.zeros((3, 4)), 0.0
        for t in range(6):
            h = net.step(h, inputs[:, t])
            total -= net.log_prob(h, wanted[:, t]).sum()
        return total

    grads = {}
    net._apply = lambda name, grad, sums, rate, at=slice(None): grads.setdefault(name, []).append((at, grad))
    net._update(np.zeros((3, 4)), inputs, wanted, 0, {}, 0.1)
    for name, place in (("u", (1, 2)), ("u", (3, 9)), ("b", (5,)), ("wc", (0, 1)), ("bc", (0,))):
        array = getattr(net, name)
        keep, eps = array[place], 1e-5
        array[place] = keep + eps
        up = loss()
        array[place] = keep - eps
        down = loss()
        array[place] = keep
        assert grads[name][0][1][place] * 3 == pytest.approx((up - down) / (2 * eps), rel=2e-3, abs=2e-4)


def test_language_model_sample_is_whole_texts_by_hash(spark):
    rows = [(i, f"a{i} b{i} c{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model, _ = lm.fit(docs)

    def block(parts):
        draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)).alias("draw")
        rows = docs.repartition(parts).select(F.lit(0).cast("long").alias("block"), draw, F.xxhash64("text").alias("th"), "text")
        (row,) = lm._blocks(rows.coalesce(1), model, None, 142).collect()
        return row

    one, other = block(5), block(3)
    assert one.tokens == 144 and one.net == other.net  # 36 whole texts of 4 tokens, whatever the partitions


def test_language_model_learns_from_blocks(spark):
    """Blocks go on from the start: a word order that the start's few texts do not show is learned from the share."""
    draw = np.random.default_rng(9)
    names = [f"w{i}" for i in range(60)]

    def text(n):
        at, out = int(draw.integers(60)), []
        for _ in range(n):
            out.append(names[at])
            at = (7 * at + 3) % 60 if draw.random() < 0.9 else int(draw.integers(60))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(200)) for i in range(400)], "doc_id long, text string")
    total = lambda share: (lambda m: lm.score(docs.where("doc_id < 50"), *m).agg(F.sum("score")).first()[0])(lm.fit(docs.where("doc_id >= 50"), fit_tokens=6000, share=share))
    assert total(1) > total(10**9) + 500


def test_the_network_is_fitted_on_every_training_text(spark, monkeypatch):
    seen, made = [], lm._blocks

    def blocks(rows, model, steps, most):
        if most is None:
            seen.append(rows.count())
        return made(rows, model, steps, most)

    monkeypatch.setattr(lm, "_blocks", blocks)
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} w{i % 7}") for i in range(80)], "doc_id long, text string")
    lm.fit(docs, fit_tokens=60, known=10, n_words=6)
    assert seen == [80]


def _plain_update(net, h, inputs, wanted, end, rate, steps):
    """One update of the network token by token, in double precision; returns the mean loss."""
    p = {k: getattr(net, k).astype(np.float64) for k in Gru.PARAMETERS}
    m, (n, length) = net.hidden, inputs.shape
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    loss = 0.0
    for row in range(n):
        state, trace = h[row].astype(np.float64), []
        for x, y in zip(inputs[row], wanted[row]):
            before = np.zeros(m) if x == end else state
            a, g = p["table"][x] + p["b"], before @ p["u"]
            z, r = np.split(1 / (1 + np.exp(-(a[: 2 * m] + g[: 2 * m]))), 2)
            new = np.tanh(a[2 * m :] + r * g[2 * m :])
            state = new + z * (before - new)
            trace.append((x, y, before, z, r, new, g, state))
        carry = np.zeros(m)
        for x, y, before, z, r, new, g, state in reversed(trace):
            dh, kind = carry, int(net.class_of(np.array([y]))[0])
            parts = [("wc", "bc", slice(None), kind)] + ([("ww", "bw", kind, y - kind * PER_CLASS)] if y < net.words else [])
            for w, b, at, hit in parts:
                matrix = p[w] if w == "wc" else p[w][at]
                q = state @ matrix + p[b][at]
                q = np.exp(q - q.max())
                q /= q.sum()
                loss -= np.log(q[hit])
                q[hit] -= 1
                grad[w][at] += np.outer(state, q)
                grad[b][at] += q
                dh = dh + matrix @ q
            dnew = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (before - new) * z * (1 - z), dnew * g[2 * m :] * r * (1 - r)
            dg = np.concatenate([dz, dr, dnew * r])
            dx = np.concatenate([dz, dr, dnew])
            grad["table"][x] += dx
            grad["b"] += dx
            grad["u"] += np.outer(before, dg)
            carry = np.zeros(m) if x == end else dh * z + p["u"] @ dg
    for k, v in grad.items():
        v = np.clip(v / n, -1, 1)
        p[k] -= rate * v / np.sqrt(steps[k] + v * v)
    return p, loss / (n * length)


def test_updates_equal_plain_ones():
    draw = np.random.default_rng(8)
    words, bands, end = 3 * PER_CLASS - 5, 3, 0
    counts = 1e4 / np.arange(1, words + 1)
    share = np.append(counts, [300, 200, 100]) / (counts.sum() + 600)
    net = Gru.start(counts, np.array([300.0, 200.0, 100.0]), hidden=6)
    part = draw.choice(words + bands, size=(5, 40), p=share).astype(np.int32)
    inputs, wanted = part[:, :-1], part[:, 1:]
    h = (draw.standard_normal((5, 6)) * 0.3).astype(np.float32)
    steps = {k: np.full_like(getattr(net, k), 1e-1) for k in Gru.PARAMETERS}
    want, want_loss = _plain_update(net, h, inputs, wanted, end, 0.08, steps)
    loss, _ = net._update(h, inputs, wanted, end, steps, 0.08)
    assert abs(loss - want_loss) < 1e-4
    for k in Gru.PARAMETERS:
        assert np.abs(getattr(net, k) - want[k]).max() < 1e-4, k


def test_rows_far_below_the_greatest_value():
    x = np.array([[0.0, 1.0], [500.0, 499.0]], np.float32)
    total = _exp(x)
    assert np.allclose(x / total[:, None], [[0.26894143, 0.73105857], [0.73105857, 0.26894143]])


def test_blocks_are_trained_in_tasks_of_their_own(spark):
    """Each block has a task: dealt by hash, two of them would meet in one and take its time twice."""
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tasks = []
    real = lm._blocks

    def seen(rows, *args):
        tasks.append([r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("block").alias("n")).collect()])
        return real(rows, *args)

    lm._blocks = seen
    try:
        lm.fit(docs, fit_tokens=1500, n_words=64)
    finally:
        lm._blocks = real
    assert len(tasks[1]) == 17 and set(tasks[1]) == {1}


def test_training_texts_are_not_counted_again(spark, monkeypatch):
    """The number of blocks follows from the tokens that are counted already."""
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    tokens = docs.agg(lm.F.sum(lm._sizes("text")).alias("n")).first().n if hasattr(lm, "_sizes") else None
    monkeypatch.setattr(lm.F, "regexp_count", None)
    model, _ = lm.fit(docs, fit_tokens=1000, n_words=64)
    assert model.net is not None and model.tokens == tokens == 40 * 101 + 2
