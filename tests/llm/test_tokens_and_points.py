"""Alignment, fill-in-middle and near-dedup against plain Python versions of what they promise."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loomdex.llm import alignment, infill, near_dedup
from loomdex.llm.queries import QUERIES

WORD, UNIT = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", "<|endoftext|> x", "▁x", "a▁", "naïve 東京 😀\r\n\tend  ", "word " * 3000, "x" * 5000, "same text", "same text", "<P> is a sentinel", "\x00 nul", "é" * 300]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_table(spark, texts=ODD, **more):
    rows = [(None if i == 4 else i, t, "extra", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a string, component long")


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    """What op11 returns, with token by token loops and the libraries themselves."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    a.no_truncation(), a.no_padding()
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(x): x for x in printable} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    spell_a = lambda i: bytes(back[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, count = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = f" {text}".encode()
        if not text or b"".join(map(spell_a, ids_a)) != raw or b"".join(map(spell_b, ids_b)) != raw:
            made.append(([], [], [], []))
            continue
        spans = []
        for ids, spell in ((ids_a, spell_a), (ids_b, spell_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spell(i)), i))
                at = out[-1][1]
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append([[i for s, e, i in side if before < e <= cut] for side in spans])
            before = cut
        links, k = [], 0
        for s, e, i in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        count.update(set(links))
        made.append((ids_a, ids_b, groups, links))
    high = defaultdict(int)
    for (i, _), n in count.items():
        high[i] = max(high[i], n)
    out = []
    for ids_a, ids_b, groups, links in made:
        form = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == high[x[0]] for x in links), sum(count[x] for x in links), sha(form) if form else ""))
    return out


def test_alignment_query(spark, sf_dir, whole):
    docs = whole.orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_align"](spark, sf_dir).collect()}
    assert got == {d.doc_id: want for d, want in zip(docs, plain_alignment([d.text for d in docs]))}


@pytest.mark.parametrize("most", [0, 40, 1 << 19])
def test_alignment_of_odd_texts_with_any_share_of_rare_pairs(spark, most):
    from loomdex.llm.queries import BPE_FILE, PIECE_FILE, bpe_model_path

    aligned = alignment.align(odd_table(spark), bpe_model_path(BPE_FILE), bpe_model_path(PIECE_FILE))
    got = alignment.score(aligned, 32000, most).collect()
    rows = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha(r.groups) if r.groups else "") for r in got)
    assert rows == sorted(plain_alignment(ODD))
    none = alignment.align(odd_table(spark, []), bpe_model_path(BPE_FILE), bpe_model_path(PIECE_FILE))
    assert alignment.score(none, 32000).count() == 0


def test_a_pair_links_what_overlaps():
    """Tokens of widths 2, 2, 2 and 3, 3 over six bytes: two groups' worth of ends but one common end."""

    class Fixed:
        def __init__(self, pieces, ids):
            self.pieces, self.ids = pieces, ids

        def many(self, texts):
            return [list(self.ids) for _ in texts]

    a, b = alignment.Side(Fixed([b" x", b"yz", b"uv"], [0, 1, 2])), alignment.Side(Fixed([b" xy", b"zuv"], [0, 1]))
    got = alignment.align_texts(["xyzuv", None, "other"], a, b)
    assert got.groups == b"0,1,2|0,1" and got.n_links.tolist() == [4, 0, 0] and got.n_groups.tolist() == [1, 0, 0]
    assert got.pairs.tolist() == [0, 2, 3, 5]


# ---------------------------------------------------------------- fill-in-middle


def plain_infill(key, text):
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, middle, last = ("".join(units[i:j]) for i, j in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(first), len(middle), f"<S>{last}<P>{first}<M>{middle}"
    return n, "psm", len(first), len(middle), f"<P>{first}<S>{last}<M>{middle}"


def test_infill_query(spark, sf_dir, whole):
    docs = {r.doc_id: r.text or "" for r in whole.collect()}
    got = QUERIES["op12_fim"](spark, sf_dir).collect()
    assert len(got) == len(docs) and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        n, form, first, middle, output = plain_infill(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, first, middle)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(docs[r.doc_id]))


def test_infill_of_odd_texts(spark):
    texts = [*ODD, "a<", ">b", "x <P", "<<S", *(f"word {i} <{'PSM'[i % 3]}" for i in range(40))]
    made = infill.transform(odd_table(spark, texts))
    got = made.withColumn("back", infill.restore(made["output"], made["form"])).collect()
    assert len(got) == len(texts)
    rows = Counter((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)
    assert rows == Counter(plain_infill(None if i == 4 else i, t or "") for i, t in enumerate(texts))
    assert Counter(r.back for r in got) == Counter(t or "" for t in texts)
    assert infill.transform(odd_table(spark, [])).count() == 0


def test_second_pass_stops_at_the_larger_rank():
    text = " a b\n c  "
    ends = [m.end() for m in UNIT.finditer(text)]
    assert infill.count(text) == 4
    for low in range(5):
        for high in range(low, 5):
            assert infill.borders(text, low, high) == tuple(0 if k == 0 else ends[k - 1] for k in (low, high))


# ---------------------------------------------------------------- near-dedup


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(points, bits=4):
    """The smallest index that links reach, by comparing every pair."""
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    values = np.array(points, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= bits):
            a, b = sorted((root(i), root(int(j))))
            up[b] = a
    return [root(i) for i in range(len(points))]


def test_near_query(spark, sf_dir, whole):
    docs = whole.orderBy("doc_id").collect()
    points = [plain_fingerprint(d.text) for d in docs]
    least = plain_components(points)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_near"](spark, sf_dir).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[k].doc_id) for d, p, k in zip(docs, points, least)}


def points_of(kind, n=1500):
    rng = np.random.default_rng(5)
    far = rng.integers(0, 2**64, n, dtype=np.uint64)
    if kind == "random":
        return far
    flips = lambda size, most: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (size, most), dtype=np.uint64), axis=1)
    if kind == "pairs":  # every point with a partner of one to seven other bits
        return np.concatenate([far, *(far[: n // 4] ^ flips(n // 4, k) for k in (1, 3, 4, 5, 7))])
    if kind == "one cluster":  # a third of all within a few bits of one point
        return np.concatenate([far, far[0] ^ flips(n // 2, 5), far[0] ^ flips(n // 2, 3)])
    if kind == "two clusters":  # not linked through vantage points alone
        return np.concatenate([far, far[0] ^ flips(n // 2, 4), far[0] ^ np.uint64(0x3FF) ^ flips(n // 2, 4)])
    chain = [np.uint64(0)]  # each point four bits from the one before
    for k in range(n // 2):
        chain.append(chain[-1] ^ flips(1, 4)[0])
    return np.concatenate([far, np.array(chain, np.uint64)])


KINDS = ("random", "pairs", "one cluster", "two clusters", "chain")


@pytest.mark.parametrize("kind", KINDS)
def test_search_in_a_shard(kind):
    points = np.unique(points_of(kind))
    half = len(points) // 3
    links = near_dedup.search(points[:half], points[half:])
    place = {int(p): i for i, p in enumerate(points)}
    groups = near_dedup.Groups(len(points))
    for a, b in links.tolist():
        assert (a ^ b).bit_count() <= 4
        groups.star(place[a], np.array([place[b]]))
    want = near_dedup.Groups(len(points))
    for i in range(half):
        want.star(i, np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4))
    least = lambda g: {int(r): k for k, r in reversed(list(enumerate(g.of(np.arange(len(points))))))}
    assert [least(groups)[int(r)] for r in groups.of(np.arange(len(points)))] == [least(want)[int(r)] for r in want.of(np.arange(len(points)))]
    assert len(links) < len(points)  # a spanning set, never all pairs of a group


@pytest.mark.parametrize("kind", KINDS)
def test_links_over_shards(spark, monkeypatch, kind):
    """Small shards and few visitors a task, so that every rule of dealing is at work."""
    monkeypatch.setattr(near_dedup, "VISITORS", 300)
    points = np.unique(points_of(kind))
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint long")
    from loomdex.llm._graph import connected_components

    for sample in (1 << 15,) if kind in ("pairs", "chain") else (500,):
        joined = {r.id: r.component for r in connected_components(near_dedup.links(table, shard=64, sample=sample)).collect()}
        want = plain_components(points)
        first = {}
        got = [first.setdefault(joined.get(int(p), int(p)), i) for i, p in enumerate(points.view(np.int64))]
        assert got == want


def test_a_great_cluster_is_not_copied_into_its_shards():
    points = np.unique(points_of("one cluster", 6000))
    tree = near_dedup.grow(points, 64)
    cluster = np.bitwise_count(points ^ points_of("one cluster", 6000)[0]) <= 5
    ranges, home = {}, np.zeros(len(points), int)
    for kind, index, at in near_dedup.route(tree, points, 4):
        if kind == "own":
            home[index] = at
    for s in home[cluster]:
        ranges[int(s)] = (7, 7)
    low, high = near_dedup.spans(tree, ranges)
    barred = lambda index, child: cluster[index] & ((low[child + tree.shards] > high[child + tree.shards]) | (low[child + tree.shards] == 7))
    visits = sum(int(cluster[index].sum()) for kind, index, _ in near_dedup.route(tree, points, 4, True, barred) if kind == "visit")
    assert visits == 0


def test_near_dedup_of_odd_texts(spark):
    texts = [*ODD, "One two THREE four five", "one two three four five", "one\ttwo\nthree four  five", "\x0b\x0c"]
    got = near_dedup.components(odd_table(spark, texts)).collect()
    points = [plain_fingerprint(t) for t in texts]
    ids = [None if i == 4 else i for i in range(len(texts))]
    assert Counter((r.doc_id, r.fingerprint % 2**64) for r in got) == Counter(zip(ids, points))
    groups = defaultdict(list)
    for i, k in enumerate(plain_components(points)):
        groups[k].append(i)
    want = {ids[i]: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for i in g}
    assert {r.doc_id: r.component for r in got} == want
    assert near_dedup.components(odd_table(spark, [])).count() == 0
