"""Substring dedup: paragraph MinHash banding over content-defined paragraphs.

A repeated passage rarely fills a paragraph of the text it was pasted into, so texts are
cut where their own words say so: after a word whose hash (with its neighbour's) is the
least within ``RADIUS`` words. A passage that stands in two texts is cut alike in both,
but for its edges. Each paragraph's word shingles give one minimum per band; paragraphs
that agree in a band are compared (equal hashes, or exact Jaccard of their shingles) and
links make clusters. A text's runs of clustered paragraphs that hold ``MIN_RUN`` words
or more are repeats; the first occurrence (smallest id, first place) of a cluster stays
and the others are removals. A run goes on over an edited stretch of at most ``GAP`` words
if the first occurrences on both its sides stand in one document at the same distance, give
or take ``GAP``; the stretch is removed with them where at least half of the run's words
are shared, which a passage of Jaccard 0.8 (one word in 45 changed) reaches.

Bands: with one minimum each, paragraphs of Jaccard 0.8 meet in one of 3 bands with
probability 1 - 0.2**3 = 0.992; unrelated ones, which share no 5-word shingle, do not meet.
In a bucket each paragraph is first compared with two pivots, the bucket's smallest paragraph
and the smallest of those that agree with it in all bands. What is still in different
clusters of one bucket is then compared where it shares one of its rarest shingles (a prefix
filter, exact for each pair of sizes), again with a pivot first and then with each other; the
numbers of shingles and 64-bit marks of them bound the Jaccard from above before sets are
read (no link is lost by that). So large groups of copies, or of unlike paragraphs around one
phrase, cost about as much as they have rows, and every link between paragraphs that meet is
found.

Defined cases: a null or empty text has no paragraphs; paragraphs of fewer words than a
shingle count as one shingle; repeats inside one text alone count only without ``across``; a null id is read as
the largest id and given back as null; rows that repeat id and text are one document;
only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm._graph import connected_components
from loomdex.llm._sieve import sieve
from loomdex.llm._store import discard, materialize
from loomdex.llm._words import Words, column, mix, slices, windows, words

RADIUS, SHINGLE, BANDS, MIN_RUN = 5, 5, 3, 20
#: Words of an edited stretch between two shared paragraphs that still belongs to their run.
GAP = 24
NUM, DEN = 80, 100
_LAST = (1 << 63) - 1
_SALTS = np.random.Generator(np.random.PCG64(41)).integers(1, 2**63, BANDS, dtype=np.uint64)


def cuts(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First words of paragraphs: every text's first word, and each word after a local minimum."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    pair = np.full(n, 2**64 - 1, np.uint64)
    pair[: n - 1] = mix(h[:-1] * np.uint64(3) + h[1:])
    first = rows[:-1][np.diff(rows) > 0]
    pair[rows[1:][np.diff(rows) > 0] - 1] = np.uint64(2**64 - 1)  # the pair over a text's end
    low = np.full(n + 2 * RADIUS, 2**64 - 1, np.uint64)
    low[RADIUS : RADIUS + n] = pair
    is_cut = pair < np.uint64(2**64 - 1)
    for k in range(2 * RADIUS + 1):
        if k != RADIUS:
            other = low[k : k + n]
            # The left one of equal minima wins.
            is_cut &= (pair < other) if k < RADIUS else (pair <= other)
    starts = np.unique(np.concatenate([first, np.flatnonzero(is_cut) + 1]))
    return starts[starts < n]


class Paragraphs:
    """The paragraphs of a run of texts."""

    def __init__(self, texts: pa.Array) -> None:
        self.words: Words = words(texts)
        h = self.words.hashes()
        self.rows = self.words.rows
        self.starts = cuts(h, self.rows)
        self.ends = np.append(self.starts[1:], len(h)) if len(self.starts) else self.starts
        self.owner = np.searchsorted(self.rows, self.starts, "right") - 1
        bounds = np.append(self.starts, len(h))
        # Hash of the whole paragraph, and its shingles.
        self.shingles, self.of, _ = windows(h, bounds, SHINGLE, whole_if_short=True)
        order = np.argsort(self.of, kind="stable")
        self.shingles, self.of = self.shingles[order], self.of[order]
        self.first_shingle = np.searchsorted(self.of, np.arange(len(self.starts) + 1))
        place = np.arange(len(h)) - self.starts[np.searchsorted(self.starts, np.arange(len(h)), "right") - 1] if len(h) else h
        self.whole = np.add.reduceat(mix(h + mix(place.astype(np.uint64) + np.uint64(77))), self.starts) if len(h) else h
        self.whole = mix(self.whole)

    def minima(self, band: int) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return np.minimum.reduceat(mix(self.shingles ^ _SALTS[band]), self.first_shingle[:-1])


def _paragraph_rows(docs: DataFrame) -> DataFrame:
    """(bucket, fine, band, p, k, th, at, n): each paragraph in each band; fine stands for all its minima."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = Paragraphs(column(part, "text"))
            k, th = column(part, "k").to_numpy(), column(part, "th").to_numpy()
            at = (p.starts - p.rows[:-1][p.owner]).astype(np.int32)
            n = (p.ends - p.starts).astype(np.int32)
            minima = [p.minima(band) for band in range(BANDS)]
            fine = mix(minima[0] + mix(minima[1] + mix(minima[2]))).view(np.int64).astype(np.int32)
            for band in range(BANDS):
                arrays = [pa.array(mix(minima[band] + np.uint64(band)).view(np.int64)), pa.array(fine), pa.array(np.full(len(at), band, np.int8)), pa.array(p.whole.view(np.int64)), pa.array(k[p.owner]), pa.array(th[p.owner]), pa.array(at), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "fine", "band", "p", "k", "th", "at", "n"])

    return docs.mapInArrow(run, "bucket long, fine int, band byte, p long, k long, th long, at int, n int")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(p, tokens, m, marks) of wanted paragraphs (p, k), read from their documents: shingles, their number, and a bit set of them."""
    lists = wanted.groupBy("k").agg(F.collect_set("p").alias("ps"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = Paragraphs(column(part, "text"))
            asked = [set(x) for x in column(part, "ps").to_pylist()]
            name = p.whole.view(np.int64).tolist()
            found = [i for i, (o, x) in enumerate(zip(p.owner.tolist(), name)) if x in asked[o]]
            sets = [np.unique(p.shingles[p.first_shingle[i] : p.first_shingle[i + 1]]) for i in found]
            marks = np.array([np.bitwise_or.reduce(np.uint64(1) << (mix(x) >> np.uint64(58))) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[i] for i in found], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(marks.view(np.int64))],
                ["p", "tokens", "m", "marks"],
            )

    rows = sieve(docs.select("k", "text"), wanted, "k").join(lists, "k").select("text", "ps")
    return materialize(rows.mapInArrow(run, "p long, tokens binary, m int, marks long").dropDuplicates(["p"]))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "x"), column(batch, "y")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(DEN * common >= NUM * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("p").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("p").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: What paragraphs that may be near each other share: a bucket, a token, and both numbers of shingles.
_KEY = ["bucket", "token", "lo", "hi"]


def _index(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, token, lo, hi, p, m, marks): paragraphs of ``apart`` under each key by which a near one of their bucket may be found.

    Sets of a and b shingles have a Jaccard of NUM / DEN only with o = ceil(NUM * (a + b) / (NUM + DEN))
    in common. In one order of all tokens, rare ones first, the first of these is then among
    the first a - o + 1 of the one and b - o + 1 of the other. A token of one paragraph alone
    takes a place there, but finds nothing and is left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = column(batch, "m").to_numpy()
            tokens = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v.as_buffer(), np.int64) for v in column(batch, "tokens"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(column(batch, "p").to_numpy(), m)), pa.array(np.repeat(m, m)), pa.array(tokens)], ["p", "m", "token"])

    tokens = materialize(sets.select("p", "m", "tokens").mapInArrow(run, "p long, m int, token long"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    placed = tokens.join(counts, "token").withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy("n", "token")))
    other = F.explode(F.sequence(F.ceil(NUM * F.col("m") / DEN).cast("int"), F.floor(DEN * F.col("m") / NUM).cast("int")))
    common = F.floor((NUM * (F.col("m") + F.col("other")) + NUM + DEN - 1) / (NUM + DEN))
    found = placed.where("n > 1").select("p", "m", "token", "place", other.alias("other")).where(F.col("place") <= F.col("m") - common + 1)
    found = found.select("p", "m", "token", F.least("m", "other").alias("lo"), F.greatest("m", "other").alias("hi"))
    index = found.join(apart.select("bucket", "p"), "p").join(sets.select("p", "marks"), "p").select(*_KEY, "p", "m", "marks")
    wide = index.groupBy(*_KEY).agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low <> high").select(*_KEY)
    out = materialize(index.join(wide, _KEY))
    discard(tokens)
    return out


def _alike() -> F.Column:
    """Whether sizes and marks (columns a_m, a_marks, b_m, b_marks) allow the Jaccard."""
    total, less, greater = F.col("a_m") + F.col("b_m"), F.least("a_m", "b_m"), F.greatest("a_m", "b_m")
    # Of a union u a Jaccard of NUM / DEN leaves (DEN - NUM) / DEN * u outside the intersection, and the sizes add up to (DEN + NUM) / DEN * u at least.
    return (DEN * less >= NUM * greater) & ((DEN + NUM) * F.bit_count(F.col("a_marks").bitwiseXOR(F.col("b_marks"))) <= (DEN - NUM) * total)


def _connect_rest(docs: DataFrame, met: DataFrame, links: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, component) with the links, too, between paragraphs of one bucket of ``met`` that are in different components of ``comps``.

    Under each key of the index paragraphs are compared with the smallest one first, then
    those that are still in different components with each other.
    """
    placed = met.groupBy("bucket", "p").agg(F.min("k").alias("k")).join(comps.select(F.col("id").alias("p"), "component"), "p", "left").withColumn("component", F.coalesce("component", "p"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    apart = materialize(placed.join(open_, "bucket").select("bucket", "p", "k"))
    wanted = materialize(apart.groupBy("p").agg(F.min("k").alias("k")))
    sets = _shingle_sets(docs, wanted)
    index = _index(apart, sets)
    discard(apart, wanted)
    for stars in (True, False):
        rows = index.join(comps.select(F.col("id").alias("p"), "component"), "p", "left").withColumn("component", F.coalesce("component", "p"))
        named = lambda side: rows.select(*_KEY, *(F.col(c).alias(f"{side}_{c}") for c in ("p", "component", "m", "marks")))
        left, right = named("a"), named("b")
        if stars:
            least = rows.groupBy(*_KEY).agg(F.min(F.struct("p", "component", "m", "marks")).alias("q"))
            right = least.select(*_KEY, *(F.col(f"q.{c}").alias(f"b_{c}") for c in ("p", "component", "m", "marks")))
        else:
            # Under a key of two sizes only paragraphs of different ones are asked for.
            left, right = left.where("a_m = lo"), right.where("b_m = hi")
        pairs = left.join(right, _KEY).where((F.col("a_component") != F.col("b_component")) & _alike())
        pairs = materialize(pairs.select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).distinct())
        if not pairs.isEmpty():
            links = links.unionByName(materialize(_verify(pairs, sets)))
            comps = materialize(connected_components(links))
        discard(pairs)
    discard(index, sets)
    return comps


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, across: bool = True) -> DataFrame:
    """(k, th, n_shared_words, n_removed_words, spans, clusters): documents with repeated passages.

    spans: (start, end) of removals in words, merged; clusters: the ids of the clusters
    that the document's repeats belong to. With ``across``, a cluster counts only if its
    paragraphs stand in two documents or more. A document whose repeats all stay (first
    occurrences) has no spans. k is the id (the largest long for a null one), th a hash
    of the text.
    """
    slim = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = _paragraph_rows(slim)
    bucket = Window.partitionBy("bucket")
    fine = Window.partitionBy("bucket", "fine")
    met = rows.withColumn("many", F.count("*").over(bucket)).withColumn("pivot", F.min(F.struct("p", "k")).over(bucket)).where("many > 1")
    met = met.withColumn("pivot2", F.min(F.struct("p", "k")).over(fine))
    met = materialize(met.select("bucket", "band", "p", "k", "th", "at", "n", "pivot", "pivot2"))
    # Different paragraphs that meet: each against the smallest of its bucket, and of those in it with the same three minima.
    near = met.select("p", "k", F.explode(F.array("pivot", "pivot2")).alias("q")).where("p <> q.p")
    stars = materialize(near.groupBy(F.col("p").alias("a"), F.col("q.p").alias("b")).agg(F.min("k").alias("ka"), F.min("q.k").alias("kb")))

    def links_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("p"), F.col("ka").alias("k")).unionByName(pairs.select(F.col("b").alias("p"), F.col("kb").alias("k")))
        wanted = materialize(ends.groupBy("p").agg(F.min("k").alias("k")))
        sets = _shingle_sets(slim, wanted)
        found = materialize(_verify(pairs.select("a", "b"), sets))
        discard(wanted, sets)
        return found

    links = links_of(stars)
    comps = materialize(connected_components(links))
    discard(stars)
    comps = _connect_rest(slim, met, links, comps)
    # Every paragraph that meets another in band 0 is there once; near ones that meet elsewhere only are added.
    linked = met.join(comps.select(F.col("id").alias("p"), "component"), "p", "left")
    spots = linked.groupBy("k", "th", "at", "n", "p").agg(F.max("component").alias("component"))
    spots = materialize(spots.withColumn("cluster", F.coalesce("component", "p")).select("k", "th", "at", "n", "cluster"))
    sizes = spots.groupBy("cluster").agg(F.count("*").alias("m"), F.min(F.struct("k", "th", "at")).alias("first"), F.max(F.struct("k", "th")).alias("last"))
    sizes = sizes.where((F.col("m") > 1) & (F.struct("first.k", "first.th") != F.col("last")) if across else F.col("m") > 1).drop("last")
    shared = spots.join(sizes, "cluster").select("k", "th", "at", "n", "cluster", "first", (F.struct("k", "th", "at") != F.col("first")).alias("goes"))
    # Runs of neighbouring shared paragraphs in a document; short ones are chance or boilerplate.
    line = Window.partitionBy("k", "th").orderBy("at")
    before = lambda c: F.lag(c).over(line)
    end, drift = F.col("at") + F.col("n"), F.col("at") - F.col("first.at")
    over = (before(F.struct("first.k", "first.th")) == F.struct("first.k", "first.th")) & (F.abs(drift - before(drift)) <= GAP) & (F.col("at") - before(end) <= GAP)
    runs = shared.withColumn("from", F.coalesce(before(end), F.lit(-1))).withColumn("bridge", F.coalesce(over & before("goes") & F.col("goes"), F.lit(False)))
    runs = runs.withColumn("new", ((F.col("at") != F.col("from")) & ~F.coalesce(over, F.lit(False))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(line))
    one = Window.partitionBy("k", "th", "run")
    runs = runs.withColumn("words", F.sum("n").over(one)).withColumn("span", F.max(end).over(one) - F.min("at").over(one)).where(F.col("words") >= min_run)
    # An edited stretch counts to the paragraph behind it.
    stretch = F.when(F.col("bridge") & (2 * F.col("words") >= F.col("span")), F.col("at") - F.col("from")).otherwise(0)
    runs = runs.withColumn("at", (F.col("at") - stretch).cast("int")).withColumn("n", (F.col("n") + stretch).cast("int"))
    gone = F.sort_array(F.collect_list(F.when(F.col("goes"), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")))))
    found = runs.groupBy("k", "th").agg(
        F.sum("n").cast("long").alias("n_shared_words"),
        F.sum(F.when(F.col("goes"), F.col("n")).otherwise(0)).cast("long").alias("n_removed_words"),
        gone.alias("pieces"),
        F.sort_array(F.collect_set("cluster")).alias("clusters"),
    )
    merged = F.aggregate(
        "pieces",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), x["end"].alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return found.select("k", "th", "n_shared_words", "n_removed_words", merged.alias("spans"), "clusters")


def remove(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text less its removals; what stood between words before a removal stays."""
    spans = found.where(F.size("spans") > 0).select(F.col("k").alias("__k"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__k", F.coalesce(F.col(key).cast("long"), F.lit(_LAST))).withColumn("__th", F.xxhash64(text)).join(spans, ["__k", "__th"], "left")
    word = r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"
    units = F.regexp_extract_all(F.col(text), F.lit(word), F.lit(1))
    head = F.regexp_extract(F.col(text), r"^[\x20\x09-\x0D]*", 0)
    kept = F.filter(units, lambda _, i: ~F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    return rows.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(head, F.array_join(kept, "")))).select(*docs.columns)
