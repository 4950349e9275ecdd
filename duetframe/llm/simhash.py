"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius agree in some segment up to a few bits, so each
one looks up the small Hamming ball around each of its segments in tables keyed by exact segment values, and whole
distances are verified in the join. With ``s`` segments, radius ``r = s * q + a``: one of the first ``a + 1`` segments
differs in at most ``q`` bits or one of the others in at most ``q - 1``, which is all that has to be enumerated.

Exact copies collapse to one node before any lookup, so a group of thousands of copies costs one lookup. Segment values
that very many nodes share are looked up by a second segment of the remaining bits as well, in the same way and just as
exactly. Groups are the connected components of the links, found with alternating star contractions whose state is a
table in the shared folder; nothing of a document or link reaches the driver.

Edge cases: texts without words (null, empty, blank) have fingerprint zero and are linked like any other; rows that repeat
an id are rows of their own with the same id; a group whose ids are all null has a null ``component_id``; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import temporary_tables
from .common import among, materialize

#: Shingles whose bits are unpacked at a time.
CHUNK = 65_536
#: Nodes that share a segment value before a second segment is looked up too.
HOT_BUCKET = 1_000
SEED = 42
#: A fingerprint that has more than one of so many shares of all rows is hot.
HOT_SHARE = 1_000


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined runs of ``k`` words, repeats included; fewer words: of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.fromiter((h(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1:], strict=False)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i:i + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = [_signed(fingerprint(shingle_hashes((t or b"").lower().split(), k))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_fingerprints(shingle), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def _segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal parts."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _balls(radius: int, parts: int) -> list[int]:
    """The radius to enumerate in each segment; -1 for none."""
    q, a = divmod(radius, parts)
    return [q if i <= a else q - 1 for i in range(parts)]


def best_parts(nodes: int, radius: int, most: int = 8) -> int:
    """The number of segments with the least work for so many distinct fingerprints: fewer segments mean more lookups of each,
    more segments more candidates that agree in one by chance."""
    def work(parts: int) -> float:
        lookups = [(math.comb(w, k), w) for (_, w), ball in zip(_segments(64, parts), _balls(radius, parts), strict=True) for k in range(ball + 1)]
        return sum(n * (1 + nodes / 2**w) for n, w in lookups)

    return min(range(2, most + 1), key=work)


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(width), n)]


def _value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column, segments: Sequence[tuple[int, int]], balls: Sequence[int], probe: bool) -> Column:
    """array<struct<part, value>>: the table keys of ``fp``, or those it looks up."""
    def keys(part: int, value: Column, width: int, ball: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in (_masks(width, ball) if probe else [0])])
        return F.transform(masks, lambda m: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(m).alias("value")))

    out = [keys(i, _value(fp, *s), s[1], ball) for i, (s, ball) in enumerate(zip(segments, balls, strict=True)) if ball >= 0]
    return F.concat(*out)


def _rotated(fp: Column, shift: int, width: int) -> Column:
    """The bits of ``fp`` outside a segment, moved to the bottom."""
    low = fp.bitwiseAND(F.lit((1 << shift) - 1)) if shift else F.lit(0).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(fp, shift + width), shift) if shift + width < 64 else F.lit(0).cast("long")
    return low.bitwiseOR(high)


def _first_part(x: Column, part: Column, segments: Sequence[tuple[int, int]], balls: Sequence[int]) -> Column:
    """Whether ``part`` is the first in which two values with the exclusive or ``x`` lie within the ball: each pair then comes once."""
    out = F.lit(True)
    for i, (segment, ball) in enumerate(zip(segments, balls, strict=True)):
        if ball >= 0:
            out = out & ((part <= i) | (F.bit_count(_value(x, *segment)) > ball))
    return out


def hamming_links(nodes: DataFrame, radius: int, parts: int, hot_bucket: int = HOT_BUCKET, also: Sequence[str] = (), also_radius: int = 0) -> DataFrame:
    """(a, b), a < b: the pairs of ``nodes`` (id, fp) with fingerprints within ``radius``, each once.

    Columns in ``also`` are the words of a second, longer fingerprint; pairs must lie within ``also_radius`` there as well.
    """
    segments, balls = _segments(64, parts), _balls(radius, parts)
    carried = ["id", "fp", *also]
    fp = F.col("fp")
    stored = nodes.select(*carried, F.explode(_keys(fp, segments, balls, False)).alias("key")).select(*carried, "key.*")
    asked = nodes.select(*carried, F.explode(_keys(fp, segments, balls, True)).alias("key")).select(*carried, "key.*")
    hot = materialize(stored.groupBy("part", "value").count().where(F.col("count") > hot_bucket).select("part", "value"), "simhash-hot")

    def links(stored: DataFrame, asked: DataFrame, on: list[str], inner: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        s, a = stored.alias("s"), asked.alias("a")
        x = F.col("a.fp").bitwiseXOR(F.col("s.fp"))
        near = (F.col("a.id") < F.col("s.id")) & (F.bit_count(x) <= radius)
        if also:
            near = near & (sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"s.{c}"))) for c in also), F.lit(0)) <= also_radius)
        near = near & _first_part(x, F.col("a.part"), segments, balls)
        if inner is not None:
            near = near & inner(F.col("a.fp"), F.col("s.fp"))
        same = near
        for c in on:
            same = (F.col(f"a.{c}") == F.col(f"s.{c}")) & same
        return a.join(s, same).select(F.col("a.id").alias("a"), F.col("s.id").alias("b"))

    if hot.isEmpty():
        return links(stored, asked, ["part", "value"])
    # nodes in a hot bucket agree in that segment up to its ball, so all of the radius may lie in the remaining bits
    out = links(stored.join(hot, ["part", "value"], "left_anti"), asked, ["part", "value"])
    for i, (shift, width) in enumerate(segments):
        inner, inner_balls = _segments(64 - width, parts), _balls(radius, parts)

        def more(df: DataFrame, probe: bool, i: int = i, shift: int = shift, width: int = width, inner=inner, inner_balls=inner_balls) -> DataFrame:
            here = df.where(F.col("part") == i).join(hot, ["part", "value"], "left_semi")
            key = F.explode(_keys(_rotated(F.col("fp"), shift, width), inner, inner_balls, probe))
            return here.select(*carried, "part", "value", key.alias("key")).select(*carried, "part", "value", F.col("key.part").alias("part2"), F.col("key.value").alias("value2"))

        def once(x: Column, y: Column, shift: int = shift, width: int = width, inner=inner, inner_balls=inner_balls) -> Column:
            return _first_part(_rotated(x.bitwiseXOR(y), shift, width), F.col("a.part2"), inner, inner_balls)

        out = out.unionByName(links(more(stored, False), more(asked, True), ["part", "value", "part2", "value2"], once))
    return out


def are_stars(edges: DataFrame) -> bool:
    """Whether each ``a`` of the ``edges`` (a, b), b < a, has one ``b``, which is no ``a`` itself; edges may repeat."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).alias("to")))
    nodes = ends.groupBy("node").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.count_if(F.col("to").isNull()).alias("above"))
    return not nodes.where("least is not null").agg(F.bool_or(F.expr("least != most or above > 0")).alias("left")).first()["left"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node of ``links`` (a, b) can reach.

    Alternating large and small stars until only stars are left; a round is two joins of slim rows, and the number of rounds
    grows with the logarithm of the longest chain. A round shuffles three times: its small stars find all of a node's edges in
    one place, so repeats go there too, and what they leave is written with its repeats, as many rows as came in at most.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "components")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.repartition("a").distinct()
        small = large.hint("merge").join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        edges = materialize(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")), "components")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def simhash_components(docs: DataFrame, *, shingle: int = 4, radius: int = 4, parts: int | None = None, hot_bucket: int = HOT_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link within ``radius``, directly or over others.

    ``component_id`` is the smallest id of the group. The number of segments (``parts``) follows from the number of distinct
    fingerprints, if not given.
    """
    prints = materialize(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-nodes")
    nodes_n = nodes.agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows")).first()
    parts = parts or best_parts(nodes_n["nodes"], radius)
    groups = connected_components(hamming_links(nodes.select(F.col("fp").alias("id"), "fp"), radius, parts, hot_bucket))
    linked = nodes.join(groups, nodes["fp"] == groups["node"]).select("fp", "first", "component")
    ids = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = linked.join(ids, "component").select("fp", "component_id")
    ids = materialize(nodes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "first").alias("component_id")), "simhash-ids")
    # fingerprints with more than a thousandth of the rows, fewer than a thousand then, do not meet their rows in one task
    often = F.col("rows") > (nodes_n["rows"] or 0) / HOT_SHARE
    hot = ids.where(often).select(F.col("fp").alias("hot"), F.col("component_id").alias("hot_id"))
    split = prints.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left")
    rest = split.where("hot is null").select("doc_id", "fp").join(ids.where(~often).select("fp", "component_id"), "fp")
    return split.where("hot is not null").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest.select("doc_id", "fp", "component_id"))


#: Radii of the lookups that go before the exact search.
RADII = (3, 7)
WIDE = ("wide0", "wide1")
#: Shingles that very many texts hold come last in prefixes: at most so many, counted in every ``SAMPLE``-th text, with so many texts there.
HOT_SHINGLES, SAMPLE, HOT_COUNT = 65_536, 16, 8


def _shingle_digests(words: list[bytes], k: int) -> list[bytes]:
    """The distinct 128-bit digests of the runs of ``k`` words, sorted; fewer words: of the whole sequence."""
    return sorted({xxhash.xxh3_128_digest(b" ".join(words[i:i + k])) for i in range(max(1, len(words) - k + 1))}) if words else []


def _shingle_set(digests: list[bytes]) -> np.ndarray:
    """The first halves of sorted digests, which stand for the shingles."""
    return np.unique(np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64))


def _prefix(own: np.ndarray, min_similarity: float, hot: np.ndarray, rank: np.ndarray) -> tuple[int, np.ndarray]:
    """The first shingles of a set in one order for all texts, in which hot ones come last, and how many of the set are not hot.

    Two sets with the similarity share at least ``ceil(min_similarity * n)`` of the ``n`` shingles of each, so they share one
    of the first ``n - ceil(min_similarity * n) + 1``, whatever the order.
    """
    at = np.minimum(np.searchsorted(hot, own), max(len(hot) - 1, 0))
    ranks = np.where(hot[at] == own, rank[at], 0) if len(hot) else np.zeros(len(own), np.int64)
    keep = len(own) - math.ceil(min_similarity * len(own) - 1e-9) + 1 if len(own) else 0
    return int((ranks == 0).sum()), own[np.lexsort((own, ranks))[:keep]]


def _wide_fingerprint(digests: list[bytes]) -> tuple[int, int]:
    """The 128-bit SimHash of the digests, as two signed longs."""
    if not digests:
        return 0, 0
    bytes_ = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(bytes_), CHUNK):
        ones += np.unpackbits(bytes_[i:i + CHUNK], axis=1).sum(0, dtype=np.int64)
    low, high = np.packbits(ones * 2 > len(bytes_)).view(np.int64).tolist()
    return low, high


#: Bits of the maps that bound from below in how many shingles two sets differ.
MAP_BITS = 1024
PRINTS = "row struct<{id}:{type},th:bigint>, same binary, fp long, wide0 long, wide1 long, n int, cold int, prefix array<long>, map array<long>"


def _parities(own: np.ndarray) -> np.ndarray:
    """For each of the buckets of a map, whether an odd number of the shingles falls into it, as signed longs.

    Shingles of both sets cancel out, so two maps differ in at most as many bits as the sets do in shingles.
    """
    odd = np.bincount((own % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _prints(shingle: int, min_similarity: float, hot: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in set(words)), np.uint64)
                digests = _shingle_digests(words, shingle)
                shingles = _shingle_set(digests)
                cold, prefix = _prefix(shingles, min_similarity, hot, rank)
                rows.append((xxhash.xxh3_128_digest(b" ".join(words)), _signed(fingerprint(own)), *_wide_fingerprint(digests), len(shingles), cold, prefix.view(np.int64), _parities(shingles)))
            same, fp, wide0, wide1, n, cold, *lists = zip(*rows, strict=True)
            longs, ints = [pa.array(x, pa.int64()) for x in (fp, wide0, wide1)], [pa.array(x, pa.int32()) for x in (n, cold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), *longs, *ints, *(pa.array(list(x), pa.list_(pa.int64())) for x in lists)], ["row", "same", "fp", "wide0", "wide1", "n", "cold", "prefix", "map"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingle_set(_shingle_digests((t or b"").lower().split(), shingle)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def wide_radius(min_similarity: float) -> int:
    """Bits that two 128-bit fingerprints of sets with this similarity differ in, with 1.4 standard deviations on top.

    Of pairs with exactly this similarity some nine in ten lie within it, and of closer ones nearly all.
    """
    p = math.acos(2 * min_similarity / (1 + min_similarity)) / math.pi
    return int(128 * p + 1.4 * math.sqrt(128 * p * (1 - p)))


def hot_shingles(slim: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts of a sample hold, sorted, and their ranks by that number; what is found only speeds up."""
    sample = slim.where(F.pmod(F.col("row.th"), F.lit(SAMPLE)) == 0).select("row.th", "text").mapInArrow(_sets(shingle), "id long, shingles array<long>")
    counts = sample.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= HOT_COUNT)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(HOT_SHINGLES).collect()
    rank = {r["shingle"]: i for i, r in enumerate(reversed(rows), 1)}
    hot = np.array(list(rank), np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], np.array(list(rank.values()), np.int64)[order]


def similar_links(slim: DataFrame, rows: DataFrame, pairs: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets of shingles have the similarity, from all their shingles.

    ``rows`` (id, row) tells which row of ``slim`` has a node's text; rows that are equal there give it once.
    """
    asked = rows.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi")
    texts = slim.join(asked.withColumnRenamed("row", "own"), F.col("row") == F.col("own")).select("id", "text").dropDuplicates(["id"])
    known = materialize(texts.mapInArrow(_sets(shingle), "id long, shingles array<long>"), "dedup-sets")
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(known.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= F.lit(min_similarity) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def _may_reach(min_similarity: float) -> Column:
    """Whether posts ``x`` and ``y`` of one shingle, if it is the first that two sets share, leave room for the similarity."""
    n, m = F.col("x.n"), F.col("y.n")
    room = F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    return (F.least(n, m) >= F.greatest(n, m) * min_similarity - 1e-9) & (room >= (n + m) * (min_similarity / (1 + min_similarity)) - 1e-9)


def _close_maps(pairs: DataFrame, maps: DataFrame, min_similarity: float) -> DataFrame:
    """The ``pairs`` without those that cannot reach the similarity, as the maps of their texts (id, n, map) differ in too many bits."""
    x, y = (maps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"m{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("ma", "mb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    most = (F.col("na") + F.col("nb")) * ((1 - min_similarity) / (1 + min_similarity)) + 1e-9
    return pairs.join(x, "a").join(y, "b").where(apart <= most).select("a", "b").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text): a row's id and a hash of its text tell it from all others but those that are equal in both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th")).alias("row"), text.alias("text"))


def near_duplicate_rows(docs: DataFrame, *, shingle: int = 5, min_similarity: float = 0.8, radii: Sequence[int] = RADII, parts: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, keep), each once: the rows (doc_id, hash of the text) whose group has several, and which one of them stays.

    A group is a connected component of all pairs whose ``shingle``-word sets have a similarity of at least
    ``min_similarity``; the row with the smallest id stays (no id counts as the largest; then the smallest hash of the text).
    Texts with the same words in the same order are one node. Lookups of fingerprints of the distinct words, in widening
    radii, each over one text of each group so far, join most of a group cheaply. What they miss is found by a join over the
    prefixes of all texts' shingles, of which only pairs of different groups are compared; every link is verified from all
    shingles. Hot shingles are first compared with the text that has most of them.
    """
    slim = _keyed(docs, id_col, text_col)
    hot, rank = hot_shingles(slim, shingle)
    kind = slim.schema["row"].dataType["doc_id"].dataType.simpleString()
    prints = slim.mapInArrow(_prints(shingle, min_similarity, hot, rank), PRINTS.format(id="doc_id", type=kind))
    prints = materialize(prints.withColumn("id", F.monotonically_increasing_id()), "dedup-prints")  # a row's number, from here on
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("row.th"))
    firsts = prints.groupBy("same").agg(F.min("id").alias("id"), F.min(order).alias("first"), F.count("*").alias("rows"), *[F.min(c).alias(c) for c in ("fp", *WIDE)])
    firsts = materialize(firsts, "dedup-nodes")
    own = prints.select("id", "row", "n", "cold", "prefix", "map").join(firsts.select("id"), "id", "left_semi")
    rows, maps = own.select("id", "row"), own.select("id", "n", "map")
    stars = docs.sparkSession.createDataFrame([], "a long, b long")

    def joined(stars: DataFrame, pairs: DataFrame) -> DataFrame:
        """(a, b): each text of a group but the first, and the first, with the similar ones of ``pairs``."""
        with temporary_tables(docs.sparkSession):
            links = stars.unionByName(similar_links(slim, rows, pairs, shingle, min_similarity))
            stars = connected_components(links).where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            return materialize(stars, "dedup-stars", keep=True)

    nodes = firsts.select("id", "fp", *WIDE)
    for radius in radii:
        left = nodes.join(stars.select(F.col("a").alias("id")), "id", "left_anti")
        stars = joined(stars, materialize(hamming_links(left, radius, parts, also=WIDE, also_radius=wide_radius(min_similarity)), "dedup-pairs"))

    def posts(stars: DataFrame) -> DataFrame:
        of = own.select("id", "n", "cold", "prefix").join(stars.select(F.col("a").alias("id"), "b"), "id", "left").withColumn("of", F.coalesce("b", "id"))
        return of.select("id", "of", "n", "cold", F.posexplode("prefix").alias("pos", "shingle"))

    rare = F.lit(True)
    if len(hot):
        few = materialize(posts(stars).where("pos >= cold"), "dedup-hot-posts")
        heads = few.groupBy("shingle").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.min(F.struct(F.expr("cold / n").alias("rest"), "id", "of", "n", "pos")).alias("head")).where("lo != hi")
        heads = heads.select("shingle", "head.id", "head.of", "head.n", "head.pos").alias("x")
        pairs = heads.join(few.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.of") != F.col("y.of")) & _may_reach(min_similarity))
        pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        stars = joined(stars, materialize(_close_maps(pairs, maps, min_similarity), "dedup-pairs"))
        few = few.join(stars.select(F.col("a").alias("id"), F.col("b").alias("now")), "id", "left").withColumn("of", F.coalesce("now", "of"))
        mixed = few.groupBy("shingle").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo != hi").select("shingle")
        few = few.join(mixed, "shingle", "left_semi").select("id", "of", "n", "pos", "shingle")
        rare = F.col("pos") < F.col("cold")

    def across(posts: DataFrame) -> DataFrame:
        x, y = posts.alias("x"), posts.alias("y")
        near = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.of") != F.col("y.of")) & _may_reach(min_similarity)
        return x.join(y, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    pairs = across(posts(stars).where(rare).select("id", "of", "n", "pos", "shingle"))
    if len(hot):
        pairs = pairs.unionByName(across(few))
    stars = joined(stars, materialize(_close_maps(pairs.distinct(), maps, min_similarity), "dedup-pairs"))

    groups = stars.withColumnRenamed("a", "id").withColumnRenamed("b", "group").unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("group")).distinct())
    several = firsts.join(groups, "id", "left").where("group is not null or rows > 1").select("same", F.coalesce("group", "id").alias("group"), "first")
    several = materialize(several, "dedup-groups")
    stays = several.select("same", "group").join(several.groupBy("group").agg(F.min("first").alias("first")), "group").select("same", "first")
    judged = prints.select("row", "same", order.alias("own")).join(stays, "same").select("row", (F.col("own") == F.col("first")).alias("keep"))
    return judged.groupBy("row").agg(F.max("keep").alias("keep"), F.count("*").alias("rows"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; columns as before.

    Of rows that are equal in id and text, too, one stays: the one whose other columns have the smallest hash. Rows that are
    alone in their group do not move.
    """
    judged = near_duplicate_rows(docs, id_col=id_col, text_col=text_col, **options).select(F.col("row").alias("judged"), "keep", F.col("rows").alias("equal"))
    judged = materialize(judged, "dedup-judged")
    touched = among(judged.select(F.xxhash64("judged").alias("h")))(F.xxhash64("own"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th")).alias("own"))
    alone, rows = rows.where(~touched), rows.where(touched)
    rows = rows.join(judged, F.col("own") == F.col("judged"), "left").where("judged is null or keep")
    once = rows.where("equal > 1").groupBy("own").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return alone.select("row").unionByName(rows.where("equal is null or equal = 1").select("row")).unionByName(once.select("row")).select("row.*")
