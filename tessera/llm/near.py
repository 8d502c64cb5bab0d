"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Words (between white space, A-Z lower-cased) make a set of shingles of ``shingle``
consecutive words; a shorter text is one shingle, a text without words has none.
Two permutations make all signature coordinates: the first sends a shingle to a
place in a ring of 2**22, the second, shifted by k along the ring, gives
coordinate k; so a shingle's coordinates are a contiguous slice of one table.
Coordinates are banded; documents that share a band are candidates.

Documents of one set (by a 128-bit digest) are one node, a number that is given once
and written down. Nodes of a bucket are tied to its smallest node; of its ties a node
keeps that to the smallest such node, which the others are tied to instead. Components
of these ties are clusters that no candidate pair leaves. A cluster is dealt out in
blocks of bounded size, each of which meets in one task with a few hubs of the
cluster; a node is verified on full sets against the nodes that share a band with it
and aren't yet in its component. A family of near copies so costs about one comparison
each, and no pairs are emitted. What isn't in a cluster's largest component after that
(strays) is compared with whatever shares a band with it, in bounded groups again.
Every candidate pair of different components is verified.

Defined cases: null and empty texts and those of white space alone have no
shingles, link with nothing and are kept; very long texts are one set like others and
are read whole; rows with the same doc_id and text are one document (all kept or all
not), rows with one id but different texts are judged by their texts; a null id is
larger than any other. ``one_of_each`` keeps one row of each group, also where ids
repeat or are null: of the rows of its least id the one of the least digest of the
set, then of the text, then the first as the table is read. An empty table gives an
empty result. Columns beside doc_id and text aren't read; ``one_of_each`` carries them
in one struct, so names can't clash.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shelve, small_batches, unshelve
from tessera.llm.graph import components
from tessera.llm.rawtext import LOWER, NOT_SPACE, U64, mix64, powers, span_hashes, text_bytes, word_spans

RING_BITS = 22
#: Hubs of a cluster (as a mean), nodes and shingles of a block, strays of a part and what is compared with them.
HUBS = 16
BLOCK_NODES, BLOCK_SHINGLES = 100, 1_500_000
STRAYS, OTHERS = 1000, 1000


@dataclass(frozen=True)
class Near:
    """Shingle words, the least similarity in percent, and how coordinates are banded.

    With 36 bands of 7, a pair of similarity 0.85 shares no band with probability
    1e-6; with 40 bands of 6, one of 0.8 with 5e-6.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


@functools.lru_cache(maxsize=2)
def ring(coordinates: int) -> np.ndarray:
    """The second permutation, as all its slices of ``coordinates`` values."""
    p = np.random.default_rng(20230601).permutation(1 << RING_BITS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: coordinates - 1]]), coordinates)


def shingle_sets(col, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    buf, off = text_bytes(col)
    starts, ends, first = word_spans(buf, off, NOT_SPACE)
    h = span_hashes(buf, starts, ends, LOWER)
    base = powers(k + 1, U64(0xC2B2AE3D27D4EB4F))
    rolled = np.zeros(max(len(h) - k + 1, 0), U64)
    for i in range(k):
        rolled += h[i : len(h) - k + 1 + i] * base[i + 1]
    rolled = mix64(rolled)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= k:
            out.append(np.unique(rolled[i : j - k + 1]))
        elif j > i:
            out.append(mix64((h[i:j] * base[1 : j - i + 1]).sum(keepdims=True) + U64(j - i)))
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    slices = ring(coordinates)
    at = (mix64(s ^ U64(0x5851F42D4C957F2D)) >> U64(64 - RING_BITS)).astype(np.int64)
    sig = np.full(coordinates, 1 << RING_BITS, np.int32)
    for i in range(0, len(at), 2048):
        np.minimum(sig, slices[at[i : i + 2048]].min(axis=0), out=sig)
    return sig


def band_keys(sig: np.ndarray, near: Near) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    rows = sig.reshape(near.bands, near.rows).astype(U64)
    base = powers(near.rows + 2)
    return mix64(rows @ base[1 : near.rows + 1] + np.arange(near.bands, dtype=U64) * U64(0xD6E8FEB86659FD93)).view(np.int64)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one = mix64(mix64(s + U64(1)).sum(keepdims=True) + U64(len(s)))
    two = mix64(mix64(s ^ U64(0xA0761D6478BD642F)).sum(keepdims=True) ^ U64(len(s)))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def signed(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, text, n_shingles, d1, d2 and bands of each row, the number ``rid`` of its own, and the other columns of ``docs``."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), near.shingle)
            bands = [band_keys(signature(s, near.coordinates), near) if len(s) else np.zeros(0, np.int64) for s in sets]
            cut = np.cumsum([0, *map(len, bands)])
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            digests = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d for d, _ in digests], pa.int64()),
                    pa.array([d for _, d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat)),
                ],
                [*b.schema.names, "n_shingles", "d1", "d2", "bands"],
            )

    schema = f"doc_id long, text string{', ' + fields if fields else ''}, n_shingles long, d1 long, d2 long, bands array<long>"
    return docs.select("doc_id", "text", *names).mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id())


class Forest:
    """Union-find over places in a group."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        if a == b:
            return False
        self.label[self.label == max(a, b)] = min(a, b)
        return True


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def resolve(nodes: np.ndarray, labels: np.ndarray, query: np.ndarray, bands: np.ndarray, texts, near: Near):
    """Links (pairs of nodes) that tie together what is similar, so far as it isn't tied by ``labels``.

    Only pairs with at least one node of ``query`` that share a band are looked at.
    """
    sets = shingle_sets(texts, near.shingle)
    forest = Forest(labels)
    links = []
    for i in np.flatnonzero(query):
        apart = np.flatnonzero(forest.label != forest.label[i])
        if not len(apart):
            continue
        # A query before this one has looked at this pair already.
        apart = apart[~(query[apart] & (apart < i))]
        shared = apart[(bands[apart] == bands[i]).any(axis=1)]
        for j in shared:
            if forest.label[i] != forest.label[j] and similar(sets[i], sets[j], near.percent):
                forest.join(i, j)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _resolver(near: Near):
    def flush(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, near.bands)
        links = resolve(t.column("node").to_numpy(), t.column("label").to_numpy(), np.array(t.column("query").to_pylist(), bool), bands, t.column("text").cast(pa.large_string()), near)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

    def run(batches):
        group, rows = None, []
        for b in batches:
            keys = list(zip(b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(7).to_pylist()))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != group and rows:
                    yield flush(rows)
                    rows = []
                group = keys[i]
                rows.append(b.slice(i, j - i).select(["node", "label", "query", "bands", "text"]))
                i = j
        if rows:
            yield flush(rows)

    return run


def _links(members: DataFrame, near: Near) -> DataFrame:
    """Links within each group (root, part, block) of members (node, label, query, bands, text)."""
    cols = ["node", "label", "query", "bands", "text", "root", "part", "block"]
    df = members.select(*cols).repartition("root", "part", "block").sortWithinPartitions("root", "part", "block", "node")
    return df.mapInArrow(_resolver(near), "u long, v long")


def _node_ties(nodes: DataFrame) -> DataFrame:
    """u, v: ties that connect all nodes that share a band, about one for each node that shares any.

    In each bucket the smallest node is the hub. A node is tied to the smallest of its
    hubs (itself included); that one is tied to the node's other hubs, and these pairs
    are few, since near copies have the same hubs.
    """
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = shelve(hubs.select(F.col("key").alias("k"), "hub"))  # written, so that the join can split a key with very many nodes
    own = keys.join(hubs, keys["key"] == hubs["k"]).groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    own = own.withColumn("least", F.array_min("hubs")).filter("size(hubs) > 1 OR least != node")
    pairs = F.concat(F.array(F.struct(F.col("node").alias("u"), F.col("least").alias("v"))), F.transform(F.array_remove("hubs", F.col("least")), lambda h: F.struct(h.alias("u"), F.col("least").alias("v"))))
    # Only the first pair names the node itself; near copies have the others in common.
    ties = shelve(own.select(F.explode(pairs).alias("x")).select("x.*").filter("u != v").distinct())
    unshelve(hubs)
    return ties


def _strays(member: DataFrame, links: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Links of the nodes of large clusters that aren't in the largest component with what shares a band with them."""
    found = components(links)
    placed = member.select("node", "root").join(found.select(F.col("node").alias("_n"), F.col("root").alias("found")), F.col("node") == F.col("_n"), "left")
    placed = shelve(placed.select("node", "root", F.coalesce("found", "node").alias("label")))
    counts = placed.groupBy("root", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    main = shelve(main.filter("most < all").select(F.col("root").alias("_root"), "main", F.ceil((F.col("all") - F.col("most")) / STRAYS).alias("parts")))
    if main.isEmpty():
        unshelve(found, placed, main)
        return links
    placed = placed.join(main, F.col("root") == F.col("_root"))
    own = F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    placed = shelve(placed.select("node", "root", "label", own.alias("own")))
    bands = nodes.select(F.col("node").alias("_n"), "bands")
    keyed = placed.join(bands, F.col("node") == F.col("_n")).select("node", "root", "own", F.explode("bands").alias("key"))
    asked_keys = shelve(keyed.filter("own IS NOT NULL").select(F.col("key").alias("k"), F.col("own").alias("part")).distinct())
    need = keyed.join(asked_keys, F.col("key") == F.col("k")).filter("own IS NULL OR own != part").select("node", "root", "part").distinct()
    need = shelve(need)
    wide = shelve(need.groupBy("root", "part").agg(F.ceil(F.count(F.lit(1)) / OTHERS).cast("int").alias("wide")).withColumnRenamed("root", "_r").withColumnRenamed("part", "_p"))
    sized = (F.col("root") == F.col("_r")) & (F.col("part") == F.col("_p"))
    others = need.join(wide, sized).select("node", "part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("wide")).cast("int").alias("block"), F.lit(False).alias("query"))
    asked = placed.filter("own IS NOT NULL").withColumn("part", F.col("own")).join(wide, sized, "left")
    asked = asked.select("node", "part", F.explode(F.sequence(F.lit(0), F.coalesce("wide", F.lit(1)) - 1)).alias("block"), F.lit(True).alias("query"))
    asked = asked.unionByName(others)
    with_label = placed.select("node", "root", "label")
    whole = asked.join(with_label, "node").join(member.select("node", "bands", "text"), "node")
    out = shelve(links.unionByName(_links(whole, near)))
    unshelve(found, placed, main, asked_keys, need, wide)
    return out


def _classed(sig: DataFrame, near: Near) -> DataFrame:
    """class and component_id for each set (d1, d2) of ``sig``, a table that ``signed`` made."""
    some = sig.filter("n_shingles > 0")
    # One row per set, with a number, the least id that has it and the row that stands for it.
    nodes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = shelve(nodes.withColumn("node", F.monotonically_increasing_id()))
    ties = _node_ties(nodes)
    clusters = components(ties)
    member = clusters.join(nodes.select(F.col("node").alias("_n"), "rid", "n", "bands"), F.col("node") == F.col("_n")).drop("_n")
    sizes = clusters.join(nodes.select(F.col("node").alias("_n"), "n"), F.col("node") == F.col("_n")).groupBy("root").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_NODES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size")
    )
    sizes = shelve(sizes.withColumnRenamed("root", "_root"))
    # A merge join at every size: both sides grow with the documents, and rows stand for one set each.
    texts = sig.select(F.col("rid").alias("_rid"), "text").hint("merge")
    member = member.join(texts, F.col("rid") == F.col("_rid")).join(sizes, F.col("root") == F.col("_root"))
    member = shelve(member.select("node", "root", "blocks", "size", "bands", "text"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    # Hubs of a large cluster go to all its blocks: those whose hash falls into a share of HUBS / size.
    share = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    hub = (F.col("blocks") > 1) & (share * F.col("size") < HUBS)
    block = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    dealt = member.select("node", F.col("node").alias("label"), F.lit(True).alias("query"), "bands", "text", "root", F.lit(0).alias("part"), block.alias("block"))
    links = shelve(_links(dealt, near))
    large = member.filter("blocks > 1")
    if not large.isEmpty():
        links = _strays(large, links, nodes, near)
    tied = components(links)
    # Classes of several sets: the least id of each.
    least = tied.join(nodes.select(F.col("node").alias("_n"), "rep"), F.col("node") == F.col("_n")).groupBy(F.col("root").alias("class")).agg(F.min("rep").alias("component_id"))
    least = shelve(least)
    tied_to = shelve(tied.join(least, F.col("root") == F.col("class")).select(F.col("node").alias("_n"), "class", "component_id"))
    named = nodes.select("d1", "d2", "node", "rep").join(tied_to, F.col("node") == F.col("_n"), "left")
    named = shelve(named.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("class", "node").alias("class"), F.coalesce("component_id", "rep").alias("component_id")))
    unshelve(nodes, ties, clusters, sizes, member, links, tied, least, tied_to)
    return named


def classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    sig = shelve(signed(docs.select("doc_id", "text"), near))
    named = _classed(sig, near)
    some = sig.filter("n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2")
    df = some.join(named, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))).select("doc_id", "n_shingles", "component_id")
    df = df.unionByName(sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return df.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each group, with its own columns; rows without shingles that repeat stand once."""
    # The text travels once, the other columns beside it in a struct (of a constant, where there are none).
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*(rest or [F.lit(0).alias("none")])).alias("_row")
    sig = shelve(signed(docs.select("doc_id", "text", row), near))
    named = _classed(sig, near)
    some = sig.filter("n_shingles > 0").select("doc_id", "d1", "d2", "rid", F.xxhash64("text").alias("h"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2", "h", "rid")
    first = some.join(named, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))).groupBy("class").agg(F.min(order)["rid"].alias("_rid"))
    blank = sig.filter("n_shingles = 0").groupBy("doc_id", "text").agg(F.min("rid").alias("_rid"))
    kept = shelve(first.select("_rid").unionByName(blank.select("_rid"))).hint("merge")
    df = sig.select("rid", "doc_id", "text", "_row").join(kept, F.col("rid") == F.col("_rid"), "left_semi")
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])
