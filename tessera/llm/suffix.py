"""Removal of repeated byte strings by per-shard suffix arrays.

Each byte goes that is covered by a string of ``LENGTH`` bytes (a window) that
also starts earlier: in a document of smaller id, or earlier in the same one.
Windows are judged on the input, not on what is left.

1. Anchors. A window's anchor is its leftmost 24-gram of smallest hash, so equal
   windows have equal anchors; consecutive windows share one, which leaves one row
   per about 39 bytes. A task marks what it sees twice; the first of each kind
   meets those of other tasks by hash. Windows of unrepeated anchors can't repeat.
2. Shards. Documents meet their repeated anchors; up to ``SHARD_BYTES`` of the
   passages around these form a shard. Its suffix array is refined in the manner
   of Larsson and Sadakane (groups of equal prefixes, sorted by the rank of what
   follows, twice as deep each round, unsorted groups only); common prefixes follow
   by Kasai's rule that a position's differs by one from its predecessor's if
   their neighbours are in step. Neighbours that share ``LENGTH`` bytes are equal
   windows; all but a shard's first are repeats.
3. Merging. A shard's first windows are sent on by anchor, as passages; digests
   of the windows of all shards are sorted, and each window looks up the earliest
   equal one by binary search. Anchors with more than ``HOT`` places send digests of
   windows instead, by digest: a passage that a third of all documents have is then
   one row per shard.

Defined cases: null and empty texts have nothing to remove, nor have texts
shorter than LENGTH; very long texts are one row and their passages are dealt to shards like
others'; null ids come last; rows of one id are ordered by text, equal
rows being copies like others; an empty table gives an empty result. In
``cleaned`` characters that lose only some of their bytes stay, so that texts
stay valid. Columns of other names can't clash: they travel in one struct.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import shelve, small_batches
from tessera.llm.rawtext import BYTE_VALUES, U64, mix64, text_bytes

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams in a window, and most windows of an anchor
BITS = 7
HOT = 4096
SHARD_BYTES = 2 << 20
FLUSH_ANCHORS = 1 << 20
LAST = (1 << 63) - 1
BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
CONTEXT, WINDOW, REPEAT = range(3)


def gram_hashes(buf: np.ndarray, lengths: tuple[int, ...], base: np.uint64) -> np.ndarray:
    """Polynomial hashes of the strings of sum(lengths) bytes at each position; ``lengths`` are powers of two."""
    value, n, known = BYTE_VALUES[buf], 1, {}
    power = base
    while True:
        if n in lengths:
            known[n] = (value, power)
        if n >= max(lengths):
            break
        value = value[: len(value) - n] * power + value[n:] if len(value) > n else value[:0]
        power = power * power
        n *= 2
    total = None
    size = max(len(buf) - sum(lengths) + 1, 0)
    at = 0
    for m in lengths:
        v, p = known[m]
        part = v[at : at + size]
        total = part if total is None else total * p + part
        at += m
    return total


def anchors(buf: np.ndarray, off: np.ndarray):
    """For each run of windows with one anchor: text, first window (in the text), windows less one, hash."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none, none
    with np.errstate(over="ignore"):
        h = mix64(gram_hashes(buf, (16, 8), BASES[0]))
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    n, least = 1, low
    while n * 2 <= SPAN:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    if SPAN > n:
        least = np.minimum(least[: len(least) - (SPAN - n)], least[SPAN - n :])
    # least[p]: of the window at p. Windows that cross texts are left out.
    text = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - LENGTH + 1, 0))
    count = np.bincount(text, minlength=len(off) - 1)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][text]
    at = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(at)))
    t = text[first]
    return t, start[first] - off[:-1][t], runs - 1, h[at[first]].view(np.int64)


def _anchor_batches(batches):
    held: list[tuple] = []
    size = 0

    def flush():
        k, part, at, h = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, part, k, h))
        k, part, at, h = k[order], part[order], at[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        copies = np.where(new, np.repeat(n, n), 0)
        spread = mix64(k.view(U64) * BASES[0] + at.view(U64)).view(np.int64)
        route = np.where(new, h, spread)
        names = ["route", "k", "part", "at", "h", "copies"]
        for i in range(0, len(h), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (route, k, part, at, h, copies.astype(np.int32))], names)

    for b in batches:
        buf, off = text_bytes(b.column(2))
        t, lo, more, h = anchors(buf, off)
        if len(t):
            held.append((b.column(0).to_numpy()[t], b.column(1).to_numpy()[t].astype(np.int32), lo << BITS | more, h))
            size += len(t)
        if size >= FLUSH_ANCHORS:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _leading(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros behind the last), and from the end on, as numbers that sort like them."""
    key, n = np.concatenate([buf, np.zeros(8, np.uint8)]), 1
    while n < 8:
        wide = key.astype(f"u{2 * n}")
        key = wide[:-n] << wide.dtype.type(8 * n) | wide[n:]
        n *= 2
    return key


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least their first ``depth`` bytes (by all of them where that decides earlier)."""
    n = len(buf)
    key = _leading(buf)[:n]
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    # Ends of text: shorter suffixes first, and so apart from those with true zeros.
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        # Places in the array that belong to groups of two or more.
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        pos = sa[at]
        follow = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        key = rank[pos].astype(U64) << U64(32) | follow.astype(U64)
        order = np.argsort(key, kind="stable")
        sa[at] = pos[order]
        key = key[order]
        split = np.ones(len(at), bool)
        split[1:] = key[1:] != key[:-1]
        new[at] |= split
        rank[sa[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        h *= 2
    return sa


def common_prefixes(buf: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Per place in ``sa``, the bytes shared with the place before; at least min(true, cap), at most the true value.

    Kasai's rule in vector form: where the neighbour of p + 1 is the successor of p's
    neighbour, p shares one byte more than p + 1 does. Only the ends of such chains
    are compared byte by byte.
    """
    n = len(buf)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    chain = np.zeros(n, bool)  # p goes on in p + 1
    if n > 1:
        step = np.flatnonzero((phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0))
        chain[step] = buf[step] == buf[phi[step]]
    live = np.flatnonzero(~chain & (phi >= 0))
    other, got = phi[live], 0
    words = _leading(np.concatenate([buf, np.zeros(cap + 8, np.uint8)]))
    length = np.zeros(n, np.int64)
    while len(live) and got < cap:
        apart = words[live + got] ^ words[other + got]
        lead = np.zeros(len(live), np.int64)
        for bits in range(56, -1, -8):
            lead += apart < U64(1 << bits)
        lead = np.minimum(lead, np.maximum(n - got - np.maximum(live, other), 0))
        length[live] += lead
        on = lead == 8
        live, other = live[on], other[on]
        got += 8
    # Back from each end along its chain.
    end = np.where(chain, n, np.arange(n))
    end = np.minimum.accumulate(end[::-1])[::-1]
    plcp = length[np.minimum(end, n - 1)] + (end - np.arange(n))
    plcp[phi < 0] = 0
    return plcp[sa]


def first_of_equal(buf: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each position, the first valid position with the same LENGTH bytes (itself where it isn't valid)."""
    n = len(buf)
    sa = suffix_array(buf, LENGTH)
    lcp = common_prefixes(buf, sa, LENGTH + 8)
    group = np.cumsum(lcp < LENGTH) - 1 if n else np.zeros(0, np.int64)
    ok = valid[sa]
    least = np.full(int(group[-1]) + 1 if n else 0, n, np.int64)
    np.minimum.at(least, group[ok], sa[ok])
    out = np.arange(n)
    out[sa[ok]] = least[group[ok]]
    return out


def window_digests(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window."""
    with np.errstate(over="ignore"):
        return tuple(mix64(gram_hashes(buf, (64, 32, 4), b)).view(np.int64) for b in BASES)


def _ragged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _runs(flag: np.ndarray, key: np.ndarray):
    """Begin and length of each run of set flags within equal keys."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (key[on[1:]] != key[on[:-1]])
    first = np.flatnonzero(new)
    return on[first], np.diff(np.append(first, len(on)))


#: What hardly changes between rows comes first and together, which shuffles well compressed.
_FOUND = ["kind", "part", "n", "k", "lo", "route", "two", "data"]
FOUND_SCHEMA = "kind int, part int, n int, k long, lo long, route long, two long, data binary"


def _found(kind, route, k, part, lo, n, data=None, two=None) -> pa.RecordBatch:
    m = len(lo)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m, kind, np.int32)),
            pa.array(np.asarray(part, np.int32)),
            pa.array(np.asarray(n, np.int32)),
            pa.array(np.asarray(k, np.int64)),
            pa.array(np.asarray(lo, np.int64)),
            pa.array(np.asarray(route, np.int64)),
            pa.array(np.asarray(two, np.int64)) if two is not None else pa.array(np.zeros(m, np.int64)),
            data if data is not None else pa.nulls(m, pa.binary()),
        ],
        _FOUND,
    )


def _binary(buf: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[_ragged(starts, n)]))])


def shard(rows: list[tuple]):
    """Batches of FOUND from documents (k, part, bytes, first windows, windows less one, hashes, hot), in order of (k, part)."""
    pieces, where = [], []
    seen = None
    for r in sorted(rows, key=lambda r: r[:2]):
        if r[:2] == seen:  # the same row twice
            continue
        seen = r[:2]
        where.append(r)
    if not where:
        return
    # The passages of the anchors, one behind the other; ``base`` is each anchor's place there.
    doc, lo, more, h, hot, base, size = [], [], [], [], [], [], 0
    for i, (_, _, data, first, extra, hashes, is_hot) in enumerate(where):
        data = np.frombuffer(data, np.uint8)
        order = np.argsort(first, kind="stable")
        first, extra, hashes, is_hot = first[order], extra[order], hashes[order], is_hot[order]
        new = np.ones(len(first), bool)
        new[1:] = first[1:] > first[:-1] + extra[:-1] + 1  # windows that don't go on form a new passage
        cut = np.flatnonzero(new)
        begin = first[cut]
        end = np.append((first + extra + LENGTH)[cut[1:] - 1], (first + extra + LENGTH)[-1])
        at = size + np.cumsum(end - begin) - (end - begin)
        passage = np.cumsum(new) - 1
        pieces += [data[x:y] for x, y in zip(begin, end)]
        base.append(at[passage] + first - begin[passage])
        size += int((end - begin).sum())
        doc.append(np.full(len(first), i))
        lo.append(first)
        more.append(extra)
        h.append(hashes)
        hot.append(is_hot)
    buf = np.concatenate(pieces)
    doc, lo, more, h, hot, base = (np.concatenate(x) for x in (doc, lo, more, h, hot, base))
    k = np.array([r[0] for r in where], np.int64)[doc]
    part = np.array([r[1] for r in where], np.int32)[doc]
    valid = np.zeros(size, bool)
    owner = np.full(size, -1, np.int64)
    at = _ragged(base, more + 1)
    valid[at] = True
    owner[at] = np.repeat(np.arange(len(base)), more + 1)
    first = first_of_equal(buf, valid)
    late = valid & (first < np.arange(size))
    run_at, run_n = _runs(late, owner)
    o = owner[run_at]
    yield _found(REPEAT, mix64(run_at.view(U64) + k[o].view(U64)).view(np.int64), k[o], part[o], lo[o] + run_at - base[o], run_n)
    # Windows that are the shard's first, per anchor from the first such to the last.
    early = np.flatnonzero(valid & ~late)
    if not len(early):
        return
    o = owner[early]
    new = np.ones(len(o), bool)
    new[1:] = o[1:] != o[:-1]
    begin = early[new]
    end = early[np.append(np.flatnonzero(new)[1:], len(early)) - 1]
    o = o[new]
    cold = ~hot[o]
    b, e, c = begin[cold], end[cold], o[cold]
    yield _found(CONTEXT, h[c], k[c], part[c], lo[c] + b - base[c], e - b + 1, _binary(buf, b, e - b + LENGTH))
    at = early[hot[owner[early]]]
    if len(at):
        one, two = window_digests(buf)
        for i in range(0, len(at), 50_000):
            p = at[i : i + 50_000]
            c = owner[p]
            yield _found(WINDOW, one[p], k[c], part[c], lo[c] + p - base[c], np.ones(len(p)), two=two[p])


def _shard_batches(batches):
    held, size = [], 0
    for b in batches:
        ks, parts, texts, lists = (b.column(i) for i in range(4))
        some = np.flatnonzero(np.asarray(lists.is_valid()))
        if not len(some):
            continue
        buf, off = text_bytes(texts)
        data = buf.tobytes()
        ends = lists.offsets.to_numpy()
        flat = lists.values.flatten()  # of structs: the fields
        lp, lat, lh, lhot = (f.to_numpy(zero_copy_only=False) for f in flat)
        for i in some.tolist():
            s = slice(ends[i], ends[i + 1])
            mine = lp[s] == parts[i].as_py()
            if not mine.any():
                continue
            at = lat[s][mine]
            first, extra = at >> BITS, at & ((1 << BITS) - 1)
            held.append((ks[i].as_py(), parts[i].as_py(), data[off[i] : off[i + 1]], first, extra, lh[s][mine], lhot[s][mine].astype(bool)))
            size += int((extra + SPAN).sum())
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
    if held:
        yield from shard(held)


def merge(route, k, part, lo, n, kind, second, data: pa.Array):
    """Repeats among the windows of several shards: k, part, lo of each, none of them the earliest of its kind."""
    # In order of documents and places; so are their windows then, and of equal ones the earliest comes first.
    rows = np.lexsort((lo, part, k))
    route, k, part, lo, n, kind, second = (x[rows] for x in (route, k, part, lo, n, kind, second))
    data = data.take(pa.array(rows))
    ctx = kind == CONTEXT
    cols = []
    if ctx.any():
        buf, off = text_bytes(data.filter(pa.array(ctx)))
        m = n[ctx].astype(np.int64)
        one, two = window_digests(buf)
        at = _ragged(off[:-1], m)
        within = at - np.repeat(off[:-1], m)
        rep = np.repeat(np.flatnonzero(ctx), m)
        cols.append((one[at], two[at], k[rep], part[rep], lo[rep] + within))
    if (~ctx).any():
        cols.append((route[~ctx], second[~ctx], k[~ctx], part[~ctx], lo[~ctx]))
    one, two, k, part, lo = (np.concatenate(x) for x in zip(*cols))
    # What is alone with half its digest has no equal.
    order = np.argsort(one, kind="stable")
    same = one[order[1:]] == one[order[:-1]]
    order = order[np.append(same, False) | np.append(False, same)]
    one, two, k, part, lo = (x[order] for x in (one, two, k, part, lo))
    order = np.lexsort((two, one))
    so, st = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (so[1:] != so[:-1]) | (st[1:] != st[:-1])
    heads = order[new]
    # Digests of the earliest windows, ascending; each window finds its own by binary search.
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    table = np.empty(len(heads), pair)
    table["a"], table["b"] = one[heads], two[heads]
    spot = np.searchsorted(table["a"], one)
    while True:  # equal first halves are all but unheard of
        wrong = (table["a"][spot] == one) & (table["b"][spot] != two)
        if not wrong.any():
            break
        spot[wrong] += 1
    e = heads[spot]
    late = (k[e] != k) | (part[e] != part) | (lo[e] != lo)
    return k[late], part[late], lo[late]


def _merge_batches(batches):
    held, size = [], 0
    last = None

    def flush(t: pa.Table):
        t = t.combine_chunks()
        cols = [t.column(c).to_numpy() for c in ("route", "k", "part", "lo", "n", "kind", "two")]
        data = t.column("data").combine_chunks()
        if isinstance(data, pa.ChunkedArray):
            data = data.chunk(0) if data.num_chunks else pa.array([], pa.binary())
        k, part, lo = merge(*cols, data)
        order = np.lexsort((lo, part, k))
        k, part, lo = k[order], part[order], lo[order]
        new = np.ones(len(lo), bool)
        new[1:] = (k[1:] != k[:-1]) | (part[1:] != part[:-1]) | (lo[1:] > lo[:-1] + 1)
        first = np.flatnonzero(new)
        end = lo[np.append(first[1:], len(lo)) - 1] if len(lo) else lo
        return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(part[first].astype(np.int32)), pa.array(lo[first]), pa.array((end - lo[first] + 1).astype(np.int32))], ["k", "part", "lo", "n"])

    for b in batches:
        kind = b.column(0).to_numpy()
        done = kind == REPEAT
        if done.any():
            yield b.filter(pa.array(done)).select(["k", "part", "lo", "n"])
        b = b.filter(pa.array(~done))
        if not len(b):
            continue
        route = b.column(5).to_numpy()
        # All rows of a route go together: cut before this batch's last route.
        if held and size >= SHARD_BYTES:
            cut = int(np.searchsorted(route != last, True))
            if cut < len(route):
                held.append(b.slice(0, cut))
                yield flush(pa.Table.from_batches(held))
                held, size = [], 0
                b, route = b.slice(cut), route[cut:]
        held.append(b)
        size += b.column(7).nbytes + 40 * len(b)
        last = int(route[-1])
    if held:
        yield flush(pa.Table.from_batches(held))


def _base(docs: DataFrame) -> DataFrame:
    """_k (null ids last), _part (the place among rows of one id), text, and the row itself."""
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row")
    k = F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("_k")
    df = docs.select(k, F.coalesce("text", F.lit("")).alias("_text"), row)
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return df.select("_k", F.lit(0).alias("_part"), "_text", "_row")
    part = F.row_number().over(Window.partitionBy("_k").orderBy("_text")) - 1
    return df.select("_k", part.cast("int").alias("_part"), "_text", "_row")


def repeats(base: DataFrame) -> DataFrame:
    """k and, per row, the list of (part, lo, n): n windows from byte lo on are repeats. ``base`` comes from ``_base``."""
    small_batches(base.sparkSession)
    found = base.select("_k", "_part", "_text").mapInArrow(_anchor_batches, "route long, k long, part int, at long, h long, copies int")
    # A route is either an anchor's hash, with one row per task, or a number of its own.
    same = Window.partitionBy("route")
    found = found.withColumn("rows", F.count(F.lit(1)).over(same)).withColumn("total", F.sum("copies").over(same))
    again = shelve(found.filter("rows > 1 OR copies != 1").select("h", "k", "part", "at", F.when(F.col("copies") > 0, F.col("total")).alias("total")))
    hot = shelve(again.filter(F.col("total") > HOT).select(F.col("h").alias("hot_h")).distinct())
    marked = again.join(hot, again["h"] == hot["hot_h"], "left").select("k", F.struct("part", "at", "h", F.col("hot_h").isNotNull().alias("hot")).alias("x"))
    lists = marked.groupBy("k").agg(F.collect_list("x").alias("list"))
    # A left join, and all columns: so this and the last join can use one exchange of the texts.
    df = base.join(lists, base["_k"] == lists["k"], "left").select("_k", "_part", "_text", "list", "_row")
    shards = df.mapInArrow(_shard_batches, FOUND_SCHEMA)
    merged = shards.repartition("route").sortWithinPartitions("route").mapInArrow(_merge_batches, "k long, part int, lo long, n int")
    return merged.groupBy("k").agg(F.collect_list(F.struct("part", "lo", "n")).alias("spans"))


def _covered(n_bytes: int, part: int, spans) -> np.ndarray:
    """Which bytes of a text go."""
    edge = np.zeros(n_bytes + 1, np.int32)
    for s in spans or ():
        if s["part"] == part:
            edge[s["lo"]] += 1
            edge[min(n_bytes, s["lo"] + s["n"] - 1 + LENGTH)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_spans(base: DataFrame) -> DataFrame:
    spans = repeats(base)
    return base.join(spans, base["_k"] == spans["k"], "left").select("_k", "_part", "_text", "spans", "_row")


def _removal_batches(batches):
    for b in batches:
        rows = []
        for part, text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            data = text.encode()
            if not spans:
                rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            gone = _covered(len(data), part, spans)
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((len(data), int(gone.sum()), n_spans, hashlib.sha256(rest).hexdigest()))
        cols = [list(c) for c in zip(*rows)] or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(4).field("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of ``docs``."""
    base = _base(docs.select("doc_id", "text"))
    return _with_spans(base).mapInArrow(_removal_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _clean_batches(batches):
    for b in batches:
        texts = []
        for part, text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if spans:
                data = np.frombuffer(text.encode(), np.uint8)
                gone = _covered(len(data), part, spans)
                char = np.cumsum((data & 0xC0) != 0x80) - 1
                stays = np.bincount(char[~gone], minlength=int(char[-1]) + 1) > 0
                text = data[stays[char]].tobytes().decode()
            texts.append(text)
        row = b.column(4)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), row], ["_text", "_row"])


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what repeats cut out of their texts (null texts stay null)."""
    base = _base(docs.withColumn("_null", F.col("text").isNull()))
    row_type = base.schema["_row"].dataType.simpleString()
    df = _with_spans(base).mapInArrow(_clean_batches, f"_text string, _row {row_type}")
    text = F.when(~F.col("_row._null"), F.col("_text"))
    return df.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
