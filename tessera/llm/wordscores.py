"""Language-model scores by cross-entropy difference, over all words of the corpus.

Two models of word pairs, one of the target documents and one of all documents, share
one vocabulary, which is every word that occurs: runs of letters and digits as they
are written, each other sign by itself, and each character of scripts without spaces
(from U+3000 on) by itself. Nothing is folded, cut off or left out, so the tables grow
with the corpus. Pairs are interpolated with words with weight ``MU``, and the
background's counts are scaled to the target's total, so that both models are smoothed
alike. A document's score is the mean over its words of target loss less background
loss (in nats); low means closer to the target.

Documents are dealt into chunks of about ``CHUNK`` words and kept as word hashes.
A chunk sends each of its words and pairs once, with both counts, to the block of the hash
space that it falls into; blocks sum the counts of all chunks and send them back. So
a frequent pair costs a block one entry per chunk, and only the totals of words and
vocabulary reach the driver. Words and pairs are named by 64-bit hashes.

Defined cases: null texts and texts without words have 0 tokens and null losses; very
long texts are a chunk of their own; rows with a null id are scored and belong to no
target; equal texts have equal scores; repeated rows count as often as they stand there; without target documents the target's model is uniform;
an empty table gives an empty result. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shelve, small_batches, unshelve
from tessera.llm.rawtext import ALNUM, BASE, NOT_SPACE, U64, mix64, span_hashes, text_bytes

MU = 64.0
CHUNK = 1 << 20
#: Blocks of the hash space: at least so many, and one for so many words.
BLOCKS, BLOCK_WORDS = 256, 1 << 22
SPACES, RUN, SINGLE, WIDE3, WIDE4, REST = range(6)
START = mix64(np.array([3], U64))[0]

_KINDS = np.where(ALNUM, RUN, np.where(NOT_SPACE, SINGLE, SPACES)).astype(np.uint8)
_KINDS[0xE3:0xEE] = WIDE3
_KINDS[0xF0:] = WIDE4


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in a row, and how many words each text has."""
    buf, off = text_bytes(col)
    kind = _KINDS[buf]
    for lead, rest in ((WIDE3, 2), (WIDE4, 3)):
        at = np.flatnonzero(kind == lead)
        for i in range(1, rest + 1):
            kind[(at + i)[at + i < len(kind)]] = REST
    first = np.zeros(len(buf), bool)
    first[off[:-1][off[:-1] < len(buf)]] = True
    before = np.zeros(len(buf), np.uint8)
    before[1:] = kind[:-1]
    begins = (kind == SINGLE) | (kind == WIDE3) | (kind == WIDE4) | ((kind == RUN) & (before != RUN)) | (first & (kind != SPACES))
    ends = kind != SPACES
    ends[:-1] &= begins[1:] | (kind[1:] == SPACES) | first[1:]
    starts = np.flatnonzero(begins)
    return span_hashes(buf, starts, np.flatnonzero(ends) + 1), np.diff(np.searchsorted(starts, off))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _chunk(ids: list, lengths: list, hashes: list) -> pa.RecordBatch:
    h = np.concatenate(hashes)
    words, at, count = np.unique(h, return_inverse=True, return_counts=True)
    # Frequent words come first, so that most places have a zero in the upper bytes.
    rare = np.zeros(len(words), np.int8)
    often = np.argsort(-count)
    rare[often[1 << 8 :]] += 1
    rare[often[1 << 16 :]] += 1
    order = np.argsort(rare, kind="stable")
    words, at = words[order], np.argsort(order)[at]
    row = [uuid.uuid4().hex, np.concatenate(ids).tolist(), np.concatenate(lengths).tolist(), len(words), pack(np.diff(words, prepend=U64(0))), pack(at)]
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["chunk", "ids", "lengths", "n_words", "words", "places"])


def _chunk_batches(batches):
    held, n = ([], [], []), 0
    for b in batches:
        if not b.num_rows:
            continue
        h, lengths = word_hashes(b.column(1))
        for to, x in zip(held, (np.array(b.column(0).to_pylist(), object), lengths, h)):
            to.append(x)
        n += len(h)
        if n >= CHUNK:
            yield _chunk(*held)
            held, n = ([], [], []), 0
    if held[0]:
        yield _chunk(*held)


def chunks(docs: DataFrame) -> DataFrame:
    """A row per chunk: its documents' ids and lengths, its distinct words, and which word stands at each place."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_chunk_batches, "chunk string, ids array<long>, lengths array<long>, n_words long, words binary, places binary")


def _keys(lengths: np.ndarray, n_words: int, words: bytes, places: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of a chunk's words, of the words before them and of the pairs, in order; and which key of each kind stands at each place. Keys of words are odd, others even."""
    n, m = int(lengths.sum()), n_words + 1
    w = np.cumsum(unpack(words, n_words))
    at = unpack(places, n).astype(np.int64)
    before = np.full(n, n_words)
    before[1:] = at[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = n_words
    pairs, pair_at = np.unique(before * m + at, return_inverse=True)
    contexts = mix64(np.append(w, START) + U64(1))
    even = U64(2**64 - 2)
    keys = np.concatenate([w | U64(1), contexts & even, mix64(contexts[pairs // m] * BASE + w[pairs % m]) & even])
    order = np.argsort(keys)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(keys))
    return keys[order], [rank[at], rank[n_words + before], rank[n_words + m + pair_at]]


def _lengths(values) -> np.ndarray:
    return np.array(values, np.int64)


def _block_batches(n_blocks: int):
    edges = np.array([(i << 64) // n_blocks for i in range(1, n_blocks)], U64)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lengths = _lengths(row["lengths"])
                keys, at = _keys(lengths, row["n_words"], row["words"], row["places"])
                flags = np.zeros(len(lengths), bool)
                flags[row["flags"] or []] = True
                is_target = np.repeat(flags, lengths)
                every = sum(np.bincount(x, minlength=len(keys)) for x in at)
                target = sum(np.bincount(x[is_target], minlength=len(keys)) for x in at)
                cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(row["chunk"], i, e - s, pack(np.diff(keys[s:e], prepend=U64(0))), pack(every[s:e]), pack(target[s:e])) for i, (s, e) in enumerate(zip(cut, cut[1:])) if e > s]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["chunk", "block", "n", "keys", "every", "target"])

    return run


def _sum_block(t: pa.Table) -> pa.Table:
    """The counts of all chunks for each key that a chunk sent, in the order in which it sent them."""
    n = t["n"].to_pylist()
    blobs = {c: t[c].to_pylist() for c in ("keys", "every", "target")}
    keys, at = np.unique(np.concatenate([np.cumsum(unpack(x, k)) for x, k in zip(blobs["keys"], n)]), return_inverse=True)
    cut, sums = np.concatenate([[0], np.cumsum(n)]), []
    for c in ("every", "target"):
        total = np.zeros(len(keys), np.int64)
        for i, (x, k) in enumerate(zip(blobs[c], n)):
            total[at[cut[i] : cut[i + 1]]] += unpack(x, k).astype(np.int64)  # a chunk sends a key once
        sums.append(total)
    word = (keys & U64(1)).astype(bool)
    totals = [int(word.sum()), *[int(s[word].sum()) for s in sums]]
    back = [[pack(s[at[i:j]]) for i, j in zip(cut[:-1], cut[1:])] for s in sums]
    cols = [pa.array(back[0], pa.binary()), pa.array(back[1], pa.binary()), *[pa.array([x] * len(n), pa.int64()) for x in totals]]
    return pa.table([t["chunk"], t["block"], t["n"], *cols], ["chunk", "block", "n", "every", "target", "v", "n_every", "n_target"])


def flagged(stored: DataFrame, target_ids: DataFrame) -> DataFrame:
    """The chunks, with the places of their target documents."""
    ids = target_ids.select(F.col("doc_id").alias("_id"))
    places = stored.select("chunk", F.posexplode("ids").alias("i", "doc_id"))
    # Always merge joins: what they join grows with the documents, so a broadcast would only serve small inputs.
    flags = places.join(ids.hint("merge"), places["doc_id"] == ids["_id"]).groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list("i").alias("flags"))
    return stored.join(flags.hint("merge"), stored["chunk"] == flags["_chunk"], "left").drop("_chunk")


def sums(stored: DataFrame) -> DataFrame:
    """For each chunk (with flags) and block the counts of its keys in all documents and in the target, and the block's vocabulary and words."""
    words = stored.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    sent = stored.drop("ids").mapInArrow(_block_batches(max(BLOCKS, words // BLOCK_WORDS)), "chunk string, block long, n long, keys binary, every binary, target binary")
    return sent.groupBy("block").applyInArrow(_sum_block, "chunk string, block long, n long, every binary, target binary, v long, n_every long, n_target long")


def losses(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: float, v: int) -> np.ndarray:
    """-ln P at each place, from the (scaled) counts of what stands there."""
    return -np.log((pair + MU * (word + 1) / (total + v)) / (context + MU))


def _score_chunk(v: int, n_every: int, n_target: int):
    scale = n_target / n_every if n_target else 1.0

    def run(stored: pa.Table, summed: pa.Table) -> pa.Table:
        out = []
        back = sorted(summed.to_pylist(), key=lambda r: r["block"])
        for row in stored.to_pylist():
            lengths = _lengths(row["lengths"])
            ends = np.cumsum(lengths)
            means = []
            if ends[-1]:
                _, at = _keys(lengths, row["n_words"], row["words"], row["places"])
            for name, by, total in (("target", 1.0, n_target), ("every", scale, n_every * scale)):
                if ends[-1]:
                    counts = np.concatenate([unpack(r[name], r["n"]) for r in back]) * by
                    at_places = losses(*[counts[x] for x in at], total, v)
                else:
                    at_places = np.zeros(0)
                s = np.concatenate([[0.0], np.cumsum(at_places)])
                with np.errstate(invalid="ignore", divide="ignore"):
                    means.append((s[ends] - s[ends - lengths]) / lengths)
            cols = [pa.array(x, pa.float64(), mask=lengths == 0) for x in (*means, means[0] - means[1])]
            out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(lengths), *cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.concat_tables(out)

    return run


def good_ids(labels: DataFrame) -> DataFrame:
    """The target: documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()


def difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for each row."""
    return score(docs, good_ids(labels))


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """The same for any target. ``target_ids`` has doc_id, each once."""
    plain = shelve(chunks(docs))
    # The flagged chunks are written too, and each step's shuffles go with it: so chunks aren't shuffled while the sent counts, which are larger, stand on disk.
    stored = shelve(flagged(plain, target_ids), shuffles_go=True)
    unshelve(plain)
    summed = shelve(sums(stored), shuffles_go=True)
    v, n_every, n_target = (x or 0 for x in summed.select("block", "v", "n_every", "n_target").distinct().agg(F.sum("v"), F.sum("n_every"), F.sum("n_target")).first())
    back = summed.select("chunk", "block", "n", "every", "target")
    both = stored.drop("flags").groupBy("chunk").cogroup(back.groupBy("chunk"))
    return both.applyInArrow(_score_chunk(v, n_every, n_target), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
