"""Byte-level BPE encoding and decoding by recursive queries in DuckDB.

Texts are cut by the tokenizers' pattern (letters, numbers, other signs, each with
a space before; contractions; white space), here from a table of character
classes over whole Arrow batches. Each partition then encodes its distinct
pieces: a row is a piece with its tokens and the ranks of their pairs in order of
position, each piece's leftmost pair of minimum rank is contracted, and the two
pairs that this makes join the merge table, until no pair is left. Long strings
have a row per token, and all their pairs join. Decoding joins the ids with
the vocabulary and aggregates their bytes in order of position.

A merge table row is a pair of tokens whose bytes together are a token, so the
rows follow from the ranks alone, and the result is what contraction by ranks
gives in any library. A recursion holds all its steps, which is quadratic in a
piece, so a query takes pieces whose steps are at most ``STATE_ROWS`` tokens, and goes on
from its last step where one piece alone has more.

Pieces of over ``STRETCH`` characters are contracted by the same queries in stretches
that are then joined: tokens on both sides of a seam are contracted anew, and the
result holds once it begins and ends with the tokens that it had; until then the window
doubles. That is exact: a sequence of tokens is what contraction gives for its bytes
if, and only if, this is so for each two neighbours, since the first contraction across
a border would be one between those two alone as well. Every pair of neighbours of the
result stands in one contraction's result.

Pieces that a worker has encoded stay in a table of bounded size (``KNOWN_PIECES``),
which is emptied when full. They are found by a hash, and their bytes are compared.

Defined cases: null and empty texts have no tokens (digests of nothing); very
long texts and pieces are encoded whole; of equal ranks in a piece the leftmost goes
first; repeated rows get equal rows, rows with a null id theirs; an unknown token id
raises ``KeyError``; empty tables give empty results. The vocabulary's path is
a parameter. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import small_batches
from tessera.llm.rawtext import U64, span_hashes, text_bytes

KNOWN_PIECES = 1_000_000
#: Tokens in all steps of one recursive query.
STATE_ROWS = 800_000
#: Characters of a stretch (a power of two, so that runs of one sign are cut where their tokens end), and tokens on each side of a seam.
STRETCH, SEAM = 16, 4
#: From so many bytes on, a step contracts all places of a rank.
MANY = 64
#: Stands for no token and no rank.
NONE = 2**31 - 1
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Endings that the pattern keeps with an apostrophe before them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    c = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    #: White space in the pattern's sense.
    c[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return c


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of valid UTF-8 and where each begins."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.int32)
    many = np.flatnonzero(cp >= 0x80)
    if len(many):
        lead, first = cp[many], at[many]
        wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
        two = ((lead & 0x1F) << 6) | wide[first + 1]
        three = ((lead & 0x0F) << 12) | (wide[first + 1] << 6) | wide[first + 2]
        four = ((lead & 0x07) << 18) | (wide[first + 1] << 12) | (wide[first + 2] << 6) | wide[first + 3]
        cp[many] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return cp, at


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each piece of the texts begins, in bytes. Pieces cover the texts and end at the next one's begin."""
    if not len(buf):
        return np.zeros(0, np.int64)
    cp, at = code_points(buf)
    n = len(cp)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, off)] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begins = run.copy()
    # A blank goes with what follows; of more white space, the last sign stands apart.
    joined = np.zeros(n, bool)
    joined[1:] = run[1:] & ~space[1:] & ~first[1:] & space[:-1]
    begins[np.flatnonzero(joined) - 1] = True
    joined[1:] &= cp[:-1] == 0x20
    begins[joined] = False
    # Contractions: an apostrophe that begins a piece, with an ending after it.
    for i in np.flatnonzero((cp == 0x27) & begins & run):
        if i + 1 >= n or first[i + 1] or kind[i + 1] != LETTER:
            continue
        for e in ENDINGS:
            end = i + 1 + len(e)
            if end <= n and not first[i + 1 : end].any() and all(cp[i + 1 + k] == ord(x) for k, x in enumerate(e)):
                begins[i + 1] = False
                if end < n and not run[end]:
                    begins[end] = True
                break
    return at[begins]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _stretches(piece: bytes) -> list[bytes]:
    """The piece cut before every STRETCH-th character (bytes that continue one stay with it)."""
    buf = np.frombuffer(piece, np.uint8)
    heads = np.flatnonzero((buf & 0xC0) != 0x80)[STRETCH::STRETCH]
    cuts = [0, *heads.tolist(), len(piece)]
    return [piece[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


class Codec:
    """A DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.names = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        # Tokens that a token ranked before them may swallow: their places can't go all at once.
        alone = {t for pair in zip(left, right, merged) for t in pair[:2] if t > pair[2]}
        as_pair = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(as_pair)
        self.pairs, self.pair_ranks = as_pair[order], np.array(merged, np.int32)[order]
        merged = [2 * m + (m in alone) for m in merged]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.db.execute("SET temp_directory = ''")
        merges = pa.table({"pair": as_pair, "rank": pa.array(merged, pa.int32())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        # Bytes as characters of the same number, so that they can be aggregated in order.
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    @functools.cached_property
    def decimals(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id's digits and a comma in a row of bytes, zeros after them, and how many they are."""
        names = np.array([b"%d," % i for i in range(max(self.names) + 1)])
        return names.view(np.uint8).reshape(len(names), -1), np.char.str_len(names).astype(np.uint8)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. A piece that is a token as a whole is that token, as in the tokenizers' library."""
        found = [self.ranks.get(p) for p in pieces]
        merged = iter(self._contract([p for p, r in zip(pieces, found) if r is None]))
        return [next(merged) if r is None else np.array([r], np.int32) for r in found]

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """What contraction gives for each piece."""
        out: list = [None] * len(pieces)
        long = [i for i, p in enumerate(pieces) if len(p) > STRETCH]
        cuts = [_stretches(pieces[i]) for i in long]
        short = [i for i, p in enumerate(pieces) if len(p) <= STRETCH]
        flat = self._recurse([*(pieces[i] for i in short), *(x for c in cuts for x in c)])
        for i, ids in zip(short, flat):
            out[i] = ids
        rest = iter(flat[len(short) :])
        parts = [[next(rest) for _ in c] for c in cuts]
        # Neighbouring stretches are joined two by two, those of all pieces together.
        while any(len(x) > 1 for x in parts):
            joined = iter(self._join([(x[i], x[i + 1]) for x in parts for i in range(0, len(x) - 1, 2)]))
            parts = [[*(next(joined) for _ in range(len(x) // 2)), *(x[-1:] if len(x) % 2 else [])] for x in parts]
        for i, x in zip(long, parts):
            out[i] = x[0]
        return out

    def _join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The contraction of the bytes of two contracted strings, for each pair of such."""
        out: list = [None] * len(pairs)
        todo, n = range(len(pairs)), SEAM
        while todo:
            windows = self._recurse([b"".join(self.names[t] for t in (*pairs[i][0][-n:], *pairs[i][1][:n])) for i in todo])
            left = []
            for i, w in zip(todo, windows):
                a, b = pairs[i]
                if (n >= len(a) or w[0] == a[-n]) and (n >= len(b) or w[-1] == b[n - 1]):
                    out[i] = np.concatenate([a[:-n], w, b[n:]])
                else:
                    left.append(i)
            todo, n = left, 2 * n
        return out

    def _recurse(self, strings: list[bytes]) -> list[np.ndarray]:
        """Queries of bounded state over the strings, shorter ones first, so that those of a query end together."""
        out: list = [None] * len(strings)
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        i = 0
        while i < len(order):
            j, state = i, 0
            while j < len(order) and (j == i or state < STATE_ROWS):
                state += len(strings[order[j]]) ** 2 // 2 + 1
                j += 1
            for k, ids in zip(order[i:j], self._query([strings[k] for k in order[i:j]])):
                out[k] = ids
            i = j
        return out

    def _query(self, strings: list[bytes]) -> list[np.ndarray]:
        """As many steps in a query as its state allows, until there are no more."""
        n = np.array([len(p) for p in strings])
        ids = self.byte_ids[np.frombuffer(b"".join(strings), np.uint8)]
        run = self._steps_all if int(n.max()) > MANY else self._steps
        while True:
            longest, steps = int(n.max()), max(2, 2 * STATE_ROWS // len(ids))
            cut, new = run(n, ids, steps)
            if longest <= steps or len(new) == len(ids):
                return [new[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            n, ids = np.diff(cut), new

    def _steps(self, n: np.ndarray, ids: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of each string begin (one more at the end), and the tokens, after so many steps at most."""
        ends = np.cumsum(n)
        pair = ids.astype(np.int64) << 32
        pair[:-1] |= ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        rank = np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)
        rank[ends - 1] = NONE
        # Each list has a place more in front, so that each token has a left neighbour.
        off = np.append(0, ends + np.arange(1, len(n) + 1))
        place = np.arange(len(ids)) + np.repeat(np.arange(1, len(n) + 1), n)
        lists = []
        for values in (ids, rank):
            flat = np.full(off[-1], NONE, np.int32)
            flat[place] = values
            lists.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat))
        rows = pa.table({"piece": np.arange(len(n), dtype=np.int32), "tokens": lists[0], "ranks": lists[1]})  # noqa: F841
        got = self.db.sql(ENCODE, params=[steps]).to_arrow_table().column("tokens").combine_chunks()
        return np.append(0, np.cumsum(got.value_lengths().to_numpy())), got.flatten().to_numpy()

    def _steps_all(self, n: np.ndarray, ids: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for long strings, with a row per token."""
        rows = pa.table(  # noqa: F841
            {"piece": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "token": np.asarray(ids, np.int32)}
        )
        got = self.db.execute(ENCODE_ALL, [steps]).fetchnumpy()
        return np.searchsorted(np.asarray(got["piece"]), np.arange(len(n) + 1)), np.asarray(got["token"])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The bytes of each text, whose ids run from its ``off`` to the next."""
        n = np.diff(off)
        rows = pa.table({"text": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": np.arange(len(ids), dtype=np.int32), "id": np.asarray(ids, np.int32)})  # noqa: F841
        got = self.db.execute(DECODE).fetchall()
        out = [b""] * len(n)
        total = 0
        for text, s, k in got:
            out[text] = s.encode("latin-1")
            total += k
        if total != len(ids):
            raise KeyError("an id is not in the vocabulary")
        return out


#: A step contracts each piece's leftmost pair of least rank. A row is a piece with its tokens and the ranks of the pairs
#: that begin with them, so that a step looks up only the two pairs with the new token, whose id is its rank.
ENCODE = f"""
WITH RECURSIVE state(step, piece, tokens, ranks, best) AS (
  SELECT 0, piece, tokens, ranks, list_min(ranks) FROM rows
  UNION ALL
  SELECT step + 1, piece, tokens, ranks, list_min(ranks)
  FROM (
    SELECT step, piece, tokens[:i - 1] || [best] || tokens[i + 2:] AS tokens,
      ranks[:i - 2] || [coalesce(before.rank >> 1, {NONE}), coalesce(after.rank >> 1, {NONE})] || ranks[i + 2:] AS ranks
    FROM (
      SELECT *, (CAST(tokens[i - 1] AS BIGINT) << 32) + best AS left_pair, (CAST(best AS BIGINT) << 32) + tokens[i + 2] AS right_pair
      FROM (SELECT *, list_position(ranks, best) AS i FROM state WHERE best < {NONE} AND step < $1)
    )
    LEFT JOIN merges AS before ON before.pair = left_pair
    LEFT JOIN merges AS after ON after.pair = right_pair
  )
)
SELECT piece, tokens[2:] AS tokens FROM state WHERE best = {NONE} OR step = $1 ORDER BY piece
"""

#: Rows of tokens, and all places of the least rank at once: of a run of overlapping ones the first, third and so on. That is
#: what one after the other gives unless a pair with the new token ranks before it (an odd ``rank``): then only the first.
ENCODE_ALL = """
WITH RECURSIVE state(step, piece, pos, token) AS (
  SELECT 0, piece, pos, token FROM rows
  UNION ALL
  SELECT step + 1, piece, pos, CASE WHEN chosen THEN best >> 1 ELSE token END
  FROM (
    SELECT *, lag(chosen, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND (CASE WHEN best % 2 = 1 THEN place = first_hit
        ELSE (place - coalesce(max(CASE WHEN NOT hit THEN place END) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 END) AS chosen
      FROM (
        SELECT *, coalesce(rank = best, false) AS hit, min(CASE WHEN rank = best THEN place END) OVER (PARTITION BY piece) AS first_hit
        FROM (
          SELECT *, min(rank) OVER (PARTITION BY piece) AS best
          FROM (
            SELECT pairs.step, pairs.piece, pairs.pos, pairs.token, pairs.place, merges.rank
            FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY pos) AS place, (CAST(token AS BIGINT) << 32) + lead(token) OVER (PARTITION BY piece ORDER BY pos) AS pair FROM state WHERE step < $1) AS pairs
            LEFT JOIN merges ON merges.pair = pairs.pair
          )
        )
      )
    )
  )
  WHERE best IS NOT NULL AND NOT gone
)
SELECT piece, token FROM (SELECT *, max(step) OVER (PARTITION BY piece) AS last FROM state) WHERE step = last ORDER BY piece, pos
"""

DECODE = """
SELECT text, string_agg(bytes, '' ORDER BY pos) AS s, count(*) AS n FROM rows JOIN vocabulary USING (id) GROUP BY text
"""


class Encoder:
    """Encodes whole Arrow columns; keeps what it knows between batches and partitions, in flat arrays."""

    def __init__(self, path: str):
        self.codec = Codec(read_ranks(path))
        self.forget()

    def forget(self):
        self.hashes = np.zeros(0, U64)  # ascending; ``place`` says which of the known pieces each is
        self.place = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)  # of the known pieces, one behind the other
        self.byte_ends = np.zeros(1, np.int64)
        self.odd: dict[bytes, int] = {}  # pieces whose hash another piece has

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of new pieces."""
        got = self.codec.encode(pieces)
        n = len(self.ends) - 1
        if got:
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in got])])
            self.ids = np.concatenate([self.ids, *got])
            self.byte_ends = np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum([len(p) for p in pieces])])
            self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        return np.arange(n, n + len(got), dtype=np.int32)

    def pieces(self, col) -> tuple[np.ndarray, np.ndarray]:
        """The known number of each piece, and where each text's begin (one more at the end)."""
        buf, off = text_bytes(col)
        starts = piece_starts(buf, off)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        keys, at, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.ends) + len(keys) > KNOWN_PIECES:
            self.forget()
        spot = np.searchsorted(self.hashes, keys)
        new = np.ones(len(keys), bool)
        inside = spot < len(self.hashes)
        new[inside] = self.hashes[spot[inside]] != keys[inside]
        data = buf.tobytes()
        numbers = self.learn([data[i:j] for i, j in zip(starts[at[new]], ends[at[new]])])
        where = spot[new]
        self.place = np.insert(self.place, where, numbers)
        self.hashes = np.insert(self.hashes, where, keys[new])
        number = self.place[np.searchsorted(self.hashes, keys)][back] if len(keys) else np.zeros(0, np.int32)
        for i in self.unlike(buf, starts, ends, number).tolist():
            piece = data[starts[i] : ends[i]]
            if piece not in self.odd:
                self.odd[piece] = int(self.learn([piece])[0])
            number[i] = self.odd[piece]
        return number, np.searchsorted(starts, off)

    def unlike(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which pieces aren't the known ones that they were taken for. Pieces cover ``buf``."""
        n = ends - starts
        wrong = np.diff(self.byte_ends)[number] != n
        # Bytes of the known piece at the same place; of one of another length, any.
        shift = np.repeat(self.byte_ends[number] - starts, n) + np.arange(len(buf))
        differ = self.bytes[np.minimum(shift, len(self.bytes) - 1)] != buf if len(buf) else np.zeros(0, bool)
        if differ.any():
            wrong |= np.add.reduceat(differ, starts) > 0
        return np.flatnonzero(wrong)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(col, path: str):
    """Per text: its ids (flat, with offsets) and the decimal ids joined by commas."""
    e = encoder(path)
    number, cut = e.pieces(col)
    begin = e.ends[number]
    each = e.ends[number + 1] - begin
    total = np.concatenate([[0], np.cumsum(each)])
    ids = e.ids[np.repeat(begin - total[:-1], each) + np.arange(int(total[-1]))]
    off = total[cut]
    names, size = e.codec.decimals
    at = np.concatenate([[0], np.cumsum(size[ids], dtype=np.int64)])[off].tolist()
    data = names[ids]
    data = data[data > 0].tobytes()
    joined = [data[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:])]
    return ids, off, joined


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of each text."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        for b in batches:
            ids, off, _ = encode_column(b.column(1), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of each row's ids (null ids: no bytes)."""
    small_batches(tokens.sparkSession)
    path = path or default_path()

    def run(batches):
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            off = np.cumsum([0, *map(len, lists)])
            ids = np.array([i for x in lists for i in x], np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(path).codec.decode(ids, off), pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        for b in batches:
            ids, off, joined = encode_column(b.column(1), path)
            data = encoder(path).codec.decode(ids, off)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
