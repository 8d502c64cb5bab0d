"""The scores of ``scoring`` for a block of users against a chunk of profiles, as matrices.

Matrices have a row per profile ``b`` and a column per user ``a``. Each part of a score
depends on ``a`` and one item, style or pace of ``b``, so it is a table with a row per such
value and a column per user, made once a block, whose rows are looked up per profile.
Nulls count as in ``scoring.score``: nothing is shared with a null item or list, except that
all points go to a user whose own list is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions import scoring

STYLES = sorted({s for pair in scoring.STYLE_POINTS for s in pair})


def _codes(values: pa.Array, among: pa.Array, missing: int) -> np.ndarray:
    """Where each value stands in ``among``, ``missing`` for nulls and others."""
    found = pc.index_in(values, value_set=among, skip_nulls=True)
    return pc.fill_null(found, missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _items(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and value of each item of a column of lists."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def _mask(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


class Block:
    """Users, with their tables."""

    def __init__(self, users: pa.Table, scenes):
        col = {c: users[c].combine_chunks() for c in users.column_names}
        self.ids, n = col["userId"], len(users)
        self.distinct = pc.unique(self.ids)
        code = _codes(self.ids, self.distinct, 0)
        self.by_id = np.argsort(code, kind="stable")
        self.starts = np.searchsorted(code[self.by_id], np.arange(len(self.distinct) + 1))
        self.shared = {}
        for name, points, cap in scoring.SHARED_POINTS:
            rows, items = _items(col[name])
            known = pc.unique(items).drop_null()
            at = _codes(items, known, len(known))
            times = np.zeros((len(known) + 1, n), np.int64)
            np.add.at(times, (at, rows), 1)
            times[-1] = 0
            least = np.where(_mask(pc.is_null(col[name])), cap, 0).astype(np.uint8)
            self.shared[name] = known, np.minimum(times * points, cap).astype(np.uint8), least, cap
        style = _codes(col["communicationStyle"], pa.array(STYLES, pa.string()), len(STYLES))
        points = np.full((len(STYLES) + 1,) * 2, scoring.STYLE_REST, np.uint8)
        for (x, y), p in scoring.STYLE_POINTS.items():
            points[STYLES.index(x), STYLES.index(y)] = points[STYLES.index(y), STYLES.index(x)] = p
        self.style = points[:, style]
        pace = col["relationshipPace"]
        self.paces = pc.unique(pa.concat_arrays([pace, pa.array(["medium"], pace.type)])).drop_null()
        at, medium = _codes(pace, self.paces, -1), self.paces.index("medium").as_py()
        of_b = np.arange(len(self.paces) + 1)[:, None]
        self.pace = np.where(at == of_b, 8, np.where((at == medium) | (of_b == medium), 5, 1)).astype(np.uint8)
        self.scene = [np.where(wants, [[5], [15]], [[0], [5]]).astype(np.uint8) for wants in _wanted(col["preferredScenes"], scenes)]

    def places(self, rows: np.ndarray, users: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and index of the pair for each column that a given user has."""
        code = _codes(users, self.distinct, -1)
        at = np.flatnonzero(code >= 0)
        first = self.starts[code[at]]
        n = self.starts[code[at] + 1] - first
        cols = self.by_id[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        return rows[at], cols, at


def _wanted(lists: pa.Array, scenes) -> list[np.ndarray]:
    rows, items = _items(lists)
    out = []
    for s in scenes:
        wants = np.zeros(len(lists), bool)
        wants[rows[_mask(pc.fill_null(pc.equal(items, pa.scalar(s, items.type)), False))]] = True
        out.append(wants)
    return out


def _shared(lists: pa.Array, known: pa.Array, table: np.ndarray, least: np.ndarray, cap: int) -> np.ndarray:
    rows, items = _items(lists)
    pairs = np.unique(rows * len(table) + _codes(items, known, len(known)))
    rows, at = pairs // len(table), pairs % len(table)
    rows, at = rows[at < len(known)], at[at < len(known)]
    out = np.repeat(least[None], len(lists), 0)
    n = np.bincount(rows, minlength=len(lists))
    first = np.cumsum(n) - n
    for i in range(n.max(initial=0)):
        these = np.flatnonzero(n > i)
        if len(these) == len(out):
            out += table[at[first + i]]
            np.minimum(out, cap, out=out)
        else:
            out[these] = np.minimum(out[these] + table[at[first[these] + i]], cap)
    return out


def found(block: Block, chunk: pa.Table, noise, scenes):
    """For each scene: its index, rows, columns and scores of the pairs that reach the threshold, of two different users who aren't in ``excluded``."""
    col = {c: chunk[c].combine_chunks() for c in chunk.column_names}
    total = block.style[_codes(col["communicationStyle"], pa.array(STYLES, pa.string()), len(STYLES))]
    total += block.pace[_codes(col["relationshipPace"], block.paces, len(block.paces))]
    for name, (known, table, least, cap) in block.shared.items():
        total += _shared(col[name], known, table, least, cap)
    same = block.places(np.arange(len(chunk)), col["userId"])[:2]
    rows, pairs = _items(col["excluded"])
    out_rows, out_cols, at = block.places(rows, pairs.field("user"))
    out_scenes = _codes(pairs.field("scene"), pa.array(scenes, pa.string()), -1)[at]
    for i, (scene, wants) in enumerate(zip(scenes, _wanted(col["preferredScenes"], scenes))):
        score = (total + block.scene[i][wants.astype(np.int8)]).astype(np.int16)
        if noise is not None:
            score = score + noise(_mask(block.ids), _mask(col["userId"]), scene)
        np.clip(score, 0, 100, out=score)
        keep = score >= scoring.THRESHOLD
        keep[same] = False
        here = out_scenes == i
        keep[out_rows[here], out_cols[here]] = False
        r, c = np.nonzero(keep)
        yield i, r, c, score[keep]
