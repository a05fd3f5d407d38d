"""NumPy kernel of the nearest-neighbour search: random-projection forests.

A tree halves a set of unit vectors by hyperplanes between two of its centres until a
part is small.  A forest is searched through one priority queue shared by its trees: a
leaf's priority is the smallest margin on the way to it, and leaves are taken in falling
order of priority.  All queries of a block are searched at once, so that the queue turns
into one partial sort and the scoring of a leaf into one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    normals: np.ndarray  # (inner nodes, dim) float32
    offsets: np.ndarray  # (inner nodes,) float32
    children: np.ndarray  # (inner nodes, 2) int32; a leaf is stored as -1 - leaf number
    leaves: int
    crowds: int = 0  # so many first leaves are crowds

    @property
    def nbytes(self) -> int:
        return self.normals.nbytes + self.offsets.nbytes + self.children.nbytes


def _split(x: np.ndarray, rng: np.random.Generator, sample: int = 256, tries: int = 1, near: float = 0.05) -> tuple[np.ndarray, float] | None:
    """Hyperplane between two centres of the rows; None where all rows are equal.

    Of several tries the one is taken that leaves the fewest rows close to it, so that
    crowds stay on one side.
    """
    n = len(x)
    best: tuple[float, np.ndarray, float] | None = None
    done = 0
    for _ in range(tries + 2):
        pick = x if n <= sample else x[rng.choice(n, sample, replace=False)]
        i, j = rng.choice(len(pick), 2, replace=False)
        a, b = pick[i].copy(), pick[j].copy()
        for _ in range(4):
            near_a = pick @ (a - b) > (a @ a - b @ b) / 2
            na = int(near_a.sum())
            if na == 0 or na == len(pick):
                break
            a, b = pick[near_a].mean(0), pick[~near_a].mean(0)
        normal = a - b
        size = float(np.linalg.norm(normal))
        if size < 1e-6:
            continue
        normal /= size
        m = pick @ normal
        cut = float(normal @ (a + b) / 2)
        share = float((m > cut).mean())
        if not 0.05 <= share <= 0.95:
            cut = float(np.median(m))
            if not (m > cut).any():
                cut = float((m.min() + m.max()) / 2)
            if not 0 < int((m > cut).sum()) < len(m):
                continue
            share = float((m > cut).mean())
        cost = float((np.abs(m - cut) < near).mean()) + abs(share - 0.5) * 0.3
        if best is None or cost < best[0]:
            best = (cost, normal.astype(np.float32), cut)
        done += 1
        if done >= tries:
            break
    return best and best[1:]


def find_crowds(x: np.ndarray, size: int, cosine: float, near: float, rng: np.random.Generator, tries: int = 200) -> list[tuple[np.ndarray, float]]:
    """Hyperplanes that part crowds of more than ``size`` rows from all other rows.

    A crowd is what lies within ``cosine`` of one row, is set apart from the rest, and cannot
    be divided itself: every hyperplane through it lies nearer than ``near`` to most of its rows.
    """
    found: list[tuple[np.ndarray, float]] = []
    rest = x
    for _ in range(8):
        if len(rest) <= size:
            break
        counts = (rest[rng.choice(len(rest), min(tries, len(rest)), replace=False)] @ rest.T >= cosine)
        most = counts.sum(1)
        if most.max() <= size:
            break
        centre = rest[counts[most.argmax()]].mean(0)
        centre /= np.linalg.norm(centre)
        m = rest @ centre
        steps = np.linspace(cosine - 0.1, float(np.median(m[counts[most.argmax()]])), 40)
        offset = float(steps[np.argmin([(np.abs(m - t) < near).sum() for t in steps])])
        crowd = rest[m > offset]
        cut = _split(crowd, rng, 1024, 16) if len(crowd) > size else None
        if cut is None or (np.abs(crowd @ cut[0] - cut[1]) < near).mean() <= 0.5 or (np.abs(m - offset) < near).sum() > 0.1 * len(crowd):
            break
        found.append((centre.astype(np.float32), offset))
        rest = rest[m <= offset]
    return found


def build_tree(
    x: np.ndarray, leaf_size: int, rng: np.random.Generator, max_leaves: int = 1 << 30, tries: int = 1, crowds: list[tuple[np.ndarray, float]] | None = None
) -> tuple[Tree, list[np.ndarray]]:
    """Tree over the rows of x, and the rows of each leaf; its first leaves are the crowds, which stay whole."""
    normals, offsets, children = [], [], []
    parts: list[np.ndarray] = []
    budget = max_leaves
    rest = np.arange(len(x))
    for normal, offset in crowds or []:
        inside = x[rest] @ normal > offset
        parts.append(rest[inside])
        rest = rest[~inside]
        normals.append(normal)
        offsets.append(offset)
        children.append([len(normals), -len(parts)])
    stack = [(rest, len(normals) - 1, 0)]
    open_parts = 1
    while stack:
        rows, parent, side = stack.pop()
        cut = _split(x[rows], rng, 256 if tries == 1 else 1024, tries) if len(rows) > leaf_size and len(parts) + open_parts < budget else None
        left = None
        if cut is not None:
            left = x[rows] @ cut[0] > cut[1]
            if left.all() or not left.any():
                cut = None
        if cut is None:
            me = -1 - len(parts)
            parts.append(rows)
            open_parts -= 1
        else:
            me = len(normals)
            normals.append(cut[0])
            offsets.append(cut[1])
            children.append([0, 0])
            stack.append((rows[left], me, 1))
            stack.append((rows[~left], me, 0))
            open_parts += 1
        if parent >= 0:
            children[parent][side] = me
    dim = x.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, dim), np.array(offsets, np.float32), np.array(children, np.int32).reshape(-1, 2), len(parts), len(crowds or [])), parts


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of every row."""
    out = np.zeros(len(x), np.int32)
    if not len(tree.normals):
        return out
    at = np.zeros(len(x), np.int32)
    todo = np.arange(len(x))
    while len(todo):
        node = at[todo]
        right = np.einsum("ij,ij->i", x[todo], tree.normals[node]) > tree.offsets[node]
        nxt = tree.children[node, right.astype(np.int8)]
        done = nxt < 0
        out[todo[done]] = -1 - nxt[done]
        at[todo] = nxt
        todo = todo[~done]
    return out


def priorities(tree: Tree, x: np.ndarray) -> np.ndarray:
    """(rows, leaves): smallest margin on the way to each leaf; inner order of a queue's pops."""
    out = np.full((len(x), tree.leaves), np.inf, np.float32)
    if not len(tree.normals):
        return out
    margin = x @ tree.normals.T - tree.offsets
    stack = [(0, np.full(len(x), np.inf, np.float32))]
    while stack:
        node, p = stack.pop()
        m = margin[:, node]
        for side, v in ((0, -m), (1, m)):
            c = tree.children[node, side]
            q = np.minimum(p, v)
            if c < 0:
                out[:, -1 - c] = q
            else:
                stack.append((int(c), q))
    return out


def close_leaves(tree: Tree, x: np.ndarray, near: float | np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves: one entry for each of a row's ``least`` best leaves and for all whose priority is at least ``-near`` (a number, or a column of them)."""
    p = priorities(tree, x)
    close = p >= -near
    least = min(least, p.shape[1])
    best = np.argpartition(-p, least - 1, axis=1)[:, :least]
    close[np.arange(len(x))[:, None], best] = True
    return np.nonzero(close)


def _scan(
    x: np.ndarray, asking: np.ndarray, best_i: np.ndarray, best_s: np.ndarray, rows: int = 512, width: int = 8192, start: int = 0, stop: int | None = None
) -> None:
    """Score the asking rows against the rows start to stop of x, in blocks; best_i and best_s get their exact best among those.

    What the lists already hold is a bound: only rows that reach it are ranked.
    """
    keep = best_i.shape[1]
    stop = len(x) if stop is None else stop
    for a in range(0, len(asking), rows):
        q = asking[a : a + rows]
        bound = best_s[q].min(1) - 1e-5  # products of other blocks may round differently
        top_i, top_s = np.full((len(q), keep), -1, np.int32), np.full((len(q), keep), -2.0, np.float32)
        for b in range(start, stop, width):
            end = min(b + width, stop)
            s = x[q] @ x[b:end].T
            own = np.nonzero((q >= b) & (q < end))[0]
            s[own, q[own] - b] = -2.0
            if (bound < -1).any() and s.shape[1] > keep:  # nothing known yet
                bound = np.maximum(bound, -np.partition(-s, keep - 1, axis=1)[:, keep - 1] - 1e-5)
            flat = np.flatnonzero(s > bound[:, None])
            if not len(flat):
                continue
            r, c = np.divmod(flat, s.shape[1])
            all_r = np.concatenate([np.repeat(np.arange(len(q)), keep), r])
            all_i = np.concatenate([top_i.ravel(), (c + b).astype(np.int32)])
            all_s = np.concatenate([top_s.ravel(), s[r, c]])
            order = np.lexsort((all_i, -all_s, all_r))
            all_r, all_i, all_s = all_r[order], all_i[order], all_s[order]
            place = np.arange(len(all_r)) - np.searchsorted(all_r, np.arange(len(q)))[all_r]
            first = place < keep  # every row has at least `keep` entries
            top_i, top_s = all_i[first].reshape(-1, keep), all_s[first].reshape(-1, keep)
            bound = np.maximum(bound, top_s[:, -1] - 1e-5)
        best_i[q], best_s[q] = top_i, top_s


def scan(x: np.ndarray, keep: int, border: int = 0) -> np.ndarray:
    """Exact `keep` best other rows of every row of x (-1: none); with a border, of the rows before it among those after it and the reverse."""
    n = len(x)
    best_i, best_s = np.full((n, keep), -1, np.int32), np.full((n, keep), -2.0, np.float32)
    if border:
        _scan(x, np.arange(border), best_i, best_s, start=border)
        _scan(x, np.arange(border, n), best_i, best_s, stop=border)
    else:
        _scan(x, np.arange(n), best_i, best_s)
    best_i[best_s <= -2.0] = -1
    return best_i


def smoothed(x: np.ndarray, found: np.ndarray, good: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Unit rows, each averaged with the rows found for it, again and again: noise goes, the place stays."""
    for _ in range(rounds):
        out = x.copy()
        for c in range(found.shape[1]):
            r = np.nonzero(good[:, c])[0]
            out[r] += x[found[r, c]]
        x = out / np.linalg.norm(out, axis=1, keepdims=True)
    return x


def search(
    x: np.ndarray, keep: int, trees: int = 4, leaf_size: int = 256, least: int = 6, most: int = 48, reach: float = 0.04, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """For every row of unit vectors x the `keep` best other rows: indices (-1: none) and cosines.

    Every row takes leaves from the queue shared by all trees: the `least` first ones in any
    case, then further ones while their priority is above ``-reach``.  Rows in crowds lie
    close to many hyperplanes; a row that would look into more than `most` leaves is scored
    against all rows instead, with its first leaves as a bound.
    Candidates are scored by exact products of the rows.
    """
    n = len(x)
    best_i = np.full((n, keep), -1, np.int32)
    best_s = np.full((n, keep), -2.0, np.float32)
    if n < 2:
        return best_i, best_s
    rng = np.random.default_rng(seed)
    forest = [build_tree(x, leaf_size, rng) for _ in range(trees if n > leaf_size else 1)]
    members = [rows for _, parts in forest for rows in parts]
    total = len(members)
    most = min(most, total)
    by_leaf: list[list[np.ndarray]] = [[] for _ in range(total)]
    crowded: list[np.ndarray] = []
    for a in range(0, n, 4096):
        block = x[a : a + 4096]
        p = np.concatenate([priorities(t, block) for t, _ in forest], axis=1)
        chosen = np.argpartition(-p, most - 1, axis=1)[:, :most] if most < total else np.broadcast_to(np.arange(total), p.shape)
        value = np.take_along_axis(p, chosen, 1)
        order = np.argsort(-value, axis=1)
        chosen, value = np.take_along_axis(chosen, order, 1), np.take_along_axis(value, order, 1)
        wanted = (value >= -reach) | (np.arange(most) < least)
        if most < total:
            capped = value[:, -1] >= -reach
            crowded.append(np.nonzero(capped)[0] + a)
            wanted[capped, least:] = False
        row, col = np.nonzero(wanted)
        flat = chosen[row, col]
        order = np.argsort(flat, kind="stable")
        who = (row[order] + a).astype(np.int32)
        edges = np.searchsorted(flat[order], np.arange(total + 1))
        for leaf in np.nonzero(np.diff(edges))[0]:
            by_leaf[leaf].append(who[edges[leaf] : edges[leaf + 1]])
    for leaf, rows in enumerate(members):
        if not by_leaf[leaf] or not len(rows):
            continue
        asking = np.concatenate(by_leaf[leaf])
        cols = x[rows].T
        for a in range(0, len(asking), 2048):
            q = asking[a : a + 2048]
            s = x[q] @ cols
            k = min(keep + 1, s.shape[1])  # one of them may be the row itself
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), s.shape)
            new_s = np.take_along_axis(s, top, 1)
            new_i = rows[top].astype(np.int32)
            new_s[(new_i == q[:, None]) | (new_i[:, :, None] == best_i[q][:, None, :]).any(2)] = -2.0
            all_s = np.concatenate([best_s[q], new_s], 1)
            all_i = np.concatenate([best_i[q], new_i], 1)
            o = np.argpartition(-all_s, keep - 1, axis=1)[:, :keep]
            best_s[q] = np.take_along_axis(all_s, o, 1)
            best_i[q] = np.take_along_axis(all_i, o, 1)
    if crowded:
        _scan(x, np.concatenate(crowded), best_i, best_s)
    best_i[best_s <= -2.0] = -1
    return best_i, best_s
