"""Deep-shallow sorting of many short byte strings, group by group.

A multikey quicksort, whose characters are eight bytes, splits all groups at once into smaller, equal and larger than a pivot
and follows the equal part to the next eight bytes, down to a shallow depth.  Groups that still hold together there have long
common prefixes; comparing them from the front again would be waste.  Each of them goes into a blind trie: it branches on
single bytes only, skips what all below a node share, and looks at a string once, against the one leaf that the blind descent
ends at.
"""

from __future__ import annotations

import numpy as np

_TOP = [np.uint64(0xFFFFFFFFFFFFFFFF >> 8 * k ^ 0xFFFFFFFFFFFFFFFF) for k in range(8)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
_MASKS = np.array(_TOP)


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first one highest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(data) + 1,), (1,)).astype(np.uint64)


class Strings:
    """Pieces of ``data``, some of them perhaps reversed copies of others'; ``at`` and ``length`` say where each is."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: np.ndarray):
        self.data, self.at, self.length, self.eight = data, at, length, words(data)

    def keys(self, which: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bytes of strings from ``depth`` on, without what lies behind their ends, and how many of them there are."""
        left = np.clip(self.length[which] - depth, 0, 8)
        place = np.minimum(self.at[which] + depth, len(self.data))
        return self.eight[place] & _MASKS[left], left


def multikey(strings: Strings, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings, group by group (groups are contiguous), sorted by their first ``shallow`` bytes at least, and
    for each place in it the number of its part: strings of one part are alike that far, or to their ends."""
    order = np.arange(len(group))
    edge = np.ones(len(group), bool)
    edge[1:] = group[1:] != group[:-1]
    depth = np.zeros(len(group), np.int64)
    open_ = np.ones(len(group), bool)                               # places whose part may split further
    while True:
        starts = np.flatnonzero(edge)
        sizes = np.diff(np.append(starts, len(edge)))
        part = np.cumsum(edge) - 1
        at = np.flatnonzero(open_ & (sizes[part] > 1) & (depth < shallow))
        if not len(at):
            return order, part
        key, left = strings.keys(order[at], depth[at])
        first = np.ones(len(at), bool)
        first[1:] = part[at[1:]] != part[at[:-1]]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        mine = np.cumsum(first) - 1
        pivot = begin + size // 2
        pivot_key, pivot_left = key[pivot][mine], left[pivot][mine]
        same = (key == pivot_key) & (left == pivot_left)
        less = (key < pivot_key) | ((key == pivot_key) & (left < pivot_left))
        more = ~(same | less)
        to = np.zeros(len(at), np.int64)
        base = begin.copy()
        marks = []
        for cls in (less, same, more):
            running = np.cumsum(cls)
            before = running[begin] - cls[begin]
            count = np.append(running[begin[1:]] - cls[begin[1:]], running[-1]) - before
            to[cls] = (base[mine] + running - 1 - before[mine])[cls]
            marks.append(base[count > 0])
            base = base + count
        moved = at[to]
        was, ended = order[at], left < 8
        order[moved] = was
        depth[moved] = depth[at] + 8 * same
        open_[moved] = ~(same & ended)
        edge[at[np.concatenate(marks)]] = True


class BlindTrie:
    """Order of strings that are alike up to a depth.

    A node is [depth, branches]; a branch goes by the byte at the node's depth, or -1 for strings that end there, to another
    node or to a list of equal strings.
    """

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None
        for i in range(len(texts)):
            self.insert(i)

    def byte(self, text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def insert(self, i: int) -> None:
        text = self.texts[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:                                  # blind descent: only the branching bytes are looked at
            branches = node[1]
            found = branches.get(self.byte(text, node[0]))
            node = found if found is not None else next(iter(branches.values()))
        other = self.texts[node[0]]
        if text == other:
            node.append(i)
            return
        n = min(len(text), len(other))
        apart = int.from_bytes(text[:n], "big") ^ int.from_bytes(other[:n], "big")
        common = n - (apart.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node) is tuple and node[0] < common:
            above, node = node, node[1][self.byte(text, node[0])]
        if type(node) is tuple and node[0] == common:
            node[1][self.byte(text, common)] = [i]
            return
        split = (common, {self.byte(other, common): node, self.byte(text, common): [i]})
        if above is None:
            self.root = split
        else:
            above[1][self.byte(text, above[0])] = split

    def sorted(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack.extend(child for _, child in sorted(node[1].items(), key=lambda kv: -kv[0]))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: Strings, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within their groups, and how many bytes each shares with the one before it (-1: another group)."""
    order, part = multikey(strings, group, shallow)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(part)))
    held = strings.data.tobytes()
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        some = order[start:start + size]
        at, length = strings.at[some].tolist(), strings.length[some].tolist()
        if min(length) <= shallow and max(length) == min(length):
            continue                                                # nothing is left to compare
        texts = [held[a + shallow:a + n] for a, n in zip(at, length)]
        order[start:start + size] = some[BlindTrie(texts).sorted()]
    return order, common_prefixes(strings, order, group)


def common_prefixes(strings: Strings, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), np.int64)
    if not len(order):
        return out
    left, right = order[:-1], order[1:]
    live = np.flatnonzero(group[left] == group[right])
    out[0] = -1
    out[1:][group[left] != group[right]] = -1
    depth = 0
    while len(live):
        a, na = strings.keys(left[live], np.full(len(live), depth))
        b, nb = strings.keys(right[live], np.full(len(live), depth))
        differ = a ^ b
        whole = (differ == 0) & (na == 8) & (nb == 8)
        equal = np.zeros(len(live), np.int64)                       # leading equal bytes of the eight
        rest = differ.copy()
        for k in range(8):
            same = (rest >> np.uint64(56 - 8 * k)) == 0
            equal += same
        out[1:][live] += np.where(whole, 8, np.minimum(equal, np.minimum(na, nb)))
        live = live[whole]
        depth += 8
    return out
