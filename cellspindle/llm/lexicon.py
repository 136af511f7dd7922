"""A minimal acyclic transducer over words: shared-suffix automaton with id outputs, as flat arrays for memory mapping.

Words enter in byte order; equal right-hand sides are merged as soon as they are complete (incremental minimisation).
Each edge carries the number of words that sort before those behind it, so the sum along a path is the word's index,
and the index addresses its ids. Lookup walks all words of a batch one byte a step, as array operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np

_DTYPES = {"keys": np.int64, "target": np.int32, "skip": np.int32, "final": np.uint8, "begin": np.int64, "ids": np.int32}


def compile_words(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """Serialised transducer of (word, ids); words are distinct and not empty."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []

    def freeze(node: list) -> int:
        sign = (node[0], tuple(node[1]))
        if sign not in register:
            register[sign] = len(edges)
            edges.append(sign[1])
            finals.append(node[0])
        return register[sign]

    def close(path: list, depth: int) -> None:
        while len(path) > depth + 1:
            child = path.pop()
            parent = path[-1]
            parent[1].append((child[2], freeze(child)))

    path: list[list] = [[False, [], -1]]  # final, finished edges, incoming byte
    previous = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(path, common)
        path.extend([False, [], b] for b in word[common:])
        path[-1][0] = True
        previous = word
    close(path, 0)
    root = freeze(path[0])

    behind = np.zeros(len(edges), np.int64)  # words behind a state; children are frozen before parents
    rows = []
    for state, out in enumerate(edges):
        seen = int(finals[state])
        for byte, to in out:
            rows.append((state << 8 | byte, to, seen))
            seen += int(behind[to])
        behind[state] = seen
    keys, target, skip = np.array(rows, np.int64).reshape(-1, 3).T
    order = np.argsort(keys)
    ids = [i for _, x in entries for i in x]
    arrays = {
        "keys": keys[order],
        "target": target[order],
        "skip": skip[order],
        "final": np.array(finals),
        "begin": np.cumsum([0, *(len(x) for _, x in entries)]),
        "ids": np.array(ids),
    }
    arrays = {k: np.ascontiguousarray(v, _DTYPES[k]) for k, v in arrays.items()}
    head = json.dumps({"root": root, "sizes": {k: len(v) for k, v in arrays.items()}}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    body = b"".join(v.tobytes() + b"\0" * (-v.nbytes % 64) for v in arrays.values())
    return len(head).to_bytes(8, "little") + head + body


class Lexicon:
    """Memory-mapped transducer."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + n].tobytes())
        at = 8 + n
        for name, size in head["sizes"].items():
            dtype = np.dtype(_DTYPES[name])
            setattr(self, name, raw[at : at + size * dtype.itemsize].view(dtype))
            at += size * dtype.itemsize + -(size * dtype.itemsize) % 64
        self.root = head["root"]

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Index of each word, -1 where it is not in the lexicon."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        found = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(lengths)
        state = np.full(len(live), self.root, np.int64)
        index = np.zeros(len(live), np.int64)
        step = 0
        while len(live) and len(self.keys):
            key = state << 8 | flat[begins[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, index = self.target[at].astype(np.int64), index[ok] + self.skip[at]
            step += 1
            ends = lengths[live] == step
            done = ends & (self.final[state] == 1)
            found[live[done]] = index[done]
            live, state, index = live[~ends], state[~ends], index[~ends]
        return found
