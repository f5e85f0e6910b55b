"""Maximum matching in general graphs: augmenting paths with contracted blossoms.

Each search grows an alternating tree from a free vertex, breadth first.  Vertices of a
contracted odd cycle share a base; when two even vertices of one tree meet, the cycle
through their lowest common base is contracted, which makes its odd vertices even.
"""

from __future__ import annotations

from collections import deque


def maximum_pairs(edges: list[tuple]) -> tuple[set[tuple], list]:
    """The edges (as given) of a matching with the most edges, and a barrier; loops and repeats don't matter.

    The barrier proves the matching: without its vertices the graph falls into so many odd
    components that (vertices + barrier - odd components) / 2 edges is the most there can be.
    """
    index: dict = {}
    for u, v in edges:
        for x in (u, v):
            index.setdefault(x, len(index))
    near: list[list[int]] = [[] for _ in index]
    for u, v in dict.fromkeys(edges):
        if u != v:
            near[index[u]].append(index[v])
            near[index[v]].append(index[u])
    n = len(near)
    mate = [-1] * n
    for u, v in edges:  # a greedy start leaves few searches
        a, b = index[u], index[v]
        if a != b and mate[a] < 0 and mate[b] < 0:
            mate[a], mate[b] = b, a
    gone = [False] * n
    barrier: list[int] = []
    for root in range(n):
        if mate[root] < 0:
            barrier += _augment(root, near, mate, gone)
    names = list(index)
    chosen = {frozenset((names[a], names[b])) for a, b in enumerate(mate) if b > a}
    return {e for e in edges if e[0] != e[1] and frozenset(e) in chosen}, [names[x] for x in barrier]


class _Own(dict):
    """Each key stands for itself until it is set."""

    def __missing__(self, key):
        return key


def _augment(root: int, near: list[list[int]], mate: list[int], gone: list[bool]) -> list[int]:
    """Search from a free vertex and flip the path that is found; else return the tree's odd vertices.

    No later search can gain from the tree of a failed one, so its vertices are gone.  What a
    search touches, and so its cost, is its own tree.
    """
    base = _Own()  # a forest whose roots are the bases, with paths halved on the way
    link: dict[int, int] = {}  # the even vertex from which an odd one was reached
    even = {root}
    queue = deque([root])

    def find(x: int) -> int:
        while (up := base[x]) != x:
            base[x] = x = base[up]
        return x

    def common(a: int, b: int) -> int:
        seen = set()
        a, b = find(a), find(b)
        while True:  # both climb in turn, so that the cost is the cycle's
            if a >= 0:
                if a in seen:
                    return a
                seen.add(a)
                a = find(link[mate[a]]) if mate[a] >= 0 else -1
            a, b = b, a

    def mark(v: int, top: int, child: int) -> None:
        while find(v) != top:
            link[v] = child
            child = mate[v]
            if child not in even:
                even.add(child)
                queue.append(child)
            for x in (v, child):
                if find(x) == x:
                    base[x] = top
            v = link[child]

    while queue:
        v = queue.popleft()
        for w in near[v]:
            if gone[w]:
                continue
            if w in even:  # an odd cycle, unless contracted
                if find(v) != find(w):
                    top = common(v, w)
                    mark(v, top, w)
                    mark(w, top, v)
            elif w not in link:
                link[w] = v
                if mate[w] < 0:
                    while w >= 0:
                        v = link[w]
                        after = mate[v]
                        mate[v], mate[w] = w, v
                        w = after
                    return []
                even.add(mate[w])
                queue.append(mate[w])
    for x in (*even, *link):
        gone[x] = True
    return [x for x in link if x not in even]


def parts_without(edges: list[tuple], barrier: list) -> dict:
    """The part of each vertex outside the barrier: the least vertex that it reaches without the barrier's."""
    gone = set(barrier)
    parent = {x: x for e in edges for x in e if x not in gone}

    def root(x):
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for u, v in edges:
        if u not in gone and v not in gone:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}
